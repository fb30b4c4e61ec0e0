import random
import zlib

from loomline.llm import toxicity

BAD = ["blorg", "snarp", "fleck"]


def corpus(seed=1):
    rnd = random.Random(seed)
    words = [f"w{i}" for i in range(500)]
    docs, labels = [], []
    for i in range(900):
        toxic = rnd.random() < 0.2
        w = rnd.choices(words, k=rnd.randrange(20, 200))
        if toxic:
            for _ in range(4):
                w.insert(rnd.randrange(len(w)), rnd.choice(BAD) + rnd.choice(["", ",", "!"]))
        docs.append((i, " ".join(w)))
        labels.append((i, 1, int(toxic)))
    return docs, labels


def test_held_out_accuracy(spark):
    docs, labels = corpus()
    out = {r.doc_id: r for r in toxicity.score(spark.createDataFrame(docs, "doc_id long, text string"),
        spark.createDataFrame(labels, "doc_id long, quality int, toxic int")).collect()}
    assert all(out[i].held_out == (zlib.crc32(str(i).encode()) % 4 == 2) for i, _ in docs)
    held = [(out[i].predicted, y) for i, _, y in labels if out[i].held_out]
    assert sum(a == y for a, y in held) >= 0.97 * len(held)


def test_held_out_labels_are_never_used(spark):
    docs, labels = corpus()
    turned = [(i, q, 1 - y if zlib.crc32(str(i).encode()) % 4 == 2 else y) for i, q, y in labels]
    d = spark.createDataFrame(docs, "doc_id long, text string")
    a, b = (toxicity.learn(d, spark.createDataFrame(x, "doc_id long, quality int, toxic int")) for x in (labels, turned))
    assert a == b and 1 < len(a) < 5000


def test_edges(spark, docs, empty):
    labels = spark.createDataFrame([(5, 1, 1), (6, 1, 0), (None, 1, 1), (7, 1, None), (5, 0, 0)], "doc_id long, quality int, toxic int")
    out = toxicity.score(docs, labels)
    rows = {r.doc_id: r for r in out.collect()}
    assert out.count() == docs.count() and all(0 <= r.score <= 1 for r in rows.values())
    assert rows[0].score == rows[1].score == rows[2].score and rows[None].held_out is False
    assert toxicity.score(empty, labels).count() == 0
    assert toxicity.score(docs, labels.filter("false")).count() == docs.count()
    kept = toxicity.clean(docs, labels)
    assert kept.columns == docs.columns and kept.count() == out.filter("predicted = 0").count()
    assert {r.doc_id: r.score for r in kept.collect() if r.doc_id} == {r.doc_id: r.score for r in docs.collect() if r.doc_id and rows[r.doc_id].predicted == 0}
