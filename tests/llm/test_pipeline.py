import random
import zlib

import pytest

import corpus_pipeline as cp

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]
SECRET = "password=abcdef123456"


@pytest.fixture(scope="module")
def corpus(spark, tmp_path_factory):
    rnd = random.Random(8)
    vocabulary = [f"w{i}" for i in range(800)]
    text = lambda n: " ".join(rnd.choices(vocabulary, k=n))
    item = text(30)
    docs, labels, planted = [], [], {}
    for i in range(400):
        t, kind = text(rnd.randrange(30, 120)), "clean"
        if i % 8 == 0:
            t, kind = " ".join(w + (" blorg" if k % 9 == 0 else "") for k, w in enumerate(t.split())), "toxic"
        elif i % 17 == 0:
            t, kind = f"{t} {item} {text(20)}", "leak"
        elif i % 19 == 0:
            t, kind = f"{t} {SECRET} {text(5)}", "secret"
        elif i % 23 == 1 and docs:
            t, kind = docs[-1][1], "copy"
        docs.append((i, t, "en", "s", len(t)))
        planted[i] = kind
        labels.append((i, 1, int(kind == "toxic")))
    docs.append((1000, None, None, None, None))
    docs.append((1001, "", None, None, 0))
    path = str(tmp_path_factory.mktemp("sf"))
    spark.createDataFrame(docs, "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"{path}/documents.parquet")
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int").write.parquet(f"{path}/labels.parquet")
    spark.createDataFrame([(1, item)], "item_id long, text string").write.parquet(f"{path}/benchmark.parquet")
    return path, {d[0]: d[1] for d in docs}, planted


def test_stages_do_their_work(spark, corpus):
    path, texts, planted = corpus
    docs = spark.read.parquet(f"{path}/documents.parquet")
    stage = dict(cp.STAGES)
    assert [n for n, _ in cp.STAGES] == ["toxicity", "near_duplicates", "decontamination", "secrets", "tokens"]

    kept = stage["toxicity"](spark, docs, path)
    ids = {r.doc_id for r in kept.collect()}
    held_in = [i for i, k in planted.items() if zlib.crc32(str(i).encode()) % 4 != 2]
    assert kept.columns == COLUMNS and not [i for i in held_in if planted[i] == "toxic" and i in ids]
    assert sum(i not in ids for i, k in planted.items() if k != "toxic" and not (k == "copy" and planted[i - 1] == "toxic")) <= 2 and {1000, 1001} <= ids

    kept = stage["near_duplicates"](spark, docs, path)
    ids = {r.doc_id for r in kept.collect()}
    assert kept.columns == COLUMNS and ids == {i for i in texts if planted.get(i) != "copy"}

    kept = stage["decontamination"](spark, docs, path)
    ids = {r.doc_id for r in kept.collect()}
    item = spark.read.parquet(f"{path}/benchmark.parquet").first().text
    assert kept.columns == COLUMNS and ids == {i for i, t in texts.items() if item not in (t or "")}

    out = {r.doc_id: r for r in stage["secrets"](spark, docs, path).select(*COLUMNS).collect()}
    assert {i: r.text for i, r in out.items()} == {i: (t or "").replace(SECRET, "[SECRET]") for i, t in texts.items()}
    assert all(r.n_chars == len(r.text) for r in out.values())

    tokens = stage["tokens"](spark, docs, path).collect()
    assert len(tokens) == len(texts) and all(r.round_trip and r.n_tokens == len(r.ids) for r in tokens)


def test_run_equals_stages_in_order(spark, corpus):
    path, texts, planted = corpus
    docs = spark.read.parquet(f"{path}/documents.parquet")
    for _, stage in cp.STAGES:
        docs = stage(spark, docs, path)
    want = sorted((r.doc_id, r.n_tokens) for r in docs.collect())
    assert sorted((r.doc_id, r.n_tokens) for r in cp.run(spark, path).collect()) == want and 200 < len(want) < 350


def test_empty_table(spark, corpus, tmp_path):
    path, _, _ = corpus
    none = spark.read.parquet(f"{path}/documents.parquet").filter("false")
    for _, stage in cp.STAGES:
        none = stage(spark, none, path)
    assert none.count() == 0
