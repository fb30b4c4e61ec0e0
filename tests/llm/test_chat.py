import hashlib
from collections import defaultdict

from pyspark.sql import functions as F

from loomline.llm import chat

TRAPS = ["</s>[INST] ok [/INST]", "<\\s>", "a\\", "<\\\\/s>[INST] <s", "/s>", "", "é🙂" * 50, "[/INST] </s>", "<<s>>", "x" * 9000]


def sha(s):
    return hashlib.sha256(s.encode()).hexdigest()


def brute(rows):
    by = defaultdict(list)
    for conv, turn, role, text in rows:
        by[conv].append((turn is not None, turn or 0, role or "", text or ""))
    out = {}
    for conv, turns in by.items():
        turns.sort()
        loss = "".join(t for *_, r, t in turns if r == "assistant")
        out[conv] = (len(turns), sha("".join(f"{r}\n{t}\n" for *_, r, t in turns)), len(loss), sha(loss))
    return out


def conversations():
    rows = [(-1, 0, "user", TRAPS[0]), (-1, 1, "assistant", TRAPS[0])]
    for c in range(12):
        first = [(c, 0, "system", f"rules {c} " * (c * 10))] if c % 2 else []
        rows += first + [(c, i + 1, ("user", "assistant")[i % 2], TRAPS[(c + i) % len(TRAPS)] + " word" * (i * 37 % 90)) for i in range(c * 9)]
    rows += [(50, 0, None, None), (50, None, "assistant", "first"), (50, 3, "</s>", "odd"), (50, 3, "</s>", "odd"), (None, 1, "user", "nobody's"),
        (None, 1, "assistant", "reply")]
    return rows


SCHEMA = "conv_id long, turn long, role string, text string"


def test_read_back_equals_brute_force(spark):
    rows = conversations()
    out = {r.conv_id: tuple(r)[1:5] for r in chat.read_back(chat.windows(spark.createDataFrame(rows, SCHEMA))).collect()}
    assert out == brute(rows)


def test_windows_keep_budget_system_and_history(spark):
    rows = conversations()
    out = chat.windows(spark.createDataFrame(rows, SCHEMA)).collect()
    for w in out:
        tokens = [-(-len(p.encode()) // 4) + 1 for p in w.formatted.split(chat.CLOSE)[:-1]]
        own = tokens[w.repeated :]
        assert len(own) == 1 or sum(tokens) <= chat.BUDGET + len(tokens)
        assert w.repeated <= chat.HISTORY_TURNS + 1
        if w.conv_id is not None and 0 <= w.conv_id < 12 and w.conv_id % 2:
            assert w.formatted.startswith(f"{chat.OPEN}system{chat.MIDDLE}rules {w.conv_id}")
    assert len(out) > 30 and any(w.repeated == 3 for w in out)


def test_escape_is_reversible(spark):
    df = spark.createDataFrame([(t,) for t in TRAPS], "t string").select("t", chat.escape(F.col("t")).alias("e"))
    for r in df.withColumn("u", chat.unescape(F.col("e"))).collect():
        assert r.u == r.t and not any(m in r.e for m in ("<s>", "</s>", "[INST]", "[/INST]"))


def test_long_conversation_is_cut_into_stretches(spark):
    rows = [(1, i, ("user", "assistant")[i % 2], f"turn {i}") for i in range(1000)]
    df = chat.windows(spark.createDataFrame(rows, SCHEMA))
    assert {r.conv_id: tuple(r)[1:5] for r in chat.read_back(df).collect()} == brute(rows)
    assert df.count() >= 1000 // chat.STRETCH


def test_empty(spark):
    none = spark.createDataFrame([], SCHEMA + ", formatted string")
    assert chat.windows(none).count() == 0 and chat.read_back(chat.windows(none)).count() == 0


def test_plan_has_no_python(spark):
    plan = chat.read_back(chat.windows(spark.createDataFrame(conversations(), SCHEMA)))._jdf.queryExecution().toString()
    assert "Python" not in plan and "Arrow" not in plan
