"""Long system turns, long conversations' budgets, repeated rows and columns whose names clash."""

import pytest
from pyspark.sql import functions as F
from test_chat import SCHEMA, brute

from loomline.llm import chat


def tokens_of(window):
    return [-(-len((p + chat.CLOSE).encode()) // 4) for p in window.formatted.split(chat.CLOSE)[:-1]]


@pytest.mark.parametrize("system", [10, 1200, 1500, 1600, 8000, 200_000])
def test_no_window_goes_beyond_the_budget_but_for_a_single_long_turn(spark, system):
    rows = [(1, 0, "system", "s" * system)] + [(1, i, ("assistant", "user")[i % 2], f"turn {i} " * (i * 13 % 60)) for i in range(1, 60)]
    out = chat.windows(spark.createDataFrame(rows, SCHEMA)).collect()
    for w in out:
        tokens = tokens_of(w)
        assert sum(tokens) <= chat.BUDGET or len(tokens) - w.repeated == 1 and tokens[-1] > chat.BUDGET - chat.HISTORY_TOKENS - sum(tokens[: w.repeated])
    later = [w for w in out if not (w.part == 0 and w.sub == 0 and w.win == 0)]
    repeats = {w.formatted.startswith(f"{chat.OPEN}system") for w in later}
    assert repeats == {system <= 1500}
    assert sum(len(w.formatted) for w in out) < 3 * sum(len(r[3]) + 30 for r in rows) + 1600 * len(out)
    assert {r.conv_id: tuple(r)[1:5] for r in chat.read_back(chat.windows(spark.createDataFrame(rows, SCHEMA))).collect()} == brute(rows)


def test_repeated_rows_and_clashing_columns(spark):
    rows = [(1, 0, "user", "a"), (1, 1, "assistant", "b"), (1, 1, "assistant", "b"), (None, None, None, None)]
    df = spark.createDataFrame([(*r, "x", 5, "y") for r in rows], SCHEMA + ", key string, part int, `a.b` string").withColumn("run", F.lit(1))
    clash = df.toDF("conv_id", "turn", "role", "text", "Text", "part", "a.b", "run")
    for d in (df, clash):
        assert {r.conv_id: tuple(r)[1:5] for r in chat.read_back(chat.windows(d)).collect()} == brute(rows)
