"""Chat formatting in budgeted windows, with DataFrame functions only.

Turns get their position in the conversation, and prefix sums of their tokens choose spans of whole turns that fit a
window's budget. Every window after the first repeats the conversation's system turn, if that is short enough to leave
room, and a limited history before its own turns. Only assistant texts that are new in a window are under its loss mask, so each is learned once.

Turns are gathered in stretches of STRETCH at most, so a very long conversation is spread over tasks and rows. A
stretch gets the last turns before it and the conversation's system turn from a table of these alone, and makes its
windows by itself.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from loomline.llm.text import positional

#: Marks of a turn; the control strings within them are escaped where texts or roles have them.
OPEN, MIDDLE, CLOSE = "<s>[INST] ", " [/INST] ", "</s>"
#: Tokens of a window, tokens and turns of history within it, and turns of a stretch. A token is four bytes of text.
BUDGET, HISTORY_TOKENS, HISTORY_TURNS, STRETCH = 1024, 256, 2, 64
_CONTROL = r"([<\[])(\\*)(/?s>|/?INST\])"
_ESCAPED = r"([<\[])\\(\\*)(/?s>|/?INST\])"


def escape(text: Column) -> Column:
    """A backslash more within each control string, so that none is left; unescape() takes it away."""
    return F.regexp_replace(text, _CONTROL, r"$1\\$2$3")


def unescape(text: Column) -> Column:
    return F.regexp_replace(text, _ESCAPED, "$1$2$3")


def _stretches(conversations: DataFrame) -> DataFrame:
    """(conv_id, key, part, sub, run): STRETCH turns at most in order, each with its formatted piece. Texts are exchanged
    once, by conversation and stretch of turn numbers; more turns than that with few numbers make more subs."""
    held, (conv, turn, role, text) = positional(conversations, "conv_id", "turn", "role", "text")
    rows = held.select(
        F.col(conv).cast("long").alias("conv_id"), F.coalesce(F.col(conv).cast("long").cast("string"), F.lit("null")).alias("key"),
            F.col(turn).cast("long").alias("turn"),
        F.coalesce(F.col(role).cast("string"), F.lit("")).alias("role"), F.coalesce(F.col(text).cast("string"), F.lit("")).alias("text"))
    rows = rows.withColumn("part", F.coalesce(F.floor(F.col("turn") / STRETCH), F.lit(-(1 << 60))))
    own = F.row_number().over(Window.partitionBy("key", "part").orderBy(F.col("turn").asc_nulls_first(), "role", "text"))
    held = rows.withColumn("own", own).withColumn("sub", F.floor((F.col("own") - 1) / STRETCH)).withColumn("text", escape(F.col("text")))
    piece = F.concat(F.lit(OPEN), escape(F.col("role")), F.lit(MIDDLE), F.col("text"), F.lit(CLOSE))
    turn = F.struct(
        "own", (F.col("role") == "assistant").alias("learned"), (F.col("role") == "system").alias("head"), piece.alias("piece"),
            F.char_length("text").cast("long").alias("chars"),
        F.ceil(F.octet_length(piece) / 4).alias("tokens"))
    return held.groupBy("conv_id", "key", "part", "sub").agg(F.sort_array(F.collect_list(turn)).alias("run"))


def _surroundings(stretches: DataFrame, history_turns: int) -> DataFrame:
    """(key, part, around): for each sub of a stretch the turns before it, the system turn, and whether it is the first."""
    order = Window.partitionBy("key").orderBy("part", "sub")
    size = F.size("run")
    tail = F.slice("run", F.greatest(size - history_turns + 1, F.lit(1)), F.lit(max(history_turns, 0)))
    head = F.when(F.col("run")[0]["head"], F.col("run")[0])
    slim = stretches.select("key", "part", "sub", tail.alias("tail"), head.alias("head"))
    first = F.row_number().over(order) == 1
    seen = slim.select("key", "part", "sub", F.lag("tail").over(order).alias("before"),
        F.first("head").over(order.rowsBetween(Window.unboundedPreceding, 0)).alias("system"), first.alias("first"))
    return seen.groupBy("key", "part").agg(F.collect_list(F.struct("sub", "before", "system", "first")).alias("around"))


def _spans(run: Column, room: Column) -> Column:
    """Array of (at, n): runs of whole turns, from index `at`, whose prefix sums of tokens differ by the room at most."""

    def step(acc: Column, t: Column) -> Column:
        full = (acc["sum"] > 0) & (acc["sum"] + t["tokens"] > room)
        done = F.struct(acc["at"].alias("at"), (acc["i"] - acc["at"]).alias("n"))
        return F.struct(
            F.when(full, t["tokens"]).otherwise(acc["sum"] + t["tokens"]).alias("sum"), F.when(full, acc["i"]).otherwise(acc["at"]).alias("at"),
                (acc["i"] + 1).alias("i"),
            F.when(full, F.concat(acc["out"], F.array(done))).otherwise(acc["out"]).alias("out"))

    start = F.struct(F.lit(0).cast("long").alias("sum"), F.lit(0).alias("at"), F.lit(0).alias("i"), F.array().cast("array<struct<at:int,n:int>>").alias("out"))
    return F.aggregate(run, start, step, lambda acc: F.concat(acc["out"], F.array(F.struct(acc["at"].alias("at"), (acc["i"] - acc["at"]).alias("n")))))


def _repeat(t: Column) -> Column:
    """A turn as it is repeated: not learned."""
    return F.struct(t["own"].alias("own"), F.lit(False).alias("learned"), t["head"].alias("head"), t["piece"].alias("piece"),
        t["chars"].alias("chars"), t["tokens"].alias("tokens"))


def _recent(turns: Column, most: int) -> Column:
    """The last of the turns, as far back as their tokens sum to at most so many; never the system turn."""

    def step(acc: Column, t: Column) -> Column:
        total = acc["sum"] + t["tokens"]
        good = acc["open"] & (total <= most) & ~t["head"]
        return F.struct(total.alias("sum"), good.alias("open"), (acc["n"] + F.when(good, 1).otherwise(0)).alias("n"))

    start = F.struct(F.lit(0).cast("long").alias("sum"), F.lit(True).alias("open"), F.lit(0).alias("n"))
    kept = F.aggregate(F.reverse(turns), start, step)["n"]
    return F.slice(turns, F.size(turns) - kept + 1, kept)


def _mask(turns: Column) -> Column:
    """Array of (start, end) of the learned texts in the turns' pieces, one after another."""

    def step(acc: Column, t: Column) -> Column:
        end = acc["at"] + F.char_length(t["piece"])
        stop = end - len(CLOSE)
        own = F.array(F.struct((stop - t["chars"]).alias("start"), stop.alias("end")))
        return F.struct(end.alias("at"), F.when(t["learned"], F.concat(acc["mask"], own)).otherwise(acc["mask"]).alias("mask"))

    start = F.struct(F.lit(0).cast("long").alias("at"), F.array().cast("array<struct<start:bigint,end:bigint>>").alias("mask"))
    return F.aggregate(turns, start, step)["mask"]


def windows(conversations: DataFrame, budget: int = BUDGET, history_tokens: int = HISTORY_TOKENS, history_turns: int = HISTORY_TURNS) -> DataFrame:
    """conversations(conv_id, turn, role, text, ...) -> conv_id, part, sub, win, formatted, mask, repeated.

    Windows of a conversation are in order of (part, sub, win). formatted holds the system turn, history and own turns;
    the first `repeated` turns are no window's own here. mask is an array of (start, end) in code points of formatted:
    the own assistant texts. A turn that is longer than a window has one to itself; no turn is cut, so that only such a
    window goes beyond the budget. The system turn is a conversation's first, if its role is system; one that takes more
    than half of what history leaves of the budget is in the first window only. History reaches back into the stretch
    before, no further. A very long conversation is spread over stretches, and columns may have any names beside these.
    Rows are ordered by turn, then role and text; repeated rows are turns of their own. Null text or role: empty; null
    turn: first; null conv_id: one conversation. Other columns are not read; no rows, no windows.
    """
    stretches = _stretches(conversations)
    rows = stretches.join(_surroundings(stretches, history_turns), ["key", "part"])
    rows = rows.withColumn("around", F.filter("around", lambda s: s["sub"] == F.col("sub"))[0]).select("conv_id", "part", "sub", "run",
        "around.before", "around.system", "around.first")
    none = F.slice("run", 1, 0)
    rows = rows.withColumn("system", F.when(F.col("system")["tokens"] <= (budget - history_tokens) // 2, F.col("system")))
    room = F.greatest(F.lit(budget - history_tokens) - F.coalesce(F.col("system")["tokens"], F.lit(0)), F.lit(1))
    rows = rows.withColumn("before", F.coalesce("before", none)).withColumn("spans", _spans(F.col("run"), room))

    def gathered(w: Column, i: Column) -> Column:
        at = F.size("before") + w["at"]
        low = F.greatest(at - history_turns, F.lit(0))
        recent = F.transform(_recent(F.slice(F.concat("before", "run"), low + 1, at - low), history_tokens), _repeat)
        opens = F.col("system").isNull() | (F.col("first") & (i == 0))
        lead = F.concat(F.when(opens, none).otherwise(F.array(_repeat(F.col("system")))), recent)
        return F.struct(i.alias("win"), lead.alias("lead"), F.slice("run", w["at"] + 1, w["n"]).alias("own"))

    def finished(w: Column) -> Column:
        turns = F.concat(w["lead"], w["own"])
        return F.struct(w["win"].alias("win"), F.array_join(F.transform(turns, lambda t: t["piece"]), "").alias("formatted"),
            _mask(turns).alias("mask"), F.size(w["lead"]).alias("repeated"))

    made = rows.select("conv_id", "part", "sub", F.explode(F.transform(F.transform("spans", gathered), finished)).alias("w"))
    return made.select("conv_id", "part", "sub", "w.*")


def read_back(formatted: DataFrame) -> DataFrame:
    """windows() -> conv_id, n_turns, turns_sha256, loss_chars, loss_sha256, formatted_chars, from the formatted text
    and its mask alone. The digests need all of a conversation's text in one row."""
    pieces = F.split("formatted", CLOSE)
    own = F.slice(pieces, F.col("repeated") + 1, F.size(pieces) - 1 - F.col("repeated"))
    parts = lambda p: F.split(p, r" \[/INST\] ", 2)
    turn = lambda p: F.concat(unescape(F.substring(parts(p)[0], len(OPEN) + 1, 1 << 30)), F.lit("\n"), unescape(parts(p)[1]), F.lit("\n"))
    learned = lambda m: unescape(F.col("formatted").substr((m["start"] + 1).cast("int"), (m["end"] - m["start"]).cast("int")))
    read = formatted.select("conv_id", F.struct("part", "sub", "win").alias("at"), F.size(own).cast("long").alias("n"),
        F.array_join(F.transform(own, turn), "").alias("turns"),
                            F.array_join(F.transform("mask", learned), "").alias("loss"), F.char_length("formatted").cast("long").alias("chars"))
    whole = read.groupBy("conv_id").agg(F.sum("n").alias("n_turns"), F.sort_array(F.collect_list(F.struct("at", "turns", "loss"))).alias("run"),
        F.sum("chars").alias("formatted_chars"))
    joined = lambda c: F.array_join(F.transform("run", lambda r: r[c]), "")
    out = whole.withColumns({"turns": joined("turns"), "loss": joined("loss")})
    return out.select("conv_id", "n_turns", F.sha2("turns", 256).alias("turns_sha256"), F.char_length("loss").cast("long").alias("loss_chars"),
        F.sha2("loss", 256).alias("loss_sha256"), "formatted_chars")
