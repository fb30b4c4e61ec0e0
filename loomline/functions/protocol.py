"""Versions, deprecation and idempotency windows, graph status: predicates as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from loomline.errors import UnsupportedMessageType, VersionMismatch

TERMINAL, ACTIVE = ("Completed", "Failed", "Cancelled"), ("Pending", "Running")


def compatible(a: Column, b: Column) -> Column:
    """Versions as structs (major, minor, patch): equal majors."""
    return a["major"] == b["major"]


def newer(a: Column, b: Column) -> Column:
    return F.struct(a["major"], a["minor"], a["patch"]) > F.struct(b["major"], b["minor"], b["patch"])


def version_text(v: Column) -> Column:
    return F.concat_ws(".", v["major"].cast("string"), v["minor"].cast("string"), v["patch"].cast("string"))


def supported(v: Column, versions: Column) -> Column:
    return F.exists(versions, lambda s: compatible(v, s))


def supported_text(versions: Column) -> Column:
    return F.array_join(F.transform(versions, version_text), ", ")


def removal(deprecated_at: Column, days: Column) -> Column:
    return deprecated_at + F.make_dt_interval(days)


def is_deprecated(deprecated_at: Column, now: Column) -> Column:
    return now >= deprecated_at


def is_removed(deprecated_at: Column, days: Column, now: Column) -> Column:
    return now >= removal(deprecated_at, days)


def key_valid(created: Column, ttl_hours: Column, now: Column) -> Column:
    """Strictly before the key's end."""
    return now < created + F.make_dt_interval(F.lit(0), ttl_hours)


def is_terminal(status: Column) -> Column:
    return status.isin(*TERMINAL)


def is_active(status: Column) -> Column:
    return status.isin(*ACTIVE)


def status_text(status: Column, message: Column) -> Column:
    return F.when(status == "Failed", F.concat(F.lit("failed: "), F.coalesce(message, F.lit("")))).otherwise(F.lower(status))


#: The kinds of messages of the control plane, of gossip and of the data plane.
MESSAGES = (
    "SubmitGraph", "GetStatus", "CancelExecution", "AllocateNodes", "Gossip", "Heartbeat", "Join", "Leave", "Failure", "ExecuteStage", "StageComplete", "DataTransfer")
CURRENT = (1, 0, 0)
_VERSION = "struct<major:int,minor:int,patch:int>"
ENVELOPE = f"id string, version {_VERSION}, message_type string, payload string, timestamp timestamp, source string, target string"


def version(major: int, minor: int, patch: int) -> Column:
    return F.struct(*[F.lit(x).cast("int").alias(n) for n, x in zip(("major", "minor", "patch"), (major, minor, patch), strict=True)])


def version_error(v: Column, versions: Column) -> Column:
    """Null for a version that one of those supported is compatible with, else what is wrong."""
    text = F.concat(F.lit("Protocol version mismatch: expected one of "), supported_text(versions), F.lit(", got "), version_text(v))
    return F.when(~supported(v, versions), text)


def kind_error(kind: Column) -> Column:
    """Null for a kind of message that there is, else what is wrong."""
    return F.when(~F.coalesce(kind.isin(*MESSAGES), F.lit(False)), F.concat(F.lit("Unsupported message type: "), F.coalesce(kind, F.lit(""))))


def envelope(id: Column, kind: Column, payload: Column, source: Column, timestamp: Column, target: Column | None = None, v: Column | None = None) -> Column:
    """A message as JSON text; the payload is JSON text of its own within it."""
    return F.to_json(F.struct(
        id.alias("id"), (version(*CURRENT) if v is None else v).alias("version"), kind.alias("message_type"), payload.alias("payload"), timestamp.alias("timestamp"),
        source.alias("source"), (F.lit(None).cast("string") if target is None else target).alias("target")))


def opened(message: Column) -> Column:
    """The struct of an envelope; null fields of text that is none."""
    return F.from_json(message, ENVELOPE)


def message_error(message: Column, versions: Column) -> Column:
    """Null for a message that can be taken, else the first thing that is wrong with it."""
    m = opened(message)
    broken = m["id"].isNull() | m["message_type"].isNull() | m["source"].isNull()
    return F.when(broken, F.concat(F.lit("Invalid message: "), F.coalesce(message, F.lit("")))).otherwise(F.coalesce(kind_error(m["message_type"]),
        version_error(m["version"], versions)))


def validate_version(v: tuple[int, int, int], versions: list[tuple[int, int, int]]) -> None:
    """Raises unless one of the versions has v's major number."""
    if not any(v[0] == s[0] for s in versions):
        raise VersionMismatch(", ".join(".".join(map(str, s)) for s in versions), ".".join(map(str, v)))


def validate_kind(kind: str) -> None:
    if kind not in MESSAGES:
        raise UnsupportedMessageType(kind)
