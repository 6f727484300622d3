"""Placeholders restored in streams of deltas, and sessions that remember reverse maps.

A placeholder may be cut in two by a delta.  ``holdback`` keeps back what follows an unclosed
bracket until it is closed, can be no placeholder, or the stream ends, so a reader of the deltas
never sees half of one.
``prefix`` restores what has arrived so far and emits what follows the longest common prefix with
the last output; a reader who joins the deltas may then see stray halves.  State is kept per
(request, choice), so interleaved choices do not disturb each other.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from ..functions.redact import LEFT, TAG, restore

_OPEN = re.compile(f"{LEFT}[A-Z0-9_]*(?:{TAG}[0-9a-f]*)?$")  # what may become a placeholder


def replace_all(text: str, entries: list[tuple[str, str]]) -> str:
    for placeholder, original in entries:
        text = text.replace(placeholder, original)
    return text


def hold_back(kept: str, delta: str, last: bool) -> tuple[str, str]:
    """(what may be emitted, what is kept back): an open bracket is kept as long as what follows it
    can be the beginning of a placeholder."""
    text = kept + delta
    at = text.rfind(LEFT)
    if last or at < 0 or not _OPEN.match(text, at):
        return text, ""
    return text[:at], text[at:]


def common_prefix(a: str, b: str) -> int:
    n = 0
    for x, y in zip(a, b):
        if x != y:
            break
        n += 1
    return n


def parse_events(lines: DataFrame, column: str = "value") -> DataFrame:
    """Server-sent event lines: (done, passed_through, choice, delta), of answers as a list of
    choices or as deltas of content blocks; what is no data event, or cannot be read, is passed
    through."""
    body = F.when(F.col(column).startswith("data: "), F.expr(f"substring({column}, 7)"))
    event = F.from_json(body, "type string, index int, delta struct<text:string>, choices array<struct<index:int,delta:struct<content:string>>>")
    rows = lines.select("*", body.alias("__b"), event.alias("__e"))
    block = F.when(
        F.col("__e.type") == "content_block_delta",
        F.array(F.struct(F.col("__e.index").alias("index"), F.struct(F.col("__e.delta.text").alias("content")).alias("delta"))),
    )
    rows = rows.select("*", F.explode_outer(F.coalesce("__e.choices", block)).alias("__c"))
    done = F.coalesce((F.trim("__b") == "[DONE]") | (F.col("__e.type") == "message_stop"), F.lit(False))
    return rows.select(
        *lines.columns,
        done.alias("done"),
        (F.col("__c").isNull() & ~done).alias("passed_through"),
        F.coalesce("__c.index", F.lit(0)).alias("choice"),
        F.col("__c.delta.content").alias("delta"),
    )


def restore_stream(deltas: DataFrame, mode: str = "holdback") -> DataFrame:
    """deltas: (request_id, choice, seq, delta, last, reverse_map array<struct<placeholder,original>>), a
    stream.  -> (request_id, choice, seq, delta) restored."""

    def step(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        kept, shown = state.get if state.exists else ("", "")
        rows, ended = pd.concat(list(batches)).sort_values("seq"), False
        out = []
        for r in rows.itertuples():
            entries = [(e["placeholder"], e["original"]) for e in (r.reverse_map if r.reverse_map is not None else [])]
            if mode == "prefix":
                kept += r.delta or ""
                new = replace_all(kept, entries)
                out.append(new[common_prefix(shown, new) :])
                shown = new
            else:
                text, kept = hold_back(kept, r.delta or "", bool(r.last))
                out.append(replace_all(text, entries))
            ended = ended or bool(r.last)
        state.remove() if ended else state.update((kept, shown))
        yield pd.DataFrame({"request_id": key[0], "choice": key[1], "seq": rows["seq"], "delta": out})

    return deltas.groupBy("request_id", "choice").applyInPandasWithState(
        step, "request_id string, choice int, seq bigint, delta string", "kept string, shown string", "append", GroupStateTimeout.NoTimeout,
    )


def restore_batch(deltas: DataFrame, maps: DataFrame) -> DataFrame:
    """The whole restored answer of each request and choice: (request_id, choice, restored).  deltas:
    (request_id, choice, seq, delta); maps: (request_id, reverse_map), joined to the whole answers."""
    whole = deltas.groupBy("request_id", "choice").agg(F.sort_array(F.collect_list(F.struct("seq", "delta"))).alias("d"))
    text = F.array_join(F.transform("d", lambda x: F.coalesce(x["delta"], F.lit(""))), "")
    both = whole.select("request_id", "choice", text.alias("text")).join(maps.select("request_id", "reverse_map").hint("merge"), "request_id", "left")
    return both.select(
        "request_id",
        "choice",
        F.when(F.col("reverse_map").isNull(), F.col("text")).otherwise(restore(F.col("text"), F.col("reverse_map"))).alias("restored"),
    )


# ---------------------------------------------------------------- sessions
DIGIT, RANKED = 12, 10_000  # bits of a key that are counted at a time; rows of a group that may be ranked as they are


def live_sessions(sessions: DataFrame, cap: int = 2000, by: list[str] | None = None) -> DataFrame:
    """The newest ``cap`` sessions (per ``by``), those of one time in the descending order of the
    MD5 of their id.  They are found digit by digit: sessions are counted per digit of the time and
    then of the MD5, newer ones than the digit with the cap stay, older ones go, and only those of
    that digit are looked at again, until there are few enough of them to be ranked."""
    by = by or []
    name = dict(sessions.dtypes)["created_at"]
    time = F.unix_micros("created_at") if name.startswith("timestamp") and "ntz" not in name else F.col("created_at").cast("bigint")
    rows = sessions.filter("created_at IS NOT NULL").withColumn("__t", time).withColumn(
        "__m", F.conv(F.substring(F.md5(F.col("session_id").cast("string").cast("binary")), 1, 12), 16, 10).cast("bigint"),
    )
    ends = rows.agg(F.min("__t").alias("low"), F.max("__t").alias("high")).first()
    if ends["low"] is None:
        return sessions.limit(0)
    bits = max(1, (ends["high"] - ends["low"]).bit_length())
    bits += -bits % DIGIT
    digits = [
        (F.col("__t") - ends["low"], bits - DIGIT * (i + 1)) for i in range(bits // DIGIT)
    ] + [(F.col("__m"), 48 - DIGIT * (i + 1)) for i in range(4)]
    open_, kept = rows.withColumn("__left", F.lit(cap).cast("bigint")), None
    for key, shift in digits:
        open_ = open_.withColumn("__d", F.shiftright(key, shift).bitwiseAND(F.lit((1 << DIGIT) - 1)))
        counts = open_.groupBy(*by, "__d").agg(F.count(F.lit(1)).alias("__n"), F.first("__left").alias("__had"))
        newer = F.coalesce(F.sum("__n").over(Window.partitionBy(*by).orderBy(F.desc("__d")).rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
        edge = counts.withColumn("__room", F.col("__had") - newer).filter("__room > 0").drop("__had")
        near = _null_safe(open_.drop("__left"), edge, [*by, "__d"])
        whole = near.filter("__n <= __room").select(*sessions.columns)
        kept = whole if kept is None else kept.unionByName(whole)
        open_ = near.filter("__n > __room").withColumn("__left", F.col("__room")).drop("__n", "__room", "__d")
        most = edge.filter("__n > __room").agg(F.max("__n").alias("n")).first()["n"]
        if most is None:
            return kept
        if most <= RANKED:
            break
    order = [F.desc("__t"), F.desc(F.md5(F.col("session_id").cast("string").cast("binary")))]
    rank = F.row_number().over(Window.partitionBy(*by).orderBy(*order))
    last = open_.withColumn("__r", rank).filter("__r <= __left").select(*sessions.columns)
    return kept.unionByName(last)


def _null_safe(left: DataFrame, right: DataFrame, keys: list[str]) -> DataFrame:
    """Inner join on keys where null equals null."""
    other = right.select(*[F.col(c).alias(f"__r_{c}") if c in keys else F.col(c) for c in right.columns])
    return left.join(other, [left[c].eqNullSafe(other[f"__r_{c}"]) for c in keys]).drop(*[f"__r_{c}" for c in keys])


def restore_session(texts: DataFrame, sessions: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(texts restored, sessions that are left): texts: (session_id, text).  A session is consumed by
    its use; one that is gone or unknown leaves its text unchanged, with an error."""
    j = texts.join(sessions.select("session_id", "reverse_map"), "session_id", "left")
    gone = F.col("reverse_map").isNull()
    text = F.when(gone, F.col("text")).otherwise(restore(F.col("text"), F.col("reverse_map")))
    done = j.select("session_id", text.alias("text"), F.when(gone, "unknown or expired session").alias("error"))
    return done, sessions.join(texts.select("session_id").distinct(), "session_id", "left_anti")


def detections_per_window(events: DataFrame, time: str, spans: str, width: str = "1 minute", late: str = "10 minutes") -> DataFrame:
    """Detections by kind in tumbling windows; batch or stream (an extension)."""
    rows = events.withWatermark(time, late) if events.isStreaming else events
    rows = rows.select(F.col(time).alias("__t"), F.explode(F.transform(spans, lambda s: s["kind"])).alias("kind"))
    return rows.groupBy(F.window("__t", width).alias("w"), "kind").agg(F.count(F.lit(1)).alias("n")).select(
        F.col("w.start").alias("window_start"), "kind", "n",
    )
