"""Typed placeholders, reverse maps, restoration and the leak audit."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

LEFT, RIGHT, TAG = "⟨", "⟩", "·"  # fixed values: the brackets and the tag mark of a placeholder
ENTRIES = "array<struct<placeholder:string,original:string,kind:string>>"


def _placeholder(kind: Column, n: Column, tag: Column | None) -> Column:
    name = [F.lit(LEFT), F.upper(kind), F.lit("_"), n.cast("string")]
    return F.concat(*name, *([F.lit(TAG), tag] if tag is not None else []), F.lit(RIGHT))


def request_tag(request_id: Column) -> Column:
    """Eight hex digits that are the same whenever a request is replayed."""
    return F.substring(F.md5(request_id.cast("string").cast("binary")), 1, 8)


def entries(spans: Column, tag: Column | None = None) -> Column:
    """The reverse map: one entry per distinct text, from right to left, numbered within its kind.
    The rightmost occurrence of a text names the kind."""

    def add(acc: Column, s: Column) -> Column:
        known = F.exists(acc, lambda e: e["original"] == s["text"])
        n = F.size(F.filter(acc, lambda e: e["kind"] == s["kind"])) + 1
        new = F.struct(_placeholder(s["kind"], n, tag).alias("placeholder"), s["text"].alias("original"), s["kind"].alias("kind"))
        return F.when(known, acc).otherwise(F.array_append(acc, new))

    return F.aggregate(F.reverse(spans), F.array().cast(ENTRIES), add)


def placeholders(spans: Column, reverse_map: Column) -> Column:
    """In text order, with repeats."""
    return F.transform(spans, lambda s: F.get(F.filter(reverse_map, lambda e: e["original"] == s["text"]), F.lit(0))["placeholder"])


def splice(text: Column, spans: Column, names: Column) -> Column:
    """The text with the spans replaced by ``names``; spans are disjoint and in order."""
    start = F.struct(F.lit(0).alias("at"), F.lit("").alias("out"))

    def add(acc: Column, x: Column) -> Column:
        gap = F.substring(text, acc["at"] + 1, x["s"]["start"] - acc["at"])
        return F.struct(x["s"]["end"].alias("at"), F.concat(acc["out"], gap, x["p"]).alias("out"))

    pairs = F.arrays_zip(spans.alias("s"), names.alias("p"))
    done = F.aggregate(pairs, start, add, lambda acc: F.concat(acc["out"], F.substring(text, acc["at"] + 1, F.length(text))))
    return F.when(F.size(spans) == 0, text).otherwise(done)


def as_map(reverse_map: Column) -> Column:
    return F.map_from_entries(F.transform(reverse_map, lambda e: F.struct(e["placeholder"], e["original"])))


def restore(text: Column, reverse_map: Column) -> Column:
    """Each placeholder replaced in the order of the map; unknown ones stay."""
    return F.aggregate(reverse_map, text, lambda acc, e: F.replace(acc, e["placeholder"], e["original"]))


def restore_once(text: Column, reverse_map: Column) -> Column:
    """As restore, in a single pass: an original that looks like a placeholder is not expanded again."""
    rx = f"(?={LEFT})|(?<={RIGHT})"
    table = F.map_from_entries(F.transform(reverse_map, lambda e: F.struct(e["placeholder"], e["original"])))
    return F.when(F.size(reverse_map) == 0, text).otherwise(
        F.array_join(F.transform(F.split(text, rx, -1), lambda p: F.coalesce(F.try_element_at(table, p), p)), "")
    )


def audit(outgoing: Column, spans: Column) -> Column:
    """Bytes sent, values detected, and detected values that are still in what is sent."""
    sent = F.size(F.filter(spans, lambda s: F.contains(outgoing, s["text"])))
    return F.struct(F.octet_length(outgoing).alias("outgoing_bytes"), F.size(spans).alias("detected"), sent.alias("sent"))
