"""Span columns: detection, union, overlap resolution, policy and summaries.

A text owns ARRAY<STRUCT<start, end, kind, confidence, text, source, ord>>; offsets are code points,
end exclusive; ord is the rank of the pattern and decides ties.  Everything is row by row.

``engine="native"`` stays in the JVM: a pattern's matches and the gaps between them are extracted and
their lengths summed up, which reads a text up to three times per pattern that hits.
``engine="python"`` runs the same patterns over Arrow batches: for each pattern the texts of a batch
that can have a match are picked by vectorised tests, and only these are scanned.  "auto" takes the
native one for up to NATIVE_UP_TO patterns: with all 39 the other is several times as fast (see the
README).  Both give the same spans.  Patterns of a user that have groups run in the second only.
"""

from __future__ import annotations

import re
from functools import reduce
from operator import or_

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, DoubleType, IntegerType, StringType, StructField, StructType

from .patterns import PATTERNS, Pattern
from .taxonomy import allowed

_FIELDS = [
    ("start", IntegerType()),
    ("end", IntegerType()),
    ("kind", StringType()),
    ("confidence", DoubleType()),
    ("text", StringType()),
    ("source", StringType()),
    ("ord", IntegerType()),
]
SPAN = StructType([StructField(n, t) for n, t in _FIELDS])
SPANS = ArrayType(SPAN)
SPANS_DDL = "array<struct<start:int,end:int,kind:string,confidence:double,text:string,source:string,ord:int>>"


NATIVE_UP_TO = 6


def no_spans() -> Column:
    return F.array().cast(SPANS_DDL)


def _matches(text: Column, p: Pattern, ord: int) -> Column:
    rx = F.lit(p.java)
    whole = F.regexp_extract_all(text, rx, F.lit(0))
    gaps = F.split(text, p.java, -1)  # one more than matches; the last pair has no match
    if p.group:
        before, value = F.regexp_extract_all(text, rx, F.lit(1)), F.regexp_extract_all(text, rx, F.lit(2))
        parts = F.arrays_zip(gaps.alias("g"), whole.alias("m"), before.alias("b"), value.alias("v"))
    else:
        parts = F.arrays_zip(gaps.alias("g"), whole.alias("m"))

    def add(acc: Column, x: Column) -> Column:
        at = acc["at"] + F.length(x["g"])
        start = at + F.length(x["b"]) if p.group else at
        value = x["v"] if p.group else x["m"]
        span = F.struct(
            start.alias("start"),
            (start + F.length(value)).alias("end"),
            F.lit(p.kind).alias("kind"),
            F.lit(1.0).alias("confidence"),
            value.alias("text"),
            F.lit("regex").alias("source"),
            F.lit(ord).alias("ord"),
        )
        return F.when(x["m"].isNull(), acc).otherwise(F.struct((at + F.length(x["m"])).alias("at"), F.array_append(acc["out"], span).alias("out")))

    return F.aggregate(parts, F.struct(F.lit(0).alias("at"), no_spans().alias("out")), add, lambda acc: acc["out"])


def detect(text: Column, patterns: tuple[Pattern, ...] = PATTERNS, engine: str = "auto") -> Column:
    """Every match of every pattern, in order of the patterns; a null text has none."""
    if engine == "python" or (engine == "auto" and len(patterns) > NATIVE_UP_TO) or any(p.own for p in patterns):
        return _detect_python(text, patterns)
    each = []
    for i, p in enumerate(patterns):
        hit = text.rlike(p.java)
        if p.hints:
            # lower() differs from (?iU) for three letters only: dotted and dotless i, long s
            hit = reduce(or_, [F.contains(F.lower(text), F.lit(h)) for h in p.hints], F.contains(text, F.lit("ſ"))) & hit
        if p.guard:
            hit = F.contains(text, F.lit(p.guard)) & hit
        each.append(F.when(hit, _matches(text, p, i)).otherwise(no_spans()))
    return F.coalesce(F.concat(*each), no_spans())


def _place(m: re.Match, p: Pattern) -> tuple[int, int]:
    if p.group:
        return m.span(2)
    return m.span(1) if p.own and m.start(1) >= 0 else m.span()


def python_spans(text: str | None, compiled: list[tuple[Pattern, re.Pattern]]) -> list[tuple]:
    """Of one text, without the tests of a batch."""
    out, low = [], (text or "").lower().replace("ſ", "s")
    for i, (p, rx) in enumerate(compiled):
        if text and p.may_match(text, low):
            for m in rx.finditer(text):
                a, b = _place(m, p)
                out.append((a, b, p.kind, 1.0, text[a:b], "regex", i))
    return out


def scan(texts: pa.Array, compiled: list[tuple[Pattern, re.Pattern]]) -> list[list[tuple[int, int, int]]]:
    """(start, end, ord) of every match, by text and then by pattern."""
    low = pc.replace_substring(pc.utf8_lower(texts), "ſ", "s")
    values, out = texts.to_pylist(), [[] for _ in range(len(texts))]
    for i, (p, rx) in enumerate(compiled):
        mask = pc.is_valid(texts)
        if p.guard is not None:
            mask = pc.and_kleene(mask, pc.match_substring(texts, p.guard))
        if p.hints:
            mask = pc.and_kleene(mask, reduce(pc.or_kleene, [pc.match_substring(low, h) for h in p.hints]))
        if p.needs is not None:
            mask = pc.and_kleene(mask, pc.match_substring_regex(texts, p.needs))
        for at in pc.indices_nonzero(pc.fill_null(mask, False)).to_pylist():
            for m in rx.finditer(values[at]):
                out[at].append((*_place(m, p), i))
    return out


_ARROW = [pa.int32(), pa.int32(), pa.string(), pa.float64(), pa.string(), pa.string(), pa.int32()]


def as_arrow(texts: pa.Array, found: list[list[tuple[int, int, int]]], kinds: list[str]) -> pa.ListArray:
    """Spans built column by column."""
    values, ends = texts.to_pylist(), [0]
    for spans in found:
        ends.append(ends[-1] + len(spans))
    flat = [(a, b, o, values[at][a:b]) for at, spans in enumerate(found) for a, b, o in spans]
    ords = pa.array([x[2] for x in flat], pa.int32())
    n = len(flat)
    columns = [
        pa.array([x[0] for x in flat], pa.int32()), pa.array([x[1] for x in flat], pa.int32()), pc.take(
            pa.array(kinds, pa.string()), ords,
        ), pa.array([1.0] * n, pa.float64()),
        pa.array([x[3] for x in flat], pa.string()), pa.array(["regex"] * n, pa.string()), ords,
    ]
    fields = [pa.field(name, kind) for (name, _), kind in zip(_FIELDS, _ARROW)]
    return pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.StructArray.from_arrays(columns, fields=fields))


def _detect_python(text: Column, patterns: tuple[Pattern, ...]) -> Column:
    compiled, kinds = [(p, re.compile(p.python)) for p in patterns], [p.kind for p in patterns]

    @F.arrow_udf(SPANS)
    def detected(texts: pa.Array) -> pa.Array:
        texts = texts.cast(pa.string())
        return as_arrow(texts, scan(texts, compiled), kinds)

    # a barrier: else the call may be copied into filters and into lambdas, where it cannot run
    return detected.asNondeterministic()(text)


def merge(spans: Column) -> Column:
    """Overlaps resolved from left to right, longer first, then by ord: a span that starts inside
    the last kept one replaces it if its confidence is strictly higher, and is dropped otherwise."""
    keyed = F.transform(spans, lambda s: F.struct(s["start"].alias("a"), (s["start"] - s["end"]).alias("b"), s["ord"].alias("c"), s.alias("s")))
    ordered = F.transform(F.sort_array(keyed), lambda k: k["s"])

    def fold(out: Column, s: Column) -> Column:
        free = (F.size(out) == 0) | (s["start"] >= F.get(out, F.size(out) - 1)["end"])
        better = s["confidence"] > F.get(out, F.size(out) - 1)["confidence"]
        return F.when(free, F.array_append(out, s)).when(better, F.array_append(F.slice(out, 1, F.size(out) - 1), s)).otherwise(out)

    return F.aggregate(ordered, no_spans(), fold)


def by_policy(spans: Column, policy) -> Column:
    """After merging: a span outside the policy may have suppressed one inside it."""
    return F.filter(spans, lambda s: allowed(s["kind"], policy))


def above_floor(spans: Column, floor: float) -> Column:
    return F.filter(spans, lambda s: s["confidence"] >= floor)


def unsure(spans: Column, below: float = 0.5) -> Column:
    """Whether a strict pipeline refuses the text."""
    return F.exists(spans, lambda s: s["confidence"] < below)


def refusal_reasons(spans: Column, below: float = 0.5) -> Column:
    """Kind and the first eight characters of each span that causes a refusal."""
    low = F.filter(spans, lambda s: s["confidence"] < below)
    return F.transform(
        low,
        lambda s: F.struct(
            s["kind"].alias("kind"), s["confidence"].alias("confidence"), F.concat(F.substring(s["text"], 1, 8), F.lit("...")).alias("preview"),
        ),
    )


def kinds_of(spans: Column) -> Column:
    return F.array_distinct(F.transform(spans, lambda s: s["kind"]))


def each(column: str | Column) -> Column:
    """An array to be exploded.  As a bare column it would get a filter on its size, which is pushed
    below its own computation and repeats it."""
    return F.transform(column, lambda x: x)


def exploded(df: DataFrame, spans: str, *keep: str) -> DataFrame:
    """One row per span: (keep..., pos, start, end, kind, confidence, text, source)."""
    rows = df.select(*keep, F.posexplode(each(spans)).alias("pos", "__s"))
    return rows.select(*keep, "pos", *[F.col(f"__s.{n}").alias(n) for n, _ in _FIELDS if n != "ord"])


def count_by_kind(df: DataFrame, spans: str) -> DataFrame:
    return df.select(F.explode(F.transform(spans, lambda s: s["kind"])).alias("kind")).groupBy("kind").agg(F.count(F.lit(1)).alias("n"))
