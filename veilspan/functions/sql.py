"""SQL names for the operators: register(spark), then SELECT detect_spans(text), redact_text(text), ..."""

from __future__ import annotations

import re

import pyarrow as pa
from pyspark.sql import SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, StringType, StructField, StructType

from .patterns import PATTERNS, Pattern
from .redact import LEFT, RIGHT
from .spans import SPAN, SPANS, python_spans, scan

_NAMES = [f.name for f in SPAN.fields]
_ENTRY = StructType([StructField("placeholder", StringType()), StructField("original", StringType())])


def merged(found: list[tuple]) -> list[tuple]:
    out: list[tuple] = []
    for s in sorted(found, key=lambda s: (s[0], s[0] - s[1], s[6])):
        if not out or s[0] >= out[-1][1]:
            out.append(s)
        elif s[3] > out[-1][3]:
            out[-1] = s
    return out


def redact_one(text: str | None, compiled, found: list[tuple] | None = None) -> tuple[str | None, list[tuple[str, str]]]:
    """The redacted text and its reverse map; ``found`` are its merged spans, if they are known."""
    if not text:
        return text, []
    spans, known, counts = merged(python_spans(text, compiled)) if found is None else found, {}, {}
    for s in reversed(spans):
        if s[4] not in known:
            counts[s[2]] = counts.get(s[2], 0) + 1
            known[s[4]] = f"{LEFT}{s[2].upper()}_{counts[s[2]]}{RIGHT}"
    parts, at = [], 0
    for s in spans:
        parts += [text[at : s[0]], known[s[4]]]
        at = s[1]
    return "".join([*parts, text[at:]]), [(p, o) for o, p in known.items()]


_ALL = StructType([StructField("redacted", StringType()), StructField("spans", SPANS), StructField("reverse_map", ArrayType(_ENTRY))])


def register(spark: SparkSession, patterns: tuple[Pattern, ...] = PATTERNS) -> None:
    """redact_all, with the redacted text, the spans and the reverse map of one scan, and its parts
    detect_spans, redact_text and reverse_map; restore_text; explode_spans as a table function.  All
    but the table function work on Arrow batches."""
    compiled = [(p, re.compile(p.python)) for p in patterns]

    def whole(texts: pa.Array) -> list[dict]:
        texts = texts.cast(pa.string())
        out = []
        for t, found in zip(texts.to_pylist(), scan(texts, compiled)):
            spans = merged([(a, b, compiled[o][0].kind, 1.0, t[a:b], "regex", o) for a, b, o in found])
            redacted, entries = redact_one(t, compiled, spans)
            out.append(
                {
                    "redacted": redacted,
                    "spans": [dict(zip(_NAMES, s)) for s in spans],
                    "reverse_map": [{"placeholder": p, "original": o} for p, o in entries],
                }
            )
        return out

    span = pa.struct([(f.name, {"int": pa.int32(), "double": pa.float64()}.get(f.dataType.simpleString(), pa.string())) for f in SPAN.fields])
    entry = pa.struct([("placeholder", pa.string()), ("original", pa.string())])
    types = {"redacted": (StringType(), pa.string()), "spans": (SPANS, pa.list_(span)), "reverse_map": (ArrayType(_ENTRY), pa.list_(entry))}

    @F.arrow_udf(_ALL)
    def redact_all(texts: pa.Array) -> pa.Array:
        return pa.array(whole(texts), pa.struct([(n, t) for n, (_, t) in types.items()]))

    spark.udf.register("redact_all", redact_all)
    for name, part in (("detect_spans", "spans"), ("redact_text", "redacted"), ("reverse_map", "reverse_map")):
        kind, arrow = types[part]

        def one(texts: pa.Array, part: str = part, arrow: pa.DataType = arrow) -> pa.Array:
            return pa.array([x[part] for x in whole(texts)], arrow)

        spark.udf.register(name, F.arrow_udf(lambda texts, one=one: one(texts), kind))

    def back(text: pa.Array, entries: pa.Array) -> pa.Array:
        out = []
        for t, es in zip(text.to_pylist(), entries.to_pylist()):
            for e in es or []:
                t = t.replace(e["placeholder"], e["original"]) if t is not None else None
            out.append(t)
        return pa.array(out, pa.string())

    spark.udf.register("restore_text", F.arrow_udf(back, StringType()))

    @F.udtf(returnType="start int, `end` int, kind string, confidence double, text string, source string")
    class ExplodeSpans:
        def eval(self, text: str):
            for s in merged(python_spans(text, compiled)):
                yield s[:6]

    spark.udtf.register("explode_spans", ExplodeSpans)
