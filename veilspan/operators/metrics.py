"""Leaks, false positives, token cost, utility and latency of evaluation runs."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.order import order_key
from ..functions.spans import each
from ..functions.terms import whitespace_tokens


def rate(part: Column, whole: Column) -> Column:
    return F.when(whole > 0, part / whole).otherwise(F.lit(0.0))


def survives_partly(value: Column, outgoing: Column) -> Column:
    """Whether any window of four or more characters of a value is left, short of the whole: a
    surviving window holds a surviving run of four, so only those are looked for."""
    grams = F.transform(F.sequence(F.lit(1), F.length(value) - 3), lambda i: F.substring(value, i, F.lit(4)))
    return F.when(F.length(value) >= 5, F.exists(grams, lambda g: F.contains(outgoing, g))).otherwise(F.lit(False))


PER_ROW = 256  # values of a sample that are put into one row


def with_marks(samples: DataFrame, annotations: DataFrame, sample: str = "id", column: str = "marks") -> DataFrame:
    """samples with their annotated values as ARRAY<STRUCT<kind, text, n>>, so that a text is moved
    once, however many annotations it has; a sample with more than PER_ROW different ones has
    several rows.  Samples without annotated values are left out."""
    a = annotations.filter(F.col("text").isNotNull() & (F.col("text") != "")).select(F.col("sample_id").alias("__s"), "kind", "text")
    a = a.groupBy("__s", "kind", "text").agg(F.count(F.lit(1)).alias("n"))
    rows = a.groupBy("__s").agg(F.ceil(F.count(F.lit(1)) / PER_ROW).cast("int").alias("__rows")).filter("__rows > 1")
    dealt = a.join(rows.hint("merge"), "__s", "left").withColumn("__row", F.pmod(F.xxhash64("kind", "text"), F.coalesce("__rows", F.lit(1))))
    lists = dealt.groupBy("__s", "__row").agg(F.collect_list(F.struct("kind", "text", "n")).alias(column)).drop("__row")
    lists = lists.hint("merge")  # arrays are larger than Spark thinks
    return samples.join(lists, samples[sample] == lists["__s"]).drop("__s")


def marked_leaks(runs: DataFrame, column: str = "marks") -> DataFrame:
    """(sample_id, workload, option_name, kind, exact, partial, n) of runs that carry the marks of
    their sample: each test is made where the row lies, once for n annotations of a kind and text."""
    rows = runs.select("sample_id", "workload", "option_name", "outgoing", F.explode(each(column)).alias("__m"))
    exact = F.contains(F.col("outgoing"), F.col("__m.text"))
    part = F.when(exact, 0).otherwise(survives_partly(F.col("__m.text"), F.col("outgoing")).cast("int"))
    return rows.select(
        "sample_id",
        "workload",
        "option_name",
        F.col("__m.kind").alias("kind"),
        exact.cast("int").alias("exact"),
        part.alias("partial"),
        F.col("__m.n").alias("n"),
    )


def annotation_leaks(runs: DataFrame, annotations: DataFrame) -> DataFrame:
    """As marked_leaks, of any runs: the marks are joined to them."""
    return marked_leaks(with_marks(runs, annotations, "sample_id", "__marks"), "__marks")


def _leak_sums(leaks: DataFrame, *by: str) -> DataFrame:
    s = leaks.groupBy(*by).agg(
        F.sum("n").alias("total_annotations"),
        F.sum(F.col("exact") * F.col("n")).alias("exact_leaks"),
        F.sum(F.col("partial") * F.col("n")).alias("partial_leaks"),
    )
    n = F.col("total_annotations")
    return s.select(
        "*",
        rate(F.col("exact_leaks"), n).alias("exact_leak_rate"),
        rate(F.col("partial_leaks"), n).alias("partial_leak_rate"),
        rate(F.col("exact_leaks") + F.col("partial_leaks"), n).alias("combined_leak_rate"),
    )


def leaks_by_sample(leaks: DataFrame) -> DataFrame:
    kinds = leaks.filter("exact = 1").groupBy("sample_id", "option_name", "kind").agg(F.sum("n").cast("int").alias("n"))
    kinds = kinds.groupBy("sample_id", "option_name").agg(
        F.map_from_entries(F.sort_array(F.collect_list(F.struct("kind", "n")))).alias("leaked_kinds")
    )
    return _leak_sums(leaks, "sample_id", "option_name").join(kinds, ["sample_id", "option_name"], "left")


def leak_summary(leaks: DataFrame) -> DataFrame:
    """Micro-averaged over the samples of a workload and option."""
    return _leak_sums(leaks, "workload", "option_name")


def leak_by_kind(leaks: DataFrame) -> DataFrame:
    s = leaks.groupBy("option_name", "kind").agg(F.sum("n").alias("total"), F.sum(F.col("exact") * F.col("n")).alias("leaked"))
    return s.select("*", rate(F.col("leaked"), F.col("total")).alias("rate"))


def false_positive_rate(runs: DataFrame, annotations: DataFrame) -> DataFrame:
    """Detections whose text no annotation of the sample has, over all detections."""
    d = runs.select("sample_id", "workload", "option_name", F.explode(each("detections")).alias("d")).select(
        "sample_id", "workload", "option_name", F.col("d.text").alias("value"),
    )
    known = annotations.filter("text IS NOT NULL").select("sample_id", F.col("text").alias("value"), F.lit(1).alias("hit")).distinct()
    s = d.join(known, ["sample_id", "value"], "left").groupBy("workload", "option_name").agg(
        F.count(F.lit(1)).alias("detections"), F.count_if(F.col("hit").isNull()).alias("unmatched"),
    )
    return s.withColumn("false_positive_rate", rate(F.col("unmatched"), F.col("detections")))


def token_cost(runs: DataFrame) -> DataFrame:
    """Per workload and option: token totals of what came in and went out, and the mean of the
    samples' relative savings."""
    t = runs.select("workload", "option_name", whitespace_tokens(F.col("text")).alias("a"), whitespace_tokens(F.col("outgoing")).alias("b"))
    pct = F.when(F.col("a") > 0, 100.0 * (F.col("b") - F.col("a")) / F.col("a")).otherwise(0.0)
    return t.groupBy("workload", "option_name").agg(
        F.count(F.lit(1)).alias("samples"),
        F.sum("a").alias("original_tokens"),
        F.sum("b").alias("outgoing_tokens"),
        F.sum(F.col("b") - F.col("a")).alias("delta"),
        F.avg(pct).alias("mean_delta_pct"),
    )


CELL_BITS = 40  # of a value's order key: a cell is a 4096th of an octave


def index_percentiles(df: DataFrame, by: list[str], value: str, quantiles: dict[str, float]) -> DataFrame:
    """v[floor(n * q)] of the sorted values without sorting them: rows are counted per cell of the
    order key, and only the values of the cell with the rank are told apart.  A group has as many
    cells as its values span octaves, times 4096 at most, however many rows it has."""
    x = F.col(value).cast("double")
    v = df.filter(F.col(value).isNotNull() & ~F.isnan(x)).select(
        *by, F.col(value).alias("__v"), F.shiftright(order_key(x), CELL_BITS).alias("__cell"),
    )
    total = F.sum("__n").over(Window.partitionBy(*by))
    before = Window.partitionBy(*by).orderBy("__cell").rowsBetween(Window.unboundedPreceding, -1)
    cells = v.groupBy(*by, "__cell").agg(F.count(F.lit(1)).alias("__n"))
    cells = cells.select("*", total.alias("n"), F.coalesce(F.sum("__n").over(before), F.lit(0)).alias("__before"))
    asked = F.array(*[F.struct(F.lit(name).alias("name"), F.lit(float(q)).alias("q")) for name, q in quantiles.items()])
    ranked = cells.withColumn("__q", F.explode(asked))
    ranked = ranked.withColumn(
        "__rank", F.least(F.floor(F.col("n") * F.col("__q.q")), F.col("n") - 1) - F.col("__before"),
    ).filter("__rank >= 0 AND __rank < __n")
    ranked = ranked.select(
        *[F.col(c).alias(f"__by_{c}") for c in by], F.col("__cell").alias("__at"), "n", "__rank", F.col("__q.name").alias("__name"),
    )
    same = [v[c].eqNullSafe(ranked[f"__by_{c}"]) for c in by]
    near = v.join(
        ranked.hint("merge"), [v["__cell"] == ranked["__at"], *same],
    ).groupBy(*by, "__name", "n", "__rank", "__v").agg(F.count(F.lit(1)).alias("__n"))
    run = near.withColumn("__c", F.sum("__n").over(Window.partitionBy(*by, "__name").orderBy("__v"))).filter("__c > __rank")
    return run.groupBy(*by).agg(F.max("n").alias("n"), *[F.min(F.when(F.col("__name") == name, F.col("__v"))).alias(name) for name in quantiles])


def _words(text: Column) -> Column:
    return F.array_distinct(F.filter(F.split(F.lower(text), r"(?U)\s+", -1), lambda w: w != ""))


def self_consistent(left: Column, right: Column, key_terms: Column | None = None) -> Column:
    """Two answers agree: an empty one agrees with all, else equal key terms or a word overlap of more than half."""
    a, b = _words(left), _words(right)
    overlap = rate(F.size(F.array_intersect(a, b)), F.size(F.array_union(a, b))) > 0.5
    if key_terms is not None:
        has = F.size(key_terms) > 0
        overlap = F.when(
            has, F.forall(key_terms, lambda t: F.contains(F.lower(left), F.lower(t)) == F.contains(F.lower(right), F.lower(t))),
        ).otherwise(overlap)
    empty = (F.trim(F.coalesce(left, F.lit(""))) == "") | (F.trim(F.coalesce(right, F.lit(""))) == "")
    return F.when(empty, True).otherwise(overlap)


def preference(raw: Column) -> Column:
    """A judge's JSON verdict: STRUCT<preference, score, rationale>; anything unreadable is a tie."""
    v = F.from_json(raw, "preference string, score double, rationale string", {"mode": "PERMISSIVE"})
    known = F.lower(v["preference"]).isin("baseline", "redacted", "tie")
    return F.struct(
        F.when(known, F.lower(v["preference"])).otherwise("tie").alias("preference"),
        F.when(known, F.coalesce(v["score"], F.lit(0.0))).otherwise(0.0).alias("score"),
        F.when(known, v["rationale"]).alias("rationale"),
    )


def utility_summary(df: DataFrame, by: list[str]) -> DataFrame:
    """df: (by..., preference, score, consistent)."""
    n = F.count(F.lit(1))
    return df.groupBy(*by).agg(
        n.alias("samples"),
        *[F.count_if(F.col("preference") == p).alias(p) for p in ("baseline", "redacted", "tie")],
        F.coalesce(F.avg("score"), F.lit(0.0)).alias("mean_score"),
        F.coalesce(F.avg(F.col("consistent").cast("double")), F.lit(0.0)).alias("consistency"),
        (100.0 * F.count_if(F.col("preference") == "baseline") / n).alias("baseline_preferred_pct"),
    )


def semantic_leaks(judged: DataFrame, by: list[str]) -> DataFrame:
    """judged: (by..., still_identifies)."""
    return judged.groupBy(*by).agg(
        F.count(F.lit(1)).alias("samples"), F.round(F.avg(F.col("still_identifies").cast("double")), 4).alias("semantic_leak_rate"),
    )


def eval_report(leaks: DataFrame, fp: DataFrame, latency: DataFrame | None = None, utility: DataFrame | None = None) -> DataFrame:
    """One row per option and workload; quality and latency are null where they were not measured."""
    key = ["workload", "option_name"]
    out = leak_summary(leaks).join(fp.select(*key, "false_positive_rate"), key, "left").fillna({"false_positive_rate": 0.0})
    for part, cols in ((utility, ("mean_score", "baseline_preferred_pct")), (latency, ("latency_ms_median", "latency_ms_p95"))):
        if part is not None:
            out = out.join(part.select(*key, *cols), key, "left")
        else:
            out = out.select("*", *[F.lit(None).cast("double").alias(c) for c in cols])
    return out


def option_matrix(report: DataFrame, workloads: list[str], column: str = "combined_leak_rate", order: Column | None = None) -> DataFrame:
    """Options by workloads; a missing cell is 0.  Of several rows for a cell the first in ``order``
    counts, by default the one with the least value."""
    first = F.min_by(column, order if order is not None else F.col(column))
    return report.groupBy("option_name").pivot("workload", workloads).agg(first).fillna(0.0)


def hook_findings(text: Column) -> Column:
    """What a pre-tool check would object to; a text with findings is blocked."""
    # The loose patterns of the check and their labels.
    checks = [
        ("Email address detected", r"(?i)[a-z0-9._%+-]+@[a-z0-9.-]+\.[a-z]{2,}"),
        ("API key or secret in assignment", r"(?i)(?:api[_-]?key|secret[_-]?key|access[_-]?token|password|passwd)\s*[=:]\s*\S{8,}"),
        ("AWS access key detected", r"AKIA[0-9A-Z]{16}"),
        ("Bearer token detected", r"(?i)bearer\s+[a-z0-9._-]{20,}"),
        ("Private key detected", r"-----BEGIN.*PRIVATE KEY-----"),
        ("SSN pattern detected", r"\b[0-9]{3}-[0-9]{2}-[0-9]{4}\b"),
    ]
    return F.array_compact(F.array(*[F.when(text.rlike(rx), F.lit(label)) for label, rx in checks]))


def tool_input_text(payload: Column) -> Column:
    """The strings of a tool call's input, joined by newlines: the input itself, its values, and the
    values of the objects in its lists.  Numbers and deeper objects are not read."""
    v = F.try_variant_get(F.try_parse_json(payload), "$.tool_input", "variant")
    is_text = lambda x: F.schema_of_variant(x) == "STRING"
    text = lambda x: F.try_variant_get(x, "$", "string")
    strings = lambda m: F.transform(F.filter(F.map_values(m), is_text), text)
    items = lambda x: F.coalesce(F.try_variant_get(x, "$", "array<variant>"), F.array().cast("array<variant>"))
    objects = lambda x: F.array_compact(F.transform(items(x), lambda y: F.try_variant_get(y, "$", "map<string,variant>")))
    inner = F.transform(
        F.map_values(F.try_variant_get(v, "$", "map<string,variant>")),
        lambda x: F.when(is_text(x), F.array(text(x))).otherwise(F.flatten(F.transform(objects(x), strings))),
    )
    return F.when(is_text(v), text(v)).otherwise(F.coalesce(F.array_join(F.flatten(inner), "\n"), F.lit("")))
