"""Every core query by name: (session, folder) -> DataFrame over whole tables."""

from __future__ import annotations

import json
import os
import tempfile
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .. import config
from ..functions import noise, patterns, redact, spans, sql, taxonomy, terms
from ..operators import metrics, models, ner, pipeline
from ..sources import io, workloads
from ..streaming import restore as streams

POLICY = ("pii", "cloud_credential")


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


def _dealt(df: DataFrame) -> DataFrame:
    """Rows dealt over the cores: a text costs far more than its bytes."""
    n = df.sparkSession.sparkContext.defaultParallelism
    return df if df.rdd.getNumPartitions() >= n else df.repartition(n)


def _texts(spark: SparkSession, folder: str, *more: str) -> DataFrame:
    return _dealt(table(spark, folder, "samples").select("id", "workload", "text", *more))


def _documents(spark: SparkSession, folder: str, *more: str) -> DataFrame:
    return _dealt(table(spark, folder, "documents").select("doc_id", "text", *more))


def _spans(s, d, *more: str, policy=None, **kw) -> DataFrame:
    return pipeline.with_spans(_texts(s, d, *more), policy=policy, **kw)


def _redacted(s, d, *more: str, tagged: bool = False, **kw) -> DataFrame:
    """``tagged``: placeholders carry a tag of the request, so that those a text holds are left alone."""
    return pipeline.with_redaction(_spans(s, d, *more, **kw), tag=redact.request_tag(F.col("id")) if tagged else None)


def _runs(s, d, options=pipeline.OPTIONS) -> DataFrame:
    return pipeline.runs(_texts(s, d), options)


def _annotations(s, d) -> DataFrame:
    """Each annotation once, its latest delivery."""
    a = table(s, d, "annotations").filter("ann_id IS NOT NULL")
    return a.groupBy("ann_id").agg(
        F.max(F.struct("annotated_at", "sample_id", "kind", "text", "span_start", "span_end")).alias("x")
    ).select("ann_id", "x.*")


def _leaks(s, d, options=pipeline.OPTIONS) -> DataFrame:
    marked = metrics.with_marks(table(s, d, "samples").select("id", "workload", "text"), _annotations(s, d))
    return metrics.marked_leaks(pipeline.runs(_dealt(marked), options, carry=("marks",)))


def _md5(c: str | Column) -> Column:
    return F.md5((F.col(c) if isinstance(c, str) else c).cast("binary"))


def _long(c: Column) -> Column:
    return c.cast("bigint")


def _request() -> Column:
    """Messages of a client and batch are a request; one without client is a request of its own."""
    return F.when(F.col("client_id").isNotNull(), F.concat_ws("/", "client_id", "batch_id")).otherwise(F.concat(F.lit("/"), "id"))


def _role() -> Column:
    return F.when(F.col("workload") == "wl3_implicit", "assistant").otherwise("user")


def _unsure_of_hosts(df: DataFrame) -> DataFrame:
    """Host names held to be uncertain."""
    return df.withColumn(
        "spans", F.transform("spans", lambda x: x.withField("confidence", F.when(x["kind"] == "hostname_internal", 0.3).otherwise(x["confidence"]))),
    )


def _echo(prompt: str) -> str:
    return prompt


# ---------------------------------------------------------------- detection
def detect_counts_by_kind(s, d):
    return spans.count_by_kind(_documents(s, d).select(spans.detect(F.col("text")).alias("spans")), "spans")


def detect_spans(s, d):
    return spans.exploded(_texts(s, d).withColumn("spans", spans.detect(F.col("text"))), "spans", "id").select("id", "kind", "start", "end", "text")


def merge_spans(s, d):
    return spans.exploded(_spans(s, d), "spans", "id").select("id", "kind", "start", "end")


def merge_spans_native(s, d):
    return spans.exploded(_spans(s, d, engine="native"), "spans", "id").select("id", "kind", "start", "end")


def category_rollup(s, d):
    k = spans.exploded(_spans(s, d), "spans", "id").select("kind", taxonomy.category(F.col("kind")).alias("category"))
    return k.rollup("category", "kind").agg(F.count(F.lit(1)).alias("n"))


def policy_filter(s, d):
    return spans.count_by_kind(_spans(s, d, policy=POLICY), "spans")


def kind_categories(s, d):
    """Detections joined with the kind table, which is fixed and small."""
    k = spans.count_by_kind(_spans(s, d), "spans")
    return k.join(F.broadcast(taxonomy.kind_table(s)), "kind", "left").select(
        "kind", F.coalesce("category", F.lit(taxonomy.UNKNOWN)).alias("category"), "n",
    )


def distinct_kinds(s, d):
    k = _spans(s, d).select("id", F.array_join(F.array_sort(spans.kinds_of(F.col("spans"))), "|").alias("kinds"))
    return k.filter("kinds <> ''")


def custom_patterns(s, d):
    """A known kind in its place, US phones, and a kind of the user's with a group, from a patterns file."""
    told = {"patterns": {"email": r"@[a-z0-9.]+", "order": r"\b(?:order|ticket|build) #?(\d+)"}}
    with tempfile.NamedTemporaryFile("w", suffix=".json") as f:  # read at once, on the driver
        json.dump(told, f)
        f.flush()
        own = config.custom_patterns(f.name)
    pats = patterns.registry(own, patterns.PATTERNS[:2])
    return spans.exploded(
        _texts(s, d).withColumn("spans", spans.detect(F.col("text"), pats)), "spans", "id",
    ).select("id", "kind", "start", "end", "text")


def entity_spans(s, d):
    e = _texts(s, d).withColumn("spans", ner.without_false_positives(ner.entity_spans(F.col("text"))))
    return spans.exploded(e, "spans", "id").select("id", "kind", "start", "end", "confidence")


def reviewed_spans(s, d):
    """Patterns and entities merged, and reviewed by a stand-in that drops dates."""
    df = pipeline.with_spans(
        _texts(s, d), use_ner=True, reviewer=lambda prompt: "\n".join("DROP" if "kind=date_time" in x else "KEEP" for x in prompt.splitlines()[1:]),
    )
    return spans.count_by_kind(df, "spans")


def detections_per_hour(s, d):
    x = _spans(s, d, "created_at").filter("created_at IS NOT NULL")
    w = streams.detections_per_window(x, "created_at", "spans", "1 hour")
    return w.select(F.unix_timestamp("window_start").alias("window_start"), "kind", "n")


# ---------------------------------------------------------------- redaction and restoration
def redact_samples(s, d):
    return _redacted(s, d).select("id", _md5("redacted").alias("redacted_md5"), _long(F.size("placeholders")).alias("placeholders"))


def reverse_map_entries(s, d):
    return _redacted(s, d).select("id", F.explode(spans.each("reverse_map")).alias("e")).select("id", "e.placeholder", "e.original")


def restore_roundtrip(s, d):
    """Texts that hold placeholders of their own included."""
    r = _redacted(s, d, tagged=True).filter("text IS NOT NULL")
    back = lambda f: f(F.col("redacted"), F.col("reverse_map")) == F.col("text")
    return r.agg(
        F.count(F.lit(1)).alias("texts"),
        F.count_if(back(redact.restore)).alias("restored"),
        F.count_if(~back(redact.restore)).alias("not_restored"),
        F.count_if(back(redact.restore_once)).alias("restored_once"),
    )


def leak_audit(s, d):
    a = _redacted(s, d).filter("text IS NOT NULL").withColumn("a", redact.audit(F.col("redacted"), F.col("spans")))
    return a.select("id", *[_long(F.col(f"a.{c}")).alias(c) for c in ("outgoing_bytes", "detected", "sent")])


def strict_refusals(s, d):
    bad = pipeline.refused(_unsure_of_hosts(_spans(s, d)))
    return bad.select(
        "id", _long(F.size("reasons")).alias("reasons"), F.array_join(F.transform("reasons", lambda r: r["preview"]), "|").alias("previews"),
    )


def request_scope(s, d):
    """Messages of a client and batch as one request: placeholders numbered across its messages."""
    m = _dealt(table(s, d, "samples").select(_request().alias("request"), "id", "text"))
    r = pipeline.redact_messages(m, "request", "id", None, "text", scope="request")
    return r.select("request", "id", _md5("redacted").alias("redacted_md5"))


def message_roles(s, d):
    """Only the messages of users are redacted."""
    m = _texts(s, d).withColumn("role", _role()).withColumn("request", F.col("workload"))
    return pipeline.redact_messages(m, "request", "id", "role", "text", roles=("user",)).select("id", _md5("redacted").alias("redacted_md5"))


def request_maps(s, d):
    m = _dealt(table(s, d, "samples").select(_request().alias("request"), "id", "text"))
    return pipeline.request_maps(pipeline.redact_messages(m, "request", "id", None, "text"), "request", "id")


def redact_blocks(s, d):
    """Bodies of a text block and an image block, with two kinds redacted where the blocks lie."""
    pats = patterns.only({"email", "employee_id"})

    def change(text: Column) -> Column:
        found = spans.merge(spans.detect(text, pats, "native"))
        return redact.splice(text, found, redact.placeholders(found, redact.entries(found)))

    block = lambda kind: F.struct(F.lit(kind).alias("type"), F.col("text").alias("text"))
    b = _texts(s, d).filter("text IS NOT NULL").select("id", F.array(block("text"), block("image")).alias("blocks"))
    b = b.select("id", pipeline.redact_blocks(F.col("blocks"), change).alias("b"))
    return b.select("id", _md5(F.col("b")[0]["text"]).alias("first_md5"), _md5(F.col("b")[1]["text"]).alias("second_md5"))


def redact_pipeline(s, d):
    """Redaction, a model that repeats what it is told, restoration; requests about code are strict
    and refused where a host name is found, others say they are not."""
    low = _unsure_of_hosts(_spans(s, d))
    df = pipeline.with_redaction(low.filter("text IS NOT NULL"))
    stop = (F.col("workload") == "wl4_code") & spans.unsure(F.col("spans"))
    sent = models.with_answer(df.filter(~stop), F.col("redacted"), "response", _echo)
    sent = sent.select("id", F.lit("answered").alias("outcome"), _md5(redact.restore(F.col("response"), F.col("reverse_map"))).alias("restored_md5"))
    return sent.unionByName(df.filter(stop).select("id", F.lit("refused").alias("outcome"), F.lit(None).cast("string").alias("restored_md5")))


def restored_choices(s, d):
    """Two choices of an answer, restored."""
    r = models.with_answer(_redacted(s, d, tagged=True).filter("text IS NOT NULL"), F.col("redacted"), "response", _echo)
    choice = lambda i, c: F.struct(F.lit(i).alias("index"), c.alias("content"))
    c = r.select(
        "id",
        pipeline.restore_choices(
            F.array(choice(0, F.col("response")), choice(1, F.concat(F.lit("re: "), "response"))), F.col("reverse_map"),
        ).alias("c"),
    )
    return c.select("id", _md5(F.col("c")[0]["content"]).alias("first_md5"), _md5(F.col("c")[1]["content"]).alias("second_md5"))


def tool_gate(s, d):
    tools = F.when(F.col("workload") == "wl4_code", '[{"name":"run"}]').when(F.col("workload") == "wl2_secrets", "[]")
    todo, passed, stopped = pipeline.tool_gate(table(s, d, "samples").select("id", tools.alias("tools")), policy="refuse")
    said = lambda df, outcome: df.select("id", F.lit(outcome).alias("outcome"))
    return said(todo, "processed").unionByName(said(passed, "bypassed")).unionByName(said(stopped, "refused"))


def sql_functions(s, d):
    """The same by SQL names; one call scans a text once for all its parts."""
    sql.register(s)
    _texts(s, d).filter("text IS NOT NULL").createOrReplaceTempView("veilspan_texts")
    r = s.sql("SELECT id, redact_all(text) AS r FROM veilspan_texts")
    return r.select(
        "id", _md5("r.redacted").alias("redacted_md5"), _long(F.size("r.spans")).alias("spans"), _long(F.size("r.reverse_map")).alias("entries"),
    )


def counters(s, d):
    seen, o = pipeline.counted(_spans(s, d))
    seen.write.format("noop").mode("overwrite").save()
    got = o.get
    return s.createDataFrame([tuple(got[c] for c in ("texts", "spans", "uncertain"))], "texts bigint, spans bigint, uncertain bigint")


# ---------------------------------------------------------------- options
def leak_summary(s, d):
    return metrics.leak_summary(_leaks(s, d))


def leak_by_sample(s, d):
    return metrics.leaks_by_sample(_leaks(s, d)).select(
        "sample_id", "option_name", "total_annotations", "exact_leaks", "partial_leaks", "combined_leak_rate",
    )


def leak_by_kind(s, d):
    return metrics.leak_by_kind(_leaks(s, d)).select("option_name", "kind", "total", "leaked", "rate")


def leak_breakdown(s, d):
    """The breakdown of option B by kind as written and read back."""
    by_kind = metrics.leak_by_kind(_leaks(s, d, ("B",))).filter("kind IS NOT NULL").select("kind", "rate")
    return io.kind_breakdown_lines(by_kind)


def false_positive_rate(s, d):
    hiding = tuple(o for o in pipeline.OPTIONS if "B" in o)
    return metrics.false_positive_rate(_runs(s, d, hiding), _annotations(s, d)).select(
        "workload", "option_name", "detections", "unmatched", "false_positive_rate",
    )


def token_cost(s, d):
    return metrics.token_cost(_runs(s, d))


def option_matrix(s, d):
    return metrics.option_matrix(metrics.leak_summary(_leaks(s, d)), sorted(workloads.SIZES))


def evaluation(s, d):
    """All twelve options with the stand-in models."""
    hiding = tuple(o for o in pipeline.OPTIONS if "B" in o)
    report = metrics.eval_report(_leaks(s, d), metrics.false_positive_rate(_runs(s, d, hiding), _annotations(s, d)))
    return report.drop("mean_score", "baseline_preferred_pct", "latency_ms_median", "latency_ms_p95")


def option_labels(s, d):
    return _runs(s, d).groupBy("option_name", "label").agg(F.count(F.lit(1)).alias("n"))


def semantic_leaks(s, d):
    r = _runs(s, d, ("baseline", "B", "E")).filter("workload = 'wl3_implicit'")
    judged = r.withColumn(
        "still_identifies", models.judge_yes(models.answer(F.col("outgoing"), lambda t: "YES" if " who " in t or " turned " in t else "NO")),
    )
    return metrics.semantic_leaks(judged, ["workload", "option_name"])


def _judge(answer: str) -> str:
    """A stand-in that likes answers the less, the more placeholders they hold; it cannot read ten."""
    holes = answer.count(redact.LEFT)
    if holes > 9:
        return "unclear"
    return json.dumps({"preference": "baseline" if holes > 3 else "redacted", "score": holes / 10, "rationale": f"{holes} placeholders"})


def utility(s, d):
    r = models.with_answer(_redacted(s, d).filter("text IS NOT NULL"), F.col("redacted"), "verdict", _judge)
    v = r.withColumn("v", metrics.preference(F.col("verdict"))).withColumn("consistent", metrics.self_consistent(F.col("text"), F.col("redacted")))
    return metrics.utility_summary(v.select("workload", "v.preference", "v.score", "consistent"), ["workload"])


def routed(s, d):
    done, rest = pipeline.routed(_texts(s, d).filter("text IS NOT NULL"), "text", models.short_is_trivial, lambda t: "re: " + t)
    rest = rest.select("id", "classification", F.lit(None).cast("string").alias("response_md5"))
    return done.select("id", "classification", _md5("response").alias("response_md5")).unionByName(rest)


def online_c(s, d):
    """Redacted, rephrased where the user speaks, sent to a model that repeats it."""
    sent, _ = pipeline.online(_texts(s, d).filter("text IS NOT NULL").withColumn("role", _role()), "B+C", _echo, role="role", policy=None)
    return sent.select("id", "label", _md5("outgoing").alias("outgoing_md5"))


def online_ab(s, d):
    sent, _ = pipeline.online(_texts(s, d).filter("text IS NOT NULL"), "A+B", _echo, local=lambda t: "local: " + t, policy=None)
    return sent.select("id", "label", _md5("response").alias("response_md5"))


def online_h(s, d):
    sent, _ = pipeline.online(_texts(s, d).filter("text IS NOT NULL"), "B+H", _echo, policy=None)
    return sent.select("id", "label", _md5("outgoing").alias("outgoing_md5"))


def online_d(s, d):
    """Texts of clients that show measurements go to an attested enclave as they are."""
    enclave = (
        F.col("batch_id"),
        F.when(F.col("client_id").isNotNull(), F.create_map(F.lit("pcr0"), F.col("client_id"))).otherwise(F.create_map().cast("map<string,string>")),
    )
    sent, refused = pipeline.online(_texts(s, d, "client_id", "batch_id").filter("text IS NOT NULL"), "D", _echo, enclave=enclave)
    sent = sent.select("id", F.lit(None).cast("string").alias("refusal"), _md5("response").alias("response_md5"))
    return sent.unionByName(refused.select("id", "refusal", F.lit(None).cast("string").alias("response_md5")))


def configured(s, d):
    """Option B with the policy of a configuration."""
    told = config.load(None, {"VEILSPAN_POLICY_CATEGORIES": ",".join(POLICY), "VEILSPAN_PIPELINE_OPTION": "B"})
    sent, _ = pipeline.configured(_texts(s, d).filter("text IS NOT NULL"), told, _echo)
    return sent.select("id", _md5("outgoing").alias("outgoing_md5"))


def model_failures(s, d):
    """Calls that fail leave a reason, and the job goes on."""

    def model(prompt: str) -> str:
        if "password" in prompt:
            raise ValueError("refused by the model")
        return prompt

    return models.failures(models.with_answer(_texts(s, d), F.col("text"), "response", model, threads=4), "response")


# ---------------------------------------------------------------- metrics
def latency_percentiles(s, d):
    r = table(s, d, "route_results").filter("latency_ms >= 0 AND NOT isnan(latency_ms)")
    return metrics.index_percentiles(r, ["option_name", "workload"], "latency_ms", {"p50": 0.5, "p95": 0.95})


def route_share(s, d):
    return pipeline.route_share(table(s, d, "route_results"))


def route_decisions(s, d):
    r = table(s, d, "route_results").withColumn("decided", models.decision(F.col("classifier_raw")))
    return r.groupBy("decided", "classification").agg(F.count(F.lit(1)).alias("n"))


def self_consistency(s, d):
    r = _redacted(s, d).filter("text IS NOT NULL")
    return r.groupBy("workload").agg(
        F.count(F.lit(1)).alias("pairs"), F.count_if(metrics.self_consistent(F.col("text"), F.col("redacted"))).alias("consistent"),
    )


def term_survival(s, d):
    t = _redacted(s, d).withColumn("terms", terms.technical_terms(F.col("text")))
    v = t.withColumn("v", terms.survival(F.col("terms"), F.col("redacted")))
    return v.select(
        "id",
        _long(F.size("terms")).alias("terms"),
        F.array_join("terms", "|").alias("term_list"),
        _long(F.size("v.surviving")).alias("surviving"),
        "v.survival_rate",
        "v.valid",
    )


def sample_prefix(s, d):
    return table(s, d, "samples").orderBy("id").limit(100).select("id", "workload")


def pairing_join(s, d):
    """Samples with both a baseline and a redacted measurement, by their latest one."""
    lr = table(s, d, "leak_results").withColumn("o", F.regexp_replace(F.lower("option_name"), r"\s+", ""))
    last = lr.groupBy("sample_id", "o").agg(F.max(F.struct("measured_at", "combined_leak_rate")).alias("m"))
    side = lambda o, c: last.filter(F.col("o") == o).select("sample_id", F.col("m.combined_leak_rate").alias(c))
    return side("baseline", "baseline_rate").join(side("b", "redacted_rate"), "sample_id")


# ---------------------------------------------------------------- transports without text
def fhe_score(s, d):
    f = _documents(s, d).filter("text IS NOT NULL").withColumn("f", pipeline.fhe_score(F.col("text")))
    return f.select("doc_id", "f.score", "f.sensitive", "f.confidence")


def mpc_shares(s, d):
    m = _documents(s, d).filter("text <> ''").select("doc_id", F.posexplode(pipeline.mpc_shares(F.col("text"))).alias("pos", "x"))
    return m.select("doc_id", _long(F.col("pos")).alias("pos"), *[F.col("x")[i].alias(f"share_{i}") for i in range(3)])


def split_activation(s, d):
    a = _documents(s, d).filter("text IS NOT NULL").withColumn("a", pipeline.split_activation(F.col("text")))
    return a.select(
        "doc_id",
        F.aggregate("a.token_ids", F.lit(0).cast("bigint"), lambda x, y: x + y).alias("id_sum"),
        _long(F.col("a.activation_shape")[0]).alias("tokens"),
    )


def dp_noise(s, d):
    n = _texts(s, d).filter("text IS NOT NULL").withColumn("n", noise.noised(F.col("text"), F.col("id"), epsilon=1.0))
    return n.select(
        "id", _md5("n.text").alias("noised_md5"), _long(F.col("n.words")).alias("words"), _long(F.col("n.substituted")).alias("substituted"),
    )


def transports(s, d):
    """Attestation of every row's enclave: its client and a measurement by its source."""
    t = table(s, d, "documents").select("doc_id", "client_id", "source")
    measured = F.map_filter(F.create_map(F.lit("pcr0"), F.col("source")), lambda _, v: v.isNotNull() & (v != ""))
    return t.select("doc_id", pipeline.attested(F.col("client_id"), measured).alias("attested"))


def hook_scan(s, d):
    h = _texts(s, d).filter("text IS NOT NULL").withColumn("f", metrics.hook_findings(F.col("text")))
    return h.select("id", F.array_join("f", "|").alias("findings"), (F.size("f") > 0).alias("blocked"))


def hook_payload(s, d):
    """Tool calls with the text among their strings, a number that is not read, and a list of objects."""
    value = F.struct(
        F.col("text").alias("a"), F.lit(5).alias("b"), F.array(F.struct(F.col("workload").alias("new"), F.lit(7).alias("line"))).alias("c"),
    )
    p = _texts(s, d).filter("text IS NOT NULL").select("id", metrics.tool_input_text(F.to_json(F.struct(value.alias("tool_input")))).alias("t"))
    return p.select("id", F.array_join(metrics.hook_findings(F.col("t")), "|").alias("findings"), _md5("t").alias("text_md5"))


# ---------------------------------------------------------------- annotations, sources and sinks
def annotate_occurrences(s, d):
    """Every place of each sample's annotated values; the values go to the text, once."""
    v = _annotations(s, d).filter("text <> ''").select("sample_id", F.lit("").alias("kind"), "text").distinct()
    t = metrics.with_marks(table(s, d, "samples").select(F.col("id").alias("sample_id"), F.col("text").alias("whole")), v, "sample_id")
    t = t.select("sample_id", "whole", F.explode(spans.each("marks")).alias("m")).select("sample_id", "whole", F.col("m.text").alias("value"))
    gaps = F.expr("split(whole, concat('\\\\Q', value, '\\\\E'), -1)")
    n = F.size("gaps") - 1
    at = F.transform(
        F.sequence(F.lit(1), n), lambda i: F.aggregate(F.slice("gaps", F.lit(1), i), (i - 1) * F.length("value"), lambda acc, g: acc + F.length(g)),
    )
    return t.withColumn("gaps", gaps).filter(F.size("gaps") > 1).select("sample_id", "value", F.explode(at).alias("start"))


def _placed(s, d) -> DataFrame:
    """Annotations that have a text beside what the sample holds at their place."""
    a = _annotations(s, d).filter("text IS NOT NULL")
    each = a.groupBy("sample_id", F.floor(F.col("span_start") / 100_000).alias("__row")).agg(
        F.collect_list(F.struct("ann_id", "kind", "text", "span_start", "span_end")).alias("a")
    )
    t = table(s, d, "samples").select(F.col("id").alias("sample_id"), F.col("text").alias("whole"))
    rows = each.join(t, "sample_id").select("sample_id", "whole", F.explode(spans.each("a")).alias("a"))
    there = F.substring("whole", F.col("a.span_start") + 1, F.col("a.span_end") - F.col("a.span_start"))
    return rows.select("sample_id", "whole", "a.*", (there == F.col("a.text")).alias("right"))


def validate_annotations(s, d):
    return _placed(s, d).filter("NOT right").select("ann_id", "sample_id", "span_start", "span_end")


def _annotated_samples(s, d) -> DataFrame:
    """Samples with their well-placed annotations."""
    ok = _placed(s, d).filter("right").groupBy("sample_id").agg(
        F.sort_array(
            F.collect_list(F.struct(F.col("span_start").alias("start"), F.col("span_end").alias("end"), "kind", "text"))
        ).alias("annotations")
    )
    t = table(s, d, "samples").filter("text IS NOT NULL").select("id", "text")
    none = F.array().cast("array<struct<start:int,end:int,kind:string,text:string>>")
    return t.join(ok, t["id"] == ok["sample_id"], "left").select("id", "text", F.coalesce("annotations", none).alias("annotations"))


def samples_roundtrip(s, d):
    """Samples written as JSON lines, checked, and read back."""
    path = io.scratch(s, "samples")
    io.write_samples(_annotated_samples(s, d), path)
    return io.read_samples(s, path).select("id", _md5("text").alias("text_md5"), _long(F.size("annotations")).alias("annotations"))


def runs_roundtrip(s, d):
    path = io.scratch(s, "runs")
    r = _redacted(s, d).filter("text IS NOT NULL")
    found = F.transform(
        "spans",
        lambda x: F.struct(x["kind"].alias("kind"), x["confidence"].alias("confidence"), x["text"].alias("text"), x["source"].alias("source")),
    )
    none = F.lit(None).cast("string")
    rows = r.select(
        F.col("id").alias("sample_id"), F.lit("B").alias("option"), F.col("text").alias("original_text"), F.col("redacted").alias("outgoing_text"), none.alias("response_text"), none.alias("restored_text"),
        found.alias("detections"), redact.as_map(
            F.col("reverse_map")
        ).alias("reverse_map"), F.lit(1.0).alias("latency_ms"), F.lit("offline").alias("mode"),
    )
    io.write_runs(rows, path)
    back = io.read_runs(s, path)
    return back.select(
        "sample_id",
        "option",
        _md5("outgoing_text").alias("outgoing_md5"),
        _long(F.size("detections")).alias("detections"),
        _long(F.size("reverse_map")).alias("entries"),
    )


def published(s, d):
    """Workloads as one dataset, partitioned by workload, read back."""
    path = io.scratch(s, "published")
    every = table(s, d, "samples").filter("text IS NOT NULL").select("id", "text", "workload")
    io.publish({w: every.filter(F.col("workload") == w).drop("workload") for w in workloads.SIZES}, path)
    return s.read.parquet(path).groupBy("workload").agg(F.count(F.lit(1)).alias("n"), _long(F.sum(F.length("text"))).alias("chars"))


def request_bodies(s, d):
    """Chat requests as JSON lines, some with tools, and as many that cannot be read."""
    t = _texts(s, d).filter("text IS NOT NULL")
    block = F.struct(F.lit("text").alias("type"), F.col("text").alias("text"))
    message = F.struct(F.lit("user").alias("role"), F.array(block).alias("content"))
    tools = F.when(
        F.col("workload") == "wl4_code", F.array(F.struct(F.lit("function").alias("type"), F.struct(F.lit("run").alias("name")).alias("function"))),
    )
    raw = t.select("id", F.to_json(F.struct(F.lit("m").alias("model"), F.array(message).alias("messages"), tools.alias("tools"))).alias("value"))
    raw = raw.unionByName(t.select(F.concat("id", F.lit("/broken")).alias("id"), F.lit("{no request").alias("value")))
    b = io.request_bodies(raw, keep=("id",))
    has = F.when(F.col("body").isNotNull(), F.size(F.coalesce("body.tools", F.array().cast("array<string>"))) > 0)
    return b.select("id", "body.model", _md5(io.message_text(F.col("body.messages")[0])).alias("content_md5"), has.alias("tools"))


def forwarded_headers(s, d):
    h = F.create_map(
        F.lit("Host"),
        F.lit("h"),
        F.lit("X-Batch"),
        F.col("batch_id"),
        F.lit("X-Client"),
        F.coalesce("client_id", F.lit("-")),
        F.lit("Connection"),
        F.lit("close"),
    )
    kept = models.forwarded_headers(h)
    pairs = F.array_sort(F.transform(F.map_entries(kept), lambda e: F.concat(e["key"], F.lit("="), e["value"])))
    return table(s, d, "samples").select("id", F.array_join(pairs, "|").alias("headers"))


def generated_workloads(s, d):
    parts = [
        workloads.generate(s, w).select("id", "text", F.size("annotations").alias("annotations"), F.lit(w).alias("workload")) for w in workloads.SIZES
    ]
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


# ---------------------------------------------------------------- sessions and streams
def session_cap(s, d):
    """The newest 50 sessions of each batch; a sample stands for a session."""
    x = table(s, d, "samples").filter("created_at IS NOT NULL").select(F.col("id").alias("session_id"), "batch_id", "created_at")
    return streams.live_sessions(x, 50, ["batch_id"]).select("session_id", "batch_id")


def session_restore(s, d):
    """Texts restored by the sessions that are still there."""
    r = _redacted(s, d, "batch_id", "created_at", tagged=True).filter("text IS NOT NULL").withColumnRenamed("id", "session_id")
    alive = streams.live_sessions(
        r.filter("created_at IS NOT NULL").select("session_id", "batch_id", "created_at"), 50, ["batch_id"],
    ).select("session_id")
    sessions = r.select("session_id", "reverse_map").join(alive, "session_id")
    done, _ = streams.restore_session(r.select("session_id", F.col("redacted").alias("text")), sessions)
    return done.select("session_id", _md5("text").alias("text_md5"), "error")


def _pieces(r: DataFrame, column: str, size: int) -> DataFrame:
    """(request_id, seq, delta, last): a text cut into pieces of ``size`` characters."""
    n = F.ceil(F.length(column) / size).cast("int")
    cutting = F.transform(F.sequence(F.lit(0), n - 1), lambda i: F.substring(column, i * size + 1, F.lit(size)))
    rows = r.select(F.col("id").alias("request_id"), n.alias("__n"), F.posexplode(cutting).alias("seq", "delta"))
    return rows.select("request_id", F.col("seq").cast("bigint").alias("seq"), "delta", (F.col("seq") == F.col("__n") - 1).alias("last"))


def stream_restore_final(s, d):
    """Redacted texts cut into pieces of seven characters, joined and restored."""
    r = _redacted(s, d, tagged=True).filter("text <> ''")
    pieces = _pieces(r, "redacted", 7).withColumn("choice", F.lit(0))
    whole = streams.restore_batch(pieces, r.select(F.col("id").alias("request_id"), "reverse_map"))
    return whole.select("request_id", _md5("restored").alias("restored_md5"))


def stream_restore(s, d):
    """Two interleaved choices of each request as a stream of deltas: the redacted text, and the plain
    one, which no placeholder of the request occurs in."""
    r = _redacted(s, d, tagged=True).filter("text <> ''")
    entries = F.transform("reverse_map", lambda e: F.struct(e["placeholder"].alias("placeholder"), e["original"].alias("original")))
    maps = r.select(F.col("id").alias("request_id"), entries.alias("reverse_map"))
    first = _pieces(r, "redacted", 97).join(maps, "request_id").withColumn("choice", F.lit(0))
    second = _pieces(r, "text", 97).withColumn(
        "reverse_map", F.array().cast("array<struct<placeholder:string,original:string>>"),
    ).withColumn("choice", F.lit(1))
    path = io.scratch(s, "deltas")
    first.unionByName(second).write.parquet(f"{path}/in")
    stream = s.readStream.schema(s.read.parquet(f"{path}/in").schema).parquet(f"{path}/in")
    q = streams.restore_stream(stream).writeStream.format("parquet").option("path", f"{path}/out").option(
        "checkpointLocation", f"{path}/state",
    ).trigger(availableNow=True).start()
    q.awaitTermination()
    whole = s.read.parquet(f"{path}/out").groupBy("request_id", "choice").agg(F.sort_array(F.collect_list(F.struct("seq", "delta"))).alias("d"))
    return whole.select("request_id", "choice", _md5(F.array_join(F.transform("d", lambda x: x["delta"]), "")).alias("restored_md5"))


def event_lines(s, d):
    """Server-sent events of two choices, an end and a comment for each text, as a source gives them."""

    def source(prompt: str):
        for choice in range(2):
            delta = prompt[choice * 50 : choice * 50 + 50]
            if choice == 0:
                yield "data: " + json.dumps({"choices": [{"index": 0, "delta": {"content": delta}}]}, ensure_ascii=False)
            else:
                yield "data: " + json.dumps({"type": "content_block_delta", "index": 1, "delta": {"type": "text_delta", "text": delta}})
        yield "data: [DONE]"
        yield ": ping"

    lines = models.event_lines(_texts(s, d).filter("text <> ''").withColumnRenamed("id", "request_id"), "request_id", F.col("text"), source)
    e = streams.parse_events(lines)
    return e.select("request_id", "choice", _md5("delta").alias("delta_md5"), "done", "passed_through")


# ---------------------------------------------------------------- reports
def _evals(s, d) -> DataFrame:
    """Each report row once: the first by the time it was reported."""
    e = table(s, d, "eval_rows")
    return e.groupBy("eval_id").agg(F.min_by(F.struct(*e.columns), "reported_at").alias("x")).select("x.*")


def report_lines(s, d):
    return io.csv_rows(_evals(s, d))


def report_markdown(s, d):
    return io.table_lines(_evals(s, d))


def report_latex(s, d):
    return io.table_lines(_evals(s, d), "latex")


def report_roundtrip(s, d):
    """The CSV report written and read back from several folders."""
    path, e = io.scratch(s, "reports"), _evals(s, d)
    for i in range(2):
        io.write_csv(e.filter(F.pmod("eval_id", F.lit(2)) == i), f"{path}/run{i}")
    return io.read_csv(s, f"{path}/run*").select("option_name", "workload", F.coalesce("combined_leak_rate", F.lit("")).alias("combined_leak_rate"))


def report_bundle(s, d):
    """The lines of the written Markdown, LaTeX and breakdown files; the breakdown is of annotations without text."""
    path = io.scratch(s, "bundle")
    a = _annotations(s, d).filter("kind IS NOT NULL")
    io.write_report(_evals(s, d), a.groupBy("kind").agg(F.avg(F.col("text").isNull().cast("double")).alias("rate")), path)
    name = F.element_at(F.split(F.col("_metadata.file_path"), "/"), -1)
    texts = s.read.text([f"{path}/{f}" for f in ("report.md", "report.tex", "leak_by_kind.md")])
    return texts.select(name.alias("file"), F.col("value").alias("line"))


def metrics_roundtrip(s, d):
    """The utility summary as JSON lines, read back."""
    summary, path = utility(s, d), io.scratch(s, "metrics")
    io.write_metrics(summary, path)
    return io.read_metrics(s, path, summary)


def pareto(s, d):
    return io.figure_data(_evals(s, d).fillna({"latency_ms_median": 0.0}))


_ALL = (
    detect_counts_by_kind, detect_spans, merge_spans, merge_spans_native, category_rollup, policy_filter, kind_categories, distinct_kinds, custom_patterns, entity_spans, reviewed_spans, detections_per_hour,
    redact_samples, reverse_map_entries, restore_roundtrip, leak_audit, strict_refusals, request_scope, message_roles, request_maps, redact_blocks, redact_pipeline, restored_choices, tool_gate, sql_functions, counters,
    leak_summary, leak_by_sample, leak_by_kind, leak_breakdown, false_positive_rate, token_cost, option_matrix, evaluation, option_labels, semantic_leaks, utility, routed, online_c, online_ab, online_h, online_d, configured,
    model_failures, latency_percentiles, route_share, route_decisions, self_consistency, term_survival, sample_prefix, pairing_join, fhe_score, mpc_shares, split_activation, dp_noise, transports, hook_scan, hook_payload,
    annotate_occurrences, validate_annotations, samples_roundtrip, runs_roundtrip, published, request_bodies, forwarded_headers, generated_workloads, session_cap, session_restore, stream_restore_final, stream_restore,
    event_lines, report_lines, report_markdown, report_latex, report_roundtrip, report_bundle, metrics_roundtrip, pareto,
)


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {f.__name__: f for f in _ALL}
