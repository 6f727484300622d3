"""Privacy pipelines over a table of texts, and the evaluation runs made from them.

Each option is a function of the same columns: what would leave the machine for a text, under
which label.  All options of a run are projections of one scan.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Observation, Window
from pyspark.sql import functions as F

from ..config import Config, custom_patterns
from ..functions import redact, spans, terms
from ..functions.noise import noised
from ..functions.patterns import PATTERNS, registry
from ..functions.taxonomy import DEFAULT_POLICY
from . import models, ner

STRICT_BELOW = 0.5
# Parameters of the transports that send no text.
SPLIT_CHARS, SPLIT_DIM, MPC_CHARS, MPC_VOCABULARY, FHE_MODULUS = 512, 4096, 128, 32000, 97


def with_spans(
    df: DataFrame,
    text: str = "text",
    patterns=PATTERNS,
    policy=None,
    use_ner: bool = False,
    recogniser=ner.gazetteer,
    floor: float = ner.FLOOR,
    reviewer=None,
    engine: str = "auto",
) -> DataFrame:
    """Adds ``spans``: detected, merged, and filtered by policy (None keeps every span)."""
    every = spans.detect(F.col(text), patterns, engine)
    if use_ner:
        every = F.concat(every, ner.without_false_positives(ner.entity_spans(F.col(text), recogniser, floor)))
    out = df.withColumn("spans", spans.merge(every))
    if reviewer is not None:
        out = ner.with_review(out, text, "spans", reviewer)
    return out if policy is None else out.withColumn("spans", spans.by_policy(F.col("spans"), policy))


def with_redaction(df: DataFrame, text: str = "text", tag: Column | None = None) -> DataFrame:
    """Adds ``reverse_map``, ``placeholders`` and ``redacted``."""
    df = df.withColumn("reverse_map", redact.entries(F.col("spans"), tag))
    df = df.withColumn("placeholders", redact.placeholders(F.col("spans"), F.col("reverse_map")))
    return df.withColumn("redacted", redact.splice(F.col(text), F.col("spans"), F.col("placeholders")))


def refused(df: DataFrame, below: float = STRICT_BELOW) -> DataFrame:
    """Rows that a strict pipeline does not send, with the reasons."""
    return df.filter(spans.unsure(F.col("spans"), below)).withColumn("reasons", spans.refusal_reasons(F.col("spans"), below))


def _answered(df: DataFrame, sent: Column, model: models.Model | None, threads: int = 1, retries: int = 0) -> DataFrame:
    """Adds response, response_error and restored where there is a model."""
    if model is None:
        return df
    out = models.with_answer(df, sent, "response", model, threads, retries)
    return out.withColumn("restored", redact.restore(F.col("response"), F.col("reverse_map")))


def redact_pipeline(
    df: DataFrame,
    text: str = "text",
    policy=DEFAULT_POLICY,
    strict: Column | bool = True,
    model: models.Model | None = None,
    threads: int = 1,
    retries: int = 0,
    **kw,
) -> tuple[DataFrame, DataFrame]:
    """(answered, refused): detect, filter, redact, optionally call a model, restore, audit.
    ``strict`` may be a column: a request's own setting.  A call that fails leaves no response but
    its reason."""
    df = with_redaction(with_spans(df, text, policy=policy, **kw), text)
    strict = F.lit(strict) if isinstance(strict, bool) else F.coalesce(strict, F.lit(True))
    stop = strict & F.coalesce(spans.unsure(F.col("spans"), STRICT_BELOW), F.lit(False))
    sent = df.filter(~stop).withColumn("leak_audit", redact.audit(F.col("redacted"), F.col("spans")))
    sent = _answered(sent, F.col("redacted"), model, threads, retries)
    return sent, df.filter(stop).withColumn("reasons", spans.refusal_reasons(F.col("spans"), STRICT_BELOW))


def counted(df: DataFrame, name: str = "veilspan") -> tuple[DataFrame, Observation]:
    """The same rows with counters that are filled in when they are computed: rows, spans found and
    rows that a strict pipeline would refuse.  No text is kept."""
    o = Observation(name)
    return df.observe(
        o, F.count(F.lit(1)).alias("texts"), F.sum(F.size("spans")).alias("spans"), F.count_if(spans.unsure(F.col("spans"))).alias("uncertain"),
    ), o


def routed(df: DataFrame, text: str, router: models.Model, local: models.Model) -> tuple[DataFrame, DataFrame]:
    """(answered locally with ``response``, to be sent on).  Split before the local model is called,
    so that it sees trivial texts only."""
    df = models.with_answer(df, models.classification_prompt(F.col(text)), "classifier_raw", router).drop("classifier_raw_error")
    df = df.withColumn("classification", models.decision(F.col("classifier_raw")))
    trivial = models.with_answer(df.filter("classification = 'TRIVIAL'"), F.col(text), "response", local)
    return trivial, df.filter("classification = 'COMPLEX'")


def restore_choices(choices: Column, reverse_map: Column) -> Column:
    """All choices of an answer (ARRAY<STRUCT<index, content>>) with their placeholders restored."""
    return F.transform(choices, lambda c: c.withField("content", redact.restore(c["content"], reverse_map)))


def tool_gate(df: DataFrame, tools: str = "tools", policy: str = "bypass") -> tuple[DataFrame, DataFrame, DataFrame]:
    """(to process, bypassed unchanged, refused): requests with tools are not redacted."""
    has = F.col(tools).isNotNull() & (F.trim(F.col(tools).cast("string")) != "") & (F.trim(F.col(tools).cast("string")) != "[]")
    none = df.limit(0)
    return df.filter(~has), (df.filter(has) if policy == "bypass" else none), (df.filter(has) if policy == "refuse" else none)


# ---------------------------------------------------------------- messages and blocks
PER_BUCKET = 50_000  # distinct values of a request that are numbered together


def redact_messages(
    df: DataFrame,
    request: str,
    turn: str,
    role: str | None,
    text: str,
    scope: str = "message",
    policy=DEFAULT_POLICY,
    roles: tuple[str, ...] | None = None,
    **kw,
) -> DataFrame:
    """One row per message; (request, turn) names it.  Only messages of ``roles`` are redacted (None:
    all).  scope="message" restarts the numbers in each message; scope="request" numbers the distinct
    values of a request together, so that placeholders never collide.

    Within a request the values of a kind are numbered in the order of their MD5.  They are counted
    by its leading digits first, so that a request which holds a third of all values is numbered in
    many tasks; each message gets the entries of its own values."""
    df = with_spans(df, text, policy=policy, **kw).withColumn("spans", F.coalesce("spans", spans.no_spans()))
    if roles is not None:
        df = df.withColumn("spans", F.when(F.col(role).isin(*roles), F.col("spans")).otherwise(spans.no_spans()))
    if scope == "message":
        return with_redaction(df, text)
    tagged = df.select(F.col(request).alias("__r"), F.col(turn).alias("__t"), F.posexplode(spans.each("spans")).alias("__p", "__s"))
    last = tagged.groupBy("__r", F.col("__s.text").alias("original")).agg(F.max_by(F.col("__s.kind"), F.struct("__t", "__p")).alias("kind"))
    last = last.withColumn("__h", F.md5(F.col("original").cast("binary")))
    most = last.groupBy("__r", "kind").agg(F.count(F.lit(1)).alias("n")).agg(F.max("n").alias("n")).first()["n"] or 0
    digits = 0
    while most > PER_BUCKET * 16**digits:
        digits += 1
    last = last.withColumn("__b", F.substring("__h", 1, digits) if digits else F.lit(""))
    here = Window.partitionBy("__r", "kind", "__b").orderBy("__h", "original")
    last = last.withColumn("n", F.row_number().over(here))
    if digits:
        sums = last.groupBy("__r", "kind", "__b").agg(F.count(F.lit(1)).alias("__k"))
        before = Window.partitionBy("__r", "kind").orderBy("__b").rowsBetween(Window.unboundedPreceding, -1)
        sums = sums.select("__r", "kind", "__b", F.coalesce(F.sum("__k").over(before), F.lit(0)).alias("__before"))
        last = last.join(sums.hint("merge"), ["__r", "kind", "__b"]).withColumn("n", F.col("n") + F.col("__before"))
    entry = last.select(
        "__r", "original", F.struct(redact._placeholder(F.col("kind"), F.col("n"), None).alias("placeholder"), "original", "kind").alias("e"),
    )
    values = tagged.select("__r", "__t", F.col("__s.text").alias("original")).distinct()
    own = values.join(entry.hint("merge"), ["__r", "original"]).groupBy("__r", "__t").agg(F.sort_array(F.collect_list("e")).alias("reverse_map"))
    own = own.hint("merge")
    df = df.join(own, (df[request] == own["__r"]) & (df[turn] == own["__t"]), "left").drop("__r", "__t").withColumn(
        "reverse_map", F.coalesce("reverse_map", F.array().cast(redact.ENTRIES)),
    )
    df = df.withColumn("placeholders", redact.placeholders(F.col("spans"), F.col("reverse_map")))
    return df.withColumn("redacted", redact.splice(F.col(text), F.col("spans"), F.col("placeholders")))


def request_maps(messages: DataFrame, request: str, turn: str) -> DataFrame:
    """One reverse map per request; where messages use one placeholder twice, the last message wins."""
    e = messages.select(request, F.col(turn).alias("__t"), F.explode(spans.each("reverse_map")).alias("e"))
    return e.groupBy(request, F.col("e.placeholder").alias("placeholder")).agg(F.max_by("e.original", "__t").alias("original"))


def redact_blocks(blocks: Column, change: Callable[[Column], Column]) -> Column:
    """Text blocks of a block list changed, other blocks as they are."""
    return F.transform(blocks, lambda b: F.when(b["type"] == "text", F.struct(b["type"].alias("type"), change(b["text"]).alias("text"))).otherwise(b))


# ---------------------------------------------------------------- transports without text
def attested(enclave_id: Column, pcr_values: Column) -> Column:
    return F.coalesce((F.length(enclave_id) > 0) & (F.size(pcr_values) > 0), F.lit(False))


def split_activation(text: Column, dim: int = SPLIT_DIM) -> Column:
    """Code points of the first characters and the shape of what would be sent."""
    chars = F.filter(F.split(F.substring(text, 1, SPLIT_CHARS), "", -1), lambda c: c != "")
    ids = F.transform(chars, lambda c: F.ascii(c))
    return F.struct(ids.alias("token_ids"), F.array(F.size(ids), F.lit(dim)).alias("activation_shape"))


def fhe_score(text: Column, threshold: float = 0.5) -> Column:
    score = F.pmod(F.length(text), F.lit(FHE_MODULUS)) / F.lit(float(FHE_MODULUS))
    return F.struct(score.alias("score"), (score >= threshold).alias("sensitive"), F.round(F.greatest(score, 1 - score), 3).alias("confidence"))


def mpc_shares(text: Column, parties: int = 3) -> Column:
    """Additive shares of each token id; they sum to the id modulo the vocabulary."""
    chars = F.filter(F.split(F.substring(text, 1, MPC_CHARS), "", -1), lambda c: c != "")

    def share(i: Column, c: Column, p: int) -> Column:
        bits = F.conv(F.substring(F.md5(F.concat_ws("|", i.cast("string"), c, F.lit(str(p))).cast("binary")), 1, 7), 16, 10).cast("bigint")
        return F.pmod(bits, F.lit(MPC_VOCABULARY))

    def one(c: Column, i: Column) -> Column:
        first = [share(i, c, p) for p in range(parties - 1)]
        rest = F.ascii(c).cast("bigint")
        for s in first:
            rest = rest - s
        return F.array(*first, F.pmod(rest, F.lit(MPC_VOCABULARY)))

    return F.transform(chars, one)


# ---------------------------------------------------------------- options
OPTIONS = ("baseline", "A", "B", "B+C", "B+H", "D", "E", "F", "G", "B+D", "A+B", "A+B+C")
_SENT = ("baseline", "A", "B", "B+C", "B+H", "D", "B+D", "A+B", "A+B+C")  # options that send text somewhere


def _known(options) -> None:
    unknown = [o for o in options if o not in OPTIONS]
    if unknown:
        raise ValueError(f"unknown options: {unknown}")


def _with_parts(
    df: DataFrame,
    options,
    text: str,
    key: str,
    epsilon: float,
    seed: int,
    router: models.Model,
    rephraser: models.Model,
    rephrased: Column | None = None,
    require: bool = True,
) -> DataFrame:
    """Adds what the options are made of: the route, the rephrased text and whether it passes, the
    noised text.  ``rephrased`` says which rows are rephrased (null: all)."""
    if any(o.startswith("A") for o in options):
        df = df.withColumn("__route", models.decision(models.answer(models.classification_prompt(F.col(text)), router)))
    if any("C" in o for o in options):
        asked = F.col("redacted") if rephrased is None else F.when(rephrased, F.col("redacted"))
        df = df.withColumn("__said", models.answer(asked, rephraser))
        # a column of their own: the terms are read several times
        df = df.withColumn("__terms", terms.technical_terms(F.col("redacted")))
        passes = terms.survival(F.col("__terms"), F.col("__said"))["valid"] if require else F.lit(True)
        df = df.withColumn("__ok", F.col("__said").isNotNull() & F.coalesce(passes, F.lit(False))).drop("__terms")
    if "B+H" in options:
        df = df.withColumn("__noise", noised(F.col("redacted"), F.col(key), epsilon, seed)["text"])
    return df


def _option(o: str, text: str, epsilon: float) -> tuple[Column, Column, bool]:
    """(label, what leaves, whether detections count) of an option over the columns of _with_parts."""
    plain, hidden, nothing = F.col(text), F.col("redacted"), F.lit("")
    local = F.col("__route") == "TRIVIAL"
    if o in ("baseline", "D"):
        return F.lit(o), plain, False
    if o in ("E", "F", "G"):
        return F.lit(o), nothing, False
    if o in ("B", "B+D"):
        return F.lit(o), hidden, True
    if o == "B+H":
        return F.lit(f"B+H(e={epsilon:g})"), F.col("__noise"), True
    if o == "A":
        return F.when(local, "A(local)").otherwise("A(cloud)"), F.when(local, nothing).otherwise(plain), False
    if o == "A+B":
        return F.when(local, "A+B(local)").otherwise("A+B(cloud)"), F.when(local, nothing).otherwise(hidden), True
    said = F.when(F.col("__ok"), F.col("__said")).otherwise(hidden)
    if o == "B+C":
        return F.when(F.col("__ok"), "B+C").otherwise("B(C-rejected)"), said, True
    sent = F.when(F.col("__ok"), "A+B+C(cloud)").otherwise("A+B+C(cloud,C-rejected)")
    return F.when(local, "A+B+C(local)").otherwise(sent), F.when(local, nothing).otherwise(said), True


def runs(
    samples: DataFrame,
    options=OPTIONS,
    epsilon: float = 4.0,
    router: models.Model = models.short_is_trivial,
    rephraser: models.Model = models.soft_rephrase,
    first: int | None = None,
    seed: int = 0,
    carry: tuple[str, ...] = (),
    **kw,
) -> DataFrame:
    """One row per sample and option: (sample_id, workload, text, option_name, label, outgoing,
    detections, carried columns).  Every option reads the same detection; the policy is not applied
    here."""
    _known(options)
    base = samples.select(F.col("id").alias("sample_id"), "workload", "text", *carry).filter("text IS NOT NULL")
    if first is not None:
        base = base.orderBy("sample_id").limit(first)
    df = with_redaction(with_spans(base, "text", policy=None, **kw))
    df = _with_parts(df, options, "text", "sample_id", epsilon, seed, router, rephraser)
    rows = []
    for o in options:
        label, outgoing, counts = _option(o, "text", epsilon)
        rows.append(
            F.struct(
                F.lit(o).alias("option_name"),
                label.alias("label"),
                outgoing.alias("outgoing"),
                (F.col("spans") if counts else spans.no_spans()).alias("detections"),
            )
        )
    return df.select(
        "sample_id", "workload", "text", *carry, F.explode(F.array(*rows)).alias("r"),
    ).select("sample_id", "workload", "text", *carry, "r.*")


def online(
    df: DataFrame,
    option: str,
    model: models.Model,
    text: str = "text",
    key: str = "id",
    role: str | None = None,
    local: models.Model | None = None,
    router: models.Model = models.short_is_trivial,
    rephraser: models.Model = models.soft_rephrase,
    policy=DEFAULT_POLICY,
    strict: bool = True,
    require: bool = True,
    epsilon: float = 4.0,
    seed: int = 0,
    enclave: tuple[Column, Column] | None = None,
    threads: int = 1,
    retries: int = 0,
    **kw,
) -> tuple[DataFrame, DataFrame]:
    """(answered, refused) of an option that sends text: what leaves is sent to the model, its answer
    restored and audited.  Trivial requests of A go to the ``local`` model.  Where there is a ``role``
    only messages of the user are rephrased.  D needs the enclave's id and measurements; what is not
    attested is refused, and so is what the strict redaction is unsure of."""
    _known([option])
    if option not in _SENT:
        raise ValueError(f"option {option} sends no text")
    df = with_redaction(with_spans(df, text, policy=policy, **kw), text)
    df = _with_parts(df, (option,), text, key, epsilon, seed, router, rephraser, None if role is None else F.col(role) == "user", require)
    label, outgoing, counts = _option(option, text, epsilon)
    df = df.withColumn("label", label).withColumn("outgoing", outgoing)
    unsure = spans.unsure(F.col("spans"), STRICT_BELOW) if strict and "B" in option else F.lit(False)
    closed = ~attested(*enclave) if enclave is not None and "D" in option else F.lit("D" in option)
    reason = F.when(closed, "enclave not attested").when(F.coalesce(unsure, F.lit(False)), "uncertain detection")
    df = df.withColumn("refusal", reason)
    here = F.col("label").endswith("(local)")
    found = F.col("spans") if counts else spans.no_spans()
    sent = df.filter("refusal IS NULL").withColumn("leak_audit", redact.audit(F.col("outgoing"), found))
    sent = models.with_answer(sent, F.when(~here, F.col("outgoing")), "response", model, threads, retries)
    if local is not None:
        sent = models.with_answer(sent, F.when(here, F.col(text)), "__local", local, threads, retries)
        sent = sent.withColumn("response", F.coalesce("response", "__local")).withColumn(
            "response_error", F.coalesce("response_error", "__local_error"),
        ).drop("__local", "__local_error")
    back = redact.restore(F.col("response"), F.col("reverse_map")) if counts else F.col("response")
    own = [c for c in df.columns if c.startswith("__") and c in ("__route", "__said", "__ok", "__noise")]
    return sent.withColumn("restored", back).drop("refusal", *own), df.filter("refusal IS NOT NULL").drop(*own)


def configured(
    df: DataFrame, config: Config, model: models.Model, text: str = "text", key: str = "id", reviewer: models.Model | None = None, **kw,
) -> tuple[DataFrame, DataFrame]:
    """``online`` with the option, policy, patterns, recogniser and limits of a configuration."""
    p, r = config.pipeline, config.recogniser
    own = registry(custom_patterns(config.policy.patterns_file or None))
    return online(
        df, p.option, model, text, key, policy=config.policy.categories, strict=p.strict, require=p.require_term_survival, epsilon=p.epsilon, patterns=own, use_ner=bool(r.model),
        floor=r.confidence_floor, reviewer=reviewer if p.review_entities else None, **kw,
    )


def route_share(routes: DataFrame) -> DataFrame:
    """Percent of requests answered locally, by option."""
    local = F.count_if(F.upper(F.col("classification")) == "TRIVIAL")
    return routes.groupBy("option_name").agg(
        local.alias("local"), (F.count(F.lit(1)) - local).alias("cloud"), (100.0 * local / F.count(F.lit(1))).alias("local_pct"),
    )
