"""Technical terms, and whether a rephrased text keeps them."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Families of technical terms, in order.
FAMILIES = (
    r"\b(?:Python|Java|JavaScript|TypeScript|Go|Rust|Ruby|C\+\+|SQL|HTML|CSS)\b",
    r"\b(?:React|FastAPI|Django|Flask|Spring|Rails|Express|Next\.js|Vue)\b",
    r"\b(?:Docker|Kubernetes|AWS|GCP|Azure|Terraform|Ansible|PostgreSQL|Redis|Kafka)\b",
    r"\b(?:API|REST|GraphQL|gRPC|HTTP|HTTPS|TCP|UDP|DNS|SSH|TLS|SSL)\b",
    r"\b(?:deploy|migration|schema|endpoint|query|index|cache|pipeline|webhook)\b",
    r"\b(?:authentication|authorization|token|session|certificate|encryption)\b",
    r"\b(?:debug|error|exception|traceback|stack trace|segfault|timeout|deadlock)\b",
    r"\b(?:database|table|column|row|foreign key|primary key|constraint)\b",
    r"(?:def |class |import |from |SELECT |INSERT |UPDATE |DELETE |CREATE |ALTER )",
)
LEAST_SURVIVAL = 0.7


def technical_terms(text: Column) -> Column:
    """Trimmed, the first spelling of each, by family and then by place."""
    every = F.concat(*[F.regexp_extract_all(text, F.lit(f"(?iU){rx}"), F.lit(0)) for rx in FAMILIES])
    every = F.transform(every, lambda t: F.trim(t))
    first = lambda acc, t: F.when(F.exists(acc, lambda k: F.lower(k) == F.lower(t)), acc).otherwise(F.array_append(acc, t))
    return F.aggregate(every, F.array().cast("array<string>"), first)


def survival(terms: Column, rephrased: Column) -> Column:
    """STRUCT<valid, survival_rate, surviving, dropped>."""
    low = F.lower(rephrased)
    alive, gone = F.filter(terms, lambda t: F.contains(low, F.lower(t))), F.filter(terms, lambda t: ~F.contains(low, F.lower(t)))
    rate = F.when(F.size(terms) == 0, F.lit(1.0)).otherwise(F.size(alive) / F.size(terms))
    return F.struct((rate >= LEAST_SURVIVAL).alias("valid"), rate.alias("survival_rate"), alive.alias("surviving"), gone.alias("dropped"))


def whitespace_tokens(text: Column) -> Column:
    from .noise import words_of

    return F.coalesce(F.size(words_of(text)), F.lit(0)).cast("bigint")


