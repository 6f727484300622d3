"""Word substitution under a differential-privacy budget.

Randomness is a hash of (seed, row key, word index), so a row's noise depends neither on its
partition nor on the order of evaluation, and a retried task repeats it.
"""

from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F

# Replacement pools and words that are never replaced.
POOLS: dict[str, tuple[str, ...]] = {
    "noun": (
        "item", "thing", "entity", "element", "object", "unit", "part", "piece", "record", "entry", "value", "data", "point", "case", "instance",
        "resource", "component", "module", "service", "task", "process", "event", "action", "result", "output", "input", "state", "type", "kind",
        "form", "level", "step", "stage", "phase", "mode",
    ),
    "verb": (
        "process", "handle", "manage", "check", "verify", "update", "create", "remove", "modify", "retrieve", "compute", "generate", "transform",
        "validate", "execute", "perform", "apply", "resolve", "configure", "initialize", "complete", "prepare", "deliver", "send",
    ),
    "adj": (
        "relevant", "specific", "general", "current", "previous", "primary", "secondary", "standard", "common", "typical", "basic", "advanced",
        "internal", "external", "local", "remote", "active", "pending", "valid", "available", "required", "optional", "default", "custom",
    ),
    "adv": (
        "quickly", "properly", "correctly", "currently", "previously", "typically", "generally", "specifically", "directly", "recently",
        "automatically", "manually", "effectively", "efficiently", "safely",
    ),
}
PRESERVED: tuple[str, ...] = (
    "the", "a", "an", "is", "are", "was", "were", "be", "been", "being", "have", "has", "had", "do", "does", "did", "will", "would", "shall",
    "should", "may", "might", "can", "could", "must", "and", "or", "but", "if", "then", "else", "not", "no", "yes", "in", "on", "at", "to", "for",
    "of", "by", "from", "with", "as", "this", "that", "it", "i", "we", "you", "they", "he", "she", "what", "which", "who", "how", "when", "where",
    "why", "true", "false", "null", "none",
)
EDGES = ".,;:!?\"'()[]{}—-"
_EDGE = r"""[.,;:!?"'()\[\]{}—\-]"""


def substitution_probability(epsilon: float) -> float:
    return 1.0 / (1.0 + math.exp(epsilon))


def words_of(text: Column) -> Column:
    """Split at any run of blanks, as Python's split does."""
    return F.filter(F.split(text, r"(?U)[\s\x1c-\x1f]+", -1), lambda w: w != "")


def core(word: Column) -> Column:
    return F.regexp_replace(word, f"^{_EDGE}+|{_EDGE}+$", "")


def kept(c: Column) -> Column:
    """Whether a stripped word must stay: structure, short words, acronyms, identifiers, addresses."""
    upper = (F.upper(c) == c) & (F.lower(c) != c)
    return F.lower(c).isin(*PRESERVED) | (F.length(c) <= 2) | upper | c.rlike(r"(?U)\d") | F.contains(c, F.lit("_")) | F.contains(c, F.lit("@")) | (
        F.contains(c, F.lit(".")) & (F.length(c) > 4)
    )


def part_of_speech(c: Column) -> Column:
    w = F.lower(c)
    return F.when(w.rlike("ly$"), "adv").when(w.rlike("(?:ing|ed|es|ize|ify|ate)$"), "verb").when(
        w.rlike("(?:ful|ous|ive|al|ent|ant|ible|able)$"), "adj",
    ).otherwise("noun")


def _bits(seed: int, key: Column, i: Column) -> Column:
    """MD5 of a word's place in hexadecimal digits: 32 bits for the flip, 32 for the pick."""
    return F.md5(F.concat_ws("|", F.lit(seed).cast("string"), key.cast("string"), i.cast("string")).cast("binary"))


def _number(hexadecimal: Column) -> Column:
    return F.conv(hexadecimal, 16, 10).cast("bigint")


def noised(text: Column, key: Column, epsilon: float = 4.0, seed: int = 0) -> Column:
    """STRUCT<text, words, substituted>; words are joined by single blanks again.  The draw is made
    first: of the words it spares nothing else is computed."""
    # the digits compare as the numbers do
    limit = f"{int(substitution_probability(epsilon) * 2**32):08x}"
    whole = int(substitution_probability(epsilon) * 2**32) >= 2**32

    def replacement(c: Column, bits: Column) -> Column:
        pick, pos = _number(F.substring(bits, 9, 8)), part_of_speech(c)
        out = F.lit(None).cast("string")
        for name, pool in POOLS.items():
            out = F.when(
                pos == name, F.element_at(F.split(F.lit(" ".join(pool)), " "), F.pmod(pick, F.lit(len(pool))).cast("int") + 1),
            ).otherwise(out)
        first = F.substring(c, 1, 1)
        return F.when((first == F.upper(first)) & (F.upper(first) != F.lower(first)), F.initcap(out)).otherwise(out)

    def one(w: Column, i: Column) -> Column:
        bits, c = _bits(seed, key, i), core(w)
        drawn = F.lit(True) if whole else F.substring(bits, 1, 8) < limit
        head, tail = F.regexp_extract(w, f"^({_EDGE}*)", 1), F.regexp_extract(w, f"({_EDGE}*)$", 1)
        return F.when(drawn, F.when(~kept(c), F.concat(head, replacement(c, bits), tail)))

    words = words_of(text)
    new = F.transform(words, one)
    merged = F.zip_with(words, new, lambda w, n: F.coalesce(n, w))
    return F.struct(
        F.array_join(merged, " ").alias("text"), F.size(words).alias("words"), F.size(F.filter(new, lambda n: n.isNotNull())).alias("substituted"),
    )
