"""Pages of stuffed keywords, bare link lists, tag and product lists.

1. A text is cut into blocks of BLOCK bytes (a short tail joins the block before it) and each block
   is compressed; the mean ratio of compressed to plain bytes measures redundancy.
2. The usual ratio depends on length and language, so it is averaged over all documents of the same
   language and length step.  A page is redundant where its ratio is below FLAG times the usual one,
   and extremely redundant below EXTREME times.
3. A redundant page is confirmed by a low density of sentence punctuation of any script; an
   extremely redundant one also if it has sentences but one word makes up much of it: the less
   redundant, the more, a PREVAILS-th of its share of the usual ratio.  What is
   redundant and unpunctuated by form (time-stamped lines, code and settings, definitions, lists of
   clauses) is let go by an exact look at the form.

No word list is used.  A text is read and compressed once: the same pass notes its ratio and what
would confirm it (a few numbers a document) are written, and the table of usual ratios, at most
(languages + 1) * steps rows, is joined to them.  Texts are never shuffled.

Defined results: null, empty and blank texts are no pages and never found; unknown, wrong or null
languages share a class of their own; a repeated doc_id is returned once.
"""

from __future__ import annotations

import math
import re
import zlib
from collections import Counter
from itertools import islice

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import BooleanType, DoubleType, StructField, StructType

from .common import cut, spread

BLOCK = 1_000
TAIL = 250
STEP = 125
LANGUAGES = ("en", "de", "es", "fr")
FLAG, EXTREME, PREVAILS = 0.92, 0.8, 8
SPARSE = 3.0  # sentence ends in a thousand characters, below which a text has no sentences
MOST_USUAL = 1.05  # no text is usually longer when compressed than this share of it
LONG_WORD, OFTEN = 4, 5  # letters; times that a word must occur to prevail

_LINK = re.compile(r"""<a\s[^>]*>|\]\([^)\s]+\)|https?://[^\s<>"')]+|(?<![\w.])www\.[^\s<>"')]+""", re.I)
# a mark that ends a sentence, after a word or a closing bracket or quote; those of scripts without blanks need none behind
_SENTENCE = re.compile(r"""(?:[.!?…։؟।॥။።](?<=[^\W\d_]{2}.|[^\W\d_]["'’”»)\]].)["'’”»)\]]*(?=\s|$))|[。！？｡](?<=[^\W\d_].)""")
_WORD = re.compile(r"[^\W\d_]+")
_STAMP = re.compile(r"(?m)^[\[(]?(?:\d{4}-\d\d-\d\d|\d\d[:/]\d\d[:/]\d\d)")
_CODE = re.compile(r"[(){}=;_]")
_DEFINED = re.compile(r"(?m)^\W*[^\W\d_][^:\n]{0,40}: +\w+ +\w+ +\w+")


def block_ratio(text: str | None) -> float | None:
    """Mean compressed share of the blocks of a text, weighted by their length."""
    if not text or text.isspace():
        return None
    b = text.encode("utf-8", "surrogatepass")
    cuts = list(range(0, len(b), BLOCK))
    if len(cuts) > 1 and len(b) - cuts[-1] < TAIL:
        cuts.pop()
    packed = sum(len(zlib.compress(b[i:j], 6)) for i, j in zip(cuts, [*cuts[1:], len(b)]))
    return packed / len(b)


def confirmations(text: str, ratio: float) -> tuple[bool, float]:
    """(sparse, prevalence): whether a redundant page without sentences is confirmed by its form, and
    in a page with sentences the share of the words that the commonest long one has.  What no usual
    ratio could flag is not looked at."""
    if ratio >= FLAG * MOST_USUAL:
        return False, 0.0
    enough = math.ceil(SPARSE * len(text) / 1000)
    few = sum(1 for _ in islice(_SENTENCE.finditer(text), enough)) < enough
    if not few and ratio >= EXTREME * MOST_USUAL:
        return False, 0.0
    marked = "://" in text or "www." in text or "](" in text or "<a" in text
    if few and marked and sum(len(m) for m in _LINK.findall(text)) >= 0.4 * len(text):
        return True, 0.0
    lines = text.count("\n") + 1
    words = _WORD.findall(text.lower())
    if not words or sum(map(len, words)) < 0.45 * len(text) or len(_CODE.findall(text)) > 0.02 * len(text):
        return False, 0.0
    if len(_STAMP.findall(text)) * 2 > lines or len(_DEFINED.findall(text)) * 2 > lines and not few:
        return False, 0.0
    long = Counter(w for w in words if len(w) >= LONG_WORD)
    most = max(long.values(), default=0)
    if not few:
        return False, most / len(words) if most >= OFTEN else 0.0
    # clauses are told from phrases by their many short words, unless one long word prevails
    return sum(len(w) < LONG_WORD for w in words) < 0.3 * len(words) or most >= 0.1 * len(words), 0.0


MEASURES = StructType([StructField("ratio", DoubleType()), StructField("sparse", BooleanType()), StructField("prevalence", DoubleType())])


@F.pandas_udf(MEASURES)
def _measures(s: pd.Series) -> pd.DataFrame:
    ratios = [block_ratio(t) for t in s]
    told = [confirmations(t, r) if r is not None else (False, 0.0) for t, r in zip(s, ratios)]
    return pd.DataFrame(
        {"ratio": pd.Series(ratios, dtype="float64"), "sparse": [a for a, _ in told], "prevalence": pd.Series([b for _, b in told], dtype="float64")}
    )


def language_class(lang: Column) -> Column:
    folded = F.lower(F.trim(lang))
    return F.when(folded.isin(*LANGUAGES), folded).otherwise("other")


def measured(documents: DataFrame) -> DataFrame:
    """(doc_id, lang class, step, ratio, sparse, prevalence) of every document with a text, written."""
    rows = documents.select("doc_id", "text", language_class(F.col("lang")).alias("lang"))
    rows = spread(rows.filter(F.col("text").rlike(r"\S")))
    step = F.floor(F.least(F.octet_length("text"), F.lit(2 * BLOCK)) / STEP).cast("int")
    return cut(rows.select("doc_id", "lang", step.alias("step"), _measures("text").alias("m")).select("doc_id", "lang", "step", "m.*"))


def usual_ratios(sizes: DataFrame) -> DataFrame:
    """(lang, step, usual): the average of the class, but no less than that of all languages and of
    any longer step (a shorter text compresses no better), so that spam which fills a small class
    does not become usual there."""
    sums = sizes.groupBy("lang", "step").agg(F.sum("ratio").alias("total"), F.count("ratio").alias("n"))
    step = Window.partitionBy("step")
    everywhere = F.sum("total").over(step) / F.sum("n").over(step)
    usual = sums.select("lang", "step", F.col("total").alias("t"), F.col("n"), everywhere.alias("all"))
    # a few dozen rows: languages times steps
    longer = F.max("all").over(Window.partitionBy(F.lit(1)).orderBy(F.desc("step")))
    return usual.select("lang", "step", F.greatest(F.col("t") / F.col("n"), longer).alias("usual"))


def redundant_pages(documents: DataFrame) -> DataFrame:
    """(doc_id, ratio, usual, share, sparse, prevalence) of the pages flagged by their block-wise compression."""
    sizes = measured(documents)
    return sizes.join(F.broadcast(usual_ratios(sizes)), ["lang", "step"]).withColumn(
        "share", F.col("ratio") / F.col("usual"),
    ).filter(F.col("share") < FLAG)


def stuffed_pages(documents: DataFrame) -> DataFrame:
    repeated = (F.col("share") < EXTREME) & (F.col("prevalence") * PREVAILS >= F.col("share"))
    return redundant_pages(documents).filter(F.col("sparse") | repeated).select("doc_id").distinct()
