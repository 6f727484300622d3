"""Groups of texts that differ by small edits: exact Jaccard similarity of word shingles.

A text is the set of its runs of WIDTH consecutive words (lower case, letters and digits).  Texts
with equal sets form a class; one representative of each class goes on.  Shingles are ordered from
rare to frequent, where frequency is counted by BUCKETS ranges of their hashes: any order that is the
same for all sets is right, a good one is fast.  If two sets share at least o shingles, the first k
shared ones lie within the first (size - o + k) of either set, the k-prefix.  So

* level 1 keys a set by each shingle of its 1-prefix,
* where more than FREQUENT sets have a key, the key is extended: level k + 1 keys these sets by the
  combination of the key and each later shingle of their (k + 1)-prefix, up to level DEEPEST.

Whether a key is extended depends on the key alone, so two similar sets take the same way: their
first shared shingles meet them at the first level where that combination is rare.  A set whose
least overlap is k keeps its keys of level k although they are extended, as it may share no more
than k shingles with another.  So no pair is lost, and no key joins many sets unless they share
DEEPEST shingles that are frequent together.

Of two sets the larger one probes with the prefix above; the smaller one is found by a shorter
one, since the overlap must be at least 2s / (1 + s) of its size.  Sets that meet are compared by
size, by what is left behind the shared key, and by a 512-bit parity map (the maps' Hamming
distance is a lower bound of the symmetric difference), then exactly.  All of it is sort-merge and
hash joins of shuffled rows and JVM expressions: no group is collected, and a hot key is a join key
that adaptive execution splits.  Only the counts of the BUCKETS, one byte each, go to every task.

Disk holds the words of the classes, compressed, and their prefixes; the shingles are made again
from the words where they are needed and never shuffled.  The keys are shuffled in up to SLICES
rounds, each with the keys of one slice of the first shingles, and the files of a round are removed
after it.  Two sets that share a key meet in the round of its first shingle.

Defined results: null texts and texts of fewer than WIDTH words have no shingles and are similar to
nothing (a group of their own in ``groups``); repeated rows of an id are one; an id is never paired
with itself.  Shingles are compared by a 64-bit hash.  Other columns are not read.
"""

from __future__ import annotations

import math
from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import settled as cut
from .common import spread, stored

WIDTH, SIMILARITY = 5, 0.8
FREQUENT = 1_000  # sets per key beyond which it is extended: up to there, comparing them costs less than extensions
DEEPEST = 4  # the most shingles in a key
FULL_PAIRS = 1_000  # square of the copies of one text beyond which each is paired with a representative only
BLOCK = 256  # members of a class that are paired at a time
BUCKET_BITS = 20  # ranges of hashes whose shingles are counted together: 2^20 counts of a byte
RANKS = 4  # ranks of frequency for each power of two
KEY_BITS = 56  # of a shingle's hash, behind its rank
SLICES = 8  # rounds in which the keys are shuffled,
SLICE_SETS = 10_000  # unless so many sets or fewer would be in one
MAP_WORDS = 8
_MAPS = [f"m{w}" for w in range(MAP_WORDS)]


def _merge(df: DataFrame) -> DataFrame:
    """A join side that is never broadcast: array columns make Spark's size estimates far too small."""
    return df.hint("merge")


def words_of(text: Column) -> Column:
    return F.regexp_extract_all(F.lower(text), F.lit(r"[\p{L}\p{N}]+"), F.lit(0))


def shingles(width: int) -> Column:
    """The sorted distinct 64-bit shingles of a column __w of words."""
    made = F.transform(F.sequence(F.lit(width), F.size("__w")), lambda i: F.xxhash64(*[F.element_at("__w", i - k) for k in range(width - 1, -1, -1)]))
    return F.when(F.size("__w") >= width, F.sort_array(F.array_distinct(made)))


def _classes(docs: DataFrame, id_col: str, text_col: str, width: int) -> tuple[DataFrame, DataFrame, Callable[[], None]]:
    """``classes``, and what removes the files of the representatives."""
    texts = docs.select(F.col(id_col).cast("string").alias("id"), F.col(text_col).alias("text")).filter("id IS NOT NULL AND text IS NOT NULL")
    txt = F.xxhash64(F.lit(2), "text").alias("txt")
    # no filter before the cut: pushed down, it would split the text again for every shingle
    base = spread(texts).withColumn("__w", words_of(F.col("text"))).select("id", txt, shingles(width).alias("toks"))
    base = base.select("id", "txt", F.xxhash64("toks").alias("__a"), F.xxhash64(F.lit(1), "toks").alias("__b"), F.isnotnull("toks").alias("any"))
    base = cut(base).filter("any")
    digest = ["__a", "__b"]
    heads = base.groupBy(*digest).agg(F.min(F.struct("id", "txt")).alias("r"))
    heads = cut(heads.select(F.monotonically_increasing_id().alias("c"), F.col("r.id").alias("cls"), F.col("r.txt").alias("txt"), *digest))
    members = cut(base.select("id", "txt", *digest).join(_merge(heads.select("c", *digest)), digest).select("id", "c", "txt").distinct())
    # of a class only the representative's words are shuffled on and kept
    once = texts.select(F.col("id").alias("cls"), txt, "text").groupBy("cls", "txt").agg(F.first("text").alias("text"))
    mine = once.join(_merge(heads.select("c", "cls", "txt")), ["cls", "txt"])
    reps, remove = stored(mine.select("c", "cls", F.array_join(words_of(F.col("text")), " ").alias("words")), "zstd")
    made = reps.withColumn("__w", F.split("words", " ")).select("c", "cls", F.lit(width).alias("width"), "words", shingles(width).alias("toks"))
    return members, made, remove


def classes(docs: DataFrame, id_col: str, text_col: str, width: int) -> tuple[DataFrame, DataFrame]:
    """members (id, c, txt) and representatives (c, cls, width, words, toks): c is a number of the
    class, cls its least id, txt a hash of the whole text; toks are made from the words when read."""
    return _classes(docs, id_col, text_col, width)[:2]


def _least(n: Column, share: float) -> Column:
    return F.ceil(n * F.lit(share) - 1e-9).cast("int")


def _rank(k: Column) -> Column:
    return F.floor(F.log2(k) * RANKS).cast("bigint")


def _bucket(t: Column) -> Column:
    return F.shiftrightunsigned(t, 64 - BUCKET_BITS).cast("int")


def ranks(reps: DataFrame) -> DataFrame:
    """One row, one array: the rank of each bucket by the number of its shingles in all sets."""
    seen = reps.select(F.explode(F.transform("toks", _bucket)).alias("b"), F.lit(1).alias("k"))
    none = reps.sparkSession.range(1 << BUCKET_BITS).select(F.col("id").cast("int").alias("b"), F.lit(0).alias("k"))
    counts = seen.unionByName(none).groupBy("b").agg(F.sum("k").alias("k"))
    # bucket and rank as one number, so that a plain sort puts the ranks in place
    each = counts.select((F.col("b").cast("bigint") * 256 + _rank(F.greatest("k", F.lit(1)))).alias("x"))
    return cut(each.agg(F.sort_array(F.collect_list("x")).alias("x")).select(F.transform("x", lambda x: (x % 256).cast("tinyint")).alias("x")))


def ordered(reps: DataFrame, similarity: float) -> DataFrame:
    """(c, n, least, pre, m0..m7): pre are the first of the n shingles in order of frequency, each as a
    number that begins with its rank."""
    bit = F.call_function("shiftleft", F.lit(1).cast("bigint"), F.shiftright("t", 3).bitwiseAND(F.lit(63)).cast("int"))
    word = F.col("t").bitwiseAND(F.lit(MAP_WORDS - 1))
    maps = [F.bit_xor(F.when(word == w, bit).otherwise(F.lit(0).cast("bigint"))).alias(f"m{w}") for w in range(MAP_WORDS)]
    # an expression: for a column Spark infers a filter, which would split the words again for every shingle
    maps = reps.select("c", F.explode(F.filter("toks", lambda t: t.isNotNull())).alias("t")).groupBy("c").agg(*maps)

    def key(t: Column) -> Column:
        rank = F.shiftleft(F.get("__r", _bucket(t)).cast("bigint"), KEY_BITS)
        return rank.bitwiseOR(t.bitwiseAND(F.lit((1 << KEY_BITS) - 1)))

    # the ranks become part of the expression: as a column of their own they would be copied to every row
    sets = reps.select("c", "toks").withColumn("__r", ranks(reps).scalar()).select("c", F.sort_array(F.transform("toks", key)).alias("o"))
    sets = sets.select("c", F.size("o").alias("n"), "o")
    sets = sets.select("c", "n", _least(F.col("n"), similarity).alias("least"), "o")
    pre = F.slice("o", F.lit(1), F.least(F.col("n"), F.col("n") - F.col("least") + DEEPEST))
    return sets.select("c", "n", "least", pre.alias("pre")).join(_merge(maps), "c")


def _first_keys(turn: int, turns: int) -> Column:
    """The keys of level 1 whose shingle is in slice ``turn``."""
    own = F.filter(F.sequence(F.lit(0), F.col("n") - F.col("least")), lambda j: F.pmod(F.get("pre", j), F.lit(turns)) == turn)
    return F.transform(own, lambda j: F.struct(F.xxhash64(F.get("pre", j)).alias("sig"), j.alias("at")))


def _combinations(level: int) -> Column:
    """The keys of a set at a level, from the keys ``ext`` that it extends: ARRAY<STRUCT<sig, at>>."""
    last = F.least(F.size("pre"), F.col("n") - F.col("least") + level) - 1
    none = F.array().cast("array<struct<sig:bigint,at:int>>")

    def longer(e: Column) -> Column:
        made = F.transform(F.sequence(e["at"] + 1, last), lambda j: F.struct(F.xxhash64(e["sig"], F.get("pre", j)).alias("sig"), j.alias("at")))
        return F.when(e["at"] < last, made).otherwise(none)

    return F.flatten(F.transform("ext", longer))


def signatures(sets: DataFrame, similarity: float, frequent: int, turn: int, turns: int) -> DataFrame:
    """(sig, c, n, upto, short, m0..m7), see the module's text, of the keys whose first shingle is in
    slice ``turn`` of ``turns``: ``upto`` is the most that can be shared where the key holds the first
    shared shingles; ``short`` is the same where the smaller of two sets is found by the key, else -1."""
    state, few = sets, F.col("n") - _least(F.col("n"), 2 * similarity / (1 + similarity))
    out: list[DataFrame] = []
    for level in range(1, DEEPEST + 1):
        state = state.withColumn("keys", _first_keys(turn, turns) if level == 1 else _combinations(level)).drop("ext")
        emitted, onward = state, None
        if level < DEEPEST:
            sigs = F.col("keys")
            if level == 1:  # as many sets as a frequent key has, its bucket has at least
                hot_rank = math.floor(math.log2(max(frequent, 1)) * RANKS) - 1
                sigs = F.filter(sigs, lambda x: F.shiftright(F.get("pre", x["at"]), KEY_BITS) >= hot_rank)
            held = state.select("c", F.explode(F.transform(sigs, lambda x: x["sig"])).alias("sig"))
            hot = cut(held.groupBy("sig").agg(F.count(F.lit(1)).alias("k")).filter(F.col("k") > frequent).select("sig"))
            if hot.limit(1).count():
                mine = cut(held.join(_merge(hot), "sig").groupBy("c").agg(F.collect_set("sig").alias("hot")))
                rare = F.filter("keys", lambda x: (F.col("least") <= level) | F.col("hot").isNull() | ~F.array_contains("hot", x["sig"]))
                emitted = state.join(_merge(mine), "c", "left").withColumn("keys", rare)
                onward = state.join(_merge(mine), "c").withColumn(
                    "ext", F.filter("keys", lambda x: F.array_contains("hot", x["sig"])),
                ).drop("keys", "hot")
        upto = F.col("n") - F.col("x.at") - 1 + level
        rows = emitted.select("c", "n", *_MAPS, few.alias("few"), F.explode("keys").alias("x"))
        out.append(
            rows.select(
                F.col("x.sig").alias("sig"),
                "c",
                "n",
                upto.alias("upto"),
                F.when(F.col("x.at") < F.col("few") + level, upto).otherwise(-1).alias("short"),
                *_MAPS,
            )
        )
        if onward is None:
            break
        state = onward
    result = out[0]
    for rows in out[1:]:
        result = result.unionByName(rows)
    return result


def _met(sig: DataFrame, similarity: float) -> DataFrame:
    """(a, b): pairs of sets that share a key and may be similar by their sizes, places and maps."""
    keep = ["c", "n", "upto", "short", *_MAPS]
    # the same rows on both sides, so that they are shuffled once: no condition of one side alone
    x = sig.select("sig", *[F.col(k).alias(f"x_{k}") for k in keep])
    y = sig.select("sig", *[F.col(k).alias(f"y_{k}") for k in keep])
    apart = sum((F.bit_count(F.col(f"x_{w}").bitwiseXOR(F.col(f"y_{w}"))) for w in _MAPS[1:]), F.bit_count(F.col("x_m0").bitwiseXOR(F.col("y_m0"))))
    # overlap >= s / (1 + s) * (n1 + n2), and overlap <= (n1 + n2 - distance of the maps) / 2
    need = F.ceil((F.col("x_n") + F.col("y_n")) * F.lit(similarity / (1 + similarity)) - 1e-9)
    first = (F.col("x_n") < F.col("y_n")) | ((F.col("x_n") == F.col("y_n")) & (F.col("x_c") < F.col("y_c")))
    near = first & (F.least("x_short", "y_upto") >= need) & (F.col("x_n") + F.col("y_n") - apart >= 2 * need)
    return x.join(_merge(y), (x["sig"] == y["sig"]) & near).select(F.col("x_c").alias("a"), F.col("y_c").alias("b")).distinct()


def similar_classes(reps: DataFrame, similarity: float, frequent: int = FREQUENT) -> DataFrame:
    """(a, b): pairs of class numbers with Jaccard similarity of at least ``similarity``, each once."""
    sets, remove = stored(ordered(reps, similarity), "snappy")
    turns = max(1, min(SLICES, math.ceil(sets.count() / SLICE_SETS)))
    found = cut(_met(signatures(sets, similarity, frequent, 0, turns), similarity))
    for turn in range(1, turns):
        found = found.unionByName(cut(_met(signatures(sets, similarity, frequent, turn, turns), similarity)))
    remove()
    found = found.distinct()
    side = lambda c: _merge(reps.select(F.col("c").alias(c), F.col("words").alias(f"{c}_w"), "width"))
    both = found.join(side("a"), "a").drop("width").join(side("b"), "b")
    both = both.select("a", "b", "width", F.split("a_w", " ").alias("a_w"), F.split("b_w", " ").alias("b_w"))
    made = lambda w: F.array_distinct(
        F.transform(F.sequence(F.lit(1), F.size(w) - F.col("width") + 1), lambda i: F.xxhash64(F.slice(w, i, F.col("width"))))
    )
    both = both.select("a", "b", made("a_w").alias("a_t"), made("b_w").alias("b_t"))
    both = cut(both.select("a", "b", F.size("a_t").alias("a_n"), F.size("b_t").alias("b_n"), F.size(F.array_intersect("a_t", "b_t")).alias("common")))
    return both.filter(F.col("common") >= F.lit(similarity) * (F.col("a_n") + F.col("b_n") - F.col("common")) - 1e-9).select("a", "b")


def components(links: DataFrame) -> DataFrame:
    """links (a, b) -> (v, root): the least vertex of each connected component."""
    edges = cut(links.select("a", "b").unionByName(links.select(F.col("b").alias("a"), F.col("a").alias("b"))).distinct())
    label = cut(edges.groupBy("a").agg(F.min("b").alias("o")).select(F.col("a").alias("v"), F.least("a", "o").alias("root")))
    while True:
        heard = edges.join(_merge(label.withColumnRenamed("v", "b")), "b").groupBy("a").agg(F.min("root").alias("o"))
        near = label.join(_merge(heard.withColumnRenamed("a", "v")), "v").select("v", F.col("root").alias("was"), F.least("root", "o").alias("root"))
        jump = near.select(F.col("v").alias("root"), F.col("root").alias("up"))
        nxt = cut(near.join(_merge(jump), "root", "left").select("v", "was", F.coalesce("up", "root").alias("root")))
        changed = nxt.filter("root <> was").limit(1).count()
        label = nxt.drop("was")
        if not changed:
            return label


def similar_pairs(docs: DataFrame, id_col: str = "id", text_col: str = "text", width: int = WIDTH, similarity: float = SIMILARITY) -> DataFrame:
    """(id_a, id_b), id_a < id_b as strings: all pairs of different texts.  Where the exact copies of
    one text would make more than FULL_PAIRS pairs, each is paired with the least id of them only;
    ``similar_groups`` has the membership."""
    members, reps, remove = _classes(docs, id_col, text_col, width)
    near = similar_classes(reps, similarity)
    remove()
    copies = members.groupBy("c", "txt").agg(F.count(F.lit(1)).alias("k"), F.min("id").alias("rep")).withColumn(
        "hot", F.col("k") * F.col("k") > FULL_PAIRS,
    )
    # a block holds members of one class: of one hot text, or of any others
    own = F.when(F.col("hot"), F.col("txt"))
    sizes = copies.groupBy("c", own.alias("own")).agg(
        F.sum("k").alias("k"), F.max("hot").alias("hot"), F.max(F.when(F.col("hot"), F.col("rep"))).alias("rep"),
    )
    sizes = cut(sizes.withColumn("parts", F.ceil(F.col("k") / BLOCK).cast("int")))
    hot_parts = sizes.select("c", F.col("own").alias("txt"), F.col("parts").alias("hot_parts")).filter("txt IS NOT NULL")
    rest_parts = sizes.filter("own IS NULL").select("c", F.col("parts").alias("rest_parts"))
    dealt = members.join(_merge(hot_parts), ["c", "txt"], "left").join(_merge(rest_parts), "c", "left")
    number = F.pmod(F.xxhash64(F.lit(3), "id"), F.coalesce("hot_parts", "rest_parts")).cast("int")
    dealt = cut(dealt.select("id", "c", F.xxhash64(F.when(F.col("hot_parts").isNotNull(), F.col("txt")), number).alias("blk")))
    blocks = sizes.select(
        "c", "own", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)).alias("n"),
    ).select("c", "own", F.xxhash64("own", "n").alias("blk"))
    alike = sizes.groupBy("c").agg(F.sum("k").alias("k")).filter("k > 1").select(F.col("c").alias("a"), F.col("c").alias("b"))
    links = near.unionByName(alike)
    block = lambda c: _merge(blocks.select(F.col("c").alias(c), F.col("own").alias(f"own_{c}"), F.col("blk").alias(f"blk_{c}")))
    side = lambda c: _merge(dealt.select(F.col("c").alias(c), F.col("blk").alias(f"blk_{c}"), F.col("id").alias(f"id_{c}")))
    met = links.join(block("a"), "a").join(block("b"), "b").filter("a <> b OR (blk_a <= blk_b AND NOT coalesce(own_a = own_b, false))")
    full = met.join(side("a"), ["a", "blk_a"]).join(side("b"), ["b", "blk_b"]).filter(
        "a <> b OR blk_a <> blk_b OR id_a < id_b"
    ).select("id_a", "id_b")
    hot = sizes.filter("hot").select("c", F.col("own").alias("txt"), F.col("rep").alias("id_a"))
    star = members.join(_merge(hot), ["c", "txt"]).select("id_a", F.col("id").alias("id_b"))
    every = full.unionByName(star).filter("id_a <> id_b")
    return every.select(F.least("id_a", "id_b").alias("id_a"), F.greatest("id_a", "id_b").alias("id_b")).distinct()


def similar_groups(docs: DataFrame, id_col: str = "id", text_col: str = "text", width: int = WIDTH, similarity: float = SIMILARITY) -> DataFrame:
    """One row per id: (id, class_id, group_id, copies, linked_classes).  class_id is the least id of
    the texts of equal shingles, group_id that of all classes connected by links."""
    members, reps, remove = _classes(docs, id_col, text_col, width)
    members, names = members.select("id", "c").distinct(), cut(reps.select("c", "cls"))
    links = similar_classes(reps, similarity)
    remove()
    roots = components(links).withColumnRenamed("v", "c")
    heads = roots.join(_merge(names), "c").groupBy("root").agg(F.min("cls").alias("group_id"))
    degree = links.select(F.explode(F.array("a", "b")).alias("c")).groupBy("c").agg(F.count(F.lit(1)).alias("linked_classes"))
    linked = roots.join(_merge(heads), "root").select("c", "group_id").join(_merge(degree), "c")
    copies = members.groupBy("c").agg(F.count(F.lit(1)).alias("copies"))
    each = names.join(_merge(copies), "c").join(_merge(linked), "c", "left")
    known = members.join(_merge(each), "c")
    known = known.select(
        "id",
        F.col("cls").alias("class_id"),
        F.coalesce("group_id", "cls").alias("group_id"),
        "copies",
        F.coalesce("linked_classes", F.lit(0)).alias("linked_classes"),
    )
    ids = docs.select(F.col(id_col).cast("string").alias("id")).filter("id IS NOT NULL").distinct()
    return ids.join(_merge(known), "id", "left").select(
        "id",
        F.coalesce("class_id", "id").alias("class_id"),
        F.coalesce("group_id", "id").alias("group_id"),
        F.coalesce("copies", F.lit(1)).alias("copies"),
        F.coalesce("linked_classes", F.lit(0)).alias("linked_classes"),
    )
