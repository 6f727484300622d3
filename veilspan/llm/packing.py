"""Items into containers of fixed capacity.

Items are dealt to partitions of bounded size by hash and packed there by best-fit decreasing.
Lower bounds from dual feasible functions certify a partition's bin count: where it equals the
bound, no packing of that partition is better.  In each exchange round every partition gives up
the bins that may be improved (all bins that are not nearly full where there is a gap to the
bound, else the emptiest one); the bins' items are dealt anew, several partitions' together, and
packed again by best-fit decreasing.  A repacking that needs no fewer bins is dropped.  Each row
carries its certificate: the partition whose bins it stayed in, the number of these bins, and the
lower bound of the items in them; the summary compares all bins with the bound of all items.

An item larger than the capacity fills whole containers of its own; its rest is an ordinary item.

Defined results: null or empty texts have 0 tokens and still get a container; a null doc_id is an
item like others; repeated rows are items of their own; plans without a positive capacity are left
out; no documents give no rows.  Other columns are not read.
"""

from __future__ import annotations

from collections import defaultdict

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import cut, spread
from .tokens import VOCABULARY, token_count

PER_PARTITION = 40_000
ROUNDS = 2
MOST_PLANS = 1_000
FULL_ENOUGH = 0.995


def lower_bound(sizes: np.ndarray, capacity: int) -> int:
    """Bins needed at least: the largest of the volume bound, Martello and Toth's thresholds and
    Fekete and Schepers' rounding functions u(k).  Integer arithmetic throughout."""
    return counted_bound(*np.unique(np.asarray(sizes, dtype=np.int64), return_counts=True), capacity)


def counted_bound(value: np.ndarray, count: np.ndarray, capacity: int) -> int:
    """lower_bound from distinct sizes and how often each occurs."""
    some = len(value) > 0
    value, count = value[value > 0], count[value > 0]
    if not len(value):
        return int(some)
    up = lambda a, b: -(-int(a) // int(b))
    best = up((value * count).sum(), capacity)
    for t in value[value * 2 <= capacity]:
        big, mid = value > capacity - t, (value >= t) & (value <= capacity - t)
        best = max(best, up(count[big].sum() * capacity + (value[mid] * count[mid]).sum(), capacity))
    best = max(best, int(count[value * 2 > capacity].sum()))
    for k in range(1, 21):
        whole = (value * (k + 1)) % capacity == 0
        scaled = np.where(whole, value * k, value * (k + 1) // capacity * capacity)  # u(k) times k times capacity
        best = max(best, up((scaled * count).sum(), k * capacity))
    return best


def best_fit_decreasing(sizes: np.ndarray, capacity: int) -> np.ndarray:
    """Bin number of each item.  Open bins are kept by room left; a bit mask over the rooms finds
    the smallest that suffices."""
    at = np.zeros(len(sizes), dtype=np.int64)
    open_bins: dict[int, list[int]] = defaultdict(list)
    mask, bins = 0, 0
    for i in np.argsort(-np.asarray(sizes, dtype=np.int64), kind="stable"):
        size = int(sizes[i])
        fits = mask >> size
        if fits:
            room = size + (fits & -fits).bit_length() - 1
            b = open_bins[room].pop()
            if not open_bins[room]:
                mask ^= 1 << room
        else:
            b, room = bins, capacity
            bins += 1
        at[i] = b
        left = room - size
        if not open_bins[left]:
            mask |= 1 << left
        open_bins[left].append(b)
    return at


PACKED = "plan_id int, capacity bigint, doc_id bigint, n_pieces bigint, piece bigint, size bigint, container string, part string, part_bins bigint, part_bound bigint, released boolean"
_COLUMNS = [x.split()[0] for x in PACKED.split(", ")]


def _packed(pdf: pd.DataFrame, label: str, last: bool) -> pd.DataFrame:
    """Pack one partition, or repack it where rows come with containers.  What it does not give up
    is certified."""
    pdf = pdf.sort_values(["size", "doc_id", "piece"], ascending=[False, True, True], kind="stable").reset_index(drop=True)
    capacity, size = int(pdf["capacity"].iloc[0]), pdf["size"].to_numpy(dtype=np.int64)
    bins = best_fit_decreasing(size, capacity)
    n = int(bins.max()) + 1
    old = pdf["container"].nunique() if pdf["container"].notna().any() else None
    if old is not None and n >= old:
        return pdf.assign(part=label, part_bins=old, part_bound=lower_bound(size, capacity), released=False)[_COLUMNS]
    fill = np.bincount(bins, weights=size, minlength=n)
    gap = n > lower_bound(size, capacity)
    loose = fill < FULL_ENOUGH * capacity if gap else np.arange(n) == fill.argmin()
    loose &= not last
    kept = ~loose[bins]
    bound = lower_bound(size[kept], capacity)
    return pdf.assign(container=[f"{label}.{b}" for b in bins], part=label, part_bins=int((~loose).sum()), part_bound=bound, released=~kept)[_COLUMNS]


def document_sizes(documents: DataFrame, vocabulary: str = VOCABULARY) -> DataFrame:
    return spread(documents.select(F.col("doc_id").cast("bigint").alias("doc_id"), "text")).select(
        "doc_id", token_count(F.col("text"), vocabulary).alias("tokens"),
    )


def pack_sizes(sizes: DataFrame, plans: list[tuple[int, int]], per_partition: int = PER_PARTITION, rounds: int = ROUNDS) -> DataFrame:
    """sizes: (doc_id, tokens).  One row per piece: (plan_id, capacity, doc_id, n_pieces, piece, size,
    container, part, part_bins, part_bound); a whole container of an oversize item is its own bound."""
    spark = sizes.sparkSession
    plans = [(int(p), int(c)) for p, c in plans if p is not None and c is not None and c > 0]
    if not plans:
        return spark.createDataFrame([], PACKED).drop("released")
    each = F.explode(F.array(*[F.struct(F.lit(p).cast("int").alias("plan_id"), F.lit(c).cast("bigint").alias("capacity")) for p, c in plans]))
    items = sizes.select(
        "doc_id", F.col("tokens").cast("bigint").alias("tokens"), each.alias("x"),
    ).select("x.plan_id", "x.capacity", "doc_id", "tokens")
    whole = F.floor(F.col("tokens") / F.col("capacity"))
    whole = F.when(whole * F.col("capacity") == F.col("tokens"), F.greatest(whole, F.lit(1))).otherwise(whole + 1)
    items = items.withColumn("n_pieces", whole.cast("bigint"))
    big = items.filter("n_pieces > 1").withColumn("piece", F.explode(F.sequence(F.lit(1).cast("bigint"), F.col("n_pieces") - 1)))
    big = big.select(
        "plan_id",
        "capacity",
        "doc_id",
        "n_pieces",
        "piece",
        F.col("capacity").alias("size"),
        F.concat_ws(".", F.lit("whole"), F.col("doc_id").cast("string"), F.col("piece").cast("string")).alias("container"),
    )
    big = big.withColumn("part", F.col("container")).withColumn("part_bins", F.lit(1).cast("bigint")).withColumn(
        "part_bound", F.lit(1).cast("bigint"),
    )
    rest = items.select(
        "plan_id",
        "capacity",
        "doc_id",
        "n_pieces",
        F.col("n_pieces").alias("piece"),
        (F.col("tokens") - (F.col("n_pieces") - 1) * F.col("capacity")).alias("size"),
    )

    counts = {r["plan_id"]: r["n"] for r in rest.groupBy("plan_id").agg(F.count(F.lit(1)).alias("n")).collect()}  # a row per plan

    def dealt(rows: DataFrame, key, counts: dict[int, int]) -> DataFrame:
        parts = F.lit(1)
        for p, n in counts.items():
            parts = F.when(F.col("plan_id") == p, -(-n // per_partition)).otherwise(parts)
        return rows.withColumn("__part", F.pmod(key, parts))

    def packed(rows: DataFrame, number: int) -> DataFrame:
        def run(key: tuple, pdf: pd.DataFrame) -> pd.DataFrame:
            return _packed(pdf, f"{number}.{key[1]}", number == rounds)

        return rows.groupBy("plan_id", "__part").applyInPandas(run, PACKED)

    rest = dealt(rest.withColumn("container", F.lit(None).cast("string")), F.xxhash64("doc_id"), counts)
    now, done = cut(packed(rest, 0)), []
    for r in range(1, rounds + 1):
        done.append(now.filter(~F.col("released")))
        loose = now.filter("released")
        counts = {x["plan_id"]: x["n"] for x in loose.groupBy("plan_id").agg(F.count(F.lit(1)).alias("n")).collect()}
        now = cut(packed(dealt(loose, F.xxhash64(F.lit(r), "container"), counts), r))
    result = big
    for part in [*done, now]:
        result = result.unionByName(part.drop("released"))
    return result


def plan_rows(plans: DataFrame) -> list[tuple[int, int]]:
    """The plans table is a few rows of settings; more than MOST_PLANS are refused."""
    rows = plans.select("plan_id", "capacity").distinct().limit(MOST_PLANS + 1).collect()
    if len(rows) > MOST_PLANS:
        raise ValueError(f"more than {MOST_PLANS} plans")
    return sorted((r["plan_id"], r["capacity"]) for r in rows if r["plan_id"] is not None and r["capacity"] is not None)


def pack(documents: DataFrame, plans: DataFrame, vocabulary: str = VOCABULARY) -> DataFrame:
    return pack_sizes(cut(document_sizes(documents, vocabulary)), plan_rows(plans))


def split_documents(packed: DataFrame) -> DataFrame:
    """(plan_id, doc_id) of the documents that had to be split."""
    return packed.filter("n_pieces > 1").select("plan_id", "doc_id").distinct()


BOUNDS = "plan_id int, bound bigint"


def _bound(pdf: pd.DataFrame) -> pd.DataFrame:
    capacity = int(pdf["capacity"].iloc[0])
    whole = int(pdf.loc[pdf["size"] >= capacity, "n"].sum())
    rest = pdf[pdf["size"] < capacity]
    bound = counted_bound(rest["size"].to_numpy(np.int64), rest["n"].to_numpy(np.int64), capacity)
    if whole and not (rest["size"] > 0).any():
        bound = 0  # empty items fit anywhere
    return pd.DataFrame({"plan_id": [pdf["plan_id"].iloc[0]], "bound": [whole + bound]})


def packing_summary(packed: DataFrame) -> DataFrame:
    """Per plan: containers, tokens, unused space, the certified lower bound of the containers of any
    packing of these items and the gap to it, and how many partitions reach their own bound."""
    key = ["plan_id", "capacity"]
    bins = packed.groupBy(*key, "container").agg(F.sum("size").alias("size"))
    total = bins.groupBy(*key).agg(F.count(F.lit(1)).alias("containers"), F.sum("size").alias("tokens"), F.max("size").alias("fullest"))
    # a table of at most capacity rows for each plan goes to Python
    bounds = packed.groupBy(*key, "size").agg(F.count(F.lit(1)).alias("n")).groupBy("plan_id").applyInPandas(_bound, BOUNDS)
    parts = packed.filter("NOT startswith(part, 'whole')").select(*key, "part", "part_bins", "part_bound").distinct()
    parts = parts.groupBy("plan_id").agg(
        F.count(F.lit(1)).alias("partitions"), F.count_if(F.col("part_bins") == F.col("part_bound")).alias("optimal_partitions"),
    )
    all_ = total.join(bounds, "plan_id").join(parts, "plan_id", "left").fillna({"partitions": 0, "optimal_partitions": 0})
    gap = F.col("containers") - F.col("bound")
    return all_.select(
        *key,
        "containers",
        "tokens",
        "bound",
        gap.alias("gap"),
        (F.col("containers") * F.col("capacity") - F.col("tokens")).alias("unused"),
        "fullest",
        "partitions",
        "optimal_partitions",
    )
