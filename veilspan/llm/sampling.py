"""Samples that follow target category shares.

For each draw a two-way table of quotas (category x stratum) is made.  The category margin is what
the draw wants of the category, as far as the batch holds it; it is spread over the strata in
proportion to what each holds.  Such a table is fractional.  A maximum flow over the unit
remainders makes it integer while every cell, category margin and stratum margin stays between the
floor and ceiling of its fraction ("controlled rounding").  Each cell then takes exactly its quota:
the rows with the smallest random keys.

Only the table of counts (categories x strata of one draw) goes to a Python group; rows never do.
The cut inside a cell is found on a histogram of the leading key bits, so a cell that holds a third
of all rows is still counted with partial sums and only rows of its boundary bucket are ranked.

A category wants max(min_rows, draw_size * target_share) rows: minima come on top of the shares, so
a draw with large minima may be larger than draw_size.  Strata are the workloads of the samples.

Defined results: null categories belong to no category; rows without id are left out; a repeated
item counts once (latest delivery, then the largest values); a category or batch that the pool
lacks has available 0; null shares, sizes and minima count as 0; targets repeated for a draw and
category count once, with the largest wish.
"""

from __future__ import annotations

import math
from collections import deque
from fractions import Fraction

import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import cut, fold_kind, fold_name, null_safe

ANNOTATIONS, LEAKS = "annotations.kind", "leak_results.option_name"
BUCKET_BITS = 12


def pool_rows(annotations: DataFrame, leaks: DataFrame) -> DataFrame:
    """(pool, batch_id, item, category, stratum), each item once."""
    stratum = F.regexp_extract(F.coalesce("sample_id", F.lit("")), r"^([^_]*)_", 1)
    a = annotations.filter(F.col("ann_id").isNotNull()).select(
        F.col("ann_id").cast("string").alias("item"),
        F.col("annotated_at").alias("__at"),
        F.col("batch_id").alias("batch_id"),
        fold_kind(F.col("kind")).alias("category"),
        stratum.alias("stratum"),
    )
    b = leaks.withColumn("__o", fold_name(F.col("option_name"))).filter(F.col("sample_id").isNotNull() & F.col("__o").isNotNull())
    b = b.select(
        F.concat_ws("\u0001", "sample_id", "__o").alias("item"),
        F.col("measured_at").alias("__at"),
        "batch_id",
        F.col("__o").alias("category"),
        stratum.alias("stratum"),
    )
    rows = a.withColumn("pool", F.lit(ANNOTATIONS)).unionByName(b.withColumn("pool", F.lit(LEAKS)))
    last = rows.groupBy("pool", "item").agg(F.max(F.struct("__at", "batch_id", "category", "stratum")).alias("x"))
    return last.select("pool", "x.batch_id", "item", "x.category", "x.stratum").filter(F.col("category").isNotNull())


def draw_wants(targets: DataFrame) -> DataFrame:
    """(draw_id, pool, batch_id, category as given, key, want) with want a real number."""
    zero = F.lit(0.0)
    share = F.coalesce(F.col("draw_size").cast("double") * F.col("target_share"), zero)
    near = F.when(F.abs(share - F.round(share)) < 1e-6, F.round(share)).otherwise(share)
    want = F.greatest(F.coalesce(F.col("min_rows").cast("double"), zero), near, zero)
    key = F.when(F.col("pool") == ANNOTATIONS, fold_kind(F.col("category"))).otherwise(fold_name(F.col("category")))
    return targets.filter(key.isNotNull()).groupBy("draw_id", "pool", "batch_id", "category", key.alias("key")).agg(F.max(want).alias("want"))


def cell_counts(rows: DataFrame, wants: DataFrame) -> DataFrame:
    """(draw_id, pool, batch_id, category, key, want, stratum, n); a category without rows has a null stratum and n 0."""
    held = rows.groupBy("pool", "batch_id", F.col("category").alias("key"), "stratum").agg(F.count(F.lit(1)).alias("n"))
    return null_safe(wants, held, ["pool", "batch_id", "key"], "left").fillna({"n": 0})


def _between(x: float | Fraction) -> tuple[int, int]:
    """Floor and ceiling: exact for a fraction; a float is right to 1e-9 only."""
    slack = 0 if isinstance(x, Fraction) else 1e-9
    return math.floor(x + slack), math.ceil(x - slack)


def controlled_rounding(table: list[list[float | Fraction]]) -> list[list[int]]:
    """Integer table whose cells, row sums, column sums and total are each the floor or ceiling of
    the fractional ones.  Maximum flow: source -> rows -> cells -> columns -> sink, where an edge
    carries the floor for certain and one unit more if its sum has a remainder.  Quotas are ratios
    of whole counts, so they come as fractions and nothing is compared with a tolerance."""
    rows, cols = len(table), len(table[0]) if table else 0
    added = lambda xs: sum(xs, Fraction(0)) if all(isinstance(x, Fraction) for x in xs) else math.fsum(xs)
    cells = [[_between(x) for x in r] for r in table]
    out = [[low for low, _ in r] for r in cells]
    open_cell = [[low < high for low, high in r] for r in cells]
    row_sum = [added(r) for r in table]
    by_row = [_between(s) for s in row_sum]
    by_col = [_between(added([r[j] for r in table])) for j in range(cols)]
    row_low = [low - sum(o) for (low, _), o in zip(by_row, out)]
    row_high = [high - sum(o) for (_, high), o in zip(by_row, out)]
    col_low = [by_col[j][0] - sum(o[j] for o in out) for j in range(cols)]
    col_high = [by_col[j][1] - sum(o[j] for o in out) for j in range(cols)]
    used_row, used_col, flow = [0] * rows, [0] * cols, [[0] * cols for _ in range(rows)]

    def augment(row_cap: list[int], col_cap: list[int] | None, row_keep: list[int] | None = None) -> bool:
        """One more unit for a row below row_cap: it goes to a column below col_cap, or is taken
        from a row above row_keep; column margins never fall."""
        back: dict = {("r", i): None for i in range(rows) if used_row[i] < row_cap[i]}
        queue = deque(back)
        while queue:
            at = queue.popleft()
            ends = used_col[at[1]] < col_cap[at[1]] if at[0] == "c" and col_cap else False
            if at[0] == "r" and back[at] is not None and row_keep:
                ends = used_row[at[1]] > row_keep[at[1]]
            if ends:
                if at[0] == "c":
                    used_col[at[1]] += 1
                else:
                    used_row[at[1]] -= 1
                while back[at] is not None:
                    prev = back[at]
                    if at[0] == "c":
                        flow[prev[1]][at[1]] = 1
                    else:
                        flow[at[1]][prev[1]] = 0
                    at = prev
                used_row[at[1]] += 1
                return True
            if at[0] == "r":
                nxt = [("c", j) for j in range(cols) if open_cell[at[1]][j] and not flow[at[1]][j]]
            else:
                nxt = [("r", i) for i in range(rows) if flow[i][at[1]]]
            for n in nxt:
                if n not in back:
                    back[n] = at
                    queue.append(n)
        return False

    # columns to their floors, rows to theirs (by exchange before new units), then the total
    while augment(row_high, col_low):
        pass
    while augment(row_low, None, row_low) or augment(row_low, col_high):
        pass
    total = round(added(row_sum)) - sum(map(sum, out))
    while sum(used_row) < total and augment(row_high, col_high):
        pass
    return [[o + f for o, f in zip(a, b)] for a, b in zip(out, flow)]


QUOTAS = "draw_id bigint, pool string, batch_id string, category string, key string, want double, available bigint, stratum string, held bigint, quota bigint"


def _quotas(pdf: pd.DataFrame) -> pd.DataFrame:
    pdf = pdf.sort_values(["category", "stratum"], na_position="last")
    cats, strata = list(dict.fromkeys(pdf["category"])), sorted({s for s in pdf["stratum"] if isinstance(s, str)})
    at = {(c, s): int(n) for c, s, n in zip(pdf["category"], pdf["stratum"], pdf["n"])}
    have = {c: sum(at.get((c, s), 0) for s in strata) for c in cats}
    want = dict(zip(pdf["category"], pdf["want"]))
    take = {c: min(Fraction(float(want[c])), Fraction(have[c])) for c in cats}
    table = [[take[c] * at.get((c, s), 0) / have[c] if have[c] else Fraction(0) for s in strata] for c in cats]
    quota = controlled_rounding(table) if strata else [[] for _ in cats]
    first = pdf.iloc[0]
    keys = dict(zip(pdf["category"], pdf["key"]))
    rows = []
    for c, q in zip(cats, quota):
        cells = [(s, at.get((c, s), 0), k) for s, k in zip(strata, q) if at.get((c, s), 0)] or [(None, 0, 0)]
        rows += [(first["draw_id"], first["pool"], first["batch_id"], c, keys[c], float(want[c]), have[c], s, n, k) for s, n, k in cells]
    return pd.DataFrame(rows, columns=[x.split()[0] for x in QUOTAS.split(", ")])


def quota_table(annotations: DataFrame, leaks: DataFrame, targets: DataFrame) -> DataFrame:
    """One row per draw, category and stratum: want, available, held and the integer quota.  A
    group of the Python step is one draw's table of counts: categories times strata rows."""
    return quotas_of(pool_rows(annotations, leaks), targets)


def quotas_of(rows: DataFrame, targets: DataFrame) -> DataFrame:
    counts = cell_counts(rows, draw_wants(targets))
    # tables of counts are small, so adaptive execution would put all draws into one task
    dealt = counts.repartition(counts.sparkSession.sparkContext.defaultParallelism, "draw_id")
    return dealt.groupBy("draw_id", "pool", "batch_id").applyInPandas(_quotas, QUOTAS)


def draw_report(quotas: DataFrame) -> DataFrame:
    """(draw_id, category, wanted, available, taken, short): one row per draw and category."""
    return quotas.groupBy("draw_id", "category").agg(
        F.max("want").alias("wanted"), F.max("available").alias("available"), F.sum("quota").alias("taken"),
    ).withColumn("short", F.col("available") < F.col("wanted"))


def draw_sample(annotations: DataFrame, leaks: DataFrame, targets: DataFrame, seed: int = 17) -> DataFrame:
    """(draw_id, pool, item, category, stratum): exactly the quota of each cell."""
    pool = cut(pool_rows(annotations, leaks))
    quotas = quotas_of(pool, targets).filter("quota > 0").select(
        "draw_id", "pool", "batch_id", "key", F.col("category").alias("__c"), "stratum", "quota",
    )
    rows = pool.withColumnRenamed("category", "key")
    drawn = null_safe(rows, quotas, ["pool", "batch_id", "key", "stratum"])
    h = F.xxhash64(F.lit(seed), "draw_id", "pool", "item")
    drawn = drawn.select(
        "draw_id",
        "pool",
        "item",
        F.col("__c").alias("category"),
        "stratum",
        "quota",
        h.alias("__h"),
        F.shiftrightunsigned(h, 64 - BUCKET_BITS).alias("__b"),
    )
    cell = ["draw_id", "pool", "category", "stratum"]
    bucket = drawn.groupBy(*cell, "quota", "__b").agg(F.count(F.lit(1)).alias("__n"))
    w = Window.partitionBy(*cell).orderBy("__b").rowsBetween(Window.unboundedPreceding, 0)
    bucket = bucket.withColumn("__cum", F.sum("__n").over(w)).withColumn(
        "__before", F.col("__cum") - F.col("__n"),
    ).filter(F.col("__before") < F.col("quota"))
    bucket = bucket.select(*cell, "__b", (F.col("quota") - F.col("__before")).alias("__left"), "__n")
    near = null_safe(drawn.drop("quota"), bucket, [*cell, "__b"])
    whole = near.filter(F.col("__n") <= F.col("__left"))
    edge = near.filter(F.col("__n") > F.col("__left")).withColumn(
        "__r", F.row_number().over(Window.partitionBy(*cell, "__b").orderBy("__h", "item")),
    ).filter(F.col("__r") <= F.col("__left"))
    return whole.select(*cell, "item").unionByName(edge.select(*cell, "item"))


def shortfalls(annotations: DataFrame, leaks: DataFrame, targets: DataFrame) -> DataFrame:
    """(draw_id, category) of the categories that cannot be met."""
    return draw_report(quota_table(annotations, leaks, targets)).filter("short").select("draw_id", "category").distinct()
