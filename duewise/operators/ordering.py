"""First/latest/top rows, distributed global order, exact median.

Nothing here sends a whole dataset or a whole group through one task: per-key picks use window group
limits (a map-side limit runs before the shuffle), and global orders are built from range partitions.
"""

from __future__ import annotations

import sys
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from duewise.session import drop_staged, stage

SLICE_ROWS = 1 << 22
PIECE_ROWS = 1 << 16
MEDIAN_BUCKETS = 1 << 12


def drop_null_keys(df: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Group keys that are null never form a group."""
    return df.dropna(subset=list(keys))


def top_per_key(df: DataFrame, keys: Sequence[str], order: Sequence[Column], k: int) -> DataFrame:
    """The first ``k`` rows of each key. ``order`` must be total for a repeatable answer."""
    ranked = df.withColumn("_rank", F.row_number().over(W.partitionBy(*keys).orderBy(*order)))
    return ranked.filter(F.col("_rank") <= k).drop("_rank")


def first_per_key(df: DataFrame, keys: Sequence[str], order: Sequence[Column]) -> DataFrame:
    return top_per_key(df, keys, order, 1)


def latest_per_key(df: DataFrame, keys: Sequence[str], time: str, tie_break: Sequence[str] = ()) -> DataFrame:
    """The row with the greatest ``time`` per key; rows without a time never win."""
    order = [F.col(time).desc(), *(F.col(c).desc() for c in tie_break)]
    return first_per_key(df.filter(F.col(time).isNotNull()), keys, order)


def dedupe(df: DataFrame, keys: Sequence[str], order: Sequence[str]) -> DataFrame:
    """One row per key, the smallest in ``order``."""
    return first_per_key(df, keys, [F.col(c).asc() for c in order])


def running_totals(
    df: DataFrame, order: Sequence[Column], sums: dict[str, str], slice_rows: int = SLICE_ROWS, piece_rows: int = PIECE_ROWS
) -> DataFrame:
    """Global row position and running sums over a total order, without a single-task sort.

    The number of range slices follows the number of rows, and each sorted slice is written once with the row
    numbers of its rows, so all readers see the same places. Positions need no window: the offset of the slice
    and the row number give them. Sums run over pieces of at most ``piece_rows`` consecutive rows of a slice,
    whatever the size of the slice; piece totals run within their slice and slice totals over all slices.
    ``order`` should end in a unique column, otherwise equal rows share a slice. Adds ``position`` (1-based),
    ``row_total`` and, for every ``out: column`` in ``sums``, ``out`` and ``out_total``.
    """
    rows = stage(df, "rows")
    slices = max(1, -(-rows.count() // slice_rows))
    placed = rows.repartitionByRange(slices, *order).sortWithinPartitions(*order)
    sliced = stage(placed.withColumn("_at", F.monotonically_increasing_id()), "slices")
    drop_staged(rows)
    # A generated id is the partition number above the row number within the partition.
    row = F.col("_at").bitwiseAND(F.lit((1 << 33) - 1))
    sliced = sliced.select(
        "*", F.shiftright("_at", 33).alias("_slice"), row.alias("_row"), F.floor(row / piece_rows).alias("_piece")
    )
    pieces = sliced.groupBy("_slice", "_piece").agg(
        F.count(F.lit(1)).alias("_n"), *(F.sum(column).alias(f"_s_{out}") for out, column in sums.items())
    )
    totals = pieces.groupBy("_slice").agg(F.sum("_n").alias("_n"), *(F.sum(f"_s_{o}").alias(f"_s_{o}") for o in sums))
    before = W.orderBy("_slice").rowsBetween(W.unboundedPreceding, -1)
    whole = W.orderBy("_slice").rowsBetween(W.unboundedPreceding, W.unboundedFollowing)
    # One row for each slice, so one for ``slice_rows`` rows of the table.
    offsets = totals.select(
        "_slice",
        F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_first"),
        F.sum("_n").over(whole).alias("row_total"),
        *(F.coalesce(F.sum(f"_s_{o}").over(before), F.lit(0)).alias(f"_off_{o}") for o in sums),
        *(F.sum(f"_s_{o}").over(whole).alias(f"{o}_total") for o in sums),
    )
    position = (F.col("_first") + F.col("_row") + 1).alias("position")
    if not sums:
        return sliced.join(offsets, "_slice").select(*df.columns, position, "row_total")
    earlier = W.partitionBy("_slice").orderBy("_piece").rowsBetween(W.unboundedPreceding, -1)
    starts = pieces.select(
        "_slice", "_piece", *(F.coalesce(F.sum(f"_s_{o}").over(earlier), F.lit(0)).alias(f"_in_{o}") for o in sums)
    ).join(offsets, "_slice")
    upto = W.partitionBy("_slice", "_piece").orderBy("_row").rowsBetween(W.unboundedPreceding, W.currentRow)
    running = sliced.select("*", *(F.sum(column).over(upto).alias(f"_run_{o}") for o, column in sums.items()))
    return running.join(starts, ["_slice", "_piece"]).select(
        *df.columns,
        position,
        "row_total",
        *((F.col(f"_off_{o}") + F.col(f"_in_{o}") + F.coalesce(f"_run_{o}", F.lit(0))).alias(o) for o in sums),
        *(f"{o}_total" for o in sums),
    )


def exact_median(df: DataFrame, value: str) -> DataFrame:
    """One row ``(median)``: the middle value, or the mean of the two middle values; nulls are ignored.

    Equal values are first counted together, so a value that fills a third of the table costs one row.
    """
    counts = df.filter(F.col(value).isNotNull()).groupBy(value).agg(F.count(F.lit(1)).alias("_count"))
    running = running_totals(counts, [F.col(value)], {"_upto": "_count"})
    low = F.expr("(_upto_total - 1) div 2")
    high = F.expr("_upto_total div 2")
    start = F.col("_upto") - F.col("_count")

    def covers(at: Column) -> Column:
        return ((at >= start) & (at < F.col("_upto"))).cast("int")

    return running.agg((F.sum(F.col(value) * (covers(low) + covers(high))) / 2.0).alias("median"))


def exact_medians(df: DataFrame, columns: Sequence[str], buckets: int = MEDIAN_BUCKETS) -> DataFrame:
    """(name, values, median) of many number columns at once; nulls and NaN are ignored.

    The range of values that holds the middles of a column is cut into ``buckets`` even parts, and the part with the middles
    becomes the next range, until its ends are the middles: rows are counted, never sorted, shuffled or written. A pass
    shuffles at most ``buckets`` counts a column and task, and two or three passes do for some 10^8 rows. ``values`` is the
    number of values; the median of none is null. ``columns`` are listed names, so the result has one row for each of them.
    """
    spark, names = df.sparkSession, list(columns)
    schema = "name string, values long, median double"
    if not names:
        return spark.createDataFrame([], schema)
    # Adding zero makes one value of both zeros.
    plain = df.select(*(
        F.when(~F.isnan(v), v + F.lit(0.0)).alias(f"c{i}") for i, v in enumerate(F.col(c).cast("double") for c in names)
    ))
    first = plain.agg(*(F.struct(F.count(c).alias("n"), F.min(c).alias("lo"), F.max(c).alias("hi")).alias(c) for c in plain.columns)).first()
    medians: dict[int, float] = {}
    # Column to its range: ends, and the number of values below it.
    ranges = {i: (first[i]["lo"], first[i]["hi"], 0) for i in range(len(names)) if first[i]["n"]}
    while True:
        for i in [i for i, (lo, hi, _) in ranges.items() if lo == hi]:
            medians[i] = ranges.pop(i)[0]
        if not ranges:
            break
        cells = F.explode(F.array(*(
            F.struct(F.lit(i).alias("_column"), F.col(f"c{i}").alias("_value"), _part(F.col(f"c{i}"), lo, hi, buckets).alias("_part"))
            for i, (lo, hi, _) in ranges.items()
        )))
        parts = plain.select(cells.alias("_cell")).select("_cell.*").filter(F.col("_part").isNotNull()).groupBy("_column", "_part").agg(
            F.count(F.lit(1)).alias("_n"), F.min("_value").alias("lo"), F.max("_value").alias("hi")
        )
        below = {i: F.lit(before) for i, (_, _, before) in ranges.items()}
        size = {i: F.lit(first[i]["n"]) for i in ranges}
        upto = F.sum("_n").over(W.partitionBy("_column").orderBy("_part"))  # `buckets` rows a column
        placed = parts.select("*", (upto + _of_column(below)).alias("_upto"), _of_column(size).alias("_size"))
        low, high, start = F.expr("(_size - 1) div 2"), F.expr("_size div 2"), F.col("_upto") - F.col("_n")
        middles = placed.filter((start <= high) & (low < F.col("_upto"))).select("_column", "lo", "hi", start.alias("_start")).collect()
        for i in list(ranges):
            # Middles in two parts are the end of one and the begin of the next.
            own = sorted((r for r in middles if r["_column"] == i), key=lambda r: r["_start"])
            if len(own) == 2:
                medians[i] = (own[0]["hi"] + own[1]["lo"]) / 2.0
                del ranges[i]
            else:
                ranges[i] = (own[0]["lo"], own[0]["hi"], own[0]["_start"])
    return spark.createDataFrame([(c, first[i]["n"], medians.get(i)) for i, c in enumerate(names)], schema)


def _part(value: Column, lo: float, hi: float, buckets: int) -> Column:
    """Which of the even parts of [lo, hi] a value is in, null outside; never falls as values rise, the ends are in the outer parts."""
    biggest = sys.float_info.max
    a, b = max(lo, -biggest) / 2, min(hi, biggest) / 2  # halves, so that no difference overflows
    at = F.floor((value / 2 - F.lit(a)) / F.lit(b - a) * F.lit(float(buckets))) if b > a else F.lit(0)
    inner = F.greatest(F.lit(0), F.least(F.lit(buckets - 1), at.cast("int")))
    part = F.when(value == F.lit(lo), -1).when(value == F.lit(hi), buckets).otherwise(inner)
    return F.when((value >= F.lit(lo)) & (value <= F.lit(hi)), part)


def _of_column(values: dict[int, Column]) -> Column:
    out = None
    for i, value in values.items():
        hit = F.col("_column") == i
        out = F.when(hit, value) if out is None else out.when(hit, value)
    return out


def ntile_of(position: Column, total: Column, buckets: int) -> Column:
    """Bucket of a 1-based position when the remainder goes to the first buckets (as SQL ``ntile``)."""
    size = F.floor(total / buckets)
    extra = total - size * buckets
    cut = extra * (size + 1)
    early = F.floor((position - 1) / (size + 1)) + 1
    late = extra + F.floor((position - 1 - cut) / F.when(size > 0, size).otherwise(F.lit(1))) + 1
    return F.when(position <= cut, early).otherwise(late).cast("int")


def average_percent_rank(df: DataFrame, value: str, out: str = "pct_rank") -> DataFrame:
    """Percentile rank with tied values sharing their mean rank (rank / n)."""
    counts = df.filter(F.col(value).isNotNull()).groupBy(value).agg(F.count(F.lit(1)).alias("_count"))
    running = running_totals(counts, [F.col(value)], {"_upto": "_count"})
    ranked = running.select(
        value, ((F.col("_upto") - F.col("_count") + (F.col("_count") + 1) / 2.0) / F.col("_upto_total")).alias(out)
    )
    return df.join(ranked, value, "left")


def last_observations(df: DataFrame, order: str, n: int, keys: Sequence[str] = ()) -> DataFrame:
    """The last ``n`` rows by order, per key or overall, with ``age`` = 1 for the newest.

    The overall form is for daily series, which hold one row per date.
    """
    ranking = (W.partitionBy(*keys) if keys else W).orderBy(F.col(order).desc())
    return df.withColumn("age", F.row_number().over(ranking)).filter(F.col("age") <= n)
