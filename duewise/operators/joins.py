"""As-of joins, trailing-window features, checked and containment joins."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F


def assert_unique(df: DataFrame, keys: Sequence[str], name: str) -> DataFrame:
    """Fail when ``keys`` repeat; returns ``df`` so it can be used inside a join. Costs one aggregate."""
    repeated = df.groupBy(*keys).agg(F.count(F.lit(1)).alias("n")).filter(F.col("n") > 1).limit(1)
    if repeated.count():
        raise ValueError(f"{name}: {list(keys)} is not unique")
    return df


def keyed_join(
    left: DataFrame,
    right: DataFrame,
    keys: Sequence[str],
    how: str = "left",
    *,
    unique_left: bool = False,
    unique_right: bool = False,
) -> DataFrame:
    """Join whose cardinality can be checked: N:1 with ``unique_right``, 1:1 with both."""
    if unique_left:
        assert_unique(left, keys, "left side")
    if unique_right:
        assert_unique(right, keys, "right side")
    return left.join(right, list(keys), how)


def coalescing_join(left: DataFrame, right: DataFrame, keys: Sequence[str], columns: Sequence[str]) -> DataFrame:
    """Left join that keeps the left value of ``columns`` and takes the right one where it is missing."""
    other = right.select(*keys, *(F.col(c).alias(f"_right_{c}") for c in columns))
    joined = left.join(other, list(keys), "left")
    for c in columns:
        mine = F.col(c) if c in left.columns else F.lit(None)
        joined = joined.withColumn(c, F.coalesce(mine, F.col(f"_right_{c}")))
    return joined.drop(*(f"_right_{c}" for c in columns))


def met(right: DataFrame, left: DataFrame, keys: Sequence[str]) -> DataFrame:
    """The rows of ``right`` whose ``keys`` occur in ``left``: all that a left join of ``left`` by them can meet."""
    return right.join(left.select(*keys), list(keys), "left_semi")


def asof_join(
    left: DataFrame,
    right: DataFrame,
    keys: Sequence[str],
    left_time: str,
    right_time: str,
    values: Sequence[str],
    *,
    tie_break: Sequence[str] = (),
    slice_unit: str | None = "month",
    anchors: DataFrame | None = None,
) -> DataFrame:
    """Add to each left row the ``values`` of the latest right row at or before its time (null when none).

    No pair of a left and a right row is ever built. The answer depends only on (key, time), so both sides
    shrink to one row per (key, time) before they are put on one timeline. A timeline is cut at calendar
    slices; each slice starts with the value carried over from the slices before it, so even a key that
    owns a third of all rows is spread over many tasks. ``slice_unit=None`` keeps one timeline per key,
    enough when times are dates. ``anchors`` may name a cheaper table that holds at least the left (key, time)
    pairs, so that an expensive ``left`` is evaluated once.
    """
    keys = list(keys)
    payload_fields = [F.col(right_time).alias("_at"), *(F.col(c).alias(f"_tie_{c}") for c in tie_break)]
    payload_fields += [F.col(c).alias(c) for c in values]
    points = (
        (left if anchors is None else anchors).select(*keys, F.col(left_time).alias("_t"))
        .dropna(subset=[*keys, "_t"])
        .distinct()
    )
    history = (
        right.dropna(subset=[*keys, right_time])
        .groupBy(*keys, F.col(right_time).alias("_t"))
        .agg(F.max(F.struct(*payload_fields)).alias("_payload"))
    )
    rows = history.withColumn("_side", F.lit(1)).unionByName(
        points.withColumn("_side", F.lit(2)), allowMissingColumns=True
    )
    if slice_unit is None:
        timeline = rows
        where = W.partitionBy(*keys)
    else:
        rows = rows.withColumn("_slice", F.trunc(F.to_date("_t"), slice_unit))
        slices = rows.groupBy(*keys, "_slice").agg(F.max("_payload").alias("_latest"))
        earlier = W.partitionBy(*keys).orderBy("_slice").rowsBetween(W.unboundedPreceding, -1)
        carried = slices.select(
            *keys, "_slice", F.last("_latest", ignorenulls=True).over(earlier).alias("_payload")
        ).filter(F.col("_payload").isNotNull())
        timeline = rows.unionByName(carried.withColumn("_side", F.lit(0)), allowMissingColumns=True)
        where = W.partitionBy(*keys, "_slice")
    # Carried rows (side 0, null time) sort first; at equal times history comes before the anchor.
    upto = where.orderBy(F.col("_t").asc_nulls_first(), "_side").rowsBetween(W.unboundedPreceding, W.currentRow)
    answers = (
        timeline.withColumn("_found", F.last("_payload", ignorenulls=True).over(upto))
        .filter(F.col("_side") == 2)
        .select(*keys, F.col("_t").alias(left_time), *(F.col(f"_found.{c}").alias(c) for c in values))
    )
    return left.join(answers, [*keys, left_time], "left")


def asof_anchors(
    points: DataFrame,
    history: DataFrame,
    keys: Sequence[str],
    times: dict[str, str],
    history_time: str,
    values: Sequence[str],
    identity: Sequence[str],
    slice_unit: str = "month",
) -> DataFrame:
    """``identity``, ``anchor`` and a struct of ``values`` (null when none) for several times of each point at once.

    One timeline per key carries all anchors of all its points and the history, and one window answers them:
    the latest history row at or before the anchor, of equal times the greatest values. Timelines are cut at
    calendar slices that begin with the value carried over, so a key with many points is spread over tasks.
    Points without a key or a time have no answer row.
    """
    keys, found = list(keys), F.struct(*(F.col(c).alias(c) for c in values))
    anchors = F.array(*(F.struct(F.lit(name).alias("anchor"), F.to_date(at).alias("_t")) for name, at in times.items()))
    asked = points.select(*identity, *keys, F.inline(anchors)).dropna(subset=[*keys, "_t"]).withColumn("_side", F.lit(2))
    known = history.dropna(subset=[*keys, history_time]).select(
        *keys, F.to_date(history_time).alias("_t"), found.alias("_payload"), F.lit(1).alias("_side")
    )
    rows = asked.unionByName(known, allowMissingColumns=True).withColumn("_slice", F.trunc("_t", slice_unit))
    slices = rows.groupBy(*keys, "_slice").agg(F.max(F.when(F.col("_side") == 1, F.struct("_t", "_payload"))).alias("_latest"))
    earlier = W.partitionBy(*keys).orderBy("_slice").rowsBetween(W.unboundedPreceding, -1)
    carried = slices.select(*keys, "_slice", F.last("_latest", ignorenulls=True).over(earlier).alias("_latest")).filter("_latest is not null")
    rows = rows.unionByName(carried.select(*keys, "_slice", "_latest._payload", F.lit(0).alias("_side")), allowMissingColumns=True)
    upto = W.partitionBy(*keys, "_slice").orderBy(F.col("_t").asc_nulls_first(), "_side", "_payload").rowsBetween(W.unboundedPreceding, W.currentRow)
    return rows.withColumn("_found", F.last("_payload", ignorenulls=True).over(upto)).filter("_side = 2").select(
        *identity, "anchor", F.col("_found").alias("state")
    )


def trailing_features(
    anchors: DataFrame,
    facts: DataFrame,
    keys: Sequence[str],
    anchor_date: str,
    fact_date: str,
    sums: dict[str, Column | str],
    days: int,
    *,
    last_date: str | None = None,
) -> DataFrame:
    """Sums of facts dated within [anchor - days + 1, anchor] for each anchor row.

    Facts collapse to one row per (key, day) before they move, and a range frame over the key's days gives
    every window at once, so a busy key costs at most one row per calendar day. Anchors with no fact in the
    window get null sums; ``last_date`` adds the latest fact day at or before the anchor.
    """
    keys = list(keys)
    daily = (
        facts.withColumn("_day", F.to_date(fact_date))
        .dropna(subset=[*keys, "_day"])
        .groupBy(*keys, "_day")
        .agg(*(F.sum(e).alias(name) for name, e in sums.items()))
        .withColumn("_seen", F.col("_day"))
    )
    points = (
        anchors.select(*keys, F.to_date(anchor_date).alias("_day")).dropna(subset=[*keys, "_day"]).distinct()
        .withColumn("_wanted", F.lit(True))
    )
    grid = (
        daily.unionByName(points, allowMissingColumns=True)
        .groupBy(*keys, "_day")
        .agg(*(F.sum(n).alias(n) for n in sums), F.max("_seen").alias("_seen"), F.max("_wanted").alias("_wanted"))
        .withColumn("_n", F.datediff("_day", F.lit("1970-01-01")))
    )
    by_day = W.partitionBy(*keys).orderBy("_n")
    window = by_day.rangeBetween(-(days - 1), 0)
    columns = [F.sum(n).over(window).alias(n) for n in sums]
    if last_date:
        columns.append(F.max("_seen").over(by_day.rangeBetween(W.unboundedPreceding, 0)).alias(last_date))
    answers = (
        grid.select(*keys, "_day", "_wanted", *columns)
        .filter(F.col("_wanted"))
        .drop("_wanted")
        .withColumnRenamed("_day", "_anchor_day")
    )
    left = anchors.withColumn("_anchor_day", F.to_date(anchor_date))
    return left.join(answers, [*keys, "_anchor_day"], "left").drop("_anchor_day")


def matching_entries(text: Column, entries: Column, terms: Sequence[str]) -> Column:
    """Entries (array of structs) with at least one non-empty term field contained in ``text``.

    The entries are a configured list, so a row is compared with the list in place and emits only its
    matches; no product of two tables is built.
    """

    def hit(entry: Column) -> Column:
        found = F.lit(False)
        for term in terms:
            value = entry[term]
            found = found | F.coalesce((value != "") & F.contains(text, value), F.lit(False))
        return found

    return F.filter(entries, hit)
