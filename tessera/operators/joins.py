"""Join helpers: size-checked broadcast, and a contraction join that splits hot keys.

The contraction ``sum_k L[g, r, k] * R[g, k, c]`` joins on (g, k). If one
inner index k carries a large share of both sides, its pairs would all land
in one task. ``contract`` finds such keys with a per-key count (aggregated
map-side, one row per key), keeps the heaviest ``max_hot`` of them in a
table whose size is bounded by that limit, and splits each into an
``sa x sb`` grid: left rows of the key go to one of ``sa`` row-buckets and
are copied to all ``sb`` column-buckets, right rows the other way round.
Every (left, right) pair still meets exactly once, so the result is exact;
keys outside the table take the ordinary shuffle join, where AQE's skew-join
splitting still applies.

Two ways to split, then:

* default (``hot_split=False``): the join shuffles on its keys as Spark
  plans it, and AQE's skew-join handling (enabled by ``get_session``) cuts
  an oversized partition into map-block slices on both sides at run time.
  No extra pass; this is what a hot key meets unless told otherwise.
* ``hot_split=True``: the explicit split above, decided before the join
  from exact per-key counts. It costs one more pass over both inputs (only
  the key column is read when the input is a stored table), and it also
  covers plans where AQE cannot act (AQE disabled, or a user repartition
  under the join).
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

DEFAULT_PAIRS_PER_TASK = 1 << 24
DEFAULT_MAX_HOT_KEYS = 4096


def broadcast_if_small(df: DataFrame, max_rows: int) -> tuple[DataFrame, bool]:
    """Broadcast ``df`` only if it provably has at most ``max_rows`` rows.

    The check is an exact count that stops reading after ``max_rows + 1``
    rows, so it is cheap whichever way it goes.
    """
    n = df.limit(max_rows + 1).count()
    if n <= max_rows:
        return F.broadcast(df), True
    return df, False


def hot_key_table(left: DataFrame, right: DataFrame, keys: list[str],
                  pairs_per_task: int, max_hot: int) -> DataFrame:
    """Keys whose pair count exceeds ``pairs_per_task``, with their split grid.

    Columns: keys..., sa, sb. At most ``max_hot`` rows (the heaviest keys).
    """
    na = left.groupBy(*keys).agg(F.count(F.lit(1)).alias("na"))
    nb = right.groupBy(*keys).agg(F.count(F.lit(1)).alias("nb"))
    st = (na.join(nb, keys)
            .withColumn("pairs", F.col("na") * F.col("nb"))
            .where(F.col("pairs") > pairs_per_task))
    s = F.ceil(F.col("pairs") / F.lit(pairs_per_task))
    # Split so that copies (na*sb + nb*sa) are smallest for sa*sb ~= s.
    sa = F.least(F.greatest(F.ceil(F.sqrt(s * F.col("na") / F.col("nb"))), F.lit(1)),
                 F.least(s, F.col("na")))
    st = st.withColumn("sa", sa.cast("int"))
    sb = F.least(F.greatest(F.ceil(s / F.col("sa")), F.lit(1)), F.col("nb"))
    st = st.withColumn("sb", sb.cast("int"))
    return st.orderBy(F.desc("pairs"), *keys).limit(max_hot).select(*keys, "sa", "sb")


def contract(left: DataFrame, right: DataFrame, group: list[str], hot_split: bool = False,
             pairs_per_task: int = DEFAULT_PAIRS_PER_TASK,
             max_hot: int = DEFAULT_MAX_HOT_KEYS) -> DataFrame:
    """sum_k left(g, r, k, lv) * right(g, k, c, rv) -> (g..., r, c, v).

    ``left`` has columns group + [r, k, lv]; ``right`` group + [k, c, rv].
    The sum is aggregated partially after the join (map-side combine), then
    once more after a shuffle on (g, r, c).
    """
    keys = group + ["k"]
    if hot_split:
        hot = F.broadcast(hot_key_table(left, right, keys, pairs_per_task, max_hot))
        lx = (left.join(hot, keys, "left")
                  .withColumn("sa", F.coalesce("sa", F.lit(1)))
                  .withColumn("sb", F.coalesce("sb", F.lit(1)))
                  .withColumn("ga", F.pmod(F.xxhash64("r"), F.col("sa")).cast("int"))
                  .withColumn("gb", F.explode(F.sequence(F.lit(0), F.col("sb") - 1)))
                  .drop("sa", "sb"))
        rx = (right.join(hot, keys, "left")
                   .withColumn("sa", F.coalesce("sa", F.lit(1)))
                   .withColumn("sb", F.coalesce("sb", F.lit(1)))
                   .withColumn("gb", F.pmod(F.xxhash64("c"), F.col("sb")).cast("int"))
                   .withColumn("ga", F.explode(F.sequence(F.lit(0), F.col("sa") - 1)))
                   .drop("sa", "sb"))
        j = lx.join(rx, keys + ["ga", "gb"])
    else:
        j = left.join(right, keys)
    return j.groupBy(*group, "r", "c").agg(F.sum(F.col("lv") * F.col("rv")).alias("v"))
