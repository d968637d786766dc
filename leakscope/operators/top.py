"""First rows per key, without collecting a key in one task."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..session import cut_lineage, local_table

# Up to this rank Spark itself limits each group before the shuffle.
PUSHED_RANK = 1000


def top_per_key(
    df: DataFrame, keys: Sequence[str], order: Sequence[Column], n: int, *, rank: str = "rank", salts: int = 64
) -> DataFrame:
    """The first ``n`` rows of every key, with their rank.

    A rank filter up to 1000 is limited on the map side, so a hot key sends at
    most ``n`` rows per task.  For a larger ``n`` the key is salted first.
    """
    if n > PUSHED_RANK:
        order_cols = [F.row_number().over(Window.partitionBy(*keys, "_salt").orderBy(*order)).alias("_r")]
        df = (
            df.withColumn("_salt", F.pmod(F.xxhash64(*[c for c, t in df.dtypes if "map<" not in t and "variant" not in t]), F.lit(salts)))
            .select("*", *order_cols)
            .where(F.col("_r") <= n)
            .drop("_salt", "_r")
        )
    ranked = df.withColumn(rank, F.row_number().over(Window.partitionBy(*keys).orderBy(*order)))
    return ranked.where(F.col(rank) <= n)


def global_rank(df: DataFrame, order: Sequence[Column], *, rank: str = "rank") -> DataFrame:
    """``df`` with each row's place in the whole order, from 1; no task holds more than its range of it.

    Rows are dealt out by ranges and sorted there, and the checkpointed ranges are numbered by the rows of those before
    them: one number a range passes through the driver.  Rows that are equal in the order are numbered in any way.
    """
    dealt = df.repartitionByRange(*order).sortWithinPartitions(*order)
    # The lower 33 bits count the rows of a partition, the upper ones are its number.
    placed = cut_lineage(dealt.withColumn("_at", F.monotonically_increasing_id()))
    part = F.shiftright("_at", 33)
    before, ends = {}, 0
    for r in placed.groupBy(part.alias("p")).agg(F.count(F.lit(1)).alias("n")).orderBy("p").collect():
        before[r["p"]], ends = ends, ends + r["n"]
    if not before:
        return placed.withColumn(rank, F.col("_at")).drop("_at")
    offsets = local_table(df.sparkSession, sorted(before.items()), "_p bigint, _before bigint")
    numbered = placed.withColumn("_p", part).join(F.broadcast(offsets), "_p")
    return numbered.withColumn(rank, F.col("_before") + F.col("_at").bitwiseAND((1 << 33) - 1) + 1).drop("_at", "_p", "_before")
