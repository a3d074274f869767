"""Most frequent items: exact, spillable, with bounded memory.

Counting is a hash aggregation with map-side combining whose partitions spill
to disk.  Each partition then keeps its own top k per group, and one ordered
limit per group merges those: at most k rows per partition and group reach it,
however many distinct values there are and however hot one of them is.

Cases: null items are not counted, null groups form a group; an item repeated
in one row's array counts once; ties at rank k go to the lesser item; an empty
input gives an empty result; further columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Spark limits per partition before the shuffle up to this rank
#: (spark.sql.optimizer.windowGroupLimitThreshold).
MAX_K = 1000


def items_of(arrays: dict[str, str]) -> Column:
    """One (field, item) struct per distinct non-null element of each array column."""
    none = F.array().cast("array<struct<field:string,item:bigint>>")

    def one(field: str, column: str) -> Column:
        distinct = F.array_distinct(F.filter(column, lambda x: x.isNotNull()))
        return F.coalesce(
            F.transform(distinct, lambda x: F.struct(F.lit(field).alias("field"), x.cast("bigint").alias("item"))), none
        )

    return F.concat(*[one(f, c) for f, c in arrays.items()])


def most_items(table: DataFrame, arrays: list[str]) -> int:
    """The largest number of elements that one array of the table holds."""
    sizes = [F.coalesce(F.size(c), F.lit(0)) for c in arrays]
    return max(table.agg(F.max(F.greatest(*sizes) if len(sizes) > 1 else sizes[0])).first()[0] or 0, 1)


def _counts(rows: DataFrame, group: list[str], item: str) -> DataFrame:
    return rows.filter(F.col(item).isNotNull()).groupBy(*group, item).agg(F.count(F.lit(1)).alias("n"))


def top_k(rows: DataFrame, group: list[str], item: str, k: int) -> DataFrame:
    """(group, item, n, rank) of the k most frequent items of each group."""
    if not 0 < k <= MAX_K:
        raise ValueError(f"k must be in 1..{MAX_K}")
    best = Window.partitionBy(*group).orderBy(F.col("n").desc(), F.col(item))
    return _counts(rows, group, item).withColumn("rank", F.row_number().over(best)).filter(F.col("rank") <= k)


def heavy(rows: DataFrame, totals: DataFrame, group: list[str], item: str, share: float, per_row: int) -> DataFrame:
    """Items in at least ``share`` of their group's rows, with ``total``.

    ``totals`` has (group, total).  If a row holds at most ``per_row`` items (see
    ``most_items``), no more than per_row/share items can reach the share, so that
    many are the top k looked at and none is lost.  Where those are more than
    ``MAX_K``, all counts are held against the share.
    """
    k = int(-(-per_row // share))
    best = top_k(rows, group, item, k) if k <= MAX_K else _counts(rows, group, item)
    return best.join(totals, group).filter(F.col("n") >= share * F.col("total"))
