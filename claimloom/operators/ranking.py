"""Numbering rows inside groups, and keeping one row per key.

A group may hold a large part of the table, so nothing here sorts a whole group
in one task unless the caller says the groups are small by construction.
"""

from functools import reduce

from pyspark.sql import Column, DataFrame, Window, functions as F

from ..functions.text import col
from ..staging import staged

BLOCK_BITS = 20


def long_block(ord_col, bits: int = BLOCK_BITS) -> Column:
    """Block of a unique integer order column: at most 2**bits rows share one."""
    return F.shiftright(col(ord_col), bits)


def number_rows(df: DataFrame, keys, order, block: Column, name: str = "rn") -> DataFrame:
    """1-based ``row_number`` per ``keys`` in ``order``, without whole groups in one task.

    ``block`` must rise with ``order``.  Rows are numbered per (keys, block), which
    needs one shuffle of the data; the offsets come from the small table of block
    sizes and join back on the same (keys, block) partitioning.  Keys and block
    must not be null, and ``order`` must be unique inside a group.
    """
    order = [col(o) for o in (order if isinstance(order, (list, tuple)) else [order])]
    marked = df.withColumn("_block", block)
    inside = Window.partitionBy(*keys, "_block")
    numbered = marked.withColumn("_in", F.row_number().over(inside.orderBy(*order)))

    before = Window.partitionBy(*keys).orderBy("_block").rowsBetween(Window.unboundedPreceding, -1)
    sizes = marked.groupBy(*keys, "_block").agg(F.count("*").alias("_n"))
    offsets = sizes.select(
        *[F.col(k).alias(f"_k_{k}") for k in keys], F.col("_block").alias("_b"),
        F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_before"),
    )
    same = reduce(
        lambda a, b: a & b,
        [F.col(k) == F.col(f"_k_{k}") for k in keys] + [F.col("_block") == F.col("_b")],
    )
    drop = ["_block", "_b", "_in", "_before"] + [f"_k_{k}" for k in keys]
    return numbered.join(offsets, same).withColumn(name, F.col("_in") + F.col("_before")).drop(*drop)


def number_ordered(df: DataFrame, keys, order: str, name: str = "rn") -> DataFrame:
    """1-based ``row_number`` per ``keys`` in the order of a column of any kind, however its values begin.

    Rows are dealt into ranges of (keys, order) whose limits Spark samples, so a key with very many rows fills several
    ranges, and numbered there as they lie sorted. What comes before a key's part of a range is a prefix sum over the
    table of such parts, at most one row per key and range. One shuffle and one write of the data. ``order`` must be
    unique per key; keys must not be null.
    """
    n = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    place = [*keys, order]
    laid = df.repartitionByRange(n, *place).sortWithinPartitions(*place).withColumn("_id", F.monotonically_increasing_id())
    rows = staged(laid, "ordered").withColumn("_range", F.shiftright("_id", 33))
    parts = rows.groupBy(*keys, "_range").agg(F.min("_id").alias("_first"), F.count("*").alias("_n"))
    before = Window.partitionBy(*keys).orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)
    parts = parts.withColumn("_before", F.coalesce(F.sum("_n").over(before), F.lit(0))).drop("_n")
    numbered = rows.join(parts, [*keys, "_range"])
    return numbered.withColumn(name, F.col("_id") - F.col("_first") + F.col("_before") + 1).select(*df.columns, name)


def previous_value(df: DataFrame, keys, order, block: Column, column: str, name: str) -> DataFrame:
    """Value of ``column`` in the row before, per ``keys``; null on the first row.

    Inside a block it is a plain lag; the first row of a block takes the last value
    of the block before, which comes from the small table of block ends.
    """
    marked = df.withColumn("_block", block)
    inside = Window.partitionBy(*keys, "_block").orderBy(order)
    lagged = marked.withColumn("_prev", F.lag(column).over(inside)).withColumn("_nth", F.row_number().over(inside))
    ends = marked.groupBy(*keys, "_block").agg(F.max_by(column, order).alias("_end"))
    before = Window.partitionBy(*keys).orderBy("_block")
    carried = ends.select(
        *[F.col(k).alias(f"_k_{k}") for k in keys], F.col("_block").alias("_b"), F.lag("_end").over(before).alias("_carry")
    )
    same = reduce(
        lambda a, b: a & b, [F.col(k) == F.col(f"_k_{k}") for k in keys] + [F.col("_block") == F.col("_b")]
    )
    value = F.when(F.col("_nth") == 1, F.col("_carry")).otherwise(F.col("_prev"))
    drop = ["_block", "_b", "_prev", "_nth", "_carry"] + [f"_k_{k}" for k in keys]
    return lagged.join(carried, same).withColumn(name, value).drop(*drop)


def number_small_groups(df: DataFrame, keys, order, name: str = "rn") -> DataFrame:
    """1-based number inside groups bounded by one record (participants, roles)."""
    return df.withColumn(name, F.row_number().over(Window.partitionBy(*keys).orderBy(order)))


def first_n_per_group(df: DataFrame, keys, order, n: int) -> DataFrame:
    """First n rows per group; Spark cuts each group on the map side first."""
    ranked = df.withColumn("_rn", F.row_number().over(Window.partitionBy(*keys).orderBy(order)))
    return ranked.filter(F.col("_rn") <= n).drop("_rn")


LISTED = 100


def smallest_values(df: DataFrame, keys, value: str, k: int = LISTED) -> DataFrame:
    """Per key the number ``n`` of its rows and its ``k`` smallest ``values`` in order. ``value`` is distinct per key.

    A window, which spills, counts and ranks the rows; only k of them are ever gathered.
    """
    whole = Window.partitionBy(*keys)
    ranked = df.withColumn("n", F.count("*").over(whole)).withColumn("_rn", F.row_number().over(whole.orderBy(value)))
    return ranked.filter(F.col("_rn") <= k).groupBy(*keys).agg(F.first("n").alias("n"), F.array_sort(F.collect_list(value)).alias("values"))


def spread_key(value, *by) -> Column:
    """Join key for an outer join whose key is often null or ''.

    Such rows match nothing, but as one key they would all land in one task.  They get
    a key of their own instead, which no real value can equal.
    """
    value = col(value)
    own = F.concat(F.lit("\u0000"), F.xxhash64(*[col(b) for b in by]).cast("string"))
    return F.when(F.coalesce(value, F.lit("")) == "", own).otherwise(value)


def keep_last(df: DataFrame, keys, ord_col: str = "ord") -> DataFrame:
    """One row per key: the last value, at the position of the first.

    An aggregate, not a window: combined on the map side before the shuffle.
    """
    rest = [c for c in df.columns if c not in keys and c != ord_col]
    rows = df.groupBy(*keys).agg(
        F.max_by(F.struct(*rest), ord_col).alias("_row"), F.min(ord_col).alias(ord_col)
    )
    picked = rows.select(*keys, ord_col, *[F.col("_row")[c].alias(c) for c in rest])
    return picked.select(*df.columns)


def keep_first(df: DataFrame, keys, ord_col: str = "ord") -> DataFrame:
    rest = [c for c in df.columns if c not in keys]
    rows = df.groupBy(*keys).agg(F.min_by(F.struct(*rest), ord_col).alias("_row"))
    return rows.select(*keys, *[F.col("_row")[c].alias(c) for c in rest]).select(*df.columns)


def union_all(*tables: DataFrame) -> DataFrame:
    return reduce(lambda a, b: a.unionByName(b), tables)


def queue_positions(records: DataFrame) -> DataFrame:
    """0-based place of each record in its document's id order."""
    numbered = number_ordered(records, ["document_id"], "reaction_id", "_position")
    return numbered.withColumn("position", F.col("_position") - 1).drop("_position")
