"""Places in an order, without bringing all rows to one task."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

#: Values of the ordering number that one stretch spans.
STRETCH = 1 << 16


def positions(rows: DataFrame, ord: str, name: str, keys: tuple[str, ...] = ()) -> DataFrame:
    """Add ``name``: 0, 1, ... in the order of the whole number ``ord`` within ``keys``.

    Rows are numbered within stretches of ``ord``; only the stretches' row counts meet in one place.
    """
    stretch = F.floor(F.col(ord) / STRETCH).alias("__stretch")
    rows = rows.withColumn("__stretch", stretch)
    sizes = rows.groupBy(*keys, "__stretch").agg(F.count("*").alias("__n"))
    earlier = Window.partitionBy(*keys or [F.lit(0)]).orderBy("__stretch").rowsBetween(Window.unboundedPreceding, -1)
    sizes = sizes.withColumn("__before", F.coalesce(F.sum("__n").over(earlier), F.lit(0))).drop("__n")
    within = Window.partitionBy(*keys, "__stretch").orderBy(ord)
    rows = rows.withColumn("__place", F.row_number().over(within) - 1)
    return rows.join(sizes, [*keys, "__stretch"]).withColumn(name, F.col("__place") + F.col("__before")).drop("__stretch", "__place", "__before")


def first_by(value: str | Column, ord: Column, where: Column | None = None) -> Column:
    """Aggregate: the value of the earliest row, of those where the condition holds."""
    value = F.col(value) if isinstance(value, str) else value
    return F.min_by(value, ord if where is None else F.when(where, ord))
