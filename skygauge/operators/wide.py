"""Tables wider than a schema should be: columns as positions of an array, named by a dictionary."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from skygauge.operators.ordering import attach_row, with_ordinal
from skygauge.session import land


def column_dictionary(df: DataFrame, col: str) -> DataFrame:
    """``name, position`` (from 0) of every value of ``col``, in order; null is not a column."""
    return land(with_ordinal(df.filter(F.col(col).isNotNull()).select(F.col(col).alias("name")).distinct(), ["name"], "position"), "dictionary")


def pivot_positions(df: DataFrame, row: str, col: str, value: Column, names: DataFrame) -> DataFrame:
    """``row, cells``: the value of each column at its position, null where the row has none.

    ``value`` is an aggregate. The width comes from the dictionary and not from a list of columns, so a table of any
    width has the same schema and plan; a cell is aggregated before a row is put together.
    """
    cells = df.groupBy(row, F.col(col).alias("name")).agg(value.alias("_v")).join(names, "name").withColumn("position", F.col("position").cast("int"))
    found = cells.groupBy(row).agg(F.map_from_entries(F.collect_list(F.struct("position", "_v"))).alias("_m"))
    sized = attach_row(found, names.agg((F.count(F.lit(1)) - 1).cast("int").alias("_last")))
    return sized.select(row, F.transform(F.sequence(F.lit(0), "_last"), lambda i: F.try_element_at(F.col("_m"), i)).alias("cells"))


def unpivot_positions(wide: DataFrame, row: str, names: DataFrame, out: str = "value") -> DataFrame:
    """The long form again: ``row, name, value``, nulls left out."""
    long = wide.select(row, F.posexplode("cells").alias("position", out)).filter(F.col(out).isNotNull())
    return long.join(names, "position").select(row, "name", out)
