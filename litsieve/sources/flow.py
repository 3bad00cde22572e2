"""The table behind a flow diagram: a template, filled with the counts of a run.

A template names a quantity in ``data`` and holds its number in ``n``; the drawing program reads both.  All cells are text,
``NA`` included, and a cell may hold line ends.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from litsieve.sources.tables import read_csv, write_csv

#: Columns of a template, and the ledger's counts that its quantities are the sums of (fixed values).
COLUMNS = ["data", "node", "box", "description", "boxtext", "tooltips", "url", "n"]
COUNTS = {
    "database_results": ["identified_total"],
    "duplicates": ["duplicates_removed", "prior_screened_removed", "possible_duplicates_merged"],
    "records_screened": ["screened"],
    "records_excluded": ["excluded"],
    "dbr_sought_reports": ["eligible", "flagged_for_review"],
}
BY_SOURCE, REASONS = "database_specific_results", "records_excluded"


def read_template(spark: SparkSession, path: str) -> DataFrame:
    """The template's rows with ord, their order."""
    return read_csv(spark, path)


def write_flow(flow: DataFrame, path: str) -> int:
    return write_csv(flow, path, COLUMNS)


def fill(template: DataFrame, counts: dict, sources: DataFrame, reasons: DataFrame) -> DataFrame:
    """``template`` with what the run tells: ``counts`` (the ledger), ``sources`` (name, n), ``reasons`` (reason, n, first).

    Quantities of which no count is known, and rows without a name, stay as they are.  A quantity that is there
    twice is filled twice.  Reasons are listed below the box's text, the most frequent first.
    """
    spark = template.sparkSession
    known = [(name, str(sum(counts[k] for k in keys if k in counts))) for name, keys in COUNTS.items() if any(k in counts for k in keys)]
    numbers = spark.createDataFrame(known, "data string, told string")
    # databases and reasons are few: the lists are one cell each
    joined = lambda rows, line, order, between: F.array_join(F.transform(F.array_sort(F.collect_list(F.struct(*order, line.alias("line")))), lambda x: x["line"]), between)
    by_source = sources.agg(joined(sources, F.concat("name", F.lit(", "), F.col("n").cast("string")), [F.col("name").alias("name_")], "; ").alias("told")).select(F.lit(BY_SOURCE).alias("data"), "told")
    below = reasons.agg(joined(reasons, F.concat("reason", F.lit(" (n = "), F.format_number("n", 0), F.lit(")")), [(-F.col("n")).alias("less"), "first"], "\n").alias("listed")).select(F.lit(REASONS).alias("data"), "listed")
    filled = template.join(F.broadcast(numbers.unionByName(by_source.where("told <> ''"))), "data", "left").join(F.broadcast(below.where("listed <> ''")), "data", "left")
    heading: Column = F.substring_index("boxtext", "\n", 1)
    text = F.when(F.col("listed").isNull(), F.col("boxtext")).otherwise(F.concat(F.regexp_replace(heading, ":$", ""), F.lit(":\n"), "listed"))
    cells = {"n": F.coalesce("told", "n"), "boxtext": text}
    return filled.select("ord", *(cells.get(c, F.col(c)).alias(c) for c in COLUMNS))
