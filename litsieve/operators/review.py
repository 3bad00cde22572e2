"""Reviewers' decisions brought back into the record table."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from litsieve.functions import text as T
from litsieve.schema import COLUMNS


def apply_decisions(records: DataFrame, possible: DataFrame, removed: DataFrame, prior_removed: DataFrame, missing: DataFrame) -> tuple[DataFrame, DataFrame, dict]:
    """(records, audit rows, counts) after the marks in the four review tables took effect, in this order.

    Merged candidates of ``possible`` (decision, drop_if_merged_id) leave; rows of ``removed`` and then
    ``prior_removed`` (restore, ord and the record columns) marked for it come back unless their id is
    there; abstracts typed into ``missing`` (record_id, abstract) fill those that have none.

    Null and blank marks count as none, null ids name nothing.  A candidate that is marked twice is merged once; of rows
    that bring one id back the first counts; of two abstracts typed for one id the greater.  Counts are tables of one
    row, n, that nothing computes before they are asked for.
    """
    decided = possible.where("drop_if_merged_id is not null and drop_if_merged_id <> ''")
    merge = T.is_marked(F.col("decision"), T.MERGE)
    keep = T.is_marked(F.col("decision"), T.KEEP)
    drop = decided.where(merge).select(F.col("drop_if_merged_id").alias("record_id"), "keep_id", "keep_title", "similarity").dropDuplicates(["record_id"])
    gone = records.join(drop, "record_id")
    audit = gone.select(F.lit("").alias("restore"), F.lit("possible_duplicate_merged_by_human").alias("match_type"), F.col("keep_id").alias("duplicate_of"), F.col("keep_title").alias("kept_title"), "similarity", *COLUMNS)
    left = records.join(drop.select("record_id"), "record_id", "left_anti").select(F.lit(0).alias("rank"), "ord", *COLUMNS)

    def marked(rows: DataFrame, rank: int) -> DataFrame:
        return rows.where(T.is_marked(F.col("restore"), T.RESTORE) & (F.coalesce("record_id", F.lit("")) != "")).select(F.lit(rank).alias("rank"), "ord", *COLUMNS)

    back = marked(removed, 1).unionByName(marked(prior_removed, 2))
    first = back.groupBy("record_id").agg(F.min_by(F.struct("rank", "ord", *[c for c in COLUMNS if c != "record_id"]), F.struct("rank", "ord")).alias("r"))
    restored = first.select("record_id", "r.*").join(left.select("record_id"), "record_id", "left_anti")
    all_ = left.unionByName(restored.select("rank", "ord", *COLUMNS))
    typed = missing.select("record_id", T.clean_text(F.col("abstract")).alias("typed")).where("typed <> ''").groupBy("record_id").agg(F.max("typed").alias("typed"))
    all_ = all_.join(typed, "record_id", "left")
    fill = F.col("typed").isNotNull() & (F.coalesce("abstract", F.lit("")) == "")
    done = all_.select(
        "rank",
        "ord",
        *(F.when(fill, F.col("typed")).otherwise(F.col(c)).alias(c) if c == "abstract" else F.when(fill, F.lit("manual")).otherwise(F.col(c)).alias(c) if c == "abstract_source" else F.col(c) for c in COLUMNS),
    )
    counts = {
        "possible_duplicates_merged": gone.select(F.count("*").alias("n")),
        "undecided": decided.where(~merge & ~keep).select(F.count("*").alias("n")),
        "restored_from_dedup": restored.where("rank = 1").select(F.count("*").alias("n")),
        "restored_from_prior": restored.where("rank = 2").select(F.count("*").alias("n")),
        "manual_abstracts": all_.where(fill).select(F.count("*").alias("n")),
    }
    return done, audit, counts
