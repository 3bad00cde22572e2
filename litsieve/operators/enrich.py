"""Abstracts that exports lack, filled from lookup tables by DOI."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from litsieve.functions import text as T
from litsieve.schema import COLUMNS


def backfill(records: DataFrame, cache: DataFrame, lookups: list[tuple[str, DataFrame]]) -> tuple[DataFrame, DataFrame]:
    """(records, cache) with abstracts filled in.

    Looked up are records without an abstract and those whose exported one is a cut preview, if they
    have a DOI.  ``cache`` (doi, text, source, status) goes first: a text counts, and so does a known
    miss (status ``absent``), though not for previews; rows of status ``failed`` are asked again.  Then
    each of ``lookups`` (source name and a table doi, text) in turn.  A preview that finds nothing loses
    its abstract.  The new cache holds what was asked, misses included.

    Null and empty texts of a lookup are no finds; of several texts for one DOI the least counts, in the cache the
    greatest.  Records that repeat are filled alike; those without a DOI are never looked up.
    """
    has = F.col("abstract").isNotNull() & (F.col("abstract") != "")
    preview = F.coalesce(T.is_preview(F.col("source_db"), F.col("abstract"), F.col("abstract_source")), F.lit(False))
    marked = records.withColumn("__preview", preview).withColumn("__target", ~F.coalesce(has, F.lit(False)) | preview)
    told = cache.where("status is null or status <> 'failed'").groupBy("doi").agg(F.max(F.struct(F.col("text").isNotNull().alias("any"), "text", "source")).alias("__c"))
    wanted = marked.where("__target and doi is not null").groupBy("doi").agg(F.bool_and("__preview").alias("__only_previews"), F.bool_or("__preview").alias("__some"))
    open_ = wanted.join(told, "doi", "left").where(F.col("__c").isNull() | (~F.col("__c.any") & F.col("__some")))
    answers = open_.select("doi")
    for i, (_, table) in enumerate(lookups):
        found = table.where("text is not null and text <> ''").groupBy("doi").agg(F.min("text").alias(f"__t{i}"))
        answers = answers.join(found, "doi", "left")
    texts = [F.col(f"__t{i}") for i in range(len(lookups))]
    source = F.coalesce(*(F.when(t.isNotNull(), F.lit(name)) for t, (name, _) in zip(texts, lookups, strict=True)), F.lit(None).cast("string"))
    answers = answers.select("doi", F.coalesce(*texts, F.lit(None).cast("string")).alias("text"), source.alias("source"))
    fresh = answers.withColumn("status", F.when(F.col("text").isNull(), "absent").otherwise("found"))
    grown = cache.join(fresh.select("doi"), "doi", "left_anti").select("doi", "text", "source", "status").unionByName(fresh)
    usable = grown.where("text is not null and (status is null or status <> 'failed')").groupBy("doi").agg(F.max(F.struct("text", "source")).alias("__f"))
    out = marked.join(usable, "doi", "left")
    text, filled = F.col("__f.text"), F.col("__target") & F.col("__f").isNotNull()
    lost = F.col("__preview") & F.col("__f").isNull()
    return (
        out.withColumn("__abstract", F.when(filled, text).when(lost, F.lit(None).cast("string")).otherwise(F.col("abstract")))
        .withColumn("__source", F.when(filled, F.col("__f.source")).when(lost, F.lit("")).otherwise(F.col("abstract_source")))
        .withColumns({"abstract": F.col("__abstract"), "abstract_source": F.col("__source")})
        .select(*[c for c in ("ord",) if c in records.columns], *COLUMNS),
        grown,
    )
