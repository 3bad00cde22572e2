"""Counts of the flow of records, as tables and as the text report."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def per_source(records: DataFrame) -> DataFrame:
    """source_db and n; a null source is one of its own, repeated rows count each."""
    return records.groupBy("source_db").agg(F.count("*").alias("n"))


def roll_up(records: DataFrame) -> DataFrame:
    """Counts by database: the letters that a source name starts with."""
    return records.groupBy(F.regexp_extract("source_db", "^[a-z]+", 0).alias("database")).agg(F.count("*").alias("n"))


def reasons(results: DataFrame) -> DataFrame:
    """reason, n, first (ord of its first row) of the exclusions that give one; order by n desc, first."""
    said = results.where("eligible = 'F' and reason_for_exclusion <> ''")
    return said.groupBy(F.col("reason_for_exclusion").alias("reason")).agg(F.count("*").alias("n"), F.min("ord").alias("first"))


def consolidate(records: DataFrame) -> DataFrame:
    """The flow of several runs and of all together: strand (null: all), identified, within_run, across_runs, unique, excluded,
    eligible, held.

    ``records`` are strand, rank (the runs' order), ord, doi, eligible, flag.  Records of one DOI are one paper: it counts
    for the earliest run that has it, by that run's first record; later ones of the run are duplicates within it, those of other
    runs across.  A record without a DOI is a paper of its own.  Flagged papers are held, whatever their verdict; null strands are no run.
    """
    known = records.where("strand is not null").withColumn("paper", F.when(F.col("doi").isNotNull(), F.struct(F.col("doi"), F.lit(None).cast("long").alias("rank"), F.lit(None).cast("long").alias("ord"))).otherwise(F.struct(F.lit(None).cast("string").alias("doi"), F.col("rank").cast("long").alias("rank"), F.col("ord").cast("long").alias("ord"))))
    runs = known.groupBy("paper", "strand", "rank").agg(F.count("*").alias("copies"), F.min_by(F.struct("eligible", "flag"), "ord").alias("first"))
    papers = runs.groupBy("paper").agg(F.min("rank").alias("rank"), F.lit(True).alias("kept"))
    # each run of a paper meets the paper's earliest by a key that no two rows share
    tied = runs.join(papers, (runs["paper"] == papers["paper"]) & (runs["rank"] == papers["rank"]), "left").select(runs["strand"], "copies", "first", F.coalesce("kept", F.lit(False)).alias("kept"))
    flagged = F.coalesce(F.col("first.flag"), F.lit("")) != ""
    counts = [
        F.sum("copies").alias("identified"),
        F.sum(F.col("copies") - 1).alias("within_run"),
        F.count_if(~F.col("kept")).alias("across_runs"),
        F.count_if("kept").alias("unique"),
        F.count_if(F.col("kept") & ~flagged & (F.col("first.eligible") == "F")).alias("excluded"),
        F.count_if(F.col("kept") & ~flagged & (F.col("first.eligible") == "T")).alias("eligible"),
        F.count_if(F.col("kept") & flagged).alias("held"),
    ]
    return tied.groupingSets([["strand"], []], "strand").agg(*counts)


def screened() -> list[Column]:
    """The counts of result rows behind the report, as aggregates to take while they are written; exclusions include flagged and audited ones."""
    flagged = F.col("needs_human_review") != ""
    split = F.startswith("needs_human_review", F.lit("samples not consistent"))
    t = F.col("eligible") == "T"
    split_n, tentative = F.count_if(split), F.count_if(t & flagged)
    return [
        F.count_if(F.col("eligible") == "F").alias("excluded"),
        F.count_if(t & ~flagged).alias("eligible"),
        tentative.alias("tentative"),
        split_n.alias("inconsistent"),
        F.count_if(flagged).alias("flagged_for_review"),
        F.count_if(F.col("total_samples") > 0).alias("screened"),
        F.count_if(F.col("total_samples") == 0).alias("not_screened"),
        F.count_if(F.col("needs_human_review") == "random audit of exclusions").alias("audited"),
        (split_n - tentative).alias("leaning_exclude"),
    ]


def report(counts: dict, sources: list[tuple[str, int]], histogram: list[tuple[str, int]]) -> str:
    """The text report, part by part; counts that are not known show as a question mark."""
    earlier = [("Screened before", "prior_screened_removed"), ("  of records of earlier runs", "prior_screened_list")]
    parts = [
        ("Identification", [*((f"  {name}", n) for name, n in sorted(sources)), ("Identified", "identified_total")]),
        ("Deduplication", [("Duplicates removed", "duplicates_removed"), ("Possible duplicates merged by people", "possible_duplicates_merged"), *(earlier if counts.get("prior_screened_removed") else [])]),
        ("Review", [("Restored duplicates", "restored_from_dedup"), ("Restored from earlier runs", "restored_from_prior"), ("Abstracts typed in", "manual_abstracts")]),
        ("Records", [("Unique", "unique_after_dedup"), ("Abstracts looked up", "abstracts_backfilled"), ("Without abstract", "missing_abstract")]),
        ("Screening", [("Model", "model"), ("Samples a record", "samples"), ("Screened", "screened"), ("Not screened", "not_screened"), ("Eligible", "eligible"), ("Excluded", "excluded"), *((f"  {reason}", n) for reason, n in histogram)]),
        ("For people", [("For review", "flagged_for_review"), ("  leaning to include", "tentative"), ("  leaning to exclude", "leaning_exclude"), ("  audited exclusions", "audited")]),
    ]
    lines = ["RECORD FLOW"]
    for heading, rows in parts:
        lines += ["", heading.upper(), *(f"{name}: {counts.get(n, '?') if isinstance(n, str) else n}" for name, n in rows)]
    lines += ["", "The share of audited exclusions that people overturn estimates how many exclusions are wrong."]
    return "\n".join(lines) + "\n"


def agreement_report(told: dict) -> str:
    """Verdicts against labels in words."""
    of = lambda a, b: f"{told[a]} of {told[a] + told[b]}"
    lines = [
        f"Labelled: {sum(told[k] for k in ('tp', 'fp', 'tn', 'fn', 'no_verdict'))}, without verdict: {told['no_verdict']}",
        f"Recall: {told['recall']:.3f} ({of('tp', 'fn')})",
        f"Specificity: {told['specificity']:.3f} ({of('tn', 'fp')})",
        f"Wrongly excluded: {told['fn']} (false_excludes.csv), wrongly included: {told['fp']} (false_includes.csv)",
    ]
    if "kappa" in told:
        lines.append(f"Two raters: {told['n']} records, agreement {told['agreement']:.3f}, kappa {told['kappa']:.3f}")
    return "\n".join(lines) + "\n"
