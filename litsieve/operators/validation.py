"""Verdicts against labels, and labels against labels."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from litsieve.functions import text as T
from litsieve.operators import screening
from litsieve.operators.dedup import earliest
from litsieve.schema import COLUMNS, from_cells

#: Columns of a validated record (file order).
RESULT = "record_id human_label eligible outcome reason_for_exclusion confidence agreement votes_include votes_exclude valid_samples total_samples needs_human_review rationale title".split()


def usable_labels(rows: DataFrame, last: bool = False) -> DataFrame:
    """record_id, human_label of ``rows`` (record_id, human_label, ord): T or F only, one per id, the first (or last).

    Rows with a null or empty id or another label, null included, are left out.
    """
    good = _usable(rows)
    if last:
        good = good.withColumn("ord", -F.col("ord"))
    return earliest(good, ["record_id"], "ord").select("record_id", "human_label")


def _usable(rows: DataFrame) -> DataFrame:
    trimmed = {"record_id": F.trim("record_id"), "human_label": F.upper(F.trim("human_label"))}
    return rows.withColumns(trimmed).where("human_label in ('T', 'F') and record_id <> ''")


def labelled_records(rows: DataFrame) -> DataFrame:
    """Records to screen, with ord and human_label, of hand-labelled ``rows``: the usable ones, the first of an id.

    Columns other than record_id, human_label and ord may be missing.  A record without an abstract is one
    with a title alone; it is screened like the others.
    """
    first = earliest(_usable(rows), ["record_id"], "ord")
    records = from_cells(first.select(*(c for c in first.columns if c in ("ord", "record_id", "title", "abstract", "authors", "year", "doi"))))
    text = lambda c: T.clean_text(F.col(c))
    abstract = F.nullif(text("abstract"), F.lit(""))
    year = T.clean_year(F.col("__year")) if "year" in first.columns else F.lit(None).cast("int")
    cleaned = {"title": text("title"), "authors": text("authors"), "abstract": abstract, "source_db": F.lit("validate")}
    raw = first.select("record_id", "human_label", *([F.col("year").alias("__year")] if "year" in first.columns else []))
    records = records.join(raw, "record_id").withColumns(cleaned | {"year": year})
    return records.withColumn("abstract_source", F.when(F.col("abstract").isNull(), "").otherwise("manual")).select("ord", "human_label", *COLUMNS)


def validated(labelled: DataFrame, votes: DataFrame, policy: str = "review") -> DataFrame:
    """``RESULT`` and ord: every labelled record (record_id, human_label, title, ord) beside its vote; without one, no verdict."""
    rows = labelled.select("ord", "record_id", "human_label", "title").join(votes, "record_id", "left")
    blank = {c: F.coalesce(c, F.lit("")) for c in ("eligible", "reason", "confidence", "rationale")} | {c: F.coalesce(c, F.lit(0)) for c in ("votes_include", "votes_exclude", "valid_samples", "total_samples")}
    flag = F.coalesce(F.when(F.col("consistent").isNull(), "not answered").otherwise(screening.review_flag(policy)), F.lit(""))
    rows = rows.withColumn("needs_human_review", flag).withColumns(blank).withColumn("agreement", F.coalesce("agreement", F.lit(0.0)))
    return rows.withColumns({"outcome": outcome(F.col("human_label"), F.col("eligible")), "reason_for_exclusion": F.col("reason")}).select("ord", *RESULT)


def outcome(human: F.Column, model: F.Column) -> F.Column:
    """A verdict against a label in words; a null or blank verdict is none."""
    return (
        F.when(~F.coalesce(model, F.lit("")).isin("T", "F"), "no verdict")
        .when((human == "T") & (model == "T"), "true include")
        .when((human == "F") & (model == "F"), "true exclude")
        .when(human == "T", "FALSE EXCLUDE")
        .otherwise("FALSE INCLUDE")
    )


def confusion(judged: DataFrame) -> DataFrame:
    """One row: tp, fp, tn, fn, no_verdict, recall, specificity (NaN where undefined) of (human_label, eligible)."""
    told = judged.withColumn("__o", outcome(F.col("human_label"), F.col("eligible")))
    n = lambda what: F.count_if(F.col("__o") == what)
    counts = told.agg(n("true include").alias("tp"), n("FALSE INCLUDE").alias("fp"), n("true exclude").alias("tn"), n("FALSE EXCLUDE").alias("fn"), n("no verdict").alias("no_verdict"))
    share = lambda a, b: F.coalesce(F.try_divide(F.col(a), F.col(a) + F.col(b)), F.lit(float("nan")))
    return counts.withColumns({"recall": share("tp", "fn"), "specificity": share("tn", "fp")})


def kappa(first: DataFrame, second: DataFrame) -> DataFrame:
    """One row: n, agreement and Cohen's kappa of two label tables (record_id, human_label); NaN where undefined."""
    both = first.select("record_id", F.col("human_label").alias("a")).join(second.select("record_id", F.col("human_label").alias("b")), "record_id")
    cells = both.groupBy("a", "b").count()
    sides = cells.select(F.col("a").alias("label"), F.col("count").alias("x"), F.lit(0).alias("y")).unionByName(cells.select(F.col("b").alias("label"), F.lit(0).cast("long").alias("x"), F.col("count").alias("y")))
    by_label = sides.groupBy("label").agg(F.sum("x").alias("x"), F.sum("y").alias("y"))
    chance = by_label.agg(F.sum(F.col("x").cast("double") * F.col("y")).alias("products"), F.sum("x").alias("n"))
    same = cells.agg(F.coalesce(F.sum(F.when(F.col("a") == F.col("b"), F.col("count"))), F.lit(0)).alias("same"), F.sum("count").alias("n"))
    row = same.join(chance.withColumnRenamed("n", "n2"), F.col("n") == F.col("n2"), "left")
    po, pe = F.try_divide(F.col("same"), F.col("n")), F.try_divide(F.col("products"), F.col("n").cast("double") * F.col("n"))
    nan = F.lit(float("nan"))
    return row.select(
        F.coalesce("n", F.lit(0)).alias("n"),
        F.coalesce(po, nan).alias("agreement"),
        F.coalesce(F.when(pe < 1, (po - pe) / (1 - pe)), nan).alias("kappa"),
    )
