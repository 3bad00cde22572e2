"""Records screened in earlier runs: matched by DOI, else by the most similar title, and taken out."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from litsieve.functions import similarity as S
from litsieve.functions import text as T
from litsieve.operators.components import cut
from litsieve.operators.dedup import AUTHOR, THRESHOLD, YEARS, similar_pairs
from litsieve.schema import COLUMNS

#: Names that a column of a prior list may have; the first that is there and not blank counts (fixed values).
NAMES = {
    "record_id": ["record_id", "id"],
    "doi": ["doi", "DOI"],
    "title": ["title", "Title"],
    "year": ["year", "Year"],
    "authors": ["authors", "Authors", "author"],
    "decision": ["eligible", "decision"],
}
CONTEXT = ["match_type", "prior_record_id", "prior_title", "prior_decision", "similarity"]


def prior_list(rows: DataFrame) -> DataFrame:
    """A prior list of any of the usual column names (ord: its order), normalised."""

    def pick(names: list[str]):
        cells = [F.nullif(F.trim(F.col(n).cast("string")), F.lit("")) for n in names if n in rows.columns]
        return F.coalesce(*cells, F.lit("")) if cells else F.lit("")

    raw = {k: pick(v) for k, v in NAMES.items()}
    return rows.select(
        "ord",
        raw["record_id"].alias("prior_record_id"),
        T.normalize_doi(raw["doi"]).alias("doi"),
        T.clean_text(raw["title"]).alias("prior_title"),
        T.clean_year(raw["year"]).alias("year"),
        T.first_author(raw["authors"]).alias("first_author"),
        raw["decision"].alias("prior_decision"),
    )


def remove_prior(records: DataFrame, prior: DataFrame, threshold: float = THRESHOLD, years: int = YEARS, author: float = AUTHOR) -> tuple[DataFrame, DataFrame]:
    """(remaining, removed) of ``records`` (record columns and ord) against ``prior`` (see ``prior_list``).

    A DOI match goes first, to the earliest prior row.  Any other record, with or without a DOI, is held
    against all prior titles of a compatible year; the best score at or above ``threshold`` (earliest on
    ties) takes it out, unless both first authors are known and differ.

    Null titles count as empty ones, and an empty earlier title matches nothing; null years fit any.  Records that
    repeat are judged alike, each by itself; of earlier rows that repeat the first by ord is told.
    """
    by_doi = prior.where("doi is not null").groupBy("doi").agg(F.min_by(F.struct("prior_record_id", "prior_title", "prior_decision"), "ord").alias("p"))
    context = lambda kind, score: [F.lit(kind).alias("match_type"), *(F.col(f"p.{c}") for c in CONTEXT[1:4]), score.alias("similarity")]
    exact = records.join(by_doi, "doi").select("ord", *context("doi_exact", F.lit(100.0)), *COLUMNS)
    rest = records.join(exact.select("ord"), "ord", "left_anti")
    # titles of a year are compared once, however many records or prior rows have them; of the prior rows the first counts
    key, y = S.sorted_tokens(T.normalize_title(F.col("title"))), F.coalesce("year", F.lit(-1))
    asked = rest.select("ord", key.alias("key"), "year", y.alias("y"), F.col("first_author").alias("l_author"))
    titled = prior.withColumn("title", F.col("prior_title")).select("ord", key.alias("key"), "year", y.alias("y"), F.struct("prior_record_id", "prior_title", "prior_decision").alias("p"), F.col("first_author").alias("r_author")).where("key <> ''")
    first = cut(titled.groupBy("key", "y").agg(F.min_by(F.struct("p", "r_author", "ord"), "ord").alias("r"), F.min("year").alias("year")))
    if not first.limit(1).count():  # no earlier title to be held against
        return rest.select("ord", *COLUMNS), exact
    # a title of a year goes by the first record that has it, on both sides
    titles = asked.groupBy("key", "y").agg(F.min("year").alias("year"), F.min("ord").alias("id"))
    left = titles.select(F.col("id").alias("l_id"), F.col("key").alias("l_title"), F.col("year").alias("l_year"))
    right = first.select(F.col("r.ord").alias("r_id"), F.col("key").alias("r_title"), F.col("year").alias("r_year"))
    pairs = similar_pairs(left, right, threshold, years)
    nearest = pairs.groupBy("l_id").agg(F.max_by(F.struct("r_id", "score"), F.struct("score", -F.col("r_id"))).alias("n"))
    named = nearest.join(titles, F.col("l_id") == F.col("id")).join(first.select("r", F.col("r.ord").alias("r_ord")), F.col("n.r_id") == F.col("r_ord"))
    best = asked.join(named.select("key", "y", F.struct("r", "n.score").alias("n")), ["key", "y"]).select(F.col("ord").alias("l_ord"), "l_author", F.struct(F.col("n.r.p").alias("p"), F.col("n.r.r_author").alias("r_author"), F.col("n.score").alias("score")).alias("b"))
    a, b = F.coalesce("l_author", F.lit("")), F.coalesce("b.r_author", F.lit(""))
    same = (a == "") | (b == "") | S.at_least(S.lcs_native(a, b), a, b, author)
    hits = best.where(same).select(F.col("l_ord").alias("ord"), F.col("b.p").alias("p"), F.col("b.score").alias("score"))
    fuzzy = rest.join(hits, "ord").select("ord", *context("fuzzy_title", F.bround("score", 1)), *COLUMNS)
    return rest.join(hits.select("ord"), "ord", "left_anti").select("ord", *COLUMNS), exact.unionByName(fuzzy)
