"""Normalising column functions.  White space is what Python's ``str`` methods take it to be."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

SPACE = r"(?U)[\s\x1c-\x1f]"
#: Spellings by which a reviewer marks a row (fixed values, compared lower-cased and stripped).
RESTORE = ["x", "y", "yes", "true", "1", "restore"]
MERGE = ["merge", "redundant", "duplicate", "dup", "drop", "same", "yes", "y", "1"]
KEEP = ["keep", "separate", "distinct", "different", "no", "n", "0"]


def strip(text: Column) -> Column:
    return F.regexp_replace(text, rf"^{SPACE}+|{SPACE}+$".replace("|(?U)", "|"), "")


def clean_text(text: Column) -> Column:
    """Runs of white space as one space, none at the ends; null as empty."""
    return F.trim(F.regexp_replace(F.coalesce(text, F.lit("")), f"{SPACE}+", " "))


def normalize_doi(text: Column) -> Column:
    """Lower case, without one resolver or ``doi:`` prefix, first word only; blank as null."""
    bare = F.regexp_replace(strip(text), r"(?i)^(https?://(dx\.)?doi\.org/|doi:(?U:[\s\x1c-\x1f])*)", "")
    return F.nullif(F.split(F.lower(strip(bare)), f"{SPACE}+")[0], F.lit(""))


def normalize_title(text: Column) -> Column:
    """ASCII letters and digits of the lower-cased text, words one space apart."""
    return F.trim(F.regexp_replace(F.lower(F.coalesce(text, F.lit(""))), "[^a-z0-9]+", " "))


def first_author(authors: Column) -> Column:
    """Surname of the first author as ASCII letters: what precedes a comma, else the last word."""
    one = F.split(strip(F.coalesce(authors, F.lit(""))), r"(?U)[\s\x1c-\x1f]*;[\s\x1c-\x1f]*|[\s\x1c-\x1f]+and[\s\x1c-\x1f]+")[0]
    last = F.element_at(F.split(strip(one), f"{SPACE}+"), -1)
    name = F.when(F.contains(one, F.lit(",")), F.split(one, ",")[0]).otherwise(last)
    return F.regexp_replace(F.lower(name), "[^a-z]", "")


def clean_year(text: Column) -> Column:
    """The first year of the 20th or 21st century in a text."""
    return F.regexp_extract(F.coalesce(text.cast("string"), F.lit("")), r"(19|20)[0-9]{2}", 0).try_cast("int")


def strip_markup(text: Column) -> Column:
    """Text without tags, cleaned."""
    return clean_text(F.regexp_replace(text, "<[^>]+>", " "))


def word_index(rows: DataFrame, words: str, name: str) -> DataFrame:
    """Add ``name``, the map from each word of the array ``words`` to its positions; null words are not allowed.

    Words are sorted with their positions; a word's run begins where the one before differs and ends where the next begins.
    """
    placed = F.array_sort(F.transform(words, lambda w, i: F.struct(w.alias("w"), i.alias("p"))))
    at = lambda i: F.get(F.col("__placed"), i)["w"]
    starts = F.filter(F.sequence(F.lit(0), F.size("__placed") - 1), lambda i: (i == 0) | (at(i) != at(i - 1)))
    run = lambda s, j: F.slice("__placed", s + 1, F.coalesce(F.get(F.col("__starts"), j + 1), F.size("__placed")) - s)
    entry = lambda s, j: F.struct(at(s).alias("key"), F.transform(run(s, j), lambda x: x["p"]).alias("value"))
    out = rows.withColumn("__placed", placed).withColumn("__starts", F.when(F.size("__placed") > 0, starts).otherwise(F.array().cast("array<int>")))
    return out.withColumn(name, F.map_from_entries(F.transform("__starts", entry))).drop("__placed", "__starts")


def rebuild_index(index: Column) -> Column:
    """The text of a map from word to positions: words by position, then by word."""
    entries = F.transform(F.map_entries(index), lambda e: F.transform(e["value"], lambda p: F.struct(p.alias("p"), e["key"].alias("w"))))
    return F.array_join(F.transform(F.array_sort(F.flatten(entries)), lambda x: x["w"]), " ")


def is_preview(source_db: Column, abstract: Column, abstract_source: Column) -> Column:
    """An exported abstract that one publisher's export cuts short with dots."""
    from_publisher = F.exists(F.split(source_db, ","), lambda s: F.lower(F.trim(s)).startswith("sage"))
    cut = F.coalesce(abstract, F.lit("")).rlike("(\\.{3}|…)" + SPACE + "*$")
    return (abstract_source == "export") & from_publisher & cut


def is_marked(mark: Column, spellings: list[str]) -> Column:
    return F.lower(strip(F.coalesce(mark, F.lit("")))).isin(spellings)


def merge_sources(lists: Column) -> Column:
    """Comma-joined names of an array of such names, each once, in order."""
    names = F.flatten(F.transform(lists, lambda s: F.split(s, ",")))
    return F.array_join(F.array_sort(F.array_distinct(F.filter(F.transform(names, lambda s: F.trim(s)), lambda s: s != ""))), ",")


def user_content(authors: Column, year: Column, title: Column, abstract: Column) -> Column:
    """The four labelled lines that a model is shown of a record."""
    line = lambda label, value: F.concat(F.lit(f"{label}: "), F.coalesce(F.nullif(value, F.lit("")), F.lit("N/A")))
    return F.concat_ws("\n", line("Author", authors), line("Year", year.cast("string")), line("Title", title), line("Abstract", abstract))
