"""Exports of literature databases as one record table.

Tagged files (RIS, MEDLINE) are read a record a row: Spark cuts them at what ends a record, so a large one is many byte
ranges on any file system, each read by a task of its own.  Files of other kinds are read whole.  Entries are
parsed where they lie and cleaned by column functions.
"""

from __future__ import annotations

import csv
import functools
import io
import os
import re
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from litsieve.functions import text as T
from litsieve.schema import COLUMNS
from litsieve.sources import formats

#: Tags that may hold a field, first one that is not blank first (fixed values).
RIS_TAGS = {"doi": ["DO"], "title": ["TI", "T1"], "year": ["PY", "Y1"], "abstract": ["AB", "N2"], "raw_id": ["ID", "AN"]}
BIBTEX_TAGS = {"doi": ["doi"], "title": ["title"], "authors": ["author"], "year": ["year"], "abstract": ["abstract"], "raw_id": ["ID"]}
#: Headers of CSV exports by field, compared without case (fixed values).
CSV_HEADERS = {
    "doi": ["DOI", "DI"],
    "title": ["Title", "Article Title", "TI", "Document Title"],
    "authors": ["Authors", "Author", "AU", "Author Full Names"],
    "year": ["Year", "Publication Year", "PY", "Date"],
    "abstract": ["Abstract", "AB"],
}
FIELDS = ["doi", "title", "authors", "year", "abstract", "raw_id"]
#: Fixed value: what ends a RIS record.
RIS_END = "ER  -"
KINDS = {".nbib": "medline", ".ris": "ris", ".txt": "ris", ".bib": "bibtex", ".csv": "csv", ".tsv": "tsv"}
RAW = "file string, idx long, doi string, title string, authors string, year string, abstract string, raw_id string"


def _pick(entry: formats.Entry, tags: list[str]) -> str:
    return next((v for t in tags for k, v in entry if k == t and v.strip()), "")


def _all(entry: formats.Entry, tag: str) -> list[str]:
    return [v for k, v in entry if k == tag and v.strip()]


def _tagged(entry: formats.Entry, kind: str) -> dict[str, str]:
    if kind == "medline":
        return {
            "doi": formats.medline_doi(entry),
            "title": " ".join(_all(entry, "TI")),
            "authors": "; ".join(_all(entry, "FAU") or _all(entry, "AU")),
            "year": _pick(entry, ["DP"]),
            "abstract": " ".join(_all(entry, "AB")),
            "raw_id": _pick(entry, ["PMID"]),
        }
    if kind == "ris":
        return {f: _pick(entry, tags) for f, tags in RIS_TAGS.items()} | {"authors": "; ".join(_all(entry, "AU") or _all(entry, "A1"))}
    return {f: _pick(entry, tags) for f, tags in BIBTEX_TAGS.items()}


def parse_file(name: str, content: bytes) -> list[dict[str, str]]:
    """The raw fields of each entry of one export that is read whole; a file of another kind has none."""
    kind = KINDS.get(os.path.splitext(name)[1].lower())
    if kind in ("csv", "tsv"):
        rows = csv.reader(io.StringIO(formats.decode(content, "mac_roman"), newline=""), delimiter="\t" if kind == "tsv" else ",")
        head = [h.strip().lower() for h in next(rows, [])]
        out = []
        for row in rows:
            if row:
                cells = list(zip(head, row, strict=False))
                out.append({f: _pick(cells, [n.lower() for n in names]) for f, names in CSV_HEADERS.items()} | {"raw_id": ""})
        return out
    if kind == "bibtex":
        return [_tagged(e, kind) for e in formats.bibtex(content.decode("utf-8", "replace"))]
    return []


def _parse(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for frame in frames:
        for path, content in zip(frame["path"], frame["content"], strict=True):
            name = os.path.basename(path)
            rows = parse_file(name, bytes(content))
            yield pd.DataFrame([{"file": name, "idx": i} | r for i, r in enumerate(rows)], columns=["file", "idx", *FIELDS])


def _parse_ranges(kind: str):
    """Entries of the records of byte ranges (file, block, content, in the order of the file), numbered within their range."""

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        here, n = None, 0
        for frame in frames:
            out = []
            for file, block, content in zip(frame["file"], frame["block"], frame["content"], strict=True):
                begins = (file, block) != here and block == 0
                if (file, block) != here:
                    here, n = (file, block), 0
                text = formats.decode(bytes(content)) if begins else bytes(content).decode("utf-8", "replace")
                if kind == "ris" and not begins:
                    text = RIS_END + text  # the rest of the line that ended the record before
                for entry in (formats.ris if kind == "ris" else formats.medline)(text):
                    out.append({"file": file, "block": block, "n": n} | _tagged(entry, kind))
                    n += 1
            yield pd.DataFrame(out, columns=["file", "block", "n", *FIELDS])

    return run


def read_tagged(spark: SparkSession, paths: list[str], kind: str, end: str) -> DataFrame:
    """file, idx and the raw fields of tagged files whose records are parted by ``end``, whatever ranges they are cut into.

    Where ``end`` is not found, as at a line end of another kind, records come together in one row and are parted by the parser.
    """
    # a file's name comes encoded as in an address
    name = F.url_decode(F.replace(F.col("_metadata.file_name"), F.lit("+"), F.lit("%2B")))
    literal = [re.sub(r"([\[\]{}*?\\])", r"\\\1", p) for p in paths]
    rows = spark.read.option("lineSep", end).text(literal).select(name.alias("file"), F.col("_metadata.file_block_start").alias("block"), F.col("value").cast("binary").alias("content"))
    fields = ", ".join(f"{f} string" for f in FIELDS)
    entries = rows.mapInPandas(_parse_ranges(kind), f"file string, block long, n long, {fields}")
    # of each range only its number of entries meets those of the file's other ranges
    sizes = entries.groupBy("file", "block").agg(F.count("*").alias("many"))
    before = F.coalesce(F.sum("many").over(Window.partitionBy("file").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    placed = entries.join(sizes.select("file", "block", before.alias("before")), ["file", "block"])
    return placed.select("file", (F.col("before") + F.col("n")).alias("idx"), *FIELDS)


def _head(spark: SparkSession, path: str) -> str:
    """The first lines of a file, with their line ends."""
    literal = re.sub(r"([\[\]{}*?\\])", r"\\\1", path)
    lines = spark.read.option("lineSep", "\n").text(literal).where("_metadata.file_block_start = 0").select(F.col("value").cast("binary")).limit(formats.LOOKED_AT).collect()
    return formats.decode(b"\n".join(bytes(r[0]) for r in lines))


def build_records(raw: DataFrame) -> DataFrame:
    """Records out of raw fields (file, idx and the fields): cleaned, with ids ``<source>-<idx>`` and ord."""
    stem = F.lower(F.regexp_extract("file", r"^(.*?)(\.[^.]*)?$", 1))
    abstract = F.nullif(T.clean_text(F.col("abstract")), F.lit(""))
    columns: dict[str, Column] = {
        "record_id": F.format_string("%s-%05d", stem, F.col("idx")),
        "source_db": stem,
        "doi": T.normalize_doi(F.col("doi")),
        "title": T.clean_text(F.col("title")),
        "authors": T.clean_text(F.col("authors")),
        "first_author": T.first_author(F.col("authors")),
        "year": T.clean_year(F.col("year")),
        "abstract": abstract,
        "abstract_source": F.when(abstract.isNotNull(), "export").otherwise(""),
        "raw_id": T.clean_text(F.col("raw_id")),
    }
    return raw.select((F.col("rank") * (1 << 32) + F.col("idx")).alias("ord"), *(columns[c].alias(c) for c in COLUMNS))


def read_exports(spark: SparkSession, folder: str) -> DataFrame:
    """All exports of a folder, files in order of their names; ord keeps the order.

    Files of unknown kinds are left out.  No file at all, or two of one name but for the ending, which
    would share ids, is an error.
    """
    files = spark.read.format("binaryFile").load(folder)
    paths = {p.rpartition("/")[2]: p for (p,) in files.select("path").collect()}
    names = sorted(n for n in paths if os.path.splitext(n)[1].lower() in KINDS)
    if not names:
        raise FileNotFoundError(f"no exports in {folder}")
    stems = [os.path.splitext(n)[0].lower() for n in names]
    if len(set(stems)) < len(stems):
        raise ValueError("exports whose names differ in the ending only would share record ids: " + ", ".join(names))
    known = spark.createDataFrame(list(enumerate(names)), "rank long, file string")
    tagged: dict[tuple[str, str], list[str]] = {}
    for name in names:
        kind = KINDS[os.path.splitext(name)[1].lower()]
        if kind in ("ris", "medline"):
            head = _head(spark, paths[name])
            kind = "medline" if kind == "medline" or name.lower().endswith(".txt") and formats.is_medline(head) else "ris"
            blank = "\r\n\r\n" if "\r\n" in head else "\n\n"
            tagged.setdefault((kind, blank if kind == "medline" else f"\n{RIS_END}"), []).append(paths[name])
    # files that are read whole, one a task
    others = F.lower(F.regexp_extract("path", r"(\.[^.]*)$", 1)).isin([e for e, k in KINDS.items() if k not in ("ris", "medline")])
    whole = files.where(others).select("path", "content").repartition(len(names), "path").mapInPandas(_parse, RAW)
    parts = [whole, *(read_tagged(spark, found, kind, end) for (kind, end), found in sorted(tagged.items()))]
    raw = functools.reduce(DataFrame.unionByName, parts)
    return build_records(raw.join(F.broadcast(known), "file"))
