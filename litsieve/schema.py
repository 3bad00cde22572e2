"""The record: the one row type that every stage of screening reads and writes."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Columns of a record in file order; ``ord``, its place in the input, goes along inside plans.
RECORD = [
    ("record_id", "string"),
    ("source_db", "string"),
    ("doi", "string"),
    ("title", "string"),
    ("authors", "string"),
    ("first_author", "string"),
    ("year", "int"),
    ("abstract", "string"),
    ("abstract_source", "string"),
    ("raw_id", "string"),
]
COLUMNS = [name for name, _ in RECORD]
#: Columns that are null where nothing is known; the others are empty.
NULLABLE = {"doi", "year", "abstract"}
DDL = ", ".join(f"{name} {kind}" for name, kind in RECORD)


def from_cells(rows: DataFrame) -> DataFrame:
    """Records out of string cells, as files hold them: blanks are null where that is allowed, missing
    columns blank, extra ones dropped, a year that is not all digits null."""

    def cell(name: str, kind: str) -> Column:
        text = F.coalesce(F.col(name).cast("string"), F.lit("")) if name in rows.columns else F.lit("")
        if kind == "int":
            return F.when(F.trim(text).rlike("^[0-9]+$"), F.trim(text).try_cast("int"))
        return F.nullif(text, F.lit("")) if name in NULLABLE else text

    kept = ["ord"] if "ord" in rows.columns else []
    return rows.select(*kept, *(cell(n, k).alias(n) for n, k in RECORD))
