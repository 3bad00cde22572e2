"""Work tables (Parquet), the files that people edit (one CSV file each), one JSON ledger, JSON lines."""

from __future__ import annotations

import codecs
import csv
import json
import os
import re
import shutil
import tempfile
import uuid

from pyspark.sql import Column, DataFrame, Observation, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StringType, StructField, StructType

from litsieve.schema import COLUMNS

#: How CSV is quoted in both directions: every cell, quotes doubled.
_QUOTING = {"quote": '"', "escape": '"'}


def shared_dir(spark: SparkSession) -> str:
    """The folder that the session names for what executors share; on one machine, where it names none, a temporary one."""
    sc = spark.sparkContext
    if sc.getCheckpointDir() is None:
        named = spark.conf.get("spark.checkpoint.dir", None)
        if named is None and not sc.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        sc.setCheckpointDir(named or tempfile.mkdtemp(prefix="tables-"))
    return sc.getCheckpointDir()


class Table:
    """A Parquet table on any file system that Spark reaches, replaced as a whole.

    The folder holds versions and a small file that names the current one.  A version is written in full, from the
    current one if need be, and then the file is renamed over the old name, which is one step: a reader finds the old or the
    new table, and a run that dies before leaves the old one.  The version before stays for those that still read it.
    """

    NAME = "_current"

    def __init__(self, spark: SparkSession, path: str):
        self._spark, self._path = spark, path
        hadoop = spark.sparkContext._jvm.org.apache.hadoop.fs
        self._conf = spark.sparkContext._jsc.hadoopConfiguration()
        self._at = lambda *parts: hadoop.Path("/".join((path, *parts)))
        self._files = hadoop.Path(path).getFileSystem(self._conf)
        self._hadoop = hadoop

    def version(self) -> str | None:
        """The current version's name; None if there is no table."""
        if not self._files.exists(self._at(self.NAME)):
            return None
        stream = self._files.open(self._at(self.NAME))
        try:
            return self._spark.sparkContext._jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8").strip()
        finally:
            stream.close()

    def read(self, schema: StructType | str | None = None) -> DataFrame:
        """The current version."""
        name = self.version()
        if name is None:
            raise FileNotFoundError(f"no table at {self._path}")
        reader = self._spark.read if schema is None else self._spark.read.schema(schema)
        return reader.parquet(f"{self._path}/{name}")

    def write(self, df: DataFrame, *counts: Column) -> dict:
        """``df`` in place of what is there; n, the rows it has, and the named aggregates ``counts``, all taken as it is written."""
        name, before, told = f"version-{uuid.uuid4().hex}", self.version(), Observation()
        df.observe(told, F.count(F.lit(1)).alias("n"), *counts).write.parquet(f"{self._path}/{name}")
        self._point(name)
        for found in self._files.listStatus(self._at()):
            if found.isDirectory() and found.getPath().getName() not in (name, before):
                self._files.delete(found.getPath(), True)
        return told.get

    def _point(self, name: str) -> None:
        fresh = self._at(f"{self.NAME}-{name}")
        stream = self._files.create(fresh, True)
        stream.write(bytearray(name.encode()))
        stream.close()
        over = getattr(self._hadoop, "Options$Rename")
        how = self._spark.sparkContext._gateway.new_array(over, 1)
        how[0] = over.OVERWRITE
        self._hadoop.FileContext.getFileContext(self._files.getUri(), self._conf).rename(self._files.makeQualified(fresh), self._files.makeQualified(self._at(self.NAME)), how)


def write_table(df: DataFrame, path: str) -> int:
    """A table (see ``Table``) in place of an earlier one; the rows it has."""
    return Table(df.sparkSession, path).write(df)["n"]


def write_counted(df: DataFrame, path: str, *counts: Column) -> dict:
    """A table in place of an earlier one; its rows, n, and the named aggregates ``counts``, taken as it is written."""
    return Table(df.sparkSession, path).write(df, *counts)


def read_table(spark: SparkSession, path: str, schema: StructType | str | None = None) -> DataFrame:
    """The table at ``path``; where there is none, an empty one of ``schema`` if that is given."""
    table = Table(spark, path)
    return spark.createDataFrame([], schema) if schema is not None and table.version() is None else table.read(schema)


def drop(spark: SparkSession, path: str) -> None:
    """Delete a folder and all tables in it, if it is there."""
    table = Table(spark, path)
    table._files.delete(table._at(), True)


def write_records(df: DataFrame, path: str) -> int:
    """Records and their ord as a table."""
    return write_table(df.select("ord", *COLUMNS), path)


def write_csv(df: DataFrame, path: str, columns: list[str], order: str = "ord") -> int:
    """One CSV file of ``df`` in the order of ``order``, written even if it has no rows, so that none of an
    earlier run is taken for it; the rows it has.

    Spark sorts and writes the parts; they are joined as bytes, so no row passes through the driver.
    """
    parts = tempfile.mkdtemp(prefix="parts-", dir=_folder(path))
    cells = df.orderBy(order).select(*(F.coalesce(F.col(c).cast("string"), F.lit("")).alias(c) for c in columns)).persist()
    n = cells.count()
    spaces = {"ignoreLeadingWhiteSpace": False, "ignoreTrailingWhiteSpace": False}
    cells.write.mode("overwrite").options(header=False, quoteAll=True, emptyValue="", **_QUOTING, **spaces).csv(parts)
    cells.unpersist()
    whole = os.path.join(parts, "whole")
    with open(whole, "wb") as out:
        out.write((",".join(columns) + "\n").encode())
        for name in sorted(f for f in os.listdir(parts) if f.startswith("part-")):
            with open(os.path.join(parts, name), "rb") as part:
                shutil.copyfileobj(part, out)
    os.replace(whole, path)
    shutil.rmtree(parts)
    return n


def read_csv(spark: SparkSession, path: str) -> DataFrame:
    """All columns of a CSV file as strings (blank: empty) with ord, the place of the row; UTF-8, else Mac Roman.

    A quoted cell may hold line ends, so one task reads the file, row after row.  Short rows are filled with
    blanks, cells beyond the heading are left out.
    """
    path = _utf8(path)
    with open(path, newline="", encoding="utf-8-sig") as f:
        head = next(csv.reader(f), [])
    if not head:
        return spark.createDataFrame([], "ord long")
    # of columns whose names differ only in case, or that are called ord, the first of each keeps its name
    seen = ["ord", *(h.lower() for h in head)]
    names = [f"{h}_{i}" if h.lower() in seen[: i + 1] else h for i, h in enumerate(head)]
    schema = StructType([StructField(n, StringType()) for n in names])
    pattern = re.sub(r"([\[\]{}*?\\])", r"\\\1", path)
    rows = spark.read.schema(schema).options(header=True, multiLine=True, **_QUOTING).csv(pattern)
    return rows.select(F.monotonically_increasing_id().alias("ord"), *(F.coalesce(F.col(f"`{n}`"), F.lit("")).alias(n) for n in names))


def _folder(path: str) -> str:
    folder = os.path.dirname(path) or "."
    os.makedirs(folder, exist_ok=True)
    return folder


def _utf8(path: str) -> str:
    """The file if it is UTF-8, else a copy of it, taken for Mac Roman, in UTF-8 beside it."""
    try:
        with codecs.open(path, encoding="utf-8") as f:
            while f.read(1 << 20):
                pass
        return path
    except UnicodeDecodeError:
        with open(path, encoding="mac_roman", newline="") as f, open(f"{path}.utf8", "w", encoding="utf-8", newline="") as out:
            shutil.copyfileobj(f, out)
        return f"{path}.utf8"


def write_audit(samples: DataFrame, results: DataFrame, folder: str, model: str, also: tuple[str, ...] = ()) -> None:
    """JSON lines, one per record: its samples in order, the final verdict, the flag and the columns ``also`` names."""
    sample = F.struct("sample_idx", "temperature", "raw", "eligible", "reason", "rationale", "parse_error")
    said = samples.groupBy("record_id").agg(F.array_sort(F.collect_list(sample)).alias("samples"))
    lines = results.join(said, "record_id").select(
        F.struct(
            "record_id",
            F.lit(model).alias("model"),
            F.transform("samples", lambda s: s.dropFields("sample_idx")).alias("samples"),
            F.struct("eligible", F.col("reason_for_exclusion").alias("reason"), "confidence", "agreement").alias("final"),
            "needs_human_review",
            *also,
        ).alias("line")
    )
    lines.select(F.to_json("line", {"ignoreNullFields": "false"}).alias("value")).write.mode("overwrite").text(folder)


def merge_ledger(path: str, counts: dict) -> dict:
    """The counts file with ``counts`` put in; a file that cannot be read counts as empty."""
    try:
        with open(path, encoding="utf-8") as f:
            known = json.load(f)
    except (OSError, ValueError):
        known = {}
    known = (known if isinstance(known, dict) else {}) | counts
    os.makedirs(os.path.dirname(path) or ".", exist_ok=True)
    with open(f"{path}.part", "w", encoding="utf-8") as f:
        json.dump(known, f, indent=2, ensure_ascii=False)
    os.replace(f"{path}.part", path)
    return known
