"""The operators on the synthetic tables, and DuckDB SQL that says the same.

The tables are not bibliographic; each query names what stands for what.  All read whole tables.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from litsieve.functions import text as T
from litsieve.functions.search import Search, term_counts
from litsieve.operators import dedup, enrich, prior, review, screening, summary, validation
from litsieve.schema import COLUMNS
from litsieve.sources import exports, tables
from litsieve.sources.tables import shared_dir

#: White space as the engine's column functions take it, for the SQL side.
_WS = r"[\t-\r\x1c-\x20\x85\xa0\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}]+"


def _clean(column: str) -> str:
    return f"trim(regexp_replace(coalesce({column}, ''), '{_WS}', ' ', 'g'))"


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def document_records(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents as records: the text's digest for a DOI, the text for an abstract if it is long enough."""
    docs = _table(spark, sf_dir, "documents")
    none = F.lit("")
    columns = {
        "record_id": F.concat(F.lit("doc-"), F.col("doc_id").cast("string")),
        "source_db": F.col("source"),
        "doi": F.md5("text"),
        "title": none,
        "authors": none,
        "first_author": none,
        "year": F.when(F.col("lang") == "en", (F.lit(1990) + F.col("n_chars") % 30).cast("int")),
        "abstract": F.when(F.col("n_chars") >= 1000, F.col("text")),
        "abstract_source": F.when(F.col("n_chars") >= 1000, "export").otherwise(""),
        "raw_id": F.col("doc_id").cast("string"),
    }
    return docs.select(F.col("doc_id").alias("ord"), *(columns[c].alias(c) for c in COLUMNS))


# ---- functions ---------------------------------------------------------------------------------------


def normalize_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Digests of every text as the cleaning functions leave it, and the first year in it."""
    text = F.col("text")
    return _table(spark, sf_dir, "documents").select(
        "doc_id",
        F.md5(T.clean_text(text)).alias("clean_md5"),
        F.length(T.clean_text(text)).cast("long").alias("clean_chars"),
        F.md5(T.normalize_title(text)).alias("title_md5"),
        T.clean_year(text).alias("year"),
    )


SQL: dict[str, str] = {}
SQL["normalize_text"] = f"""
SELECT doc_id, md5({_clean('text')}) AS clean_md5, CAST(length({_clean('text')}) AS BIGINT) AS clean_chars,
       md5(trim(regexp_replace(lower(coalesce(text, '')), '[^a-z0-9]+', ' ', 'g'))) AS title_md5,
       TRY_CAST(nullif(regexp_extract(text, '(19|20)[0-9]{{2}}'), '') AS INTEGER) AS year
FROM documents"""


def strip_markup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Digests of every page without its tags."""
    text = T.strip_markup(F.col("html"))
    return _table(spark, sf_dir, "pages").select("page_id", F.md5(text).alias("text_md5"), F.length(text).cast("long").alias("chars"))


SQL["strip_markup"] = f"""
WITH t AS (SELECT page_id, {_clean("regexp_replace(html, '<[^>]+>', ' ', 'g')")} AS text FROM pages)
SELECT page_id, md5(text) AS text_md5, CAST(length(text) AS BIGINT) AS chars FROM t"""


def inverted_index_rebuild(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each text taken apart into words and positions, and put together again; no row leaves its place."""
    docs = _table(spark, sf_dir, "documents").select("doc_id", F.split(T.clean_text(F.col("text")), " ").alias("words"))
    index = T.word_index(docs, "words", "index")
    return index.select("doc_id", F.size("index").cast("long").alias("words"), F.md5(T.rebuild_index(F.col("index"))).alias("text_md5"))


SQL["inverted_index_rebuild"] = f"""
SELECT doc_id, CAST(len(list_distinct(string_split({_clean('text')}, ' '))) AS BIGINT) AS words, md5({_clean('text')}) AS text_md5
FROM documents"""


def ris_round_trip(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents written as RIS files, which are then read as exports: number, DOI, title, year and abstract of each record."""
    text = T.clean_text(F.col("text"))
    tagged = {"TY": F.lit("JOUR"), "ID": F.concat(F.lit("d"), F.col("doc_id").cast("string")), "T1": F.concat(F.lit("About "), F.col("source")), "DO": F.concat(F.lit("https://doi.org/10.1/"), F.upper(F.md5("text"))), "PY": F.concat((1990 + F.col("n_chars") % 30).cast("string"), F.lit("/05")), "AB": F.concat(F.lit("On "), text), "ER": F.lit("")}
    record = F.concat_ws("\n", *(F.concat(F.lit(f"{tag}  - "), F.coalesce(value, F.lit(""))) for tag, value in tagged.items()), F.lit(""))
    folder = f"{shared_dir(spark)}/ris-{uuid.uuid4().hex}"
    _table(spark, sf_dir, "documents").select(record.alias("value")).write.text(folder)
    read = exports.read_exports(spark, folder)
    return read.select("raw_id", "doi", "title", "year", F.md5("abstract").alias("abstract_md5"), "abstract_source")


SQL["ris_round_trip"] = f"""
SELECT 'd' || doc_id AS raw_id, '10.1/' || md5(text) AS doi, 'About ' || source AS title, CAST(1990 + n_chars % 30 AS INTEGER) AS year,
  md5(trim('On ' || {_clean('text')})) AS abstract_md5, 'export' AS abstract_source FROM documents"""


def parse_props(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events counted and summed by the number in their properties, read by Spark alone."""
    said = screening.parse_strict(F.col("props"), "k int")
    return _table(spark, sf_dir, "events").groupBy(said["k"].alias("k")).agg(F.count("*").alias("n"), F.bround(F.sum("value"), 2).alias("total"))


SQL["parse_props"] = """
SELECT CAST(json_extract(props, '$.k') AS INTEGER) AS k, count(*) AS n, round_even(sum(value), 2) AS total FROM events GROUP BY 1"""


# ---- deduplication -----------------------------------------------------------------------------------


def exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents of equal text as one record: the first of them, with what the others add."""
    kept, _ = dedup.exact(document_records(spark, sf_dir))
    return kept.select("record_id", "source_db", "doi", "year", "abstract_source", F.md5("abstract").alias("abstract_md5"))


_RECORDS = """
records AS (SELECT doc_id AS ord, 'doc-' || CAST(doc_id AS VARCHAR) AS record_id, source AS source_db, md5(text) AS doi, text, lang,
  CASE WHEN lang = 'en' THEN CAST(1990 + n_chars % 30 AS INTEGER) END AS year,
  CASE WHEN n_chars >= 1000 THEN text END AS abstract FROM documents),
kept AS (SELECT doi, min(ord) AS ord, arg_min(record_id, ord) AS record_id, string_agg(DISTINCT source_db, ',' ORDER BY source_db) AS source_db,
  arg_min(year, ord) FILTER (year IS NOT NULL) AS year, arg_min(abstract, ord) FILTER (abstract IS NOT NULL) AS abstract FROM records GROUP BY doi)"""
SQL["exact_dedup"] = f"""
WITH {_RECORDS}
SELECT record_id, source_db, doi, year, CASE WHEN abstract IS NULL THEN '' ELSE 'export' END AS abstract_source, md5(abstract) AS abstract_md5 FROM kept"""


def removed_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The documents that ``exact_dedup`` removes, and for which record."""
    _, removed = dedup.exact(document_records(spark, sf_dir))
    return removed.select("record_id", "match_type", "duplicate_of", "similarity", "source_db")


SQL["removed_rows"] = f"""
WITH {_RECORDS}
SELECT r.record_id, 'doi_exact' AS match_type, k.record_id AS duplicate_of, CAST(100.0 AS DOUBLE) AS similarity, r.source_db
FROM records r JOIN kept k USING (doi) WHERE r.ord <> k.ord"""


def part_titles(spark: SparkSession, sf_dir: str, year: Column, author: Column) -> DataFrame:
    """Names of all parts, as they are and in the plural, as titles of records without a DOI; ``year`` and ``author`` are a part's."""
    part = _table(spark, sf_dir, "part").select(F.col("p_partkey").alias("key"), "p_name", year.cast("int").alias("year"), author.alias("first_author"))
    titles = part.select((F.col("key") * 2).alias("ord"), F.col("p_name").alias("title"), "year", "first_author").unionByName(part.select((F.col("key") * 2 + 1).alias("ord"), F.concat("p_name", F.lit("s")).alias("title"), "year", "first_author"))
    none = F.lit(None).cast("string")
    cells = {c: F.lit("") for c in COLUMNS} | {"record_id": F.concat(F.lit("part-"), F.col("ord").cast("string")), "source_db": F.lit("part"), "doi": none, "abstract": none}
    cells |= {c: F.col(c) for c in ("title", "year", "first_author")}
    return titles.select("ord", *(cells[c].alias(c) for c in COLUMNS))


def fuzzy_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Names of all parts, as they are and in the plural, as titles without a DOI: who is merged into whom."""
    unique, removed, possible = dedup.deduplicate(part_titles(spark, sf_dir, F.lit(None), F.lit("")))
    return (
        unique.select("record_id", F.lit("kept").alias("verdict"), F.lit(None).cast("string").alias("other"), F.lit(None).cast("double").alias("similarity"))
        .unionByName(removed.select("record_id", F.lit("removed").alias("verdict"), F.col("duplicate_of").alias("other"), "similarity"))
        .unionByName(possible.select(F.col("drop_if_merged_id").alias("record_id"), F.lit("possible").alias("verdict"), F.col("keep_id").alias("other"), "similarity"))
    )


def fuzzy_dedup_dated(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same with years for the parts of even size and makers as authors for most: the window, the author's guard, years gained, rounds of joins."""
    year = F.when(F.col("p_size") % 2 == 0, 1990 + F.col("p_size") % 7)
    author = F.when(F.col("p_size") % 5 == 0, "").otherwise(F.lower("p_type"))
    unique, removed, possible = dedup.deduplicate(part_titles(spark, sf_dir, year, author), stretch=500)
    return (
        unique.select("record_id", F.lit("kept").alias("verdict"), F.lit(None).cast("string").alias("other"), F.lit(None).cast("double").alias("similarity"), "year")
        .unionByName(removed.select("record_id", F.lit("removed").alias("verdict"), F.col("duplicate_of").alias("other"), "similarity", "year"))
        .unionByName(possible.select(F.col("drop_if_merged_id").alias("record_id"), F.lit("possible").alias("verdict"), F.col("keep_id").alias("other"), "similarity", F.col("keep_year").alias("year")))
    )


def _lcs_sql(a: str, b: str) -> str:
    """LCS length of two SQL strings by one list fold inside another."""
    row = f"list_reduce(range(1, length({b}) + 1), lambda done, j: list_append(done, greatest(prev[j + 1], done[-1], CASE WHEN substr({b}, j, 1) = substr({a}, i, 1) THEN prev[j] + 1 ELSE 0 END)), [CAST(0 AS BIGINT)])"
    return f"list_reduce(range(1, length({a}) + 1), lambda prev, i: {row}, list_resize([CAST(0 AS BIGINT)], length({b}) + 1, 0))[-1]"


# Without years and authors a title that is there again always finds a kept one at 90, so only the first record of
# a title can be kept: the recursion decides over the titles in that order, the rest looks up who was kept by then.
SQL["fuzzy_dedup"] = f"""
WITH RECURSIVE rec AS (SELECT p_partkey * 2 AS ord, p_name AS title FROM part UNION ALL SELECT p_partkey * 2 + 1, p_name || 's' FROM part),
keyed AS (SELECT ord, array_to_string(list_sort(string_split(trim(regexp_replace(lower(coalesce(title, '')), '[^a-z0-9]+', ' ', 'g')), ' ')), ' ') AS k FROM rec),
cls AS MATERIALIZED (SELECT k, min(ord) AS o, row_number() OVER (ORDER BY min(ord)) AS n FROM keyed GROUP BY k),
sim AS MATERIALIZED (SELECT x.n AS l, y.n AS r, y.o AS r_ord, CASE WHEN x.n = y.n THEN 100.0 ELSE 200.0 * {_lcs_sql('x.k', 'y.k')} / (length(x.k) + length(y.k)) END AS score FROM cls x, cls y),
dup AS (SELECT l, list(r) FILTER (r < l AND score >= 90) AS over FROM sim GROUP BY l),
walk(n, kept) AS (SELECT CAST(0 AS BIGINT), CAST([] AS BIGINT[])
  UNION ALL SELECT w.n + 1, CASE WHEN len(list_intersect(w.kept, coalesce(d.over, CAST([] AS BIGINT[])))) = 0 THEN list_append(w.kept, w.n + 1) ELSE w.kept END FROM walk w JOIN dup d ON d.l = w.n + 1),
kept AS (SELECT unnest(kept) AS r FROM (SELECT arg_max(kept, n) AS kept FROM walk)),
best AS (SELECT k.ord, arg_max(struct_pack(r_ord, score), struct_pack(s.score, o := -r_ord)) AS m
  FROM keyed k JOIN cls c USING (k) JOIN sim s ON s.l = c.n JOIN kept USING (r) WHERE s.r_ord < k.ord AND s.score >= 83 GROUP BY k.ord),
told AS (SELECT k.ord, m, CASE WHEN m IS NULL THEN 'kept' WHEN m.score >= 90 THEN 'removed' ELSE 'possible' END AS verdict FROM keyed k LEFT JOIN best USING (ord))
SELECT 'part-' || ord AS record_id, verdict, CASE WHEN m IS NOT NULL THEN 'part-' || m.r_ord END AS other, round_even(CAST(m.score AS DOUBLE), 1) AS similarity FROM told
UNION ALL SELECT 'part-' || ord, 'kept', NULL, NULL FROM told WHERE verdict = 'possible'"""


# Row after row with the kept ones as a list: for small tables.
SQL["fuzzy_dedup_dated"] = f"""
WITH RECURSIVE rec AS (SELECT p_partkey * 2 + i AS ord, p_name || CASE i WHEN 1 THEN 's' ELSE '' END AS title, CASE WHEN p_size % 2 = 0 THEN 1990 + p_size % 7 END AS year,
  CASE WHEN p_size % 5 = 0 THEN '' ELSE lower(p_type) END AS author FROM part, range(2) AS r(i)),
keyed AS (SELECT *, array_to_string(list_sort(string_split(trim(regexp_replace(lower(coalesce(title, '')), '[^a-z0-9]+', ' ', 'g')), ' ')), ' ') AS k FROM rec),
cls AS MATERIALIZED (SELECT k, row_number() OVER (ORDER BY k) AS c FROM (SELECT DISTINCT k FROM keyed)),
sim AS MATERIALIZED (SELECT list(row_ ORDER BY c) AS s FROM (SELECT x.c, list(CASE WHEN x.c = y.c THEN 100.0 ELSE 200.0 * {_lcs_sql('x.k', 'y.k')} / (length(x.k) + length(y.k)) END ORDER BY y.c) AS row_ FROM cls x, cls y GROUP BY x.c)),
names AS MATERIALIZED (SELECT author, row_number() OVER (ORDER BY author) AS a FROM (SELECT DISTINCT author FROM rec)),
alike AS MATERIALIZED (SELECT list(row_ ORDER BY a) AS g FROM (SELECT x.a, list(x.author = '' OR y.author = '' OR 200 * {_lcs_sql('x.author', 'y.author')} >= 80 * (length(x.author) + length(y.author)) ORDER BY y.a) AS row_ FROM names x, names y GROUP BY x.a)),
rows_ AS MATERIALIZED (SELECT row_number() OVER (ORDER BY ord) AS n, ord, c, CAST(year AS INTEGER) AS year, a FROM keyed JOIN cls USING (k) JOIN names USING (author)),
walk(n, kept, ord, verdict, b) AS (SELECT CAST(0 AS BIGINT), CAST([] AS STRUCT(ord BIGINT, c BIGINT, y INTEGER, a BIGINT)[]), CAST(NULL AS BIGINT), CAST(NULL AS VARCHAR), CAST(NULL AS STRUCT(s DOUBLE, o BIGINT, y INTEGER, a BIGINT))
  UNION ALL
  SELECT n, CASE WHEN verdict <> 'removed' THEN list_append(kept, {{'ord': ord, 'c': c, 'y': year, 'a': a}})
    WHEN b.y IS NULL AND year IS NOT NULL THEN list_transform(kept, lambda x: CASE WHEN x.ord = -b.o THEN {{'ord': x.ord, 'c': x.c, 'y': year, 'a': x.a}} ELSE x END) ELSE kept END, ord, verdict, b
  FROM (SELECT *, CASE WHEN b.s >= 90 AND g[a][b.a] THEN 'removed' WHEN b.s >= 83 AND b.s < 90 THEN 'possible' ELSE 'kept' END AS verdict
    FROM (SELECT r.n, r.ord, r.c, r.year, r.a, w.kept, g, list_sort(list_transform(list_filter(w.kept, lambda x: s[r.c][x.c] >= 83 AND (x.y IS NULL OR r.year IS NULL OR abs(x.y - r.year) <= 1)),
      lambda x: {{'s': CAST(s[r.c][x.c] AS DOUBLE), 'o': -x.ord, 'y': x.y, 'a': x.a}}), 'DESC')[1] AS b FROM walk w JOIN rows_ r ON r.n = w.n + 1, sim, alike))),
told AS (SELECT w.ord, verdict, b, r.year FROM walk w JOIN rows_ r USING (n)),
last AS (SELECT unnest(kept, recursive := true) FROM (SELECT arg_max(kept, n) AS kept FROM walk))
SELECT 'part-' || ord AS record_id, 'kept' AS verdict, NULL AS other, CAST(NULL AS DOUBLE) AS similarity, y AS year FROM last
UNION ALL SELECT 'part-' || ord, verdict, 'part-' || -b.o, round_even(b.s, 1), CASE verdict WHEN 'possible' THEN b.y ELSE year END FROM told WHERE verdict <> 'kept'"""


def year_band_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Counts of orders and of line items by year, missing for open orders, joined at most a year apart."""
    orders = _table(spark, sf_dir, "orders").groupBy("o_orderpriority", F.when(F.col("o_orderstatus") != "P", F.year("o_orderdate")).alias("l_year")).agg(F.count("*").alias("orders"))
    items = _table(spark, sf_dir, "lineitem").groupBy("l_returnflag", F.when(F.col("l_linestatus") == "F", F.year("l_shipdate")).alias("r_year")).agg(F.count("*").alias("items"))
    pairs = dedup.year_pairs(orders.withColumn("__block", F.lit(0)), items.withColumn("__block", F.lit(0)), 1)
    return pairs.select("o_orderpriority", "l_year", "orders", "l_returnflag", "r_year", "items")


SQL["year_band_join"] = """
WITH o AS (SELECT o_orderpriority, CASE WHEN o_orderstatus <> 'P' THEN CAST(year(o_orderdate) AS INTEGER) END AS l_year, count(*) AS orders FROM orders GROUP BY 1, 2),
i AS (SELECT l_returnflag, CASE WHEN l_linestatus = 'F' THEN CAST(year(l_shipdate) AS INTEGER) END AS r_year, count(*) AS items FROM lineitem GROUP BY 1, 2)
SELECT o_orderpriority, l_year, orders, l_returnflag, r_year, items FROM o, i
WHERE l_year IS NULL OR r_year IS NULL OR abs(l_year - r_year) <= 1"""


# ---- earlier runs and enrichment ---------------------------------------------------------------------


def prior_exact_anti(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Customers against orders: those who ordered before go to their first order, the others remain."""
    key = lambda c: F.concat(F.lit("10.1/"), F.col(c).cast("string"))
    customers = _table(spark, sf_dir, "customer")
    none = {c: F.lit("") for c in COLUMNS} | {"abstract": F.lit(None).cast("string"), "year": F.lit(None).cast("int")}
    records = customers.select(F.col("c_custkey").alias("ord"), *((none | {"record_id": F.col("c_name"), "doi": key("c_custkey")})[c].alias(c) for c in COLUMNS))
    orders = _table(spark, sf_dir, "orders")
    rows = orders.select(F.col("o_orderkey").alias("ord"), F.col("o_orderkey").cast("string").alias("id"), key("o_custkey").alias("DOI"), F.col("o_orderstatus").alias("decision"))
    remaining, removed = prior.remove_prior(records, prior.prior_list(rows))
    gone = removed.select("record_id", "match_type", "prior_record_id", "prior_decision")
    blank = F.lit(None).cast("string")
    return gone.unionByName(remaining.select("record_id", blank.alias("match_type"), blank.alias("prior_record_id"), blank.alias("prior_decision")))


SQL["prior_exact_anti"] = """
WITH p AS (SELECT o_custkey, arg_min(o_orderkey, o_orderkey) AS k, arg_min(o_orderstatus, o_orderkey) AS d FROM orders GROUP BY 1)
SELECT c_name AS record_id, CASE WHEN k IS NOT NULL THEN 'doi_exact' END AS match_type, CAST(k AS VARCHAR) AS prior_record_id, d AS prior_decision
FROM customer LEFT JOIN p ON c_custkey = o_custkey"""


def prior_fuzzy_anti(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All parts' names against the same names in the plural and in other order, as an earlier list."""
    part = _table(spark, sf_dir, "part").select("p_name", F.col("p_partkey").alias("ord"))
    none = {c: F.lit("") for c in COLUMNS} | {c: F.lit(None).cast("string") for c in ("abstract", "doi")} | {"year": F.lit(None).cast("int")}
    records = part.select("ord", *((none | {"record_id": F.concat(F.lit("part-"), F.col("ord").cast("string")), "title": F.col("p_name")})[c].alias(c) for c in COLUMNS))
    words = F.split("p_name", " ")
    rows = part.select("ord", F.concat(F.lit("prior-"), F.col("ord").cast("string")).alias("record_id"), F.concat_ws(" ", F.concat(F.element_at(words, -1), F.lit("s")), F.element_at(words, 1)).alias("title"))
    remaining, removed = prior.remove_prior(records, prior.prior_list(rows))
    gone = removed.select("record_id", "match_type", "prior_record_id", "similarity")
    blank = lambda kind: F.lit(None).cast(kind)
    return gone.unionByName(remaining.select("record_id", blank("string").alias("match_type"), blank("string").alias("prior_record_id"), blank("double").alias("similarity")))


SQL["prior_fuzzy_anti"] = f"""
WITH p AS (SELECT p_name, min(p_partkey) AS ord FROM part GROUP BY 1),
r AS (SELECT p_name, array_to_string(list_sort(string_split(p_name, ' ')), ' ') AS a FROM p),
l AS (SELECT ord AS prior_ord, array_to_string(list_sort([string_split(p_name, ' ')[-1] || 's', string_split(p_name, ' ')[1]]), ' ') AS b FROM p),
scored AS (SELECT p_name, prior_ord, 200.0 * {_lcs_sql('a', 'b')} / (length(a) + length(b)) AS score FROM r, l),
best AS (SELECT p_name, arg_max(struct_pack(prior_ord, score), struct_pack(score, o := -prior_ord)) AS m FROM scored WHERE score >= 90 GROUP BY 1)
SELECT 'part-' || p_partkey AS record_id, CASE WHEN m IS NOT NULL THEN 'fuzzy_title' END AS match_type, CASE WHEN m IS NOT NULL THEN 'prior-' || m.prior_ord END AS prior_record_id,
       round_even(CAST(m.score AS DOUBLE), 1) AS similarity
FROM part LEFT JOIN best USING (p_name)"""


def document_lookups(spark: SparkSession, sf_dir: str) -> tuple[list[tuple[str, DataFrame]], DataFrame]:
    """The lookups and the cache of ``enrich_backfill``."""
    cache = _table(spark, sf_dir, "labels").where("quality = 0").select(F.col("doc_id").cast("string").alias("doi"), F.lit(None).cast("string").alias("text"), F.lit(None).cast("string").alias("source"), F.lit("absent").alias("status"))
    first = _table(spark, sf_dir, "benchmark").select(F.col("item_id").cast("string").alias("doi"), "text")
    second = _table(spark, sf_dir, "pages").select(F.col("page_id").cast("string").alias("doi"), T.strip_markup(F.col("html")).alias("text"))
    return [("benchmark", first), ("pages", second)], cache


def enrich_backfill(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents under 1,000 characters lack an abstract; labels of low quality are known misses, benchmark
    items and then pages are looked up by number."""
    records = document_records(spark, sf_dir).withColumn("doi", F.col("raw_id"))
    lookups, cache = document_lookups(spark, sf_dir)
    out, _ = enrich.backfill(records, cache, lookups)
    return out.select("record_id", "abstract_source", F.md5("abstract").alias("abstract_md5"))


SQL["enrich_backfill"] = f"""
WITH {_RECORDS},
page AS (SELECT page_id, {_clean("regexp_replace(html, '<[^>]+>', ' ', 'g')")} AS text FROM pages),
miss AS (SELECT DISTINCT doc_id FROM labels WHERE quality = 0),
found AS (SELECT r.*, CASE WHEN r.abstract IS NULL AND m.doc_id IS NULL THEN coalesce(b.text, nullif(p.text, '')) END AS got,
                 CASE WHEN b.text IS NOT NULL THEN 'benchmark' ELSE 'pages' END AS got_from
          FROM records r LEFT JOIN miss m ON m.doc_id = r.ord LEFT JOIN benchmark b ON b.item_id = r.ord LEFT JOIN page p ON p.page_id = r.ord)
SELECT record_id, CASE WHEN got IS NOT NULL THEN got_from WHEN abstract IS NULL THEN '' ELSE 'export' END AS abstract_source,
       md5(coalesce(got, abstract)) AS abstract_md5 FROM found"""


# ---- verdicts ------------------------------------------------------------------------------------------


def event_verdicts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events as samples of a user's verdict: views and clicks include, errors exclude, for one of four reasons."""
    k = screening.parse_strict(F.col("props"), "k int")["k"]
    kind = F.col("event_type")
    eligible = F.when(kind.isin("view", "click"), "T").when(kind == "error", "F").otherwise("")
    reasons = F.array(*(F.lit(x) for x in ("Off topic", "No data", screening.INSUFFICIENT, "")))
    reason = F.when(kind == "error", F.element_at(reasons, k % 4 + 1)).otherwise("")
    return _table(spark, sf_dir, "events").select(
        F.col("user_id").alias("record_id"),
        F.col("event_id").alias("sample_idx"),
        eligible.alias("eligible"),
        reason.alias("reason"),
        F.when(k % 2 == 0, F.concat(F.lit("r"), F.col("event_id").cast("string"))).otherwise("").alias("rationale"),
        (kind == "signup").alias("parse_error"),
        (reason == "No data").alias("off_vocab_reason"),
    )


def dirty_replies(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events as replies in eight forms, told by their number: well-formed, with prose, with other quotes, with a rest
    behind, with a key twice, with other types, without an object, with escapes."""
    k = screening.parse_strict(F.col("props"), "k int")["k"].cast("string")
    forms = [
        F.concat(F.lit('{"rationale": "r'), k, F.lit('", "eligible": "T", "reason": ""}')),
        F.lit('Sure.\n{"eligible": " f ", "reason": "Off topic"} Done.'),
        F.lit("{'eligible': 'T'}"),
        F.lit('{"eligible": "T"} x }'),
        F.concat(F.lit('{"eligible": "T", "eligible": "F", "reason": "k'), k, F.lit('"}')),
        F.concat(F.lit('{"eligible": true, "reason": 0, "rationale": '), k, F.lit("}")),
        F.lit("T"),
        F.lit('{"eligible": "F", "reason": "line\\u0020two", "rationale": null}'),
    ]
    raw = F.element_at(F.array(*forms), (F.col("event_id") % 8 + 1).cast("int"))
    rows = _table(spark, sf_dir, "events").select(F.col("event_id").alias("record_id"), raw.alias("raw"))
    return screening.parse_replies(rows, ["Off topic"]).drop("raw")


SQL["dirty_replies"] = """
WITH e AS (SELECT event_id, event_id % 8 AS i, CAST(json_extract(props, '$.k') AS VARCHAR) AS k FROM events)
SELECT event_id AS record_id, CASE i WHEN 0 THEN 'T' WHEN 1 THEN 'F' WHEN 4 THEN 'F' WHEN 7 THEN 'F' ELSE '' END AS eligible,
  CASE i WHEN 1 THEN 'Off topic' WHEN 4 THEN 'k' || k WHEN 7 THEN 'line two' ELSE '' END AS reason,
  CASE i WHEN 0 THEN 'r' || k WHEN 5 THEN CASE WHEN k = '0' THEN '' ELSE k END ELSE '' END AS rationale, i IN (2, 3, 6) AS parse_error, i IN (4, 7) AS off_vocab_reason FROM e"""


def job_answers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events as replies of users to jobs, named by their type: what counts for the job ``click`` of four samples, and what is still open."""
    replies = _table(spark, sf_dir, "events").select(F.col("event_type").alias("job"), F.col("user_id").cast("string").alias("record_id"), (F.col("event_id") % 6).cast("int").alias("sample_idx"), F.col("value").alias("temperature"), F.col("props").alias("raw"))
    said = screening.answers(replies, "click", 4)
    asked = replies.select("record_id").distinct().withColumn("sample_idx", F.explode(F.sequence(F.lit(0), F.lit(3))))
    left = screening.outstanding(asked, said)
    blank = {"temperature": F.lit(None).cast("double"), "raw": F.lit(None).cast("string")}
    return said.withColumn("open", F.lit(False)).unionByName(left.withColumns(blank | {"open": F.lit(True)}))


SQL["job_answers"] = """
WITH e AS (SELECT event_type AS job, CAST(user_id AS VARCHAR) AS record_id, CAST(event_id % 6 AS INTEGER) AS sample_idx, value AS temperature, props AS raw FROM events),
said AS (SELECT record_id, sample_idx, min({'t': temperature, 'r': raw}) AS m FROM e WHERE job = 'click' AND sample_idx < 4 GROUP BY 1, 2),
asked AS (SELECT DISTINCT record_id, CAST(i AS INTEGER) AS sample_idx FROM e, range(4) AS r(i))
SELECT a.record_id, a.sample_idx, m.t AS temperature, m.r AS raw, m IS NULL AS open FROM asked a LEFT JOIN said s ON s.record_id = a.record_id AND s.sample_idx = a.sample_idx"""


def vote_aggregate(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The events of each user voted into a verdict."""
    return screening.vote(event_verdicts(spark, sf_dir), threshold=0.66)


_VOTES = """
v AS (SELECT user_id AS record_id, event_id AS i, CAST(json_extract(props, '$.k') AS INTEGER) AS k,
  CASE WHEN event_type IN ('view', 'click') THEN 'T' WHEN event_type = 'error' THEN 'F' ELSE '' END AS e,
  CASE WHEN event_type = 'error' THEN ['Off topic', 'No data', 'Insufficient information', ''][k % 4 + 1] ELSE '' END AS reason,
  CASE WHEN k % 2 = 0 THEN 'r' || event_id ELSE '' END AS why, event_type = 'signup' AS bad FROM events),
top AS (SELECT record_id, arg_min(reason, struct_pack(a := -n, b := f)) AS top FROM
  (SELECT record_id, reason, count(*) AS n, min(i) AS f FROM v WHERE e = 'F' AND reason <> '' GROUP BY 1, 2) GROUP BY 1),
c AS (SELECT record_id, count(*) FILTER (e = 'T') AS t, count(*) FILTER (e = 'F') AS f, count(*) AS n, bool_or(bad) AS bad, bool_or(reason = 'No data') AS off,
  arg_min(why, i) FILTER (e = 'T' AND why <> '') AS why_t, arg_min(why, i) FILTER (e = 'F' AND why <> '') AS why_f FROM v GROUP BY 1),
s AS (SELECT c.*, CASE WHEN t + f = 0 THEN '' WHEN t >= f THEN 'T' ELSE 'F' END AS side, greatest(t, f) / nullif(t + f, 0) AS share,
  CASE WHEN t + f > 0 AND t < f THEN coalesce(top, '') ELSE '' END AS reason FROM c LEFT JOIN top USING (record_id)),
votes AS (SELECT record_id, side AS eligible, reason, CASE WHEN share >= 1 THEN 'high' WHEN share >= 0.75 THEN 'medium' ELSE 'low' END AS confidence,
  coalesce(round_even(share, 3), 0.0) AS agreement, t AS votes_include, f AS votes_exclude, t + f AS valid_samples, n AS total_samples,
  coalesce(CASE side WHEN 'T' THEN why_t WHEN 'F' THEN why_f END, '') AS rationale, coalesce(t + f >= n // 2 + 1 AND share >= 0.66, false) AS consistent,
  bad OR t + f = 0 AS parse_error, off AS off_vocab_reason, reason = 'Insufficient information' AS insufficient, false AS forced_include FROM s)"""
SQL["vote_aggregate"] = f"WITH {_VOTES} SELECT * FROM votes"


def review_flags(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Why a user's verdict needs a person."""
    return vote_aggregate(spark, sf_dir).select("record_id", screening.review_flag().alias("flag"))


SQL["review_flags"] = f"""
WITH {_VOTES}
SELECT record_id, CASE WHEN valid_samples = 0 THEN 'no parseable verdict'
  WHEN NOT consistent THEN 'samples not consistent (' || votes_include || 'T / ' || votes_exclude || 'F of ' || total_samples || ')'
  WHEN off_vocab_reason THEN 'reason not in the allowed list' WHEN insufficient THEN 'insufficient information' ELSE '' END AS flag FROM votes"""


def reason_histogram(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How often each reason is given, and where first."""
    rows = event_verdicts(spark, sf_dir).withColumnsRenamed({"reason": "reason_for_exclusion", "sample_idx": "ord"})
    return summary.reasons(rows)


SQL["reason_histogram"] = f"""
WITH {_VOTES} SELECT reason, count(*) AS n, min(i) AS first FROM v WHERE e = 'F' AND reason <> '' GROUP BY 1"""


def audit_sample(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents in German as unflagged exclusions: the fifty that the audit draws."""
    results = _table(spark, sf_dir, "documents").select(F.col("doc_id").alias("ord"), F.when(F.col("lang") == "de", "F").otherwise("T").alias("eligible"), F.lit("").alias("needs_human_review"))
    return screening.audit_sample(results).select("ord", "draw")


#: What Python's ``random.Random(20260628).sample`` draws from the pools of the given tables, rows of ``documents`` in German (fixed values).
_DRAWS = {
    31: "14 1 11 30 25 2 16 13 21 4 9 12 17 0 18 7 22 20 26 8 28 5 15 27 6 19 24 3 29 10 23",
    129: "113 8 45 57 102 9 66 101 53 86 115 19 39 49 68 97 0 112 31 34 76 23 67 69 40 59 33 126 2 63 55 74 10 27 4 93 26 120 5 99 83 29 20 123 82 12 17 14 60 92",
    1486: "904 68 735 914 152 1070 853 1380 309 624 797 1098 7 2 497 548 1224 370 1078 1112 641 954 540 731 35 1009 887 1198 163 442 64 428 854 92 1015 1461 1328 468 329 147 1321 192 282 230 963 419 46 575 245 690",
}
_DRAWN = ", ".join(f"({n}, {p}, {i})" for n, draw in _DRAWS.items() for i, p in enumerate(draw.split()))
SQL["audit_sample"] = f"""
WITH pool AS (SELECT doc_id AS ord, row_number() OVER (ORDER BY doc_id) - 1 AS place, count(*) OVER () AS n FROM documents WHERE lang = 'de'),
drawn(n, place, draw) AS (VALUES {_DRAWN})
SELECT ord, CAST(draw AS INTEGER) AS draw FROM pool JOIN drawn USING (n, place)"""


def confusion_metrics(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Quality as the label against toxicity as the verdict."""
    labels = _table(spark, sf_dir, "labels")
    mark = lambda c: F.when(F.col(c) == 1, "T").otherwise("F")
    return validation.confusion(labels.select(mark("quality").alias("human_label"), mark("toxic").alias("eligible")))


SQL["confusion_metrics"] = """
WITH c AS (SELECT count(*) FILTER (quality = 1 AND toxic = 1) AS tp, count(*) FILTER (quality <> 1 AND toxic = 1) AS fp,
  count(*) FILTER (quality <> 1 AND toxic <> 1) AS tn, count(*) FILTER (quality = 1 AND toxic <> 1) AS fn FROM labels)
SELECT tp, fp, tn, fn, CAST(0 AS BIGINT) AS no_verdict, tp / (tp + fn) AS recall, tn / (tn + fp) AS specificity FROM c"""


def cohen_kappa(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Quality and toxicity as two raters."""
    labels = _table(spark, sf_dir, "labels")
    rater = lambda c: validation.usable_labels(labels.select(F.col("doc_id").cast("string").alias("record_id"), F.when(F.col(c) == 1, "t").otherwise("f").alias("human_label"), F.col("doc_id").alias("ord")))
    return validation.kappa(rater("quality"), rater("toxic")).select("n", F.bround("agreement", 9).alias("agreement"), F.bround("kappa", 9).alias("kappa"))


SQL["cohen_kappa"] = """
WITH c AS (SELECT count(*) AS n, count(*) FILTER ((quality = 1) = (toxic = 1)) AS same, count(*) FILTER (quality = 1) AS q, count(*) FILTER (toxic = 1) AS t FROM labels),
p AS (SELECT n, same / n AS po, (q * t + (n - q) * (n - t)) / (CAST(n AS DOUBLE) * n) AS pe FROM c)
SELECT n, round_even(po, 9) AS agreement, round_even((po - pe) / (1 - pe), 9) AS kappa FROM p"""


# ---- review and reports --------------------------------------------------------------------------------


def document_marks(spark: SparkSession, sf_dir: str, removed: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """The marks of ``apply_decisions``: possible duplicates, removed records, abstracts typed in."""
    labels = _table(spark, sf_dir, "labels")
    possible = labels.select(
        F.when(F.col("toxic") == 1, " Merge ").when(F.col("quality") == 0, "keep").otherwise("").alias("decision"),
        F.lit(85.0).alias("similarity"),
        F.lit("").alias("keep_id"),
        F.lit("").alias("keep_title"),
        F.concat(F.lit("doc-"), F.col("doc_id").cast("string")).alias("drop_if_merged_id"),
    )
    langs = _table(spark, sf_dir, "documents").select(F.col("doc_id").alias("ord"), "lang")
    marked = removed.join(langs, "ord").withColumn("restore", F.when(F.col("lang") == "fr", "X").otherwise(""))
    typed = _table(spark, sf_dir, "benchmark").select(F.concat(F.lit("doc-"), F.col("item_id").cast("string")).alias("record_id"), F.col("text").alias("abstract"))
    return possible, marked, typed


def apply_decisions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Kept documents; toxic ones are merged away, low quality is kept apart; removed French copies come back;
    benchmark items are abstracts typed in by number."""
    kept, removed = dedup.exact(document_records(spark, sf_dir))
    possible, marked, typed = document_marks(spark, sf_dir, removed)
    done, _, _ = review.apply_decisions(kept, possible, marked, marked.where("false"), typed)
    return done.select("record_id", "rank", "abstract_source")


SQL["apply_decisions"] = f"""
WITH {_RECORDS},
gone AS (SELECT DISTINCT 'doc-' || doc_id AS record_id FROM labels WHERE toxic = 1),
survivors AS (SELECT record_id, CAST(0 AS INTEGER) AS rank, abstract FROM kept WHERE record_id NOT IN (SELECT record_id FROM gone)
  UNION ALL SELECT r.record_id, CAST(1 AS INTEGER), r.abstract FROM records r JOIN kept k USING (doi) WHERE r.ord <> k.ord AND r.lang = 'fr')
SELECT record_id, rank, CASE WHEN abstract IS NOT NULL THEN 'export' WHEN record_id IN (SELECT 'doc-' || item_id FROM benchmark) THEN 'manual' ELSE '' END AS abstract_source
FROM survivors"""


def source_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents by source."""
    return summary.per_source(document_records(spark, sf_dir))


SQL["source_counts"] = "SELECT source AS source_db, count(*) AS n FROM documents GROUP BY 1"


def source_rollup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents by the letters that their source begins with."""
    return summary.roll_up(document_records(spark, sf_dir))


SQL["source_rollup"] = "SELECT regexp_extract(source, '^[a-z]+') AS database, count(*) AS n FROM documents GROUP BY 1"


_SEARCH = Search([["thanedble", '"ingre onanshat"', "eswh*", "entz*", '"stung-ein"'], ["the", "de*", "une[ab]"]], ["ofonrereer"], (1995, 2020))


def search_strings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents that two blocks of terms and years find; a document's source is its title."""
    docs = _table(spark, sf_dir, "documents").withColumn("year", (1990 + F.col("n_chars") % 40).cast("int"))
    return docs.where(_SEARCH.met(F.col("source"), F.col("text"), F.col("year"))).select("doc_id", "year")


_PLAIN = "' ' || trim(regexp_replace(lower(coalesce(text, '')), '[^a-z0-9]+', ' ', 'g')) || ' '"
SQL["search_strings"] = f"""
WITH d AS (SELECT doc_id, CAST(1990 + n_chars % 40 AS INTEGER) AS year, {_PLAIN} AS t FROM documents)
SELECT doc_id, year FROM d WHERE (t LIKE '% thanedble %' OR t LIKE '% ingre onanshat %' OR t LIKE '% eswh%' OR t LIKE '% entz%' OR t LIKE '% stung ein %')
  AND (t LIKE '% the %' OR t LIKE '% de%' OR t LIKE '% une %') AND t NOT LIKE '% ofonrereer %' AND year BETWEEN 1995 AND 2020"""


def search_terms(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How many documents each term finds."""
    docs = _table(spark, sf_dir, "documents").select(F.col("source").alias("title"), F.col("text").alias("abstract"))
    return term_counts(docs, _SEARCH)


SQL["search_terms"] = f"""
WITH d AS (SELECT {_PLAIN} AS t FROM documents),
terms(block, term, shown) AS (VALUES (0, 'thanedble', '% thanedble %'), (0, '"ingre onanshat"', '% ingre onanshat %'), (0, 'eswh*', '% eswh%'), (0, 'entz*', '% entz%'),
  (0, '"stung-ein"', '% stung ein %'), (1, 'the', '% the %'), (1, 'de*', '% de%'), (1, 'une[ab]', '% une %'))
SELECT CAST(block AS INTEGER) AS block, term, count(*) FILTER (t LIKE shown) AS n FROM d, terms GROUP BY ALL"""


def strand_flow(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents as records of eight runs, told by language and the last bit of the number, earliest by name: equal texts are
    one paper, short texts have no DOI, toxic ones are excluded, low quality is flagged."""
    labels = _table(spark, sf_dir, "labels").groupBy("doc_id").agg(F.max("toxic").alias("toxic"), F.min("quality").alias("quality"))
    # texts stay where they are, only their digests meet the labels
    doi = F.when(F.col("n_chars") >= 100, F.md5("text"))
    docs = _table(spark, sf_dir, "documents").select("doc_id", "lang", doi.alias("doi")).join(labels, "doc_id", "left")
    rank = F.element_at(F.create_map(*(F.lit(x) for i, lang in enumerate(("de", "en", "es", "fr")) for x in (lang, i))), F.col("lang"))
    eligible = F.when(F.col("toxic") == 1, "F").otherwise("T")
    flag = F.when(F.col("quality") == 0, "low quality").otherwise("")
    strand = F.concat("lang", F.lit("-"), (F.col("doc_id") % 2).cast("string"))
    return summary.consolidate(docs.select(strand.alias("strand"), (rank * 2 + F.col("doc_id") % 2).alias("rank"), F.col("doc_id").alias("ord"), "doi", eligible.alias("eligible"), flag.alias("flag")))


SQL["strand_flow"] = """
WITH l AS (SELECT doc_id, max(toxic) AS toxic, min(quality) AS quality FROM labels GROUP BY 1),
r AS (SELECT lang || '-' || doc_id % 2 AS strand, doc_id AS ord, CASE WHEN n_chars >= 100 THEN md5(text) ELSE CAST(doc_id AS VARCHAR) END AS paper,
  coalesce(toxic = 1, false) AS bad, coalesce(quality = 0, false) AS low FROM documents LEFT JOIN l USING (doc_id)),
c AS (SELECT paper, strand, count(*) AS copies, arg_min(bad, ord) AS bad, arg_min(low, ord) AS low FROM r GROUP BY 1, 2),
k AS (SELECT *, row_number() OVER (PARTITION BY paper ORDER BY strand) = 1 AS kept FROM c)
SELECT strand, CAST(sum(copies) AS BIGINT) AS identified, CAST(sum(copies - 1) AS BIGINT) AS within_run, count(*) FILTER (NOT kept) AS across_runs, count(*) FILTER (kept) AS "unique",
  count(*) FILTER (kept AND NOT low AND bad) AS excluded, count(*) FILTER (kept AND NOT low AND NOT bad) AS eligible, count(*) FILTER (kept AND low) AS held
FROM k GROUP BY GROUPING SETS ((strand), ())"""


def flow_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The ledger of documents: identified, unique, removed, without abstract."""
    records = document_records(spark, sf_dir)
    kept, _ = dedup.exact(records)
    total = records.agg(F.count("*").alias("identified_total"), F.lit(1).alias("one"))
    unique = kept.agg(F.count("*").alias("unique_after_dedup"), F.count_if(F.col("abstract").isNull()).alias("missing_abstract"), F.lit(1).alias("one"))
    return total.join(unique, "one").select("identified_total", "unique_after_dedup", (F.col("identified_total") - F.col("unique_after_dedup")).alias("duplicates_removed"), "missing_abstract")


SQL["flow_counts"] = f"""
WITH {_RECORDS}
SELECT (SELECT count(*) FROM records) AS identified_total, count(*) AS unique_after_dedup, (SELECT count(*) FROM records) - count(*) AS duplicates_removed,
       count(*) FILTER (abstract IS NULL) AS missing_abstract FROM kept"""


def flow_ledger(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All counts of a run over the documents, each taken as its stage's table is written.

    Spanish texts are an earlier list; labels are marks and known misses, as in ``apply_decisions`` and ``enrich_backfill``;
    the events of a user are the samples of the document of that number.  Abstracts go by their digests: counts need no texts.
    """
    digest = lambda c: F.when(F.col(c) != "", F.md5(c))
    folder = f"{shared_dir(spark)}/ledger-{uuid.uuid4().hex}"
    told: dict[str, int] = {}

    def stage(name: str, df: DataFrame, rows: str, *counts: Column) -> DataFrame:
        found = tables.write_counted(df, f"{folder}/{name}", *counts)
        told.update({rows: found.pop("n")} | found)
        return tables.read_table(spark, f"{folder}/{name}", df.schema)

    docs = _table(spark, sf_dir, "documents")
    records = stage("01_ingested", document_records(spark, sf_dir).withColumn("abstract", digest("abstract")), "identified_total")
    sources = F.array_join(F.array_sort(F.collect_list(F.concat_ws("=", "source_db", F.col("n").cast("string")))), ",")
    kept, removed = dedup.exact(records)
    removed = stage("dedup_removed", removed, "duplicates_removed")
    kept = stage("02_deduplicated", kept, "unique_before_prior")
    earlier = docs.where("lang = 'es'").select(F.col("doc_id").alias("ord"), F.col("doc_id").cast("string").alias("id"), F.md5("text").alias("doi"))
    listed = stage("prior_list", prior.prior_list(earlier), "prior_screened_list")
    left, gone = prior.remove_prior(kept, listed)
    stage("prior_screened_removed", gone, "prior_screened_removed")
    left = stage("02_without_prior", left, "unique_after_dedup")
    lookups, cache = document_lookups(spark, sf_dir)
    lookups = [(name, table.withColumn("text", digest("text"))) for name, table in lookups]
    enriched, _ = enrich.backfill(left.withColumn("doi", F.col("raw_id")), cache, lookups)
    looked_up = F.count_if(F.col("abstract_source").isin(*(name for name, _ in lookups)))
    enriched = stage("03_enriched", enriched, "rows", looked_up.alias("abstracts_backfilled"), F.count_if(F.col("abstract").isNull()).alias("missing_abstract"))
    possible, marked, typed = document_marks(spark, sf_dir, removed)
    done, audit, _ = review.apply_decisions(enriched, possible, marked, marked.where("false"), typed)
    stage("merged", audit, "possible_duplicates_merged")
    done = stage("03_applied", done, "rows", F.count_if(F.col("rank") == 1).alias("restored_from_dedup"), F.count_if(F.col("abstract_source") == "manual").alias("manual_abstracts"))
    votes = vote_aggregate(spark, sf_dir).withColumn("record_id", F.concat(F.lit("doc-"), F.col("record_id").cast("string")))
    stage("04_results", screening.assemble(done, votes), "rows", *summary.screened())
    names = "identified_total duplicates_removed unique_after_dedup prior_screened_list prior_screened_removed abstracts_backfilled missing_abstract restored_from_dedup possible_duplicates_merged manual_abstracts screened eligible flagged_for_review excluded".split()
    told["dedup_possible_duplicates"] = possible.where("drop_if_merged_id <> ''").count()
    by_source = summary.per_source(records).agg(sources.alias("n")).first().n
    tables.drop(spark, folder)
    return spark.range(1).select(F.lit(by_source).alias("identified_per_source"), *(F.lit(told[n]).cast("long").alias(n) for n in (*names, "dedup_possible_duplicates")))


SQL["flow_ledger"] = f"""
WITH {_RECORDS}, {_VOTES},
flags AS (SELECT record_id, eligible, total_samples, CASE WHEN valid_samples = 0 OR NOT consistent OR off_vocab_reason OR insufficient THEN true ELSE false END AS flagged FROM votes),
page AS (SELECT page_id, {_clean("regexp_replace(html, '<[^>]+>', ' ', 'g')")} AS text FROM pages),
miss AS (SELECT DISTINCT doc_id FROM labels WHERE quality = 0), toxic AS (SELECT DISTINCT doc_id FROM labels WHERE toxic = 1),
old AS (SELECT md5(text) AS doi FROM documents WHERE lang = 'es'),
rest AS (SELECT ord, abstract FROM kept WHERE doi NOT IN (SELECT doi FROM old)),
found AS (SELECT r.ord, r.abstract, CASE WHEN r.abstract IS NULL AND m.doc_id IS NULL THEN coalesce(b.text, nullif(p.text, '')) END AS got
  FROM rest r LEFT JOIN miss m ON m.doc_id = r.ord LEFT JOIN benchmark b ON b.item_id = r.ord LEFT JOIN page p ON p.page_id = r.ord),
survivors AS (SELECT ord, 0 AS rank, coalesce(got, abstract) AS abstract FROM found WHERE ord NOT IN (SELECT doc_id FROM toxic)
  UNION ALL SELECT r.ord, 1, r.abstract FROM records r JOIN kept k USING (doi) WHERE r.ord <> k.ord AND r.lang = 'fr'),
typed AS (SELECT ord, rank, abstract IS NULL AND ord IN (SELECT item_id FROM benchmark) AS manual, abstract IS NULL AND ord NOT IN (SELECT item_id FROM benchmark) AS bare FROM survivors),
results AS (SELECT t.*, CASE WHEN bare THEN '' ELSE coalesce(f.eligible, '') END AS eligible, bare OR coalesce(f.flagged, true) AS flagged, CASE WHEN bare THEN 0 ELSE coalesce(total_samples, 0) END AS n
  FROM typed t LEFT JOIN flags f ON f.record_id = t.ord)
SELECT (SELECT string_agg(source || '=' || n, ',' ORDER BY source || '=' || n) FROM (SELECT source, count(*) AS n FROM documents GROUP BY 1)) AS identified_per_source,
  (SELECT count(*) FROM documents) AS identified_total, (SELECT count(*) FROM documents) - (SELECT count(*) FROM kept) AS duplicates_removed, (SELECT count(*) FROM rest) AS unique_after_dedup,
  (SELECT count(*) FROM old) AS prior_screened_list, (SELECT count(*) FROM kept) - (SELECT count(*) FROM rest) AS prior_screened_removed,
  (SELECT count(*) FROM found WHERE got IS NOT NULL) AS abstracts_backfilled, (SELECT count(*) FROM found WHERE got IS NULL AND abstract IS NULL) AS missing_abstract,
  (SELECT count(*) FROM typed WHERE rank = 1) AS restored_from_dedup, (SELECT count(*) FROM found WHERE ord IN (SELECT doc_id FROM toxic)) AS possible_duplicates_merged,
  (SELECT count(*) FROM typed WHERE manual) AS manual_abstracts, count(*) FILTER (n > 0) AS screened, count(*) FILTER (eligible = 'T' AND NOT flagged) AS eligible,
  count(*) FILTER (flagged) + least(50, count(*) FILTER (eligible = 'F' AND NOT flagged)) AS flagged_for_review, count(*) FILTER (eligible = 'F') AS excluded,
  (SELECT count(*) FROM labels) AS dedup_possible_duplicates
FROM results"""


def cost_estimate(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What asking about every document would cost."""
    return screening.cost_estimate(_table(spark, sf_dir, "documents").select(F.col("text").alias("content")), 1761, 5, {"input": 3.0, "output": 15.0}, floor=1024)


SQL["cost_estimate"] = """
WITH c AS (SELECT count(*) AS records, CAST(sum(greatest(1, length(text) // 4)) AS BIGINT) AS tokens FROM documents),
d AS (SELECT records, records * 5 AS n, tokens * 5 + records * 75 AS u, CAST(ceil(records / 3000) AS BIGINT) * 5 AS w FROM c)
SELECT records, n AS requests, u AS user_tokens, n * 80 AS output_tokens, round_even((u + n * 1761) * 3e-6 + n * 80 * 15e-6, 2) AS upper_usd,
  round_even(u * 3e-6 + 1761 * 3e-6 * (w * 1.25 + (n - w) * 0.10) + n * 80 * 15e-6, 2) AS cached_usd,
  true AS caching, round_even((n - w) / n, 2) AS read_share, false AS borderline FROM d"""


def decision_pivot(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Conversations side by side: the role that speaks in each of the first eight turns, and the later turns as ``turn:role``."""
    turns = _table(spark, sf_dir, "conversations").groupBy("conv_id", "turn").agg(F.min("role").alias("role"))
    later = F.sort_array(F.collect_list(F.when(F.col("turn") > 7, F.struct("turn", "role"))))
    told = F.array_join(F.transform(later, lambda x: F.concat_ws(":", x["turn"].cast("string"), x["role"])), ",")
    return turns.groupBy("conv_id").agg(*(F.min(F.when(F.col("turn") == t, F.col("role"))).alias(f"t{t}") for t in range(8)), F.nullif(told, F.lit("")).alias("later"))


SQL["decision_pivot"] = (
    "WITH t AS (SELECT conv_id, turn, min(role) AS role FROM conversations GROUP BY 1, 2) SELECT conv_id, "
    + ", ".join(f"min(role) FILTER (turn = {t}) AS t{t}" for t in range(8))
    + ", string_agg(concat_ws(':', turn, role), ',' ORDER BY turn) FILTER (turn > 7) AS later FROM t GROUP BY 1"
)


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    f.__name__: f
    for f in (
        normalize_text,
        strip_markup,
        inverted_index_rebuild,
        ris_round_trip,
        parse_props,
        exact_dedup,
        removed_rows,
        fuzzy_dedup,
        fuzzy_dedup_dated,
        year_band_join,
        prior_exact_anti,
        prior_fuzzy_anti,
        enrich_backfill,
        dirty_replies,
        job_answers,
        vote_aggregate,
        review_flags,
        reason_histogram,
        audit_sample,
        confusion_metrics,
        cohen_kappa,
        apply_decisions,
        source_counts,
        source_rollup,
        search_strings,
        search_terms,
        strand_flow,
        flow_counts,
        flow_ledger,
        cost_estimate,
        decision_pivot,
    )
}
