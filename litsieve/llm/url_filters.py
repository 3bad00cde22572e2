"""URL filters: pattern rules found through their rarest literal token.

A rule is a regular expression over ``host + path`` with the literal tokens that every match
must hold.  Of those, the one least frequent in the urls at hand indexes the rule.  The tokens of
a url fetch its candidate rules by an equi-join, and only candidates run their expression.  Rules are
a table: Spark broadcasts the index only while it is under its own size threshold; beyond, the same
joins shuffle.
"""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"

#: The query's site rules: (verdict, host and path).
SITE_RULES = [
    ("allow", "org/"),
    ("block", "example.org/es/"),
    ("block", "example.org/en/1"),
    ("allow", "com/fr/"),
    ("block", "com/de/"),
]

#: The method's own rules for hosts: words that, standing alone between separators, mark a site as one of these classes.
HOST_WORDS = {
    "gambling": "baccarat bet bets betting bingo blackjack bookmaker casino casinos freespins gambling jackpot jackpots lottery lotto poker roulette slot slots sportsbook wager",
    "adult": "adult camgirls cams erotic erotica escort escorts fetish hentai hookup milf nsfw nude nudes porn porno sex sexcam webcams xxx",
    "pharmacy": "cbd cialis drugstore erectile kratom levitra modafinil oxycodone painkillers pharmacy pills steroids tramadol valium viagra weightloss xanax",
    "loans": "badcredit cashadvance creditrepair debtrelief fastcash fastloan forex getrich instantloan loans payday paydayloan paydayloans quickcash refinance",
    "counterfeit": "cheapwatches counterfeit fakeid knockoff knockoffs outletstore replica replicas swisswatches",
    "piracy": "crack cracked cracks crackz keygen keygens nulled serialz torrent torrents warez",
    "spam": "adserver backlink backlinks buyfollowers clickbait doorway fakereviews guestpost linkfarm linkwheel malware phishing popunder seospam spam spammer spyware trafficbot",
}
#: And for paths: segments of pages that are forms, baskets or lists, not texts.
PATH_SEGMENTS = {
    "accounts": "account login logout my-account password-reset register signin signup wp-admin wp-login.php",
    "shopping": "add-to-cart basket cart checkout wishlist",
    "machines": "cgi-bin wp-content wp-json xmlrpc.php",
}


def url_parts(url: Column) -> tuple[Column, Column]:
    """Host and path: after the first ``://``; both empty for a null url or one without it."""
    at = F.instr(url, "://")
    rest = F.when(at > 0, F.substr(url, at + 3)).otherwise(F.lit(""))
    rest = F.coalesce(rest, F.lit(""))
    host = F.translate(F.regexp_extract(rest, "^[^/?#]*", 0), UPPER, LOWER)
    return host, F.regexp_extract(rest, "^[^/?#]*([^?#]*)", 1)


def site_rule(verdict: str, rule: str) -> dict:
    """A rule for a host with all its subdomains and a path prefix; longer rules go first."""
    host, slash, rest = rule.partition("/")
    path = slash + rest
    whole = path.split("/")[:-1]  # what follows the last slash may be part of a longer segment
    return {
        "rule": rule,
        "verdict": verdict,
        "site": True,
        "rank": len(rule),
        "pattern": r"^(?:[^/]*\.)?" + re.escape(host) + re.escape(path),
        "tokens": [f"h:{x}" for x in host.split(".") if x] + [f"p:{x}" for x in whole if x],
    }


def word_rule(verdict: str, word: str) -> dict:
    """A rule for a word between dots, hyphens or the ends of a host; any site rule goes before it."""
    return {
        "rule": f"*{word}*",
        "verdict": verdict,
        "site": False,
        "rank": 0,
        "pattern": rf"^(?:[^/]*[.\-])?{re.escape(word)}(?:[.\-][^/]*)?(?:/|$)",
        "tokens": [f"w:{word}"],
    }


def segment_rule(verdict: str, segment: str) -> dict:
    """A rule for a whole segment of a path, on any host; any site rule goes before it."""
    return {
        "rule": f"*/{segment}/*",
        "verdict": verdict,
        "site": False,
        "rank": 0,
        "pattern": rf"^[^/]*/(?:[^/]+/|/)*{re.escape(segment)}(?:/|$)",
        "tokens": [f"p:{segment}"],
    }


RULES = "rule string, verdict string, site boolean, rank int, pattern string, tokens array<string>"


def rule_table(spark: SparkSession, rules: list[dict]) -> DataFrame:
    """Rules as a table; one that is there already (see ``RULES``) may hold any number of them."""
    return spark.createDataFrame([tuple(r[c] for c in ("rule", "verdict", "site", "rank", "pattern", "tokens")) for r in rules], RULES)


def _tokens(host: Column, path: Column) -> Column:
    tagged = lambda tag, parts: F.transform(parts, lambda x: F.concat(F.lit(tag), x))
    return F.array_distinct(
        F.concat(
            tagged("h:", F.split(host, r"\.")),
            tagged("p:", F.split(path, "/")),
            tagged("w:", F.split(host, r"[.\-]")),
        )
    )


def filter_urls(urls: DataFrame, rules: DataFrame, default: str = "allow") -> DataFrame:
    """Judge the distinct values of column ``url``: url, host, path, rule, verdict.

    ``rules`` is a table (see ``RULES``) of any size; rows that repeat count once.  The fitting rule of the highest ``rank`` decides
    (ties: block first, then the smaller rule).  ``rule`` is null unless a site rule decided.  Where none fits,
    ``default`` holds; a rule without tokens cannot be found and never fits.  Null urls are one value among the
    others; empty input gives an empty result, an empty rule table ``default`` throughout.
    """
    host, path = url_parts(F.col("url"))
    parts = urls.select("url").distinct().select("url", host.alias("host"), path.alias("path"))
    literal = rules.distinct().withColumn("token", F.explode("tokens")).drop("tokens")
    # tokens of no rule go at once, so only those of rules are counted
    named = literal.select("token").distinct()
    fetched = parts.select("url", "host", "path", F.explode(_tokens(F.col("host"), F.col("path"))).alias("token")).join(named, "token", "left_semi")
    often = fetched.groupBy("token").agg(F.count("*").alias("n"))
    # a token that no url has brings nothing: its rule cannot fit
    index = (
        literal.join(often, "token", "left")
        .groupBy("rule", "verdict", "site", "rank", "pattern")
        .agg(F.min_by(F.struct("token", "n"), F.struct(F.coalesce("n", F.lit(0)), "token")).alias("t"))
        .where("t.n is not null")
        .select("rule", "verdict", "site", "rank", "pattern", F.col("t.token").alias("token"))
    )
    hits = fetched.join(index, "token").where(F.expr("concat(host, path) rlike pattern"))
    best = hits.groupBy("url", "host", "path").agg(
        F.min_by(F.struct("rule", "verdict", "site"), F.struct(-F.col("rank"), F.col("verdict") != "block", "rule")).alias("best")
    )
    rest = parts.join(best.select("url"), "url", "left_anti")
    return best.select(
        "url", "host", "path", F.when(F.col("best.site"), F.col("best.rule")).alias("rule"), F.col("best.verdict").alias("verdict")
    ).unionByName(
        rest.select("url", "host", "path", F.lit(None).cast("string").alias("rule"), F.lit(default).alias("verdict"))
    )


def judge_pages(pages: DataFrame, rules: DataFrame | None = None, default: str = "allow") -> DataFrame:
    """page_id, host, path, rule, verdict for every row of ``pages`` (page_id, url), by ``rules`` or the default ones.

    Equal urls are judged once.  Rows with a null url get empty host and path and ``default``;
    repeated rows stay repeated; other columns of ``pages`` are not read.
    """
    rules = rule_table(pages.sparkSession, default_rules()) if rules is None else rules
    pages = pages.select("page_id", "url")
    judged = filter_urls(pages.where("url is not null"), rules, default)
    found = pages.join(judged, "url", "left")
    empty = lambda c: F.coalesce(F.col(c), F.lit("")).alias(c)
    return found.select("page_id", empty("host"), empty("path"), "rule", F.coalesce("verdict", F.lit(default)).alias("verdict"))


def _listed(classes: dict[str, str]) -> list[str]:
    return [w for words in classes.values() for w in words.split()]


def default_rules() -> list[dict]:
    """The site rules, and the method's own: words of hosts and segments of paths that are blocked."""
    own = [word_rule("block", w) for w in _listed(HOST_WORDS)] + [segment_rule("block", x) for x in _listed(PATH_SEGMENTS)]
    return [site_rule(v, r) for v, r in SITE_RULES] + own


def op9_url_filters(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every row of ``pages`` judged by the default rules."""
    return judge_pages(spark.read.parquet(f"{sf_dir}/pages.parquet"))


def _oracle() -> str:
    sites = ", ".join(f"('{v}', '{r.partition('/')[0]}', '/{r.partition('/')[2]}', '{r}')" for v, r in SITE_RULES)
    words, segments = "|".join(_listed(HOST_WORDS)), "|".join(map(re.escape, _listed(PATH_SEGMENTS)))
    return f"""
WITH cut AS (
  SELECT page_id, CASE WHEN url IS NOT NULL AND position('://' IN url) > 0
                       THEN substr(url, position('://' IN url) + 3) ELSE '' END AS rest FROM pages),
parts AS (
  SELECT page_id, translate(regexp_extract(rest, '^[^/?#]*'), '{UPPER}', '{LOWER}') AS host,
         regexp_extract(rest, '^[^/?#]*([^?#]*)', 1) AS path FROM cut),
sites(verdict, h, p, rule) AS (VALUES {sites}),
judged AS (
  SELECT page_id, host, path,
         (SELECT max_by(struct_pack(r := rule, v := verdict), length(rule)) FROM sites
           WHERE (host = h OR ends_with(host, '.' || h)) AND starts_with(path, p)) AS best FROM parts)
SELECT page_id, host, path, best.r AS rule,
       coalesce(best.v, CASE WHEN regexp_matches(host, '(^|[.\\-])({words})([.\\-]|$)') OR regexp_matches(path, '/({segments})(/|$)') THEN 'block' ELSE 'allow' END) AS verdict
FROM judged"""


ORACLE = _oracle()
