"""Searches, the flow of several runs, and the table behind a flow diagram."""

import csv
import random

import pytest
from pyspark.sql import functions as F

from litsieve.functions.search import Search, Term, term_counts
from litsieve.operators import summary
from litsieve.sources import flow


@pytest.mark.parametrize(
    ("written", "words", "open_", "fields"),
    [
        ("takeover", "takeover", False, ("title", "abstract")),
        ('"take-over request"', "take over request", False, ("title", "abstract")),
        ("interven*[ti]", "interven", True, ("title",)),
        (' "Level 3" [AB] ', "level 3", False, ("abstract",)),
        ('"human–AI team*"', "human ai team", True, ("title", "abstract")),
    ],
)
def test_terms(written, words, open_, fields):
    assert Term.of(written) == Term(words, open_, fields)


@pytest.mark.parametrize("written", ["", "*", "in*vent", "word[xx]", '"--"'])
def test_terms_that_are_none(written):
    with pytest.raises(ValueError, match="needs letters|no field"):
        Term.of(written)


def test_search(spark):
    rows = [
        ("Take-over requests", "driver attention", 2012),
        ("Takeover", "Attentional control", 2012),
        ("Retakeover", "attention", 2012),
        ("x", "takeover. ATTENTION", None),
        ("x", "takeover attention", 2009),
        ("attention", "takeover in rats", 2012),
        (None, None, 2012),
    ]
    df = spark.createDataFrame([(i, *r) for i, r in enumerate(rows)], "id int, title string, abstract string, year int")
    found = lambda s: [r.id for r in df.where(s.met(F.col("title"), F.col("abstract"), F.col("year"))).orderBy("id").collect()]
    blocks = [["takeover", '"take over request*"'], ["attention*"]]
    assert found(Search(blocks)) == [0, 1, 3, 4, 5]
    assert found(Search(blocks, ["rats"], (2010, 2026))) == [0, 1]
    assert found(Search([["takeover[ti]"]])) == [1] and found(Search([["attention[ti]"]])) == [5]
    assert found(Search([])) == list(range(7))
    assert Search(blocks).over_limits(2, 1, 1) == ["3 terms, at most 2", "2 terms in a block, at most 1", "2 truncations, at most 1"] and not Search(blocks).over_limits(3, 2, 2)
    told = {(r.block, r.term): r.n for r in term_counts(df, Search(blocks)).collect()}
    assert told == {(0, "takeover"): 4, (0, '"take over request*"'): 1, (1, "attention*"): 6}


def test_runs_together(spark):
    rnd = random.Random(3)
    rows = [(rnd.choice(["a", "b", "c"]), i, rnd.choice([None, *(f"d{k}" for k in range(25))]), rnd.choice("TF"), rnd.choice(["", "", "why", None])) for i in range(120)] + [(None, 500, "d1", "T", "")]
    df = spark.createDataFrame(rows, "strand string, ord long, doi string, eligible string, flag string").withColumn("rank", F.ascii("strand"))
    want, seen = {}, set()
    for s in ("a", "b", "c"):
        mine, papers = [r for r in rows if r[0] == s], {}
        for r in mine:
            papers.setdefault(r[2] or r[1], r)
        new = [r for p, r in papers.items() if p not in seen]
        seen |= set(papers)
        want[s] = (len(mine), len(mine) - len(papers), len(papers) - len(new), len(new), *(sum(not r[4] and r[3] == e for r in new) for e in "FT"), sum(bool(r[4]) for r in new))
    want[None] = tuple(map(sum, zip(*want.values(), strict=True)))
    got = {r.strand: tuple(r)[1:] for r in summary.consolidate(df.repartition(5)).collect()}
    assert got == want
    assert want[None][0] - want[None][1] - want[None][2] == want[None][3] == sum(want[None][4:])


def test_flow_template(spark, tmp_path):
    cells = [
        ["database_results", "node7", "box2", "Records: Databases", "Databases", "t", "u.html", "1"],
        ["database_specific_results", "NA", "box2", "", "Specific", "NA", "u.html", "Old, 1"],
        ["NA", "node16", "oth", 'Grey; "title"', "Other", "Grey", "o.html", "0"],
        ["duplicates", "node8", "box3", "", "Duplicates", "", "", "NA"],
        ["records_excluded", "node10", "box5", "", "Records excluded:\nOld reason (n = 3)", "", "", "3"],
        ["citations_results", "NA", "box11", "", "Scholar", "NA", "NA", "2"],
        ["records_screened", "node9", "box4", "", "Screened", "", "", "9"],
    ]
    path, out = str(tmp_path / "template.csv"), str(tmp_path / "flow.csv")
    with open(path, "w", newline="", encoding="utf-8") as f:
        csv.writer(f).writerows([flow.COLUMNS, *cells])
    template = flow.read_template(spark, path)
    read = lambda p: list(csv.reader(open(p, newline="", encoding="utf-8")))
    assert flow.write_flow(template, out) == 7 and read(out) == [flow.COLUMNS, *cells]
    sources = spark.createDataFrame([("wos", 843), ("acm", 7087)], "name string, n long")
    reasons = spark.createDataFrame([("No task", 45, 9), ("Off topic", 4957, 3), ("Not human", 45, 2)], "reason string, n long, first long")
    filled = flow.fill(template, {"identified_total": 7930, "duplicates_removed": 20, "prior_screened_removed": 5, "excluded": 5047}, sources, reasons)
    assert flow.write_flow(filled, out) == 7
    rows = {r[0]: r for r in read(out)[1:]}
    assert [rows[k][7] for k in ("database_results", "database_specific_results", "NA", "duplicates", "citations_results", "records_screened")] == ["7930", "acm, 7087; wos, 843", "0", "25", "2", "9"]
    assert rows["records_excluded"][4] == "Records excluded:\nOff topic (n = 4,957)\nNot human (n = 45)\nNo task (n = 45)" and rows["records_excluded"][7] == "5047"
    none = flow.fill(template, {}, sources.where("false"), reasons.where("false"))
    assert flow.write_flow(none, out) == 7 and read(out) == [flow.COLUMNS, *cells]
