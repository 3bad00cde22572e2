import csv
import os
import random

import pytest
from pyspark.sql import functions as F

from litsieve.functions import similarity as S
from litsieve.operators import components, dedup, enrich, order, prior, review, screening, summary, validation
from litsieve.schema import COLUMNS, DDL
from litsieve.sources import tables


def records(spark, rows):
    """rows: dicts of some record columns; ord is their place."""
    blank = {c: "" for c in COLUMNS} | {"doi": None, "year": None, "abstract": None, "source_db": "s"}
    full = [blank | {"record_id": f"r{i}"} | r for i, r in enumerate(rows)]
    return spark.createDataFrame([(i, *(r[c] for c in COLUMNS)) for i, r in enumerate(full)], "ord long, " + DDL)


def norm(title):
    import re

    return " ".join(sorted(re.sub("[^a-z0-9]+", " ", title.lower()).split()))


def plain_dedup(rows, threshold=90, band=83, years=1, author=80):
    """The sequential rule over all records, as a loop."""
    kept, removed, possible, by_doi = [], [], [], {}
    for i, r in enumerate(rows):
        r = dict(r, ord=i, sources={r.get("source_db", "s")})
        if r.get("doi"):
            if r["doi"] in by_doi:
                k = by_doi[r["doi"]]
                removed.append((i, k["ord"]))
                k["sources"] |= r["sources"]
                if k.get("year") is None:
                    k["year"] = r.get("year")
                if not k.get("abstract"):
                    k["abstract"] = r.get("abstract")
                continue
            by_doi[r["doi"]] = r
            kept.append(r)
    for i, r in enumerate(rows):
        if r.get("doi"):
            continue
        r = dict(r, ord=i, sources={r.get("source_db", "s")})
        best, score = None, -1
        for u in kept:
            if u.get("year") is not None and r.get("year") is not None and abs(u["year"] - r["year"]) > years:
                continue
            a, b = norm(r["title"]), norm(u["title"])
            s = 200 * S.lcs_length(a, b) / (len(a) + len(b)) if a or b else 100
            if s > score:
                best, score = u, s
        if best is not None and score >= threshold:
            a, b = r.get("first_author", ""), best.get("first_author", "")
            if not a or not b or 200 * S.lcs_length(a, b) >= author * (len(a) + len(b)):
                removed.append((i, best["ord"]))
                best["sources"] |= r["sources"]
                if best.get("year") is None:
                    best["year"] = r.get("year")
                if not best.get("abstract"):
                    best["abstract"] = r.get("abstract")
                continue
        elif best is not None and score >= band:
            possible.append((i, best["ord"], best.get("year"), ",".join(sorted(best["sources"]))))
        kept.append(r)
    return kept, removed, possible


@pytest.mark.parametrize(("seed", "stretch"), [(1, 1000), (2, 1000), (1, 0), (3, 0), (4, 6)])
def test_dedup_is_sequential(spark, seed, stretch):
    """Replayed in tasks, settled by rounds, and both."""
    rnd = random.Random(seed)
    words = "alpha beta gamma delta takeover loop reentry study".split()
    rows = []
    for i in range(70):
        title = " ".join(rnd.choice(words) for _ in range(rnd.choice([0, 2, 3, 4])))
        if rnd.random() < 0.4 and title:
            k = rnd.randrange(len(title))
            title = title[:k] + rnd.choice("xyz") + title[k + 1 :]
        rows.append(
            {
                "title": title,
                "year": rnd.choice([None, 2001, 2002, 2003]),
                "doi": rnd.choice([None, None, None, "d1", "d2", f"d{i}"]),
                "first_author": rnd.choice(["", "smith", "smyth", "roe"]),
                "abstract": rnd.choice([None, f"a{i}"]),
                "source_db": rnd.choice(["s", "t", "u"]),
            }
        )
    kept, removed, possible = plain_dedup(rows)
    got, gone, near = dedup.deduplicate(records(spark, rows).repartition(3), stretch=stretch)
    got = {r.ord: r for r in got.collect()}
    assert sorted(got) == sorted(k["ord"] for k in kept)
    assert sorted((r.ord, int(r.duplicate_of[1:])) for r in gone.collect()) == sorted(removed)
    assert sorted((r.ord, int(r.keep_id[1:]), r.keep_year, r.keep_source) for r in near.collect()) == sorted(possible)
    for k in kept:
        r = got[k["ord"]]
        assert (r.year, r.abstract, r.source_db) == (k.get("year"), k.get("abstract"), ",".join(sorted(k["sources"])))


def hot_rows(rnd, n):
    """Few titles, years and authors, so that most rows are there again."""
    titles = ["red bolt", "red bolts", "bolt red s", "old bolt", "cold bolt", "cold bolts", ""]
    years, authors, weights = [None, 2001, 2002, 2003, 2004], ["", "smith", "smyth", "roe"], [rnd.random() ** 3 for _ in range(5)]
    row = lambda i: {"title": rnd.choice(titles), "year": rnd.choices(years, weights)[0], "first_author": rnd.choice(authors), "source_db": rnd.choice(["s", "t", "u,v"]), "doi": rnd.choice([None] * 9 + [f"d{i}"])}
    return [row(i) for i in range(n)]


def told(result):
    """What ``deduplicate`` returns, as rows in order."""
    unique, removed, possible = result
    return [
        sorted((r.ord, r.year, r.source_db) for r in unique.collect()),
        sorted((r.ord, int(r.duplicate_of[1:]), r.similarity) for r in removed.collect()),
        sorted((r.ord, int(r.keep_id[1:]), r.similarity, r.keep_year, r.keep_source) for r in possible.collect()),
    ]


@pytest.mark.parametrize(("seed", "kinds", "ahead"), [(1, 1000, 1), (2, 1000, 2), (3, 1000, 32), (4, 0, 32), (5, 20, 1), (6, 1000, 1)])
def test_dedup_of_hot_titles(spark, seed, kinds, ahead):
    """Walked through by changes, settled by rounds, and replayed row after row give the same."""
    rows = hot_rows(random.Random(seed), 400 if kinds == 1000 else 120)
    kept, removed, possible = plain_dedup(rows)
    got = told(dedup.deduplicate(records(spark, rows).repartition(3), stretch=0, kinds=kinds, ahead=ahead))
    assert got[0] == sorted((k["ord"], k.get("year"), ",".join(sorted(",".join(k["sources"]).split(",")))) for k in kept)
    assert [r[:2] for r in got[1]] == sorted(removed)
    assert [(o, k, y, ",".join(sorted(s.split(",")))) for o, k, _, y, s in got[2]] == sorted((o, k, y, ",".join(sorted(s.split(",")))) for o, k, y, s in possible)


def test_dedup_of_hot_titles_takes_few_rounds(spark):
    """Rounds do not grow with the rows: by rounds of joins, years gained one after the other took one each."""
    rnd = random.Random(7)
    titles = [f"{a} {b}{s}" for a in ("red", "old", "cold", "hot", "new", "blue") for b in ("ring", "rod", "bolt", "gear") for s in ("", "s")]
    years, authors = [None, None, None, *range(1990, 1997)], ["", "large", "economy", "small", "standard", "medium", "promo"]
    df = records(spark, [{"title": rnd.choice(titles), "year": rnd.choice(years), "first_author": rnd.choice(authors)} for _ in range(3000)]).repartition(3).localCheckpoint()
    spark.sparkContext.setJobGroup("hot", "")
    try:
        got = dedup.deduplicate(df, stretch=50)
        jobs = len(spark.sparkContext.statusTracker().getJobIdsForGroup("hot"))
    finally:
        spark.sparkContext.setJobGroup("", "")
    assert jobs < 200
    assert told(got) == told(dedup.deduplicate(df, stretch=10_000))


def test_dedup_of_hot_titles_far_ords(spark):
    """Places beyond the whole numbers of a double."""
    rows, far = hot_rows(random.Random(8), 200), 1 << 60
    df = records(spark, rows)
    walked = told(dedup.deduplicate(df.withColumn("ord", F.col("ord") + far), stretch=0, ahead=3))
    assert [[(r[0] - far, *r[1:]) for r in part] for part in walked] == told(dedup.deduplicate(df))


def test_dedup_empty(spark):
    got, gone, near = dedup.deduplicate(records(spark, [{}]).where("false"))
    assert got.count() == gone.count() == near.count() == 0


def test_prior(spark):
    mine = records(spark, [{"doi": "d1", "title": "x"}, {"title": "Alpha takeover study", "year": 2001, "first_author": "smith"}, {"title": "Alpha takeover study", "first_author": "roe"}, {"doi": "d9", "title": "beta gamma delta"}, {"title": ""}])
    listed = spark.createDataFrame(
        [(0, "p0", "https://doi.org/D1", "other", "", "", "T"), (1, "p1", "", "Alpha takeover studies", "2002", "Smith, J", "F"), (2, "p2", "d1", "later", "", "", "F"), (3, "p3", "", "Delta beta gamma", "", "", ""), (4, "p4", "", "", "", "", "")],
        "ord long, id string, doi string, title string, year string, authors string, decision string",
    )
    left, gone = prior.remove_prior(mine, prior.prior_list(listed))
    assert sorted(r.record_id for r in left.collect()) == ["r2", "r4"]
    assert {r.record_id: (r.prior_record_id, r.match_type) for r in gone.collect()} == {"r0": ("p0", "doi_exact"), "r1": ("p1", "fuzzy_title"), "r3": ("p3", "fuzzy_title")}


def test_enrich(spark):
    cut = {"source_db": "sage1", "abstract": "Cut...", "abstract_source": "export"}
    mine = records(spark, [{"doi": "a"}, {"doi": "b"}, {"doi": "c", **cut}, {**cut}, {"doi": "e", "abstract": "mine", "abstract_source": "export"}, {"doi": "f"}, {"doi": "g"}])
    cache = spark.createDataFrame([("b", None, None, "absent"), ("c", None, None, "absent"), ("f", None, None, "failed"), ("g", "known", "old", "found")], "doi string, text string, source string, status string")
    look = lambda rows: spark.createDataFrame(rows, "doi string, text string")
    out, grown = enrich.backfill(mine, cache, [("first", look([("a", "A"), ("b", "B"), ("f", "F")])), ("second", look([("a", "no"), ("c", "C")]))])
    got = {r.record_id: (r.abstract, r.abstract_source) for r in out.collect()}
    assert got == {"r0": ("A", "first"), "r1": (None, ""), "r2": ("C", "second"), "r3": (None, ""), "r4": ("mine", "export"), "r5": ("F", "first"), "r6": ("known", "old")}
    assert {r.doi: r.status for r in grown.collect()} == {"a": "found", "b": "absent", "c": "found", "f": "found", "g": "found"}


def test_apply_decisions(spark):
    mine = records(spark, [{}, {"abstract": "x"}, {}])
    possible = spark.createDataFrame([(" MERGE", "r0", "t", 85.0, "r1"), ("keep", "r0", "t", 84.0, "r2"), ("maybe", "r0", "t", 84.0, "r2"), ("y", "r0", "t", 84.0, "zz")], "decision string, keep_id string, keep_title string, similarity double, drop_if_merged_id string")
    back = records(spark, [{"record_id": "q1"}, {"record_id": "r0"}, {"record_id": "q2"}]).withColumn("restore", F.element_at(F.array(F.lit("X"), F.lit("yes"), F.lit("")), (F.col("ord") + 1).cast("int")))
    typed = spark.createDataFrame([("r0", " an  abstract "), ("r2", ""), ("q1", "late")], "record_id string, abstract string")
    done, audit, counts = review.apply_decisions(mine, possible, back, back.where("record_id = 'q1'"), typed)
    assert {r.record_id: (r.rank, r.abstract) for r in done.collect()} == {"r0": (0, "an abstract"), "r2": (0, None), "q1": (1, "late")}
    assert [r.record_id for r in audit.collect()] == ["r1"]
    assert {k: v.first()[0] for k, v in counts.items()} == {"possible_duplicates_merged": 1, "undecided": 1, "restored_from_dedup": 1, "restored_from_prior": 0, "manual_abstracts": 2}


INSUFFICIENT = screening.INSUFFICIENT


def plain_vote(samples, policy="review", threshold=1.0):
    valid = [s for s in samples if s[0] in "TF" and s[0]]
    t, f = sum(s[0] == "T" for s in valid), sum(s[0] == "F" for s in valid)
    if not valid:
        return "", "", 0.0
    final = "T" if t >= f else "F"
    reasons = [s[1] for s in valid if s[0] == "F" and s[1]]
    reason = max(dict.fromkeys(reasons), key=lambda r: reasons.count(r)) if final == "F" and reasons else ""
    if reason == INSUFFICIENT and policy == "include":
        final, reason = "T", ""
    return final, reason, round(max(t, f) / len(valid), 3)


@pytest.mark.parametrize("policy", ["review", "include", "exclude"])
def test_vote(spark, policy):
    rnd = random.Random(7)
    data = {f"r{i}": [(rnd.choice(["T", "F", "F", ""]), rnd.choice(["", "a", "b", INSUFFICIENT])) for _ in range(rnd.randrange(1, 7))] for i in range(150)}
    rows = [(k, j, e, r if e == "F" else "", f"why{j}", False, False) for k, s in data.items() for j, (e, r) in enumerate(s)]
    df = spark.createDataFrame(rows, "record_id string, sample_idx int, eligible string, reason string, rationale string, parse_error boolean, off_vocab_reason boolean")
    got = {r.record_id: (r.eligible, r.reason, r.agreement) for r in screening.vote(df.repartition(5), policy=policy).collect()}
    assert got == {k: plain_vote(s, policy) for k, s in data.items()}


def test_flags_and_assembly(spark):
    votes = ["TTTTT", "FFFFF", "TTTFF", "FFFFT", "TTFF", "-----", "T----"]
    reps = [(f"r{i}", j, None if c == "-" else '{"eligible":"%s","reason":"%s"}' % (c, "a" if c == "F" else "")) for i, v in enumerate(votes) for j, c in enumerate(v)]
    samples = spark.createDataFrame(reps, "record_id string, sample_idx int, raw string")
    voted = screening.vote(screening.parse_replies(samples, ["a"]))
    mine = records(spark, [{"abstract": "x"} for _ in votes] + [{}])
    made = screening.assemble(mine, voted, audit=(1, 5))
    out = {r.record_id: r for r in made.collect()}
    assert [out[f"r{i}"].eligible for i in range(8)] == ["T", "F", "T", "F", "T", "", "T", ""]
    assert out["r0"].needs_human_review == "" and out["r2"].needs_human_review.startswith("samples not consistent (3T / 2F of 5)")
    assert out["r1"].needs_human_review == "random audit of exclusions"
    assert out["r5"].needs_human_review == "no parseable verdict" and out["r6"].needs_human_review.startswith("samples not")
    assert out["r7"].needs_human_review == "missing abstract (not screened)"
    order_ = [r.record_id for r in sorted((r for r in out.values() if r.review_ord), key=lambda r: r.review_ord)]
    assert order_ == ["r2", "r3", "r4", "r5", "r6", "r7", "r1"]
    excluded = {r.record_id: r for r in screening.assemble(mine, voted, missing="exclude").collect()}
    assert excluded["r7"].eligible == "F"
    row = made.agg(*summary.screened()).first()
    assert (row.screened, row.excluded, row.tentative, row.inconsistent) == (7, 2, 3, 4)
    assert "Excluded: 2" in summary.report(row.asDict(), [("s", 8)], [("a", 2)])


def test_audit_and_positions(spark):
    df = spark.range(0, 300000, 3).withColumnRenamed("id", "ord")
    got = order.positions(df.repartition(7), "ord", "at").where("ord <> at * 3").count()
    assert got == 0
    results = df.select("ord", F.lit("F").alias("eligible"), F.lit("").alias("needs_human_review"))
    drawn = sorted((r.draw, r.ord) for r in screening.audit_sample(results, 10, 4).collect())
    pool = list(range(0, 300000, 3))
    assert [o for _, o in drawn] == random.Random(4).sample(pool, 10)


def test_requests(spark):
    mine = records(spark, [{} for _ in range(5)])
    asked = screening.expand(mine, [0.0, 0.5], 3, chunk=2)
    assert sorted((r.record_id, r.sample_idx, r.temperature, r.chunk) for r in asked.select("record_id", "sample_idx", "temperature", "chunk").collect())[:3] == [("r0", 0, 0.0, 0), ("r0", 1, 0.5, 0), ("r0", 2, 0.0, 0)]
    done = spark.createDataFrame([("r0", 1), ("r4", 2)], "record_id string, sample_idx int")
    assert screening.outstanding(asked, done).count() == 13
    none = screening.cost_estimate(spark.createDataFrame([], "content string"), 100, 5, {"input": 1.0, "output": 1.0}).first()
    assert none.records == 0 and none.upper_usd == 0


def test_validation(spark):
    rows = spark.createDataFrame([("a", "t", 0), ("a", "F", 1), ("", "T", 2), ("b", "x", 3), ("c", "F", 4), (None, "T", 5)], "record_id string, human_label string, ord int")
    assert {(r.record_id, r.human_label) for r in validation.usable_labels(rows).collect()} == {("a", "T"), ("c", "F")}
    assert {(r.record_id, r.human_label) for r in validation.usable_labels(rows, last=True).collect()} == {("a", "F"), ("c", "F")}
    row = validation.confusion(spark.createDataFrame([("T", "T"), ("T", "F"), ("F", "F"), ("T", "")], "human_label string, eligible string")).first()
    assert (row.tp, row.fn, row.tn, row.fp, row.no_verdict, row.recall) == (1, 1, 1, 0, 1, 0.5)
    one = spark.createDataFrame([(str(i), "T" if i % 2 else "F") for i in range(10)], "record_id string, human_label string")
    assert validation.kappa(one, one).first().kappa == 1.0
    assert validation.kappa(one, one.where("false")).first().n == 0


def test_components(spark):
    rnd = random.Random(2)
    edges = [(rnd.randrange(200), rnd.randrange(200)) for _ in range(150)] + [(1000 + i, 1001 + i) for i in range(40)]
    root = {}

    def find(x):
        root.setdefault(x, x)
        while root[x] != x:
            x = root[x]
        return x

    for a, b in edges:
        a, b = find(a), find(b)
        root[max(a, b)] = min(a, b)
    got = {r.node: r.component for r in components.components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert got == {x: find(x) for a, b in edges for x in (a, b) if a != b}


def test_cut_forgets_estimates(spark):
    """A join's estimated size is the product of its sides'; in a loop it must not grow round by round."""
    rows = spark.range(5).withColumn("x", F.lit(1))
    held = components.Cuts()
    for _ in range(6):
        rows = held(rows.join(rows.select("id"), "id"))
    assert rows.count() == 5
    assert int(rows._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()) < 1 << 20
    kept = components.cut(rows)
    held.close()
    assert kept.count() == 5
    with pytest.raises(Exception):
        rows.count()


def test_files(spark, tmp_path):
    mine = records(spark, [{"title": 'a "quoted", one', "year": 2001, "abstract": "x\ny"}, {"doi": "10.1/é"}])
    path = str(tmp_path / "work/01")
    assert tables.write_records(mine, path) == 2
    back = tables.read_table(spark, path)
    assert [r.asDict() for r in back.orderBy("ord").collect()] == [r.asDict() for r in mine.select(back.columns).orderBy("ord").collect()]
    assert tables.write_records(back.where("year = 2001"), path) == 1  # over the table it is read from
    assert tables.write_records(mine.where("false"), path) == 0
    assert tables.read_table(spark, path).count() == 0 and os.listdir(tmp_path / "work") == ["01"]

    cells = ['a "q", \\ one', "x\ny", " pad ", "", None, "c\rd", "é", "'"]
    odd = spark.createDataFrame([(9 - i, c, i) for i, c in enumerate(cells)], "ord long, a string, b int")
    path = str(tmp_path / "out [1].csv")
    assert tables.write_csv(odd, path, ["a", "b"]) == len(cells)
    with open(path, newline="", encoding="utf-8") as f:
        assert list(csv.reader(f)) == [["a", "b"], *([c or "", str(i)] for i, c in reversed(list(enumerate(cells))))]
    back = tables.read_csv(spark, path).orderBy("ord").collect()
    assert [r.a.replace("\r", "\n") for r in back] == [(c or "").replace("\r", "\n") for c in reversed(cells)]
    assert [r.ord for r in back] == list(range(len(cells)))
    assert tables.write_csv(odd.where("false"), path, ["a", "b"]) == 0 and tables.read_csv(spark, path).columns == ["ord", "a", "b"]
    for name, raw in (("bom", b"\xef\xbb\xbfa,b\n1\n2,3,4\n"), ("mac", "a,b\n1,é\n".encode("mac_roman"))):
        (tmp_path / name).write_bytes(raw)
    assert [tuple(r) for r in tables.read_csv(spark, str(tmp_path / "bom")).collect()] == [(0, "1", ""), (1, "2", "3")]
    assert [tuple(r) for r in tables.read_csv(spark, str(tmp_path / "mac")).collect()] == [(0, "1", "é")]
    ledger = str(tmp_path / "counts.json")
    tables.merge_ledger(ledger, {"a": 1})
    assert tables.merge_ledger(ledger, {"b": 2}) == {"a": 1, "b": 2}
    (tmp_path / "counts.json").write_text("{")
    assert tables.merge_ledger(ledger, {"c": 3}) == {"c": 3}
