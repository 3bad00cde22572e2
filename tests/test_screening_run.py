import csv
import json

import pytest

from litsieve.operators import screening
from litsieve.plans.screen import Screening, main
from litsieve.plans.workspace import Workspace, parse_criteria, system_prompt
from litsieve.sources import tables
from litsieve.streaming.responses import collect_responses

CRITERIA = "Include studies.\n<!-- no -->\n## ALLOWED EXCLUSION REASONS\n- Off topic\n- Insufficient information\n"


def rows(path):
    with open(path, newline="", encoding="utf-8") as f:
        return list(csv.DictReader(f))


def test_whole_run(spark, tmp_path):
    root = str(tmp_path / "searches")
    ws = Workspace.create(root, "one")
    (tmp_path / "searches/one/inputs/wos.csv").write_text(
        "DOI,Title,Authors,Year,Abstract\n10.1/a,Alpha takeover study,Smith J,2020,About alpha.\n10.1/A,Alpha again,Smith J,2020,\n,Beta loop reentry task,Roe A,2019,\n,Beta loop reentry tasks,Roe A,2020,Late abstract.\n10.1/c,Gamma,Poe,2018,\n10.1/old,Seen before,X,2001,y\n",
        encoding="utf-8",
    )
    (tmp_path / "searches/one/prior_screened/old.csv").write_text("id,DOI,Title,eligible\np1,10.1/old,Seen before,F\n")
    (tmp_path / "searches/one/criteria.md").write_text(CRITERIA)
    look = spark.createDataFrame([("10.1/c", "Found text")], "doi string, text string")
    run = Screening(spark, ws, [("lookup", look)])
    run.clean()
    work, out = ws.path("work"), ws.path("outputs")
    enriched = lambda: [r.asDict() for r in tables.read_table(spark, f"{work}/03_enriched").orderBy("ord").collect()]
    assert [r["record_id"] for r in enriched()] == ["wos-00000", "wos-00002", "wos-00004"]
    assert {r["record_id"]: r["match_type"] for r in rows(f"{out}/dedup_removed.csv")} == {"wos-00001": "doi_exact", "wos-00003": "fuzzy_title"}
    assert [r["record_id"] for r in rows(f"{out}/prior_screened_removed.csv")] == ["wos-00005"]
    assert enriched()[1]["abstract"] == "Late abstract."
    assert enriched()[2]["abstract_source"] == "lookup"
    counts = json.load(open(f"{work}/pipeline_counts.json"))
    assert counts["identified_total"] - counts["duplicates_removed"] - counts["prior_screened_removed"] == counts["unique_after_dedup"] == 3

    marked = rows(f"{out}/dedup_removed.csv")
    marked[0]["restore"] = "x"
    with open(f"{out}/dedup_removed.csv", "w", newline="", encoding="utf-8") as f:
        writer = csv.DictWriter(f, marked[0].keys())
        writer.writeheader()
        writer.writerows(marked)
    run.apply()
    restored = [r["record_id"] for r in enriched()]
    assert restored == ["wos-00000", "wos-00002", "wos-00004", marked[0]["record_id"]]

    asked = run.requests().collect()
    assert {r.sample_idx for r in asked} == {0, 1, 2, 3, 4} and len(run.fingerprint()) == 64
    (tmp_path / "arrivals").mkdir()
    say = {"wos-00000": "T", "wos-00002": "F", "wos-00004": "T"}
    lines = [json.dumps({"job": r.job, "record_id": r.record_id, "sample_idx": r.sample_idx, "temperature": r.temperature, "raw": json.dumps({"eligible": say.get(r.record_id, "F"), "reason": "Off topic"})}) for r in asked]
    (tmp_path / "arrivals/a.json").write_text("\n".join(lines[:7] + lines[:2]))
    for name, part in (("b", lines[5:]), ("c", lines[:3])):
        collect_responses(spark, str(tmp_path / "arrivals"), f"{work}/responses", str(tmp_path / "state")).awaitTermination()
        (tmp_path / f"arrivals/{name}.json").write_text("\n".join(part))
    collect_responses(spark, str(tmp_path / "arrivals"), f"{work}/responses", str(tmp_path / "state")).awaitTermination()
    assert spark.read.parquet(f"{work}/responses").count() == len(asked) and run.requests().count() == 0
    run.screen()
    full = {r["record_id"]: r for r in rows(f"{out}/screening_results_full.csv")}
    assert full["wos-00000"]["eligible"] == "T" and full["wos-00002"]["reason_for_exclusion"] == "Off topic"
    assert {r["record_id"] for r in rows(f"{out}/eligible_for_fulltext.csv")} == {"wos-00000", "wos-00004"}
    assert "Identified: 6" in open(f"{out}/prisma_summary.txt").read()
    (tmp_path / "searches/one/validate/labels.csv").write_text("record_id,human_label\nwos-00000,T\nwos-00002,T\n")
    told = run.validate(second=ws.path("validate", "labels.csv"))
    assert (told["tp"], told["fn"], told["n"]) == (1, 1, 2)
    assert [r["record_id"] for r in rows(ws.path("validate", "false_excludes.csv"))] == ["wos-00002"]

    # labelled records of their own, one with a title alone, one that nobody answered
    more = tmp_path / "labels.csv"
    more.write_text("record_id,human_label,title,abstract\nx1,t,Alpha,\nx2,F,Beta,Some text\nx2,T,again,\nx3,?,none,\nx4,F,Gamma,y\n", encoding="utf-8")
    asked = run.validation_requests(str(more))
    assert {r.record_id for r in asked.collect()} == {"x1", "x2", "x4"}
    job = asked.first().job
    answers = [(j, x, i, 0.0, '{"eligible": "%s"}' % e) for j, e in ((job, "T"), ("another", "F")) for x in ("x1", "x2") for i in range(5)]
    spark.createDataFrame(answers, screening.RESPONSE).write.partitionBy("job").parquet(ws.path("validate", "responses"))
    told = run.validate(str(more))
    assert (told["tp"], told["fp"], told["no_verdict"]) == (1, 1, 1)
    full = rows(ws.path("validate", "validate_results.csv"))
    assert [(r["record_id"], r["outcome"]) for r in full] == [("x1", "true include"), ("x2", "FALSE INCLUDE"), ("x4", "no verdict")]
    assert len(full[0]) == 14 and "without verdict: 1" in open(ws.path("validate", "summary.txt")).read()
    assert run.validate(str(more), dry_run=True)["records"] == 3 and run.screen(dry_run=True)["requests"] == 15
    assert run.ask()["requests"] == 0

    # another prompt is another job: everything is asked again and no old reply counts
    before = run.fingerprint()
    (tmp_path / "searches/one/criteria.md").write_text(CRITERIA.replace("Include", "Only include"))
    assert run.fingerprint() != before
    again = run.ask()
    assert again == {"requests": 15, "fingerprint": run.fingerprint()}
    run.screen(archive=False)
    full = rows(f"{out}/screening_results_full.csv")
    assert len(full) == 4 and {(r["eligible"], r["total_samples"]) for r in full} == {("", "0")}
    assert sorted(r["needs_human_review"] for r in full) == ["missing abstract (not screened)", *["no parseable verdict"] * 3]
    (tmp_path / "searches/one/criteria.md").write_text(CRITERIA)
    assert run.ask()["requests"] == 0  # and the old job's replies are still there


def test_one_reply_a_sample(spark):
    said = [("j", "a", 0, 0.3, "x"), ("j", "a", 0, 0.3, "x"), ("j", "a", 0, 0.3, "b"), ("j", "a", 5, 0.0, "beyond"), ("j", "a", 1, None, None), ("k", "a", 2, 0.0, "other"), (None, "a", 2, 0.0, "none"), ("j", None, 0, 0.0, "who")]
    got = screening.answers(spark.createDataFrame(said, screening.RESPONSE), "j", 5)
    assert sorted((r.record_id, r.sample_idx, r.raw) for r in got.collect()) == [("a", 0, "b"), ("a", 1, None)]
    assert screening.answers(spark.createDataFrame([], screening.RESPONSE), "j", 5).count() == 0


def test_replies_again_after_a_restart(spark, tmp_path):
    """Deliveries that repeat, in one file, in a later file and after a restart, are told by the stream's state."""
    table, state, arrivals = str(tmp_path / "table"), str(tmp_path / "state"), tmp_path / "in"
    arrivals.mkdir()
    line = lambda j, r, i, raw: json.dumps({"job": j, "record_id": r, "sample_idx": i, "temperature": 0.0, "raw": raw})
    collect = lambda: collect_responses(spark, str(arrivals), table, state).awaitTermination()
    (arrivals / "a.json").write_text("\n".join([line("j", "a", 0, "1"), line("j", "a", 0, "1"), line("k", "a", 0, "2"), "{broken", line(None, "a", 0, "3")]))
    collect()
    (arrivals / "b.json").write_text("\n".join([line("j", "a", 0, "late"), line("j", "a", 1, "4")]))
    collect()
    collect()
    got = sorted((r.job, r.record_id, r.sample_idx, r.raw) for r in spark.read.parquet(table).collect())
    assert got == [("j", "a", 0, "1"), ("j", "a", 1, "4"), ("k", "a", 0, "2")]


def test_workspace(tmp_path, capsys):
    root = str(tmp_path)
    main(["prepare", root, "--search", "a"])
    main(["prepare", root, "--search", "b"])
    main(["searches", root])
    assert capsys.readouterr().out.split() == ["a", "*", "b"]
    with pytest.raises(SystemExit):
        main(["all", root])
    with pytest.raises(FileNotFoundError):
        Workspace(root, "c")
    told, reasons = parse_criteria(CRITERIA)
    assert told == "Include studies." and reasons == ["Off topic", "Insufficient information"]
    assert "- Off topic" in system_prompt(told, reasons)
    with pytest.raises(ValueError):
        parse_criteria("nothing")


@pytest.mark.parametrize("scheme", ["", "file://"])
def test_tables_are_replaced_in_one_step(spark, tmp_path, monkeypatch, scheme):
    path = f"{scheme}{tmp_path}/deep/table"
    assert tables.read_table(spark, path, "a long").count() == 0
    with pytest.raises(FileNotFoundError):
        tables.read_table(spark, path)
    assert tables.write_table(spark.range(5).toDF("a"), path) == 5
    old = tables.read_table(spark, path)
    assert tables.write_table(old.where("a > 2"), path) == 2  # from what it replaces
    assert sorted(r.a for r in tables.read_table(spark, path).collect()) == [3, 4] and old.count() == 5

    def dies(*_):
        raise OSError("lost")

    with monkeypatch.context() as m:
        m.setattr(tables.Table, "_point", dies)  # written in full, not named yet
        with pytest.raises(OSError, match="lost"):
            tables.write_table(spark.range(9).toDF("a"), path)
    assert tables.read_table(spark, path).count() == 2
    assert tables.write_table(spark.range(3).toDF("a").where("false"), path) == 0
    assert tables.read_table(spark, path, "a long").count() == 0
    versions = [f for f in (tmp_path / "deep/table").iterdir() if f.is_dir()]
    assert len(versions) == 2  # the current one and the one before
