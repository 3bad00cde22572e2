"""The stages of a screening run over a workspace: ``python -m litsieve.plans.screen STAGE ROOT``.

Stages before the reviewers' files and those after are never run in one go.
"""

from __future__ import annotations

import argparse
import glob
import hashlib
import os

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from litsieve.functions import text as T
from litsieve.operators import dedup, enrich, order, prior, review, screening, summary, validation
from litsieve.plans.workspace import Workspace, system_prompt
from litsieve.schema import COLUMNS
from litsieve.sources import exports, flow, tables

POSSIBLE = ["decision", "similarity", "keep_id", "keep_title", "keep_year", "keep_source", "drop_if_merged_id", "drop_if_merged_title", "drop_if_merged_year", "drop_if_merged_source"]
REMOVED = ["restore", *dedup.REMOVED, *COLUMNS]
PRIOR = ["restore", *prior.CONTEXT, *COLUMNS]
CACHE = "doi string, text string, source string, status string"
STAGES = ("ingest", "dedup", "prior", "enrich", "clean", "apply", "ask", "screen", "validate", "archive")


class Screening:
    """One search's run.  ``lookups`` are (name, table of doi and text); responses are a table (``screening.RESPONSE``) that
    whatever asks the model has written, partitioned by the job that asked."""

    def __init__(self, spark: SparkSession, workspace: Workspace, lookups: list[tuple[str, DataFrame]] | None = None):
        self.spark, self.ws, self.lookups = spark, workspace, lookups or []

    def _records(self, name: str) -> DataFrame:
        return tables.read_table(self.spark, self.ws.path("work", name))

    def _count(self, **counts: int) -> dict:
        return tables.merge_ledger(self.ws.path("work", "pipeline_counts.json"), counts)

    def _review(self, name: str) -> DataFrame:
        return tables.read_csv(self.spark, self.ws.path("outputs", name))

    def ingest(self) -> None:
        n = tables.write_records(exports.read_exports(self.spark, self.ws.path("inputs")), self.ws.path("work", "01_ingested"))
        by_source = summary.per_source(self._records("01_ingested"))
        self._count(identified_total=n, identified_per_source={r[0]: r[1] for r in by_source.collect()})

    def dedup(self) -> None:
        unique, removed, possible = dedup.deduplicate(self._records("01_ingested"), **self.ws.config["dedup"])
        kept = tables.write_records(unique, self.ws.path("work", "02_deduplicated"))
        gone = tables.write_csv(removed.withColumn("restore", F.lit("")), self.ws.path("outputs", "dedup_removed.csv"), REMOVED)
        near = tables.write_csv(possible, self.ws.path("outputs", "dedup_possible_duplicates.csv"), POSSIBLE)
        self._count(duplicates_removed=gone, unique_after_dedup=kept, dedup_possible_duplicates=near)

    def prior(self) -> None:
        settings = self.ws.config["prior"]
        paths = sorted({p for g in settings["patterns"] for p in glob.glob(self.ws.path("prior_screened", g)) if os.path.isfile(p)})
        records = self._records("02_deduplicated")
        out = self.ws.path("outputs", "prior_screened_removed.csv")
        if not settings["enabled"] or not paths:
            tables.write_csv(records.where("false").withColumns({c: F.lit("") for c in PRIOR[:6]}), out, PRIOR)
            return
        parts = [prior.prior_list(tables.read_csv(self.spark, p).withColumn("ord", F.col("ord") + (i << 32))) for i, p in enumerate(paths)]
        listed = parts[0]
        for part in parts[1:]:
            listed = listed.unionByName(part)
        keys = {k: self.ws.config["dedup"][k] for k in ("threshold", "years", "author")}
        left, removed = prior.remove_prior(records, listed, **keys)
        gone = tables.write_csv(removed.withColumn("restore", F.lit("")), out, PRIOR)
        n = tables.write_records(left, self.ws.path("work", "02_deduplicated"))
        self._count(prior_screened_list=listed.count(), prior_screened_removed=gone, unique_after_dedup=n)

    def _enriched(self, records: DataFrame) -> None:
        path = self.ws.path("work", "abstract_cache")
        cache = tables.read_table(self.spark, path, CACHE)
        out, grown = enrich.backfill(records, cache, self.lookups)
        tables.write_records(out, self.ws.path("work", "03_enriched"))
        tables.write_table(grown, path)
        out = self._records("03_enriched")
        missing = tables.write_csv(out.where("abstract is null"), self.ws.path("outputs", "missing_abstracts.csv"), COLUMNS)
        filled = out.join(records.select("record_id", F.col("abstract").alias("old")), "record_id").where("abstract is not null and not abstract <=> old").count()
        self._count(abstracts_backfilled=filled, missing_abstract=missing)

    def enrich(self) -> None:
        self._enriched(self._records("02_deduplicated"))

    def clean(self) -> None:
        for stage in (self.ingest, self.dedup, self.prior, self.enrich):
            stage()

    def apply(self) -> None:
        records = self._records("03_enriched")
        possible, removed = self._review("dedup_possible_duplicates.csv"), self._review("dedup_removed.csv")
        from_prior, typed = self._review("prior_screened_removed.csv"), self._review("missing_abstracts.csv")
        done, audit, counts = review.apply_decisions(records, possible.withColumn("similarity", F.col("similarity").try_cast("double")), _typed(removed), _typed(from_prior), typed)
        told = {k: v.first()[0] for k, v in counts.items()}
        if not sum(v for k, v in told.items() if k != "undecided"):
            return
        more = removed.select("ord", *REMOVED).unionByName(audit.withColumn("ord", F.lit(1 << 40)).select("ord", *(F.col(c).cast("string") for c in REMOVED)))
        done = done.withColumn("ord", F.struct("rank", "ord"))
        place = order.positions(done.select("record_id", (F.col("ord.rank") * (1 << 40) + F.col("ord.ord")).alias("key")), "key", "ord")
        done = done.drop("ord", "rank").join(place.select("record_id", "ord"), "record_id")
        n = tables.write_records(done, self.ws.path("work", "02_deduplicated"))
        tables.write_csv(more, self.ws.path("outputs", "dedup_removed.csv"), REMOVED)
        self._count(unique_after_dedup=n, **told)
        self._enriched(self._records("02_deduplicated"))

    def _answers(self, folder: str, job: str) -> DataFrame:
        """What the responses in ``folder`` say to ``job``; only its partition is read."""
        path = self.ws.path(folder, "responses")
        there = os.path.isdir(path)
        told = self.spark.read.schema(screening.RESPONSE).parquet(path) if there else self.spark.createDataFrame([], screening.RESPONSE)
        return screening.answers(told, job, self.ws.config["screening"]["samples"])

    def _asked(self, records: DataFrame, folder: str) -> DataFrame:
        """What to ask of ``records`` that the job's responses in ``folder`` do not answer yet; each request names the job."""
        settings = self.ws.config["screening"]
        asked = screening.expand(records, settings["temperatures"], settings["samples"], settings["chunk"])
        content = T.user_content(F.col("authors"), F.col("year"), F.col("title"), F.col("abstract"))
        job = self.fingerprint(records)
        asked = asked.select(F.lit(job).alias("job"), "record_id", "sample_idx", "temperature", "chunk", content.alias("content"))
        return screening.outstanding(asked, self._answers(folder, job))

    def _askable(self) -> DataFrame:
        records = self._records("03_enriched")
        return records if self.ws.config["screening"]["missing_abstract"] == "screen" else records.where("abstract is not null")

    def requests(self) -> DataFrame:
        """What to ask the model: one row per record and sample that has no response yet."""
        return self._asked(self._askable(), "work")

    def labelled(self, labels: str | None = None) -> DataFrame:
        return validation.labelled_records(tables.read_csv(self.spark, labels or self.ws.path("validate", "labels.csv")))

    def validation_requests(self, labels: str | None = None) -> DataFrame:
        """What to ask about the labelled records; their responses go to ``validate/responses``."""
        return self._asked(self.labelled(labels).drop("human_label"), "validate")

    def estimate(self, records: DataFrame | None = None) -> dict:
        """What asking about ``records`` would cost (default: those that a screening asks about)."""
        config = self.ws.config
        s, cache = config["screening"], config["prompt_cache"]
        rows = self._askable() if records is None else records
        content = T.user_content(F.col("authors"), F.col("year"), F.col("title"), F.col("abstract")).alias("content")
        prompt = max(1, len(system_prompt(*self.ws.criteria())) // 4)
        return screening.cost_estimate(rows.select(content), prompt, s["samples"], config["rates"], s["chunk"], caching=cache["enabled"], floor=cache["floor"]).first().asDict()

    def fingerprint(self, records: DataFrame | None = None) -> str:
        """Names a job: changes with the model, the temperatures, the prompt or the records asked about (default: those of a screening)."""
        s = self.ws.config["screening"]
        hashes = (F.xxhash64("record_id"), F.xxhash64(F.lit("again"), "record_id"))
        ids = (self._askable() if records is None else records).agg(F.count("*"), *(F.bit_xor(h) for h in hashes), *(F.sum(h.cast("decimal(38,0)")) for h in hashes)).first()
        parts = [self.ws.config["model"], repr([(s["temperatures"] or [0.0])[i % len(s["temperatures"] or [0.0])] for i in range(s["samples"])]), system_prompt(*self.ws.criteria()), repr([str(v) for v in ids])]
        return hashlib.sha256("\0".join(parts).encode()).hexdigest()

    def _votes(self, raw: DataFrame) -> tuple[DataFrame, DataFrame]:
        """(samples, votes) of responses."""
        s = self.ws.config["screening"]
        samples = screening.parse_replies(raw.withColumn("said", F.col("raw")), self.ws.criteria()[1]).drop("raw").withColumnRenamed("said", "raw")
        return samples, screening.vote(samples, s["agreement"], s["insufficient"], s["min_valid"])

    def screen(self, archive: bool = True, dry_run: bool = False) -> dict | None:
        """Votes, results and reports of the responses; a dry run only tells what asking would cost."""
        if dry_run:
            return self.estimate()
        config = self.ws.config
        s = config["screening"]
        samples, votes = self._votes(self._answers("work", self.fingerprint()))
        made = screening.assemble(self._records("03_enriched"), votes, s["insufficient"], (config["audit"]["size"], config["audit"]["seed"]), s["missing_abstract"])
        told = tables.write_counted(made, self.ws.path("work", "04_screening_results"), *summary.screened())
        results = self._records("04_screening_results")
        out = lambda name: self.ws.path("outputs", name)
        tables.write_csv(results, out("screening_results_full.csv"), screening.RESULT)
        tables.write_csv(results.where("eligible = 'T' and needs_human_review = ''"), out("eligible_for_fulltext.csv"), screening.RESULT)
        tables.write_csv(results.where("review_ord is not null"), out("needs_human_review.csv"), screening.RESULT, "review_ord")
        tables.write_audit(samples, results, self.ws.path("work", "04_raw_samples"), config["model"])
        counts = self._count(**{k: v for k, v in told.items() if k != "n"})
        histogram = [(r.reason, r.n) for r in summary.reasons(results).orderBy(F.desc("n"), "first").collect()]
        with open(out("prisma_summary.txt"), "w", encoding="utf-8") as f:
            told = counts | {"model": config["model"], "samples": s["samples"]}
            f.write(summary.report(told, list(counts.get("identified_per_source", {}).items()), histogram))
        template = self.ws.path("flow_template.csv")
        if os.path.exists(template):
            by_source = self.spark.createDataFrame([*counts.get("identified_per_source", {}).items()], "name string, n long")
            flow.write_flow(flow.fill(flow.read_template(self.spark, template), counts, by_source, summary.reasons(results)), out("flow.csv"))
        if archive:
            self.ws.archive(counts)

    def validate(self, labels: str | None = None, second: str | None = None, dry_run: bool = False) -> dict:
        """The labelled records' own verdicts against their labels, and kappa if a second rater's are given.

        Responses are those of ``validate/responses`` to this job; where there are none, those of the screening's job.
        """
        labelled = self.labelled(labels)
        if dry_run:
            return self.estimate(labelled)
        s = self.ws.config["screening"]
        raw = self._answers("validate", self.fingerprint(labelled.drop("human_label")))
        if not raw.limit(1).count():
            raw = self._answers("work", self.fingerprint())
        samples, votes = self._votes(raw.join(labelled.select("record_id"), "record_id", "left_semi"))
        path = self.ws.path("validate", "results")
        tables.write_table(validation.validated(labelled, votes, s["insufficient"]), path)
        rows = tables.read_table(self.spark, path)
        for name, kind in (("validate_results", None), ("false_excludes", "FALSE EXCLUDE"), ("false_includes", "FALSE INCLUDE")):
            tables.write_csv(rows if kind is None else rows.where(F.col("outcome") == kind), self.ws.path("validate", f"{name}.csv"), validation.RESULT)
        tables.write_audit(samples, rows, self.ws.path("validate", "validate_raw_samples"), self.ws.config["model"], ("human_label",))
        out = validation.confusion(rows).first().asDict()
        if second:
            mine = labelled.select("record_id", "human_label")
            out |= validation.kappa(mine, validation.usable_labels(tables.read_csv(self.spark, second), last=True)).first().asDict()
        with open(self.ws.path("validate", "summary.txt"), "w", encoding="utf-8") as f:
            f.write(summary.agreement_report(out))
        return out

    def ask(self) -> dict:
        """Write the open requests as JSON lines to ``work/requests``; how many there are, and the job's fingerprint, which every reply has to carry."""
        path = self.ws.path("work", "requests")
        self.requests().write.mode("overwrite").json(path)
        asked = self.spark.read.schema("record_id string, sample_idx int").json(path).count()
        return {"requests": asked, "fingerprint": self.fingerprint()}

    def archive(self) -> None:
        self.ws.archive(self._count())


def _typed(rows: DataFrame) -> DataFrame:
    """Review rows with the record columns as their types."""
    from litsieve.schema import from_cells

    return from_cells(rows).join(rows.select("ord", "restore"), "ord")


def main(args: list[str] | None = None) -> None:
    parser = argparse.ArgumentParser(prog="litsieve")
    parser.add_argument("stage", choices=[*STAGES, "prepare", "searches", "restore", "all"])
    parser.add_argument("root")
    parser.add_argument("--search")
    parser.add_argument("--no-archive", action="store_true")
    parser.add_argument("--dry-run", action="store_true", help="screen, validate: what asking would cost, no more")
    parser.add_argument("--labels", help="validate: the labels, if not validate/labels.csv")
    parser.add_argument("--labels2", help="validate: a second rater's labels")
    given = parser.parse_args(args)
    if given.stage == "all":
        parser.error("people look at the review files between clean and screen: run clean, edit, apply, screen")
    if given.stage == "prepare":
        Workspace.create(given.root, given.search or "search")
        return
    if given.stage == "searches":
        active = Workspace(given.root).name if Workspace.searches(given.root) else ""
        for name in Workspace.searches(given.root):
            print("*" if name == active else " ", name)
        return
    spark = SparkSession.builder.config("spark.sql.session.timeZone", "UTC").getOrCreate()
    run = Screening(spark, Workspace(given.root, given.search))
    if spark.sparkContext.getCheckpointDir() is None:  # the session names none: beside the tables, which executors share too
        spark.sparkContext.setCheckpointDir(run.ws.path("work", "checkpoints"))
    stage = "apply" if given.stage == "restore" else given.stage
    options = {"screen": {"archive": not given.no_archive, "dry_run": given.dry_run}, "validate": {"labels": given.labels, "second": given.labels2, "dry_run": given.dry_run}}
    print(getattr(run, stage)(**options.get(stage, {})) or "")


if __name__ == "__main__":
    main()
