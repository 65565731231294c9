"""The whole run: ingest, generate, gate, quality control, render, publish.

Each stage is one lazy plan that ends in a table below ``out``, in the folder of its execution.
The next stage reads that table, so a lost executor costs tasks and never a stage. A stage that is
done leaves a mark with a fingerprint of what it was made from. When an execution is started again,
stages with the same fingerprint are taken as they are and the run goes on at the one that failed.
Answers of a model are logged as they come, so a business is asked once.
"""

import datetime
import hashlib
import json
import time
import uuid

from py4j.protocol import Py4JJavaError
from pyspark.errors import AnalysisException, PySparkException
from pyspark.sql import functions as F

from mainstreet.functions import checks
from mainstreet.operators import cleaning, linking, quality, responses, site
from mainstreet.operators.content import with_checks
from mainstreet.operators.shuffles import number_rows
from mainstreet.plans.workspace import materialise
from mainstreet.sources import folders, stores, tables

c = F.col


class NothingGenerated(RuntimeError):
    """No business got a page, so the run stops before quality control."""


def rule_feedback(pages):
    """Stand-in for a reviewer: the share of passed checks and their names."""
    checked = pages if "seo_results" in pages.columns else with_checks(pages)
    done = checked.withColumn("results", F.map_concat("seo_results", "content_results"))
    names = F.map_keys("results")
    passed = F.filter(names, lambda n: c("results")[n])
    rated = done.select(
        "business_id",
        "page_pos",
        passed.alias("passed_checks"),
        F.filter(names, lambda n: ~c("results")[n]).alias("failed_checks"),
        checks.suggest_improvements(c("seo_results"), c("content_results")).alias("suggestions"),
    )
    share = F.size("passed_checks") / (F.size("passed_checks") + F.size("failed_checks"))
    return rated.withColumns(
        {"quality_score": share, "retry_count": F.lit(0), "needs_regeneration": share < 0.5}
    )


# Further attempts of a stage, seconds before the first one, and their growth.
RETRIES, WAIT, BACKOFF = 3, 2.0, 2.0


def _named(fn):
    """A function as part of a fingerprint."""
    return None if fn is None else f"{fn.__module__}.{fn.__qualname__}"


class _Run:
    def __init__(self, spark, out, execution_id, wait):
        self.spark, self.out, self.execution_id, self.wait = spark, out, execution_id, wait
        self.started = datetime.datetime.now(datetime.timezone.utc).replace(tzinfo=None)
        self.done = {}  # stage: the name of its result, another one each time it is made

    def path(self, stage):
        return f"{self.out}/{stage}/execution_id={self.execution_id}"

    def _attempts(self, work):
        """Spark's failures are worth another attempt, a plan that does not resolve is not."""
        for turn in range(RETRIES + 1):
            try:
                return work()
            except (PySparkException, Py4JJavaError) as problem:
                if turn == RETRIES or isinstance(problem, AnalysisException):
                    raise
                time.sleep(self.wait * BACKOFF**turn)

    def stage(self, stage, made_from, plan, write=tables.save_result):
        """The table of a stage: as it is if its mark says that it was made from the same, else made by ``plan()``.

        ``made_from`` names earlier stages and other values. The mark lies in the folder of the
        table and goes when that is written anew.
        """
        parts = [self.done.get(p, p) if isinstance(p, str) else p for p in made_from]
        fingerprint = hashlib.sha256(json.dumps([stage, parts], default=str).encode()).hexdigest()
        mark = f"{self.path(stage)}/_made_from"
        known = json.loads(folders.read_note(self.spark, mark) or "{}")
        if known.get("fingerprint") != fingerprint:
            self._attempts(lambda: write(plan(), self.path(stage)))
            known = {"fingerprint": fingerprint, "name": uuid.uuid4().hex}
            folders.write_note(self.spark, mark, json.dumps(known))
        self.done[stage] = known["name"]
        return None if write is tables.write_pages else self.spark.read.parquet(self.path(stage))

    def status(self, no, stage, total, ok, errors=()):
        now = datetime.datetime.now(datetime.timezone.utc).replace(tzinfo=None)
        row = (self.execution_id, no, stage, total, ok, total - ok, self.started, now, list(errors))
        line = self.spark.createDataFrame(
            [row],
            "execution_id string, stage_no int, stage string, total_businesses long, successful_pages long, "
            "failed_pages long, start_time timestamp, updated_at timestamp, errors array<string>",
        )
        stores.append_status(line, f"{self.out}/status")


def run_stages(spark, source, out, execution_id, generate=None, review=rule_feedback, day=None,
               base_url="https://example.com", multi_line=False, wait=WAIT):
    """Run all stages on the listings at ``source`` and return their tables by name.

    ``multi_line`` is for CSV listings with line breaks inside quotes; see ``tables.read_businesses``.
    A stage that Spark fails to run is tried again after ``wait`` seconds, then after longer. A second call
    with the same ``out`` and ``execution_id`` goes on where the first one stopped: it makes those
    stages anew whose input files, parameters or earlier stages have changed.
    """
    run = _Run(spark, out, execution_id, wait)
    day = day or datetime.date.today().isoformat()

    files = folders.data_files(spark, source)
    checked = run.stage(
        "checked", [files, multi_line], lambda: cleaning.ingest(number_rows(tables.read_businesses(spark, source, multi_line)))
    )
    good, rejected = cleaning.split_valid(checked)
    businesses = run.stage("businesses", ["checked"], lambda: good.withColumnRenamed("row_idx", "pos"))
    counts = tables.stage_summary(checked, F.size("errors") == 0).first()
    # at most ten messages
    messages = [row.message for row in cleaning.first_errors(rejected).collect()]
    run.status(1, "ingest", counts.total, counts.successful, messages)

    log = run.path("answers") if generate else None
    pages = run.stage(
        "generated_pages", ["businesses", _named(generate)],
        lambda: responses.generate_pages(linking.related_links(businesses), generate, log=log),
    )
    counts = tables.stage_summary(pages, c("generation_successful")).first()
    run.status(2, "generate", counts.total, counts.successful)
    if counts.successful == 0:
        raise NothingGenerated(f"All {counts.total} content generation attempts failed")

    def reviewed():
        # the rules' own review reads the checks that the routing needs; any other reviewer gets the pages as they are
        judged = materialise(quality.judged_pages(pages)) if review is rule_feedback else pages
        return quality.qc_route(judged, review(judged.where("generation_successful")), on=("business_id", "page_pos"))

    qc = run.stage("qc_results", ["generated_pages", _named(review)], reviewed)
    counts = quality.qc_summary(qc).first()
    run.status(3, "qc", counts.total_pages, counts.successful_qc)

    def scored():
        return site.join_qc(pages.drop("quality_score"), qc.withColumn("qc_pos", c("page_pos")))

    def shown():
        made = site.render_pages(scored().where("generation_successful"), base_url)
        return made.select(site.page_path(c("seo.slug")).alias("path"), c("html").alias("body"))

    rendered = run.stage("rendered_pages", ["generated_pages", "qc_results"], lambda: site.render_route(scored()))
    run.stage("pages", ["generated_pages", "qc_results", [base_url]], shown, tables.write_pages)
    counts = tables.stage_summary(rendered, c("render_successful")).first()
    run.status(4, "render", counts.total, counts.successful)

    made = {
        "sitemap": lambda: site.sitemap_files(site.sitemap_basic(rendered, base_url, day)),
        "index_cards": lambda: site.index_cards(rendered),
        "site_metadata": lambda: site.site_metadata(rendered),
        "execution_report": lambda: site.execution_report(rendered, execution_id),
    }
    out_tables = {
        "businesses": businesses,
        "rejected": rejected,
        "generated_pages": pages,
        "qc_results": qc,
        "rendered_pages": rendered,
        **{name: run.stage(name, ["rendered_pages", [base_url, day]], plan) for name, plan in made.items()},
    }
    run.status(5, "publish", counts.total, counts.successful)
    return {**out_tables, "status": stores.read_status(spark, f"{out}/status")}
