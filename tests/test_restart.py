"""One call per business and one run of a stage, whatever fails in between."""

import collections
import json
import pathlib
import subprocess
import sys
import textwrap

import pytest
from pyspark.sql import functions as F

from catalog import fixtures
from mainstreet.operators import answers, responses, site
from mainstreet.plans import stages
from mainstreet.sources import tables

ANSWER = json.dumps({"business": None, "seo": {"title": "t"}})


def counting(folder, stop=None):
    """A model that notes its calls; ``stop`` names a business at which its process ends for the first time."""
    folder, mark = str(folder), str(folder) + ".stopped"

    def model(row):
        import os
        import uuid

        if row["business_id"] == stop and not os.path.exists(mark):
            open(mark, "w").close()
            raise SystemExit("lost")
        with open(f"{folder}/{uuid.uuid4().hex}", "w") as file:
            file.write(row["business_id"])
        return f"answer {row['business_id']}"

    return model


def calls(folder):
    return collections.Counter(p.read_text() for p in pathlib.Path(folder).iterdir())


def _prompts(spark, n=60):
    ids = F.format_string("b%03d", F.col("id"))
    return spark.range(n).select(F.col("id").alias("pos"), ids.alias("business_id"), F.concat(F.lit("about "), ids).alias("prompt"))


@pytest.fixture
def noted(tmp_path):
    (tmp_path / "calls").mkdir()
    return tmp_path / "calls"


def test_a_second_run_asks_the_rest_only(spark, tmp_path, noted, monkeypatch):
    monkeypatch.setattr(answers, "LOT", 1)
    prompts, log = _prompts(spark), str(tmp_path / "log")
    with pytest.raises(Exception):
        answers.answers(prompts, counting(noted, "b040"), 2, log).collect()
    before = calls(noted)
    assert 0 < len(before) < 60
    rows = answers.answers(prompts, counting(noted, "b040"), 3, log).collect()
    assert sorted((r.pos, r.business_id, r.response, r.problem) for r in rows) == [(i, f"b{i:03d}", f"answer b{i:03d}", None) for i in range(60)]
    assert calls(noted) == {f"b{i:03d}": 1 for i in range(60)}
    # with all answers logged nobody is asked; another prompt is another question
    assert len(answers.answers(prompts, counting(noted), 3, log).collect()) == 60
    other = prompts.withColumn("prompt", F.when(F.col("pos") < 3, "other").otherwise(F.col("prompt")))
    assert len(answers.answers(other, counting(noted), 3, log).collect()) == 60
    assert calls(noted) == {f"b{i:03d}": 2 if i < 3 else 1 for i in range(60)}


def test_odd_questions(spark, tmp_path, noted):
    rows = [(1, "a", "p"), (2, "a", "p"), (3, None, "p"), (4, None, None), (5, "b", "q"), (6, "b", "r"), (7, "", "")]
    prompts = spark.createDataFrame([(*r, "x") for r in rows], "pos long, business_id string, prompt string, response string")
    folder = str(noted)

    def model(row):
        import uuid

        if row["prompt"] == "r":
            raise ValueError("no answer")
        with open(f"{folder}/{uuid.uuid4().hex}", "w") as file:
            file.write(str(row["business_id"]))
        return row["response"] + str(row["prompt"])

    log = str(tmp_path / "log")
    for _ in range(2):
        got = {r.pos: (r.response, r.problem) for r in answers.answers(prompts, model, 2, log).collect()}
        assert got == {1: ("xp", None), 2: ("xp", None), 3: ("xp", None), 4: ("xNone", None), 5: ("xq", None), 6: (None, "no answer"), 7: ("x", None)}
    assert calls(noted) == {"a": 1, "None": 2, "b": 1, "": 1}
    assert answers.answers(prompts.limit(0), model, 2, str(tmp_path / "none")).count() == 0


def test_a_task_that_is_lost_goes_on(tmp_path, noted):
    """Spark repeats a lost task here, as on a cluster; the repeated one reads what the first one was told."""
    script = f"""
        import sys
        sys.path[:0] = [{str(pathlib.Path(__file__).parents[1])!r}, {str(pathlib.Path(__file__).parent)!r}]
        from pyspark.sql import SparkSession
        from mainstreet.operators import answers
        import test_restart
        spark = (SparkSession.builder.master("local[2,4]").config("spark.ui.enabled", "false")
                 .config("spark.checkpoint.dir", {str(tmp_path / "shared")!r}).getOrCreate())
        answers.LOT = 1
        made = answers.answers(test_restart._prompts(spark), test_restart.counting({str(noted)!r}, "b040"), 2, {str(tmp_path / "log")!r})
        print("rows", made.where("response = concat('answer ', business_id)").count())
    """
    done = subprocess.run([sys.executable, "-c", textwrap.dedent(script)], capture_output=True, text=True, timeout=300)
    assert "rows 60" in done.stdout, done.stderr[-2000:]
    assert pathlib.Path(str(noted) + ".stopped").exists()
    assert calls(noted) == {f"b{i:03d}": 1 for i in range(60)}


def _page_model(folder):
    folder = str(folder)

    def model(row):
        import json
        import uuid

        with open(f"{folder}/{uuid.uuid4().hex}", "w") as file:
            file.write(row["business_id"])
        words = "word " * 60
        return json.dumps({
            "business": {k: row[k] for k in ("business_id", "name", "category", "address", "city", "state", "zip_code", "phone", "website", "email")},
            "seo": {"title": row["name"] + " of " + row["city"], "meta_description": words[:100], "h1": "Heading of it", "slug": row["page_slug"], "keywords": ["one"]},
            "content": {"introduction": words, "main_content": words, "conclusion": words},
            "jsonld": {"name": row["name"], "address": {"a": "b"}}, "internal_links": [],
        })

    return model


def test_a_run_goes_on_at_the_stage_that_failed(spark, sf, tmp_path, noted, monkeypatch):
    source = tables.write_businesses_csv(fixtures.businesses(spark, sf), str(tmp_path / "in"))
    out = str(tmp_path / "out")
    model = _page_model(noted)

    def run(execution="r1", **more):
        return stages.run_stages(spark, source, out, execution, generate=model, day="2024-06-01", multi_line=True, wait=0.01, **more)

    def broken(*args):
        raise RuntimeError("render is down")

    with monkeypatch.context() as patch:
        patch.setattr(site, "render_route", broken)
        with pytest.raises(RuntimeError):
            run()
    asked = calls(noted)
    assert asked and set(asked.values()) == {1}
    made = {p: p.stat().st_mtime_ns for p in pathlib.Path(out, "generated_pages").rglob("*.parquet")}

    with monkeypatch.context() as patch:
        patch.setattr(responses, "generate_pages", broken)
        tables_made = run()
    assert calls(noted) == asked
    assert {p: p.stat().st_mtime_ns for p in pathlib.Path(out, "generated_pages").rglob("*.parquet")} == made
    n = tables_made["businesses"].count()
    assert n == len(asked) == tables_made["rendered_pages"].count() == tables_made["generated_pages"].count()
    assert tables_made["status"].first().stage == "publish"

    # nothing has changed: every stage is taken as it is
    with monkeypatch.context() as patch:
        for name in ("render_route", "sitemap_files", "site_metadata"):
            patch.setattr(site, name, broken)
        assert run()["rendered_pages"].count() == n
        # another address changes the sitemap, so the last stages are made anew
        with pytest.raises(RuntimeError):
            run(base_url="https://example.org")
    # another execution asks for itself
    run("r2")
    assert set(calls(noted).values()) == {2}


def test_a_stage_is_tried_again(spark, tmp_path):
    run = stages._Run(spark, str(tmp_path), "r", 0.01)
    tries = []

    def plan():
        tries.append(1)
        bad = F.raise_error(F.lit("lost")) if len(tries) < 3 else F.lit("x")
        return spark.range(3).select("id", bad.alias("v"))

    assert run.stage("t", [], plan).count() == 3 and len(tries) == 3
    tries.clear()
    assert run.stage("t", [], plan).count() == 3 and not tries
    with pytest.raises(Exception, match="nowhere"):
        run.stage("u", [], lambda: tries.append(1) or spark.range(1).select("nowhere"))
    assert len(tries) == 1
