"""Files in and out, and the staged run."""

import json

import pytest
from pyspark.sql import functions as F

from catalog import fixtures
from mainstreet import schemas
from mainstreet.operators import quality, site
from mainstreet.plans import stages, workspace
from mainstreet.sources import folders, tables

c = F.col
HEADER = ",".join(schemas.BUSINESS_COLUMNS)


def _listing(path, *rows, header=HEADER):
    path.write_text("\n".join([header, *rows]) + "\n", encoding="utf-8")
    return str(path)


def test_csv_keeps_zips_and_quoted_breaks(spark, tmp_path):
    path = _listing(
        tmp_path / "a.csv", 'b1,"Joe, ""the"" Baker",Bakery,12 Main Street,Rome,NY,01234,,,,"two\nlines",4.5,7'
    )
    row = tables.read_businesses(spark, path, multi_line=True).first()
    assert (row.name, row.zip_code, row.description, row.rating) == ('Joe, "the" Baker', "01234", "two\nlines", "4.5")


def test_other_layout_is_matched_by_name(spark, tmp_path):
    path = _listing(
        tmp_path / "b.csv",
        '"b1","Joe","Bakery","12 Main Street","Rome","IL","62701","2175550123","https://x.com","Bread","Dine-in, Takeout"',
        header="business_id,name,category,address,city,state,zip_code,phone,website,description,services",
    )
    df = tables.read_businesses(spark, path)
    assert df.columns == schemas.BUSINESS_COLUMNS
    assert (df.first().description, df.first().email, df.first().rating) == ("Bread", None, None)


def test_json_listing(spark, tmp_path):
    path = tmp_path / "c.json"
    path.write_text(json.dumps([{n: "x" for n in schemas.REQUIRED_COLUMNS} | {"rating": 4.5}]))
    assert tables.read_businesses(spark, str(path)).first().rating == "4.5"


def test_missing_column_stops(spark, tmp_path):
    path = _listing(tmp_path / "d.csv", "b1,Joe", header="business_id,name")
    with pytest.raises(ValueError, match="category"):
        tables.read_businesses(spark, path)


def test_malformed_document_becomes_nulls(spark, tmp_path):
    (tmp_path / "good.json").write_text('{"a": 1, "b": "x"}')
    (tmp_path / "bad.json").write_text('{"a": 1, "b": "x"')
    rows = tables.read_docs(spark, str(tmp_path), "a long, b string").orderBy("a").collect()
    assert [(r.a, r.b) for r in rows] == [(None, None), (1, "x")]
    assert rows[0]._corrupt


def test_both_forms_of_an_envelope(spark, tmp_path):
    doc = {"day": "2024-06-01", "total": 50, "rows": [{"id": f"b{i}", "city": None if i % 7 == 0 else "é\n"} for i in range(50)]}
    (tmp_path / "doc.json").write_text(json.dumps(doc))
    schema, row = "day string, total int, rows array<struct<id:string,city:string>>", "id string, city string"
    one = tables.explode_rows(tables.read_docs(spark, str(tmp_path / "doc.json"), schema), "rows", keep=["day", "total"])
    path = tables.split_envelope(spark, str(tmp_path / "doc.json"), str(tmp_path / "out"), schema, "rows", tasks=6)
    spark.conf.set("spark.sql.files.openCostInBytes", str(64 << 20))
    try:
        many = tables.read_envelope(spark, path, row, "day string, total int")
        assert many.columns == one.columns and many.rdd.getNumPartitions() == 6 and one.rdd.getNumPartitions() == 1
        assert sorted(map(tuple, many.collect()), key=str) == sorted(map(tuple, one.collect()), key=str)
    finally:
        spark.conf.unset("spark.sql.files.openCostInBytes")
    assert tables.read_envelope(spark, path, row).columns == ["pos", "id", "city"]
    (tmp_path / "bad.json").write_text("{")
    empty = tables.split_envelope(spark, str(tmp_path / "bad.json"), str(tmp_path / "none"), schema, "rows")
    assert tables.read_envelope(spark, empty, row, "day string").count() == 0


def test_synthetic(spark):
    rows = tables.synthetic_businesses(spark).collect()
    assert len(rows) == 25 and rows[0].business_id == "biz_001"
    assert {sum(r.category == k for r in rows) for k in {r.category for r in rows}} == {5}
    assert all(3 <= r.rating < 5 and 10 <= r.review_count < 300 for r in rows)


def test_page_leaves_out_what_is_missing_and_escapes(spark, sf):
    pages = fixtures.page_specs(spark, sf).drop("quality_score").withColumn("quality_score", F.lit(0.85))
    rows = site.render_pages(pages).select("html", "business", "seo", "jsonld").collect()
    for row in rows:
        assert row.html.startswith("<!DOCTYPE html>") and row.html.endswith("</html>")
        assert ('href="tel:' in row.html) == (row.business.phone is not None)
        assert ('href="mailto:' in row.html) == (row.business.email is not None)
        assert ("ld+json" in row.html) == (row.jsonld is not None)
        assert "Mario's" not in row.html.split("</script>")[-1]
        assert 'class="badge green">Quality: 85.0%' in row.html


def test_jsonld_rating_block(spark):
    fields = "name string, description string, website string, phone string, email string, address string, city string, state string, zip_code string, rating double, review_count int"
    rows = [("A", None, None, None, None, "s", "c", "st", "z", 4.5, None), ("B", "d", "w", "p", "e", "s", "c", "st", "z", None, 3)]
    a, b = (json.loads(r.j) for r in spark.createDataFrame(rows, fields).select(site.jsonld(F.lit("meta")).alias("j")).collect())
    assert a["aggregateRating"]["ratingValue"] == "4.5" and a["aggregateRating"]["reviewCount"] == "1"
    assert a["description"] == "meta" and "telephone" not in a
    assert "aggregateRating" not in b and b["description"] == "d"


def test_reports_of_nothing(spark, sf):
    none = fixtures.rendered(spark, sf).where("false")
    report = site.execution_report(none).first()
    assert (report.overall_status, report.success_rate) == ("success", 0.0)
    assert report.quality_analysis.message == "No quality scores available for analysis"
    assert report.recommendations[0].startswith("Low success rate")


def test_run(spark, sf, tmp_path):
    source = tables.write_businesses_csv(fixtures.businesses(spark, sf), str(tmp_path / "in"))
    out = stages.run_stages(spark, source, str(tmp_path / "out"), "r1", day="2024-06-01", multi_line=True)
    n = {name: df.count() for name, df in out.items()}
    assert n["businesses"] + n["rejected"] == 150
    assert n["generated_pages"] == n["businesses"] == n["rendered_pages"] == n["qc_results"]
    assert out["rendered_pages"].where("render_successful").count() > 0
    assert out["sitemap"].agg(F.sum("urls")).first()[0] == out["rendered_pages"].where("render_successful").select("slug").distinct().count() + 1
    assert out["status"].first().stage == "publish"
    last = spark.read.parquet(str(tmp_path / "out/status"))
    assert [r.stage for r in last.orderBy("stage_no").collect()] == ["ingest", "generate", "qc", "render", "publish"]


def test_run_checks_a_page_once_and_keeps_small_files(spark, sf, tmp_path, monkeypatch):
    listed = fixtures.businesses(spark, sf).coalesce(1)
    source = tables.write_businesses_csv(listed, str(tmp_path / "in"))
    whole = stages.run_stages(spark, source, str(tmp_path / "out"), "r1", day="2024-06-01", multi_line=True)
    pages = spark.read.parquet(str(tmp_path / "out/generated_pages"))
    twice = quality.qc_route(pages, stages.rule_feedback(pages.where("generation_successful")), on=("business_id", "page_pos"))
    assert sorted(map(repr, whole["qc_results"].select(twice.columns).collect())) == sorted(map(repr, twice.collect()))

    def again(*_):
        raise AssertionError("the checks were made before")

    monkeypatch.setattr(stages, "with_checks", again)
    monkeypatch.setattr(tables, "ROWS_PER_FILE", 20)
    source = tables.write_businesses_csv(listed, str(tmp_path / "in2"))
    assert len(folders.data_files(spark, source)) == 8  # 150 rows
    small = stages.run_stages(spark, source, str(tmp_path / "out2"), "r1", day="2024-06-01", multi_line=True)
    assert len(folders.data_files(spark, str(tmp_path / "out2/checked"))) >= 8
    for name in ("businesses", "rejected", "generated_pages", "qc_results", "rendered_pages"):
        # the order of the rows is that of the listing
        assert sorted(map(repr, whole[name].collect())) == sorted(map(repr, small[name].collect()))


def test_run_stops_when_nothing_is_generated(spark, sf, tmp_path):
    def broken(row):
        raise RuntimeError("no model")

    source = tables.write_businesses_csv(fixtures.businesses(spark, sf), str(tmp_path / "in"))
    with pytest.raises(stages.NothingGenerated):
        stages.run_stages(spark, source, str(tmp_path / "out"), "r1", generate=broken, multi_line=True)
    errors = spark.read.parquet(str(tmp_path / "out/generated_pages")).select("error").distinct().collect()
    assert [r.error for r in errors] == ["no model"]


def test_a_cluster_needs_a_shared_folder():
    class Nowhere:
        master = "spark://host:7077"

        def getCheckpointDir(self):
            return None

    class Session:
        sparkContext = Nowhere()
        conf = {}

    with pytest.raises(ValueError, match="spark.checkpoint.dir"):
        workspace.shared_dir(Session())
    Nowhere.master = "local-cluster[2,1,1024]"
    with pytest.raises(ValueError):
        workspace.shared_dir(Session())
