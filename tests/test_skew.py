"""Joins, ranks and lists where one key holds much of the data."""

import pytest
from pyspark.sql import functions as F

from catalog import fixtures
from mainstreet.operators import profiling, publication
from mainstreet.operators import shuffles
from mainstreet.operators.shuffles import first_rows, global_rank, lookup, number_rows

c = F.col


@pytest.fixture
def shuffled_joins(spark, monkeypatch):
    """No broadcast because of a small size, so that only those of heavy keys are left."""
    monkeypatch.setattr(shuffles, "BROADCAST_ROWS", 10)
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    spark.conf.set("spark.sql.adaptive.autoBroadcastJoinThreshold", "-1")
    yield
    spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.unset("spark.sql.adaptive.autoBroadcastJoinThreshold")


def _facts(spark, n=30000):
    # a third of the rows share key 0, some have none, the rest are spread thin
    key = F.when(c("id") % 3 == 0, 0).when(c("id") % 50 == 1, None).otherwise(c("id") + 1)
    return spark.range(n).select("id", key.alias("key"))


@pytest.mark.parametrize("counted", [True, False])
def test_lookup_equals_a_left_join(spark, shuffled_joins, counted):
    facts = _facts(spark)
    counts = facts.where(c("key").isNotNull()).groupBy("key").agg(F.count(F.lit(1)).alias("n"))
    table = counts.where((c("key") % 7 != 3) | (c("key") == 0))
    got = lookup(facts, table, ["key"], ["id"], counted="n" if counted else None)
    want = facts.join(table, "key", "left").select("id", "key", "n")
    assert got.exceptAll(want).count() == 0 and want.exceptAll(got).count() == 0


def test_lookup_of_wide_heavy_rows(spark, shuffled_joins, monkeypatch):
    monkeypatch.setattr(shuffles, "BROADCAST_BYTES", 0)
    test_lookup_equals_a_left_join(spark, None, True)


def test_heavy_rows_are_spread_over_tasks(spark, shuffled_joins):
    facts = _facts(spark)
    counts = facts.where(c("key").isNotNull()).groupBy("key").agg(F.count(F.lit(1)).alias("n"))
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    try:
        got = lookup(facts, counts, ["key"], ["id"], counted="n")
        assert "SortMergeJoin" in got._jdf.queryExecution().executedPlan().toString()
        sizes = [r["count"] for r in got.groupBy(F.spark_partition_id()).count().collect()]
    finally:
        spark.conf.unset("spark.sql.adaptive.enabled")
    assert len(sizes) == 8 and max(sizes) < 1.2 * min(sizes)


def test_numbers_follow_the_input(spark):
    rows = spark.range(0, 1000, 1, 7)
    assert [r.row_idx - 1 for r in number_rows(rows).orderBy("id").collect()] == list(range(1000))


@pytest.mark.parametrize("size", ["300", "1k", "128m"])
def test_numbers_do_not_depend_on_how_files_are_read(spark, tmp_path, size):
    rows = [f"{i},v{i}" for i in range(900)]
    for name, part in (("b", rows[:500]), ("a", rows[500:700]), ("c", rows[700:])):
        (tmp_path / f"{name}.csv").write_text("\n".join(["id,v", *part]) + "\n")
    (tmp_path / "empty.csv").write_text("id,v\n")
    spark.conf.set("spark.sql.files.maxPartitionBytes", size)
    try:
        read = spark.read.option("header", True).csv(str(tmp_path)).select("v", c("id").cast("int").alias("id"))
        got = [(r.row_idx, r.id, r.v) for r in number_rows(read).orderBy("row_idx").collect()]
    finally:
        spark.conf.unset("spark.sql.files.maxPartitionBytes")
    order = [*range(500, 700), *range(500), *range(700, 900)]
    assert got == [(n + 1, i, f"v{i}") for n, i in enumerate(order)]


def test_null_safe_lookup_of_a_hot_key(spark, shuffled_joins):
    facts = spark.range(6000).select(
        "id", F.when(c("id") % 2 == 0, "hot").when(c("id") % 7 > 0, c("id").cast("string")).alias("a"), F.when(c("id") % 4 > 0, c("id") % 5).alias("b")
    )
    table = facts.groupBy("a", "b").agg(F.count(F.lit(1)).alias("n")).where("n % 3 > 0 OR a IS NULL")
    got = shuffles.null_safe_lookup(facts, table, ["a", "b"], ["id"], counted="n")
    t = table.select(c("a").alias("ta"), c("b").alias("tb"), "n")
    want = facts.join(t, c("a").eqNullSafe(c("ta")) & c("b").eqNullSafe(c("tb")), "left").select("id", "a", "b", "n")
    assert got.columns == want.columns
    assert got.exceptAll(want).count() == 0 and want.exceptAll(got).count() == 0


def test_top_rated_with_a_tie_of_half_the_rows(spark, shuffled_joins):
    rows = spark.range(4000).select(
        F.format_string("n%d", "id").alias("name"), F.lit("x").alias("city"), F.lit("y").alias("state"), F.lit("Cafe").alias("category"),
        F.when(c("id") % 2 == 0, 5.0).otherwise(1.0 + c("id") % 7 / 2).alias("rating"), F.when(c("id") % 2 > 0, c("id")).alias("review_count"),
    )
    got = profiling.top_rated(rows).collect()
    assert len(got) == 2000 and {r.category_rank for r in got} == {1} and {r.review_count for r in got} == {None}
    few = profiling.top_rated(rows.where("id % 2 = 1 OR id < 4")).collect()
    assert sorted(r.category_rank for r in few) == [1, 1, 3, 4, 5]


def test_global_rank(spark):
    rows = spark.range(5000).select("id", (c("id") % 10).alias("score"))
    ranked = global_rank(rows, [c("score").desc(), c("id")], "place").collect()
    order = sorted(ranked, key=lambda r: r.place)
    assert [r.place for r in order] == list(range(1, 5001))
    assert [(r.score, r.id) for r in order] == sorted(((i % 10, i) for i in range(5000)), key=lambda t: (-t[0], t[1]))


def test_first_rows_limits_before_the_shuffle(spark):
    df = first_rows(_facts(spark), ["key"], [c("id").desc()], 2)
    plan = df._jdf.queryExecution().executedPlan().toString()
    assert "WindowGroupLimit" in plan and "Partial" in plan
    assert {r.id for r in df.where("key = 0").collect()} == {29997, 29994}


def _related(rows):
    out = {}
    for r in rows:
        if None in (r.name, r.category, r.city, r.state):
            continue
        entries = {
            f"{o.name}|{o.category}|{o.business_id}"
            for o in rows
            if o.city == r.city and o.state == r.state and o.business_id != r.business_id and None not in (o.name, o.category)
        }
        out[r.business_id] = entries
    return out


def test_small_table_is_broadcast_and_facts_stay_in_place(spark):
    facts = _facts(spark)
    table = spark.createDataFrame([(0, "a"), (3, "b")], "key long, label string")
    got = lookup(facts, table, ["key"], ["id"])
    assert "Exchange hashpartitioning" not in got._jdf.queryExecution().executedPlan().toString()
    assert got.where("label = 'a'").count() == 10000 and got.count() == 30000


def test_wide_rows_are_not_broadcast(spark, monkeypatch):
    monkeypatch.setattr(shuffles, "BROADCAST_BYTES", 1000)
    table = spark.range(20).select(c("id").alias("key"), F.repeat(F.lit("x"), 100).alias("label"))
    assert not shuffles.fits(table)
    assert shuffles.fits(table.limit(3))


def test_related_counts_and_members_agree(spark, sf):
    b = fixtures.businesses(spark, sf, False)
    want = _related(b.collect())
    members = {}
    for row in publication.market_members(b).collect():
        members.setdefault((row.city, row.state), set()).add(row.entry)
    got = publication.related_businesses(publication.candidates(b), b).collect()
    assert {r.business_id for r in got} == set(want)
    for r in got:
        others = members.get((r.city, r.state), set()) - {f"{r.name}|{r.category}|{r.business_id}"}
        assert others == want[r.business_id]
        assert r.related_count == len(others)


def test_publish_list_keeps_little_and_is_in_order(spark, sf, monkeypatch):
    stored = []
    original = shuffles.materialise
    monkeypatch.setattr(shuffles, "materialise", lambda df: stored.append(df.columns) or original(df))
    out = publication.publish_list(fixtures.businesses(spark, sf), min_score=15.0)
    assert len(stored) == 2 and not any("description" in names for names in stored)
    ranks = [r.publication_rank for r in out.select("publication_rank").collect()]
    assert ranks == list(range(1, len(ranks) + 1))


def test_repeated_and_null_ids_have_ranks_of_their_own(spark, sf):
    b = fixtures.businesses(spark, sf)
    copies = b.where("pos % 4 = 0")
    none = b.where("pos % 5 = 0").withColumn("business_id", F.lit(None).cast("string"))
    many = b.unionByName(copies).unionByName(copies).unionByName(none)
    once = publication.publish_list(b, min_score=15.0)
    out = publication.publish_list(many, min_score=15.0).collect()
    listed = {r.business_id: r.pos for r in once.join(b.select("business_id", "pos"), "business_id").collect()}
    assert len(out) == len(listed) + sum(2 * (p % 4 == 0) + (p % 5 == 0) for p in listed.values())
    assert [r.publication_rank for r in out] == list(range(1, len(out) + 1))
    batches = [r.processing_batch for r in out]
    assert [batches.count(f"BATCH_{k}") for k in ("1_HIGH_PRIORITY", "2_MEDIUM_PRIORITY")] == [25, 50]
    keys = [(-r.priority_score, -(r.rating or -1), -(r.review_count or -1), r.business_id is None, r.business_id or "") for r in out]
    assert keys == sorted(keys)
    assert all(r.local_competition > 0 for r in out)


def _page_tables(spark, path):
    """Documents that nearly all belong to business 1, some twice or without an id; one business stands twice, one has no key."""
    ids = [*range(10, 20010, 10), 10, 20, None, 4, 5, 6, 7]
    docs = [(i, f"Text {n}. More of {i}!", "en", "web", 20) for n, i in enumerate(ids)]
    spark.createDataFrame(docs, "doc_id long, text string, lang string, source string, n_chars int").write.parquet(f"{path}/documents.parquet")
    keys = [1, 2, 3, 3, None]
    customers = [(k, f"c{n}", n, 1.0, "MACHINERY") for n, k in enumerate(keys)]
    fields = "c_custkey long, c_name string, c_nationkey int, c_acctbal double, c_mktsegment string"
    spark.createDataFrame(customers, fields).write.parquet(f"{path}/customer.parquet")
    return str(path)


def test_pages_of_one_business_are_divided(spark, shuffled_joins, tmp_path):
    """Also if the businesses are too many to be sent to every task; the rows are those of the SQL."""
    pages = fixtures.flat_pages(spark, _page_tables(spark, tmp_path))
    sizes = [r["count"] for r in pages.groupBy(F.spark_partition_id()).count().collect()]
    assert max(sizes) < 0.3 * sum(sizes)
    plain = spark.sql(fixtures.page_sql()).drop("k")
    assert pages.columns == plain.columns
    assert pages.schema.simpleString() == plain.schema.simpleString()
    told = [sorted(map(repr, df.collect())) for df in (pages, plain)]
    assert told[0] == told[1] and len(told[0]) == 2002 + 2 + 2 * 2
