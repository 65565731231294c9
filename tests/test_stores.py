"""Tables that are kept between runs: writes that meet earlier ones, pruned reads, compaction, names."""

import datetime

import pytest
from pyspark.sql import functions as F

from catalog import fixtures
from mainstreet.sources import folders, stores

SPEC = "page_pos long, business_id string, generated_at timestamp, body string"


def _specs(spark, *rows):
    """Rows of (position, id, day of January 2024 or None, body)."""
    return spark.createDataFrame(
        [(p, i, None if day is None else datetime.datetime(2024, 1, day, 12), body) for p, i, day, body in rows], SPEC
    )


def _held(spark, path):
    rows = stores.read_page_specs(spark, path).collect()
    return sorted(((r.gen_date, r.business_id, r.body) for r in rows), key=repr)


def test_specs_of_other_days_stay(spark, tmp_path):
    path = str(tmp_path / "specs")
    stores.write_page_specs(_specs(spark, (1, "a", 1, "one"), (2, "b", 1, "two"), (3, None, 1, "none"), (4, "a", 1, "later")), path)
    first = [("20240101", None, "none"), ("20240101", "a", "later"), ("20240101", "b", "two")]
    assert _held(spark, path) == sorted(first, key=repr)
    before = {f for f in folders.data_files(spark, path)}
    stores.write_page_specs(_specs(spark, (1, "a", 2, "next day")), path)
    assert before <= set(folders.data_files(spark, path))  # the first day's files were not touched
    stores.write_page_specs(_specs(spark, (9, "b", 1, "again"), (9, None, 1, "none again"), (9, "c", 1, "new"), (9, "x", None, "undated")), path)
    stores.write_page_specs(_specs(spark, (1, "x", None, "undated again")), path)
    last = [
        ("20240101", None, "none again"), ("20240101", "a", "later"), ("20240101", "b", "again"), ("20240101", "c", "new"),
        ("20240102", "a", "next day"), (None, "x", "undated again"),
    ]
    assert _held(spark, path) == sorted(last, key=repr)


def test_specs_may_gain_and_lose_columns(spark, tmp_path):
    path = str(tmp_path / "specs")
    stores.write_page_specs(_specs(spark, (1, "a", 1, "one"), (2, "b", 1, "two")).withColumn("old", F.lit(1)), path)
    stores.write_page_specs(_specs(spark, (1, "a", 1, "again"), (3, "c", 2, "three")).withColumn("new", F.lit("n")), path)
    rows = {(r.gen_date, r.business_id): (r.body, r.old, r.new) for r in stores.read_page_specs(spark, path).collect()}
    assert rows == {("20240101", "a"): ("again", None, "n"), ("20240101", "b"): ("two", 1, None), ("20240102", "c"): ("three", None, "n")}


def test_a_write_that_fails_changes_nothing(spark, tmp_path):
    path = str(tmp_path / "specs")
    stores.write_page_specs(_specs(spark, (1, "a", 1, "one")), path)
    broken = _specs(spark, (1, "a", 1, "x"), (2, "b", 2, "y")).withColumn("body", F.when(c("business_id") == "b", F.raise_error(F.lit("no"))).otherwise(c("body")))
    with pytest.raises(Exception, match="no"):
        stores.write_page_specs(broken, path)
    assert _held(spark, path) == [("20240101", "a", "one")]


c = F.col


@pytest.mark.parametrize("n, days", [(1, 1), (3, 1), (4, 3), (100, 6)])
def test_latest_opens_only_the_days_it_needs(spark, tmp_path, n, days):
    path = str(tmp_path / "specs")
    rows = [(i, f"b{i}", day, f"{day} {i}") for day in range(1, 6) for i in range(3)] + [(1, None, 5, "null id"), (1, "z", None, "undated")]
    rows = [r for r in rows if (r[1], r[2]) != ("b2", 5)]
    stores.write_page_specs(_specs(spark, *rows), path)
    found = stores.latest_page_specs(spark, path, n)
    order = sorted(rows, key=lambda r: (r[2] is not None, r[2] or 0, r[1] is not None, r[1] or ""), reverse=True)
    assert sorted(r.body for r in found.collect()) == sorted(r[3] for r in order[:n])
    opened = {name.split("gen_date=")[1].split("/")[0] for name in found.inputFiles() if "gen_date=" in name}
    assert len(opened) == days
    assert stores.latest_page_specs(spark, path, 0).count() == 0


def test_latest_of_the_table(spark, sf, tmp_path):
    specs = fixtures.page_specs(spark, sf)
    path = stores.write_page_specs(specs, str(tmp_path / "specs"))
    found = [(r.gen_date, r.business_id) for r in stores.latest_page_specs(spark, path, 10).collect()]
    every = [(r.gen_date, r.business_id) for r in stores.read_page_specs(spark, path).collect()]
    assert sorted(found) == sorted(every)[-10:]


def _opened(found):
    return {name.split("gen_date=")[1].split("/")[0] for name in found.inputFiles() if "gen_date=" in name}


def _turn(spark, path, held, turn, days, ids):
    """One write of the given days after 2024 began; ``held`` is what the store must hold then."""
    start = datetime.datetime(2024, 1, 1, 12)
    times = [None if d is None else start + datetime.timedelta(days=d) for d in days]
    rows = [(turn, i, t, f"{turn} {i}") for t in times for i in ids]
    held.update({(None if t is None else t.strftime("%Y%m%d"), i): body for _, i, t, body in rows})
    stores.write_page_specs(spark.createDataFrame(rows, SPEC), path)
    assert _held(spark, path) == sorted(((day, i, body) for (day, i), body in held.items()), key=repr)


def test_many_small_days_share_a_folder_per_month(spark, tmp_path):
    path, held = str(tmp_path / "specs"), {}
    _turn(spark, path, held, 1, [9, None], ["a", "b"])
    assert folders.subfolders(spark, path) == ["gen_date=20240110", "gen_date=__HIVE_DEFAULT_PARTITION__"]
    _turn(spark, path, held, 2, [None, *range(150)], ["a", None])
    months = [f"gen_date=2024{m:02d}" for m in range(1, 6)]
    undated = "gen_date=__HIVE_DEFAULT_PARTITION__"
    assert folders.subfolders(spark, path) == sorted([*months, "gen_date=20240110", undated])
    before = folders.data_files(spark, path)
    assert len(before) == 7
    # a day of a shared folder, a day with its own, a new day of a shared month, and a day of a month of its own
    _turn(spark, path, held, 3, [0, 9, 150, 155], ["a", "c"])
    assert folders.subfolders(spark, path) == sorted([*months, "gen_date=20240110", "gen_date=20240604", undated])
    kept = [f for f in before if any(f"{m}/" in f[0] for m in months[1:4])]
    assert len(kept) == 3 and set(kept) <= set(folders.data_files(spark, path))
    _turn(spark, path, held, 4, [*range(0, 100, 2), *range(160, 420, 2)], ["b"])
    order = sorted(held, key=lambda k: (k[0] is not None, k[0] or "", k[1] is not None, k[1] or ""), reverse=True)
    for n in (1, 40, 700):
        found = stores.latest_page_specs(spark, path, n)
        told = sorted(((r.gen_date, r.business_id, r.body) for r in found.collect()), key=repr)
        assert told == sorted(((*k, held[k]) for k in order[:n]), key=repr)
    assert _opened(stores.latest_page_specs(spark, path, 1)) == {"202502"}


def test_days_of_a_full_month_have_folders_of_their_own(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(stores, "MONTH_SPECS", 60)
    path, held = str(tmp_path / "specs"), {}
    _turn(spark, path, held, 1, range(120), ["a", "b"])  # 62 specs in January and March, 58 in February and April
    names = [n.split("=")[1] for n in folders.subfolders(spark, path)]
    assert len(names) == 31 + 31 + 2 and {"202402", "20240131", "202404"} <= set(names)
    # the newest lots are April, then days of March
    assert _opened(stores.latest_page_specs(spark, path, 61)) == {"202404", "20240331", "20240330"}
    _turn(spark, path, held, 2, [0, 31, 32], ["a", "c"])
    assert [n.split("=")[1] for n in folders.subfolders(spark, path)] == names


STATUS = "execution_id string, stage_no int, updated_at timestamp, stage string"


def _status(spark, *rows):
    return spark.createDataFrame([(e, n, datetime.datetime(2024, 1, 1, 0, 0, t), s) for e, n, t, s in rows], STATUS)


def _last(spark, path):
    return sorted((r.execution_id, r.stage) for r in stores.read_status(spark, path).collect())


def test_compaction_keeps_the_last_rows(spark, tmp_path):
    path = str(tmp_path / "status")
    with pytest.raises(FileNotFoundError):
        stores.read_status(spark, path)
    for t in range(6):
        stores.append_status(_status(spark, ("a", t, t, f"a{t}"), ("b", t, 9 - t, f"b{t}")).coalesce(1), path)
    expected = [("a", "a5"), ("b", "b0")]
    assert _last(spark, path) == expected
    assert stores.compact_status(spark, path) == 1
    assert _last(spark, path) == expected
    assert len(stores.read_status(spark, path).inputFiles()) == len([f for f in folders.data_files(spark, f"{path}/_snapshots/00000001")])
    assert stores.compact_status(spark, path) == 1  # nothing new
    stores.append_status(_status(spark, ("a", 9, 9, "a9"), ("c", 1, 1, "c1")), path)
    expected = [("a", "a9"), ("b", "b0"), ("c", "c1")]
    assert _last(spark, path) == expected
    assert stores.compact_status(spark, path) == 2
    assert _last(spark, path) == expected
    stores.append_status(_status(spark, ("d", 1, 1, "d1")).withColumn("note", F.lit("x")), path)
    assert stores.compact_status(spark, path) == 3
    assert _last(spark, path) == [*expected, ("d", "d1")]
    # files of the first turns are gone, those of the last snapshot wait for the next one
    assert len(folders.subfolders(spark, f"{path}/_snapshots")) == 2
    assert {r.execution_id for r in spark.read.parquet(path).collect()} == {"d"}


def test_a_reader_during_compaction_sees_whole_rows(spark, tmp_path, monkeypatch):
    path = str(tmp_path / "status")
    stores.append_status(_status(spark, ("a", 1, 1, "a1")), path)
    stores.compact_status(spark, path)
    stores.append_status(_status(spark, ("a", 2, 2, "a2")), path)
    move = folders.move

    def stop(spark_, source, target):
        if source.split("/")[-1].startswith("."):
            raise OSError("lost")
        move(spark_, source, target)

    monkeypatch.setattr(folders, "move", stop)
    with pytest.raises(OSError):
        stores.compact_status(spark, path)
    assert _last(spark, path) == [("a", "a2")]
    monkeypatch.undo()
    planned = stores.read_status(spark, path)
    stores.compact_status(spark, path)
    # a plan made before still finds its files
    assert [(r.execution_id, r.stage) for r in planned.collect()] == _last(spark, path) == [("a", "a2")]


def test_named_table(spark, tmp_path):
    path = str(tmp_path / "raw")
    spark.range(5).withColumn("day", (c("id") % 2).cast("string")).write.partitionBy("day").parquet(path)
    stores.register(spark, "kept_rows", path)
    assert spark.sql("SELECT count(*) FROM kept_rows WHERE day = 1").first()[0] == 2
    assert {t.name: t.isTemporary for t in spark.catalog.listTables()}["kept_rows"] is False
    # a new partition, with one more column, and a file with fewer columns
    spark.range(10, 13).withColumns({"day": F.lit("7"), "more": F.lit("m")}).write.mode("append").partitionBy("day").parquet(path)
    table = stores.register(spark, "kept_rows", path)
    assert sorted(table.columns) == ["day", "id", "more"]
    assert spark.sql("SELECT count(*), count(more), count(DISTINCT day) FROM kept_rows").first()[:] == (8, 3, 3)
    # a read by day opens the files of that day only
    assert all("day=7" in f for f in spark.sql("SELECT * FROM kept_rows WHERE day = 7").inputFiles())
    assert stores.register(spark, "kept_rows", path).count() == 8
    spark.sql("DROP TABLE kept_rows")
    assert stores.register(spark, "kept_rows", path).count() == 8  # the files outlive the name
    spark.range(3).select(F.lit("x").alias("id"), F.lit("8").alias("day")).write.mode("append").partitionBy("day").parquet(path)
    with pytest.raises(Exception, match="id.*STRING|merge"):
        stores.register(spark, "kept_rows", path)
    other = str(tmp_path / "other")
    spark.range(2).write.parquet(other)
    assert stores.register(spark, "kept_rows", other).columns == ["id"]
    with pytest.raises(FileNotFoundError):
        stores.register(spark, "kept_rows", str(tmp_path / "none"))


def test_named_csv(spark, tmp_path):
    (tmp_path / "a.csv").write_text("id,name\n1,x\n")
    assert stores.register(spark, "kept_csv", str(tmp_path), "csv").collect() == [("1", "x")]
    (tmp_path / "b.csv").write_text("id,name,more\n2,y,m\n")
    rows = stores.register(spark, "kept_csv", str(tmp_path), "csv").collect()
    assert sorted(tuple(r) for r in rows) == [("1", "x", None), ("2", "y", "m")]
