"""Tables that are kept between runs: page specs by day, the status log, and named tables."""

import json
import uuid
from collections import Counter

from pyspark.sql import functions as F
from pyspark.sql import types as T

from mainstreet.operators.shuffles import checked_broadcast, first_rows
from mainstreet.plans.workspace import materialise
from mainstreet.sources import folders

DAY = "gen_date"

# The day as files hold it whose folder is a month's, and the folder of specs without a time.
IN_FILE, NO_DAY = "_gen_date", "__HIVE_DEFAULT_PARTITION__"

# New days of one write up to which each has a folder of its own, and specs of a month that may share one.
DAYS_APART, MONTH_SPECS = 100, 10_000


def keep_last_spec(df):
    """The last page spec per day and business; later writes replace earlier ones.

    The winners are found on keys alone, so the texts of the pages are not sorted or shuffled for it
    unless the winners are too many to be sent to every task.
    """
    dated = df.withColumn(DAY, F.date_format("generated_at", "yyyyMMdd"))
    keys = dated.select(DAY, "business_id", "generated_at", "page_pos")
    last = first_rows(keys, [DAY, "business_id"], [F.col("generated_at").desc(), F.col("page_pos").desc()])
    last = checked_broadcast(last.select(F.col("page_pos").alias("_pos"), F.col(DAY).alias("_day")))
    return dated.join(last, dated["page_pos"].eqNullSafe(F.col("_pos")) & dated[DAY].eqNullSafe(F.col("_day")), "left_semi")


def _places(spark, path):
    """The days and months that the store holds as folders, oldest first, from their names."""
    mark = f"{DAY}="
    return [name[len(mark) :] for name in folders.subfolders(spark, path) if name.startswith(mark)]


def _month(day):
    """The month that a day may be kept in; none for the day of specs without a time."""
    return day[:6] if len(day) == 8 and day.isdigit() else None


def _shared_months(counts, held):
    """The months among ``counts``, specs by day, whose days share a folder, each with those of its days that have their own.

    A day that the store holds stays where it is. Other days share a folder per month if there are more
    than ``DAYS_APART`` of them and few specs in the month, since a small file costs far more than its rows.
    """
    fresh = [day for day in counts if day not in held and _month(day)]
    size = Counter()
    for day in fresh:
        size[_month(day)] += counts[day]
    bulk = len(fresh) > DAYS_APART
    months = {_month(day) for day in counts} - {None}
    shared = {m: [] for m in months if m in held or (bulk and 0 < size[m] <= MONTH_SPECS)}
    for day in held:
        if _month(day) in shared:
            shared[_month(day)].append(day)
    return shared


def _placed(rows, shared):
    """Rows with the name of their folder in place of their day, which goes into the file where the folder is a month's."""
    if not shared:
        return rows
    months = rows.sparkSession.createDataFrame(sorted(shared.items()), "_month string, _apart array<string>")
    found = rows.withColumn("_month", F.left(DAY, F.lit(6))).join(F.broadcast(months), "_month", "left")
    within = F.coalesce(F.col("_apart").isNotNull() & ~F.array_contains("_apart", F.col(DAY)) & (F.length(DAY) == 8), F.lit(False))
    named = found.withColumn(IN_FILE, F.when(within, F.col(DAY)))
    return named.withColumn(DAY, F.when(within, F.col("_month")).otherwise(F.col(DAY))).select(*rows.columns, IN_FILE)


def _dated(rows):
    """Rows as read, with the day that their folder or, where that is a month's, their file names."""
    day = F.col(DAY).cast("string")
    if IN_FILE not in rows.columns:
        return rows.withColumn(DAY, day)
    return rows.withColumn(DAY, F.coalesce(F.col(IN_FILE), day)).drop(IN_FILE)


def _read_places(spark, path, places):
    """The specs of the given folders only; other folders are neither listed nor opened."""
    parts = [f"{path}/{DAY}={place}" for place in places]
    return _dated(spark.read.option("basePath", path).option("mergeSchema", True).parquet(*parts))


def write_page_specs(df, path):
    """Add page specs to the store at ``path``, one per business and day.

    A spec replaces the one that the store holds for its day and business. All other specs stay:
    days without new specs are not touched, and a day with new ones is merged with what it holds and
    put in place of it when all of it is written. A null business_id is a key like any other. Columns that
    only older or only newer specs have are null in the others. Specs without a time share one day
    of their own. Only one run may write at a time. A day is written by as many tasks as its size asks for.
    Many small days that come at once share a folder per month, ``gen_date=yyyyMM``, which is merged as a whole.
    """
    spark = df.sparkSession
    new = materialise(keep_last_spec(df))
    held = set(_places(spark, path))
    # one row per day of the new specs
    counts = {row[0] or NO_DAY: row[1] for row in new.groupBy(DAY).count().collect()}
    shared = _shared_months(counts, held)
    again = sorted({day if day in held else _month(day) for day in counts} & held)
    merged = new
    if again:
        key = new.select(F.col(DAY).alias("_day"), F.col("business_id").alias("_id"))
        old = _read_places(spark, path, again)
        same = old[DAY].eqNullSafe(F.col("_day")) & old["business_id"].eqNullSafe(F.col("_id"))
        # stored before the days are replaced, so that nothing is read from a folder that is going
        merged = materialise(old.join(checked_broadcast(key), same, "left_anti").unionByName(new, allowMissingColumns=True))
    (
        _placed(merged, shared)
        .hint("rebalance", F.col(DAY))
        .write.mode("overwrite")
        .option("partitionOverwriteMode", "dynamic")
        .partitionBy(DAY)
        .parquet(path)
    )
    return path


def read_page_specs(spark, path):
    return _dated(spark.read.option("mergeSchema", True).parquet(path))


def _newest_first(places):
    """Lists of folders, from the newest day back: a day, or a month that days share with those that have their own."""
    months = {p for p in places if len(p) == 6 and p.isdigit()}
    lots = {}
    for place in places:
        month = place if place in months else _month(place)
        lots.setdefault(month if month in months else place, []).append(place)
    names = sorted(lots, reverse=True)
    # undated ones come last
    return [lots[n] for n in names if n.isdigit()] + [lots[n] for n in names if not n.isdigit()]


def latest_page_specs(spark, path, n=100):
    """The specs of the last ``n`` (day, business) keys of the store, from the newest day back.

    Days are taken from the newest on until they hold ``n`` specs; the counts come from the files'
    footers, and older days are not opened. The keys of these days are ranked alone; the texts are
    read for the winners only.
    """
    days = _newest_first(_places(spark, path))
    if not days or n < 1:
        return read_page_specs(spark, path).limit(0)
    taken, rows, step = 0, 0, 1
    while taken < len(days) and rows < n:
        lot = days[taken : taken + step]
        rows += _read_places(spark, path, sum(lot, [])).count()
        taken, step = taken + len(lot), 2 * step
    recent = _read_places(spark, path, sum(days[:taken], []))
    keys = recent.select(DAY, "business_id").orderBy(F.col(DAY).desc_nulls_last(), F.col("business_id").desc_nulls_last()).limit(n)
    keys = keys.select(F.col(DAY).alias("_day"), F.col("business_id").alias("_id"))
    same = recent[DAY].eqNullSafe(F.col("_day")) & recent["business_id"].eqNullSafe(F.col("_id"))
    found = recent.join(checked_broadcast(keys), same, "left_semi")
    # the limit comes before unreadable ones are dropped
    return found.where(F.col("_corrupt").isNull()) if "_corrupt" in found.columns else found


# The status log: files that runs append, and below ``_snapshots`` the last row of every execution
# as of some of them. The number of the snapshot counts up; the newest one that is whole is read.


def append_status(df, path):
    """Add rows to the log."""
    df.write.mode("append").parquet(path)
    return path


def latest_status(df):
    """The last status row of each execution."""
    fields = [name for name in df.columns if name != "execution_id"]
    last = F.max_by(F.struct(*fields), F.struct("updated_at", "stage_no")).alias("last")
    return df.groupBy("execution_id").agg(last).select("execution_id", "last.*")


def _snapshot(spark, path):
    """Folder of the newest snapshot, or None, and the names of the log files it covers."""
    names = [n for n in folders.subfolders(spark, f"{path}/_snapshots") if n.isdigit()]
    if not names:
        return None, set()
    place = f"{path}/_snapshots/{names[-1]}"
    return place, set(json.loads(folders.read_note(spark, f"{place}/_covers")))


def _tail(spark, path, covered):
    return [name for name, _, _ in folders.data_files(spark, path) if name.rsplit("/", 1)[1] not in covered]


def read_status(spark, path):
    """The last row of every execution: the newest snapshot and the files that came after it."""
    snapshot, covered = _snapshot(spark, path)
    parts = [spark.read.parquet(snapshot)] if snapshot else []
    tail = _tail(spark, path, covered)
    if tail:
        parts.append(spark.read.option("mergeSchema", True).parquet(*tail))
    if not parts:
        raise FileNotFoundError(path)
    rows = parts[0] if len(parts) == 1 else parts[0].unionByName(parts[1], allowMissingColumns=True)
    return latest_status(rows)


def compact_status(spark, path):
    """Fold the log into one row per execution, so that reads cost executions and not the length of the log.

    The new snapshot is written aside and gets its number by one rename. A reader sees the old
    snapshot with its tail or the new one with its tail, and a run that ends before the rename
    leaves the log as it was. Rows that are appended meanwhile belong to the next tail. The files
    that the snapshot before already covered are deleted then; nobody starts to read them any more.
    Returns the number of the snapshot.
    """
    before, covered = _snapshot(spark, path)
    tail = _tail(spark, path, covered)
    number = int(before.rsplit("/", 1)[1]) + 1 if before else 1
    if not tail:
        return number - 1
    aside = f"{path}/_snapshots/.{uuid.uuid4().hex}"
    read_status(spark, path).write.parquet(aside)
    present = {name.rsplit("/", 1)[1] for name, _, _ in folders.data_files(spark, path)}
    names = [name.rsplit("/", 1)[1] for name in tail]
    folders.write_note(spark, f"{aside}/_covers", json.dumps(sorted(names + [n for n in covered if n in present])))
    folders.move(spark, aside, f"{path}/_snapshots/{number:08d}")
    for name in covered & present:
        folders.remove(spark, f"{path}/{name}")
    for old in folders.subfolders(spark, f"{path}/_snapshots"):
        if old.isdigit() and int(old) < number - 1:
            folders.remove(spark, f"{path}/_snapshots/{old}")
    return number


def _same_place(a, b):
    return a.split(":", 1)[-1].rstrip("/").lstrip("/") == b.split(":", 1)[-1].rstrip("/").lstrip("/")


def _definition(spark, name):
    """Location and properties of a table of the catalog."""
    rows = {r.col_name: r.data_type for r in spark.sql(f"DESCRIBE TABLE EXTENDED {name}").collect()}
    properties = {r.key: r.value for r in spark.sql(f"SHOW TBLPROPERTIES {name}").collect()}
    return rows["Location"], properties


def _ddl(field):
    return f"`{field.name}` {field.dataType.simpleString()}"


def register(spark, name, path, fmt="parquet"):
    """Name the files under ``path`` as an external table of the session's catalog, or bring the table up to date.

    The first call looks at the columns of all files, a later one only at files that were changed
    since: columns that they add are added to the table, and folders of new partitions are found. Columns that
    later files lack stay and are null in them. A column whose type has changed is an error. A read
    through the name needs no merging of file schemas. The table lasts as long as the catalog: with a metastore
    beyond the session, else for the session. The files are never changed, and dropping the table keeps them.
    """
    found = folders.data_files(spark, path)
    if not found:
        raise FileNotFoundError(path)
    known = spark.catalog.tableExists(name)
    location, properties = _definition(spark, name) if known else (None, {})
    if known and not _same_place(location, path):
        spark.sql(f"DROP TABLE {name}")
        known, properties = False, {}
    seen = int(properties.get("mainstreet.seen", -1))
    reader = spark.read.option("basePath", path)
    reader = reader.option("mergeSchema", True) if fmt == "parquet" else reader.option("header", True)
    if not known:
        # partitions are discovered from the folders' names
        whole = reader.format(fmt).load(path)
        parts = _partition_columns(found, path)
        columns = ", ".join(_ddl(f) for f in whole.schema.fields)
        by = f"PARTITIONED BY ({', '.join(f'`{p}`' for p in parts)})" if parts else ""
        options = "" if fmt == "parquet" else "OPTIONS (header 'true')"
        spark.sql(f"CREATE TABLE {name} ({columns}) USING {fmt} {options} {by} LOCATION '{path}'")
    else:
        # files written in the same millisecond as the last one seen are looked at again
        fresh = [file for file, _, changed in found if changed >= seen]
        parts = _partition_columns(found, path)
        if fresh:
            _add_columns(spark, name, [f for f in reader.format(fmt).load(fresh).schema.fields if f.name not in parts])
    if parts:
        spark.catalog.recoverPartitions(name)
    spark.sql(f"ALTER TABLE {name} SET TBLPROPERTIES ('mainstreet.seen' = '{max(t for _, _, t in found)}')")
    spark.catalog.refreshTable(name)
    return spark.table(name)


def _partition_columns(found, path):
    below = found[0][0].split(path.rstrip("/").split(":", 1)[-1].rstrip("/"), 1)[-1]
    return [part.split("=", 1)[0] for part in below.split("/")[:-1] if "=" in part]


def _add_columns(spark, name, fields):
    there = {f.name.lower(): f.dataType for f in spark.table(name).schema.fields}
    for field in fields:
        kind = there.get(field.name.lower())
        if kind is not None and kind != field.dataType and not isinstance(field.dataType, T.NullType):
            raise TypeError(f"{name}.{field.name} is {kind.simpleString()} in the table and {field.dataType.simpleString()} in new files")
    more = [f for f in fields if f.name.lower() not in there]
    if more:
        spark.sql(f"ALTER TABLE {name} ADD COLUMNS ({', '.join(map(_ddl, more))})")
