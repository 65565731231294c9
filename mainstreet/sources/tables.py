"""Reading business files and keeping stage tables, documents and reports."""

import json

from pyspark.sql import functions as F
from pyspark.sql import types as T

from mainstreet import schemas
from mainstreet.sources import folders

# Rows of a listing file or of a file of a stage: one that is read as a whole should be a small part of a task.
ROWS_PER_FILE = 10_000


def read_businesses(spark, path, multi_line=False, fmt=None):
    """Business listings, all columns as text and matched by name.

    Columns that a layout lacks are null, extra ones are dropped. Files are split among tasks
    unless ``multi_line`` allows line breaks inside quotes, at the price of one task per file. JSON
    files are read as documents with the same columns.
    """
    if (fmt or ("json" if str(path).endswith((".json", ".jsonl")) else "csv")) == "json":
        raw = spark.read.option("primitivesAsString", True).option("multiLine", multi_line).json(path)
    else:
        raw = (
            spark.read.option("header", True)
            .option("multiLine", multi_line)
            .option("quote", '"')
            .option("escape", '"')
            .csv(path)
        )
    return conform(require_columns(raw))


def require_columns(df, columns=schemas.REQUIRED_COLUMNS):
    """Stop early when a required column is missing."""
    missing = [name for name in columns if name not in df.columns]
    if missing:
        raise ValueError(f"Missing required columns: {missing}")
    return df


def conform(df):
    """The business columns in their fixed order as text."""
    return df.select(
        *[
            (F.col(name).cast("string") if name in df.columns else F.lit(None).cast("string")).alias(name)
            for name in schemas.BUSINESS_COLUMNS
        ]
    )


def write_businesses_csv(df, path):
    (
        df.select(*schemas.BUSINESS_COLUMNS)
        .write.mode("overwrite")
        .option("maxRecordsPerFile", ROWS_PER_FILE)
        .option("header", True)
        .option("escape", '"')
        .option("ignoreLeadingWhiteSpace", False)
        .option("ignoreTrailingWhiteSpace", False)
        .csv(path)
    )
    return path


def read_docs(spark, path, schema, multi_line=True):
    """JSON documents; a malformed document becomes nulls with its text in ``_corrupt``."""
    fields = T.StructType.fromDDL(schema) if isinstance(schema, str) else schema
    docs = (
        spark.read.schema(T.StructType([*fields.fields, T.StructField("_corrupt", T.StringType(), True)]))
        .option("multiLine", multi_line)
        .option("mode", "PERMISSIVE")
        .option("columnNameOfCorruptRecord", "_corrupt")
        .json(path)
    )
    whole = F.col("_corrupt").isNull()
    return docs.select(*[F.when(whole, F.col(f.name)).alias(f.name) for f in fields.fields], "_corrupt")


def write_docs(df, path):
    """JSON lines; dates and times become ISO text."""
    shown = [
        F.date_format(f.name, "yyyy-MM-dd'T'HH:mm:ss.SSSSSS").alias(f.name)
        if f.dataType.typeName() in ("timestamp", "timestamp_ntz")
        else F.col(f.name).cast("string").alias(f.name)
        if f.dataType.typeName() in ("date", "decimal", "binary")
        else F.col(f.name)
        for f in df.schema.fields
    ]
    df.select(*shown).write.mode("overwrite").json(path)
    return path


def write_pages(df, path, buckets=64):
    """Page bodies as JSON lines (path, body) in ``buckets`` folders, each written by as many tasks as its size asks for."""
    (
        df.select(
            F.pmod(F.xxhash64("path"), F.lit(buckets)).cast("int").alias("bucket"),
            F.to_json(F.struct("path", "body")).alias("value"),
        )
        .hint("rebalance", F.col("bucket"))
        .write.mode("overwrite")
        .partitionBy("bucket")
        .text(path)
    )
    return path


def append_traces(df, path):
    """Add traces to the log, by day."""
    dated = df.withColumn("trace_date", F.date_format("created_at", "yyyyMMdd"))
    # a day is written by as many tasks as its size asks for
    dated.hint("rebalance", F.col("trace_date")).write.mode("append").partitionBy("trace_date").json(path)
    return path


def save_result(df, path, fmt="parquet"):
    """Keep the result of a query under an output location, in files that pack evenly into the tasks that read them."""
    df.write.mode("overwrite").option("maxRecordsPerFile", ROWS_PER_FILE).format(fmt).save(path)
    return path


def explode_rows(docs, field, keep=()):
    """Rows of the array ``field`` of an envelope with their position; ``keep`` names envelope columns to carry along."""
    rows = docs.select(*keep, F.posexplode(field).alias("pos", "row"))
    return rows.select(*keep, "pos", "row.*")


def write_envelope(rows, path, header):
    """An envelope that can be read in parts: its own fields as one small document, its rows as lines.

    ``rows`` has the columns of the rows and ``pos``, their position; ``header`` is a dict.
    """
    rows.write.json(f"{path}/rows")
    folders.write_note(rows.sparkSession, f"{path}/header.json", json.dumps(header, default=str))
    return path


def read_envelope(spark, path, schema, keep=""):
    """The rows of an envelope as from :func:`explode_rows`, in as many tasks as their files ask for.

    ``schema`` describes a row, ``keep`` the fields of the header to carry along, both as DDL. The
    header is one small document, read by the driver; a header that is missing or malformed gives nulls.
    """
    fields = T.StructType.fromDDL(f"pos long, {schema}")
    rows = spark.read.schema(fields).json(f"{path}/rows")
    kept = T.StructType.fromDDL(keep) if keep else T.StructType()
    text = folders.read_note(spark, f"{path}/header.json") or "{}"
    header = F.from_json(F.lit(text), kept) if keep else None
    return rows.select(*[header[f.name].alias(f.name) for f in kept.fields], *fields.names)


def split_envelope(spark, path, out, schema, field, tasks=None):
    """Turn the document at ``path`` with its rows in the array ``field`` into the form of :func:`write_envelope`.

    One document is read by one task, this once; the lines it leaves are dealt to ``tasks`` files
    and read in parts ever after. Its other top-level fields become the header.
    """
    whole = T.StructType.fromDDL(schema)
    docs = read_docs(spark, path, whole).where(F.col("_corrupt").isNull()).drop("_corrupt")
    rows = docs.select(F.posexplode(field).alias("pos", "row")).select("pos", "row.*")
    tasks = tasks or int(spark.conf.get("spark.sql.shuffle.partitions"))
    others = [f.name for f in whole.fields if f.name != field]
    # the fields of one document without its rows
    first = docs.select(F.to_json(F.struct(*others)) if others else F.lit("{}")).first()
    return write_envelope(rows.repartition(tasks, "pos"), out, json.loads(first[0]) if first else {})


def stage_summary(df, success):
    """Row, success and failure counts of a stage; ``success`` is a boolean column."""
    ok = F.count_if(success)
    rows = F.count(F.lit(1))
    return df.agg(rows.alias("total"), ok.alias("successful"), (rows - ok).alias("failed"))


def synthetic_businesses(spark, n=25, seed=7):
    """Made-up listings for trials without data: categories and cities take turns, ratings 3 to 5."""
    # Categories and cities of the made-up listings.
    categories = ["Restaurant", "Automotive", "Healthcare", "Retail", "Professional Services"]
    cities = ["Los Angeles", "San Francisco", "San Diego", "Sacramento", "Oakland"]
    turn = (F.col("id") % 5).cast("int")
    return spark.range(n).select(
        F.format_string("biz_%03d", F.col("id") + 1).alias("business_id"),
        F.concat(F.lit("Sample Business "), (F.col("id") + 1).cast("string")).alias("name"),
        F.get(F.array(*map(F.lit, categories)), turn).alias("category"),
        F.get(F.array(*map(F.lit, cities)), turn).alias("city"),
        F.lit("CA").alias("state"),
        (F.rand(seed) * 2 + 3).alias("rating"),
        (F.floor(F.rand(seed + 1) * 290) + 10).cast("int").alias("review_count"),
    )
