"""A log of what a model answered, so that no business is asked twice whatever fails in between.

A task writes the answers of every lot of rows to the log before it asks on. When it is run again,
it reads the files of its own partition first; when the whole run is started again, all logged
answers are taken by a join and only the other rows are asked. An answer belongs to the execution,
the business and the hash of its prompt: another prompt is another question.

Log files are written by the Python workers with ``pyarrow.fs``, so the log must lie in a folder
that they can open as such: a mounted one, or a store that pyarrow knows.
"""

import uuid

from pyspark import TaskContext
from pyspark.sql import functions as F
from pyspark.sql import types as T

from mainstreet.plans.workspace import materialise
from mainstreet.sources import folders

LOT = 20  # answers to a file; as many may be asked again after a lost task

QUESTIONS = 10_000  # to a task with a log, which holds what its partition has been answered already

_COLUMNS = ["pos", "business_id", "prompt_hash", "response", "problem"]
_LOG = "pos long, business_id string, prompt_hash string, response string, problem string"


def keyed(prompts):
    return prompts.withColumn("prompt_hash", F.sha2(F.coalesce("prompt", F.lit("")), 256))


def logged(spark, log):
    """The answers of earlier runs, one per business and prompt; answers win over failures."""
    kind = T.StructType.fromDDL(_LOG)
    if not folders.data_files(spark, log):
        return spark.createDataFrame([], kind)
    rows = spark.read.schema(kind).option("recursiveFileLookup", True).parquet(log)
    best = F.min(F.struct(F.col("problem").isNotNull(), "response", "problem")).alias("best")
    return rows.groupBy("business_id", "prompt_hash").agg(best).select("business_id", "prompt_hash", "best.response", "best.problem")


def _answered(system, folder):
    """Answers in the files of a partition, by business and prompt."""
    import pyarrow.fs as fs
    import pyarrow.parquet as parquet

    out = {}
    for file in system.get_file_info(fs.FileSelector(folder, allow_not_found=True)):
        if file.path.endswith(".parquet"):
            with system.open_input_file(file.path) as stream:
                for row in parquet.read_table(stream).to_pylist():
                    out[row["business_id"], row["prompt_hash"]] = row["response"], row["problem"]
    return out


def _write(system, folder, rows):
    """One file, which has its final name only when it is whole."""
    import pyarrow as pa
    import pyarrow.parquet as parquet

    kinds = [(n, pa.int64() if n == "pos" else pa.string()) for n in _COLUMNS]
    system.create_dir(folder, recursive=True)
    name = uuid.uuid4().hex
    with system.open_output_stream(f"{folder}/.{name}") as stream:
        parquet.write_table(pa.Table.from_pylist(rows, pa.schema(kinds)), stream)
    system.move(f"{folder}/.{name}", f"{folder}/{name}.parquet")


def ask(fn, log=None):
    """The function for ``mapInPandas`` that calls ``fn`` once per row, unless the log has its answer."""

    def call(batches):
        import pyarrow.fs as fs

        system, known, last, waiting = None, {}, (None, None), []
        if log:
            system, root = fs.FileSystem.from_uri(log) if "://" in log or log.startswith("file:") else (fs.LocalFileSystem(), log)
            folder = f"{root}/part-{TaskContext.get().partitionId():06d}"
            known = _answered(system, folder)
        for batch in batches:
            out = []
            for row in batch.astype(object).where(batch.notna(), None).to_dict("records"):
                key = row["business_id"], row.get("prompt_hash")
                # equal questions stand one after the other
                answer = last[1] if log and key == last[0] else known.get(key)
                if answer is None:
                    try:
                        answer = fn({k: v for k, v in row.items() if k != "prompt_hash"}), None
                    except Exception as problem:  # noqa: BLE001 - the row is reported as failed
                        answer = None, str(problem)
                    if log:
                        waiting.append(dict(zip(_COLUMNS, (row["pos"], *key, *answer))))
                        if len(waiting) >= LOT:
                            _write(system, folder, waiting)
                            waiting = []
                last = key, answer
                out.append(answer)
            yield batch[["pos", "business_id"]].assign(response=[a for a, _ in out], problem=[p for _, p in out])
        if waiting:
            _write(system, folder, waiting)

    return call


def answers(prompts, fn, callers, log=None):
    """pos, business_id, response and problem for every row of ``prompts``.

    With a log, rows that it has an answer for are not asked; those that failed in an earlier run
    are asked once more. ``fn`` sees a row as a dict. Equal businesses with equal prompts are one question.
    """
    fields = "pos long, business_id string, response string, problem string"
    ready = keyed(prompts)
    if not log:
        return ready.repartition(callers, "pos").mapInPandas(ask(fn), fields)
    spark = prompts.sparkSession
    done = logged(spark, log).where("problem IS NULL").withColumn("_known", F.lit(True))
    done = done.select(F.col("business_id").alias("_id"), F.col("prompt_hash").alias("_hash"), F.col("response").alias("_response"), "_known")
    same = ready["business_id"].eqNullSafe(F.col("_id")) & (ready["prompt_hash"] == F.col("_hash"))
    # stored, so that a second look at the log cannot change which rows are asked
    met = materialise(ready.join(done, same, "left").drop("_id", "_hash"))
    found = met.where("_known").select("pos", "business_id", F.col("_response").alias("response"), F.lit(None).cast("string").alias("problem"))
    # each run has its folders, because its partitions are not those of another run
    turn = f"{log}/{uuid.uuid4().hex}"
    asked = met.where("_known IS NULL").drop("_known", "_response")
    # equal questions meet in one task, side by side
    tasks = max(callers, -(-asked.count() // QUESTIONS))
    dealt = asked.repartition(tasks, "business_id", "prompt_hash").sortWithinPartitions("business_id", "prompt_hash", "pos")
    return found.unionByName(dealt.mapInPandas(ask(fn, turn), fields))
