"""Shared working folder of a run and lineage cuts that survive the loss of an executor."""

import re
import tempfile
import uuid


def shared_dir(spark):
    """The folder that the cluster names in ``spark.checkpoint.dir``.

    Executors of a cluster do not see each other's disks, so a missing name is an error there. Only
    a local session, which has one disk, gets a private folder.
    """
    context = spark.sparkContext
    if context.getCheckpointDir() is None:
        named = spark.conf.get("spark.checkpoint.dir", None)
        if not named and not re.fullmatch(r"local(\[[^\]]*\])?", context.master):
            raise ValueError("Name a folder that all executors share in spark.checkpoint.dir")
        context.setCheckpointDir(named or tempfile.mkdtemp(prefix="mainstreet-"))
    return context.getCheckpointDir()


def new_path(spark, name):
    return f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"


def materialise(df):
    """Write the rows once as a table in the shared folder and go on from there.

    Later reads see the same rows whatever happens to an executor, take only the columns they
    need, and do not run the plan before it again.
    """
    path = new_path(df.sparkSession, "stored")
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)
