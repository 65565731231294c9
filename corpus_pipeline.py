"""The corpus pipeline: five stages over ``documents``, each a function of (spark, docs, sf_dir).

Every stage but the last returns the columns of ``documents``; ``run`` applies them one after the
other. Each is stored in the shared folder before the next one reads it.

Columns of ``documents`` that a stage does not know go through it, whatever their names. A null text counts as
empty. An empty table stays one. Without labels all documents get one score and stay or go together; without benchmark
items none is dropped.
"""

from pyspark.sql import functions as F

from mainstreet.llm import blocks, decontamination, minhash, mixing, quality, sharding
from mainstreet.operators.shuffles import checked_broadcast
from mainstreet.plans.workspace import materialise

QUALITY_THRESHOLD = 0.7


def quality_stage(spark, docs, sf_dir):
    """Keep the documents that the quality classifier does not reject; learned as in ``op5_quality``."""
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet")
    held_out = blocks.remainder(F.col("doc_id"), 4) == 2
    model = quality.fit(docs, labels.where(~held_out))
    name = blocks.free_name(docs, "_quality")
    return quality.score(docs, model, score_col=name).where(F.col(name) >= QUALITY_THRESHOLD).drop(name)


def dedup_stage(spark, docs, sf_dir):
    """Keep one document of each group of near duplicates: five words to a shingle, similarity 0.8."""
    return minhash.deduplicated(docs, percent=80, width=5)


def decontamination_stage(spark, docs, sf_dir):
    """Drop the documents that hold a passage of the benchmark."""
    return decontamination.clean(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def mixing_stage(spark, docs, sf_dir):
    """Bring the sources to their target weights: a document is repeated, or left out, as the mix says.

    Rows without id cannot be told apart and are used once; rows that share one are used as often as the most used of
    them. (The dedup before this stage leaves one row to an id.)
    """
    own, times, use = (blocks.free_name(docs, n) for n in ("_mix_id", "_mix_uses", "_mix_use"))
    uses = mixing.mix(docs).groupBy(F.col("doc_id").alias(own)).agg(F.max(F.size("draws")).alias(times))
    uses = checked_broadcast(uses)  # so that texts are moved only if the ids are too many for it
    rows = docs.join(uses, docs["doc_id"] == uses[own], "left")
    again = F.explode(F.array_repeat(F.lit(0), F.coalesce(times, F.lit(1))))
    return rows.select(*[docs[c] for c in docs.columns], again.alias(use)).drop(use)


def sharding_stage(spark, docs, sf_dir):
    """Put every document, and every repeat of one, into a slot of one of eight shards of near-equal bytes."""
    return sharding.place(docs)


STAGES = [
    ("quality", quality_stage),
    ("minhash", dedup_stage),
    ("decontamination", decontamination_stage),
    ("mixing", mixing_stage),
    ("sharding", sharding_stage),
]

# The model, the hashes of the dedup and the draws of the mix cannot be said in SQL.
ORACLE_SQL = None


def run(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for _, stage in STAGES[:-1]:
        docs = materialise(stage(spark, docs, sf_dir))
    return STAGES[-1][1](spark, docs, sf_dir)
