"""From raw documents to mixed, sharded training data.

Each stage calls one operator on all documents its predecessor kept, and returns the columns of
documents; the last one adds the shard. Toxic documents go, one document of each group of near copies
stays, documents that hold a benchmark item go, sources are repeated or left out for their target
weights, and what is left is dealt into shards.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from plumbline.llm import decontaminate, jaccard, mixing, sharding, toxicity
from plumbline.llm.common import checkpointed, written

SHARDS = 40
#: Near copies share at least 80 hundredths of their five-word shingles.
WIDTH, PERCENT = 5, 80
#: Keys up to which a set of documents to drop is broadcast (16 bytes each); beyond, the join shuffles.
BROADCAST_KEYS = 200_000
#: Columns that operators read; all others travel under names that no operator uses.
READ = ("doc_id", "text", "source")


def _shielded(docs: DataFrame) -> tuple[DataFrame, list[str]]:
    names = [c if c in READ else f"_c{i}" for i, c in enumerate(docs.columns)]
    return docs.toDF(*names), names


def without_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The documents that are predicted not toxic; null and empty texts stay unless all are likely toxic."""
    safe, names = _shielded(docs)
    model = toxicity.fit(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))
    scores = toxicity.scored(safe, model, name="_score")
    return scores.where(F.col("_score") < toxicity.THRESHOLD).select(*names).toDF(*docs.columns)


def without_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies, the one with the smallest id; repeated rows are one.

    A document is its id and text. Texts without words are in no group and stay; rows that repeat
    such a document stay once.
    """
    safe, names = _shielded(docs)
    safe = safe.withColumn("_key", F.xxhash64("doc_id", "text"))
    found = jaccard.near_copies(safe.select("_key", "text"), key="_key", width=WIDTH, percent=PERCENT)
    keys = safe.groupBy("_key").agg(F.min("doc_id").alias("doc_id"), F.count(F.lit(1)).alias("rows"))
    groups = found.select("_key", "component_id").distinct().join(keys, "_key")
    groups = checkpointed(groups)
    first = groups.groupBy("component_id").agg(F.min(F.struct(F.col("doc_id").isNull(), "doc_id", "_key"))["_key"].alias("kept"))
    told = checkpointed(groups.join(first, "component_id").select("_key", (F.col("_key") != F.col("kept")).alias("drop"), (F.col("rows") > 1).alias("often")).where("drop or often"))
    counts = told.agg(F.count_if("drop"), F.count_if("often")).first()
    small = lambda df, n: F.broadcast(df) if n <= BROADCAST_KEYS else df
    rest = safe.join(small(told.where("drop").select("_key"), counts[0]), "_key", "left_anti")
    if counts[1]:
        often = small(told.where("often").select("_key"), counts[1])
        once = rest.join(often, "_key", "left_semi").dropDuplicates(["_key"])
        rest = rest.join(often, "_key", "left_anti").unionByName(once)
    return rest.select(*names).toDF(*docs.columns)


def without_benchmark(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The documents that hold no benchmark item."""
    safe, names = _shielded(docs)
    clean = decontaminate.decontaminated(safe, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))
    return clean.select(*names).toDF(*docs.columns)


def mixed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The documents as often as the mix of sources takes them: never, once, twice or three times."""
    safe, names = _shielded(docs)
    return mixing.repeated(mixing.mixed(safe)).select(*names).toDF(*docs.columns)


def sharded(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The documents with size, shard and slot; columns of these names are replaced."""
    return sharding.byte_shards(docs, shards=SHARDS)


STAGES = [
    ("toxicity", without_toxic),
    ("near_copies", without_near_copies),
    ("decontamination", without_benchmark),
    ("mixing", mixed),
    ("sharding", sharded),
]

#: The first stage trains a classifier, which SQL cannot express.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over all documents, each written as Parquet and read again."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for _, stage in STAGES[:-1]:
        docs = written(stage(spark, docs, sf_dir))
    return STAGES[-1][1](spark, docs, sf_dir)
