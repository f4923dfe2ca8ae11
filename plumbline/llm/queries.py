"""The corpus queries, each thin over its operator, beside its SQL where SQL can express it."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from plumbline.llm import codes, decontaminate, jaccard, lines, merkle, mixing, neighbours, quality, sharding, substring, suffixes, tokencount, toxicity
from plumbline.llm.common import text_or_empty, written
from plumbline.llm.sql import ORACLES


def read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_byte_shards(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents in 40 contiguous shards of nearly equal bytes."""
    docs = read(spark, sf_dir, "documents")
    keys = docs.select("doc_id", "text", F.crc32(text_or_empty("text")).alias("text_crc32"))
    return sharding.byte_shards(keys, shards=40, keep=("doc_id", "text_crc32")).select(
        "doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", "slot",
        F.lit(None).cast("int").alias("grown_shard"),
    )


def op2_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents with the toxicity of their whole texts."""
    docs = read(spark, sf_dir, "documents").select("doc_id", "text")
    scores = toxicity.toxicity(docs, read(spark, sf_dir, "labels"))
    return scores.select("doc_id", "held_out", "score", "predicted")


def op3_near_copies(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents with the component of their near copies."""
    return jaccard.near_copies(read(spark, sf_dir, "documents")).select("doc_id", "n_shingles", "component_id")


def op6_contained_items(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents that hold a benchmark item, with the share of its five-word shingles."""
    found = decontaminate.contained(read(spark, sf_dir, "documents"), read(spark, sf_dir, "benchmark"))
    return found.drop("text_hash")


def removed(spans: str) -> Column:
    """The length of all spans that an array of starts and ends holds."""
    sign = lambda x, i: F.when(i % 2 == 0, -x).otherwise(x)
    return F.aggregate(F.transform(spans, sign), F.lit(0).cast("long"), lambda a, x: a + x)


def op4_neighbours(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The ten nearest vectors of each hundredth one."""
    vectors = read(spark, sf_dir, "embeddings")
    return neighbours.nearest(vectors, F.col("vec_id") % 100 == 0)


def op5_unique_bytes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents without the strings of 50 bytes that a smaller doc_id has."""
    found = suffixes.unique_bytes(read(spark, sf_dir, "documents"))
    return found.select(
        "doc_id", "n_bytes", removed("spans").alias("n_removed"), (F.size("spans") / 2).cast("long").alias("n_spans"),
        F.sha2("kept", 256).alias("kept_sha256"),
    )


def op7_repeated_passages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents without the passages of 35 words that occur elsewhere."""
    found = substring.repeated_passages(read(spark, sf_dir, "documents"))
    return found.select("doc_id", "n_words", removed("spans").alias("n_removed"), F.sha2("kept", 256).alias("kept_sha256"))


def op8_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents with the words that the mix takes of each."""
    mix = mixing.mixed(read(spark, sf_dir, "documents"), keep=("doc_id", "source"))
    return mix.select(
        "doc_id", "size", "source_size", "target", (F.col("copies") * F.col("size")).alias("taken"),
        "source", "rate", "copies",
    )


def tokenizer_path() -> str:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json")


def op9_line_dedup(spark: SparkSession, sf_dir: str, alone: int | None = None) -> DataFrame:
    """All documents without the runs of two lines that occur earlier."""
    found = lines.deduplicated(read(spark, sf_dir, "documents").select("doc_id", "text"), alone=alone)
    gone = F.aggregate("spans", F.lit(0), lambda a, s: a + s["end"] - s["start"])
    return found.select("doc_id", "n_lines", gone.alias("n_removed"), F.size("spans").alias("n_runs"), F.sha2("kept", 256).alias("kept_sha256"))


def op9_line_dedup_alone(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same, also without lines that occur earlier and have twenty words or are the whole text."""
    return op9_line_dedup(spark, sf_dir, lines.ALONE)


def op10_token_counts(spark: SparkSession, sf_dir: str, path: str | None = None) -> DataFrame:
    """Tokens of every whole document, and what of it 512 tokens hold."""
    counts = tokencount.token_counts(read(spark, sf_dir, "documents"), path or tokenizer_path())
    return counts.withColumn("over_limit", F.col("n_tokens") > tokencount.LIMIT)


def op11_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents with the quality of their whole texts."""
    docs = read(spark, sf_dir, "documents").select("doc_id", "text")
    return quality.quality(docs, read(spark, sf_dir, "labels")).select("doc_id", "held_out", "score", "predicted")


UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def op12_manifest(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents as leaves of one tree, a fifth of them checked against texts put into lower case."""
    docs = read(spark, sf_dir, "documents").select("doc_id", "source", "lang", "n_chars", "text")
    before = [merkle.field(c) for c in ("doc_id", "source", "lang", "n_chars")]
    leaf = F.sha2(F.concat(*before, merkle.field("text")), 256)
    changed = F.sha2(F.concat(*before, merkle.sized(F.translate("text", UPPER, LOWER))), 256)
    seen = F.when(F.crc32(F.col("doc_id").cast("string")) % 5 == 0, changed)
    found = merkle.manifest(docs, leaf, "doc_id", "source", seen, keep=["doc_id"])
    return found.select("doc_id", "leaf", "subroot", "root", "proof_sha256", "folded_root", "verified")


def op13_vector_codes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All vectors as four codes each, with what the codes miss, and the codebooks' checksum."""
    found, books = codes.compressed(read(spark, sf_dir, "embeddings"), keep=["vec_id", "label"])
    told = codes.with_label_errors(written(found), "label")
    return told.select("vec_id", "code", "error", "label_error", F.lit(books.sha256()).alias("codebooks_sha256"))


__all__ = ["ORACLES", "QUERIES"]

QUERIES = {
    "op1_byte_shards": op1_byte_shards,
    "op2_toxicity": op2_toxicity,
    "op3_near_copies": op3_near_copies,
    "op4_neighbours": op4_neighbours,
    "op5_unique_bytes": op5_unique_bytes,
    "op6_contained_items": op6_contained_items,
    "op7_repeated_passages": op7_repeated_passages,
    "op8_mix": op8_mix,
    "op9_line_dedup": op9_line_dedup,
    "op9_line_dedup_alone": op9_line_dedup_alone,
    "op10_token_counts": op10_token_counts,
    "op11_quality": op11_quality,
    "op12_manifest": op12_manifest,
    "op13_vector_codes": op13_vector_codes,
}
