"""Benchmark decontamination by size-partitioned MinHash containment (operator 6), in DataFrame operations only.

A set that holds the share ``t`` of an item's n shingles lacks at most n - ceil(t * n) of them, so it
holds one of the item's n - ceil(t * n) + 1 smallest hashes: that many MinHash values find every
document, whatever its length. Documents are partitioned by the size of their sets, and an item
is looked for only from the first partition on whose sets are large enough to hold the share.
Candidates are verified by counting the item's distinct shingles in the whole document.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from plumbline.llm.common import checkpointed

#: Words in a shingle, and the least share of an item's shingles, in hundredths.
WIDTH = 5
PERCENT = 80
#: Rows of hashes or keys up to which a side is broadcast (16 to 32 bytes each); beyond, the join shuffles.
BROADCAST_ROWS = 200_000
_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def words(text: str) -> Column:
    """The words of a text, lower-cased in A-Z; none for null."""
    lower = F.translate(F.coalesce(F.col(f"`{text}`").cast("string"), F.lit("")), _UPPER, _LOWER)
    return F.array_remove(F.split(lower, r"[\x20\x09-\x0D]+"), "")


def shingle_hashes(text: str, width: int) -> Column:
    """The distinct hashes of the shingles; with fewer words, of the whole sequence; none without words."""
    hashes = F.transform(words(text), lambda w: F.xxhash64(w))

    def of(h: Column) -> Column:
        runs = F.transform(F.sequence(F.lit(0), F.size(h) - width), lambda i: F.xxhash64(*[F.get(h, i + k) for k in range(width)]))
        return F.when(F.size(h) >= width, runs).when(F.size(h) > 0, F.array(F.xxhash64(h))).otherwise(F.array().cast("array<long>"))

    # a lambda's argument is computed once, where a column would be for each shingle
    return F.array_distinct(F.get(F.transform(F.array(hashes), of), F.lit(0)))


def _small(df: DataFrame, rows: int) -> DataFrame:
    return F.broadcast(df) if rows <= BROADCAST_ROWS else df


def contained(
    docs: DataFrame, items: DataFrame, width: int = WIDTH, percent: int = PERCENT,
    text: str = "text", key: str = "doc_id", item_text: str = "text", item_key: str = "item_id",
) -> DataFrame:
    """(key, text_hash, item key, n_shingles, n_shared, containment) of each item that a document holds.

    Held means that at least ``percent`` hundredths of the item's distinct shingles are anywhere in the
    document. Null texts and texts without words hold nothing and are held nowhere. A text with
    fewer words than a shingle is one shingle of its own. Rows that repeat key and text are one
    document, or one item. No documents or no items give no rows; other columns are not read.
    """
    own = items.select(F.col(f"`{item_key}`").alias("item"), F.xxhash64(F.col(f"`{item_text}`")).alias("item_hash"), shingle_hashes(item_text, width).alias("all")).distinct()
    least = F.ceil(F.col("n") * percent / 100).cast("long")
    own = own.select("item", "item_hash", F.sort_array("all").alias("all"), F.size("all").cast("long").alias("n")).where("n > 0")
    own = checkpointed(own.select("item", "item_hash", "n", least.alias("least"), "all"))
    part = lambda n: F.floor(F.log2(n))  # noqa: E731  sets of 2**part to 2**(part + 1) - 1 shingles
    signature = own.select(F.explode(F.slice("all", F.lit(1), (F.col("n") - F.col("least") + 1).cast("int"))).alias("hash"), part(F.col("least")).alias("from"))
    signature = checkpointed(signature.groupBy("hash").agg(F.min("from").alias("from")))
    shingles = checkpointed(own.select("item", "item_hash", "n", "least", F.explode("all").alias("hash")))

    sets = docs.select(F.col(f"`{key}`").alias("key"), F.xxhash64(F.col(f"`{text}`")).alias("text_hash"), shingle_hashes(text, width).alias("all"))
    tried = sets.select("key", "text_hash", part(F.size("all")).alias("part"), F.explode("all").alias("hash"))
    found = tried.join(_small(signature, signature.count()), "hash").where("part >= from")
    found = checkpointed(found.select("key", "text_hash").distinct())
    n_found = found.count()

    able = _small(found.select(F.col("key").alias("_key"), F.col("text_hash").alias("_hash")), n_found)
    whole = docs.withColumn("_text", F.xxhash64(F.col(f"`{text}`")))
    whole = whole.join(able, (whole["_text"] == able["_hash"]) & whole[f"`{key}`"].eqNullSafe(able["_key"]), "left_semi")
    sets = whole.select(F.col(f"`{key}`").alias("key"), F.col("_text").alias("text_hash"), shingle_hashes(text, width).alias("all")).distinct()
    each = sets.select("key", "text_hash", F.explode("all").alias("hash")).join(_small(shingles, shingles.count()), "hash")
    pairs = each.groupBy("key", "text_hash", "item", "item_hash", "n", "least").agg(F.count(F.lit(1)).alias("n_shared"))
    pairs = pairs.where("n_shared >= least")
    return pairs.select(
        F.col("key").alias(key), "text_hash", F.col("item").alias(item_key), F.col("n").alias("n_shingles"), "n_shared",
        (F.col("n_shared") / F.col("n")).alias("containment"),
    )


def decontaminated(docs: DataFrame, items: DataFrame, text: str = "text", key: str = "doc_id", **options) -> DataFrame:
    """The documents that hold no item, as they are; null and empty texts stay."""
    held = checkpointed(contained(docs, items, text=text, key=key, **options).select(F.col(f"`{key}`").alias("_key"), F.col("text_hash").alias("_hash")).distinct())
    held = _small(held, held.count())
    same = F.xxhash64(docs[f"`{text}`"]).eqNullSafe(held["_hash"]) & docs[f"`{key}`"].eqNullSafe(held["_key"])
    return docs.join(held, same, "left_anti")
