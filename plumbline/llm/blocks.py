"""Documents in blocks of a few megabytes, and the count of every gram over all blocks.

A block's grams are hashed, made distinct and sent as sorted, front-coded runs to the ranges of the
hash space; each range answers every block with the number of times each of its grams occurs
anywhere. A gram with a third of all occurrences is one entry per block. Only counts come back,
in the block's own order, so the answer to a block is one byte per distinct gram.
"""

from __future__ import annotations

import ctypes
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from plumbline.llm.common import shipped, text_or_empty, written

#: Text in a block, and text whose grams meet in one range.
BLOCK_BYTES = 4 << 20
RANGE_BYTES = 4 << 20
#: Bits of a row's number within its block, and of a block's within its partition. Numbers of rows
#: hold both and 23 bits of the partition, so they stay below 2 ** 63.
ROW_BITS = 20
BLOCK_BITS = 20
#: Bits of a hash beyond those that number the bytes of the corpus: one gram in 2 ** 12 at most
#: is taken for another one here. What follows compares the grams themselves.
SPARE_BITS = 12
#: Counts are told up to this.
MOST = 255
U = np.uint64
_LIBC = ctypes.CDLL(None)

BLOCKS = "block long, keys array<long>, sizes array<int>, raw long, body binary"


def packed(df: DataFrame, text: str = "text", key: str = "doc_id", block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """Blocks of whole texts (null: empty) with their keys, compressed, as a table in the shared folder.

    A block ends before ``block_bytes`` are exceeded, and after ``2 ** ROW_BITS`` texts.
    """
    shipped(df.sparkSession)
    rows = df.select(F.col(f"`{key}`").cast("long").alias("key"), text_or_empty(text).alias("text"))

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        first, n, keys, texts, raw = TaskContext.get().partitionId() << BLOCK_BITS, 0, [], [], 0

        def block() -> pa.RecordBatch:
            if n >> BLOCK_BITS:
                raise OverflowError(f"more than {1 << BLOCK_BITS} blocks in a partition")
            body = zstandard.ZstdCompressor(level=3).compress(b"".join(texts))
            arrays = [
                pa.array([first + n], pa.int64()), pa.array([keys], pa.list_(pa.int64())),
                pa.array([[len(t) for t in texts]], pa.list_(pa.int32())), pa.array([raw], pa.int64()), pa.array([body], pa.binary()),
            ]
            return pa.RecordBatch.from_arrays(arrays, ["block", "keys", "sizes", "raw", "body"])

        for batch in batches:
            for key_, value in zip(batch.column("key").to_pylist(), batch.column("text"), strict=True):
                data = value.as_buffer().to_pybytes()
                if raw and raw + len(data) > block_bytes or len(keys) >> ROW_BITS:
                    yield block()
                    n, keys, texts, raw = n + 1, [], [], 0
                keys.append(key_)
                texts.append(data)
                raw += len(data)
        if keys:
            yield block()

    return written(rows.mapInArrow(pack, BLOCKS), compression="none")


def released() -> None:
    """Gives the memory that a block took back to the system, since workers live on between tasks."""
    pa.default_memory_pool().release_unused()
    if trim := getattr(_LIBC, "malloc_trim", None):
        trim(0)


def total_bytes(blocks: DataFrame) -> int:
    return blocks.agg(F.sum("raw")).first()[0] or 0


def texts_of(body: bytes, sizes: list[int]) -> list[bytes]:
    data = zstandard.ZstdDecompressor().decompress(body, max_output_size=max(1, sum(sizes))) if sum(sizes) else b""
    ends = np.cumsum(sizes)
    return [data[e - s : e] for e, s in zip(ends.tolist(), sizes, strict=True)]


def squeezed(numbers: np.ndarray) -> bytes:
    """Ascending numbers as their differences, in as few bytes each as all of them need."""
    steps = np.diff(numbers, prepend=numbers[:1] * 0).astype("<u8")
    width = max(1, (int(steps.max(initial=0)).bit_length() + 7) // 8)
    return bytes([width]) + np.ascontiguousarray(steps.view(np.uint8).reshape(-1, 8)[:, :width]).tobytes()


def unsqueezed(data: bytes) -> np.ndarray:
    width = data[0]
    steps = np.zeros(((len(data) - 1) // width, 8), dtype=np.uint8)
    steps[:, :width] = np.frombuffer(data, np.uint8, offset=1).reshape(-1, width)
    return np.cumsum(steps.view("<u8").ravel(), dtype=U)


class GramSpace:
    """How many bits of a hash count in a corpus of this size, and into how many ranges they fall."""

    def __init__(self, raw: int, range_bytes: int = RANGE_BYTES) -> None:
        self.bits = min(64, max(32, raw.bit_length() + SPARE_BITS))
        self.range_bits = max(6, (raw // range_bytes).bit_length())

    def cut(self, hashes: np.ndarray) -> np.ndarray:
        return hashes >> U(64 - self.bits)

    def ranges(self, distinct: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The ranges of ascending cut hashes, and where each begins."""
        return np.unique((distinct >> U(self.bits - self.range_bits)).astype(np.int64), return_index=True)


def runs(block: int, hashes: np.ndarray, space: GramSpace) -> pa.RecordBatch:
    """A block's distinct cut hashes and their counts, a row per range."""
    distinct, counts = np.unique(space.cut(hashes), return_counts=True)
    counts = np.minimum(counts, MOST).astype(np.uint8)
    ranges, starts = space.ranges(distinct)
    cuts = list(zip(starts, [*starts[1:], len(distinct)], strict=True)) if len(distinct) else []
    arrays = [
        pa.array(ranges, pa.int64()), pa.array([block] * len(ranges), pa.int64()),
        pa.array([squeezed(distinct[a:b]) for a, b in cuts], pa.binary()), pa.array([counts[a:b].tobytes() for a, b in cuts], pa.binary()),
    ]
    return pa.RecordBatch.from_arrays(arrays, ["range", "block", "grams", "counts"])


RUNS = "range long, block long, grams binary, counts binary"
ANSWERS = "block long, range long, told binary"


def answered(sent: DataFrame) -> DataFrame:
    """Rows (block, range, told) from runs of all blocks: in a run's order, how often each gram occurs."""

    def answer(group: pa.Table) -> pa.Table:
        each = [unsqueezed(g) for g in group["grams"].to_pylist()]
        own = np.frombuffer(b"".join(group["counts"].to_pylist()), np.uint8)
        _, place = np.unique(np.concatenate(each), return_inverse=True)
        counts = np.minimum(np.bincount(place, weights=own), MOST).astype(np.uint8)[place]
        ends = np.cumsum([len(r) for r in each])
        back = [counts[e - len(r) : e].tobytes() for e, r in zip(ends, each, strict=True)]
        return pa.table({"block": group["block"], "range": group["range"], "told": pa.array(back, pa.binary())})

    return sent.groupBy("range").applyInArrow(answer, ANSWERS)


def gram_counts(blocks: DataFrame, grams: Callable[[list[bytes]], np.ndarray], space: GramSpace) -> DataFrame:
    """How often each distinct gram of a block occurs in all blocks, as ``answered`` tells it.

    ``grams`` hashes all grams of a list of texts; each occurrence that it returns counts once.
    """

    def send(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in batch.to_pylist():
                yield runs(row["block"], grams(texts_of(row["body"], row["sizes"])), space)
                released()

    return answered(blocks.select("block", "sizes", "body").mapInArrow(send, RUNS))


def told(answers: pa.Table) -> np.ndarray:
    """The counts of a block's distinct cut hashes, from the answers of all ranges."""
    order = np.argsort(answers["range"].to_numpy())
    parts = answers["told"].to_pylist()
    return np.frombuffer(b"".join(parts[i] for i in order), np.uint8)


def counts_of(hashes: np.ndarray, answers: pa.Table, space: GramSpace) -> np.ndarray:
    """The counts of a block's hashes, each in its place; ``hashes`` are those that were sent."""
    distinct, place = np.unique(space.cut(hashes), return_inverse=True)
    return told(answers)[place] if len(distinct) else np.zeros(0, np.uint8)
