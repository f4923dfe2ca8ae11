"""Repeated byte strings by a distributed merge sort of suffixes (operator 5).

Suffixes are sparse: they start at the smallest gram of each window, and only at grams that occur
more than once in the corpus, so each window that could repeat belongs to one suffix. A block sorts
its suffixes (distinct ones, each with its smallest document) and sends them front-coded, as the
length in common with the one before and the rest, to ranges of the suffix order. A range merges
the runs of all blocks with a loser tree that compares only behind the known common prefix, and
gets the common prefixes of the whole order with it. From these it tells, for each window, whether
a smaller document has it: the window's right part is an interval of the order, its left part a
fingerprint. Only one bit per window goes back.
"""

from __future__ import annotations

from bisect import bisect_left
from itertools import pairwise

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from plumbline.llm import blocks as B
from plumbline.llm import words as W
from plumbline.llm.substring import covered_by, spans_of

#: Bytes in a window, and in the gram that a suffix starts with.
WINDOW = 50
GRAM = 26
#: Suffixes sampled for the bounds of the ranges, per range, and how many ranges there are at most.
SAMPLED = 32
MOST_RANGES = 20_000

RUNS = "range long, block long, n int, run binary"
TOLD = "block long, range long, told binary"
FOUND = "key long, n_bytes long, spans array<long>, kept binary"
ARROW_FOUND = pa.schema([("key", pa.int64()), ("n_bytes", pa.int64()), ("spans", pa.list_(pa.int64())), ("kept", pa.binary())])
#: The place of documents without a key: after all others.
LAST = np.iinfo(np.int64).max


class Suffixes:
    """The sparse suffixes of a block's texts."""

    def __init__(self, texts: list[bytes], window: int, gram: int) -> None:
        self.window, self.gram = window, gram
        self.left = window - gram
        self.parts, powers = [], W.Powers()
        for first, end in W.batches(texts):
            own = texts[first:end]
            gap = bytes(window)
            blob = np.frombuffer(gap + gap.join(own) + gap, np.uint8)
            sizes = np.array([len(t) for t in own], np.int64)
            starts = window + np.concatenate(([0], np.cumsum(sizes + window)[:-1]))
            grams = W.rolling(W.BYTE[blob], gram, powers)
            least = W.sliding(grams, self.left + 1, np.minimum)
            inside = np.zeros(len(least) + 1, np.int64)  # windows within one text
            long = sizes >= window
            np.add.at(inside, starts[long], 1)
            np.add.at(inside, (starts + sizes - window + 1)[long], -1)
            inside = np.cumsum(inside[:-1]) > 0
            edge = np.zeros(self.left, W.U)
            most = W.sliding(np.concatenate((edge, np.where(inside, least, W.U(0)), edge)), self.left + 1, np.maximum)
            places = np.flatnonzero((grams == most) & (most > 0))
            windows = np.flatnonzero(inside)
            self.parts.append((first, blob, starts, sizes, places, grams[places], windows, least[windows]))

    def seeds(self) -> np.ndarray:
        return np.concatenate([np.zeros(0, W.U), *[p[5] for p in self.parts]])

    def shared(self, counts: np.ndarray, keys: np.ndarray) -> tuple:
        """Suffixes whose gram occurs elsewhere: context, windows as bits, document, part and place of each.

        A context is the suffix up to a window's length and then what is left of it; bit ``l`` stands
        for the window that begins ``l`` bytes before the suffix.
        """
        shared = np.unique(self.seeds()[counts > 1])
        contexts, bits, docs, parts, at = [], [], [], [], []
        reach = np.concatenate((np.arange(self.window), np.arange(-self.left, 0)))
        for k, (first, blob, starts, _, places, grams, windows, least) in enumerate(self.parts):
            if not len(shared) or not len(windows):
                continue
            hit = shared[np.minimum(np.searchsorted(shared, least), len(shared) - 1)] == least
            windows, least = windows[hit], least[hit]
            if not len(windows):
                continue
            owner = np.searchsorted(places, windows)
            while len(odd := np.flatnonzero(grams[owner] != least)):
                owner[odd] += 1
            own = np.flatnonzero(np.diff(owner, prepend=-1))  # owners ascend with the windows
            bit = np.left_shift(np.uint32(1), (places[owner] - windows).astype(np.uint32))
            at.append(places[owner[own]])
            bits.append(np.bitwise_or.reduceat(bit, own))
            contexts.append(blob[at[-1][:, None] + reach])
            docs.append(keys[first + np.searchsorted(starts, at[-1], side="right") - 1])
            parts.append(np.full(len(own), k))
        if not at:
            return np.zeros((0, len(reach)), np.uint8), *[np.zeros(0, t) for t in (np.uint32, np.int64, np.int64, np.int64)]
        return tuple(map(np.concatenate, (contexts, bits, docs, parts, at)))


def distinct_suffixes(contexts: np.ndarray, bits: np.ndarray, docs: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The first row of each distinct suffix in order, each row's distinct suffix, and its smallest document."""
    n = len(bits)
    # the last byte keeps zeros before it from being taken for padding
    rows = np.hstack([contexts, bits.astype(">u4").view(np.uint8).reshape(n, 4), np.ones((n, 1), np.uint8)])
    _, first, place = np.unique(np.ascontiguousarray(rows).view(f"S{rows.shape[1]}").ravel(), return_index=True, return_inverse=True)
    low = np.full(len(first), LAST)
    np.minimum.at(low, place, docs)
    return first, place, low


def common(rows: np.ndarray) -> np.ndarray:
    """Bytes that each row has in common with the one before; 0 for the first."""
    if not len(rows):
        return np.zeros(0, np.uint8)
    same = rows[1:] == rows[:-1]
    return np.concatenate(([0], np.where(same.all(axis=1), rows.shape[1], same.argmin(axis=1)))).astype(np.uint8)


def front_coded(contexts: np.ndarray, bits: np.ndarray, docs: np.ndarray, window: int) -> bytes:
    right, left = contexts[:, :window], contexts[:, window:]
    lengths = common(right)
    rest = right[np.arange(window) >= lengths[:, None]]
    data = (lengths.tobytes(), left.tobytes(), bits.astype("<u4").tobytes(), docs.astype("<i8").tobytes(), rest.tobytes())
    return zstandard.ZstdCompressor(level=3).compress(b"".join(data))


def decoded(data: bytes, n: int, window: int, left: int) -> tuple[np.ndarray, ...]:
    """Right parts, common lengths, left parts, bits and documents of a front-coded run."""
    raw = zstandard.ZstdDecompressor().decompress(data)
    ends = np.cumsum([n, n * left, n * 4, n * 8])
    lengths, lefts, bits, docs = (np.frombuffer(raw[a:b], np.uint8) for a, b in pairwise([0, *ends.tolist()]))
    rest = np.frombuffer(raw[ends[-1] :], np.uint8)
    begin = np.concatenate(([0], np.cumsum(window - lengths.astype(np.int64))[:-1]))
    right = np.empty((n, window), np.uint8)
    row = np.arange(n)
    for c in range(window):
        # the last row that spells this byte out
        source = np.maximum.accumulate(np.where(lengths <= c, row, 0))
        right[:, c] = rest[begin[source] + c - lengths[source]]
    return right, lengths, lefts.reshape(n, left), bits.view("<u4"), docs.view("<i8")


def merged(runs: list[tuple[list[int], list[int]]], width: int) -> tuple[list[int], list[int]]:
    """The order of sorted runs as run numbers, and what each string has in common with the one before.

    A run has its strings of ``width`` bytes as numbers, and their common lengths. In the tree each
    loser knows the bytes it has in common with the last winner. The one with more comes first;
    only where two have equally many are the bytes behind those compared.
    """
    k = 1 << max(1, (len(runs) - 1).bit_length())
    values = [r[0] for r in runs] + [[]] * (k - len(runs))
    lengths = [r[1] for r in runs] + [[]] * (k - len(runs))
    place = [0] * k
    known = [0 if v else -1 for v in values]  # -1: the run has ended
    now = [v[0] if v else 0 for v in values]
    losers, out, shared = [0] * k, [], []

    def first_of(node: int) -> int:
        """The winner below a node, at the start."""
        if node >= k:
            return node - k
        a, b = first_of(2 * node), first_of(2 * node + 1)
        if known[b] < 0 or known[a] >= 0 and now[a] <= now[b]:
            a, b = b, a
        # b wins
        losers[node] = a
        if known[a] >= 0:
            known[a] = width - (((now[a] ^ now[b]).bit_length() + 7) >> 3)
        return b

    r = first_of(1)
    length = known[r]
    for _ in range(sum(map(len, values))):
        out.append(r)
        shared.append(length)
        place[r] = i = place[r] + 1
        if i < len(values[r]):
            now[r], length = values[r][i], lengths[r][i]
        else:
            length = -1
        node = (r + k) >> 1
        while node:
            other = losers[node]
            theirs = known[other]
            if length < theirs:
                losers[node], known[r] = r, length
                r, length = other, theirs
            elif length == theirs and length >= 0:
                differ = now[r] ^ now[other]
                both = width - ((differ.bit_length() + 7) >> 3)
                if now[r] <= now[other]:
                    known[other] = both
                else:
                    losers[node], known[r] = r, both
                    r = other
            node >>= 1
    return out, shared


def told_windows(runs: list[tuple[np.ndarray, ...]], window: int, left: int) -> list[np.ndarray]:
    """For each run's suffixes the bits of the windows that a smaller document has."""
    as_numbers = lambda rows: [int.from_bytes(r) for r in rows.view(f"V{window}").ravel().tolist()]
    order, shared = merged([(as_numbers(np.ascontiguousarray(r[0])), r[1].tolist()) for r in runs], window)
    order, shared = np.array(order, np.int64), np.array(shared, np.int64)
    # rows in the merged order; each run's rows keep their own order
    back = np.argsort(order, kind="stable")
    sizes = np.cumsum([len(r[1]) for r in runs])
    place = np.empty(len(order), np.int64)
    place[back] = np.arange(len(order))
    lefts, bits, docs = (np.concatenate([r[i] for r in runs])[place] for i in (2, 3, 4))
    out, prints = np.zeros(len(order), np.uint32), np.zeros(len(order), W.U)
    for l in range(left + 1):  # noqa: E741
        if l:
            prints = W.mix(prints + lefts[:, left - l].astype(W.U) + W.U(l << 8))
        rows = np.flatnonzero(bits >> np.uint32(l) & 1)
        if not len(rows):
            continue
        interval = np.cumsum(shared < window - l).astype(W.U)
        group = W.mix(prints + interval * W.U(0x9E3779B97F4A7C15))[rows]
        by = np.argsort(group, kind="stable")
        new = np.flatnonzero(np.concatenate(([True], group[by][1:] != group[by][:-1])))
        low = np.repeat(np.minimum.reduceat(docs[rows][by], new), np.diff([*new, len(by)]))
        smaller = rows[by][docs[rows][by] > low]
        out[smaller] |= np.uint32(1 << l)
    return np.split(out[back], sizes[:-1])


def unique_bytes(df: DataFrame, text: str = "text", key: str = "doc_id", window: int = WINDOW, gram: int = GRAM) -> DataFrame:
    """Per row its key, ``n_bytes``, the repeated ``spans`` and the bytes ``kept`` without them.

    A byte is in a span if a string of ``window`` bytes that covers it also starts in a row with a
    smaller key; overlapping strings count, and all are judged on the input. ``spans`` holds the first
    byte and the byte after the last of each maximal run in turn. Null texts are empty; texts shorter
    than a window are kept; a null key is larger than all others, and rows with one key, repeated
    rows too, take nothing from each other. No rows give no rows; other columns are not read.
    """
    blocks = B.packed(df, text, key)
    raw = B.total_bytes(blocks)
    space = B.GramSpace(raw)
    left = window - gram

    def block_of(table: pa.Table) -> tuple[dict, list[bytes], Suffixes, np.ndarray]:
        row = table.to_pylist()[0]
        texts = B.texts_of(row["body"], row["sizes"])
        return row, texts, Suffixes(texts, window, gram), np.array([LAST if k is None else k for k in row["keys"]], np.int64)

    def grams(texts: list[bytes]) -> np.ndarray:
        return Suffixes(texts, window, gram).seeds()

    ranges = min(MOST_RANGES, max(64, raw // B.RANGE_BYTES))
    n_blocks = max(1, blocks.count())
    each = max(1, SAMPLED * ranges // n_blocks)

    def sampled(batches):
        for batch in batches:
            for row in batch.to_pylist():
                rng = np.random.default_rng(row["block"])
                data = b"\0".join(B.texts_of(row["body"], row["sizes"]))
                places = rng.integers(0, max(1, len(data) - gram), each).tolist()
                yield pa.RecordBatch.from_arrays([pa.array([data[p : p + gram] for p in places], pa.binary())], ["gram"])

    # at most SAMPLED grams for each of at most MOST_RANGES ranges
    some = sorted(bytes(r[0]) for r in blocks.select("block", "sizes", "body").mapInArrow(sampled, "gram binary").collect())
    bounds = sorted(set(some[:: max(1, len(some) // ranges)][1:]))

    def send(_: tuple, table: pa.Table, answers: pa.Table) -> pa.Table:
        row, _, found, keys = block_of(table)
        contexts, bits, docs, *_ = found.shared(B.counts_of(found.seeds(), answers, space), keys)
        first, _, low = distinct_suffixes(contexts, bits, docs)
        contexts, bits = contexts[first], bits[first]
        head = np.ascontiguousarray(contexts[:, :gram])
        starts = np.array([bisect_left(Rows(head), b) for b in bounds], np.int64)
        cuts = [0, *starts.tolist(), len(bits)]
        out = [
            {"range": i, "block": row["block"], "n": b - a, "run": front_coded(contexts[a:b], bits[a:b], low[a:b], window)}
            for i, (a, b) in enumerate(pairwise(cuts)) if b > a
        ]
        return pa.Table.from_pylist(out, pa.schema([("range", pa.int64()), ("block", pa.int64()), ("n", pa.int32()), ("run", pa.binary())]))

    def merge(table: pa.Table) -> pa.Table:
        runs = [decoded(r, n, window, left) for r, n in zip(table["run"].to_pylist(), table["n"].to_pylist(), strict=True)]
        back = [t.astype("<u4").tobytes() for t in told_windows(runs, window, left)]
        return pa.table({"block": table["block"], "range": table["range"], "told": pa.array(back, pa.binary())})

    def cut(_: tuple, table: pa.Table, answers: pa.Table) -> pa.Table:
        row, texts, found, keys = block_of(table)
        step = answers["step"].to_numpy()
        contexts, bits, docs, parts, at = found.shared(B.counts_of(found.seeds(), answers.filter(pa.array(step == 1)), space), keys)
        _, place, low = distinct_suffixes(contexts, bits, docs)
        del contexts
        told = B.told(answers.filter(pa.array(step == 2))).view("<u4")
        repeated = np.where(docs > low[place], bits, told[place]) if len(bits) else bits
        out = []
        for k, (first, _, starts, sizes, *_) in enumerate(found.parts):
            own = np.flatnonzero(parts == k)
            windows = [at[own[repeated[own] >> np.uint32(l) & 1 > 0]] - l for l in range(left + 1)]
            covered = covered_by(np.concatenate(windows), window, int(starts[-1] + sizes[-1]) + window)
            for i, (a, n) in enumerate(zip(starts.tolist(), sizes.tolist(), strict=True)):
                here, text_ = covered[a : a + n], texts[first + i]
                kept = np.frombuffer(text_, np.uint8)[~here].tobytes() if here.any() else text_
                out.append({"key": row["keys"][first + i], "n_bytes": n, "spans": spans_of(here), "kept": kept})
        return pa.Table.from_pylist(out, ARROW_FOUND)

    first = B.gram_counts(blocks, grams, space)
    sent = blocks.groupBy("block").cogroup(first.groupBy("block")).applyInArrow(send, RUNS)
    second = sent.groupBy("range").applyInArrow(merge, TOLD)
    both = first.withColumn("step", F.lit(1)).union(second.withColumn("step", F.lit(2)))
    return blocks.groupBy("block").cogroup(both.groupBy("block")).applyInArrow(cut, FOUND).withColumnRenamed("key", key)


class Rows:
    """The rows of a byte matrix as a sequence of byte strings, made one at a time."""

    def __init__(self, rows: np.ndarray) -> None:
        self.rows = rows

    def __len__(self) -> int:
        return len(self.rows)

    def __getitem__(self, i: int) -> bytes:
        return self.rows[i].tobytes()
