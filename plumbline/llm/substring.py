"""Repeated word passages by seed and extend (operator 7).

Seeds are winnowed: of the grams of each window the smallest. A seed that occurs once in the
corpus ends there. The others are extended both ways: an occurrence's extension by ``l`` words to
the left and the rest of the window to the right is one fingerprint, and extensions that occur
more than once are repeats. Consecutive repeated windows join into maximal repeats, which are at
least one window long. Fingerprints, not occurrences, are matched: copies in one block are one.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from plumbline.llm import blocks as B
from plumbline.llm import words as W

#: Words in a window, and in a seed.
WINDOW = 35
SEED = 10

FOUND = "key long, n_words long, spans array<long>, kept string"
ARROW_FOUND = pa.schema([("key", pa.int64()), ("n_words", pa.int64()), ("spans", pa.list_(pa.int64())), ("kept", pa.string())])


class Seeds:
    """Per text of a block its words' hashes, its seeds and each window's seed, in one pass."""

    def __init__(self, texts: list[bytes], window: int, seed: int) -> None:
        self.powers, self.window = W.Powers(), window
        self.words: list[np.ndarray] = []
        self.least: list[np.ndarray] = []
        self.seeds: list[np.ndarray] = []
        none = np.zeros(0, W.U)
        for first, end in W.batches(texts):
            hashes, bounds = W.word_hashes(texts[first:end], self.powers)
            for a, b in zip(bounds[:-1], bounds[1:], strict=True):
                own = hashes[a:b]
                least = places = none
                if b - a >= window:
                    grams = W.rolling(own, seed, self.powers)
                    least, places = W.winnowed(grams, window - seed + 1)
                    places = grams[places]
                self.words.append(own)
                self.least.append(least)
                self.seeds.append(places)

    def all_seeds(self) -> np.ndarray:
        return np.concatenate([np.zeros(0, W.U), *self.seeds])

    def extended(self, seed_counts: np.ndarray) -> tuple[list[np.ndarray], np.ndarray]:
        """Per text the windows whose seed occurs elsewhere, and the fingerprints of all of these."""
        every = self.all_seeds()
        shared = np.unique(every[seed_counts > 1])
        able, prints = [], [np.zeros(0, W.U)]
        for own, least in zip(self.words, self.least, strict=True):
            place = np.searchsorted(shared, least)
            hit = np.flatnonzero(shared[np.minimum(place, len(shared) - 1)] == least) if len(shared) and len(least) else np.zeros(0, np.int64)
            able.append(hit)
            if len(hit):
                prints.append(W.rolling(own, self.window, self.powers)[hit])
        return able, np.concatenate(prints)


def spans_of(covered: np.ndarray) -> np.ndarray:
    """Starts and ends of the runs of True, one after the other."""
    return np.flatnonzero(np.diff(np.concatenate(([False], covered, [False]))))


def covered_by(windows: np.ndarray, width: int, n: int) -> np.ndarray:
    """Which of ``n`` places lie in a window of ``width`` that begins at one of ``windows``."""
    marks = np.zeros(n + 1, np.int64)
    marks[windows] += 1
    marks[windows + width] -= 1
    return np.cumsum(marks[:n]) > 0


def repeated_passages(df: DataFrame, text: str = "text", key: str = "doc_id", window: int = WINDOW, seed: int = SEED) -> DataFrame:
    """Per row its key, ``n_words``, the maximal repeated ``spans`` and the text ``kept`` without them.

    A word is in a span if a window of words that covers it occurs anywhere else in the corpus,
    in the same text too. ``spans`` holds the first word and the word after the last of each span
    in turn. ``kept`` are the other words, joined by one space. Null and empty texts have no words;
    texts shorter than a window are kept; repeated rows are copies of each other, so both lose
    what they share; no rows give no rows; other columns are not read.
    """
    blocks = B.packed(df, text, key)
    space, exact = B.GramSpace(B.total_bytes(blocks)), B.GramSpace(B.total_bytes(blocks))
    exact.bits = 64

    def seeds(texts: list[bytes]) -> np.ndarray:
        return Seeds(texts, window, seed).all_seeds()

    def extensions(_: tuple, left: pa.Table, answers: pa.Table) -> pa.Table:
        row = left.to_pylist()[0]
        found = Seeds(B.texts_of(row["body"], row["sizes"]), window, seed)
        _, prints = found.extended(B.counts_of(found.all_seeds(), answers, space))
        return pa.Table.from_batches([B.runs(row["block"], prints, exact)])

    def cut(_: tuple, left: pa.Table, answers: pa.Table) -> pa.Table:
        row = left.to_pylist()[0]
        texts = B.texts_of(row["body"], row["sizes"])
        found = Seeds(texts, window, seed)
        step = answers["step"].to_numpy()
        able, prints = found.extended(B.counts_of(found.all_seeds(), answers.filter(pa.array(step == 1)), space))
        counts = B.counts_of(prints, answers.filter(pa.array(step == 2)), exact)
        out, at = [], 0
        for key_, text_, words, windows in zip(row["keys"], texts, found.words, able, strict=True):
            repeated = windows[counts[at : at + len(windows)] > 1]
            at += len(windows)
            covered = covered_by(repeated, window, len(words))
            parts = text_.split()
            if len(repeated):
                parts = [parts[i] for i in np.flatnonzero(~covered).tolist()]
            out.append({"key": key_, "n_words": len(words), "spans": spans_of(covered), "kept": b" ".join(parts).decode()})
        return pa.Table.from_pylist(out, ARROW_FOUND)

    first = B.gram_counts(blocks, seeds, space)
    second = B.answered(blocks.groupBy("block").cogroup(first.groupBy("block")).applyInArrow(extensions, B.RUNS))
    both = first.withColumn("step", F.lit(1)).union(second.withColumn("step", F.lit(2)))
    return blocks.groupBy("block").cogroup(both.groupBy("block")).applyInArrow(cut, FOUND).withColumnRenamed("key", key)
