"""Quality by the labels of the nearest texts (operator 11).

A text is the counts of its runs of three bytes, dealt into a fixed number of terms and weighted by how
rare each term is among all documents, beside its shape: shares such as those of repeated words, marks
and capitals, in steps that are terms too. The leading directions of such vectors, from a bounded sample,
span a latent-semantic space. A bounded sample of labelled rows is placed in it and goes to every task;
there each document's cosine with every labelled row is computed, block by block, and the labels of
the nearest ones vote with their similarity. How many neighbours vote is chosen by leaving out each
labelled row in turn.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from plumbline.llm import words as W
from plumbline.llm.common import checkpointed, shipped, text_or_empty

#: Labelled rows that vote, and rows that the latent space is made from, at most (about).
LABELLED = 8_000
BASIS = 1_500
#: Terms (a power of two) and latent dimensions.
TERM_BITS = 14
TERMS = 1 << TERM_BITS
LATENT = 64
#: What a text's shape weighs in its vector, the steps of a share of it, and how many shares there are.
SHAPE, STEPS, SHARES = 0.5, 12, 7
WIDTH = TERMS + SHARES * (STEPS + 1)
#: Kinds of bytes: other, upper-case and lower-case ASCII letters, digits, and marks.
KINDS = 5
#: Numbers of neighbours that are tried.
NEIGHBOURS = (5, 9, 15, 25)
THRESHOLD = 0.3
#: Texts and bytes counted together; a longer text is counted in pieces of so many bytes.
TEXTS, BYTES, PIECE = 128, 1 << 18, 1 << 20
#: What the share of good labels weighs in a vote.
PRIOR = 0.05
_POWERS = W.Powers()
_KIND = np.array([1 if 65 <= b <= 90 else 2 if 97 <= b <= 122 else 3 if 48 <= b <= 57 else 4 if 33 <= b <= 126 else 0 for b in range(256)])


def held_out(key: str) -> Column:
    """Rows whose labels are never learned from."""
    return F.coalesce(F.crc32(F.col(f"`{key}`").cast("string")) % 5 == 0, F.lit(False))


def terms(blob: np.ndarray) -> np.ndarray:
    """The term of each run of three bytes."""
    x = blob.astype(np.uint32)
    runs = x[:-2] << 16 | x[1:-1] << 8 | x[2:]
    return (runs * np.uint32(2654435761)) >> np.uint32(32 - TERM_BITS)


@dataclass
class Counts:
    """A few texts: how often each has each term [text, term], and the shares that make up its shape [text, share]."""

    often: np.ndarray
    shape: np.ndarray


def _tallies(texts: list[bytes]) -> np.ndarray:
    """Per text its words, those that one of the three words before them repeats, and its bytes of some kinds."""
    hashes, bounds = W.word_hashes(texts, _POWERS)
    again = np.zeros(len(hashes), bool)
    owner = np.repeat(np.arange(len(texts)), np.diff(bounds))
    for lag in (1, 2, 3):
        again[lag:] |= (hashes[lag:] == hashes[:-lag]) & (owner[lag:] == owner[:-lag])
    blob = np.frombuffer(b"".join(texts), np.uint8)
    of = np.repeat(np.arange(len(texts)), [len(t) for t in texts])
    kinds = np.bincount(of * KINDS + _KIND[blob], minlength=len(texts) * KINDS).reshape(-1, KINDS)
    repeated = np.bincount(owner, weights=again, minlength=len(texts))
    return np.column_stack([np.diff(bounds), repeated, kinds])


def _shares(tallies: np.ndarray, distinct: np.ndarray, total: np.ndarray) -> np.ndarray:
    """Shares from 0 to 1: repeated words, kinds of bytes, distinct terms, length of words and of the text."""
    n_words, repeated, kinds = tallies[:, 0], tallies[:, 1], tallies[:, 2:]
    size = np.maximum(1, kinds.sum(axis=1))
    share = lambda part, whole: part / np.maximum(1, whole)
    return np.column_stack([
        share(repeated, n_words), share(kinds[:, 1], kinds[:, 1] + kinds[:, 2]), share(kinds[:, 3], size), share(kinds[:, 4], size),
        share(distinct, total), np.minimum(1, size / np.maximum(1, n_words) / 16), np.minimum(1, np.log2(1 + size) / 24),
    ])


def counts(texts: Sequence[str]) -> Iterator[Counts]:
    """The counts of each text, a few texts at a time, in order.

    A text stands between two spaces, so one letter is a term too; an empty text has none. Words that
    lie across the pieces of a very long text count as two.
    """
    framed: list[bytes] = []
    size = 0

    def block() -> Counts:
        if len(framed) == 1:
            text, often, tallies = framed[0], np.zeros(TERMS, np.int64), np.zeros((1, 2 + KINDS))
            for start in range(0, max(1, len(text)), PIECE):
                tallies += _tallies([text[start : start + PIECE]])
                if len(text) - start > 2:
                    often += np.bincount(terms(np.frombuffer(text[start : start + PIECE + 2], np.uint8)), minlength=TERMS)
            often = often[None]
        else:
            tallies = _tallies(framed)
            blob = np.frombuffer(b"".join(framed), np.uint8)
            owner = np.repeat(np.arange(len(framed)), [len(t) for t in framed])
            keys = np.zeros(0, np.int64)
            if len(blob) > 2:
                inside = owner[:-2] == owner[2:]
                keys = owner[:-2][inside] * TERMS + terms(blob)[inside]
            often = np.bincount(keys, minlength=len(framed) * TERMS).reshape(len(framed), TERMS)
        return Counts(often, _shares(tallies, (often > 0).sum(axis=1), often.sum(axis=1)))

    for text in texts:
        own = b" " + text.encode() + b" " if text else b""
        if framed and (len(framed) >= TEXTS or size + len(own) > BYTES):
            yield block()
            framed, size = [], 0
        framed.append(own)
        size += len(own)
    if framed:
        yield block()


def weighted(found: Counts, rarity: np.ndarray) -> np.ndarray:
    """[text, term or step of a share]: vectors of length one, or zero for a text without terms.

    A share lies between two of its steps and counts for both, the nearer one more.
    """
    rows = np.log1p(found.often.astype(np.float32)) * rarity
    length = np.sqrt((rows * rows).sum(axis=1, keepdims=True))
    rows = rows / np.maximum(length, 1e-9) * np.float32(np.sqrt(1 - SHAPE))
    n, s = found.shape.shape
    steps = np.zeros((n, s, STEPS + 1), np.float32)
    at = np.sqrt(np.clip(found.shape, 0, 1)) * STEPS  # finer steps for small shares
    low = np.minimum(at.astype(np.int64), STEPS - 1)
    i, j = np.indices((n, s))
    steps[i, j, low], steps[i, j, low + 1] = 1 - (at - low), at - low
    steps = steps.reshape(n, -1)
    steps *= np.float32(np.sqrt(SHAPE)) / np.sqrt((steps * steps).sum(axis=1, keepdims=True))
    return np.concatenate([rows, np.where(length > 0, steps, 0)], axis=1)


def latent_space(rows: np.ndarray, dimensions: int = LATENT) -> np.ndarray:
    """[term, dimension]: the leading right singular vectors of the rows, through their products."""
    if not len(rows):
        return np.zeros((WIDTH, 1), np.float32)
    values, vectors = np.linalg.eigh((rows @ rows.T).astype(np.float64))
    lead = np.argsort(-values)[: min(dimensions, len(rows))]
    lead = lead[values[lead] > 1e-9 * max(values.max(), 1e-30)]
    if not len(lead):
        return np.zeros((WIDTH, 1), np.float32)
    return (rows.T @ (vectors[:, lead] / np.sqrt(values[lead])).astype(np.float32)).astype(np.float32)


@dataclass
class Model:
    """The terms' weights, the latent space, and the labelled rows in it."""

    rarity: np.ndarray
    space: np.ndarray
    vectors: np.ndarray
    labels: np.ndarray
    prior: float = 0.5
    neighbours: int = NEIGHBOURS[0]

    def places(self, texts: Sequence[str]) -> Iterator[np.ndarray]:
        """Unit vectors of the texts, a few at a time; a text without terms is at zero."""
        for found in counts(texts):
            at = weighted(found, self.rarity) @ self.space
            length = np.sqrt((at * at).sum(axis=1, keepdims=True))
            yield np.where(length > 1e-6, at / np.maximum(length, 1e-6), 0).astype(np.float32)

    def scores(self, texts: Sequence[str]) -> np.ndarray:
        """The share of good labels around each text."""
        found = [votes(at @ self.vectors.T, self.labels, self.prior, self.neighbours) for at in self.places(texts)]
        return np.concatenate(found) if found else np.zeros(0)


def votes(similar: np.ndarray, labels: np.ndarray, prior: float, neighbours: int) -> np.ndarray:
    """[row, labelled] similarities into each row's mean label of its neighbours, weighted by similarity.

    Similarities count to five decimals; all that are as near as the last neighbour vote, and none that
    isn't similar at all. The prior has a small weight, all of it where there is no neighbour.
    """
    near = np.round(np.maximum(similar, 0), 5)
    if near.shape[1] > neighbours:
        last = np.partition(near, near.shape[1] - neighbours, axis=1)[:, near.shape[1] - neighbours]
        near = np.where(near >= last[:, None], near, 0)
    near = near.astype(np.float64)
    return (near @ labels + PRIOR * prior) / (near.sum(axis=1) + PRIOR)


def chosen_neighbours(vectors: np.ndarray, labels: np.ndarray, prior: float) -> int:
    """The number of neighbours whose votes miss the labels least, each row's own being left out."""
    missed = dict.fromkeys(NEIGHBOURS, 0.0)
    for a in range(0, len(vectors), 512):
        similar = vectors[a : a + 512] @ vectors.T
        similar[np.arange(len(similar)), np.arange(a, a + len(similar))] = 0
        for k in NEIGHBOURS:
            missed[k] += float(((votes(similar, labels, prior, k) - labels[a : a + 512]) ** 2).sum())
    return min(missed, key=lambda k: (round(missed[k], 6), k))


def rarity_of(texts: DataFrame) -> np.ndarray:
    """Of each term the logarithm of how rarely texts have it, over all rows: one number a term reaches the driver."""

    def seen(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        often, rows = np.zeros(TERMS, np.int64), 0
        for batch in batches:
            for block in counts(batch.column("text").to_pylist()):
                often += (block.often > 0).sum(axis=0)
            rows += batch.num_rows
        used = np.flatnonzero(often)
        yield pa.RecordBatch.from_arrays(
            [pa.array(np.append(used, -1).astype(np.int32)), pa.array(np.append(often[used], rows))], ["term", "n"]
        )

    told = texts.mapInArrow(seen, "term int, n bigint").groupBy("term").agg(F.sum("n").alias("n")).collect()
    often = {r["term"]: r["n"] for r in told}
    rows, out = often.pop(-1, 0), np.full(TERMS, 0.0)
    for term, n in often.items():
        out[term] = np.log((1 + rows) / (1 + n)) + 0.1  # a term of all documents still tells how often it is used
    return out.astype(np.float32)


def fit(df: DataFrame, labels: DataFrame, text: str = "text", key: str = "doc_id", label: str = "quality") -> Model:
    """A model from the labels of rows that are not held out; the terms' rarity is that among all rows.

    About LABELLED rows are taken by a hash of the key, with the mean label of their key; BASIS of them
    make the latent space. Null labels and keys are ignored. Without labels every text scores 0.5; with
    labels of one kind, nearly that label.
    """
    shipped(df.sparkSession)
    texts = df.select(F.col(f"`{key}`").alias("key"), text_or_empty(text).alias("text"))
    rarity = rarity_of(texts.select("text"))
    known = labels.where(F.col(f"`{label}`").isNotNull() & F.col(f"`{key}`").isNotNull())
    known = known.groupBy(F.col(f"`{key}`").alias("key")).agg(F.avg((F.col(f"`{label}`") > 0).cast("double")).alias("y"))
    known = known.where(~held_out("key"))
    share = min(1.0, LABELLED / max(1, known.count()))
    known = known.where(F.pmod(F.xxhash64("key"), F.lit(1 << 20)) < int(share * (1 << 20)))
    # about LABELLED rows of two numbers; their texts stay in the tasks
    sample = checkpointed(texts.join(F.broadcast(known), "key").select("key", "text", "y"))
    total = sample.count()

    def sparse(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for block in counts(batch.column("text").to_pylist()):
                at, values = [], []
                for row in weighted(block, rarity):
                    at.append(np.flatnonzero(row).astype(np.int32))
                    values.append(row[at[-1]])
                yield pa.RecordBatch.from_arrays([pa.array(at, pa.list_(pa.int32())), pa.array(values, pa.list_(pa.float32()))], ["at", "value"])

    share = min(1.0, BASIS / max(1, total))
    chosen = sample.where(F.pmod(F.xxhash64("key", F.lit(1)), F.lit(1 << 20)) < int(share * (1 << 20)))
    told = chosen.orderBy("key", F.xxhash64("text")).select("text").mapInArrow(sparse, "at array<int>, value array<float>").toArrow()
    rows = np.zeros((told.num_rows, WIDTH), np.float32)
    for i, (at, value) in enumerate(zip(told.column("at"), told.column("value"), strict=True)):
        rows[i, at.values.to_numpy()] = value.values.to_numpy()
    model = Model(rarity, latent_space(rows), np.zeros((0, 1), np.float32), np.zeros(0))
    del rows, told

    def placed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            at = [row for block in model.places(batch.column("text").to_pylist()) for row in block]
            yield pa.RecordBatch.from_arrays([batch.column("key").cast(pa.string()), batch.column("y"), pa.array(at, pa.list_(pa.float32()))], ["key", "y", "at"])

    told = sample.mapInArrow(placed, "key string, y double, at array<float>").orderBy("key", "y", "at").toArrow()
    vectors = np.array([v.values.to_numpy() for v in told.column("at")], np.float32).reshape(told.num_rows, model.space.shape[1])
    known_labels = told.column("y").to_numpy().astype(np.float64)
    prior = float(known_labels.mean()) if len(known_labels) else 0.5
    model.vectors, model.labels, model.prior = vectors, known_labels, prior
    model.neighbours = chosen_neighbours(vectors, known_labels, prior)
    return model


def scored(df: DataFrame, model: Model, text: str = "text", name: str = "score") -> DataFrame:
    """All rows and columns with the score of the whole text, from 0 to 1.

    Null and empty texts score the share of good labels. An input column named like the output is replaced.
    """
    shipped(df.sparkSession)

    @F.pandas_udf("double")
    def score(texts):
        return type(texts)(model.scores(texts.tolist()))

    kept = [F.col(f"`{c}`") for c in df.columns if c.lower() != name.lower()]
    return df.select(*kept, score(text_or_empty(text)).alias(name))


def quality(df: DataFrame, labels: DataFrame, text: str = "text", key: str = "doc_id", threshold: float = THRESHOLD) -> DataFrame:
    """All rows with ``held_out``, ``score`` and ``predicted``, by a model fitted to them."""
    rows = scored(df, fit(df, labels, text, key), text)
    kept = [F.col(f"`{c}`") for c in rows.columns if c.lower() not in ("held_out", "predicted")]
    return rows.select(*kept, held_out(key).alias("held_out"), (F.col("score") >= threshold).cast("int").alias("predicted"))
