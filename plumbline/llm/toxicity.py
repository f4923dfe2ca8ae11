"""Toxicity by weak supervision (operator 2).

Lexicon and pattern voters are drawn up from a bounded sample of labelled rows: words, and word
beginnings, that toxic texts have far more often. Every document is put to the voters. A
generative label model is fitted to the counts of all vote patterns: the voters depend on the
label and, along a tree of the strongest correlations, on each other; the model gives each
voter's accuracy, and each pattern the posterior of its label. A linear classifier over the words
and beginnings of a bounded sample of texts is trained on the posteriors, and scores whole texts.
"""

from __future__ import annotations

import hashlib
from collections import Counter
from collections.abc import Callable, Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from plumbline.llm.common import checkpointed, shipped, text_or_empty

#: Labelled rows, and rows with posterior labels, that are learned from at most (about).
LABELLED = 40_000
TRAINED = 40_000
#: Voters on words and on word beginnings; together at most 12, so there are few vote patterns.
WORD_VOTERS = 5
START_VOTERS = 5
#: A feature is so many times likelier in toxic texts at least, and so surely (twice the log of the
#: likelihood ratio). Voters may be less sure: the label model weighs them.
SURE = 20.0
SURE_VOTER = 14.0
ODDS = 8.0
TERMS = 2_000
FEATURES = 6_000
#: Bytes of the word beginnings.
STARTS = (4, 5, 6, 7)
THRESHOLD = 0.3
#: Words whose terms a worker keeps, and features that it counts before it passes them on.
KEPT_WORDS = 150_000
KEPT_FEATURES = 100_000
_LETTERS = bytes(c if c >= 128 or chr(c).isalnum() else 32 for c in range(256))


def words_of(text: str) -> Counter:
    """The words of a whole text and how often it has each, in lower case, cut at ASCII marks and white space."""
    return Counter(text.lower().encode().translate(_LETTERS).split())


def terms_of(word: bytes) -> list[bytes]:
    """A word, and its beginnings marked as such."""
    return [word, *[word[:n] + b"*" for n in STARTS if len(word) > n]]


def levels(often: int, total: int) -> int:
    """How much of a text is one term: there at all (0), or with a share of its words (1 to 3)."""
    if often < 2 or often * 100 < total:
        return 0
    return 1 if often * 50 < total else 2 if often < 3 or often * 25 < total else 3


def features_of(words: Counter) -> list[bytes]:
    """The terms of a text, each with its level and all below."""
    often: Counter = Counter()
    for word, n in words.items():
        for term in terms_of(word):
            often[term] += n
    total = words.total()
    return [term + b"\0%d" % k for term, n in often.items() for k in range(levels(n, total) + 1)]


def held_out(key: str) -> Column:
    """Rows whose labels are never learned from."""
    return F.coalesce(F.crc32(F.col(f"`{key}`").cast("string")) % 4 == 2, F.lit(False))


class Lookup:
    """The numbers of a text's known features; the known terms are kept per word."""

    def __init__(self, numbers: dict[bytes, int]) -> None:
        self.kept: dict[bytes, tuple] = {}
        self.levels: dict[bytes, list] = {}
        for feature, number in numbers.items():
            term, level = feature.rsplit(b"\0", 1)
            self.levels.setdefault(term, [None] * 4)[int(level)] = number

    def __call__(self, words: Counter) -> set[int]:
        often: dict[bytes, int] = {}
        kept, known = self.kept, self.levels
        for word, n in words.items():
            terms = kept.get(word)
            if terms is None:
                if len(kept) > KEPT_WORDS:
                    kept.clear()
                terms = kept[word] = tuple(t for t in terms_of(word) if t in known)
            for term in terms:
                often[term] = often.get(term, 0) + n
        if not often:
            return set()
        total = words.total()
        return {x for t, n in often.items() for x in known[t][: levels(n, total) + 1] if x is not None}


@dataclass
class LabelModel:
    """Voters given the label, each also given its parent in a tree of voters."""

    parents: list[int] = field(default_factory=list)
    #: [label, voter, parent's vote]: how likely the voter votes.
    votes: np.ndarray = field(default_factory=lambda: np.zeros((2, 0, 2)))
    prior: float = 0.5

    def joint(self, patterns: np.ndarray) -> np.ndarray:
        """[pattern, label]: the likelihood of both."""
        out = np.repeat(np.log([[1 - self.prior, self.prior]]), len(patterns), axis=0)
        for j, parent in enumerate(self.parents):
            given = patterns[:, parent] if parent >= 0 else np.zeros(len(patterns), int)
            for y in (0, 1):
                p = self.votes[y, j, given]
                out[:, y] += np.where(patterns[:, j] > 0, np.log(p), np.log1p(-p))
        return np.exp(out)

    def posterior(self, patterns: np.ndarray) -> np.ndarray:
        both = self.joint(patterns)
        return both[:, 1] / both.sum(axis=1)

    def accuracies(self, patterns: np.ndarray, counts: np.ndarray) -> np.ndarray:
        """Of each voter the share of its votes that are right, under the model."""
        p = self.posterior(patterns) * counts
        return (patterns * p[:, None]).sum(axis=0) / np.maximum(1e-9, (patterns * counts[:, None]).sum(axis=0))


def _tree(patterns: np.ndarray, weights: np.ndarray) -> list[int]:
    """Parents in the tree that joins voters by their correlation given the label, strongest first."""
    m = patterns.shape[1]
    gain = np.zeros((m, m))
    for y in (0, 1):
        w = weights[:, y]
        total = w.sum() + 4e-3
        for a in range(m):
            for b in range(a):
                for va in (0, 1):
                    for vb in (0, 1):
                        both = (w[(patterns[:, a] == va) & (patterns[:, b] == vb)].sum() + 1e-3) / total
                        pa_ = (w[patterns[:, a] == va].sum() + 2e-3) / total
                        pb_ = (w[patterns[:, b] == vb].sum() + 2e-3) / total
                        gain[a, b] += total * both * np.log(both / (pa_ * pb_))
    gain += gain.T
    parents, joined = [-1] * m, [0]
    best = {b: 0 for b in range(1, m)}
    while best:
        b = max(best, key=lambda x: gain[x, best[x]])
        parents[b] = best.pop(b)
        joined.append(b)
        for x in best:
            if gain[x, b] > gain[x, best[x]]:
                best[x] = b
    return parents


def fitted(patterns: np.ndarray, counts: np.ndarray, labelled: np.ndarray, steps: int = 40) -> LabelModel:
    """The label model by expectation-maximisation; ``labelled`` [pattern, label] counts keep their labels.

    Labelled rows get as much weight together as all other rows, so they tell the classes apart.
    """
    m = patterns.shape[1]
    free = np.maximum(0, counts - labelled.sum(axis=1)).astype(float)
    known = labelled * max(1.0, free.sum() / max(1.0, labelled.sum()))
    model, weights = LabelModel(), known + 0.0
    for step in range(steps):
        if step:
            both = model.joint(patterns)
            weights = known + free[:, None] * both / both.sum(axis=1, keepdims=True)
        parents = _tree(patterns, weights) if step in (0, 1, 5) else model.parents
        votes = np.zeros((2, m, 2))
        for y in (0, 1):
            for j, parent in enumerate(parents):
                for v in (0, 1):
                    w = weights[:, y] * (patterns[:, parent] == v if parent >= 0 else 1.0)
                    own = (weights[:, y] * patterns[:, j]).sum() + 0.5
                    mean = own / (weights[:, y].sum() + 1.0)
                    votes[y, j, v] = ((w * patterns[:, j]).sum() + 2 * mean) / (w.sum() + 2)
        model = LabelModel(parents, np.clip(votes, 1e-6, 1 - 1e-6), float(np.clip(weights[:, 1].sum() / max(1e-9, weights.sum()), 1e-4, 1 - 1e-4)))
    return model


def logistic(rows: list[list[int]], targets: np.ndarray, n: int, penalty: float = 1.0, steps: int = 300) -> tuple[np.ndarray, float]:
    """Weights and bias of a logistic regression on soft labels over sets of features, by Nesterov's method."""
    flat = np.concatenate([np.array(r, np.int64) for r in rows]) if rows else np.zeros(0, np.int64)
    sizes = np.array([len(r) for r in rows], np.int64)
    owner = np.repeat(np.arange(len(rows)), sizes)
    mean = float(np.clip(targets.mean() if len(targets) else 0.5, 1e-4, 1 - 1e-4))
    w, bias = np.zeros(n), np.log(mean / (1 - mean))
    ahead, ahead_bias = w.copy(), bias
    # rows and columns of the features bound the curvature
    often = np.bincount(flat, minlength=n).astype(float)
    curve = 0.25 * np.maximum(1.0, np.bincount(flat, weights=(sizes[owner] + 1.0), minlength=n)) + penalty
    curve_bias = 0.25 * max(1.0, float((sizes + 1).sum()))
    for step in range(steps):
        score = np.bincount(owner, weights=ahead[flat], minlength=len(rows)) + ahead_bias
        off = 1 / (1 + np.exp(-np.clip(score, -40, 40))) - targets
        new = ahead - (np.bincount(flat, weights=off[owner], minlength=n) + penalty * ahead) / curve
        new_bias = ahead_bias - off.sum() / curve_bias
        pull = step / (step + 3)
        ahead, ahead_bias = new + pull * (new - w), new_bias + pull * (new_bias - bias)
        w, bias = new, new_bias
    return np.where(often > 0, w, 0.0), float(bias)


class Judge:
    """The posterior of a text's votes."""

    def __init__(self, voters: dict[bytes, int], posterior: dict[int, float]) -> None:
        self.voters, self.posterior, self.lookup = voters, posterior, Lookup(voters)

    def fresh(self) -> Judge:
        return Judge(self.voters, self.posterior)

    def __call__(self, words: Counter) -> float:
        return self.posterior[sum(1 << v for v in self.lookup(words))]


@dataclass
class Model:
    """The classifier, and the voters and label model that it was trained by."""

    weights: dict[bytes, float]
    bias: float
    voters: dict[bytes, int]
    labels: LabelModel
    accuracies: list[float]


def _text_counts(texts: DataFrame, judge: Callable[[Counter], float] | None = None) -> DataFrame:
    """(feature, toxic, often) from (text, p): sums over distinct features of texts, added up per task first.

    ``judge`` gives the p of a text's words where there is no such column.
    """

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def out(often: Counter, toxic: Counter) -> pa.RecordBatch:
            keys = list(often)
            return pa.RecordBatch.from_arrays(
                [pa.array(keys, pa.binary()), pa.array([float(toxic[k]) for k in keys], pa.float64()), pa.array([often[k] for k in keys], pa.int64())],
                ["feature", "toxic", "often"],
            )

        often, toxic = Counter(), Counter()
        for batch in batches:
            given = batch.column("p").to_pylist() if judge is None else [None] * batch.num_rows
            for text, p in zip(batch.column("text"), given, strict=True):
                words = words_of(text.as_py())
                p = judge(words) if judge else p
                found = features_of(words)
                often.update(found)
                if p > 1e-3:
                    for f in found:
                        toxic[f] += p
                if len(often) > KEPT_FEATURES:
                    yield out(often, toxic)
                    often, toxic = Counter(), Counter()
        yield out(often, toxic)

    sums = texts.mapInArrow(count, "feature binary, toxic double, often long")
    return sums.groupBy("feature").agg(F.sum("toxic").alias("toxic"), F.sum("often").alias("often"))


def _telling(counts: DataFrame, toxic: float, clean: float, most: int, odds: float, sure: float) -> list[tuple[bytes, float]]:
    """The features that tell toxic texts, by how surely they do: at most ``most``.

    How surely: the likelihood ratio of the feature's own share of toxic texts against theirs among all.
    """
    n, other = F.col("often"), F.greatest(F.lit(0.0), F.col("often") - F.col("toxic"))
    share = toxic / (toxic + clean)
    part = lambda k, p: F.when(k > 0, k * F.log(k / n / p)).otherwise(0.0)
    ratio = F.log((F.col("toxic") + 0.5) / (toxic + 1.0)) - F.log((other + 0.5) / (clean + 1.0))
    rows = counts.withColumn("sure", 2 * (part(F.col("toxic"), share) + part(other, 1 - share))).withColumn("ratio", ratio)
    rows = rows.where((F.col("ratio") >= float(np.log(odds))) & (F.col("sure") >= sure))
    rows = rows.orderBy(F.col("sure").desc(), "feature").limit(most)
    return [(bytes(r["feature"]), r["ratio"]) for r in rows.select("feature", "ratio").collect()]


def fit(df: DataFrame, labels: DataFrame, text: str = "text", key: str = "doc_id", label: str = "toxic") -> Model:
    """A model from the labels of rows that are not held out, and from the texts of all rows.

    Labels are taken from a sample of about LABELLED rows, chosen by a hash of the key, and one label
    per key (the larger one). Without labels of both kinds there are no voters, and every text scores
    the share of toxic labels (0.5 without any).
    """
    shipped(df.sparkSession)
    texts = df.select(F.col(f"`{key}`").alias("key"), text_or_empty(text).alias("text"))
    known = labels.where(F.col(f"`{label}`").isNotNull() & F.col(f"`{key}`").isNotNull()).groupBy(F.col(f"`{key}`").alias("key")).agg((F.max(f"`{label}`") > 0).cast("double").alias("p"))
    known = known.where(~held_out("key"))
    share = min(1.0, LABELLED / max(1, known.count()))
    known = known.where(F.pmod(F.xxhash64("key"), F.lit(1 << 20)) < int(share * (1 << 20)))
    # at most about LABELLED rows of two numbers
    sample = texts.join(F.broadcast(known), "key").groupBy(F.xxhash64("text"), "text").agg(F.max("p").alias("p")).select("text", "p")
    sample = checkpointed(sample)
    row = sample.agg(F.sum("p"), F.count(F.lit(1))).first()
    toxic, clean = float(row[0] or 0), float(row[1] - (row[0] or 0))
    terms = _telling(_text_counts(sample), toxic, clean, TERMS, ODDS, SURE_VOTER) if toxic and clean else []
    if not terms:
        mean = toxic / (toxic + clean) if toxic + clean else 0.5
        mean = min(max(mean, 1e-3), 1 - 1e-3)
        return Model({}, float(np.log(mean / (1 - mean))), {}, LabelModel(), [])

    voters, seen = {}, {"w": 0, "s": 0}
    for term, _ in terms:  # dealt in turn, the surest first
        kind = "s" if b"*" in term else "w"
        voters[term] = WORD_VOTERS + seen[kind] % START_VOTERS if kind == "s" else seen[kind] % WORD_VOTERS
        seen[kind] += 1
    m = WORD_VOTERS + START_VOTERS

    def votes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        lookup, counts = Lookup(voters), Counter()
        for batch in batches:
            given = batch.column("p").to_pylist() if "p" in batch.schema.names else [None] * batch.num_rows
            for text_, p in zip(batch.column("text"), given, strict=True):
                counts[sum(1 << v for v in lookup(words_of(text_.as_py()))), p] += 1
        keys = list(counts)
        yield pa.RecordBatch.from_arrays(
            [pa.array([k[0] for k in keys], pa.int32()), pa.array([k[1] for k in keys], pa.float64()), pa.array([counts[k] for k in keys], pa.int64())],
            ["pattern", "p", "n"],
        )

    def tallied(rows: DataFrame) -> list:
        """At most 2 ** voters patterns, with and without label."""
        return rows.mapInArrow(votes, "pattern int, p double, n long").groupBy("pattern", "p").agg(F.sum("n").alias("n")).collect()

    everything = Counter({r["pattern"]: r["n"] for r in tallied(texts.select("text"))})
    labelled = Counter({(r["pattern"], int(r["p"])): r["n"] for r in tallied(sample)})
    numbers = sorted({*everything, *[k[0] for k in labelled]})
    patterns = np.array([[n >> j & 1 for j in range(m)] for n in numbers])
    counts = np.array([everything[n] for n in numbers])
    model = fitted(patterns, counts, np.array([[labelled[n, 0], labelled[n, 1]] for n in numbers]))
    posterior = dict(zip(numbers, model.posterior(patterns).tolist(), strict=True))

    judge = Judge(voters, posterior)
    share = min(1.0, TRAINED / max(1, sum(everything.values())))
    chosen = texts.where(~held_out("key") & (F.pmod(F.xxhash64("text"), F.lit(1 << 20)) < int(share * (1 << 20))))
    chosen = checkpointed(chosen.select("text").distinct())

    def summed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own, toxic, n = judge.fresh(), 0.0, 0
        for batch in batches:
            toxic += sum(own(words_of(t.as_py())) for t in batch.column("text"))
            n += batch.num_rows
        yield pa.RecordBatch.from_arrays([pa.array([toxic]), pa.array([n], pa.int64())], ["p", "n"])

    row = chosen.mapInArrow(summed, "p double, n long").agg(F.round(F.sum("p"), 6), F.sum("n")).first()
    toxic, clean = float(row[0] or 0), float((row[1] or 0) - (row[0] or 0))
    found = _telling(_text_counts(chosen, judge), toxic, clean, FEATURES, ODDS / 2, SURE)
    numbers_of = {f: i for i, (f, _) in enumerate(found)}
    for term in voters:
        numbers_of.setdefault(term, len(numbers_of))

    def encoded(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        lookup, own = Lookup(numbers_of), judge.fresh()
        for batch in batches:
            words = [words_of(t.as_py()) for t in batch.column("text")]
            ids, p = [sorted(lookup(w)) for w in words], [own(w) for w in words]
            yield pa.RecordBatch.from_arrays([pa.array(ids, pa.list_(pa.int32())), pa.array(p, pa.float64())], ["ids", "p"])

    # about TRAINED rows, in an order that no partitioning changes
    rows = chosen.mapInArrow(encoded, "ids array<int>, p double").orderBy("p", "ids").collect()
    weights, bias = logistic([r["ids"] for r in rows], np.array([r["p"] for r in rows]), len(numbers_of))
    kept = {f: float(weights[i]) for f, i in numbers_of.items() if weights[i]}
    return Model(kept, bias, voters, model, model.accuracies(patterns, counts).tolist())


def scored(df: DataFrame, model: Model, text: str = "text", name: str = "score") -> DataFrame:
    """All rows and columns with the score of the whole text, from 0 to 1; null and empty texts score the bias.

    Equal texts score alike, whatever the other columns hold; an input column named like the
    output is replaced.
    """
    numbers = {f: i for i, f in enumerate(model.weights)}
    weights, bias = np.array([*model.weights.values(), 0.0]), model.bias
    mark = hashlib.sha256(repr(list(numbers)).encode()).digest()
    shipped(df.sparkSession)

    @F.pandas_udf("double")
    def score(texts):
        lookup = _lookup(mark, numbers)
        sums = np.array([weights[list(lookup(words_of(t)))].sum() if t else 0.0 for t in texts]) + bias
        return type(texts)(1 / (1 + np.exp(-np.clip(sums, -40, 40))))

    kept = [F.col(f"`{c}`") for c in df.columns if c.lower() != name.lower()]
    return df.select(*kept, score(text_or_empty(text)).alias(name))


_LOOKUPS: dict[bytes, Lookup] = {}


def _lookup(mark: bytes, numbers: dict[bytes, int]) -> Lookup:
    """The lookup of this process for one model's features, which ``mark`` stands for."""
    if mark not in _LOOKUPS:
        _LOOKUPS.clear()
        _LOOKUPS[mark] = Lookup(numbers)
    return _LOOKUPS[mark]


def toxicity(df: DataFrame, labels: DataFrame, text: str = "text", key: str = "doc_id", threshold: float = THRESHOLD) -> DataFrame:
    """All rows with ``held_out``, ``score`` and ``predicted``, by a model fitted to them."""
    rows = scored(df, fit(df, labels, text, key), text)
    kept = [F.col(f"`{c}`") for c in rows.columns if c.lower() not in ("held_out", "predicted")]
    return rows.select(*kept, held_out(key).alias("held_out"), (F.col("score") >= threshold).cast("int").alias("predicted"))
