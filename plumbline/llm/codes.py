"""Vector code compression (operator 13): product codes in whole numbers, by rounds of exact assignment.

Components become whole numbers, vectors are cut into parts, and each part position has a codebook. A
round assigns every part to its nearest entry and moves each entry to the mean of its parts. A row
keeps, for each part, a bound above the distance to its entry and bounds below the distances to groups
of entries, each with the round it was measured in. The codebooks of all rounds are kept, so a bound is
carried to a later round by how far its entries really are from where they were then (the norm of the
sum of their moves, never more than the sum of the norms). Only what the bounds leave open is measured
again, exactly.

A round is one pass over a table of rows and bounds, which writes the next such table in the shared
folder together with each task's sums by entry; the table before it is then dropped. Only the codebooks
reach the driver.
"""

from __future__ import annotations

import uuid
from collections.abc import Iterator, Sequence
from dataclasses import dataclass
from decimal import Decimal
from hashlib import sha256

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from plumbline.llm.common import shared_folder, shipped

SCALE, PARTS, ENTRIES, ROUNDS = 1024, 4, 256, 4
#: Entries that share a bound.
GROUP = 32
#: Distances are sums of whole numbers below this, which doubles hold exactly; beyond it Python's integers count.
EXACT = 2.0**53
#: Components end here, and errors at the largest long.
MOST, MOST_ERROR = 10**30, 2**63 - 1
#: Rows assigned together.
ROWS = 2048
#: Labels up to which their sums are broadcast.
BROADCAST_LABELS = 100_000


def able(vector: str) -> Column:
    """Vectors that take part: not null, and without null, infinite or NaN components."""
    c = F.col(f"`{vector}`")
    odd = lambda x: x.isNull() | F.isnan(x.cast("double")) | (F.abs(x.cast("double")) == float("inf"))
    return c.isNotNull() & F.coalesce(~F.exists(c, odd), F.lit(False))


def whole(vectors: Sequence[Sequence[float]], size: int, scale: int = SCALE) -> np.ndarray:
    """The components as whole numbers, a row for each vector; short vectors end in zeros.

    Doubles where all are small enough for exact distances, else Python's integers.
    """
    out = np.zeros((len(vectors), size))
    for i, v in enumerate(vectors):
        out[i, : len(v)] = v
    with np.errstate(over="ignore"):
        out = np.floor(out * scale)
    if _exact(out):
        return out
    return np.array([[int(max(-MOST, min(MOST, x))) for x in row] for row in out.tolist()], dtype=object).reshape(out.shape)


def _exact(*numbers: np.ndarray) -> bool:
    """Whether squared distances between such rows stay exact as doubles."""
    most = max([float(np.abs(x).max()) for x in numbers if x.size], default=0.0)
    return 4 * most * most * max(1, numbers[0].shape[1]) < EXACT


def squares(x: np.ndarray, entries: np.ndarray) -> np.ndarray:
    """[row, entry]: squared distances, exact."""
    if x.dtype != object and entries.dtype != object and _exact(x, entries):
        return (x * x).sum(axis=1)[:, None] - 2 * (x @ entries.T) + (entries * entries).sum(axis=1)
    a, b = _integers(x), _integers(entries)
    out = np.zeros((len(a), len(b)), dtype=object)
    for i in range(len(a)):
        out[i] = ((b - a[i]) ** 2).sum(axis=1)
    return out


def _integers(x: np.ndarray) -> np.ndarray:
    return x if x.dtype == object else x.astype(np.int64).astype(object)


def square(x: np.ndarray, entries: np.ndarray) -> np.ndarray:
    """The squared distance of each row to an entry of its own, exact."""
    if x.dtype == object or entries.dtype == object or not _exact(x, entries):
        x, entries = _integers(x), _integers(entries)
    return ((x - entries) ** 2).sum(axis=1)


# --- bounds --------------------------------------------------------------------------


@dataclass
class Bounds:
    """Of each row's part: its entry, how far that was at most, and how near the groups' others were at least."""

    code: np.ndarray
    upper: np.ndarray
    stamp: np.ndarray
    lower: np.ndarray
    lower_stamp: np.ndarray

    @staticmethod
    def kind(groups: int) -> np.dtype:
        """How a row's bounds of one part are stored."""
        return np.dtype([("code", "u1"), ("stamp", "u1"), ("upper", "f8"), ("lower_stamp", "u1", (groups,)), ("lower", "f4", (groups,))])

    def stored(self) -> np.ndarray:
        out = np.zeros(len(self.code), self.kind(self.lower.shape[1]))
        for name in out.dtype.names:
            out[name] = getattr(self, name)
        return out

    @classmethod
    def read(cls, stored: np.ndarray) -> Bounds:
        return cls(stored["code"].astype(np.int64), stored["upper"].copy(), stored["stamp"].copy(), stored["lower"].copy(), stored["lower_stamp"].copy())


def _above(distance: np.ndarray) -> np.ndarray:
    return distance * (1 + 1e-12)


def _below(distance: np.ndarray) -> np.ndarray:
    return np.maximum(0, distance * (1 - 1e-6)).astype(np.float32)


def _two_least(far: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Of each row the first least distance, where it is, and the least of the others."""
    at = far.argmin(axis=1)
    rows = np.arange(len(far))
    least = far[rows, at].copy()
    rest = far.copy()
    rest[rows, at] = np.inf
    return least, at, rest.min(axis=1)


def assigned(x: np.ndarray, history: Sequence[np.ndarray], bounds: Bounds | None = None) -> tuple[Bounds, int]:
    """The nearest entry of each row in the last codebook of the history (ties: the first), with new bounds.

    Also returns how many rows were measured against how many groups, added up.
    """
    now, t = history[-1], len(history) - 1
    groups = [slice(a, min(a + GROUP, len(now))) for a in range(0, len(now), GROUP)]
    n, rows = len(x), np.arange(len(x))
    if x.dtype == object or now.dtype == object or not _exact(x, now):
        code = squares(x, now).argmin(axis=1) if n else np.zeros(0, np.int64)
        # nothing is known of the others, so the next round measures again
        return Bounds(code, np.full(n, np.inf), np.full(n, t, np.uint8), np.zeros((n, len(groups)), np.float32), np.full((n, len(groups)), t, np.uint8)), n * len(groups)
    if bounds is None:
        best, code = np.full(n, np.inf), np.zeros(n, np.int64)
        lower, stamps = np.zeros((n, len(groups)), np.float32), np.full((n, len(groups)), t, np.uint8)
        open_ = np.ones((n, len(groups)), bool)
        bounds = Bounds(code, best.copy(), np.full(n, t, np.uint8), lower, stamps)
        unsure, had = rows, None
    else:
        code = bounds.code.copy()
        moved = [np.sqrt(((now - then) ** 2).sum(axis=1).astype(float)) for then in history]
        upper = _above(bounds.upper + np.array(moved)[bounds.stamp, code])
        shift = np.array([[m[g].max() for g in groups] for m in moved])
        lower = bounds.lower - _above(shift[bounds.lower_stamp, np.arange(len(groups))])
        unsure = np.flatnonzero(upper >= lower.min(axis=1))
        if not len(unsure):
            return bounds, 0
        had = code[unsure]
        best = square(x[unsure], now[had])
        open_ = _above(np.sqrt(best))[:, None] >= lower[unsure]
        bounds.upper[unsure], bounds.stamp[unsure] = _above(np.sqrt(best)), t
        code = had.copy()
    first, own = [], best.copy()
    for j, g in enumerate(groups):
        need = np.flatnonzero(open_[:, j])
        if not len(need):
            first.append(None)
            continue
        least, at, second = _two_least(squares(x[unsure[need]], now[g]))
        at = at + g.start
        nearer = (least < best[need]) | ((least == best[need]) & (at < code[need]))
        best[need] = np.where(nearer, least, best[need])
        code[need] = np.where(nearer, at, code[need])
        first.append((need, least, at, second))
    for j, found in enumerate(first):
        if found is not None:
            need, least, at, second = found
            bounds.lower[unsure[need], j] = _below(np.sqrt(np.where(at == code[need], second, least)))
            bounds.lower_stamp[unsure[need], j] = t
    if had is not None:
        # an entry that was left counts among its group's others from now on
        for j, g in enumerate(groups):
            left = np.flatnonzero((code != had) & (had >= g.start) & (had < g.stop) & ~open_[:, j])
            held = np.minimum(np.maximum(0, lower[unsure[left], j]), np.sqrt(own[left]))
            bounds.lower[unsure[left], j] = _below(held)
            bounds.lower_stamp[unsure[left], j] = t
    bounds.code[unsure], bounds.upper[unsure], bounds.stamp[unsure] = code, _above(np.sqrt(best)), t
    return bounds, int(open_.sum())


# --- codebooks -----------------------------------------------------------------------


@dataclass
class Codebooks:
    """The entries of each part position, [part][entry, component], as whole numbers."""

    entries: list[np.ndarray]
    scale: int = SCALE

    def text(self) -> str:
        return ",".join(str(int(x)) for part in self.entries for entry in part for x in entry)

    def sha256(self) -> str:
        return sha256(self.text().encode()).hexdigest()

    def vector(self, code: str) -> list[float]:
        """What a code stands for: the entries' components, in the vectors' own scale."""
        numbers = [int(code[2 * p : 2 * p + 2], 16) for p in range(len(self.entries))]
        return [int(x) / self.scale for part, i in zip(self.entries, numbers, strict=True) for x in part[i]]


def _narrow(entries: list[list[int]], width: int) -> np.ndarray:
    """A codebook as doubles where these are exact."""
    exact = np.array(entries, dtype=object).reshape(len(entries), width)
    small = exact.astype(float)
    return small if _exact(small) else exact


def _moved(codebook: np.ndarray, sums: dict[int, tuple[int, list[int]]]) -> np.ndarray:
    """Each entry at the floor of its parts' mean; an entry without parts stays."""
    rows = [[int(x) for x in entry] for entry in codebook]
    for i, (count, total) in sums.items():
        rows[i] = [x // count for x in total]
    return _narrow(rows, codebook.shape[1])


class _Tables:
    """One pass after another: each writes the rows with their bounds, and the sums of its tasks."""

    def __init__(self, spark: SparkSession) -> None:
        self.spark, self.path = spark, None

    def write(self, df: DataFrame) -> DataFrame:
        before, self.path = self.path, f"{shared_folder(self.spark)}/table-{uuid.uuid4().hex}"
        df.write.parquet(self.path)
        if before is not None:  # nothing reads it any more
            place = self.spark._jvm.org.apache.hadoop.fs.Path(before)
            place.getFileSystem(self.spark._jsc.hadoopConfiguration()).delete(place, True)
        return self.spark.read.schema(df.schema).parquet(self.path)


def _pieces(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
    for start in range(0, batch.num_rows, ROWS):
        yield batch.slice(start, ROWS)


def _stored(column: pa.Array, kind: np.dtype, parts: int) -> list[Bounds]:
    packed = np.frombuffer(b"".join(column.to_pylist()), dtype=kind).reshape(-1, parts)
    return [Bounds.read(packed[:, p]) for p in range(parts)]


def compressed(
    df: DataFrame, key: str = "vec_id", vector: str = "embedding", keep: Sequence[str] | None = None,
    parts: int = PARTS, entries: int = ENTRIES, rounds: int = ROUNDS, scale: int = SCALE,
) -> tuple[DataFrame, Codebooks]:
    """Each able vector with its ``code`` (two hexadecimal digits a part) and ``error``, and the codebooks.

    Codebooks start as the vectors with the smallest keys (nulls last; ties by the vector), fewer where
    there are fewer rows. ``error`` is the squared distance of the whole-number vector to its entries,
    at most the largest long. A vector shorter than the longest, and one whose length the parts don't divide, ends in zeros;
    components beyond 10**30 count as that. Rows that repeat are coded alike; no rows give empty codebooks.
    ``keep`` names the columns to carry along (all but the vector without it); those named like an
    output are replaced.
    """
    if not 0 < entries <= 256:
        raise ValueError("a code has two hexadecimal digits a part, so up to 256 entries")
    shipped(df.sparkSession)
    kept = [c for c in (df.columns if keep is None else keep) if c.lower() not in ("code", "error") and (keep is not None or c != vector)]
    carried = [f"c{i}" for i in range(len(kept))]
    rows = df.where(able(vector)).select(
        F.col(f"`{key}`").alias("k"), F.col(f"`{vector}`").cast("array<double>").alias("v"),
        *[F.col(f"`{c}`").alias(n) for c, n in zip(kept, carried, strict=True)],
    )
    fields = [f for f in rows.schema.fields if f.name in carried]
    longest = rows.agg(F.max(F.size("v"))).first()[0]
    start = [r["v"] for r in rows.orderBy(F.col("k").asc_nulls_last(), "v").select("v").limit(entries).collect()]
    if not start:
        schema = T.StructType([*fields, T.StructField("code", T.StringType()), T.StructField("error", T.LongType())])
        return df.sparkSession.createDataFrame([], schema).toDF(*kept, "code", "error"), Codebooks([np.zeros((0, 0))] * parts, scale)
    width = -(-longest // parts)
    cut = lambda x: [x[:, p * width : (p + 1) * width] for p in range(parts)]
    history = [[_narrow([[int(x) for x in row] for row in part], width)] for part in cut(whole(start, parts * width, scale))]
    kind = Bounds.kind(-(-len(start) // GROUP))
    # vectors stay as wide as they are: every round reads and writes them
    table = rows.select(F.col("v").cast(df.schema[vector].dataType).alias("v"), F.lit(None).cast("binary").alias("bounds"), *carried)
    names = table.columns
    extra = "part int, entry int, n bigint, sums array<decimal(38,0)>"
    schema = T.StructType([*[T.StructField(f.name, f.dataType) for f in table.schema.fields], *T.StructType.fromDDL(extra).fields])

    def round_of(books: list[list[np.ndarray]]):
        def step(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            counts = np.zeros((parts, len(start)), np.int64)
            totals = np.zeros((parts, len(start), width), dtype=object)
            kinds: list[pa.DataType] = []
            for batch in batches:
                kinds = [batch.schema.field(c).type for c in names]
                for piece in _pieces(batch):
                    x = cut(whole(piece.column("v").to_pylist(), parts * width, scale))
                    column = piece.column("bounds")
                    known = [None] * parts if column.null_count else _stored(column, kind, parts)
                    found = [assigned(x[p], books[p], known[p])[0] for p in range(parts)]
                    packed = np.stack([f.stored() for f in found], axis=1)
                    for p in range(parts):
                        _add(counts[p], totals[p], found[p].code, x[p])
                    n = piece.num_rows
                    nothing = [pa.nulls(n, f.type) for f in sums_of]
                    bounds = pa.array([row.tobytes() for row in packed], pa.binary())
                    columns = {c: piece.column(c) for c in names} | {"bounds": bounds}
                    yield pa.RecordBatch.from_arrays([*columns.values(), *nothing], [*names, *sums_of.names])
            used = np.argwhere(counts)
            if len(used):
                made = [
                    pa.array(used[:, 0], pa.int32()), pa.array(used[:, 1], pa.int32()), pa.array(counts[counts > 0]),
                    pa.array([[Decimal(int(x)) for x in totals[p, i]] for p, i in used], sums_of.field("sums").type),
                ]
                empty = [pa.nulls(len(used), k) for k in kinds]
                yield pa.RecordBatch.from_arrays([*empty, *made], [*names, *sums_of.names])

        return step

    sums_of = pa.schema([("part", pa.int32()), ("entry", pa.int32()), ("n", pa.int64()), ("sums", pa.list_(pa.decimal128(38, 0)))])
    tables = _Tables(df.sparkSession)
    for _ in range(rounds):
        table = tables.write(table.select(*names).mapInArrow(round_of(history), schema))
        for p, sums in enumerate(_sums(table, parts)):
            history[p] = [*history[p], _moved(history[p][-1], sums)]
        table = table.where(F.col("part").isNull())

    def coded(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for piece in _pieces(batch):
                x = cut(whole(piece.column("v").to_pylist(), parts * width, scale))
                known = [None] * parts if piece.column("bounds").null_count else _stored(piece.column("bounds"), kind, parts)
                found = [assigned(x[p], history[p], known[p])[0].code for p in range(parts)]
                far = sum(_integers(square(x[p], history[p][-1][found[p]])) for p in range(parts))
                hexed = ["".join(f"{c:02x}" for c in row) for row in np.stack(found, axis=1).tolist()]
                error = [min(int(e), MOST_ERROR) for e in far]
                yield pa.RecordBatch.from_arrays(
                    [*[piece.column(c) for c in carried], pa.array(hexed, pa.string()), pa.array(error, pa.int64())], [*carried, "code", "error"]
                )

    result = T.StructType([*fields, T.StructField("code", T.StringType()), T.StructField("error", T.LongType())])
    codes = table.select(*names).mapInArrow(coded, result)
    return codes.toDF(*kept, "code", "error"), Codebooks([books[-1] for books in history], scale)


def _add(counts: np.ndarray, totals: np.ndarray, code: np.ndarray, x: np.ndarray) -> None:
    """Adds rows to the sums of their entries; sums of a piece are exact as doubles where its distances are."""
    counts += np.bincount(code, minlength=len(counts))
    if x.dtype == object:
        np.add.at(totals, code, x)
        return
    for i in range(x.shape[1]):
        column = np.bincount(code, weights=x[:, i], minlength=len(counts))
        totals[:, i] += column.astype(np.int64).astype(object)


def _sums(table: DataFrame, parts: int) -> list[dict[int, tuple[int, list[int]]]]:
    """Of each part position the used entries with their rows and sums: as many rows as the codebooks have entries."""
    told = table.where(F.col("part").isNotNull()).select("part", "entry", "n", F.posexplode_outer("sums").alias("at", "x"))
    added = told.groupBy("part", "entry", "at").agg(F.sum("n").alias("n"), F.sum("x").alias("x"))
    listed = added.groupBy("part", "entry").agg(F.max("n").alias("n"), F.array_sort(F.collect_list(F.struct("at", "x"))).alias("sums"))
    out: list[dict[int, tuple[int, list[int]]]] = [{} for _ in range(parts)]
    for r in listed.collect():
        out[r["part"]][r["entry"]] = (r["n"], [int(s["x"]) for s in r["sums"] if s["at"] is not None])
    return out


def with_label_errors(codes: DataFrame, label: str) -> DataFrame:
    """The coded rows with ``label_error``: the errors summed over equal labels, nulls being one label."""
    sums = codes.groupBy(F.col(f"`{label}`").alias("_label")).agg(F.sum(F.col("error").cast("decimal(38,0)")).alias("_sum"))
    sums = sums.select("_label", F.least(F.col("_sum"), F.lit(MOST_ERROR).cast("decimal(38,0)")).cast("bigint").alias("label_error"))
    few = sums.count() <= BROADCAST_LABELS
    joined = codes.join(F.broadcast(sums) if few else sums, F.col(f"`{label}`").eqNullSafe(F.col("_label")), "left")
    return joined.drop("_label")
