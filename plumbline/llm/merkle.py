"""Merkle manifest of a data set (operator 12).

Rows are leaves, in order within their group; sixteen consecutive nodes at a time become a parent, until
one node of the group is left, and the groups' nodes become the root in the same way. Two levels are
built at a time, from blocks of 256 consecutive nodes: a block is one row of a table, so no task holds
more of a group than that, however large the group. The way down hands every block the siblings of its
ancestors, a few kilobytes for 256 leaves.

A parent keeps a copy of its hash state before each child's slot. Folding a changed leaf resumes the
state before its slot with the new digest and the siblings to its right, and so on up to the root;
what stands to the left of a slot is hashed once for all leaves of a block.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence
from hashlib import sha256

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from plumbline.llm.common import checkpointed, in_ranges, shipped, written

#: Children of a parent, and nodes of a block: two levels of them.
FAN, DEPTH = 16, 2
BLOCK = FAN**DEPTH
#: Blocks whose rows are returned together.
TOGETHER = 16
DIGEST = 64

#: Siblings of one level, to the left and to the right, each digests in hexadecimal put together.
LEVEL = "struct<left:string,right:string>"


def field(column: str) -> Column:
    """A value as it goes into a leaf: its length in bytes, a colon and its text, or a dash for null."""
    text = F.col(f"`{column}`").cast("string")
    return sized(text)


def sized(text: Column) -> Column:
    return F.when(text.isNull(), "-").otherwise(F.concat(F.octet_length(text).cast("string"), F.lit(":"), text))


class Parent:
    """A node over a few children, with a copy of its hash state before each child's slot."""

    def __init__(self, children: Sequence[str]) -> None:
        self.text = "".join(children)
        self.before = []
        state = sha256()
        for child in children:
            self.before.append(state.copy())
            state.update(child.encode())
        self.digest = state.hexdigest()

    def left(self, slot: int) -> str:
        return self.text[: slot * DIGEST]

    def right(self, slot: int) -> str:
        return self.text[(slot + 1) * DIGEST :]

    def folded(self, slot: int, child: str) -> str:
        """The digest with another child in this slot."""
        return resumed(self.before[slot], child, self.right(slot))


def resumed(before, child: str, right: str) -> str:
    """The digest of a parent from its state before a slot, the slot's child and what is right of it."""
    state = before.copy()
    state.update((child + right).encode())
    return state.hexdigest()


def levels_of(nodes: Sequence[str], alone: bool) -> list[list[Parent]]:
    """The parents over the nodes of a block, level by level.

    A block that is the whole of its group (``alone``) stops when one node is left, which may be at once.
    """
    levels: list[list[Parent]] = []
    while len(levels) < DEPTH and not (alone and len(nodes) == 1):
        levels.append([Parent(nodes[i : i + FAN]) for i in range(0, len(nodes), FAN)])
        nodes = [parent.digest for parent in levels[-1]]
    return levels


def path_in(levels: list[list[Parent]], slot: int) -> list[tuple[Parent, int]]:
    """The parents of a slot within its block, each with the slot of its child."""
    out = []
    for level in levels:
        out.append((level[slot // FAN], slot % FAN))
        slot //= FAN
    return out


def verified(leaf: str, path: Sequence[tuple[str, str]], root: str) -> bool:
    """Whether a leaf leads to the root, given its siblings to the left and right at each level."""
    for left, right in path:
        leaf = sha256((left + leaf + right).encode()).hexdigest()
    return leaf == root


# --- blocks --------------------------------------------------------------------------


def _numbered(rows: DataFrame, order: Sequence[Column]) -> DataFrame:
    """The rows with their place in their group (column g), from 0, in this order within it.

    Only the first and the last group of each partition reach the driver, with their numbers of rows.
    """
    dealt = in_ranges(rows, [F.col("g").asc(), *order])
    sizes = dealt.groupBy("_part", "g").agg(F.count(F.lit(1)).alias("n"))
    ends = sizes.groupBy("_part").agg(F.min(F.struct("g", "n")).alias("first"), F.max(F.struct("g", "n")).alias("last"))
    before, group, running = {}, None, 0
    for row in sorted(ends.collect(), key=lambda r: r["_part"]):
        before[row["_part"]] = running if row["first"]["g"] == group else 0
        running = row["last"]["n"] + (before[row["_part"]] if row["last"]["g"] == row["first"]["g"] else 0)
        group = row["last"]["g"]

    def placed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        group, place = None, 0
        for batch in batches:
            if not batch.num_rows:
                continue
            groups = batch.column("g").to_pylist()
            if group is None:
                group, place = groups[0], before[batch.column("_part")[0].as_py()]
            places = np.zeros(batch.num_rows, np.int64)
            for i, g in enumerate(groups):
                if g != group:
                    group, place = g, 0
                places[i] = place
                place += 1
            names = [n for n in batch.schema.names if n != "_part"]
            yield pa.RecordBatch.from_arrays([*[batch.column(n) for n in names], pa.array(places)], [*names, "place"])

    kept = [f for f in dealt.schema.fields if f.name != "_part"]
    return dealt.mapInArrow(placed, T.StructType([*kept, T.StructField("place", T.LongType())]))


def _blocks(nodes: DataFrame, columns: Sequence[str]) -> DataFrame:
    """(g, block, nodes): the nodes of 256 consecutive places of a group as one row."""
    slot = (F.col("place") % BLOCK).cast("int").alias("slot")
    block = F.floor(F.col("place") / BLOCK).alias("block")
    rows = nodes.groupBy("g", block).agg(F.collect_list(F.struct(slot, *columns)).alias("nodes"))
    return written(rows)


class _Rows:
    """The nodes of all blocks of a batch, each block's nodes by their slots."""

    def __init__(self, batch: pa.RecordBatch) -> None:
        column = batch.column("nodes")
        self.nodes, self.block = column.values, batch.column("block").to_pylist()
        self.bounds = column.offsets.to_numpy()
        slots = self.nodes.field("slot").to_numpy(zero_copy_only=False)
        self.order = [a + np.argsort(slots[a:z], kind="stable") for a, z in zip(self.bounds[:-1], self.bounds[1:], strict=True)]

    def digests(self, name: str, i: int) -> list[str]:
        column = self.nodes.field(name).take(pa.array(self.order[i]))
        return [x.hex() for x in column.to_pylist()]

    def alone(self, i: int) -> bool:
        """The first block of a group is all of it when it isn't full; a full one has both levels either way."""
        return self.block[i] == 0 and len(self.order[i]) < BLOCK


def _tops(blocks: DataFrame) -> DataFrame:
    """(g, place, digest): what each block becomes, at the block's place."""

    def collapsed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows, out = _Rows(batch), []
            for i in range(batch.num_rows):
                nodes = rows.digests("digest", i)
                levels = levels_of(nodes, rows.alone(i))
                out.append(bytes.fromhex(levels[-1][0].digest if levels else nodes[0]))
            yield pa.RecordBatch.from_arrays([batch.column("g"), batch.column("block"), pa.array(out, pa.binary())], ["g", "place", "digest"])

    return blocks.mapInArrow(collapsed, "g string, place bigint, digest binary")


def _up(nodes: DataFrame, columns: Sequence[str] = ("digest",)) -> tuple[list[DataFrame], DataFrame]:
    """The tables of blocks, the lowest first, and (g, digest): the one node that is left of each group."""
    tables = [_blocks(nodes, columns)]
    while (tables[-1].agg(F.max("block")).first()[0] or 0) > 0:
        tables.append(_blocks(_tops(tables[-1]), ["digest"]))
    return tables, _tops(tables[-1]).select("g", "digest")


def _down(blocks: DataFrame, above: DataFrame) -> DataFrame:
    """(g, block, path, top, root): for each node of the blocks what the block below it needs.

    ``above`` has (g, block, path, top, root) of these blocks; path holds the siblings of all ancestors,
    the nearest first.
    """

    def handed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows, paths = _Rows(batch), batch.column("path").to_pylist()
            out: dict[str, list] = {n: [] for n in ("g", "block", "path", "top", "root")}
            for i, (g, top, root) in enumerate(zip(*[batch.column(n).to_pylist() for n in ("g", "top", "root")], strict=True)):
                nodes = rows.digests("digest", i)
                levels = levels_of(nodes, rows.alone(i))
                for slot in range(len(nodes)):
                    own = [{"left": p.left(s), "right": p.right(s)} for p, s in path_in(levels, slot)]
                    for name, value in zip(out, (g, rows.block[i] * BLOCK + slot, own + paths[i], top, root), strict=True):
                        out[name].append(value)
            level = pa.struct([("left", pa.string()), ("right", pa.string())])
            kinds = (pa.string(), pa.int64(), pa.list_(level), pa.string(), pa.string())
            yield pa.RecordBatch.from_arrays([pa.array(v, k) for v, k in zip(out.values(), kinds, strict=True)], list(out))

    joined = blocks.join(above, ["g", "block"])
    return joined.mapInArrow(handed, f"g string, block bigint, path array<{LEVEL}>, top string, root string")


def manifest(
    df: DataFrame, leaf: Column, order: str, group: str, seen: Column | None = None, keep: Sequence[str] | None = None,
    path: bool = False,
) -> DataFrame:
    """Each row with its ``leaf``, its group's ``subroot``, the ``root``, and a check of what is ``seen``.

    ``leaf`` is the SHA-256 of a row in hexadecimal, ``seen`` the one that the row has at the time of the
    check (null: the same). ``proof_sha256`` is the hash of the leaf's siblings, level by level up to the
    root, ``folded_root`` the root that the seen leaf gives with the recorded siblings, and ``verified``
    whether it is the root. With ``path`` the siblings themselves are returned, as ``verified`` takes them.

    Groups come by their text, bytewise, null first; leaves by ``order`` (null first), ties by the leaf,
    so repeated rows are leaves of their own, next to each other. No rows give no rows. ``keep`` names
    the columns to carry along (all without it); those named like an output are replaced.
    """
    shipped(df.sparkSession)
    outputs = ("leaf", "subroot", "root", "proof_sha256", "folded_root", "verified", "path")
    kept = [c for c in (df.columns if keep is None else keep) if c.lower() not in outputs]
    name = F.col(f"`{group}`").cast("string")
    digest = F.unhex(leaf)
    rows = df.select(
        F.coalesce(F.concat(F.lit("="), name), F.lit("")).alias("g"),
        F.col(f"`{order}`").alias("o"),
        digest.alias("digest"),
        (digest if seen is None else F.coalesce(F.unhex(seen), digest)).alias("seen"),
        *[F.col(f"`{c}`").alias(f"c{i}") for i, c in enumerate(kept)],
        F.rand(5).alias("tie"),  # rows alike in all of this are dealt to ranges anyhow
    )
    carried = [f"c{i}" for i in range(len(kept))]
    ordered = _numbered(rows, [F.col("o").asc_nulls_first(), F.col("digest").asc(), F.col("seen").asc(), F.col("tie").asc()])
    tables, subroots = _up(ordered, ["digest", "seen", *carried])
    subroots = checkpointed(subroots)
    # the groups' nodes are the leaves of one more tree
    dealt = _numbered(subroots.select(F.lit("").alias("g"), F.col("g").alias("o"), "digest"), [F.col("o").asc()])
    over, root = _up(dealt, ["digest", "o"])
    top = root.select(F.hex("digest")).first()
    if top is None:
        return _listed(ordered.limit(0).select(F.lit(0).alias("x")), df, kept, path)
    at = F.array().cast(f"array<{LEVEL}>")
    hexed = F.lit(top[0].lower())
    above = over[-1].select("g", "block", at.alias("path"), F.lit("").alias("top"), hexed.alias("root"))
    for blocks in reversed(over):
        above = _down(blocks, above)
    names = over[0].select("g", "block", F.inline("nodes")).select(
        (F.col("block") * BLOCK + F.col("slot")).alias("block"), F.col("o").alias("name"), F.lower(F.hex("digest")).alias("subroot")
    )
    above = above.drop("g", "top").join(names, "block").select(
        F.col("name").alias("g"), F.lit(0).cast("bigint").alias("block"), "path", F.col("subroot").alias("top"), "root"
    )
    for blocks in reversed(tables[1:]):
        above = _down(blocks, above)
    return _listed(tables[0].join(above, ["g", "block"]), df, kept, path)


def _listed(blocks: DataFrame, df: DataFrame, kept: Sequence[str], path: bool) -> DataFrame:
    """The leaves of blocks that know the siblings of their ancestors."""
    fields = [T.StructField(f"c{i}", df.schema[c].dataType) for i, c in enumerate(kept)]
    texts = ("leaf", "subroot", "root", "proof_sha256", "folded_root")
    schema = T.StructType([*fields, *[T.StructField(n, T.StringType()) for n in texts], T.StructField("verified", T.BooleanType())])
    if path:
        schema.add("path", T.ArrayType(T.StructType([T.StructField("left", T.StringType()), T.StructField("right", T.StringType())])))

    def leaves(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for start in range(0, batch.num_rows, TOGETHER):
                yield told(batch.slice(start, TOGETHER))

    def told(batch: pa.RecordBatch) -> pa.RecordBatch:
        rows, paths = _Rows(batch), batch.column("path").to_pylist()
        tops, roots = batch.column("top").to_pylist(), batch.column("root").to_pylist()
        out: dict[str, list] = {n: [] for n in (*texts, "verified", *["path"] * path)}
        for i in range(batch.num_rows):
            nodes, seen = rows.digests("digest", i), rows.digests("seen", i)
            levels = levels_of(nodes, rows.alone(i))
            upper = [(sha256(x["left"].encode()), x["right"]) for x in paths[i]]
            shared = "".join(x["left"] + x["right"] for x in paths[i])
            for slot, (leaf, now) in enumerate(zip(nodes, seen, strict=True)):
                own = path_in(levels, slot)
                proof = "".join(p.left(s) + p.right(s) for p, s in own) + shared
                for parent, at in own:
                    now = parent.folded(at, now)
                for before, right in upper:
                    now = resumed(before, now, right)
                values = (leaf, tops[i], roots[i], sha256(proof.encode()).hexdigest(), now, now == roots[i])
                for name, value in zip(out, values, strict=False):
                    out[name].append(value)
                if path:
                    out["path"].append([{"left": p.left(s), "right": p.right(s)} for p, s in own] + paths[i])
        order = pa.array(np.concatenate(rows.order) if rows.order else np.zeros(0, np.int64))
        carried = [rows.nodes.field(f.name).take(order) for f in fields]
        level = pa.struct([("left", pa.string()), ("right", pa.string())])
        kinds = [pa.string()] * len(texts) + [pa.bool_()] + [pa.list_(level)] * path
        made = [pa.array(v, k) for v, k in zip(out.values(), kinds, strict=True)]
        return pa.RecordBatch.from_arrays([*carried, *made], schema.names)

    if "nodes" not in blocks.columns:  # an empty table
        return df.sparkSession.createDataFrame([], schema).toDF(*kept, *schema.names[len(kept) :])
    return blocks.mapInArrow(leaves, schema).toDF(*kept, *schema.names[len(kept) :])
