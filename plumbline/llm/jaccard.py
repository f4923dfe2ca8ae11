"""Near copies by a grouped prefix join on word shingles (operator 3).

Shingles are ordered rare first, by how often they occur in the corpus. Documents of one size whose
prefixes hold the same shared shingles are a group; postings, size and position filters work on
groups, and only what passes is expanded to members and verified on the whole sets.

Links are found in three steps, none of which writes out all pairs of a list: every posting list
is tried against its smallest group, then against a few groups chosen by hash, and at last only
the pairs of a list that lie in different components so far are tried, in blocks. A block finds the
rows that may link, is sent their whole sets, and tells the links that join what is still apart:
fewer than it has rows. Members of a group whose prefix no other group shares are a list of their
own there.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from plumbline.llm import blocks as B
from plumbline.llm import words as W
from plumbline.llm.common import checkpointed, written
from plumbline.llm.graph import components

#: Width of a shingle in words, and the least share of shingles in common, in hundredths.
WIDTH = 3
PERCENT = 90
#: Groups by hash that each list is tried against in the second step.
TRIED = 3
#: Rows and shingles on either side of a block in the last step (about), and the fewest bits that a set is folded into.
BLOCK_ROWS = 1024
BLOCK_TOKENS = 1 << 21
FOLDED_BITS = 1024

NODES = (
    "row long, key long, n_shingles long, set_a long, set_b long, unshared int, "
    "prefix array<long>, tokens array<long>, folded binary"
)


def least_common(n: int, percent: int) -> int:
    """Shingles that a set of ``n`` has in common with any set it links with."""
    return -(-n * percent // 100)


def folded(tokens: np.ndarray) -> bytes:
    """The parities of a set's tokens in as many classes as it has tokens, up to a power of two.

    Both halves of the parities, one over the other, are those in half as many classes.
    """
    width = max(FOLDED_BITS, 1 << (len(tokens) - 1).bit_length())
    classes = (tokens.view(W.U) >> W.U(32)).astype(np.int64) & (width - 1)
    return np.packbits((np.bincount(classes, minlength=width) & 1).astype(np.uint8)).tobytes()


class Folds:
    """The parities of a block's sets, of rows of one width as a matrix."""

    def __init__(self, each: list[bytes]) -> None:
        self.widths = np.array([len(x) for x in each])
        self.place, self.at = np.zeros(len(each), np.int64), {}
        for w in np.unique(self.widths).tolist():
            own = np.flatnonzero(self.widths == w)
            self.place[own] = np.arange(len(own))
            self.at[w, w] = np.frombuffer(b"".join(each[i] for i in own), np.uint64).reshape(len(own), -1)

    def folded_to(self, wide: int, narrow: int) -> np.ndarray:
        if (wide, narrow) not in self.at:
            found = self.folded_to(wide, 2 * narrow)
            half = found.shape[1] // 2
            self.at[wide, narrow] = found[:, :half] ^ found[:, half:]
        return self.at[wide, narrow]

    def differ(self, i: int, other: np.ndarray) -> np.ndarray:
        """In how many classes, of the fewer ones of both, set ``i`` and each other one differ in parity."""
        out, own = np.zeros(len(other), np.int64), int(self.widths[i])
        for w in np.unique(self.widths[other]).tolist():
            at, m = np.flatnonzero(self.widths[other] == w), min(own, w)
            bits = self.folded_to(w, m)[self.place[other[at]]] ^ self.folded_to(own, m)[self.place[i]]
            out[at] = np.bitwise_count(bits).sum(axis=1, dtype=np.int64)
        return out


def shingle_sets(blocks: DataFrame, width: int, percent: int) -> DataFrame:
    """Per document its set's size and identity; with tokens, rare first, where a link is possible.

    A document links with another one only if that share of its shingles occurs elsewhere.
    """
    space = B.GramSpace(B.total_bytes(blocks))

    def sets_of(texts: list[bytes]) -> list[np.ndarray]:
        powers, out = W.Powers(), []
        texts = [t.lower() for t in texts]  # of bytes: A-Z alone
        for first, end in W.batches(texts):
            hashes, bounds = W.word_hashes(texts[first:end], powers)
            out += [W.shingles(hashes[a:b], width, powers) for a, b in zip(bounds[:-1], bounds[1:], strict=True)]
        return out

    def grams(texts: list[bytes]) -> np.ndarray:
        return np.concatenate([*sets_of(texts), np.zeros(0, W.U)])

    def found(_: tuple, left: pa.Table, answers: pa.Table) -> pa.Table:
        row = left.to_pylist()[0]
        sets = sets_of(B.texts_of(row["body"], row["sizes"]))
        every = np.concatenate([*sets, np.zeros(0, W.U)])
        counts = B.counts_of(every, answers, space)
        out, at = [], 0
        for i, (key, tokens) in enumerate(zip(row["keys"], sets, strict=True)):
            n, often = len(tokens), counts[at : at + len(tokens)]
            at += n
            node = {"row": (row["block"] << B.ROW_BITS) + i, "key": key, "n_shingles": n}
            node["set_a"], node["set_b"] = (int(W.mix(tokens + W.U(k)).sum(dtype=W.U).view(np.int64)) for k in (1, 2))
            if n and int((often > 1).sum()) >= least_common(n, percent):
                order = np.lexsort((tokens, often))
                length = n - least_common(n, percent) + 1
                unshared = int((often == 1).sum())
                tokens = tokens[order].view(np.int64)
                node |= {"unshared": unshared, "prefix": tokens[unshared:length], "tokens": tokens, "folded": folded(tokens)}
            out.append(node)
        del every, counts, sets
        B.released()
        return pa.Table.from_pylist(out, ARROW_NODES)

    answers = B.gram_counts(blocks, grams, space)
    return blocks.groupBy("block").cogroup(answers.groupBy("block")).applyInArrow(found, NODES)


ARROW_NODES = pa.schema(
    [(n, pa.int64()) for n in ("row", "key", "n_shingles", "set_a", "set_b")]
    + [("unshared", pa.int32()), ("prefix", pa.list_(pa.int64())), ("tokens", pa.list_(pa.int64())), ("folded", pa.binary())]
)


def linked(common: Column, n_a: Column, n_b: Column, percent: int) -> Column:
    return common * 100 >= (n_a + n_b - common) * percent


def _fits(a: str, b: str, percent: int) -> Column:
    """The size filter: a set and one of fewer than ``percent`` of its shingles cannot link."""
    return (F.col(a) * 100 >= F.col(b) * percent) & (F.col(b) * 100 >= F.col(a) * percent)


def _verified(pairs: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """Of candidate rows (a, b) those that link, by intersecting their whole sets."""
    left = sets.select(F.col("row").alias("a"), F.col("tokens").alias("tokens_a"))
    right = sets.select(F.col("row").alias("b"), F.col("tokens").alias("tokens_b"))
    both = pairs.join(left, "a").join(right, "b")
    common = F.size(F.array_intersect("tokens_a", "tokens_b"))
    return both.where(linked(common, F.size("tokens_a"), F.size("tokens_b"), percent)).select("a", "b")


def near_copies(
    df: DataFrame, text: str = "text", key: str = "doc_id", width: int = WIDTH, percent: int = PERCENT
) -> DataFrame:
    """Per row of the input its key, ``n_shingles``, ``component_id`` and ``copies`` of its very set.

    ``component_id`` is the smallest key reachable over links, the row's own included. Words are
    lower-cased in A-Z; a text with fewer words than ``width`` is one shingle. Null and empty texts
    and texts without words have no shingles and link with nothing. A null key is no smallest key
    unless all keys of its component are null. Repeated rows are copies of each other; no rows
    give no rows; other columns are not read.
    """
    nodes = written(shingle_sets(B.packed(df, text, key), width, percent), compression="none")
    sets = ["n_shingles", "set_a", "set_b"]
    # one row stands for all with its set; copies are counted before the shuffle
    same = written(nodes.where("n_shingles > 0").groupBy(*sets).agg(F.min("row").alias("row"), F.min("key").alias("low"), F.count(F.lit(1)).alias("copies")))
    able = nodes.where("tokens is not null")
    distinct = written(able.join(same.select("row"), "row", "left_semi"), compression="none")

    group = F.xxhash64("n_shingles", "unshared", "prefix")
    members = distinct.select(group.alias("group"), "row", F.col("n_shingles").alias("n"), "unshared", "prefix")
    groups = checkpointed(
        members.groupBy("group").agg(F.min("row").alias("first"), F.first("n").alias("n"), F.first("unshared").alias("unshared"), F.first("prefix").alias("prefix"), F.count(F.lit(1)).alias("members"))
    )
    members = checkpointed(members.select("group", "row"))
    postings = groups.select("group", "first", "n", F.posexplode("prefix").alias("place", "token"))
    postings = postings.select("group", "first", "n", "token")
    shared = postings.groupBy("token").agg(F.count(F.lit(1)).alias("long")).where("long > 1").select("token")
    postings = checkpointed(postings.join(shared, "token"))
    # all pairs of two members are tried with the first one; of more members, they need a list
    alone = groups.where("members > 2").join(postings.select("group").distinct(), "group", "left_anti")
    alone = alone.select(F.get("prefix", F.lit(0)).alias("token"), "group", "first", "n")

    def tried(leaders: DataFrame, labels: DataFrame | None) -> DataFrame:
        """Candidate rows from leading groups and the other groups of their lists, and from groups' members."""
        pairs = postings.select("token", "group", "n").join(leaders, "token").where(_fits("n", "lead_n", percent) & (F.col("group") != F.col("lead_group")))
        pairs = pairs.select("group", F.col("lead").alias("a")).distinct()
        within = groups.select("group", F.col("first").alias("a"))
        pairs = pairs.union(within).join(members, "group").select(F.least("a", "row").alias("a"), F.greatest("a", "row").alias("b"))
        pairs = pairs.where("a <> b").distinct()
        if labels is None:
            return pairs
        of = lambda c: labels.select(F.col("node").alias(c), F.col("component").alias(f"of_{c}"))
        pairs = pairs.join(of("a"), "a", "left").join(of("b"), "b", "left")
        return pairs.where(F.coalesce("of_a", "a") != F.coalesce("of_b", "b")).select("a", "b")

    def chosen(*orders: Column) -> DataFrame:
        """The group of each list that is first in each order; an order is a number of the group."""
        least = postings.groupBy("token").agg(*[F.min(o).alias(f"o{k}") for k, o in enumerate(orders)])
        each = F.array(*[F.struct(F.lit(k).alias("k"), F.col(f"o{k}").alias("o")) for k in range(len(orders))])
        least = least.select("token", F.inline(each))
        numbers = F.array(*[F.struct(F.lit(k).alias("k"), o.alias("o")) for k, o in enumerate(orders)])
        leaders = groups.select(F.col("first").alias("lead"), F.col("group").alias("lead_group"), F.col("n").alias("lead_n"), F.inline(numbers))
        return least.join(leaders, ["k", "o"]).select("token", "lead", "lead_group", "lead_n").distinct()

    edges = checkpointed(_verified(tried(chosen(F.col("first")), None), distinct, percent))
    some = chosen(*[F.xxhash64("first", F.lit(k)) for k in range(TRIED)])
    edges = checkpointed(edges.union(_verified(tried(some, components(edges)), distinct, percent)))
    labels = components(edges)
    more = checkpointed(_across(postings.unionByName(alone), members, distinct, labels, percent))
    if more.take(1):
        labels = components(edges.union(more))

    low = same.join(labels.withColumnRenamed("node", "row"), "row", "left").withColumn("component", F.coalesce("component", "row"))
    lowest = low.groupBy("component").agg(F.min("low").alias("component_id"))
    low = low.join(lowest, "component").select(*sets, "component_id", "copies")
    found = nodes.select("key", *sets).join(low, sets, "left")
    alone = F.col("n_shingles") == 0
    return found.select(
        F.col("key").alias(key), "n_shingles",
        F.when(alone, F.col("key")).otherwise(F.col("component_id")).alias("component_id"),
        F.when(alone, F.lit(1).cast("long")).otherwise(F.col("copies")).alias("copies"),
    )


def _able(table: pa.Table, percent: int) -> Iterator[tuple[int, np.ndarray]]:
    """Of each left row of a block the right ones of other components that it may link with.

    Sets are folded into parities. Two sets differ by at least the parities that differ, so a pair
    with more of them than a link allows is left out; that is exact.
    """
    component, size = table["component"].to_numpy(), table["size"].to_numpy().astype(np.int64)
    folds = Folds(table["folded"].to_pylist())
    second, same_part = table["second"].to_numpy(zero_copy_only=False), table["p"][0] == table["q"][0]
    left = np.flatnonzero(~second)
    right = left if same_part else np.flatnonzero(second)
    for i in left:
        other = right[(component[right] != component[i]) & (size[right] * 100 >= size[i] * percent) & (size[i] * 100 >= size[right] * percent)]
        if same_part:
            other = other[other > i]
        differ = folds.differ(i, other)
        # common = (both sizes - difference) / 2 at most
        other = other[(size[other] + size[i] - differ) * 100 >= (size[other] + size[i] + differ) * percent]
        if len(other):
            yield int(i), other


def joining(table: pa.Table, percent: int) -> pa.Table:
    """Links (a, b) of a block's rows, verified on whole sets, that join its components: a forest."""
    row, size = table["row"].to_numpy(), table["size"].to_numpy().astype(np.int64)
    tokens = table["tokens"].combine_chunks()
    ends = np.cumsum(size)
    values, codes = np.unique(tokens.flatten().to_numpy(), return_inverse=True)
    sets = [codes[e - n : e] for e, n in zip(ends.tolist(), size.tolist(), strict=True)]
    _, label = np.unique(table["component"].to_numpy(), return_inverse=True)
    held = np.zeros(len(values), bool)
    a, b = [], []
    for i, other in _able(table, percent):
        other = other[label[other] != label[i]]
        if not len(other):
            continue
        held[sets[i]] = True
        starts = np.cumsum([0, *size[other[:-1]].tolist()])
        common = np.add.reduceat(held[np.concatenate([sets[j] for j in other])].astype(np.int64), starts)
        held[sets[i]] = False
        for j in other[common * 100 >= (size[other] + size[i] - common) * percent]:
            if label[j] != label[i]:
                label[label == label[j]] = label[i]
                a.append(min(row[i], row[j]))
                b.append(max(row[i], row[j]))
    return pa.table({"a": pa.array(a, pa.int64()), "b": pa.array(b, pa.int64())})


def _across(postings: DataFrame, members: DataFrame, distinct: DataFrame, labels: DataFrame, percent: int) -> DataFrame:
    """Links between rows of one list and different components, enough to join all that link there.

    A list is cut into blocks of about BLOCK_ROWS rows or BLOCK_TOKENS shingles a side. First a
    block keeps its rows that may link with another one; only these are sent with their whole sets.
    """
    rows = postings.select("token", "group", "n").join(members, "group")
    rows = rows.join(labels.withColumnRenamed("node", "row"), "row", "left").withColumn("component", F.coalesce("component", "row"))
    lists = rows.groupBy("token").agg(F.count(F.lit(1)).alias("long"), F.sum("n").alias("all"), F.min("component").alias("c0"), F.max("component").alias("c1"))
    parts = F.greatest(F.ceil(F.col("long") / BLOCK_ROWS), F.ceil(F.col("all") / BLOCK_TOKENS)).cast("int")
    rows = rows.join(lists.where("c0 <> c1").select("token", parts.alias("parts")), "token")
    part = F.pmod(F.xxhash64("row"), F.col("parts")).cast("int")
    # each part of a list meets each other part once, and itself
    rows = rows.withColumn("part", part).withColumn("with", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)))
    rows = rows.select("token", "row", "component", F.col("n").alias("size"), F.least("part", "with").alias("p"), F.greatest("part", "with").alias("q"), (F.col("part") > F.col("with")).alias("second"))
    rows = rows.join(distinct.select("row", "folded"), "row")
    names = ["token", "row", "component", "size", "p", "q", "second"]

    def promising(table: pa.Table) -> pa.Table:
        may = np.zeros(table.num_rows, bool)
        for i, other in _able(table, percent):
            may[i] = True
            may[other] = True
        return table.select(names).filter(pa.array(may))

    schema = rows.select(*names).schema
    rest = checkpointed(rows.groupBy("token", "p", "q").applyInArrow(promising, schema))
    rest = rest.join(distinct.select("row", "folded", "tokens"), "row")
    return rest.groupBy("token", "p", "q").applyInArrow(lambda table: joining(table, percent), "a long, b long").distinct()
