"""The corpus operators against brute force, and on nulls, ties, empty tables and clashing names."""

import hashlib
import random
import zlib
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from plumbline.llm import blocks, decontaminate, graph, jaccard, lines, mixing, neighbours, sharding, substring, suffixes
from plumbline.llm import words as W
from plumbline.llm.common import text_or_empty

DDL = "doc_id long, text string, source string, lang string"
rng = random.Random(11)
WORDS = ["".join(rng.choice("abcdefgh") for _ in range(rng.randint(1, 7))) for _ in range(400)]


def prose(n, seed):
    r = random.Random(seed)
    return "".join(r.choice(WORDS).capitalize() + r.choice([" ", " ", " ", "\n", "\t ", ", "]) for _ in range(n)).strip()


def corpus():
    """Null and empty texts, exact and near copies, repeated rows, a shared passage, one long text."""
    base = [prose(90, i) for i in range(12)]
    passage = prose(60, 99)
    rows = [(i, t) for i, t in enumerate(base)]
    rows += [(20 + i, base[3]) for i in range(8)]  # a group of copies
    rows += [(30 + i, base[4].replace(base[4].split()[5 * i + 2], "zz", 1)) for i in range(9)]  # near copies
    rows += [(40 + i, prose(10, 200 + i) + " " + passage + " " + prose(10, 300 + i)) for i in range(6)]
    rows += [(50, None), (51, ""), (52, " \n\t"), (53, "one"), (54, "One"), (55, "two words"), (56, "é" * 200), (57, "ab" * 300), (58, "ab" * 300)]
    rows += [(60, passage + " mid " + passage), (61, "\n".join([base[6], base[7]])), (62, prose(3000, 7)), (None, base[0]), (None, "alone in here")]
    rows += [(5, base[5]), (5, base[5])]  # rows that repeat
    return [(k, t, f"s{(k or 0) % 3}" if (k or 0) % 7 else None, "x") for k, t in rows]


@pytest.fixture(scope="module")
def docs(spark):
    from plumbline.sources.local import local_frame

    return local_frame(spark, corpus(), DDL).repartition(5)


@pytest.fixture
def nothing(frame):
    return frame([], DDL)


def words(text):
    return (text or "").encode().split()


# --- 1: shards ---------------------------------------------------------------------------


def test_shards_are_contiguous_gapless_and_near_equal(docs):
    kept = sharding.byte_shards(docs.withColumn("SHARD", F.lit("clash")), shards=7)
    assert kept.columns == ["doc_id", "text", "source", "lang", "size", "shard", "slot"]
    rows = sorted(kept.collect(), key=lambda r: (r.shard, r.slot))
    assert len(rows) == len(corpus()) and [r.size for r in rows] == [len((r.text or "").encode()) + 16 for r in rows]
    keys = [(r.doc_id is not None, r.doc_id or 0) for r in rows]
    assert keys == sorted(keys)  # nulls first, then by id, over all shards
    total, most = sum(r.size for r in rows), max(r.size for r in rows)
    for s in range(7):
        own = [r for r in rows if r.shard == s]
        assert [r.slot for r in own] == list(range(len(own)))
        assert abs(sum(r.size for r in own) - total / 7) <= most
    again = sharding.byte_shards(docs.repartition(3), shards=7, keep=("doc_id",)).collect()
    assert Counter((r.doc_id, r.size, r.shard, r.slot) for r in again) == Counter((r.doc_id, r.size, r.shard, r.slot) for r in rows)


def test_shards_of_one_hot_key_and_of_nothing(spark, nothing):
    hot = spark.range(0, 3000, 1, 6).select(F.lit(1).alias("doc_id"), F.concat(F.lit("t"), F.col("id") % 5).alias("text"))
    sizes = sharding.byte_shards(hot, shards=40).groupBy("shard").agg(F.sum("size").alias("n")).collect()
    assert len(sizes) == 40 and max(r.n for r in sizes) - min(r.n for r in sizes) <= 36
    assert sharding.byte_shards(nothing).collect() == []


def test_no_column_name_clashes_with_a_helper(docs):
    names = ["_part", "_tie", "_order", "_row", "_copy", "_c0", "_k0", "_START", "number", "key", "row", "place", "island"]
    wide = docs.select("*", *[F.concat(F.lit(n), F.col("doc_id").cast("string")).alias(n) for n in names])
    for result in (
        sharding.byte_shards(wide, shards=3), mixing.mixed(wide), lines.deduplicated(wide),
        mixing.repeated(mixing.mixed(wide).withColumn("copies", F.lit(1))),
    ):
        assert result.columns[: len(wide.columns)] == wide.columns
        rows = result.collect()
        assert len(rows) == len(corpus())
        for r in rows:
            assert all(r[n] == (None if r.doc_id is None else f"{n}{r.doc_id}") for n in names)


def test_checksums_are_those_of_the_utf8_bytes(docs):
    for r in docs.select("text", F.crc32(text_or_empty("text")).alias("c")).collect():
        assert r.c == zlib.crc32((r.text or "").encode())


# --- 3: near copies ------------------------------------------------------------------------


def near_copies_by_force(rows, width=3, percent=90):
    sets = []
    for _, text, *_ in rows:
        w = words((text or "").encode().lower().decode())
        sets.append(frozenset(tuple(w[i : i + width]) for i in range(len(w) - width + 1)) if len(w) >= width else frozenset([tuple(w)] if w else []))
    part = list(range(len(rows)))

    def root(i):
        while part[i] != i:
            i = part[i]
        return i

    for i in range(len(rows)):
        for j in range(i):
            both = len(sets[i] & sets[j])
            if sets[i] and 100 * both >= percent * len(sets[i] | sets[j]):
                part[max(root(i), root(j))] = min(root(i), root(j))
    low = {}
    for i, (key, *_) in enumerate(rows):
        r = root(i)
        low[r] = key if low.get(r) is None else low[r] if key is None else min(low[r], key)
    return Counter((key, len(sets[i]), low[root(i)]) for i, (key, *_) in enumerate(rows))


@pytest.mark.parametrize("width, percent", [(3, 90), (5, 80), (1, 50)])
def test_near_copies_agree_with_all_pairs(docs, width, percent):
    got = jaccard.near_copies(docs.withColumn("tokens", F.lit(1)), width=width, percent=percent)
    assert Counter((r.doc_id, r.n_shingles, r.component_id) for r in got.collect()) == near_copies_by_force(corpus(), width, percent)


def test_lists_longer_than_a_block_lose_no_link(spark, frame, monkeypatch):
    """Variants of one text, many of which link with few of the others only."""
    base = [WORDS[i] for i in range(60)]
    rows = []
    for i in range(90):
        r = random.Random(i)
        own = list(base)
        for _ in range(r.choice([0, 1, 1, 2, 3, 5])):
            own[r.randrange(60)] = f"w{r.randrange(30)}"
        rows.append((i, " ".join(own), None, None))
    monkeypatch.setattr(jaccard, "BLOCK_ROWS", 7)
    monkeypatch.setattr(jaccard, "TRIED", 1)
    got = jaccard.near_copies(frame(rows, DDL))
    assert Counter((r.doc_id, r.n_shingles, r.component_id) for r in got.collect()) == near_copies_by_force(rows)


def test_parities_differ_at_most_as_sets_do():
    r = np.random.default_rng(4)
    pool = r.integers(-(2**63), 2**63 - 1, 6000)
    sets = [np.unique(pool[r.random(6000) < share]) for share in (0.001, 0.1, 0.16, 0.18, 0.5, 0.9, 0.95, 1) for _ in range(3)]
    folds = jaccard.Folds([jaccard.folded(x) for x in sets])
    assert len(set(folds.widths.tolist())) == 4
    for i, x in enumerate(sets):
        found = folds.differ(i, np.arange(len(sets)))
        exact = [len(np.setxor1d(x, y)) for y in sets]
        assert found[i] == 0 and all(a <= b and a % 2 == b % 2 for a, b in zip(found, exact))
        # sizes that may link: the parities tell unlike sets apart
        assert all(a >= b / 4 for a, b, y in zip(found, exact, sets) if 0.8 * len(x) <= len(y) <= len(x) / 0.8)


@pytest.mark.parametrize("n", [100, 200, 400])
def test_a_block_tells_fewer_links_than_it_has_rows(n):
    """Near copies of one set: the links of a block join what all its links join."""
    r = np.random.default_rng(n)
    sets = [np.unique(np.where(r.random(60) < r.choice([0.02, 0.08, 0.2]), r.integers(100, 2**60, 60), np.arange(60))) for _ in range(n)]
    folded = [jaccard.folded(x) for x in sets]
    component = [i - i % 2 for i in range(n)]  # each second row is joined to the one before it
    table = pa.table({
        "row": pa.array(range(n), pa.int64()), "component": pa.array(component, pa.int64()), "size": [len(x) for x in sets],
        "p": [0] * n, "q": [0] * n, "second": [False] * n, "folded": folded, "tokens": [x.tolist() for x in sets],
    })
    found = jaccard.joining(table, 80).to_pylist()
    assert 0 < len(found) < n // 2 + n % 2  # components less one

    def label(edges):
        own = list(component)
        for a, b in edges:
            low, high = sorted((own[a], own[b]))
            own = [low if c == high else c for c in own]
        return own

    every = [(i, j) for i in range(n) for j in range(i) if 100 * len(np.intersect1d(sets[i], sets[j])) >= 80 * len(np.union1d(sets[i], sets[j]))]
    assert len(every) > len(found) and label((e["a"], e["b"]) for e in found) == label(every)


def test_members_of_one_group_link_without_its_first(frame):
    """No other group shares the prefix of the three documents, and their first links with neither other."""
    header, p, q = "h1 h2 h3 h4 h5 h6 h7", [f"p{i}" for i in range(31)], [f"q{i}" for i in range(31)]
    p, q = " ".join(["s1", "s2", *p]), " ".join(["s1", "s2", *q])
    texts = [f"{header} {q} x3", f"{header} {p} x1", f"{header} {p} x2"]
    texts += [" ".join([f"l{i}w{k}" for k in range(90)] + [p, f"m{i}", q] + [f"r{i}w{k}" for k in range(90)]) for i in range(6)]
    rows = [(i, t, None, None) for i, t in enumerate(texts)]
    got = jaccard.near_copies(frame(rows, DDL).coalesce(1))
    told = Counter((r.doc_id, r.n_shingles, r.component_id) for r in got.collect())
    assert told == near_copies_by_force(rows) and told[2, 39, 1] == 1


def test_rows_are_numbered_in_every_partition(spark, monkeypatch):
    """Partitions from the 129th on, and blocks that end by their number of empty texts."""
    texts = F.when(F.col("id") < 8, F.lit("")).otherwise(F.concat_ws(" ", F.lit("one two three"), F.col("id") % 2))
    docs = spark.range(0, 300, 1, 150).select(F.col("id").alias("doc_id"), texts.alias("text")).where("id < 8 or id > 255")
    monkeypatch.setattr(blocks, "ROW_BITS", 0)
    packed = blocks.packed(docs)
    monkeypatch.undo()
    assert packed.count() == 52 and max(len(r["keys"]) for r in packed.select("keys").collect()) == 1
    packed = blocks.packed(docs)
    sets = [r["row"] for r in jaccard.shingle_sets(packed, 3, 90).select("row").collect()]
    assert len(set(sets)) == 52 and 149 << 40 <= max(sets) < 1 << 63
    assert (((1 << 23) - 1) << blocks.BLOCK_BITS | (1 << blocks.BLOCK_BITS) - 1) << blocks.ROW_BITS < 1 << 63


def test_near_copies_of_nothing(nothing):
    assert jaccard.near_copies(nothing).collect() == []


def test_components_reach_along_chains(spark, frame):
    chain = [(i, i + 1) for i in range(0, 40)] + [(100, 90), (90, 95), (7, 7), (50, 51), (50, 51)]
    got = {r.node: r.component for r in graph.components(frame(chain, "a long, b long")).collect()}
    assert got == {i: 0 for i in range(41)} | {90: 90, 95: 90, 100: 90, 50: 50, 51: 50}
    assert graph.components(frame([], "a long, b long")).collect() == []


# --- 4: neighbours -------------------------------------------------------------------------


def vectors(spark, n, seed=1):
    r = np.random.default_rng(seed)
    centres = r.standard_normal((24, 16)) * 2
    points = centres[r.integers(0, 24, n)] + r.standard_normal((n, 16))
    rows = [(i, [float(x) for x in p]) for i, p in enumerate(points)]
    for i in range(n // 3):  # one vector that a third of all rows share
        rows[3 * i + 1] = (3 * i + 1, rows[1][1])
    return rows


def exact_neighbours(rows, query, k):
    fine = [(i, np.array(v)) for i, v in rows if i is not None and v and len(v) == 16 and all(x is not None and np.isfinite(x) for x in v) and any(v)]
    own = dict(fine)[query]
    return sorted((float(np.sqrt(((v - own) ** 2).sum())), i) for i, v in fine if i != query)[:k]


def test_neighbours_are_found_and_ranked(spark, frame, monkeypatch):
    monkeypatch.setattr(neighbours, "PIECE", 150)
    monkeypatch.setattr(neighbours, "ROWS_PER_PART", 120)
    rows = vectors(spark, 1500)
    rows += [(2000, None), (2001, []), (2002, [0.0] * 16), (2003, [float("nan")] + [1.0] * 15), (2004, [None] + [1.0] * 15), (2005, [1.0] * 3), (None, [1.0] * 16)]
    df = frame(rows, "vec_id long, embedding array<double>").withColumn("rank", F.lit("clash"))
    found = {}
    for r in neighbours.nearest(df, F.col("vec_id") % 100 == 0).collect():
        found.setdefault(r.query_id, []).append((r.rank, r.score, r.vec_id))
    assert set(found) == {q for q in range(0, 1500, 100)}
    hits = 0
    for query, rows_found in found.items():
        rows_found.sort()
        assert [r[0] for r in rows_found] == list(range(1, 11))
        assert [r[1:] for r in rows_found] == sorted(r[1:] for r in rows_found)
        wanted = exact_neighbours(rows, query, 10)
        far = dict((i, s) for s, i in exact_neighbours(rows, query, len(rows)))
        assert all(s == pytest.approx(far[i], rel=1e-12) for _, s, i in rows_found)
        hits += len({i for _, i in wanted} & {i for *_, i in rows_found})
    assert hits >= 0.9 * 10 * len(found)


def test_neighbours_of_few_rows_and_of_none(frame):
    few = frame([(100, [1.0, 0.0]), (7, [1.0, 1.0]), (3, [1.0, -1.0]), (200, [5.0, 0.0])], "vec_id long, embedding array<float>")
    got = [tuple(r) for r in neighbours.nearest(few, F.col("vec_id") == 100).orderBy("rank").collect()]
    assert got == [(100, 1, 3, 1.0), (100, 2, 7, 1.0), (100, 3, 200, 4.0)]  # a tie goes to the smaller id
    assert neighbours.nearest(few.filter("false"), F.col("vec_id") == 100).collect() == []


def test_halves_are_balanced_and_follow_the_graph():
    a = [(i, j) for i in range(20) for j in range(i)]
    edges = np.array([*a, *[(i + 20, j + 20) for i, j in a], (0, 20)]).T
    side = neighbours.halves(edges, 40, np.random.default_rng(0))
    assert side.sum() == 20 and len(set(side[:20].tolist())) == 1


# --- 5: bytes ------------------------------------------------------------------------------


def unique_bytes_by_force(rows, window=50):
    first = {}
    order = lambda k: (k is None, k or 0)
    for key, text, *_ in sorted(rows, key=lambda r: order(r[0])):
        data = (text or "").encode()
        for i in range(len(data) - window + 1):
            first.setdefault(data[i : i + window], order(key))
    out = Counter()
    for key, text, *_ in rows:
        data = (text or "").encode()
        gone = bytearray(len(data))
        for i in range(len(data) - window + 1):
            if first[data[i : i + window]] < order(key):
                gone[i : i + window] = b"\1" * window
        out[key, len(data), sum(gone), hashlib.sha256(bytes(x for x, g in zip(data, gone) if not g)).hexdigest()] += 1
    return out


def told_bytes(df):
    out = Counter()
    for r in df.collect():
        s = r.spans
        assert s == sorted(s) and len(s) % 2 == 0 and len(set(s)) == len(s)
        out[r.doc_id, r.n_bytes, sum(s[1::2]) - sum(s[::2]), hashlib.sha256(r.kept).hexdigest()] += 1
    return out


def test_repeated_bytes_agree_with_brute_force(docs):
    assert told_bytes(suffixes.unique_bytes(docs.withColumn("kept", F.lit(1)))) == unique_bytes_by_force(corpus())


def test_repeated_bytes_over_many_small_blocks(frame, monkeypatch):
    """Periodic and binary-looking texts, each in a block of its own, over many ranges."""
    r = random.Random(4)
    parts = ["\0" * 30 + "x", "aab" * 20, prose(30, 1), "\x00\x01" * 40, "ÿé" * 30, prose(12, 2)]
    rows = [(i, "".join(r.choice(parts) for _ in range(r.randint(0, 5))), None, None) for i in range(60)]
    monkeypatch.setattr(blocks, "RANGE_BYTES", 64)
    packed = blocks.packed
    monkeypatch.setattr(suffixes.B, "packed", lambda df, text, key: packed(df, text, key, block_bytes=200))
    assert told_bytes(suffixes.unique_bytes(frame(rows, DDL))) == unique_bytes_by_force(rows)


def test_no_bytes(nothing):
    assert suffixes.unique_bytes(nothing).collect() == []


def test_merged_runs_are_sorted_with_their_common_lengths():
    r = random.Random(2)
    for _ in range(60):
        width = r.choice([1, 3, 8])
        runs = [sorted(bytes(r.choice(b"ab\0") for _ in range(width)) for _ in range(r.randint(0, 9))) for _ in range(r.randint(1, 7))]
        as_rows = [np.frombuffer(b"".join(x), np.uint8).reshape(len(x), width) for x in runs]
        order, shared = suffixes.merged([([int.from_bytes(b) for b in x], suffixes.common(m).tolist()) for x, m in zip(runs, as_rows)], width)
        at, out = [0] * len(runs), []
        for k in order:
            out.append(runs[k][at[k]])
            at[k] += 1
        assert out == sorted(b for x in runs for b in x)
        for a, b, n in zip(out, out[1:], shared[1:]):
            assert n == next((i for i in range(width) if a[i] != b[i]), width)


def test_front_coding_is_exact():
    r = np.random.default_rng(0)
    rows = np.unique(r.integers(97, 99, (200, 74)).astype(np.uint8), axis=0)
    bits, docs = r.integers(1, 1 << 24, len(rows)).astype(np.uint32), r.integers(-5, 9, len(rows))
    right, _, left, b, d = suffixes.decoded(suffixes.front_coded(rows, bits, docs, 50), len(rows), 50, 24)
    assert (right == rows[:, :50]).all() and (left == rows[:, 50:]).all() and (b == bits).all() and (d == docs).all()


# --- 7: passages ---------------------------------------------------------------------------


def passages_by_force(rows, window=35):
    seen = Counter(tuple(w[i : i + window]) for _, t, *_ in rows for w in [words(t)] for i in range(len(w) - window + 1))
    out = Counter()
    for key, text, *_ in rows:
        w = words(text)
        gone = [False] * len(w)
        for i in range(len(w) - window + 1):
            if seen[tuple(w[i : i + window])] > 1:
                gone[i : i + window] = [True] * window
        out[key, len(w), sum(gone), b" ".join(x for x, g in zip(w, gone) if not g).decode()] += 1
    return out


def told_passages(df):
    return Counter((r.doc_id, r.n_words, sum(r.spans[1::2]) - sum(r.spans[::2]), r.kept) for r in df.collect())


def test_repeated_passages_agree_with_brute_force(docs):
    assert told_passages(substring.repeated_passages(docs.withColumn("spans", F.lit(1)))) == passages_by_force(corpus())


def test_a_passage_repeated_within_its_own_text(frame):
    rows = [(1, "x y " * 40, None, None), (2, prose(50, 5) + " and " + prose(50, 5), None, None), (3, prose(34, 8), None, None), (4, prose(34, 8), None, None)]
    got = told_passages(substring.repeated_passages(frame(rows, DDL)))
    assert got == passages_by_force(rows) and sum(k[2] for k in got) == 180


def test_no_passages(nothing):
    assert substring.repeated_passages(nothing).collect() == []


def test_words_are_cut_at_six_characters_only():
    texts = ["a\x0bb\x0cc d\te\nf\rg", "", "\x1c\xa0  x", " lead", "trail "]
    hashes, bounds = W.word_hashes([t.encode() for t in texts], W.Powers())
    assert np.diff(bounds).tolist() == [7, 0, 2, 1, 1]
    again, _ = W.word_hashes([b"lead a"], W.Powers())
    assert again[0] == hashes[9] and again[1] == hashes[0]


# --- 6: benchmark items --------------------------------------------------------------------


def contained_by_force(docs, items):
    def shingles(text):
        w = words((text or "").encode().lower().decode())
        return {tuple(w[i : i + 5]) for i in range(len(w) - 4)} if len(w) > 4 else {tuple(w)} if w else set()

    out = set()
    for key, text, *_ in docs:
        own = shingles(text)
        for item, t in items:
            s = shingles(t)
            if s and len(own & s) * 100 >= len(s) * 80:
                out.add((key, item, len(s), len(own & s)))
    return out


def test_contained_items_agree_with_all_pairs(docs, frame):
    rows = corpus()
    text = rows[0][1].split()
    items = [
        (1, " ".join(text[10:40]).upper()), (2, " ".join(text[:20]) + " other words at the end here"), (3, rows[-5][1] and " ".join(rows[-5][1].split()[:9])),
        (4, "ONE"), (5, "two  words"), (6, None), (7, ""), (8, prose(40, 999)), (9, " ".join(rows[2][1].split()[:10] + ["q"] * 30)), (10, prose(60, 99)), (10, prose(60, 99)),
    ]
    given = frame(items, "item_id long, text string").withColumn("all", F.lit("clash"))
    got = decontaminate.contained(docs.withColumn("hash", F.lit(1)), given).collect()
    assert {(r.doc_id, r.item_id, r.n_shingles, r.n_shared) for r in got} == contained_by_force(rows, items)
    assert len(got) == len({(r.doc_id, r.text_hash, r.item_id) for r in got})
    dirty = {k for k, *_ in contained_by_force(rows, items)}
    clean = decontaminate.decontaminated(docs, given)
    assert clean.columns == docs.columns
    assert Counter(r.doc_id for r in clean.collect() if r.doc_id is not None) == Counter(k for k, *_ in rows if k is not None and k not in dirty)


def test_no_items_and_no_documents(docs, nothing, frame):
    none = frame([], "item_id long, text string")
    assert decontaminate.contained(docs, none).collect() == []
    assert decontaminate.decontaminated(docs, none).count() == len(corpus())
    assert decontaminate.contained(nothing, frame([(1, "a b c d e f")], "item_id long, text string")).collect() == []


# --- 8: the mix ------------------------------------------------------------------------------


def targets_by_force(sizes, weights=(5, 2, 1), most=3):
    names = sorted((s for s in sizes if s is not None), key=lambda s: s.encode()) + [None] * (None in sizes)
    weight = {s: weights[i % 3] for i, s in enumerate(names)}
    total, held = sum(sizes.values()), {}
    while True:
        free = [s for s in names if s not in held]
        level = (total - sum(held.values())) / sum(weight[s] for s in free) if free else 0
        over = [s for s in free if weight[s] * level > most * sizes[s]]
        if not over:
            return {s: held.get(s, weight[s] * level) for s in names}
        held |= {s: most * sizes[s] for s in over}


def test_the_mix_meets_its_targets(spark, frame):
    r = random.Random(5)
    rows = []
    for s, n in (("b", 300), ("a", 40), ("é", 25), ("Z", 2), (None, 30), ("", 5)):
        rows += [(len(rows) + i, " ".join(["w"] * r.choice([0, 1, 3, 30, 200, 900])) or None, s, "x") for i in range(n)]
    df = frame(rows, DDL).repartition(4)
    got = mixing.mixed(df, keep=("doc_id", "source")).collect()
    assert sorted(g.doc_id for g in got) == sorted(x[0] for x in rows)
    sizes, taken = Counter(), Counter()
    for g in got:
        assert g.size == len(words(rows[g.doc_id][1])) and 0 <= g.copies <= 3
        sizes[g.source] += g.size
        taken[g.source] += g.copies * g.size
    wanted = targets_by_force(dict(sizes))
    for g in got:
        assert g.source_size == sizes[g.source] and g.target == pytest.approx(wanted[g.source])
    assert sum(wanted.values()) == pytest.approx(sum(sizes.values()))
    for s in wanted:
        assert abs(taken[s] - wanted[s]) <= max(30, 0.02 * wanted[s]), (s, taken[s], wanted[s])
    again = mixing.mixed(frame(rows, DDL).repartition(7), keep=("doc_id", "source")).collect()
    assert {(g.doc_id, g.copies) for g in again} == {(g.doc_id, g.copies) for g in got}


def test_rates_are_an_exponential_tilt(frame):
    """Away from the bound the log of a rate is proportional to the document's size."""
    rows = [(i, " ".join(["w"] * n), s, "x") for i, (n, s) in enumerate([(10, "a"), (40, "a"), (80, "a"), (10, "b"), (60, "b"), (90, "c"), (30, "c")])]
    rates = {}
    for g in mixing.mixed(frame(rows, DDL), keep=("doc_id", "source")).collect():
        if g.rate < 3:
            rates.setdefault(g.source, set()).add(round(float(np.log(g.rate)) / g.size, 6))
    assert rates and all(len(x) == 1 for x in rates.values())


def test_tilts_reach_sources_of_very_long_and_short_documents(spark, frame):
    """Half the words in one document of a million, half in short ones, and a tenth of them wanted."""
    counts = frame([(0, 1_000_000, 1), (0, 500, 2000)], "_rank long, size long, _n long")
    sources = frame([(0, 200_000.0, 6_000_000.0)], "_rank long, target double, _bound double")
    found = mixing.tilts(counts, sources, 1).first()
    rate = np.exp(found["_tilt"] * 500 / found["_scale"])
    assert found["_tilt"] < -1000 and abs(1_000_000 * rate - 200_000) < 1


def test_the_mix_carries_all_columns_and_repeats_rows(docs, nothing):
    mix = mixing.mixed(docs.withColumn("Size", F.lit("clash")))
    assert mix.columns == ["doc_id", "text", "source", "lang", "size", "source_size", "target", "rate", "copies"]
    assert mix.count() == len(corpus())
    copies = mix.agg(F.sum("copies")).first()[0]
    assert mixing.repeated(mix).count() == copies
    assert mixing.mixed(nothing).collect() == []


# --- 9: lines --------------------------------------------------------------------------------


def line_dedup_by_force(rows, shortest):
    first, out = {}, Counter()
    order = sorted(range(len(rows)), key=lambda i: (rows[i][0] is None, rows[i][0] or 0))
    texts = [None if rows[i][1] is None else rows[i][1].split("\n") for i in order]
    for place, own in enumerate(texts):
        for k in range(len(own or []) - shortest + 1):
            first.setdefault(tuple(own[k : k + shortest]), (place, k))
    for place, own in enumerate(texts):
        if own is None:
            out[rows[order[place]][0], 0, 0, None] += 1
            continue
        gone = [False] * len(own)
        for k in range(len(own) - shortest + 1):
            if first[tuple(own[k : k + shortest])] < (place, k):
                gone[k : k + shortest] = [True] * shortest
        kept = "\n".join(x for x, g in zip(own, gone) if not g)
        out[rows[order[place]][0], len(own), sum(gone), kept] += 1
    return out


@pytest.mark.parametrize("shortest", [1, 2, 3])
def test_line_dedup_agrees_with_brute_force(frame, shortest):
    r = random.Random(9)
    pool = ["a", "b", "", "c c", "d"]
    rows = [(i, "\n".join(r.choice(pool) for _ in range(r.randint(1, 9))), None, None) for i in range(25)]
    rows += [(30, None, None, None), (31, "", None, None), (32, "\n", None, None), (33, "\n".join(["long"] * 40), None, None), (None, "a\nb\nc c", None, None)]
    rows += [(34, rows[3][1], None, None), (3, rows[3][1], None, None), (35, "x\r\ny\r\nx", None, None)]
    got = lines.deduplicated(frame(rows, DDL).coalesce(1).withColumn("spans", F.lit(1)), shortest=shortest).collect()
    told = Counter((g.doc_id, g.n_lines, sum(s.end - s.start for s in g.spans), g.kept) for g in got)
    assert told == line_dedup_by_force(rows, shortest)


def test_long_lines_and_whole_texts_go_alone(frame):
    r = random.Random(5)
    pool = ["a", "b c", "", "one two  three", "x y z w", "\tp q r", "lone"]
    rows = [(i, "\n".join(r.choice(pool) for _ in range(r.randint(1, 7))), None, None) for i in range(25)]
    rows += [(30, "lone", None, None), (31, "lone", None, None), (32, "", None, None), (33, "", None, None), (34, None, None, None)]
    seen, pairs, wanted = set(), set(), Counter()
    for key, text, *_ in rows:
        own = [] if text is None else text.split("\n")
        gone = set()
        for k, line in enumerate(own):
            pair = tuple(own[k : k + 2])
            if len(pair) == 2 and pair in pairs:
                gone |= {k, k + 1}
            if line in seen and (len(line.split()) >= 3 or len(own) == 1 and line.split()):
                gone.add(k)
            seen.add(line)
            pairs.add(pair)
        runs = sum(k - 1 not in gone for k in gone)
        wanted[key, len(gone), runs, None if text is None else "\n".join(x for k, x in enumerate(own) if k not in gone)] += 1
    got = lines.deduplicated(frame(rows, DDL), alone=3).collect()
    assert Counter((g.doc_id, sum(s.end - s.start for s in g.spans), len(g.spans), g.kept) for g in got) == wanted


def test_no_lines(nothing):
    assert lines.deduplicated(nothing).collect() == []


def test_longest_repeats_are_told_by_doubling(frame):
    rows = [(i * 100 + k, hash(x) % 1000, 0) for i, text in enumerate(["abcdefgh", "xabcdefgy"]) for k, x in enumerate(text)]
    found = {r.place: (r.first, r.longest) for r in lines.repeated_runs(frame(rows, "place long, line_a long, line_b int")).collect()}
    assert found[101] == (0, 4) and found[104] == (3, 4) and found[106] == (5, 2) and len(found) == 6
