"""Manifest, vector codes and quality against brute force, and on nulls, ties, empty tables and clashing names."""

import random
import zlib
from collections import Counter, defaultdict
from hashlib import sha256

import numpy as np
import pytest
from pyspark.sql import functions as F

from plumbline.llm import codes, merkle, quality, queries

DDL = "doc_id long, source string, lang string, n_chars long, text string"
SF_DIR = "/root/testdata/sf0.001"


def hashed(text):
    return sha256(text.encode()).hexdigest()


def told(value):
    return "-" if value is None else f"{len(str(value).encode())}:{value}"


# --- 12: manifest ------------------------------------------------------------------------


def levels(nodes):
    out = [nodes]
    while len(nodes) > 1:
        nodes = [hashed("".join(nodes[i : i + 16])) for i in range(0, len(nodes), 16)]
        out.append(nodes)
    return out


def siblings(tree, i):
    out = []
    for level in tree[:-1]:
        a = i // 16 * 16
        out.append(("".join(level[a:i]), "".join(level[i + 1 : a + 16])))
        i //= 16
    return out


def manifest_of(rows):
    """Of rows (doc_id, source, lang, n_chars, text) what the query returns, by plain recursion."""
    lower = str.maketrans(queries.UPPER, queries.LOWER)
    groups = defaultdict(list)
    for row in rows:
        leaf = hashed("".join(map(told, row)))
        k, text = row[0], row[4]
        changed = k is not None and zlib.crc32(str(k).encode()) % 5 == 0 and text is not None
        seen = hashed("".join(map(told, (*row[:4], text.translate(lower))))) if changed else leaf
        groups[row[1]].append((k is not None, k or 0, leaf, seen, k))
    order = sorted(groups, key=lambda s: (s is not None, (s or "").encode()))
    trees = []
    for name in order:
        groups[name].sort(key=lambda x: x[:4])
        trees.append(levels([x[2] for x in groups[name]]))
    top = levels([t[-1][0] for t in trees])
    out = []
    for g, (name, tree) in enumerate(zip(order, trees, strict=True)):
        for i, (_, _, leaf, seen, k) in enumerate(groups[name]):
            path = siblings(tree, i) + siblings(top, g)
            for left, right in path:
                seen = hashed(left + seen + right)
            root = top[-1][0]
            out.append((k, leaf, tree[-1][0], root, hashed("".join(a + z for a, z in path)), seen, seen == root))
    return Counter(out)


def manifest_rows():
    r = random.Random(4)
    rows = [(i, "hot", "en", i, f"Text {i} " + "x" * (i % 5)) for i in range(700)]  # three levels of a source
    rows += [(1000 + i, "full", None, None, f"T{i}") for i in range(256)]
    rows += [(2000 + i, "most", "de", 1, f"T{i}") for i in range(257)]
    rows += [(3000 + i, "run", "de", 1, f"T{i}") for i in range(17)]
    rows += [(4000, "one", "fr", 2, "Éa B"), (4001, "", "fr", 2, ""), (4002, None, "fr", 2, None), (4003, None, None, None, "A" * 300_000)]
    rows += [(5, "hot", "en", 5, "again"), (7, "hot", "en", 7, "Text 7 xx"), (7, "hot", "en", 7, "Text 7 xx"), (None, "hot", "en", 0, "No key")]
    rows += [(5000 + i, f"s{i}é", "it", 1, "Z") for i in range(40)]  # more groups than a parent has children
    r.shuffle(rows)
    return rows


def test_manifest_is_that_of_plain_recursion(spark, frame, tmp_path):
    rows = manifest_rows()
    df = frame(rows, DDL).repartition(7).withColumn("ROOT", F.lit("clash")).withColumn("block", F.lit(1))
    df.write.parquet(f"{tmp_path}/documents.parquet")
    got = queries.op12_manifest(spark, str(tmp_path))
    assert Counter(map(tuple, got.collect())) == manifest_of(rows)


def test_a_path_proves_its_leaf_and_nothing_else(frame):
    df = frame(manifest_rows(), DDL).withColumn("place", F.lit("kept")).withColumn("leaf", F.lit("clash"))
    got = merkle.manifest(df, F.sha2(merkle.field("text"), 256), "doc_id", "source", path=True)
    assert "place" in got.columns and got.columns.count("leaf") == 1
    for row in random.Random(1).sample(got.collect(), 60):
        path = [(x["left"], x["right"]) for x in row.path]
        assert row.verified and row.folded_root == row.root and row.place == "kept"
        assert merkle.verified(row.leaf, path, row.root) and not merkle.verified(hashed("other"), path, row.root)
        assert hashed("".join(a + z for a, z in path)) == row.proof_sha256


def test_a_parent_resumes_the_state_before_a_slot():
    children = [hashed(str(i)) for i in range(16)]
    parent = merkle.Parent(children)
    assert parent.digest == hashed("".join(children)) and len(parent.before) == 16
    for slot in range(16):
        changed = [*children[:slot], hashed("new"), *children[slot + 1 :]]
        assert parent.folded(slot, hashed("new")) == hashed("".join(changed))
        assert parent.folded(slot, children[slot]) == parent.digest


def test_manifest_of_nothing_and_of_one_row(frame):
    leaf = F.sha2(merkle.field("text"), 256)
    none = merkle.manifest(frame([], DDL), leaf, "doc_id", "source", path=True)
    assert none.collect() == [] and none.columns[-1] == "path"
    (one,) = merkle.manifest(frame([(1, None, None, None, None)], DDL), leaf, "doc_id", "source").collect()
    assert one.root == one.subroot == one.leaf == hashed("-") and one.proof_sha256 == hashed("") and one.verified


# --- 13: vector codes --------------------------------------------------------------------


def codes_of(vectors, entries=256, rounds=4, parts=4, scale=1024):
    """Codes, errors and codebooks of (key, vector) rows in order of the key, with Python's integers alone."""
    from math import floor

    width = -(-max((len(v) for _, v in vectors), default=0) // parts)
    whole = [[floor(scale * x) for x in v] + [0] * (parts * width - len(v)) for _, v in vectors]
    cut = [[v[p * width : (p + 1) * width] for v in whole] for p in range(parts)]
    books = [[list(x) for x in part[:entries]] for part in cut]

    def nearest(x, book):
        return min((sum((a - b) ** 2 for a, b in zip(x, entry, strict=True)), i) for i, entry in enumerate(book))

    for _ in range(rounds):
        for p in range(parts):
            groups = defaultdict(list)
            for x in cut[p]:
                groups[nearest(x, books[p])[1]].append(x)
            for i, xs in groups.items():
                books[p][i] = [sum(c) // len(xs) for c in zip(*xs, strict=True)]
    found = [[nearest(x, books[p]) for x in cut[p]] for p in range(parts)]
    coded = ["".join(f"{found[p][i][1]:02x}" for p in range(parts)) for i in range(len(vectors))]
    errors = [min(2**63 - 1, sum(found[p][i][0] for p in range(parts))) for i in range(len(vectors))]
    return coded, errors, books


def checked(frame, vectors, **options):
    vectors = [(k, [float(np.float32(x)) for x in v]) for k, v in vectors]
    got, books = codes.compressed(frame(vectors, "vec_id long, embedding array<float>").repartition(3), **options)
    rows = sorted(vectors, key=lambda r: (r[0] is None, r[0] or 0, r[1]))
    coded, errors, wanted = codes_of(rows, **options)
    assert Counter(map(tuple, got.select("vec_id", "code", "error").collect())) == Counter(zip([r[0] for r in rows], coded, errors, strict=True))
    assert books.text() == ",".join(str(x) for part in wanted for entry in part for x in entry)
    return books


def points(n, size, seed, spread=1.0):
    r = np.random.default_rng(seed)
    centres = r.normal(size=(6, size)) * 2
    return [(int(i), [float(np.float32(x)) for x in centres[i % 6] + spread * r.normal(size=size)]) for i in range(n)]


def test_codes_are_those_of_plain_rounds(frame):
    books = checked(frame, points(150, 8, 1), entries=40)
    assert len(books.entries[0]) == 40 and len(books.vector("00010203")) == 8


def test_codes_of_ties_copies_short_vectors_and_large_numbers(frame):
    same = [(i, [1.0, 2.0, 3.0, 4.0]) for i in range(30)]
    checked(frame, same + [(40, [0.5, 2.0, -3.0, 4.0]), (40, [0.5, 2.0, -3.0, 4.0]), (None, [9.0, 9.0, 9.0, 9.0])])
    checked(frame, [(1, [0.25, -0.25, 1.0]), (2, []), (3, [0.5] * 6), (4, [1.0, 2.0, 3.0, 4.0, 5.0])], entries=3)
    checked(frame, [(1, [1e12, 1.0, -3e11, 4.0]), (2, [5.0, 1e24, 0.0, -0.0]), (3, [5.0, 1.0, 2.0, 1e-30])], entries=2)


def test_rows_that_take_no_part_and_clashing_names(frame):
    nan, inf = float("nan"), float("inf")
    rows = [(1, [1.0, 2.0, 3.0, 4.0]), (2, None), (3, [1.0, None, 3.0, 4.0]), (4, [nan, 1.0, 1.0, 1.0]), (5, [inf, 1.0, 1.0, 1.0]), (6, [0.0] * 4)]
    df = frame(rows, "vec_id long, embedding array<float>").withColumn("Code", F.lit("clash")).withColumn("bounds", F.lit("kept"))
    got, _ = codes.compressed(df)
    assert sorted((r.vec_id, r.code, r.error, r.bounds) for r in got.collect()) == [(1, "00000000", 0, "kept"), (6, "01010101", 0, "kept")]
    none, books = codes.compressed(df.filter("vec_id > 1 and vec_id < 6"))
    assert none.collect() == [] and books.text() == ""


def test_label_errors_count_nulls_together(frame):
    rows = [(1, 7), (2, 7), (3, None), (4, None), (5, 1)]
    df = frame(rows, "vec_id long, label int").withColumn("error", F.col("vec_id"))
    got = codes.with_label_errors(df, "label")
    assert {r.vec_id: r.label_error for r in got.collect()} == {1: 3, 2: 3, 3: 7, 4: 7, 5: 5}


def test_bounds_leave_less_to_measure_in_every_round_and_change_nothing():
    x = np.floor(np.array([v for _, v in points(1500, 12, 3, 0.4)]) * 1024)
    history, bounds, shares = [x[:256].copy()], None, []
    for _ in range(6):
        bounds, measured = codes.assigned(x, history, bounds)
        assert (bounds.code == codes.squares(x, history[-1]).argmin(axis=1)).all()
        shares.append(measured / (len(x) * 8))
        now = history[-1].copy()
        for i in range(256):
            if (bounds.code == i).any():
                now[i] = np.floor(x[bounds.code == i].mean(axis=0))
        history.append(now)
    assert shares[0] == 1 and shares == sorted(shares, reverse=True) and shares[-1] < 0.5


def test_net_moves_are_used_and_not_the_sum_of_moves():
    far = np.array([[0.0], [1000.0]])
    entries = np.array([[0.0]] * 32 + [[1000.0]] * 32)
    history = [entries, entries + 400.0, entries]  # there and back again: the net move is none
    bounds, _ = codes.assigned(far, history[:1])
    _, measured = codes.assigned(far, history, bounds)
    assert measured == 2  # each row's own group, for its ties; drifts added up would have opened both


# --- 11: quality -------------------------------------------------------------------------


def texts_of(n=420, seed=2):
    r = random.Random(seed)
    words = ["".join(r.choice("abdeilmnorst") for _ in range(r.randint(2, 8))) for _ in range(500)]
    rows, labels = [], []
    for i in range(n):
        own = [r.choice(words) for _ in range(r.randint(30, 90))]
        bad = i % 5 == 0
        if bad and i % 2:
            own = [w + r.choice(["###", "%%%"]) for w in own]
        elif bad:
            own = [own[0]] * 30 + [own[1]] * 30
        rows.append((i, " ".join(own).capitalize() + "."))
        if r.random() < 0.7:
            labels.append((i, int(not bad)))
    return rows, labels


def test_quality_of_held_out_rows(frame):
    rows, labels = texts_of()
    df = frame(rows + [(None, rows[0][1]), (900, None), (901, ""), (902, "x"), (3, rows[3][1]), (903, "Go on. " * 300_000)], "doc_id long, text string")
    df = df.withColumn("SCORE", F.lit("clash")).withColumn("key", F.lit("kept")).repartition(3)
    got = quality.quality(df, frame(labels, "doc_id long, quality int")).collect()
    assert len(got) == len(rows) + 6 and all(r.key == "kept" and 0 <= r.score <= 1 for r in got)
    assert all(r.held_out == (r.doc_id is not None and zlib.crc32(str(r.doc_id).encode()) % 5 == 0) for r in got)
    assert all(r.predicted == int(r.score >= 0.3) for r in got)
    out = [(r.doc_id % 5 == 0, r.score) for r in got if r.held_out and r.doc_id is not None and r.doc_id < 420]
    assert np.mean([s < 0.3 for bad, s in out if bad]) > 0.9 and np.mean([s >= 0.3 for bad, s in out if not bad]) > 0.97
    by_id = {r.doc_id: r.score for r in got}
    assert by_id[900] == by_id[901] > 0.5 and len({r.score for r in got if r.doc_id == 3}) == 1


def test_votes_are_those_of_all_pairs():
    r = np.random.default_rng(5)
    at, known = r.normal(size=(40, 6)), r.normal(size=(90, 6))
    known[10:20] = known[10]  # ties
    at, known = (x / np.linalg.norm(x, axis=1, keepdims=True) for x in (at, known))
    labels = (r.random(90) < 0.7).astype(float)
    got = quality.votes(at @ known.T, labels, 0.7, 9)
    for i in range(40):
        near = sorted(((round(float(max(0, at[i] @ known[j])), 5), labels[j]) for j in range(90)), reverse=True)
        near = [x for x in near if x[0] >= near[8][0]]
        wanted = (sum(s * y for s, y in near) + quality.PRIOR * 0.7) / (sum(s for s, _ in near) + quality.PRIOR)
        assert got[i] == pytest.approx(wanted, abs=1e-9)


def test_counts_do_not_depend_on_how_texts_are_put_together(monkeypatch):
    r = random.Random(8)
    texts = ["".join(r.choice("ab é#\n") for _ in range(r.choice([0, 1, 2, 50, 900]))) for _ in range(60)]
    whole = [row for block in quality.counts(texts) for row in np.column_stack([block.often, block.shape])]
    alone = [row for t in texts for block in quality.counts([t]) for row in np.column_stack([block.often, block.shape])]
    assert np.allclose(whole, alone)
    monkeypatch.setattr(quality, "PIECE", 128)
    pieces = [block.often[0] for t in texts for block in quality.counts([t])]
    assert all((p == w[: quality.TERMS]).all() for p, w in zip(pieces, whole, strict=True))


def test_quality_without_labels_of_both_kinds(frame):
    rows, labels = texts_of(40)
    df, ddl = frame(rows, "doc_id long, text string"), "doc_id long, quality int"
    assert {r.score for r in quality.quality(df, frame([], ddl)).collect()} == {0.5}
    assert all(r.score > 0.9 for r in quality.quality(df, frame([(k, 1) for k, _ in labels], ddl)).collect())
    assert quality.quality(df.filter("false"), frame(labels, ddl)).collect() == []
