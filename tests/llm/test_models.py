"""Token counts against the library, toxicity on held-out rows, the pipeline against its parts."""

import random
import time
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from plumbline.llm import queries, tokencount, toxicity
from plumbline.llm.common import written

tokenizers = pytest.importorskip("tokenizers")
pytest.importorskip("public_tokenizers")
DDL = "doc_id long, text string, source string"
PIECES = [
    "'", "s", "'ll", "'r", " ", "  ", "\n", "\t", "a", "Zebra", "é", "中文", "²", "37", "٣", "_", "--", "<|endoftext|>", "<|endo",
    "\x85", "\xa0", "​", "\x1c", "😀", "ß", "the", " of", "...", "　", "́", "\0", "ÃÂÃÂ", "aaaaaaa", "qzx",
]


@pytest.fixture(scope="module")
def library():
    return tokenizers.Tokenizer.from_file(queries.tokenizer_path())


def count(library, text):
    return len(library.encode(text, add_special_tokens=False).ids)


def test_every_prefix_has_the_count_of_the_library(library):
    counter = tokencount.counter(queries.tokenizer_path())
    r = random.Random(6)
    for _ in range(400):
        text = "".join(r.choice(PIECES) for _ in range(r.randint(0, 12)))
        table = counter.text(text)
        counts = [count(library, text[:k]) for k in range(len(text) + 1)]
        assert [table.at(k) for k in range(len(text) + 1)] == counts, text
        for budget in range(6):
            assert table.longest(budget) == max(k for k, n in enumerate(counts) if n <= budget), (text, budget)


def test_token_counts_of_a_table(spark, frame, library):
    long = "".join(random.Random(1).choice(PIECES) for _ in range(4000))
    rows = [(1, None, "a"), (2, "", "a"), (3, "héllo wörld", "b"), (3, "héllo wörld", "b"), (None, "x" * 3000, None), (4, long, "c"), (5, "a<|endoftext|>b", "c")]
    df = frame(rows, DDL).withColumn("n_tokens", F.lit("clash"))
    got = tokencount.token_counts(df, queries.tokenizer_path()).collect()
    assert Counter((r.doc_id, r.n_bytes, r.n_tokens) for r in got) == Counter((k, len((t or "").encode()), count(library, t or "")) for k, t, _ in rows)
    cut = {r.doc_id: r.budget_bytes for r in got}
    kept = long.encode()[: cut[4]].decode()
    assert count(library, kept) <= 512 < count(library, long) and cut[3] == 13
    assert all(count(library, long[:k]) > 512 for k in range(len(kept) + 1, len(kept) + 200))
    assert tokencount.token_counts(df.filter("false"), queries.tokenizer_path()).collect() == []


def test_a_very_long_piece_takes_time_by_its_length(library):
    counter = tokencount.counter(queries.tokenizer_path())
    long = "abcdefghij" * 30_000
    began = time.perf_counter()
    n = counter.count(long)
    assert time.perf_counter() - began < 20
    assert n == count(library, long)


def test_pieces_met_often_are_encoded_once(spark, library, monkeypatch):
    monkeypatch.setattr(tokencount, "KEPT_PIECES", 100)
    counter = tokencount.PrefixCounter(queries.tokenizer_path())
    encoded, prefixes = Counter(), counter._prefixes

    def counted(piece):
        encoded[piece] += 1
        return prefixes(piece)

    monkeypatch.setattr(counter, "_prefixes", counted)
    r = random.Random(4)
    for _ in range(300):
        text = "often " + "".join(r.choice("abcdefgh") for _ in range(8))
        assert counter.text(text).total == count(library, text)
    assert encoded["often"] == 1 and len(counter.totals) + len(counter.older) <= 100


def test_many_texts_are_counted_like_each_alone(library):
    counter = tokencount.PrefixCounter(queries.tokenizer_path())
    r = random.Random(8)
    texts = ["".join(r.choice(PIECES) for _ in range(r.randint(0, 30))) for _ in range(300)]
    for some in (texts[:200], texts[100:], []):
        tables = list(counter.texts(some))
        assert [t.total for t in tables] == [count(library, text) for text in some]
        assert [t.longest(4) for t in tables] == [counter.text(text).longest(4) for text in some]


def test_lookups_follow_the_model():
    found = [toxicity._lookup(m, n) for m, n in ((b"a", {b"x\x001": 0}), (b"b", {b"y\x001": 0}), (b"b", {b"y\x001": 0}))]
    assert found[1] is found[2] and found[0] is not found[1]


# --- toxicity ------------------------------------------------------------------------------

VOCABULARY = ["".join(random.Random(i).choice("klmnoprstuv") for _ in range(4)) for i in range(500)]
SLURS = ["grubb", "snark", "twerp", "dolt"]


def toxic_corpus(n=900, seed=3):
    r = random.Random(seed)
    rows, labels = [], []
    for i in range(n):
        own = [r.choice(VOCABULARY) for _ in range(r.randint(20, 80))]
        toxic = i % 6 == 0
        if toxic:
            for _ in range(r.randint(2, 5)):
                own.insert(r.randrange(len(own)), r.choice(SLURS) + r.choice(["", "", "ish", "ed"]))
        rows.append((i, " ".join(own).capitalize() + ".", f"s{i % 3}"))
        if r.random() < 0.6:
            labels.append((i, int(toxic)))
    return rows, labels


def test_held_out_rows_are_told_apart(spark, frame):
    rows, labels = toxic_corpus()
    df = frame(rows, DDL).withColumn("score", F.lit("clash")).repartition(3)
    got = toxicity.toxicity(df, frame(labels, "doc_id long, toxic int"))
    assert got.columns == ["doc_id", "text", "source", "score", "held_out", "predicted"]
    told = {r.doc_id: r for r in got.collect()}
    assert len(told) == len(rows) and all(0 <= r.score <= 1 for r in told.values())
    held = [r for r in told.values() if r.held_out]
    assert 0.15 < len(held) / len(rows) < 0.35
    assert sum(r.predicted == (r.doc_id % 6 == 0) for r in held) / len(held) > 0.97


def test_labels_of_held_out_rows_are_not_learned_from(spark, frame):
    rows, labels = toxic_corpus(400)
    df = frame(rows, DDL)
    out = {r.doc_id for r in df.where(toxicity.held_out("doc_id")).select("doc_id").collect()}
    known = frame(labels, "doc_id long, toxic int")
    turned = frame([(k, 1 - y if k in out else y) for k, y in labels], "doc_id long, toxic int")
    scores = [sorted((r.doc_id, r.score) for r in toxicity.toxicity(df, x).collect()) for x in (known, turned)]
    assert scores[0] == scores[1]


def test_odd_texts_and_no_labels(spark, frame):
    rows, labels = toxic_corpus(300)
    odd = [(1000, None, None), (1001, "", None), (None, "dolt twerp", None), (1002, "w " * 50_000 + "dolt", "s"), (1, rows[1][1], "s1")]
    df, known = frame(rows + odd, DDL), frame([*labels, (6, None), (None, 1), (labels[0][0], labels[0][1])], "doc_id long, toxic int")
    got = toxicity.toxicity(df, known).collect()
    assert len(got) == len(rows) + len(odd) and all(0 <= r.score <= 1 for r in got)
    empty = {r.score for r in got if r.doc_id in (1000, 1001)}
    assert len(empty) == 1 and [r.held_out for r in got if r.doc_id is None] == [False]
    for y, want in ((None, 0.5), (0, 0.001), (1, 0.999)):
        some = known.filter("false") if y is None else known.filter(f"toxic = {y}")
        assert {round(r.score, 6) for r in toxicity.toxicity(df, some).collect()} == {want}
    assert toxicity.toxicity(df.filter("false"), known).collect() == []


def test_the_label_model_finds_accuracies_and_correlations():
    r = np.random.default_rng(5)
    y = r.random(20_000) < 0.2
    good, noisy = np.where(y, r.random(20_000) < 0.8, r.random(20_000) < 0.02), np.where(y, r.random(20_000) < 0.4, r.random(20_000) < 0.15)
    echo = np.where(r.random(20_000) < 0.95, noisy, ~noisy)  # says what the noisy one says
    third = np.where(y, r.random(20_000) < 0.6, r.random(20_000) < 0.05)
    votes = np.stack([good, noisy, echo, third], axis=1).astype(int)
    patterns, place, counts = np.unique(votes, axis=0, return_inverse=True, return_counts=True)
    labelled = np.zeros((len(patterns), 2))
    np.add.at(labelled, (place[:600], y[:600].astype(int)), 1)
    model = toxicity.fitted(patterns, counts, labelled)
    assert model.parents[2] == 1 or model.parents[1] == 2
    told = dict(enumerate(model.accuracies(patterns, counts)))
    for j, want in enumerate([(v[y].sum() / v.sum()) for v in (good, noisy, echo, third)]):
        assert told[j] == pytest.approx(want, abs=0.08)
    assert model.prior == pytest.approx(0.2, abs=0.04)


# --- pipeline ------------------------------------------------------------------------------


def test_stages_keep_the_columns_and_make_their_decisions(spark, tmp_path):
    import corpus_pipeline as P

    rows, labels = toxic_corpus(700)
    long = [w for _, t, _ in rows[1:4] for w in t.split()]
    item = " ".join(long[:30])
    rows = [(k, t, s) for k, t, s in rows]
    rows += [(1500, rows[1][1], "s1"), (1501, rows[1][1], "s2"), (1502, item + " " + rows[5][1], "s0"), (1503, None, None), (1504, "", "s1"), (7, rows[7][1], "s1")]
    path = str(tmp_path)
    columns = f"{DDL}, n_chars long, size int, tokens string, _text string"
    spark.createDataFrame([(*r, 1, 2, "x", None) for r in rows], columns).write.parquet(f"{path}/documents.parquet")
    spark.createDataFrame(labels, "doc_id long, toxic int").write.parquet(f"{path}/labels.parquet")
    spark.createDataFrame([(1, item)], "item_id long, text string").write.parquet(f"{path}/benchmark.parquet")
    docs = spark.read.parquet(f"{path}/documents.parquet")
    assert [n for n, _ in P.STAGES] == ["toxicity", "near_copies", "decontamination", "mixing", "sharding"]
    kept = []
    for name, stage in P.STAGES:
        docs = written(stage(spark, docs, path))
        if name != "sharding":
            assert docs.columns == ["doc_id", "text", "source", "n_chars", "size", "tokens", "_text"]
        kept.append(Counter(r.doc_id for r in docs.select("doc_id").collect()))
    clean, single, tested, mix, sharded = kept
    assert sum(k % 6 == 0 for k in clean if k < 700) <= 12 and sum(k % 6 != 0 for k in clean if k < 700) >= 575
    assert clean[1] and clean[1500] and single[1] == 1 and not single[1500] and not single[1501] and single[7] == 1
    assert single[1503] == single[1504] == 1 and single[1502] and not tested[1502] and set(tested) == set(single) - {1502, 1}
    assert set(mix) <= set(tested) and max(mix.values()) <= 3 and sharded == mix
    assert {"shard", "slot", "size"} <= set(docs.columns) and docs.agg(F.max("shard")).first()[0] <= 39
    again = P.run(spark, path)
    assert Counter(tuple(r) for r in again.select("doc_id", "shard", "slot").collect()) == Counter(tuple(r) for r in docs.select("doc_id", "shard", "slot").collect())
