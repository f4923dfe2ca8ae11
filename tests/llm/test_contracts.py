"""The registered corpus queries without SQL, over the given tables, against brute force.

The pipeline is held stage by stage to what its stage was given.
"""

import math
import os
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from plumbline.llm.queries import QUERIES, tokenizer_path
from tests.llm.test_operators import contained_by_force, near_copies_by_force, targets_by_force, words

SF_DIR = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")

pytestmark = pytest.mark.skipif(not os.path.isdir(SF_DIR), reason="no test tables here")


def rows_of(spark, name, *columns):
    return [tuple(r) for r in spark.read.parquet(f"{SF_DIR}/{name}.parquet").select(*columns).collect()]


@pytest.fixture(scope="module")
def documents(spark):
    return rows_of(spark, "documents", "doc_id", "text", "source")


def near(taken, target, copies):
    """Two hundredths at most, or no document with words, moved by one copy, would come nearer.

    ``copies`` holds (size, copies) of the source's documents.
    """
    movable = [n for n, c in copies if n and (c < 3 if taken < target else c > 0)]
    return abs(taken - target) <= max(0.02 * target, min(movable, default=math.inf) / 2)


def test_toxicity_of_every_document(spark, documents):
    scores = {r.doc_id: r for r in QUERIES["op2_toxicity"](spark, SF_DIR).collect()}
    assert sorted(scores) == sorted(d for d, _, _ in documents)
    for r in scores.values():
        assert r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 4 == 2)
        assert 0 <= r.score <= 1 and r.predicted == int(r.score >= 0.3)
    toxic = dict(rows_of(spark, "labels", "doc_id", "toxic"))
    told = [(toxic[k], r.predicted) for k, r in scores.items() if r.held_out and toxic.get(k) is not None]
    assert sum(a == b for a, b in told) >= 0.9 * len(told)


def test_neighbours_of_every_hundredth_vector(spark):
    given = rows_of(spark, "embeddings", "vec_id", "embedding")
    part = [(k, np.array(v, float)) for k, v in given if v is not None and None not in v and np.isfinite(v).all() and np.any(v)]
    found = defaultdict(list)
    for r in QUERIES["op4_neighbours"](spark, SF_DIR).orderBy("query_id", "rank").collect():
        found[r.query_id].append(r)
    asked = [(k, v) for k, v in part if k % 100 == 0]
    assert set(found) == {k for k, _ in asked} and len(part) > 10
    vectors, hits = dict(part), 0
    for query, v in asked:
        got = found[query]
        assert [r["rank"] for r in got] == list(range(1, 11)) and query not in {r.vec_id for r in got}
        assert [(r.score, r.vec_id) for r in got] == sorted((r.score, r.vec_id) for r in got)
        for r in got:
            assert r.score == pytest.approx(math.dist(v, vectors[r.vec_id]), rel=1e-12)
        best = sorted((math.dist(v, w), k) for k, w in part if k != query)[:10]
        hits += len({k for _, k in best} & {r.vec_id for r in got})
    assert hits >= 9 * len(asked)


def test_the_mix_of_all_documents(spark, documents):
    got = QUERIES["op8_mix"](spark, SF_DIR).collect()
    source, size = {k: s for k, _, s in documents}, {k: len(words(t)) for k, t, _ in documents}
    assert Counter(r.doc_id for r in got) == Counter(k for k, _, _ in documents)
    total, taken = Counter(), Counter()
    for k, _, s in documents:
        total[s] += size[k]
    wanted = targets_by_force(dict(total))
    for r in got:
        s = source[r.doc_id]
        assert (r.size, r.source_size) == (size[r.doc_id], total[s]) and r.target == pytest.approx(wanted[s])
        assert 0 <= r.taken <= 3 * r.size and (r.taken == 0 or r.taken % r.size == 0)
        taken[s] += r.taken
    for s in total:
        copies = [(r.size, r.taken // r.size if r.size else 0) for r in got if source[r.doc_id] == s]
        assert near(taken[s], wanted[s], copies), s
    again = QUERIES["op8_mix"](spark, SF_DIR)
    assert {(r.doc_id, r.taken) for r in again.collect()} == {(r.doc_id, r.taken) for r in got}


def test_tokens_of_every_document(spark, documents):
    from tokenizers import Tokenizer

    library = Tokenizer.from_file(str(tokenizer_path()))
    library.no_truncation()
    library.no_padding()
    got = {r.doc_id: r for r in QUERIES["op10_token_counts"](spark, SF_DIR).collect()}
    assert sorted(got) == sorted(k for k, _, _ in documents)
    for k, text, _ in documents:
        n = len(library.encode(text or "", add_special_tokens=False).ids)
        assert (got[k].n_bytes, got[k].n_tokens, got[k].over_limit) == (len((text or "").encode()), n, n > 512)


def test_the_pipeline_stage_by_stage(spark, documents):
    import corpus_pipeline as P
    from plumbline.llm.common import written

    items = rows_of(spark, "benchmark", "item_id", "text")
    given = spark.read.parquet(f"{SF_DIR}/documents.parquet")
    kept = {}
    docs = given
    for name, stage in P.STAGES:
        docs = written(stage(spark, docs, SF_DIR))
        assert name == "sharding" or docs.columns == given.columns
        kept[name] = [tuple(r) for r in docs.select("doc_id", "text", "source").collect()]

    def ids(name):
        return Counter(k for k, _, _ in kept[name])

    clean = {r.doc_id for r in QUERIES["op2_toxicity"](spark, SF_DIR).where("predicted = 0").collect()}
    assert ids("toxicity") == Counter(clean)
    # a component's smallest id stays; texts without words are components of their own
    groups = near_copies_by_force(kept["toxicity"], P.WIDTH, P.PERCENT)
    assert ids("near_copies") == Counter({low for _, _, low in groups})
    dirty = {k for k, *_ in contained_by_force(kept["near_copies"], items)}
    assert ids("decontamination") == Counter(k for k, _, _ in kept["near_copies"] if k not in dirty)

    total, taken, mix = Counter(), Counter(), ids("mixing")
    for k, t, s in kept["decontamination"]:
        total[s] += len(words(t))
        taken[s] += mix[k] * len(words(t))
    assert set(mix) <= set(ids("decontamination")) and max(mix.values()) <= 3
    for s, n in targets_by_force(dict(total)).items():
        assert near(taken[s], n, [(len(words(t)), mix[k]) for k, t, x in kept["decontamination"] if x == s]), s

    assert ids("sharding") == mix
    rows = docs.select("shard", "slot", "size", F.octet_length("text").alias("bytes")).collect()
    slots, load = defaultdict(list), Counter({k: 0 for k in range(P.SHARDS)})
    for r in rows:
        assert r.size == (r.bytes or 0) + 16
        slots[r.shard].append(r.slot)
        load[r.shard] += r.size
    assert all(sorted(s) == list(range(len(s))) for s in slots.values()) and set(load) == set(range(P.SHARDS))
    largest = max(r.size for r in rows)
    assert all(abs(n - sum(load.values()) / P.SHARDS) <= largest for n in load.values())
