import math
import random
import re
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from routelab.llm import oracles, queries, ranked_search

WORD = re.compile(ranked_search.TERM)
LOW = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def words(text):
    return WORD.findall((text or "").translate(LOW))


def brute(docs, items, k=20):
    """(item, rank, doc_id, score) by scoring every document for every item."""
    bags = [(i, Counter(words(t))) for i, t in docs]
    bags = [(i, b) for i, b in bags if b]
    big_n, big_l = len(bags), sum(sum(b.values()) for _, b in bags)
    df = Counter(t for _, b in bags for t in b)
    rows = []
    for item in dict.fromkeys(i for i, _ in items):
        asked = Counter(t for i, text in dict.fromkeys(items) if i == item for t in words(text))
        scored = []
        for i, b in bags:
            m = 75 + 25 * sum(b.values()) * big_n // big_l
            score = sum(times * math.floor(1000 * math.log((2 * big_n + 2) / (2 * df[t] + 1))) * (10**9 * b[t] // (1000 * b[t] + 12 * m)) for t, times in asked.items() if t in b)
            if score > 0:
                scored.append((-score, i is None, i or 0, i))
        rows += [(item, n + 1, i, -s) for n, (s, _, _, i) in enumerate(sorted(scored, key=lambda x: x[:3])[:k])]
    return sorted(map(repr, rows))


def got(df):
    return sorted(repr((r["item_id"], r["rank"], r["doc_id"], r["score"])) for r in df.collect())


@pytest.fixture
def made(spark):
    def make(docs, items):
        return spark.createDataFrame(docs, "doc_id bigint, text string"), spark.createDataFrame(items, "item_id bigint, text string")

    return make


def test_query_is_its_oracle(compare):
    compare(queries.op12_ranked_search, oracles.RANKED)


def test_query_is_brute_force(spark, docs):
    items = [tuple(r) for r in spark.read.parquet("/root/testdata/sf0.001/benchmark.parquet").select("item_id", "text").collect()]
    assert got(queries.op12_ranked_search(spark, "/root/testdata/sf0.001")) == brute([(r["doc_id"], r["text"]) for r in docs.collect()], items)


def test_many_shards_ties_and_copies(made, monkeypatch):
    rng = random.Random(4)
    vocabulary = [f"w{k}" for k in range(40)] + ["é三", "A", "a"]
    docs = [(k, " ".join(rng.choices(vocabulary, k=rng.randint(0, 12)))) for k in range(300)]
    docs += [(k, "w1 w2 w3 w3") for k in range(1000, 1200)] + [(7, "w1 w2"), (7, "w1 w2"), (None, "w1 w2 w3 w3"), (None, None), (2**60 + 1, "w5 w5"), (2**60, "w5 w5")]
    rng.shuffle(docs)
    items = [(k, " ".join(rng.choices(vocabulary, k=rng.randint(1, 9)))) for k in range(12)] + [(20, "w1 W2, w3"), (None, "w5"), (21, ""), (22, None), (23, "nowhere"), (0, "w9"), (20, "w1 W2, w3")]
    d, i = made(docs, items)
    monkeypatch.setattr(ranked_search, "BLOCK_ITEMS", 5)
    for size, few in ((400, 100_000), (1 << 24, 0)):
        monkeypatch.setattr(ranked_search, "BROADCAST_TERMS", few)
        index = ranked_search.build_index(d.repartition(3), shard_bytes=size)
        assert index.table.filter("term IS NULL").agg(F.sum("n")).first()[0] == index.documents == sum(bool(words(t)) for _, t in docs)
        assert got(ranked_search.search(index, i)) == brute(docs, items)
        assert got(ranked_search.search(index, i, k=3)) == brute(docs, items, 3)


def test_odd_rows(odd, spark):
    items = spark.createDataFrame([(1, "word the row"), (2, "三😀 no"), (3, "a" * 20_000)], "item_id bigint, text string")
    rows = [(r["doc_id"], r["text"]) for r in odd.collect()]
    assert got(ranked_search.ranked_search(odd, items)) == brute(rows, [tuple(r) for r in items.collect()])
    assert ranked_search.ranked_search(odd.limit(0), items).count() == 0
    assert ranked_search.ranked_search(odd, items.limit(0)).count() == 0


def _trees(rng, n_docs, n_terms):
    postings = [sorted(rng.sample(range(n_docs), rng.randint(1, n_docs // 2))) for _ in range(n_terms)]
    blobs = []
    for docs in postings:
        docs, impacts = np.array(docs, np.int32), np.array([rng.choice([5, rng.randint(1, 1000)]) for _ in docs], np.int32)
        blobs.append((docs, impacts, *ranked_search.treap(docs, impacts, np.zeros(1, np.int64))))
    return blobs


def test_treaps_have_both_orders():
    for docs, impacts, before, behind in _trees(random.Random(5), 400, 30):
        children = np.concatenate([before[before >= 0], behind[behind >= 0]])
        assert sorted(children) == sorted(set(children)) and len(children) == len(docs) - 1
        for k in range(len(docs)):
            assert before[k] < k and (behind[k] < 0 or behind[k] > k)
            assert all(impacts[c] <= impacts[k] for c in (before[k], behind[k]) if c >= 0)


def test_search_prunes_and_splits():
    rng = random.Random(6)
    blobs = _trees(rng, 3000, 25)
    trees = ranked_search.Trees(*([x.tobytes() for x in side] for side in zip(*blobs)), 3000)
    item = np.repeat(np.arange(8), 6)
    term = np.concatenate([rng.sample(range(25), 6) for _ in range(8)])
    weight = np.array([rng.randint(1, 900) for _ in item])
    for slots in (400_000, 50):
        found = trees.search(item, term, weight, 20, slots)
        for i in range(8):
            scores = np.zeros(3000, np.int64)
            for t, w in zip(term[item == i], weight[item == i]):
                scores[blobs[t][0]] += w * blobs[t][1].astype(np.int64)
            want = sorted(((-s, d) for d, s in enumerate(scores.tolist()) if s))[:20]
            assert [(-s, d) for d, s in zip(found[1][found[0] == i].tolist(), found[2][found[0] == i].tolist())] == want
    postings = sum(len(blobs[t][0]) for t in term)
    assert trees.pruned > 0 and trees.visited < 2 * postings  # both searches together; one without pruning looks at every posting more than once


def test_a_thousand_copies_make_no_chain():
    docs, impacts = np.arange(20_000, dtype=np.int32), np.full(20_000, 7, np.int32)
    before, behind = ranked_search.treap(docs, impacts, np.zeros(1, np.int64))
    depth = {int(k): 0 for k in range(20_000) if k not in set(before) | set(behind)}
    line = list(depth)
    while line:
        k = line.pop()
        for c in (int(before[k]), int(behind[k])):
            if c >= 0:
                depth[c] = depth[k] + 1
                line.append(c)
    assert len(depth) == 20_000 and max(depth.values()) < 80
