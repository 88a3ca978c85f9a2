"""The Jaccard join, its parts and the pipeline."""

import base64
import hashlib
import random
import re

import numpy as np
import public_tokenizers as P
import pytest
import tiktoken
from pyspark.sql import functions as F
from test_cleaning import Plain, brute_leaks

from routelab.llm import jaccard_join, queries
from routelab.llm.components import connected_components
from routelab.llm.rtree import Forest, Tree, counts, folded, groups_of, packed, point, point_links, set_links, unpacked
from routelab.llm.shingles import shingle_sets

LOWER = str.maketrans({chr(c): chr(c + 32) for c in range(65, 91)})


def shingles(text, width=4):
    words = re.findall(r"[^\x20\x09-\x0D]+", (text or "").translate(LOWER))
    if not words:
        return frozenset()
    return frozenset(tuple(words[k : k + width]) for k in range(max(1, len(words) - width + 1)))


def brute(rows, width=4, percent=85):
    """rows (id, text): sizes and the least id reachable of each id."""
    sets = [(i, shingles(t, width)) for i, t in rows if i is not None]
    forest = Forest([i for i, _ in sets])
    where = {}
    for k, (i, own) in enumerate(sets):
        met = {}
        for s in own:
            for j in where.setdefault(s, []):
                met[j] = met.get(j, 0) + 1
            where[s].append(k)
        for j, n in met.items():
            if 100 * n >= percent * (len(own) + len(sets[j][1]) - n):
                forest.join(i, sets[j][0])
    return {i: forest.find(i) for i, _ in sets}


def check(df, rows, width=4, percent=85):
    got = jaccard_join.jaccard_classes(df, width, percent).collect()
    assert len(got) == len(rows)
    want = brute(rows, width, percent)
    for r in got:
        assert r["component_id"] == (want[r["doc_id"]] if r["doc_id"] is not None else None)
    assert sorted(r["n_shingles"] for r in got) == sorted(len(shingles(t, width)) for _, t in rows)


def test_sets_match_strings():
    rng = random.Random(2)
    words = ["a", "b", "cc", "D", "d", "é", "É", "x1", "zz", "The", "\x1c", "三"]
    texts = [rng.choice(["", " ", "\n"]) + rng.choice([" ", "\t", "\r\n "]).join(rng.choice(words) for _ in range(rng.randint(0, 12))) for _ in range(1500)] + [None]
    seen = {}
    for own, want in zip(shingle_sets(texts), map(shingles, texts)):
        assert len(own) == len(want) and seen.setdefault(own.tobytes(), want) == want


def test_tree_bound_loses_nothing():
    rng = np.random.default_rng(0)
    sets = [np.unique(rng.integers(0, 2**63, rng.integers(1, 90), dtype=np.uint64)) for _ in range(300)]
    for k in range(0, 300, 3):
        keep = sets[k][rng.random(len(sets[k])) < 0.93]
        sets[k + 1] = np.unique(np.concatenate([keep, rng.integers(0, 2**63, 2, dtype=np.uint64)]))
    points = counts(sets)
    tree = Tree(points)
    place = np.argsort(tree.order)
    plain = [set(s.tolist()) for s in sets]
    for a in range(300):
        found = set(tree.search(points[a], len(sets[a]), 85, 185)[0].tolist())
        for b in range(300):
            n = len(plain[a] & plain[b])
            if 100 * n >= 85 * (len(sets[a]) + len(sets[b]) - n):
                assert place[b] in found


def near_copies(seed, n_base, n, edits, length):
    rng = random.Random(seed)
    base = [[rng.randrange(10**6) for _ in range(rng.randint(3, length))] for _ in range(n_base)]
    out = []
    for _ in range(n):
        w = list(rng.choice(base))
        for _ in range(rng.randint(0, edits)):
            w[rng.randrange(len(w))] = rng.randrange(10**6)
        out.append(" ".join(map(str, w)))
    return out


def test_links_span_the_classes():
    docs = near_copies(5, 12, 400, 6, 120)
    sets, ids = shingle_sets(docs), list(range(len(docs)))
    want = brute(list(zip(ids, docs)))
    forest = Forest(ids)
    for a, b in set_links(ids, sets, 85):
        forest.join(a, b)
    assert {i: forest.find(i) for i in ids} == want


@pytest.mark.parametrize("n, m", [(60, 50), (150, 120), (80, 0)])
def test_components(spark, n, m):
    rng = random.Random(n)
    edges = [(rng.randrange(n), rng.randrange(n)) for _ in range(m)] if m else [(k, k + 1) for k in range(n)]
    forest = Forest(list(range(n + 1)))
    for a, b in edges:
        forest.join(a, b)
    got = connected_components(spark.createDataFrame(edges, "u long, v long")).collect()
    assert {r["node"] for r in got} == {x for e in edges if e[0] != e[1] for x in e} and len(got) == len({r["node"] for r in got})
    assert all(forest.find(r["node"]) == r["component"] for r in got)


def test_query(spark, docs):
    rows = [(r["doc_id"], r["text"]) for r in docs.collect()]
    want = brute(rows)
    got = queries.op8_jaccard_join(spark, "/root/testdata/sf0.001").collect()
    assert {r["doc_id"]: r["component_id"] for r in got} == want
    assert {r["doc_id"]: r["n_shingles"] for r in got} == {i: len(shingles(t)) for i, t in rows}


def test_query_against_sql(compare):
    compare(queries.op8_jaccard_join, queries.ORACLE_SQL["op8_jaccard_join"], "/root/testdata/sf0.01")


def test_large_groups_of_chains(spark, monkeypatch):
    """Blocks far smaller than the groups: links across blocks must be found, also along chains of ever farther texts."""
    monkeypatch.setattr(jaccard_join, "BLOCK", 8)
    monkeypatch.setattr(jaccard_join, "QUERY_BLOCK", 16)
    texts = near_copies(9, 3, 150, 5, 60)
    words = [str(k) for k in range(100)]
    for k in range(60):
        words = [*words[2:], f"new{k}"]
        texts.append(" ".join(words))
    passage = " ".join(f"p{k}" for k in range(40))
    texts += [passage + " " + " ".join(f"{k}q{j}" for j in range(4)) for k in range(60)]
    rows = list(enumerate(texts, 1000))
    random.Random(1).shuffle(rows)
    check(spark.createDataFrame(rows, "doc_id bigint, text string").repartition(5), rows)


def test_points_fold_and_pack():
    rng = np.random.default_rng(0)
    for n in (1, 256, 257, 5000, 70_000):
        own = np.unique(rng.integers(0, 2**63, n, dtype=np.uint64))
        p = point(own)
        assert len(p) == groups_of(len(own)) and p.sum() == len(own) and len(own) <= 4 * len(p) and (len(p) == 64 or len(own) > 2 * len(p))
        assert (unpacked(packed(p)) == p).all() and (folded(p, 64) == counts([own])[0]).all()
    assert (unpacked(packed(np.array([1, 300, 70_000]))) == [1, 300, 70_000]).all()


@pytest.mark.parametrize("n", [300, 3000, 27_000])
def test_bounds_part_sets_that_share_little(n):
    rng = np.random.default_rng(n)
    base = rng.integers(0, 2**63, n, dtype=np.uint64)
    sets = [np.unique(np.concatenate([base[: n // 4], rng.integers(0, 2**63, n - n // 4, dtype=np.uint64)])) for _ in range(6)]
    near = np.unique(np.concatenate([sets[0][: int(0.97 * n)], rng.integers(0, 2**63, n // 50, dtype=np.uint64)]))
    assert point_links(list(range(7)), [point(s) for s in [*sets, near]], 80) == [(6, 0)]


def test_repeated_ids_tie_their_texts(spark):
    x, y, z, other = "a b c d e f", "g h i j k l", "m n o p q r", "s t u v w x"
    rows = [(0, x), (1, x), (1, y), (2, y), (3, z), (5, z), (5, other), (4, other), (None, x), (7, None), (7, y)]
    check(spark.createDataFrame(rows, "doc_id bigint, text string"), rows)
    kept = jaccard_join.one_of_each_class(spark.createDataFrame(rows, "doc_id bigint, text string"), 4, 85)
    assert sorted(((r[0], r[1]) for r in kept.collect()), key=str) == [(0, x), (3, z), (None, x)]
    twice = spark.createDataFrame([(1, x), (1, y), (1, y), (1, z)], "doc_id bigint, text string")
    assert len({str(jaccard_join.one_of_each_class(twice.repartition(n)).collect()) for n in (1, 3)}) == 1


def test_classes_too_wide_to_join(spark, monkeypatch):
    """Texts that one passage ties into a group but none resembles: blocks by shingles, and no text is compared with all."""
    monkeypatch.setattr(jaccard_join, "BLOCK_SHINGLES", 2000)
    monkeypatch.setattr(jaccard_join, "QUERY_SHINGLES", 4000)
    rng = random.Random(4)
    passage = " ".join(f"p{k}" for k in range(30))
    rows = [(k, " ".join(f"{k}w{j}" for j in range(20)) + " " + passage + " " + " ".join(f"{k}v{j}" for j in range(rng.randint(0, 3)))) for k in range(400)]
    rows += [(1000 + k, rows[k][1] + f" tail{k}") for k in range(0, 400, 7)]
    check(spark.createDataFrame(rows, "doc_id bigint, text string").repartition(5), rows)


def test_odd_rows(spark, odd):
    check(odd, [(r["doc_id"], r["text"]) for r in odd.collect()])
    check(odd.limit(0), [])
    same_id = [(1, "a b c d e f"), (1, "g h i j k l"), (2, "g h i j k l"), (3, "A B c d E f")]
    check(spark.createDataFrame(same_id, "doc_id bigint, text string"), same_id)
    kept = jaccard_join.one_of_each_class(odd)
    assert kept.columns == odd.columns
    assert sorted((r["doc_id"] for r in kept.collect()), key=lambda x: x or 0) == [None, 1, 2, 4, 5, 6, 7]


def test_pipeline(spark):
    """Every stage against what its parts say of its own input."""
    import corpus_pipeline as p

    sf = "/root/testdata/sf0.001"
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    columns = docs.columns
    assert 4 <= len(p.STAGES) <= 5
    for k, (name, stage) in enumerate(p.STAGES):
        out = stage(spark, docs, sf).cache()
        before, after = {r["doc_id"]: r for r in docs.collect()}, {r["doc_id"]: r for r in out.collect()}
        assert set(after) <= set(before)
        if k == 1:
            want = brute([(i, r["text"]) for i, r in before.items()], 5, 80)
            assert set(after) == set(want.values())
        if k < len(p.STAGES) - 1:
            assert out.columns == columns
        if k == 0:
            model = {r["doc_id"]: r["predicted"] for r in queries.op1_quality_classifier(spark, sf).collect()}
            assert set(after) == {i for i in before if model[i] == 1}
        if k == 2:
            items = spark.read.parquet(f"{sf}/benchmark.parquet").select("item_id", "text").collect()
            assert set(after) == set(before) - {doc for doc, _, _ in brute_leaks(items, [(i, r["text"]) for i, r in before.items()])}
        if k in (0, 1, 2):
            assert all(after[i] == before[i] for i in after)
        if k == 3:
            hide = Plain(queries.pii_key(spark)).hide
            assert {i: r["text"] for i, r in after.items()} == {i: hide(r["text"]) for i, r in before.items()}
            assert all(r["n_chars"] == len(r["text"]) for r in after.values())
        if k == 4:
            encode = tiktoken.Encoding("own", pat_str=P.PATTERN, mergeable_ranks={base64.b64decode(a): int(b) for a, b in map(bytes.split, open(P.path(queries.RANKS), "rb"))}, special_tokens={}).encode_ordinary
            assert set(after) == set(before)
            for i, r in after.items():
                ids = encode(before[i]["text"])
                assert r["n_tokens"] == len(ids) and r["ids_sha256"] == hashlib.sha256(np.array(ids, "<u4").tobytes()).hexdigest()
                assert r["decoded_sha256"] == hashlib.sha256(before[i]["text"].encode()).hexdigest()
        docs = out
    final = {r["doc_id"]: tuple(r) for r in docs.collect()}
    assert {r["doc_id"]: tuple(r) for r in p.run(spark, sf).collect()} == final


def test_pipeline_odd_rows(spark, odd, tmp_path):
    import corpus_pipeline as p

    for t in ("labels", "benchmark"):
        spark.read.parquet(f"/root/testdata/sf0.001/{t}.parquet").write.parquet(f"{tmp_path}/{t}.parquet")
    odd.select("doc_id", "text", "lang", "source", "n_chars").write.parquet(f"{tmp_path}/documents.parquet")
    rows = p.run(spark, str(tmp_path)).collect()
    assert {r["doc_id"] for r in rows} <= {None, 1, 2, 4, 5, 6, 7} and len({r["doc_id"] for r in rows}) == len(rows)
    clean = odd.select("doc_id", "text", "lang", "source", "n_chars")
    for name, stage in p.STAGES[1:4]:
        out = stage(spark, odd, str(tmp_path))
        assert out.columns == odd.columns, name  # columns of clashing names pass through
        kept = sorted(str(r["doc_id"]) for r in out.collect())
        assert kept == sorted(["1", "2", "4", "5", "6", "7", "None"] + ["5"] * (name != "n-gram Jaccard join")), name
    empties = {r["doc_id"]: r for r in p.token_ids(spark, clean, str(tmp_path)).collect() if r["doc_id"] in (1, 2)}
    assert all(r["n_tokens"] == 0 and r["ids_sha256"] == hashlib.sha256(b"").hexdigest() == r["decoded_sha256"] for r in empties.values())
    scores = {r["doc_id"]: r["predicted"] for r in queries.scored(spark, clean, str(tmp_path)).collect()}
    assert {r["doc_id"] for r in p.good_quality(spark, clean, str(tmp_path)).collect()} == {i for i, s in scores.items() if s == 1}
    clash = clean.withColumns({"score": F.lit("own"), "predicted": F.lit("own"), "n_pseudonyms": F.lit("own")})
    for stage in (p.good_quality, p.without_personal_data):
        assert all(r["score"] == r["predicted"] == r["n_pseudonyms"] == "own" for r in stage(spark, clash, str(tmp_path)).collect())
    empty = odd.select("doc_id", "text", "lang", "source", "n_chars").limit(0)
    for _, stage in p.STAGES:
        assert stage(spark, empty, str(tmp_path)).count() == 0
