"""Compression bands and the quality classifier."""

import math
import re
import zlib
from collections import Counter

import numpy as np
import pytest
import zstandard
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from routelab.llm import compression_rules, queries
from routelab.llm import quality_classifier as qc

METER = compression_rules.Meter(compression_rules.Bands())
WORD = re.compile(r"[^\x20\x09-\x0D]+")


def brute(text):
    text = text or ""
    words = WORD.findall(text)
    windows = [tuple(words[k : k + 3]) for k in range(len(words) - 2)]
    counts = Counter(windows)
    hit = {k + j for k, w in enumerate(windows) if counts[w] > 1 for j in range(3)}
    lines, seen, dup = text.split("\n"), set(), 0
    for line in lines:
        if WORD.search(line):
            dup += line in seen
            seen.add(line)
    return len(words), sum(map(len, words)), len(re.findall(r"[#*$%&|<>]", text)), dup, len(hit)


@settings(max_examples=300, deadline=None)
@given(st.text(alphabet="ab#| \n\t\x1c é\x85", max_size=60))
def test_counts(text):
    assert METER(text)[:5] == brute(text)


def test_rules_query(spark, docs):
    got = {r["doc_id"]: r for r in queries.op3_compression_rules(spark, "/root/testdata/sf0.001").collect()}
    for d in docs.collect():
        r, want = got[d["doc_id"]], brute(d["text"])
        assert (r["n_words"], r["word_chars"], r["n_symbols"], r["n_dup_lines"], r["n_repeat_words"]) == want
        assert r["base_failed"] == (want[0] < 50 or 100 * want[4] > 50 * want[0])
        assert not (r["base_failed"] and r["kept"])


def brute_kept(texts, bands=compression_rules.Bands()):
    """Verdicts of plain Python: quartiles of sorted lists, one pass a text."""
    band, steps = lambda n: int(2 * math.log2(n)), lambda r: round(512 * math.log2(r))
    ratio = lambda raw: len(raw) / len(zstandard.ZstdCompressor(level=3, write_content_size=False).compress(raw))
    base = {}
    for t in set(texts):
        n, _, _, _, repeats = brute(t)
        base[t] = n < 50 or 100 * repeats > 50 * n
    by_band = {}
    for t in set(texts):
        if not base[t]:
            raw = t.encode()
            by_band.setdefault(band(len(raw)), []).append(steps(ratio(raw)))

    def fits(raw):
        own = sorted(by_band.get(band(len(raw)), []))
        if len(own) >= 50:
            low, high = (own[-(-q * len(own) // 4) - 1] for q in (1, 3))
            reach = 3 * max(high - low, 22)
            return low - reach <= steps(ratio(raw)) <= high + reach
        fixed = [x for x in bands.limits if band(len(raw)) >= band(x[0])]
        return not fixed or steps(fixed[-1][1]) <= steps(ratio(raw)) <= steps(fixed[-1][2])

    out = []
    for t in texts:
        raw, bad = (t or "").encode(), 0
        if base[t] or not fits(raw):
            out.append(False)
            continue
        for at in range(0, len(raw) if len(raw) > 2048 else 0, 2048):
            piece = raw[at : at + 2048]
            bad += 0 if fits(piece if len(piece) >= 1024 else raw[-2048:]) else len(piece)
        out.append(5 * bad <= len(raw))
    return out


def test_verdicts_against_brute_force(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet").select("doc_id", "text").collect()
    want = dict(zip([d["doc_id"] for d in docs], brute_kept([d["text"] for d in docs])))
    got = {r["doc_id"]: r["kept"] for r in queries.op3_compression_rules(spark, "/root/testdata/sf0.01").collect()}
    assert got == want


def test_the_method_decides(spark):
    sf = "/root/testdata/sf0.1"
    got = {r["doc_id"]: r for r in queries.op3_compression_rules(spark, sf).collect()}
    past = [r for r in got.values() if not r["base_failed"]]
    assert sum(r["ratio"] > r["greatest_ratio"] for r in past) > 100
    assert sum(not r["kept"] and r["least_ratio"] <= r["ratio"] <= r["greatest_ratio"] for r in past) >= 1  # by chunks
    labels = {r["doc_id"]: r["quality"] for r in spark.read.parquet(f"{sf}/labels.parquet").collect()}
    share = lambda q: np.mean([r["kept"] for i, r in got.items() if labels.get(i) == q and not r["base_failed"]])
    assert share(1) > 0.995 and share(0) < 0.7


def test_repetitive_and_incompressible_text_goes(spark):
    rng = np.random.default_rng(0)
    vocabulary = ["".join(rng.choice(list("etaoinshrdlu"), rng.integers(2, 8))) for _ in range(900)]
    prose = lambda n: " ".join(rng.choice(vocabulary, n))
    noise = lambda n: " ".join("".join(map(chr, rng.integers(33, 127, 12))) for _ in range(n))
    shout = " ".join(f"{a}{b}" for a in vocabulary[:3] for b in range(900))
    rows = [(k, prose(int(rng.integers(60, 1500)))) for k in range(1500)]
    odd = [noise(700), shout, prose(900) + " " + noise(180), prose(900) + " " + " ".join(f"x{k}" for k in range(800)), prose(900)]
    rows += [(2000 + k, t) for k, t in enumerate(odd)] + [(3000 + k, odd[1]) for k in range(3000)]  # copies don't move the fences
    got = {r["doc_id"]: r for r in compression_rules.compression_rules(spark.createDataFrame(rows, "doc_id bigint, text string").repartition(4)).collect()}
    assert [got[2000 + k]["kept"] for k in range(5)] == [False, False, False, False, True] and not got[3000]["kept"]
    assert not any(got[2000 + k]["base_failed"] for k in range(5)) and np.mean([got[k]["kept"] for k in range(1500)]) > 0.99


def test_a_short_tail_is_judged():
    rng = np.random.default_rng(0)
    for n in (2048, 2049, 3071, 3072, 4096, 5000, 9999):
        raw = rng.integers(97, 123, n, np.uint8).tobytes()
        cut = METER.chunks(raw)
        assert sum(k for k, _ in cut) == (n if n > 2048 else 0) and all(1024 <= len(c) <= 2048 and raw.count(c) for _, c in cut)


def test_rules_odd_rows(odd):
    out = compression_rules.compression_rules(odd)
    assert out.count() == odd.count() and "id" in out.columns and dict(out.dtypes)["n_words"] == "bigint"
    assert {r["kept"] for r in out.filter("n_words = 0").collect()} == {False} and "text" not in out.columns
    assert compression_rules.compression_rules(odd.limit(0)).count() == 0


def test_rules_keep_columns_of_any_name(spark):
    names = ["band", "steps", "text_key", "chunks", "n_bytes", "c0", "C1", "doc id", "a.b"]
    df = spark.createDataFrame([(*range(len(names)), "some words " * 40, 7)], [*[f"x{k}" for k in range(len(names))], "text", "n_words"]).toDF(*names, "text", "n_words")
    out = compression_rules.compression_rules(df)
    assert out.columns == [*names, *compression_rules.FIELDS]
    row = out.first()
    assert list(row)[: len(names)] == list(range(len(names))) and row["n_words"] == 80


def test_features_are_per_text():
    texts = ["One two THREE!! three three", None, "", "x", "One two THREE!! three three", "no no\nno no", "é É 三"]
    rows, found = qc.features(texts, True)
    for k, t in enumerate(texts):
        alone = qc.features([t], True)[1]
        assert found[rows == k].tolist() == alone.tolist()
    assert len(found[rows == 1]) == 0


def test_descent_solves_the_dual():
    rng = np.random.default_rng(0)
    sets = [np.unique(rng.integers(0, 30, 12)) for _ in range(120)]
    good = np.array([int((s < 10).sum() > (s >= 20).sum()) for s in sets])
    values = [np.ones(len(s)) for s in sets]
    w, b = qc.descend(sets, values, good, np.full(120, 1.0), 500)
    sign = np.where(good == 1, 1, -1)
    objective = lambda w, b: 0.5 * (w @ w + b * b) + sum(max(0, 1 - sign[k] * (w[sets[k]].sum() + b)) for k in range(120))
    best = objective(w, b)
    for _ in range(200):
        d = np.zeros(qc.SIZE)
        d[:30] = rng.normal(size=30) * 0.01
        assert objective(w + d, b + rng.normal() * 0.01) >= best - 1e-6


def test_held_out_accuracy(spark):
    sf = "/root/testdata/sf0.1"
    scored = {r["doc_id"]: r for r in queries.op1_quality_classifier(spark, sf).collect()}
    labels = spark.read.parquet(f"{sf}/labels.parquet").collect()
    assert len(scored) == 10_000
    held = [(r["quality"], scored[r["doc_id"]]) for r in labels if zlib.crc32(str(r["doc_id"]).encode()) % 5 == 0]
    assert all(s["held_out"] for _, s in held) and all(0 <= s["score"] <= 1 and s["predicted"] == int(s["score"] >= 0.3) for _, s in held)
    assert np.mean([q == s["predicted"] for q, s in held]) > 0.98


def test_the_query_sees_vocabulary(spark, tmp_path):
    texts = [(k, f"{'pear' if k % 2 else 'poor'} {'aeiou'[k // 2 % 5] * 4}") for k in range(200)]  # all of the same shapes
    spark.createDataFrame(texts, "doc_id bigint, text string").write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([(k, k % 2) for k in range(200)], "doc_id bigint, quality int").write.parquet(f"{tmp_path}/labels.parquet")
    scored = queries.op1_quality_classifier(spark, str(tmp_path)).filter("held_out").collect()
    assert scored and all(r["predicted"] == r["doc_id"] % 2 for r in scored)


def test_classifier_odd_rows(spark, odd):
    labels = spark.createDataFrame([(2, 1), (5, 0), (5, 1), (None, 1), (6, None), (77, 0)], "doc_id bigint, quality int")
    model = qc.train(odd, labels)
    out = qc.score(odd, model).collect()
    assert len(out) == odd.count() and all(0 <= r["score"] <= 1 for r in out)
    assert qc.score(odd, qc.train(odd, labels.limit(0))).first()["score"] == pytest.approx(0.5)
    assert qc.score(odd.limit(0), model).count() == 0
    clash = odd.withColumns({"y": F.lit(3), "found": F.lit(1), "__id": F.lit(2)})
    assert len(qc.score(clash, qc.train(clash, labels)).collect()) == odd.count()


def test_training_is_bounded_and_takes_an_id_once(spark, monkeypatch):
    seen = []
    monkeypatch.setattr(qc, "fit", lambda sets, good: seen.append((sets, good)) or qc.Model(np.zeros(qc.SIZE), np.zeros(qc.SIZE), 0.0, 0.0, 0.0))
    rows = [(k, " ".join(f"w{j}{'x' * (j % 9)}" for j in range(k))) for k in range(1, 40)] * 2
    docs = spark.createDataFrame(rows, "doc_id bigint, text string").repartition(3)
    labels = spark.createDataFrame([(k, k % 2) for k in range(1, 40)], "doc_id bigint, quality int")
    qc.train(docs, labels)
    qc.train(docs, labels, max_bytes=2000)
    qc.train(docs, labels, max_rows=5)
    (whole, _), (small, _), (five, _) = seen
    assert len(whole) == sum(zlib.crc32(str(k).encode()) % 5 != 0 for k in range(1, 40)) and len(five) == 5
    assert 0 < sum(map(len, small)) * 4 <= 2000 < sum(map(len, whole)) * 4
