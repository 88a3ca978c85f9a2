"""Pseudonyms and benchmark decontamination."""

import datetime
import hashlib
import random
import re

import numpy as np
import pytest
import regex
from pyspark.sql import functions as F

from routelab.llm import decontamination, pseudonyms, queries


def luhn(digits):
    total = 0
    for k, c in enumerate(reversed(digits)):
        d = int(c) * (1 + k % 2)
        total += d - 9 * (d > 9)
    return total % 10 == 0


def hidden(spark, texts, key="k"):
    df = spark.createDataFrame(list(enumerate(texts)), "id int, text string")
    return [r["text"] for r in pseudonyms.pseudonymise(df, key).orderBy("id").collect()]


def test_kinds_keep_their_format(spark):
    texts = [
        "4111 1111 1111 1111", "4111-1111-1111-1111", "4111111111111111", "378282246310005", "+1 (017) 555-7713", "212-555-1234", "123-45-6789", "97.51.17.173", "2024-02-29", "31/12/1999",
        "ann.34@mail7.example.com", 'token = "24be64439e3e49cf46b2d7c90f3602a3d0b907ff"',
    ]
    out = hidden(spark, [f"x {t}, y {t}" for t in texts])
    shape = lambda s: re.sub("[0-9]", "9", s)
    for text, new in zip(texts, out):
        a, b = re.fullmatch(r"x (.*), y (.*)", new).groups()
        assert a == b != text
        if "@" in text:
            assert a.endswith("@mail7.example.com") and "ann" not in a
        elif "token" in text:
            assert re.fullmatch(r'token = "[0-9a-f]{40}"', a)
        elif text == "97.51.17.173":
            assert all(0 <= int(o) <= 255 for o in a.split("."))
        else:
            assert shape(a) == shape(text)
    for new in out[:4]:
        assert luhn(re.sub("[^0-9]", "", new.split(",")[0]))
    assert out[0].split(",")[0][2:].replace(" ", "") == out[2].split(",")[0][2:]  # one card, whatever its separators
    assert hidden(spark, ["x 4111111111111111"], "other") != [out[2].split(",")[0]]


class Plain:
    """Pseudonyms once more, in plain Python."""

    def __init__(self, key):
        self.key = key

    def digest(self, *parts):
        return hashlib.sha256("|".join([self.key, *map(str, parts)]).encode()).hexdigest()

    def mix(self, a, b, sizes, kind):
        for at in range(10):
            a, b = b, (a + int(self.digest(kind, at, b)[:15], 16)) % sizes[at % 2]
        return a, b

    def card(self, d):
        if not luhn(d):
            return d
        body, u = d[:-1], (len(d) - 1) // 2
        a, b = self.mix(int(body[:u]), int(body[u:]), (10**u, 10 ** (len(body) - u)), "card")
        new = str(a).zfill(u) + str(b).zfill(len(body) - u)
        return new + next(c for c in "0123456789" if luhn(new + c))

    def phone(self, d):
        area, exchange, line = int(d[:3]), int(d[3:6]), int(d[6:])
        if area >= 200 and exchange >= 200:
            a, b = self.mix((area - 200) * 800 + exchange - 200, line, (640_000, 10_000), "phone")
            return f"{a // 800 + 200:03}{a % 800 + 200:03}{b:04}"
        a, b = self.mix(area * 1000 + exchange if area < 200 else 200_000 + (area - 200) * 200 + exchange, line, (360_000, 10_000), "phone-low")
        return f"{a:06}{b:04}" if a < 200_000 else f"{(a - 200_000) // 200 + 200:03}{(a - 200_000) % 200:03}{b:04}"

    def ssn(self, d):
        issued = [x for x in range(1, 900) if x != 666]
        never = [x for x in range(1000) if x not in set(issued)]
        area, group, serial = int(d[:3]), int(d[3:5]), int(d[5:])
        if area in never:
            a, b = self.mix(never.index(area), group * 10_000 + serial, (102, 1_000_000), "ssn-area")
            return f"{never[a]:03}{b:06}"
        if not group or not serial:
            a, b = self.mix(issued.index(area), serial if not group else 9_999 + group, (898, 10_099), "ssn-zero")
            return f"{issued[a]:03}" + (f"00{b:04}" if b < 10_000 else f"{b - 9_999:02}0000")
        a, b = self.mix(issued.index(area), (group - 1) * 9_999 + serial - 1, (898, 989_901), "ssn")
        return f"{issued[a]:03}{b // 9_999 + 1:02}{b % 9_999 + 1:04}"

    def __call__(self, m):
        v = m.group()
        fill = lambda form, digits: re.sub("[0-9]", lambda _, it=iter(digits): next(it), form)
        digits = re.sub("[^0-9]", "", v)
        if "@" in v:
            local, domain = v.split("@")
            letters = self.digest("email", v.lower()).translate(str.maketrans("0123456789abcdef", "ghjkmnpqrstuvwxy"))
            return letters[: max(12, len(local))] + "@" + domain
        if re.fullmatch("[0-9A-Fa-f]{32,}", v):
            return "".join(self.digest("secret", k, v.lower()) for k in range(len(v) // 64 + 1))[: len(v)]
        if re.fullmatch(pseudonyms.ADDRESS, v):
            o = list(map(int, v.split(".")))
            a, b = self.mix(o[0] * 256 + o[1], o[2] * 256 + o[3], (65536, 65536), "address")
            return f"{a // 256}.{a % 256}.{b // 256}.{b % 256}"
        if re.fullmatch(pseudonyms.DATE, v):
            form = "%Y-%m-%d" if v[4] == "-" else "%d/%m/%Y"
            first = datetime.date(1900, 1, 1)
            try:
                day = (datetime.datetime.strptime(v, form).date() - first).days
            except ValueError:
                return v
            while True:
                a, b = self.mix(day // 270, day % 270, (271, 270), "date")
                day = a * 270 + b
                if day < 73049:
                    return (first + datetime.timedelta(day)).strftime(form)
        if re.fullmatch(pseudonyms.SSN, v):
            return fill(v, self.ssn(digits))
        if re.fullmatch(pseudonyms.PHONE, v):
            start = len(re.match(r"(\+1[ .-]?)?", v).group())
            return v[:start] + fill(v[start:], self.phone(re.sub("[^0-9]", "", v[start:])))
        return fill(v, self.card(digits))

    def hide(self, text):
        return text and regex.sub(pseudonyms.PATTERN, self, text)


def test_against_plain_python(spark, docs):
    rng = random.Random(3)
    n = lambda k: "".join(rng.choice("0123456789") for _ in range(k))
    texts = [f"{n(16)} {n(4)}-{n(4)}-{n(4)}-{n(4)} ({n(3)}) {n(3)}-{n(4)}; +1 {n(3)}.{n(3)}.{n(4)}, {n(3)}-{n(2)}-{n(4)} 19{n(2)}-0{n(1)}-1{n(1)} 2{n(1)}/1{n(1)}/20{n(2)} 1{n(2)}.{n(2)}.{n(1)}.2{n(2)}" for _ in range(300)]
    texts += ["000-12-3456 666-01-0001 900-55-0000 123-00-4567 123-00-0000 123-45-0000 665-01-0001 667-99-9999 899-99-9999 001-01-0001", "100-200-3000 200-199-0000 999-999-9999"]
    assert hidden(spark, texts, "k") == [Plain("k").hide(t) for t in texts]
    rows = {r["doc_id"]: r["text"] for r in pseudonyms.pseudonymise(docs, "another").collect()}
    assert rows == {d["doc_id"]: Plain("another").hide(d["text"]) for d in docs.collect()}


def test_the_query_against_plain_python(spark, docs):
    got = {r["doc_id"]: r["text"] for r in queries.op6_pseudonyms(spark, "/root/testdata/sf0.001").collect()}
    key = spark.conf.get(queries.KEY)
    assert len(key) == 64 and queries.pii_key(spark) == key  # random where none is set, and kept
    assert got == {d["doc_id"]: Plain(key).hide(d["text"]) for d in docs.collect()}


def test_numbers_are_one_to_one(spark):
    rng = random.Random(1)
    ssn = sorted({f"{rng.randrange(1000):03}{rng.randrange(100) * rng.randrange(2):02}{rng.randrange(10000) * rng.randrange(2):04}" for _ in range(8000)})
    df = spark.createDataFrame([(f"{s[:3]}-{s[3:5]}-{s[5:]}",) for s in ssn], "v string")
    new = [r[0] for r in df.select(pseudonyms.ssn(F.col("v"), "k")).collect()]
    real = lambda s: s[:3] not in ("000", "666") and s[0] != "9" and s[3:5] != "00" and s[5:] != "0000"
    assert len(set(new)) == len(ssn) and all(real(a) == real(b.replace("-", "")) for a, b in zip(ssn, new))


def test_no_size_hides_from_the_patterns(spark):
    """Secrets and addresses of any length go, in linear time."""
    long = ["key=" + "ab12" * 40, "token: " + "0f" * 50_000, "a" * 65 + "@b.org", "x" * 300_000 + "@" + ".".join(["sub"] * 3000) + ".example.com", ".dots@a.org", "key=" + "f" * 200_000 + "z", "@" * 5000]
    out = hidden(spark, long)
    assert [a != b for a, b in zip(long, out)] == [True] * 5 + [False] * 2
    assert [len(b) for b in out[:2]] == [len(a) for a in long[:2]] and not any("a" * 65 in b for b in out) and "dots" not in out[4] and out[3].endswith("sub.example.com")


def test_columns_of_any_name(spark):
    df = spark.createDataFrame([("call 212-555-1234", 1, "b", 2)], "text string, __found int, new string, found int")
    row = pseudonyms.pseudonymise(df, "k").first()
    assert row[1:] == (1, "b", 2, 1) and "1234" not in row["text"]


def test_what_stays(spark):
    texts = ["4111 1111 1111 1112", "1234567890123", "2023-02-29", "31/02/2001", "1.2.3.4.5", "999.1.1.1", "version 3, 2007", "a@b", "", None, "12345-6789", "9807915762804491"]
    assert hidden(spark, texts) == texts


def test_neighbours(spark):
    a, b = hidden(spark, ["4111111111111111 5500005555555559", "5500005555555559"])
    assert a.split()[1] == b and a.split()[0] != "4111111111111111"


def test_permutations_are_one_to_one(spark):
    df = spark.range(10_000)
    four = df.select(pseudonyms.permuted_digits(F.lpad(F.col("id").cast("string"), 4, "0"), "k", "t").alias("x"))
    assert four.distinct().count() == 10_000 and four.filter("length(x) <> 4").count() == 0
    days = spark.range(0, pseudonyms.DAYS, 1, 4).select(F.date_format(F.date_add(F.to_date(F.lit("1900-01-01")), F.col("id").cast("int")), "yyyy-MM-dd").alias("d"))
    new = days.select(pseudonyms.date(F.col("d"), "k").alias("x"))
    assert new.distinct().count() == pseudonyms.DAYS
    low, high = new.agg(F.min("x"), F.max("x")).first()
    assert (low, high) == ("1900-01-01", "2099-12-31")


def test_pseudonyms_query(spark, docs):
    got = {r["doc_id"]: r for r in queries.op6_pseudonyms(spark, "/root/testdata/sf0.001").collect()}
    assert len(got) == docs.count()
    plan = pseudonyms.pseudonymise(docs, "k")._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "Arrow" not in plan
    for d in docs.collect():
        for m in re.findall(r"\S+@\S+\.com|\+1 \(\d{3}\) \d{3}-\d{4}|(?<!\d)\d{16}(?!\d)|token = \"[0-9a-f]+\"", d["text"], re.I):
            assert (m in got[d["doc_id"]]["text"]) == (m.isdigit() and not luhn(m))


def test_pseudonyms_odd_rows(odd):
    out = pseudonyms.pseudonymise(odd, "k")
    assert out.columns == [*odd.columns, "n_pseudonyms"]
    assert sorted(map(repr, out.drop("n_pseudonyms").collect())) == sorted(map(repr, odd.collect()))
    assert pseudonyms.pseudonymise(odd.limit(0), "k").count() == 0


def distance(pattern, text):
    row = [0] * (len(text) + 1)
    for k, c in enumerate(pattern, 1):
        new = [k]
        for j, d in enumerate(text, 1):
            new.append(min(row[j] + 1, new[-1] + 1, row[j - 1] + (c != d)))
        row = new
    return min(row)


@pytest.mark.parametrize("seed", range(8))
def test_matches_brute_force(seed):
    rng = random.Random(seed)
    letters = "abc " if seed % 2 else "abcdefgh "
    for _ in range(60):
        p = decontamination.normal("".join(rng.choice(letters) for _ in range(rng.randint(6, 45)))) or "a"
        q = list(p)
        for _ in range(rng.randint(0, 7)):
            at = rng.randrange(len(q) + 1)
            if rng.random() < 0.5 and q:
                q[min(at, len(q) - 1)] = rng.choice("abcz")
            elif rng.random() < 0.5 and q:
                del q[min(at, len(q) - 1)]
            else:
                q.insert(at, rng.choice("abc"))
        pad = lambda: "".join(rng.choice(letters) for _ in range(25))
        text = decontamination.normal(pad() + "".join(q) + pad())
        for budget in (0.1, 0.25):
            most, best = int(len(p) * budget), distance(p, text)
            found = decontamination.Matcher([(7, p)], budget)(text)
            assert bool(found) == (best <= most), (p, text)
            if found:
                _, edits, start, end = found[0]
                assert edits == best and distance(p, text[start:end]) <= edits


def least_edits(item, text):
    """Least edits of ``item`` for each end in ``text``, a row of the table at a time."""
    codes, at = np.array([ord(c) for c in text], np.int32), np.arange(len(text) + 1, dtype=np.int32)
    row = np.zeros(len(text) + 1, np.int32)
    for c in item:
        new = row + 1
        np.minimum(new[1:], row[:-1] + (codes != ord(c)), out=new[1:])
        row = np.minimum.accumulate(new - at) + at
    return row


def brute_leaks(items, texts):
    """(doc, item, edits) of rows (id, text): every text against every item."""
    items, texts = ([(i, decontamination.normal(t)) for i, t in rows] for rows in (items, texts))
    apart = "\0" * (max(len(t) for _, t in items) // 10 + 2)
    starts = np.cumsum([0, *[len(t) + len(apart) for _, t in texts]])
    whole = apart.join(t for _, t in texts) + apart
    want = set()
    for item, form in items:
        row = least_edits(form, whole)
        for (doc, t), a in zip(texts, starts):
            edits = int(row[a : a + len(t) + 1].min())
            if form and edits <= len(form) // 10:
                want.add((doc, item, edits))
    return want


def test_the_query_against_brute_force(spark, docs):
    sf = "/root/testdata/sf0.001"
    want = brute_leaks(spark.read.parquet(f"{sf}/benchmark.parquet").select("item_id", "text").collect(), docs.select("doc_id", "text").collect())
    assert want and {(r["doc_id"], r["item_id"], r["edits"]) for r in queries.op7_decontamination(spark, sf).collect()} == want


def test_the_least_of_overlapping_places():
    text, item = "xx a bb a ba a ba b a ba a yy", "a ba b a ba a"
    for budget in (0.1, 0.2, 0.3):
        (_, edits, _, _), = decontamination.Matcher([(1, item)], budget)(text)
        assert edits == 0
    assert [m[1] for m in decontamination.Matcher([(1, item)], 0.2)("a b a ba a b a ba ab")] == [distance(item, "a b a ba a b a ba ab")]


def test_items_stand_between_word_borders(spark):
    texts = ["concatenate a cat", "concatenate", "category", "cat", "a bobcat sat", "The CAT. sat", "sat cats", None, "the quick brown foxes jump", "thequick brown fox jumps", "xthe quick brown fox jumpsx"]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id int, text string")
    items = spark.createDataFrame([(1, "cat"), (2, "a"), (3, "the quick brown fox jumps")], "item_id int, text string")
    got = {(r["doc_id"], r["item_id"]): (r["edits"], r["match_start"], r["match_end"]) for r in decontamination.find_items(docs, items).collect()}
    assert {k for k in got if k[1] == 1} == {(0, 1), (3, 1), (5, 1)} and {k for k in got if k[1] == 2} == {(0, 2), (4, 2)}
    assert got[0, 1] == (0, 14, 17) and got[3, 1] == (0, 0, 3) and got[5, 1] == (0, 4, 7) and got[0, 2] == (0, 12, 13)
    assert got[9, 3][0] == 1 and got[10, 3][0] == 2 and (8, 3) not in got  # a lost border costs an edit; "es", " jump" and "s" are more than two
    kept = {r[0] for r in decontamination.without_items(docs, items).select("doc_id").collect()}
    assert kept == {1, 2, 6, 7, 8}


def test_ids_of_any_type(spark):
    docs = spark.createDataFrame([("d1", "some words that leak here"), (None, "some words that leak")], "doc_id string, text string")
    items = spark.createDataFrame([("q", "words that leak")], "item_id string, text string")
    assert sorted(((r[0], r[1]) for r in decontamination.find_items(docs, items).collect()), key=str) == [("d1", "q"), (None, "q")]


def test_decontamination_query(spark, docs):
    items = spark.read.parquet("/root/testdata/sf0.001/benchmark.parquet").collect()
    got = {(r["doc_id"], r["item_id"]) for r in queries.op7_decontamination(spark, "/root/testdata/sf0.001").collect()}
    normal = decontamination.normal
    exact = {(d["doc_id"], i["item_id"]) for d in docs.collect() for i in items if normal(i["text"]) and normal(i["text"]) in normal(d["text"])}
    assert exact <= got and len(got - exact) <= 2


def test_decontamination_odd_rows(spark, odd):
    items = spark.createDataFrame([(1, None), (2, ""), (3, "##"), (4, "the SAME row, twice"), (4, "the SAME row, twice"), (5, "word " * 300)], "item_id bigint, text string").withColumn("doc_id", F.lit(1))
    found = decontamination.find_items(odd, items).collect()
    assert sorted((r["doc_id"], r["item_id"]) for r in found) == [(5, 4)] * 4 + [(6, 5)]
    by_block = decontamination.find_items(odd, items, block_bytes=20).collect()
    assert sorted(map(repr, by_block)) == sorted(map(repr, found))
    kept = decontamination.without_items(odd, items)
    assert kept.columns == odd.columns and kept.count() == odd.count() - 3
    assert decontamination.find_items(odd, items.limit(0)).count() == 0 and decontamination.find_items(odd.limit(0), items).count() == 0
