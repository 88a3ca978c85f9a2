import hashlib
import json
import random

import numpy as np
import public_tokenizers as P
import pytest
from tokenizers import Tokenizer

from routelab.llm import queries, word_bpe

PATH = P.path("word_bpe_49k.json")


@pytest.fixture(scope="module")
def codec():
    with open(PATH, "rb") as f:
        return word_bpe.WordCodec(f.read(), cache=500, table=2000, window=700)


@pytest.fixture(scope="module")
def library():
    return Tokenizer.from_file(PATH)


def same(codec, library, text):
    want = library.encode(text or "", add_special_tokens=False).ids
    ids = codec.encode(text)
    assert np.frombuffer(ids, "<u4").tolist() == want, repr(text)[:200]
    assert codec.decode(ids, block=50).decode() == library.decode(want, skip_special_tokens=False)


def test_random_texts(codec, library):
    rng = random.Random(1)
    letters = "ab é\x1c\x1d\x85\xa0 \n\t'sll 12三😀́.!?\x00ΣİǅKﬁ"
    for _ in range(3000):
        same(codec, library, "".join(rng.choice(letters) for _ in range(rng.randint(0, 60))))
        same(codec, library, "".join(rng.choice("abcdehtinors") for _ in range(rng.randint(0, 40))))


def test_odd_texts(codec, library):
    rng = random.Random(2)
    texts = [None, "", " \n ", "a" * 9000, "ab" * 5000, "".join(rng.choice("abcdehti") for _ in range(60_000)), "word " * 3000, "é́ ́" * 900]
    texts += ["<|endoftext|>x<|startoftext|><|endoftext|>", "e<|endoftext|>́", "a <|endoftext |>", "\U000105c0b ꟋᲉ \U00010d4a1 ࢏￿ x"]
    for text in texts:
        same(codec, library, text)


def test_characters(codec, library):
    for k in [*range(0x80, 0x3400, 7), *range(0xA640, 0xABF0, 11), *range(0xF900, 0x20000, 97)]:
        same(codec, library, f"a{chr(k)}b{chr(k)} {chr(k)}́")


def test_border_table_is_the_merges(codec, library):
    """Two tokens are compatible exactly if the library's encoding of their joined text is these two."""
    merges, rng, seen = codec.merges, random.Random(3), [0, 0]
    inner = [k for k in range(512, len(merges.head)) if all(ord(c) < word_bpe.LAST for c in merges.spelled[k]) and merges.spelled[k].isascii() is False]
    lasts = [k for k in range(512, len(merges.head)) if ord(merges.spelled[k][-1]) >= word_bpe.LAST]
    plain = lambda k: "".join(chr(ord(c) & 0xFF) for c in merges.spelled[k])
    for _ in range(4000):
        a, b = rng.choice(inner), rng.choice(lasts)
        word = plain(a) + plain(b)
        if word.isascii() and word.isalpha():
            ids = library.encode(word, add_special_tokens=False).ids
            good = ids == [int(merges.ids[a]), int(merges.ids[b])]
            assert merges.stays(a, b) == good
            seen[good] += 1
    assert min(seen) > 20


def test_other_files_are_refused():
    spec = json.load(open(PATH))
    spec["normalizer"]["normalizers"].pop()
    with pytest.raises(ValueError, match="steps"):
        word_bpe.WordCodec(json.dumps(spec).encode())


def test_query(spark, docs, library):
    got = {r["doc_id"]: r for r in queries.op11_word_bpe(spark, "/root/testdata/sf0.001").collect()}
    for row in docs.collect():
        ids = library.encode(row["text"], add_special_tokens=False).ids
        r = got[row["doc_id"]]
        assert r["n_tokens"] == len(ids)
        assert r["ids_sha256"] == hashlib.sha256(np.array(ids, "<u4").tobytes()).hexdigest()
        assert r["decoded_sha256"] == hashlib.sha256(library.decode(ids, skip_special_tokens=False).encode()).hexdigest()


def test_odd_rows(odd, library):
    out = word_bpe.round_trip(odd, PATH)
    assert out.columns == [*odd.columns, "token_ids", "decoded"]
    for r in out.collect():
        ids = library.encode(r["text"] or "", add_special_tokens=False).ids
        assert np.frombuffer(r["token_ids"], "<u4").tolist() == ids
        assert r["decoded"].decode() == library.decode(ids, skip_special_tokens=False)
    twice = word_bpe.decode(word_bpe.encode(odd, PATH), PATH)
    assert sorted(map(repr, twice.collect())) == sorted(map(repr, out.collect()))
    assert word_bpe.round_trip(odd.limit(0), PATH).count() == 0
    assert word_bpe.round_trip(out, PATH).columns == out.columns  # outputs of an earlier run are replaced
