import base64
import hashlib
import random

import numpy as np
import public_tokenizers as P
import pytest
import tiktoken

from routelab.llm import bpe, queries

PATH = P.path("byte_bpe_50k.tiktoken")


@pytest.fixture(scope="module")
def codec():
    return bpe.Codec(bpe.read_ranks(PATH), P.PATTERN)


@pytest.fixture(scope="module")
def reference():
    ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, open(PATH, "rb"))}
    return tiktoken.Encoding("own", pat_str=P.PATTERN, mergeable_ranks=ranks, special_tokens={}).encode_ordinary


def test_random_texts(codec, reference):
    rng = random.Random(1)
    letters = "ab é\x1c\x1d\x85\xa0 \n\t'sll 12三😀́.!?\x00"
    texts = ["".join(rng.choice(letters) for _ in range(rng.randint(0, 60))) for _ in range(2000)]
    texts += ["a" * 9000, "ab" * 5000, "".join(rng.choice("abcdehti") for _ in range(6000)), "", None, "<|endoftext|>"]
    for text, ids in zip(texts, codec.encode(texts)):
        assert np.frombuffer(ids, "<u4").tolist() == reference(text or "")
        assert codec.decode(ids) == (text or "").encode()


def test_query(spark, docs, reference):
    got = {r["doc_id"]: r for r in queries.op9_byte_bpe(spark, "/root/testdata/sf0.001").collect()}
    for row in docs.collect():
        ids = reference(row["text"])
        r = got[row["doc_id"]]
        assert r["n_tokens"] == len(ids)
        assert r["ids_sha256"] == hashlib.sha256(np.array(ids, "<u4").tobytes()).hexdigest()
        assert r["decoded_sha256"] == hashlib.sha256(row["text"].encode()).hexdigest()


def test_odd_rows(odd):
    out = bpe.round_trip(odd, PATH, P.PATTERN)
    assert out.columns == [*odd.columns, "token_ids", "decoded"]
    for r in out.collect():
        assert r["decoded"].decode() == (r["text"] or "")
    twice = bpe.decode(bpe.encode(odd, PATH, P.PATTERN), PATH, P.PATTERN)
    assert sorted(map(repr, twice.collect())) == sorted(map(repr, out.collect()))
    assert bpe.round_trip(odd.limit(0), PATH, P.PATTERN).count() == 0
