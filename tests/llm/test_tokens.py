"""Encoding and counting against the public libraries."""

import base64
import hashlib
import random

import numpy as np
import public_tokenizers
import pytest
import tiktoken
from hypothesis import given, settings
from hypothesis import strategies as st
from tokenizers import Tokenizer

from sparklode.llm import byte_bpe, pretokens, token_counts

RANKS, SPEC = public_tokenizers.path("byte_bpe_multi_50k.tiktoken"), public_tokenizers.path("byte_bpe_50k.json")
ODD = [
    "", " ", "a", "a" * 3000, "abcdefgh" * 300, "日本語 です。 \n\n\t x", "<|endoftext|> a<|endoftext|>b", "don't I'LL we're", "\x1c\x85　 x", "՘a\U000323b0 1\U00012550",
    "naïve ÀÉ ſ", "\U0001f600👩‍👩‍👧 é", "ababab" * 99, "\0\1\2 \0a \0b", "x   y\n\n  z ",
]


@pytest.fixture(scope="module")
def library():
    ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, open(RANKS, "rb"))}
    return tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})


@pytest.fixture(scope="module")
def counter():
    return Tokenizer.from_file(SPEC)


def noise(seed):
    rnd = random.Random(seed)
    return ["".join(chr(rnd.choice([rnd.randrange(0x300), rnd.randrange(0xD800), rnd.randrange(0x10000, 0x34000)])) for _ in range(80)) for _ in range(200)]


def test_perfect_hash_is_minimal_and_exact():
    codec = byte_bpe.codec(RANKS)
    keys = list(codec.ranks)
    lengths = np.array([len(k) for k in keys])
    found = codec.hash.lookup(np.frombuffer(b"".join(keys), np.uint8), np.concatenate([[0], np.cumsum(lengths)]))
    assert (found == np.arange(len(keys))).all()
    assert sorted(codec.hash.key_at) == list(range(len(keys)))
    strange = [b"zzzzqqqq", b"\xff\xfe\xfd", b"qxqxqx"]
    assert (codec.hash.lookup(np.frombuffer(b"".join(strange), np.uint8), np.array([0, 8, 11, 17])) == -1).all()


def test_encoding_equals_the_library(library):
    texts = ODD + noise(1)
    codec = byte_bpe.codec(RANKS)
    ids = codec.encode(texts)
    assert [x.tolist() for x in ids] == [library.encode_ordinary(t) for t in texts]
    assert [codec.decode(x) for x in ids] == [t.encode() for t in texts]


@settings(max_examples=60, deadline=None)
@given(st.text(max_size=60))
def test_round_trip(text):
    codec = byte_bpe.codec(RANKS)
    assert codec.decode(codec.encode([text])[0]).decode() == text
    assert "".join(pretokens.split(text)) == text


def test_counts_equal_the_library(counter):
    texts = ODD + noise(2)
    wanted = [len(e.ids) for e in counter.encode_batch(texts, add_special_tokens=False)]
    assert token_counts.merges(SPEC).count(texts).tolist() == wanted


def test_merges_come_after_their_parts():
    m = token_counts.merges(SPEC)
    made = {int(i): rank for rank, i in enumerate(m.made)}
    for key, rank in zip(m.keys.tolist(), m.rank.tolist(), strict=True):
        for part in divmod(key, int(m.base)):
            assert made.get(part, -1) < rank


def test_whole_tables(spark, odd, crowded, none, library):
    found = byte_bpe.encode_documents(odd, RANKS).collect()
    assert len(found) == odd.count()
    texts = sorted(r["text"] or "" for r in odd.collect())
    assert sorted(r["ids_sha256"] for r in found) == sorted(hashlib.sha256(np.array(library.encode_ordinary(t), "<u4").tobytes()).hexdigest() for t in texts)
    assert sorted(r["decoded_sha256"] for r in found) == sorted(hashlib.sha256(t.encode()).hexdigest() for t in texts)
    back = byte_bpe.decode_documents(byte_bpe.encode_documents(odd, RANKS), RANKS).collect()
    assert sorted(r["text"] for r in back) == texts
    counts = token_counts.count_tokens(crowded, SPEC).collect()
    assert len(counts) == odd.count() and {r["n_tokens"] for r in counts if r["doc_id"] in (1, 2)} == {0}
    assert [r["over_limit"] for r in counts if r["doc_id"] in (0, 8)] == [False, True]
    assert byte_bpe.encode_documents(none, RANKS).count() == token_counts.count_tokens(none, SPEC).count() == 0
