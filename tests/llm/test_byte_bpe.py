import hashlib
import random
from collections import Counter

import numpy as np
import public_tokenizers as public
import pytest
import tiktoken

from taskweave.llm import byte_bpe
from taskweave.llm.word_exchange import pack_ints, pack_strings, unpack_ints, unpack_strings


@pytest.fixture(scope="module")
def ranks():
    return byte_bpe.load_ranks(public.path("byte_bpe_multi_50k.tiktoken"))


@pytest.fixture(scope="module")
def library(ranks):
    return tiktoken.Encoding("test", pat_str=public.PATTERN, mergeable_ranks=ranks, special_tokens={})


def test_words_and_merges_equal_the_library(ranks, library):
    r = random.Random(1)
    alphabet = list("ab'sréñ ßI \n\t\r\x1c\x85\u2003\u3000٣Ⅷ²½😀 .,'tll中文") + [" ", " ", "\n", "the"]
    for _ in range(3000):
        text = "".join(r.choice(alphabet) for _ in range(r.randint(0, 16)))
        split, numbers = byte_bpe.word_splitter(public.PATTERN)
        found = list(split(text))
        words = list(numbers)
        assert [i for n in found for i in byte_bpe.merge(words[n].encode(), ranks)] == library.encode_ordinary(text), repr(text)


def test_long_words(ranks, library):
    for word in ("a" * 700, "the" * 300, "abracadabra" * 50, "zqx" * 400):
        assert byte_bpe.merge(word.encode(), ranks) == library.encode_ordinary(word)


def test_packing():
    a = np.array([0, 1, 70000, 2 ** 32 - 1], np.uint32)
    assert (unpack_ints(pack_ints(a)) == a).all() and len(unpack_ints(pack_ints(a[:0]))) == 0
    for items in ([], [b""], [b"ab", b"", b"\x00", b"ab"]):
        assert unpack_strings(pack_strings(items)) == items


def expected(docs, library):
    return Counter((r.doc_id, tuple(library.encode_ordinary(r.text or "")), (r.text or "").encode()) for r in docs.collect())


def test_encode_and_decode_round_trip(spark, odd_docs, ranks, library):
    encoded = byte_bpe.encode(spark, odd_docs, ranks, public.PATTERN)
    got = Counter((r.doc_id, tuple(r.ids), bytes(r.decoded)) for r in byte_bpe.decode(spark, encoded, ranks).collect())
    assert got == expected(odd_docs, library)


def test_small_batches_give_the_same(spark, odd_docs, ranks, library, monkeypatch):
    from taskweave.llm import word_exchange
    monkeypatch.setattr(word_exchange.pack, "__defaults__", (False, 500))
    encoded = byte_bpe.encode(spark, odd_docs, ranks, public.PATTERN)
    got = Counter((r.doc_id, tuple(r.ids)) for r in encoded.collect())
    assert got == Counter((i, ids) for i, ids, _ in expected(odd_docs, library).elements())


def test_digests(spark, odd_docs, no_docs, ranks, library):
    got = Counter(tuple(r) for r in byte_bpe.encode_digest(spark, odd_docs, ranks, public.PATTERN).collect())
    want = Counter((i, len(ids), hashlib.sha256(np.array(ids, "<u4").tobytes()).hexdigest(), hashlib.sha256(raw).hexdigest())
                   for i, ids, raw in expected(odd_docs, library).elements())
    assert got == want
    assert byte_bpe.encode_digest(spark, no_docs, ranks, public.PATTERN).count() == 0
