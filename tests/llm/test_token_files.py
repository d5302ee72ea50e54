import random
import zlib

import numpy as np
import public_tokenizers as public
import pytest
from tokenizers import Tokenizer

from taskweave.llm import token_files
from taskweave.llm.perfect_hash import PerfectHash, fingerprints

PATH = public.path("byte_bpe_50k.json")


@pytest.fixture(scope="module")
def library():
    return Tokenizer.from_file(PATH)


@pytest.mark.parametrize("n", [0, 1, 2, 700, 20000])
def test_perfect_hash(n):
    r = np.random.default_rng(n)
    keys = np.unique(np.concatenate([r.integers(-2 ** 62, 2 ** 62, n), np.arange(n)]))
    index = PerfectHash.build(keys)
    slots = index.slots(keys)
    assert sorted(slots.tolist()) == list(range(len(keys)))
    prints = np.zeros(len(keys), np.uint32)
    prints[slots] = fingerprints(keys)
    foreign = r.integers(2 ** 62 + 1, 2 ** 63 - 1, 2000)
    at = index.slots(foreign)
    assert (prints[at[at >= 0]] == fingerprints(foreign[at >= 0])).sum() == 0


def test_pieces_equal_the_library(library):
    r = random.Random(2)
    alphabet = list("ab'sréñ ßI \n\t\r\x1c\x85\u2003\u3000٣Ⅷ²½😀 .,'tll中文") + [" ", " ", "\n", "the", "<|endoftext|>"]
    texts = ["".join(r.choice(alphabet) for _ in range(r.randint(0, 20))) for _ in range(3000)]
    texts += ["a<|endoftext|>b", "x <|endoftext|> y", "one\ntwo three\nfour\n", "\nfirst", "a\n\nb\nc d"]
    with open(PATH, encoding="utf-8") as f:
        encoder = token_files.PieceEncoder(f.read(), 2)
    got = encoder.encode(texts)
    assert [np.frombuffer(g, "<u2").tolist() for g in got] == [library.encode(t, add_special_tokens=False).ids + [2] for t in texts]
    token_files.CACHE, many = 50, token_files.CACHE  # generations that fill up all the time
    assert [g for i in range(0, len(texts), 40) for g in encoder.encode(texts[i:i + 40])] == got
    token_files.CACHE = many


@pytest.fixture
def many_shards(spark):
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    yield
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "true")


def test_files_hold_all_documents(spark, odd_docs, library, many_shards):
    manifest = token_files.write_shards(spark, odd_docs, PATH, 2)
    assert manifest.count() > 1
    rows = sorted(odd_docs.collect(), key=lambda r: (r.doc_id is not None, r.doc_id or 0))
    ids = [library.encode(r.text or "", add_special_tokens=False).ids + [2] for r in rows]
    found = token_files.read_shards(spark, manifest, odd_docs.select("doc_id")).collect()
    assert sorted((r.doc_id, r.n_tokens, r.ids_crc32) for r in found if r.doc_id is not None) == sorted(
        (r.doc_id, len(x), zlib.crc32(np.array(x, "<u4").tobytes())) for r, x in zip(rows, ids) if r.doc_id is not None)
    assert sum(r.doc_id is None for r in found) == 1
    at = 0
    for r in sorted(found, key=lambda r: r.start):  # no gap and no overlap, in ascending order of the ids
        assert r.start == at
        at += r.n_tokens
    order = [r.doc_id for r in sorted(found, key=lambda r: r.start)]
    assert order == sorted(order, key=lambda i: (i is not None, i or 0)) and at == sum(map(len, ids))


def test_keyed_access(spark, odd_docs, many_shards):
    manifest = token_files.write_shards(spark, odd_docs, PATH, 2)
    keys = spark.createDataFrame([(3,), (3,), (10 ** 6,), (-5,)], "k long")
    assert [r.doc_id for r in token_files.read_shards(spark, manifest, keys).collect()] == [3]
    shard = manifest.where("n_docs > 0").first()
    assert token_files.ShardReader(shard.path).footer["n_docs"] == shard.n_docs


def test_rows_that_repeat_are_dealt_over_shards(spark, many_shards):
    docs = spark.range(4000).selectExpr("7L AS doc_id", "'same text' AS text").repartition(5)
    manifest = token_files.write_shards(spark, docs, PATH, 2)
    sizes = [r.n_docs for r in manifest.collect()]
    assert len(sizes) > 4 and sum(sizes) == 4000 and max(sizes) < 2000
    assert token_files.read_shards(spark, manifest, docs.select("doc_id")).count() == 4000


def test_paths_carry_the_scheme_that_spark_gives_them(spark, odd_docs, tmp_path):
    manifest = token_files.write_shards(spark, odd_docs, PATH, 2, folder=f"{tmp_path}/shards")
    assert all(r.path.startswith(f"file://{tmp_path}/shards/") for r in manifest.collect())


def test_empty_table(spark, no_docs):
    manifest = token_files.write_shards(spark, no_docs, PATH, 2)
    assert manifest.count() == 0
    assert token_files.read_shards(spark, manifest, no_docs.select("doc_id")).count() == 0
