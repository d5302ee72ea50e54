from collections import Counter

import pytest

import corpus_pipeline
from taskweave.llm.queries import QUERIES, SQL


def test_stages(spark, odd_docs, no_docs):
    assert [n for n, _ in corpus_pipeline.STAGES] == ["quality_rules", "line_dedup", "simhash_near_dedup", "source_mixing", "byte_bpe"]
    for start in (odd_docs, no_docs):
        docs = start
        for name, stage in corpus_pipeline.STAGES:
            out = stage(spark, docs, "unused")
            if name != "byte_bpe":
                assert out.columns == docs.columns and [t for _, t in out.dtypes] == [t for _, t in docs.dtypes]
                docs = corpus_pipeline.stored(spark, out, f"test-{name}")
        digests = out.collect()
        assert Counter(r.doc_id for r in digests) == Counter(r.doc_id for r in docs.select("doc_id").collect())


def brute_pipeline(spark, rows):
    """The stages' definitions one after the other, in plain Python."""
    import hashlib

    import numpy as np
    import public_tokenizers as public
    import tiktoken
    from test_line_dedup import brute as removed_lines
    from test_mixing import brute_targets
    from test_quality import Limits, brute as verdicts
    from test_simhash_dedup import brute_components, brute_fingerprint

    from taskweave.llm import byte_bpe
    rows = [r for r, v in zip(rows, verdicts([(r.lang, r.text) for r in rows], Limits())) if v[6]]
    keys = {r.text: r.k for r in spark.createDataFrame([(r.text,) for r in rows], "text string").selectExpr("text", "xxhash64(text) k").collect()}
    one_each = list({(r.doc_id, r.text): r for r in rows}.values())     # rows with equal id and text are one document
    gone = removed_lines([(r.doc_id, r.text, keys[r.text]) for r in one_each], 50)
    text = {(r.doc_id, r.text): None if r.text is None else "\n".join(x for i, x in enumerate(r.text.split("\n")) if i not in gone[d]) for d, r in enumerate(one_each)}
    docs = [(r.doc_id, text[r.doc_id, r.text], r.source) for r in rows]
    fps = [brute_fingerprint(t) for _, t, _ in docs]
    kept: dict = {}
    for root, fp, d in zip(brute_components(fps), fps, docs):
        rank = (d[0] is None, d[0] or 0, fp - (1 << 64) if fp >> 63 else fp)
        if root not in kept or rank < kept[root][0]:
            kept[root] = (rank, d)
    docs = [d for _, d in kept.values()]
    words = {d: len((d[1] or "").encode().split()) for d in docs}
    sizes: dict = {}
    for d in docs:
        sizes[d[2]] = sizes.get(d[2], 0) + words[d]
    targets = brute_targets(sizes)
    ranks = byte_bpe.load_ranks(public.path("byte_bpe_multi_50k.tiktoken"))
    library = tiktoken.Encoding("test", pat_str=public.PATTERN, mergeable_ranks=ranks, special_tokens={})
    out = Counter()
    for i, t, source in docs:
        rate = targets[source] / sizes[source] if sizes[source] else 0.0
        draw = int(hashlib.md5(f"11:{'null' if i is None else i}".encode()).hexdigest()[:12], 16) / (1 << 48)
        ids = library.encode_ordinary(t or "")
        digest = (i, len(ids), hashlib.sha256(np.array(ids, "<u4").tobytes()).hexdigest(), hashlib.sha256((t or "").encode()).hexdigest())
        out[digest] += int(rate) + (draw < rate - int(rate))
    return +out


def test_whole_pipeline_equals_brute_force(spark, odd_docs):
    import random

    from test_simhash_dedup import near_texts
    r = random.Random(6)
    passage = " ".join(f"w{r.randint(0, 400)}" for _ in range(60))
    long_ones = [" ".join(f"v{r.randint(0, 900)}" for _ in range(r.randint(20, 90))) + ("\n" + passage if i % 3 == 0 else "") for i in range(30)]
    more = [(5000 + i, t, "en", "ab"[i % 2], len(t)) for i, t in enumerate(near_texts() + long_ones)]
    docs = odd_docs.select("doc_id", "text", "lang", "source", "n_chars").unionByName(
        spark.createDataFrame(more, "doc_id long, text string, lang string, source string, n_chars long"))
    docs = corpus_pipeline.stored(spark, docs, "test-docs")
    out = docs
    for name, stage in corpus_pipeline.STAGES:
        out = corpus_pipeline.stored(spark, stage(spark, out, "unused"), f"test-{name}")
    got = Counter(tuple(x) for x in out.collect())
    want = brute_pipeline(spark, docs.collect())
    assert got == want and sum(want.values()) > 30


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_queries_run_over_whole_tables(spark, name):
    sf = "/root/testdata/sf0.001"
    table = {"op2": "pages", "op11": "embeddings"}.get(name.split("_")[0], "documents")
    rows = QUERIES[name](spark, sf).count()
    read = spark.read.parquet(f"{sf}/{table}.parquet")
    if name.startswith("op13_"):
        assert rows == 600 * read.select("lang").distinct().count()
    elif not name.startswith("op5_"):
        assert rows == read.count()
    assert rows > 0


@pytest.mark.parametrize("name", sorted(SQL))
def test_queries_equal_their_sql(spark, name):
    import duckdb
    sf = "/root/testdata/sf0.001"
    con = duckdb.connect()
    for table in ("documents", "pages", "embeddings", "labels"):
        con.sql(f"CREATE VIEW {table} AS SELECT * FROM '{sf}/{table}.parquet'")
    found = con.sql(SQL[name])
    got = QUERIES[name](spark, sf).select(*found.columns)
    assert Counter(map(tuple, got.collect())) == Counter(found.fetchall())
