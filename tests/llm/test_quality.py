import random
import re
from collections import Counter

import numpy as np
import pytest

from taskweave.llm import quality
from taskweave.llm.quality import CLASSES, Limits

WORD = r"[^\x20\x09-\x0D]+"


def brute_base(text):
    text = text or ""
    w = re.findall(WORD, text)
    grams = Counter(tuple(w[i:i + 5]) for i in range(len(w) - 4))
    repeated = {k for i in range(len(w) - 4) if grams[tuple(w[i:i + 5])] > 1 for k in range(i, i + 5)}
    lines = text.split("\n")
    dup = sum(1 for i, line in enumerate(lines) if re.search(WORD, line) and line in lines[:i])
    n = len(w)
    return n, sum(map(len, w)), len(re.findall(r"[#*$%&|<>]", text)), dup, len(repeated), n < 10 or 100 * len(repeated) > 20 * n


def brute_classes(text):
    kinds = {"lower": "[a-z]", "upper": "[A-Z]", "digit": "[0-9]", "space": r"[\x20\x09-\x0D]", "sentence": r"[.,;:!?'\"()\-]", "beyond_ascii": r"[^\x00-\x7f]"}
    out = {k: len(re.findall(p, text)) for k, p in kinds.items()}
    out["symbol"] = len(text) - sum(out.values())
    return [out[k] for k in CLASSES]


def brute_js(p, q):
    p, q = [x / sum(p) for x in p], [x / sum(q) for x in q]
    m = [(a + b) / 2 for a, b in zip(p, q)]
    return max(0, sum(a * np.log2(a / c) for a, c in zip(p, m) if a) / 2 + sum(b * np.log2(b / c) for b, c in zip(q, m) if b) / 2) ** 0.5


def brute(rows, limits):
    """(lang, text) -> verdicts, all from the definition."""
    words: dict = {}
    classes: dict = {}
    for lang, t in rows:
        words.setdefault(lang, Counter()).update(re.findall(WORD, re.sub("[A-Z]", lambda m: m[0].lower(), t or "")))
        classes[lang] = np.array(classes.get(lang, [0] * 7)) + brute_classes(t or "")
    total = sum(sum(c.values()) for c in words.values())
    for lang, t in rows:
        base = brute_base(t)
        by_class = by_word = None
        if sum(words[lang].values()) >= limits.least_share * total:
            if len(t or "") >= limits.class_chars:
                by_class = brute_js(brute_classes(t), classes[lang])
            if base[0] >= limits.word_words:
                top = sorted(words[lang], key=lambda w: (-words[lang][w], w.encode()))[:limits.common_words]
                own = Counter(re.findall(WORD, re.sub("[A-Z]", lambda m: m[0].lower(), t)))
                rest = lambda c: sum(c.values()) - sum(c[w] for w in top)
                by_word = brute_js([own[w] for w in top] + [rest(own)], [words[lang][w] for w in top] + [rest(words[lang])])
        far = (by_class is not None and by_class > limits.class_distance[0] + limits.class_distance[1] / len(t) ** 0.5
               or by_word is not None and by_word > limits.word_distance[0] + limits.word_distance[1] / base[0] ** 0.5)
        yield *base, not (base[5] or far), by_class, by_word


@pytest.mark.parametrize("limits", [Limits(), Limits(common_words=3, class_chars=20, word_words=10, class_distance=(0.15, 0.0), word_distance=(0.1, 0.0))])
def test_equals_brute_force(spark, odd_docs, limits):
    rows = odd_docs.collect()
    got = quality.judge(spark, odd_docs, limits).collect()
    flat = lambda v: tuple(round(x, 9) if isinstance(x, float) else x for x in v)
    want = [(r.doc_id, *flat(v)) for r, v in zip(rows, brute([(r.lang, r.text) for r in rows], limits))]
    assert Counter(flat(tuple(r)) for r in got) == Counter(want)
    if limits != Limits():
        assert 0 < sum(w[7] for w in want) < sum(not w[6] for w in want)  # the distances reject some


def test_stage_keeps_the_kept_rows_and_their_columns(spark, odd_docs, no_docs):
    verdicts = [v[6] for v in brute([(r.lang, r.text) for r in odd_docs.collect()], Limits())]
    kept = quality.drop_rejected(spark, odd_docs)
    assert kept.columns == odd_docs.columns
    assert Counter(map(str, kept.collect())) == Counter(str(r) for r, v in zip(odd_docs.collect(), verdicts) if v)
    assert quality.judge(spark, no_docs).count() == 0 and quality.drop_rejected(spark, no_docs).count() == 0


def test_junk_is_rejected_and_prose_kept(spark):
    import random
    r = random.Random(1)
    pool = ["the", "of", "and", "to"] * 12 + [f"{a}{b}" for a in ("ba", "do", "ki", "su") for b in ("la", "mer", "ton", "vi", "na")]
    prose = [" ".join(r.choice(pool) for _ in range(r.randint(60, 300))) + "." for _ in range(120)]
    junk = [prose[0].upper().replace(" ", "!! "), " | ".join(r.choice(pool[48:]) for _ in range(150)), " ".join(w + "%%%" for w in prose[1].split()), "spam " * 100]
    docs = spark.createDataFrame([(i, t, "en") for i, t in enumerate(prose + junk)], "doc_id long, text string, lang string")
    kept = {x.doc_id for x in quality.judge(spark, docs).where("kept").collect()}
    assert kept == set(range(len(prose)))


def test_repeats_in_long_texts():
    import random
    r = random.Random(0)
    w = [str(r.randint(0, 10 ** 6)).encode() for _ in range(20000)]
    assert quality.repeated_words(w, 5) == 0
    assert quality.repeated_words(w + w[100:110] + [b"x"] + w[5000:5004], 5) == 20


@pytest.mark.parametrize("broadcast", [1000, 2])
def test_small_languages_are_compared_however_large_the_others(spark, monkeypatch, broadcast):
    import random
    monkeypatch.setattr(quality, "BROADCAST_LANGS", broadcast)
    r = random.Random(2)
    pool = ["the", "of", "and", "to"] * 12 + [f"{a}{b}" for a in ("ba", "do", "ki", "su") for b in ("la", "mer", "ton", "vi", "na")]
    prose = [(lang, " ".join(r.choice(pool) for _ in range(100)) + ".") for lang in ("aa", None) for _ in range(30)]
    junk = [(lang, prose[0][1].upper().replace(" ", "!! ")) for lang in ("aa", None)]
    large = [(lang, " ".join(r.choice(pool) for _ in range(400_000))) for lang in ("x", "y") for _ in range(6)]
    rows = [(i, lang, t, 1) for i, (lang, t) in enumerate(prose + junk + large)]
    docs = spark.createDataFrame(rows, "doc_id long, lang string, text string, body int").repartition(4)
    judged = {x.doc_id: x for x in quality.judge(spark, docs).collect()}
    assert len(judged) == len(rows) and all(x.class_distance is not None and x.word_distance is not None for x in judged.values())
    assert not any(judged[i].kept for i in (60, 61)) and all(judged[i].kept for i in range(60))
    assert {x.doc_id for x in quality.drop_rejected(spark, docs).collect()} == {i for i, x in judged.items() if x.kept}


def test_the_statement_agrees_at_every_bound(spark, tmp_path):
    """Languages of 499 and 500 words, no language beside the empty one, texts at the bounds of both distances."""
    import duckdb

    from taskweave.llm.queries import QUERIES, SQL
    r = random.Random(7)
    some = lambda n, kinds: " ".join("".join(r.choice(kinds) for _ in range(r.randint(2, 6))) for _ in range(n))
    rows = [(1, some(499, "abcdef"), "few"), (2, some(500, "abcdef"), "just"), (3, some(600, "ghij"), None), (4, some(600, "klmn"), "")]
    rows += [(10 + i, some(n, "ghij"), lang) for i, (n, lang) in enumerate((n, lang) for n in (9, 10, 49, 50, 51, 70) for lang in ("499", "500", None, ""))]
    rows += [(60 + i, "w" * n, "500") for i, n in enumerate((199, 200, 201))] + [(70, None, "500"), (71, "", None)]
    rows += [(80 + i, some(300, "aeiou"), "big") for i in range(8)] + [(90, some(60, "AEIOU"), "big"), (91, some(60, "01234"), "big")]
    spark.createDataFrame(rows, "doc_id long, text string, lang string").write.parquet(f"{tmp_path}/documents.parquet")
    con = duckdb.connect()
    con.execute(f"CREATE VIEW documents AS SELECT * FROM read_parquet('{tmp_path}/documents.parquet/*.parquet')")
    found = con.execute(SQL["op7_quality_rules"])
    names = [d[0] for d in found.description]
    want = sorted((dict(zip(names, x)) for x in found.fetchall()), key=lambda x: x["doc_id"])
    got = sorted((x.asDict() for x in QUERIES["op7_quality_rules"](spark, str(tmp_path)).collect()), key=lambda x: x["doc_id"])
    assert [{k: x[k] for k in names} for x in got] == [{k: pytest.approx(v, abs=2e-6) if isinstance(v, float) else v for k, v in x.items()} for x in want]
    by_id = {x["doc_id"]: x for x in got}
    assert by_id[1]["word_distance"] is None and by_id[2]["word_distance"] is not None
    assert by_id[3]["word_distance"] != by_id[4]["word_distance"] and not by_id[90]["kept"]
