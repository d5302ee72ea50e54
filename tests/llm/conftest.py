import random

import pytest

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, batch int, part string, fp string, place double, `__kept` int, size string"


def words(r, n, kinds="abcdefgh"):
    return " ".join("".join(r.choice(kinds) for _ in range(r.randint(1, 4))) for _ in range(n))


@pytest.fixture(scope="session")
def texts():
    """Odd and ordinary texts: null, empty, blank, repeated, long, and with characters of all sorts."""
    r = random.Random(3)
    out = [None, "", " ", "\n\n", "a", "A  B\t\nc ", "ab " * 40, "x" * 5000, "déjà vu — 中文 ٣Ⅷ½ 😀\u3000end\x1c.", "it's  we'll\r\n\r\n  go '", words(r, 3000)]
    out += [words(r, r.randint(1, 120)).replace(" ", r.choice([" ", " ", "\n"])) for _ in range(40)]
    return out + out[10:14]


@pytest.fixture(scope="session")
def odd_docs(spark, texts):
    """The texts as documents with a null and a repeated id, a null language and source, and columns with clashing names."""
    rows = [(None if i == 5 else 7 if i in (8, 9) else i, t, [None, "en", "fr"][i % 3], [None, "b", "a", "ü"][i % 4], len(t or ""), i, "p", "f", 0.5, 1, "s")
            for i, t in enumerate(texts)]
    return spark.createDataFrame(rows + rows[-1:], SCHEMA).repartition(3)


@pytest.fixture(scope="session")
def no_docs(spark):
    return spark.createDataFrame([], SCHEMA)
