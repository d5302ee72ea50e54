"""File sources: quirks of the reference's readers, exercised on small files."""

import json
import os
import random
import tempfile

import pandas as pd
import pytest
from pyspark.sql import functions as F

from table_paths import SF_SMALL
from taskweave.operators import interference as I
from taskweave.plans import fixtures as X
from taskweave.sources import delimited as D
from taskweave.sources import lines as LN
from taskweave.sources import similarity as S


def write(path, text):
    with open(path, "w", encoding="utf-8", newline="") as f:
        f.write(text)


def test_positional_join_quirks(spark):
    d = tempfile.mkdtemp()
    os.makedirs(f"{d}/t")
    os.makedirs(f"{d}/l")
    write(f"{d}/t/part-0.txt", 'one\nNA\n"\n\nfive')          # no trailing newline
    write(f"{d}/l/part-0.txt", "1\n0\n\n1\n0\n")                 # blank label line skipped
    text = LN.read_lines_positional(spark, f"{d}/t", col="tweet")
    labs = LN.read_lines_positional(spark, f"{d}/l", skip_blank=True, col="y").withColumn("y", F.col("y").cast("int"))
    got = sorted(tuple(r) for r in LN.join_positional(text, labs).collect())
    assert got == [(0, "one", 1), (2, '"', 1)]
    assert [r.tweet for r in text.orderBy("pos").collect()] == ["one", None, '"', None, "five"]


def test_positions_across_files_and_splits(spark):
    d = tempfile.mkdtemp()
    lines = [f"line {i:05d} " + "x" * 50 for i in range(3000)]
    write(f"{d}/part-00000", "\n".join(lines[:1700]) + "\n")
    write(f"{d}/part-00001", "\n".join(lines[1700:]) + "\n")
    old = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "8192")
    try:
        got = LN.read_lines_positional(spark, d).collect()
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", old)
    assert sorted((r.pos, r.line) for r in got) == list(enumerate(lines))


def test_csv_na_tokens_and_multiline(spark):
    d = tempfile.mkdtemp()
    write(f"{d}/a.csv", 'id,tweet\n1,"multi\nline, with comma"\n2,NA\n3,null\n4,""\n5,ok\n')
    df = D.read_delimited(spark, d, "id INT, tweet STRING", multi_line=True)
    assert [tuple(r) for r in df.orderBy("id").collect()] == [
        (1, "multi\nline, with comma"), (2, None), (3, None), (4, None), (5, "ok")]


@pytest.fixture
def small_splits(spark):
    """File splits of some hundred bytes."""
    old = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "300")
    yield
    spark.conf.set("spark.sql.files.maxPartitionBytes", old)


def quoted(r, ends):
    """A field, quoted where it must be, with line breaks of both kinds, separators and quotes inside."""
    text = "".join(r.choice(["a", "bc", " ", ",", "\t", '"', "\n", "\r\n", "é", "\n\n", "x" * r.randint(1, 40)]) for _ in range(r.randint(0, 9)))
    plain = not any(c in text for c in ',\t"\n\r')
    return text if plain and r.random() < 0.7 else '"' + text.replace('"', '""') + '"'


@pytest.mark.parametrize("sep, ends", [(",", "\n"), ("\t", "\n"), (",", "\r\n")])
def test_quoted_line_breaks_over_many_splits(spark, small_splits, sep, ends):
    r = random.Random(len(sep + ends))
    d = tempfile.mkdtemp()
    for name in ("one", "two", "three"):
        rows = [sep.join([str(i), quoted(r, ends), quoted(r, ends)]) for i in range(300)]
        if name == "two":
            rows[40] = sep.join(["40", '"' + "long\n" * 900 + '"', "over many splits"])  # a record over many splits
            rows[70] = ends  # blank lines
            rows[90:95] = [f'{i}{sep}a "quote" inside{sep}it' + "''" for i in range(90, 95)]
        write(f"{d}/{name}.csv", ends.join(["id" + sep + "a" + sep + '"b\nc"', *rows]) + (ends if name != "three" else ""))
    schema = "id INT, a STRING, b STRING"
    whole = (spark.read.schema(schema).option("header", True).option("sep", sep).option("quote", '"').option("escape", '"')
             .option("multiLine", True).csv(d))
    got = D.read_delimited(spark, d, schema, sep=sep, multi_line=True, na_tokens=False)
    assert got.rdd.getNumPartitions() > 20 and whole.rdd.getNumPartitions() <= 3
    rows = sorted(map(tuple, got.collect()), key=repr)
    assert len(rows) == 899
    if ends == "\n":  # Spark's own reader takes the line end of a file from its first line break
        assert rows == sorted(map(tuple, whole.collect()), key=repr)
    frames = [pd.read_csv(f"{d}/{name}.csv", sep=sep, dtype=str, keep_default_na=False) for name in ("one", "two", "three")]
    assert sorted([(i, a or "", b or "") for i, a, b in rows]) == sorted((int(i), a, b) for f in frames for i, a, b in f.itertuples(index=False))
    named = D.read_with_provenance(spark, d, schema, r"(one|two|three)", ["name"], sep=sep, multi_line=True)
    assert {(x["name"], x["n"]) for x in named.groupBy("name").agg(F.count(F.lit(1)).alias("n")).collect()} == {("one", 300), ("two", 299), ("three", 300)}


def test_unbalanced_quote_swallows_the_rest_of_its_file(spark, small_splits):
    d = tempfile.mkdtemp()
    write(f"{d}/a.csv", "id,a\n" + "".join(f"{i},x{i}\n" for i in range(100)) + '100,"open\n' + "".join(f"{i},y{i}\n" for i in range(100, 300)))
    write(f"{d}/b.csv", "id,a\n" + "".join(f"{i},z{i}\n" for i in range(300, 400)))
    rows = D.read_delimited(spark, d, "id INT, a STRING", multi_line=True).orderBy("id").collect()
    assert [r.id for r in rows] == [*range(101), *range(300, 400)]
    assert rows[100].a.startswith("open\n100,y100\n") and rows[100].a.rstrip().endswith("299,y299")


def test_similarity_json_round_trip_and_reference_form(spark):
    g = X.fg(spark, SF_SMALL)
    sims = I.group_cosines(g, I.task_pairs(I.task_order(g))).withColumn("idx", F.col("step").cast("long"))
    d = tempfile.mkdtemp()
    S.write_similarity_json(sims, f"{d}/s")
    back = S.read_similarity_json(spark, f"{d}/s")
    a = sorted((r.pair, r.grp, r.similarity) for r in back.collect() if r.similarity == r.similarity)
    w = sims.withColumn("idx", F.row_number().over(
        __import__("pyspark.sql").sql.Window.partitionBy("pair", "grp").orderBy("step")) - 1)
    b = sorted((r.pair, r.grp, r.similarity) for r in w.collect() if r.similarity == r.similarity)
    assert a == b
    # a single whole-file object as the reference writes it (NaN token, empty list)
    write(f"{d}/one.json", '{"a-b": {"all_model": [0.5, NaN], "encoder": [], "fc_layer": [1.0]}}')
    one = S.read_similarity_json(spark, f"{d}/one.json", wholetext=True).collect()
    assert len(one) == 3 and {r.grp for r in one} == {"all_model", "fc_layer"}


def series(r, names, lengths):
    value = lambda: r.choice([r.uniform(-1, 1), r.uniform(-1, 1), float("nan"), None, 1, -2e-7])
    return {n: {g: [value() for _ in range(r.choice(lengths))] for g in S.GROUPS} for n in names}


def long_form(data):
    return sorted((repr((p, g, i, None if v is None else float(v))) for p, gs in data.items() for g, vs in gs.items() for i, v in enumerate(vs)))


@pytest.mark.parametrize("indent", [None, 1])
def test_one_json_object_over_many_splits(spark, small_splits, indent):
    r = random.Random(3)
    data = series(r, ["a-b", 'with "quotes" \\ and, commas, in, it', "c" * 700 + ", long", "é-ü", "[x]:{y}-z"], [0, 1, 5, 900])
    d = tempfile.mkdtemp()
    write(f"{d}/one.json", json.dumps(data, indent=indent))
    got = S.read_similarity_json(spark, f"{d}/one.json")
    assert got.rdd.getNumPartitions() > 20
    assert sorted(repr(tuple(x)) for x in got.collect()) == long_form(data)
    lines = [{n: s} for n, s in data.items()]
    write(f"{d}/lines.json", "\n".join(json.dumps(x) for x in lines))
    assert sorted(repr(tuple(x)) for x in S.read_similarity_json(spark, f"{d}/lines.json").collect()) == long_form(data)


def test_long_series_are_written_in_pieces(spark, small_splits):
    r = random.Random(4)
    data = series(r, ["a-b", 'q"uote, d', "b-c", "z"], [0, 3, 700])
    data["m-n"] = {g: [0.5, 0.25] for g in S.GROUPS}
    rows = [(p, g, 10 + 3 * i, None if v is None else float(v)) for p, gs in data.items() for g, vs in gs.items() for i, v in enumerate(vs)]
    r.shuffle(rows)
    d = tempfile.mkdtemp()
    old = spark.conf.get("spark.sql.adaptive.coalescePartitions.enabled")
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    S.write_similarity_json(spark.createDataFrame(rows, "pair string, grp string, idx int, similarity double"), f"{d}/s")
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", old)
    parts = sorted(x for x in os.listdir(f"{d}/s") if x.startswith("part-"))
    text = "".join(open(f"{d}/s/{x}", encoding="utf-8").read() for x in parts)
    assert len(parts) > 3 and max(map(len, text.split("\n"))) < 100
    written = {p: gs for p, gs in data.items() if any(gs.values())}
    assert repr(json.loads(text)) == repr({p: {g: [None if v is None else float(v) for v in vs] for g, vs in gs.items()} for p, gs in sorted(written.items())})
    assert sorted(repr(tuple(x)) for x in S.read_similarity_json(spark, f"{d}/s").collect()) == long_form(data)


def test_tsv_quote_modes(spark):
    d = tempfile.mkdtemp()
    write(f"{d}/a.tsv", 'id\ttweet\n1\t"unbalanced quote\n2\tnext\n3\tlast\n')
    as_written = D.read_delimited(spark, d, "id INT, tweet STRING", sep="\t", mode="as_written", multi_line=True).collect()
    intended = D.read_delimited(spark, d, "id INT, tweet STRING", sep="\t", mode="intended", multi_line=True).orderBy("id").collect()
    assert len(as_written) < 3                       # the open quote swallows the following rows
    assert [tuple(r) for r in intended] == [(1, '"unbalanced quote'), (2, "next"), (3, "last")]
