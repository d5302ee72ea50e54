"""The operators run where workers can't import this package."""

import os
import subprocess
import sys

ROOT = os.path.dirname(os.path.dirname(os.path.dirname(os.path.abspath(__file__))))
SCRIPT = f'''
import sys
sys.path.insert(0, {ROOT!r})
import public_tokenizers as public
from taskweave.session import build_session
from taskweave.llm import byte_bpe, centroids, filter_audit, line_dedup, lm_scoring, quality, simhash_dedup, suffix_dedup, token_files, topk
from taskweave.llm.attention import Shape
from taskweave.sources import delimited

spark = build_session(master="local[2]", shuffle_partitions=2)


def lacks(_):
    try:
        import taskweave
    except ModuleNotFoundError:
        return [True]
    return [False]


assert spark.sparkContext.parallelize([0], 1).mapPartitions(lacks).collect() == [True]
docs = spark.createDataFrame([(i, f"some words {{i % 3}}\\n" + "and a line that stands in all of them " * 9, "en", "a") for i in range(8)], "doc_id long, text string, lang string, source string")
labels = spark.createDataFrame([(1, 1, 0)], "doc_id long, quality int, toxic int")
vectors = spark.createDataFrame([(i, [float(i % 3), float(i)]) for i in range(9)], "vec_id long, embedding array<double>")
ranks = byte_bpe.load_ranks(public.path("byte_bpe_multi_50k.tiktoken"))
small = Shape(width=4, mixtures=3, window=8, stride=4, steps=4, batch=4)
results = {{
    "op1": byte_bpe.encode_digest(spark, docs, ranks, public.PATTERN),
    "op3": token_files.read_shards(spark, token_files.write_shards(spark, docs, public.path("byte_bpe_50k.json"), 2), docs.select("doc_id")),
    "op4": simhash_dedup.near_duplicates(spark, docs),
    "op5": topk.search(spark, vectors, k=2, query_every=3),
    "op7": quality.judge(spark, docs),
    "op8": line_dedup.dedup_lines(spark, docs),
    "op10": lm_scoring.score_documents(spark, docs, ranks, shape=small),
    "op11": centroids.cluster_vectors(spark, vectors, k=2, rounds=2, dims=2),
    "op12": suffix_dedup.remove_repeats(spark, docs),
    "op13": filter_audit.audit_filters(spark, docs, labels),
}}
with open("quoted.csv", "w") as f:
    f.write('id,a\\n1,"x\\ny"\\n2,z\\n')
results["csv"] = delimited.read_delimited(spark, "file:///" + sys.argv[1] + "/quoted.csv", "id INT, a STRING", multi_line=True)
print({{name: df.count() for name, df in results.items()}})
'''


def test_workers_without_the_package(tmp_path):
    env = {k: v for k, v in os.environ.items() if k != "PYTHONPATH"}
    keep = [p for p in os.environ.get("PYTHONPATH", "").split(os.pathsep) if p and os.path.abspath(p) != ROOT]
    if keep:
        env["PYTHONPATH"] = os.pathsep.join(keep)
    out = subprocess.run([sys.executable, "-c", SCRIPT, str(tmp_path)], cwd=tmp_path, env=env, capture_output=True, text=True, timeout=600)
    assert out.returncode == 0, out.stderr[-3000:]
    counts = eval(out.stdout.strip().split("\n")[-1])
    assert counts == {"op1": 8, "op3": 8, "op4": 8, "op5": 6, "op7": 8, "op8": 8, "op10": 8, "op11": 9, "op12": 8, "op13": 600, "csv": 2}
