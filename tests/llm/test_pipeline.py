"""The pipeline's stages against brute force on a small folder."""

from __future__ import annotations

import collections
import random

import pytest
from pyspark.sql import functions as F

from test_operators import edited, feasible, plain_components, plain_judge, words
from wayfare.llm import pu_quality, sharding
from wayfare.llm.queries import learnable

corpus_pipeline = pytest.importorskip("corpus_pipeline")


@pytest.fixture(scope="module")
def folder(spark, tmp_path_factory):
    at = str(tmp_path_factory.mktemp("corpus"))
    rng = random.Random(4)
    base = [words(80, i, 2000) for i in range(40)]
    item = words(30, 99, 4000)
    rows = [(i, base[i % 40] if i < 40 else edited(base[i % 40], rng.randrange(0, 4), rng), "ab"[i % 2]) for i in range(100)]
    rows += [(200 + i, words(20, 300 + i) + " " + item + " " + words(20, 400 + i), "a") for i in range(5)]
    rows += [(300 + i, " ".join(f"JUNK{rng.randrange(4)}!!" for _ in range(60)), "b") for i in range(60)]
    rows += [(400, None, "a"), (401, "", None), (402, base[1], "b"), (2, base[2], "a"), (None, words(50, 77), "a"), (403, "long " + words(30_000, 5, 9000), "b")]
    spark.createDataFrame([(i, t, "en", s, len(t or "")) for i, t, s in rows], "doc_id long, text string, lang string, source string, n_chars int").coalesce(2).write.parquet(f"{at}/documents.parquet")
    spark.createDataFrame([(1, item), (2, None)], "item_id long, text string").coalesce(1).write.parquet(f"{at}/benchmark.parquet")
    labels = [(i, 1, 0) for i in range(0, 100, 2)] + [(300 + i, 0, 0) for i in range(0, 60, 2)]
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int").coalesce(1).write.parquet(f"{at}/labels.parquet")
    return at


def test_stages_by_brute_force(spark, folder):
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    columns = docs.columns
    stages = dict(corpus_pipeline.STAGES)
    assert list(stages) == ["quality", "near_copies", "decontaminate", "mix", "shard"]
    of = lambda df: [(r["doc_id"], r["text"]) for r in df.collect()]

    kept = stages["quality"](spark, docs, folder).cache()
    model = pu_quality.fit(docs, learnable(spark.read.parquet(f"{folder}/labels.parquet")))
    score = collections.defaultdict(list)
    for r in pu_quality.with_scores(docs, model, "text", "q").collect():
        score[(r["doc_id"], r["text"])].append(r["q"])
    want = collections.Counter(k for k, v in score.items() for q in v if q >= 0.3)
    assert collections.Counter(of(kept)) == want and kept.columns == columns
    assert sum(i is not None and i < 100 for i, _ in of(kept)) >= 95 and sum(i is not None and 300 <= i < 360 for i, _ in of(kept)) <= 5

    one = stages["near_copies"](spark, kept, folder).cache()
    rows = of(kept)
    found = {}
    for i, n, c in plain_components(rows, 5, 4, 5):
        found.setdefault(i, (n, c))
    want = collections.Counter((i, t) for i, t in rows if found[i][0] == 0 or i is None or found[i][1] == i)
    assert collections.Counter(of(one)) == want and one.columns == columns

    clean = stages["decontaminate"](spark, one, folder).cache()
    rows = of(one)
    items = [(r["item_id"], r["text"]) for r in spark.read.parquet(f"{folder}/benchmark.parquet").collect()]
    bad = {i for i, *_, hit in plain_judge(rows, items) if hit}
    assert bad == set(range(200, 205)) & {i for i, _ in rows}
    assert collections.Counter(of(clean)) == collections.Counter((i, t) for i, t in rows if i not in bad) and clean.columns == columns

    mixed = stages["mix"](spark, clean, folder).cache()
    assert set(of(mixed)) <= set(of(clean)) and mixed.columns == columns
    sizes = {r["source"]: r["b"] for r in mixed.groupBy("source").agg(F.sum(F.octet_length("text")).alias("b")).collect()}
    assert set(sizes) <= {"a", "b", None}

    placed = stages["shard"](spark, mixed, folder)
    assert placed.columns == [*columns, "shard"] and placed.count() == mixed.count()
    load, groups = collections.Counter(), collections.Counter()
    for r in placed.withColumn("h", F.xxhash64(F.coalesce("text", F.lit("")))).collect():
        n = len((r["text"] or "").encode()) + 1
        load[r["shard"]] += n
        groups[r["h"]] += n
    assert feasible([groups[h] for h in sorted(groups)], max(load.values()), 16)
    assert not feasible([groups[h] for h in sorted(groups)], max(load.values()) - 1, 16)
    assert max(load.values()) >= sharding.shard_bounds(mixed.select(F.xxhash64(F.coalesce("text", F.lit(""))).alias("h"), (F.octet_length(F.coalesce("text", F.lit(""))) + 1).cast("long").alias("size")), 16)[0]


def test_run_is_the_stages_in_turn(spark, folder):
    out = corpus_pipeline.run(spark, folder)
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    for _, stage in corpus_pipeline.STAGES:
        docs = stage(spark, docs, folder)
    count = lambda df: collections.Counter((r["doc_id"], r["text"], r["shard"]) for r in df.collect())
    assert count(out) == count(docs)


def test_run_on_empty_tables(spark, folder, tmp_path):
    for name in ("documents", "benchmark", "labels"):
        spark.read.parquet(f"{folder}/{name}.parquet").limit(0).write.parquet(f"{tmp_path}/{name}.parquet")
    assert corpus_pipeline.run(spark, str(tmp_path)).count() == 0
