"""Shuffle files of a scratch table go when it is written, not when the driver collects its garbage."""

from __future__ import annotations

import glob
import os
import time

from pyspark.sql import functions as F
from tidemark.llm import ngram_jaccard as op
from tidemark.llm.scratch import TIDY, Scratch


def shuffled(spark):
    root = os.path.dirname(spark._jvm.org.apache.spark.SparkEnv.get().blockManager().diskBlockManager().localDirsString()[0])
    return set(glob.glob(f"{root}/**/shuffle_*", recursive=True))


def test_tidy_scratch(spark):
    before, had = shuffled(spark), spark.conf.get(TIDY, None)
    sums = spark.range(50_000).groupBy((F.col("id") % 100).alias("k")).agg(F.sum("id").alias("s"))
    out = Scratch(spark, "plain").save(sums, "sums")
    left = shuffled(spark) - before
    assert left and out.count() == 100
    before = shuffled(spark)
    out = Scratch(spark, "tidy", tidy=True).save(sums, "sums")
    for _ in range(100):  # files are deleted meanwhile
        if not shuffled(spark) - before:
            break
        time.sleep(0.1)
    assert not shuffled(spark) - before
    assert out.count() == 100 and out.agg(F.sum("s")).first()[0] == 50_000 * 49_999 // 2
    assert sums.count() == 100 and spark.conf.get(TIDY, None) == had


def test_jaccard_is_tidy(spark):
    made, own = [], op.Scratch
    op.Scratch = lambda *a, **k: made.append(own(*a, **k)) or made[-1]
    try:
        docs = spark.createDataFrame([(1, "a b c d e f g h"), (2, "a b c d e f g h"), (3, "x y"), (4, None)], "doc_id long, text string")
        rows = {r.doc_id: r.component_id for r in op.ngram_jaccard(docs).collect()}
    finally:
        op.Scratch = own
    assert rows == {1: 1, 2: 1, 3: 3, 4: 4}
    assert made[0].tidy
