import math
import random
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from creditspark.llm import quality
from creditspark.llm.quality import TokenHashes, buckets_of, kth_largest, resample

LABELS = "doc_id long, quality int, toxic int"


def corpus():
    random.seed(3)
    good = lambda: " ".join(random.choice(["the", "and", "sea", "is", "calm"]) for _ in range(random.randint(5, 60)))
    bad = lambda: " ".join(random.choice(["BUY!!", "NOW!!", "$$$", "|", "the"]) for _ in range(random.randint(5, 60)))
    rows = [(i, bad() if i % 5 == 0 else good()) for i in range(400)]
    labels = [(i, int(i % 5 != 0), 0) for i in range(0, 400)] + [(None, 1, 0), (7, None, None), (99_999, 1, 0), (11, 1, 1)]
    return rows, labels


def plain_ratio(rows, good, buckets):
    known, raw, target = TokenHashes(), Counter(), Counter()
    for i, t in rows:
        raw.update(buckets_of(t, known, buckets).tolist())
        if i in good:
            target.update(buckets_of(t, known, buckets).tolist())
    n, m = sum(raw.values()) + buckets / 2, sum(target.values()) + buckets / 2
    return {i: sum(math.log((target[b] + 0.5) / m) - math.log((raw[b] + 0.5) / n) for b in buckets_of(t, known, buckets).tolist()) for i, t in rows}


def test_ratios_equal_plain_counts_and_bad_texts_go(spark):
    rows, labels = corpus()
    rows += [(1000, None), (1001, ""), (1002, "the sea " * 20_000)]
    df = spark.createDataFrame([(i, t, "x") for i, t in rows], "doc_id long, text string, kept string")
    got = resample(df, spark.createDataFrame(labels, LABELS), buckets=256).collect()
    numbers = spark.createDataFrame([(i,) for i, q, x in labels if q == 1 and not x and i is not None], "i long")
    aside = {r.i for r in numbers.where(F.pmod(F.xxhash64("i", F.lit(11)), F.lit(5)) == 0).collect()}
    good = {r.i for r in numbers.collect()} - aside
    want = plain_ratio(rows, good, 256)
    assert len(got) == len(rows)
    for r in got:
        assert r.log_ratio == pytest.approx(want[r.doc_id], rel=1e-9, abs=1e-9)
    kept = {r.doc_id for r in got if r.kept}
    level = min(want[i] for i in aside & want.keys())
    assert len(kept) == sum(r.log_ratio >= level - 1e-9 for r in got)
    assert {r.doc_id for r in sorted(got, key=lambda r: -r.gumbel_key)[: len(kept)]} == kept
    assert sum(i % 5 == 0 for i in kept if i < 400) <= 6
    half = resample(df, spark.createDataFrame(labels, LABELS), buckets=256, keep_share=0.5).where("kept").count()
    assert half == round(0.5 * len(rows))


def test_noise_is_gumbel(spark):
    g = np.array([r[0] for r in spark.range(4000).select(quality.gumbel(F.col("id"), 3)).collect()])
    assert g.mean() == pytest.approx(0.5772, abs=0.08) and g.std() == pytest.approx(1.2825, abs=0.08)


def test_kth_largest(spark):
    random.seed(1)
    values = [random.choice([0.0, 1.0, -1e300, 1e300, random.gauss(0, 1), random.gauss(0, 1e-9)]) for _ in range(500)]
    df = spark.createDataFrame([(v,) for v in values], "v double")
    for k in (1, 2, 100, 250, 499, 500, 900):
        assert kth_largest(df, "v", k) == sorted(values, reverse=True)[min(k, 500) - 1]
    assert kth_largest(df, "v", 0) is None


def test_odd_tables(spark):
    none = spark.createDataFrame([], LABELS)
    empty = spark.createDataFrame([], "doc_id long, text string")
    assert resample(empty, none).count() == 0
    same = spark.createDataFrame([(5, "a b"), (5, "a b"), (None, None)], "doc_id long, text string")
    assert [r.kept for r in resample(same, none).collect()] == [True] * 3
    rows = resample(same, spark.createDataFrame([(5, 0, 0)], LABELS)).collect()
    assert [(r.kept, r.log_ratio) for r in rows] == [(True, 0.0)] * 3
    assert not resample(same, none, keep_share=0.0).where("kept").count()
