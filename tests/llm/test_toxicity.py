import math
import random

import numpy as np
import pytest
import xxhash
from pyspark.sql import functions as F

from __spark_entry__ import queries
from creditspark.llm.toxicity import ALPHA, BETA, L1, L2, WordHashes, features, learned, toxicity

MASK = 2**64 - 1


def plain_features(text):
    """Words, neighbours, and words with one between, by whole numbers."""
    import re

    h = [xxhash.xxh3_64_intdigest(w.encode()) for w in re.findall(r"\w+", (text or "").lower())]

    def joined(a, b, kind):
        mixed = (a * kind & MASK) ^ (b >> 31 | b << 33 & MASK)
        return (mixed ^ mixed >> 29) * 0xD6E8FEB86659FD93 & MASK

    pairs = [joined(a, b, 0x9E3779B97F4A7C15) for a, b in zip(h, h[1:], strict=False)]
    return h + pairs + [joined(a, b, 0xC2B2AE3D27D4EB4F) for a, b in zip(h, h[2:], strict=False)]


def plain_ftrl(docs, labels, intercept, passes, seen_in):
    """The same learner with a dictionary for each coordinate."""
    seen = {}
    for doc in docs:
        for k in set(doc):
            seen[k] = seen.get(k, 0) + 1
    z, n = {0: -intercept * BETA / ALPHA}, {}

    def weight(k):
        own = z.get(k, 0.0)
        l1, l2 = (0, 0) if k == 0 else (L1, L2)
        return 0.0 if abs(own) <= l1 else (math.copysign(l1, own) - own) / ((BETA + math.sqrt(n.get(k, 0))) / ALPHA + l2)

    for _ in range(passes):
        for doc, label in zip(docs, labels, strict=True):
            at = [0, *sorted(k for k in set(doc) if seen[k] >= seen_in)]
            w = [weight(k) for k in at]
            g = 1 / (1 + math.exp(-sum(w))) - label
            for k, own in zip(at, w, strict=True):
                old = n.get(k, 0.0)
                z[k] = z.get(k, 0.0) + g - (math.sqrt(old + g * g) - math.sqrt(old)) / ALPHA * own
                n[k] = old + g * g
    return {k: weight(k) for k in z if weight(k)}


def corpus(n, seed=1):
    rng = random.Random(seed)
    words = ["".join(rng.choices("abcdefghij", k=4)) for _ in range(300)]
    rows = []
    for i in range(n):
        text, toxic = rng.choices(words, k=rng.randint(3, 40)), int(rng.random() < 0.2)
        if toxic:
            for w in rng.sample(["Vile", "rotten!", "awful"], 2):
                text.insert(rng.randint(0, len(text)), w)
        rows.append((i, " ".join(text), toxic))
    return rows


@pytest.mark.parametrize("text", [None, "", "  ", "One", "one TWO", "É a-b c, d! é\na b", "x " * 5000])
def test_features(text):
    assert sorted(features(text, WordHashes()).tolist()) == sorted(plain_features(text))


def test_learner_equals_plain_ftrl():
    rows = corpus(120)
    docs, labels = [np.unique(features(t, WordHashes())) for _, t, _ in rows], [y for *_, y in rows]
    keys, w = learned(docs, labels, -1.3, 3, 3)
    want = plain_ftrl([d.tolist() for d in docs], labels, -1.3, 3, 3)
    assert len(want) > 3 and dict(zip(keys.tolist(), w.tolist(), strict=True)) == pytest.approx(want)


def run(spark, rows, labels, **how):
    docs = spark.createDataFrame([(i, t, 1.5) for i, t in rows], "doc_id long, text string, score double")
    marks = spark.createDataFrame(labels, "doc_id long, toxic int")
    return toxicity(docs, marks, F.coalesce(F.col("doc_id") % 4 != 2, F.lit(True)), **how)


def test_scores_equal_the_mean_of_plain_learners(spark):
    rows = corpus(200)
    got = {r.doc_id: r for r in run(spark, [r[:2] for r in rows], [(i, y) for i, _, y in rows]).collect()}
    taught = [r for r in rows if r[0] % 4 != 2]
    turn = {r.i: r.h for r in spark.createDataFrame([(i,) for i, *_ in taught], "i long").select("i", F.xxhash64(F.col("i").cast("string"), F.lit(6)).alias("h")).collect()}
    taught.sort(key=lambda r: turn[r[0]])
    share = (sum(y for *_, y in taught) + 0.1) / (len(taught) + 1)
    model = plain_ftrl([plain_features(t) for _, t, _ in taught], [y for *_, y in taught], math.log(share / (1 - share)), 4, 3)
    for i, t, _ in rows:
        s = model[0] + sum(model.get(k, 0) for k in set(plain_features(t)))
        assert got[i].score == pytest.approx(1 / (1 + math.exp(-s))) and got[i].predicted == (got[i].score >= 0.3)


def test_several_learners_tell_held_out_documents(spark):
    rows = corpus(1200)
    df = run(spark, [r[:2] for r in rows], [(i, y) for i, _, y in rows], shard=150)
    got = {r.doc_id: r.predicted for r in df.collect()}
    held = [(got[i], y) for i, _, y in rows if i % 4 == 2]
    assert sum(p == y for p, y in held) > 0.97 * len(held)
    assert [r.score for r in df.orderBy("doc_id").collect()] == [r.score for r in run(spark, [r[:2] for r in reversed(rows)], [(i, y) for i, _, y in rows], shard=150).orderBy("doc_id").collect()]


def test_odd_rows(spark):
    rows = [(1, None), (2, ""), (3, "   "), (None, "some words"), (4, "vile " * 30_000), (4, "vile"), (5, "vile"), (5, "vile"), (7, "mild and dull")]
    labels = [(4, 1), (4, 1), (4, None), (5, 1), (5, 0), (7, 0), (7, 9), (None, 1), (99, 1)]
    df = run(spark, rows, labels)
    assert df.columns == ["doc_id", "score", "predicted"]
    got = df.collect()
    assert len(got) == len(rows) and all(0 < r.score < 1 for r in got)
    base = next(r.score for r in got if r.doc_id == 1)
    assert all(r.score == base for r in got if r.doc_id in (2, 3))
    assert {round(r.score, 9) for r in run(spark, rows, []).collect()} == {0.1}
    assert run(spark, [], labels).count() == 0


def test_query_tells_held_out_documents_of_the_table(spark):
    data = "/root/testdata/sf0.01"
    got = queries()["op12_toxicity"](spark, data).join(spark.read.parquet(f"{data}/labels.parquet"), "doc_id").where("held_out").collect()
    toxic, clean = [r.score for r in got if r.toxic], [r.score for r in got if not r.toxic]
    assert sum(a > b for a in toxic for b in clean) > 0.8 * len(toxic) * len(clean)
    assert sum(r.predicted for r in got if not r.toxic) <= 0.05 * len(clean)
