import hashlib
import random
from collections import defaultdict

import pytest
from pyspark.sql import functions as F

from creditspark.llm.exact import OF_RUN, as_is, content_sort, exact_duplicates


def brute(rows, keep):
    groups = defaultdict(list)
    for i, t, *_ in rows:
        groups[t or ""].append(i)
    best = {t: (max if keep == "largest" else min)([i for i in ids if i is not None], default=None) for t, ids in groups.items()}
    return sorted(((i, best[t or ""], len(groups[t or ""]), hashlib.sha256((t or "").encode()).hexdigest()) for i, t, *_ in rows), key=repr)


DIGESTS = {"own": F.xxhash64, "one for all": lambda c: F.lit(1).cast("long"), "two": lambda c: F.length(c).cast("long") % 2}


@pytest.mark.parametrize("digest", DIGESTS)
@pytest.mark.parametrize("run", [10_000, 7])
@pytest.mark.parametrize("keep", ["largest", "smallest"])
def test_equals_brute_force(spark, keep, run, digest):
    """Also where the hash tells no texts apart, and where frequent texts are dealt to runs."""
    random.seed(2)
    long = "p" * 40_000
    texts = [None, "", " ", "a", "A", "hot", "hot", "hot", long, long + "x", "é", "é", "x" * 32 + "1", "x" * 32 + "2"]
    rows = [(i, random.choice(texts), "k", i % 3) for i in range(300)] + [(1000 + i, f"one {i}", "k", 0) for i in range(50)]
    rows += [(7, "hot", "k", 0)] * 5 + [(None, "hot", "k", 0), (None, "alone", "k", 0), (None, "alone", "k", 0)]
    df = spark.createDataFrame(rows, "doc_id long, text string, kept string, __salt int")
    out = exact_duplicates(df, keep=keep, run=run, digest=DIGESTS[digest])
    assert out.columns == ["doc_id", "text", "__salt", "keep_id", "group_size", "kept", "text_sha256"]
    got = out.collect()
    assert sorted(((r.doc_id, r.keep_id, r.group_size, r.text_sha256) for r in got), key=repr) == brute(rows, keep)
    assert len({r.text_sha256 for r in got}) == sum(r.kept for r in got)
    assert all(r.doc_id == r.keep_id for r in got if r.kept)


def test_empty_table_and_null_texts(spark):
    empty = spark.createDataFrame([], "doc_id long, text string")
    assert exact_duplicates(empty).count() == 0
    nulls = spark.createDataFrame([(2, None), (3, None)], "doc_id long, text string")
    assert [(r.keep_id, r.group_size) for r in exact_duplicates(nulls).collect()] == [(2, 2), (2, 2)]


def test_wrong_choice(spark):
    with pytest.raises(ValueError):
        exact_duplicates(spark.createDataFrame([], "doc_id long, text string"), keep="first")


@pytest.mark.parametrize("digest", DIGESTS)
def test_neighbours_that_are_equal_in_full_make_the_groups(spark, digest):
    """Without hot texts a run of equal neighbours is a group, so comparisons alone join all copies."""
    rows = [(i, f"text {i % 40}" if i % 3 else "same beginning of some length, and then " + str(i % 7)) for i in range(400)]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    runs = content_sort(df, "doc_id", "text", as_is, "largest", 10_000, DIGESTS[digest])
    assert runs.select(*OF_RUN).distinct().count() == len({t for _, t in rows}) == runs.select("__text").distinct().count()
    assert runs.groupBy(*OF_RUN).agg(F.countDistinct("text").alias("n")).where("n > 1").count() == 0
    hot = content_sort(df, "doc_id", "text", as_is, "largest", 10, F.xxhash64).where("__hot")
    assert 7 < hot.select(*OF_RUN).distinct().count() <= 7 * 4 and {r[0][:4] for r in hot.select("text").collect()} == {"same"}
