import random
import re
from collections import defaultdict

from creditspark.llm import substrings
from creditspark.llm.substrings import remove_repeats


def plain(rows, width):
    found = {n: re.findall(r"[^\x20\x09-\x0D]+", t or "") for n, (_, t) in enumerate(rows)}
    first = defaultdict(list)
    for n, (doc, _) in enumerate(rows):
        for i in range(len(found[n]) - width + 1):
            if doc is not None:
                first[tuple(found[n][i : i + width])].append(doc)
    out = []
    for n, (doc, _) in enumerate(rows):
        gone = set()
        for i in range(len(found[n]) - width + 1):
            if doc is not None and min(first[tuple(found[n][i : i + width])]) < doc:
                gone |= set(range(i, i + width))
        out.append((doc, len(found[n]), len(gone), " ".join(w for i, w in enumerate(found[n]) if i not in gone)))
    return sorted(out, key=repr)


def rows():
    random.seed(11)
    text = lambda n, v=8: " ".join(random.choice("abcdefghij"[:v]) for _ in range(n))
    hot = text(30)
    out = [(i, text(random.randint(0, 60), 6)) for i in range(60)]
    out += [(100 + i, text(10) + " " + hot + "\n" + text(10)) for i in range(40)]
    out += [(300, None), (301, ""), (302, " \t"), (303, hot), (303, hot), (None, hot), (304, "É é " * 40), (305, "é É " * 40), (306, text(4000, 3))]
    return out


def check(spark, data, width):
    df = spark.createDataFrame([(d, t, "x", 0) for d, t in data], "doc_id long, text string, hashes string, n_words int")
    got = remove_repeats(df, width).collect()
    assert sorted(((r.doc_id, r.n_words, r.n_removed, r.kept_text) for r in got), key=repr) == plain(data, width)
    for r in got:
        assert sum(s.end - s.start for s in r.spans) == r.n_removed
        assert all(a.end < b.start for a, b in zip(r.spans, r.spans[1:]))


def test_equals_brute_force(spark):
    check(spark, rows(), 5)
    check(spark, rows(), 13)


def test_equals_brute_force_when_tasks_send_often(spark, monkeypatch):
    import numpy as np

    texts = [(3, np.array([1, 2, 1 << 63], np.uint64)), (1, np.array([1 << 63, 7], np.uint64)), (3, np.array([2], np.uint64))]
    batch = substrings.to_buckets(texts, 4).to_pydict()
    rows_ = {b: (np.frombuffer(d, np.int64).tolist(), np.frombuffer(h, np.uint64).tolist()) for b, d, h in zip(batch["bucket"], batch["docs"], batch["hashes"])}
    assert rows_[0] == ([1, 3], [7, 1, 2]) and rows_[2] == ([1], [1 << 63])
    assert [v for k, v in rows_.items() if k < 0] == [([3], [1 << 63])]


def test_empty_table(spark):
    empty = spark.createDataFrame([], "doc_id long, text string")
    assert remove_repeats(empty).count() == 0
    nulls = spark.createDataFrame([(1, None), (None, None)], "doc_id long, text string")
    assert [(r.n_words, r.kept_text) for r in remove_repeats(nulls).collect()] == [(0, ""), (0, "")]


def test_decided_windows_of_copies_are_dealt_over_the_buckets(spark, monkeypatch):
    from pyspark.sql import functions as F

    monkeypatch.setattr(substrings, "HELD", 300)
    monkeypatch.setattr(substrings, "DECIDED", 64, raising=False)
    text = " ".join(f"w{i}" for i in range(112))  # every chunk is three copies, and has 200 decided windows
    docs = spark.range(240).select(F.col("id").alias("doc"), F.lit(text).alias("text")).repartition(8)
    sizes = {}

    class Grouped:
        def __init__(self, rows):
            self.rows = rows

        def applyInArrow(self, meet, schema):
            for r in self.rows.where("bucket < 0").collect():
                sizes[r.bucket] = sizes.get(r.bucket, 0) + len(r.hashes) // 8
            return self.rows

    kind = type(docs)
    with monkeypatch.context() as m:
        m.setattr(kind, "groupBy", lambda self, *_: Grouped(self))
        substrings.repeated_hashes(docs, 13, 16)
    total = sum(sizes.values())
    assert total > 10_000 and len(sizes) == 16 and max(sizes.values()) < 2 * total / 16
    rows_ = [(i, text) for i in range(12)]
    check(spark, rows_, 13)


def test_identifiers_of_any_type(spark):
    name = lambda d: None if d is None else f"doc-{d:04d}"
    data = [(name(d), t) for d, t in rows()]
    got = remove_repeats(spark.createDataFrame(data, "doc_id string, text string"), 5)
    assert dict(got.dtypes)["doc_id"] == "string"
    assert sorted(((r.doc_id, r.n_words, r.n_removed, r.kept_text) for r in got.collect()), key=repr) == plain(data, 5)
    assert remove_repeats(spark.createDataFrame([], "doc_id string, text string")).collect() == []
    small = spark.createDataFrame([(1, "a b c"), (2, "a b c")], "doc_id int, text string")
    assert sorted((r.doc_id, r.n_removed) for r in remove_repeats(small, 2).collect()) == [(1, 0), (2, 3)]


def test_a_task_for_every_bucket(spark, monkeypatch):
    monkeypatch.setattr(substrings, "BUCKET_BYTES", 1000)
    check(spark, rows(), 5)
    docs = spark.createDataFrame(rows(), "doc long, text string").where("doc is not null and text is not null")
    assert substrings.repeated_hashes(docs, 5, 37).rdd.getNumPartitions() == 37
