import random
import re
from collections import defaultdict

import pytest

from creditspark.llm.mixing import mix, mixed, source_targets


def plain_targets(sizes, weights=(3, 1, 2), share=1.5, most=2.0):
    names = sorted(sizes, key=lambda s: (s is None, s or ""))
    w = {s: weights[i % len(weights)] for i, s in enumerate(names)}
    left, target, open_ = share * sum(sizes.values()), {}, set(names)
    while open_:
        level = left / sum(w[s] for s in open_)
        over = [s for s in open_ if level * w[s] > most * sizes[s]]
        if not over:
            return target | {s: level * w[s] for s in open_}
        for s in over:
            target[s] = most * sizes[s]
            left -= target[s]
            open_.remove(s)
    return target


def test_targets_equal_the_rounds(spark):
    random.seed(8)
    for _ in range(6):
        sizes = {s: random.choice([0, 1, 10, 100, 5000]) + random.randint(0, 9) for s in random.sample(["a", "b", "Z", "é", "src10", "src9", ""], 5)}
        sizes[None] = 40
        df = spark.createDataFrame(list(sizes.items()), "source string, source_size long")
        got = {r.source: r.target for r in source_targets(df).collect()}
        want = plain_targets(sizes)
        assert got.keys() == want.keys()
        assert all(got[s] == pytest.approx(want[s], rel=1e-12, abs=1e-9) for s in want)


def corpus(n=1500):
    random.seed(12)
    rows = [(i, random.choice(["hot", "hot", "hot", "a", "b", "c", None]), "w " * random.randint(0, 40), i) for i in range(n)]
    return rows + [(n, "a", None, 0), (n + 1, "b", "", 0), (n + 2, "tiny", "one", 0), (n + 3, "long", "x " * 3000, 0), (n + 4, "void", " ", 0)]


def test_every_source_comes_near_its_target(spark):
    rows = corpus()
    df = spark.createDataFrame(rows, "doc_id long, source string, text string, size int")
    got = mix(df, chunk=8).collect()
    size = {i: len(re.findall(r"[^\x20\x09-\x0D]+", t or "")) for i, _, t, _ in rows}
    totals, taken, largest = defaultdict(int), defaultdict(int), defaultdict(int)
    for i, s, _, _ in rows:
        totals[s] += size[i]
        largest[s] = max(largest[s], size[i])
    want = plain_targets(totals)
    assert sorted(r.doc_id for r in got) == sorted(i for i, *_ in rows)
    for r in got:
        assert r.size == size[r.doc_id] and r.source_size == totals[r.source]
        assert r.target == pytest.approx(want[r.source]) and r.taken == r.copies * r.size <= 2 * r.size
        taken[r.source] += r.taken
    for s in totals:
        assert abs(taken[s] - want[s]) <= largest[s] + 1e-6, s
    again = mix(df.repartition(7), chunk=8).collect()
    assert sorted(map(tuple, got), key=repr) == sorted(map(tuple, again), key=repr)


def test_copies_are_right_on_average(spark):
    df = spark.createDataFrame([(i, "s", "w " * (1 + i % 5)) for i in range(60)] + [(99, "t", "w " * 30)], "doc_id long, source string, text string")
    total = defaultdict(float)
    for seed in range(20):
        for r in mix(df, weights=(1, 0.05), most=1.6, seed=seed, chunk=6).where("source = 's'").collect():
            total[r.doc_id % 5] += r.copies / 20 / 12
            rate = r.target / r.source_size
    assert all(abs(v - rate) < 0.15 for v in total.values()), (total, rate)


def test_the_mix_repeats_whole_rows(spark):
    rows = corpus(200) + [(5000, "a", "r r r", 1), (5000, "a", "r r r", 2), (None, "a", "n n", 3)]
    df = spark.createDataFrame(rows, "doc_id long, source string, text string, size int")
    copies = defaultdict(int)
    for r in mix(df).collect():
        copies[r.doc_id] += r.copies
    seen = defaultdict(int)
    for r in mixed(df).collect():
        seen[r.doc_id] += 1
    assert mixed(df).columns == df.columns
    assert {k: v for k, v in copies.items() if v} == dict(seen)


def test_empty_tables(spark):
    empty = spark.createDataFrame([], "doc_id long, source string, text string")
    assert mix(empty).count() == 0 and mixed(empty).count() == 0
    blank = spark.createDataFrame([(1, "a", None), (2, None, "")], "doc_id long, source string, text string")
    assert [r.taken for r in mix(blank).collect()] == [0, 0]


def test_a_large_chunk_decides_all_its_units(spark):
    df = spark.range(4400).selectExpr("id AS doc_id", "'s' AS source", "'one two' AS text")
    rows = mix(df, chunk=5000).collect()
    assert len(rows) == 4400 and {r.copies for r in rows} == {1, 2}
    assert abs(sum(r.taken for r in rows) - rows[0].target) <= 2
