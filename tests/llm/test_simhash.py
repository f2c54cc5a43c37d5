import random

import numpy as np
import xxhash

from creditspark.llm.graph import components
from creditspark.llm.simhash import fingerprint, linked, near_duplicates, near_links


def plain_fingerprint(text, k=3):
    import re

    w = re.findall(r"[^\x20\x09-\x0D]+", "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or ""))
    if not w:
        return "0" * 16
    grams = [" ".join(w[i : i + k]) for i in range(len(w) - k + 1)] or [" ".join(w)]
    h = [xxhash.xxh64_intdigest(g.encode(), 42) for g in grams]
    return f"{sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h)):016x}"


def plain_components(ids, marks, distance=2):
    root = {m: m for m in marks}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    values = sorted(set(marks))
    for i, a in enumerate(values):
        for b in values[:i]:
            if (int(a, 16) ^ int(b, 16)).bit_count() <= distance:
                root[find(a)] = find(b)
    first = {}
    for i, m in zip(ids, marks):
        r = find(m)
        first[r] = min(first.get(r, i), i)
    return [first[find(m)] for m in marks]


def test_fingerprints():
    for t in [None, "", " \n", "one", "Two Words", "a b c", "a b c a b c a b c", "É é É é", "x " * 5000, "w" * 100_000]:
        assert fingerprint(t, 3).hex() == plain_fingerprint(t)


def test_rows_equal_brute_force(spark):
    random.seed(4)
    vocab = [f"w{i}" for i in range(60)]
    texts = [None, "", "  ", "a", "A", "a b", "A  b"]
    for _ in range(12):
        base = [random.choice(vocab) for _ in range(400)]
        texts.append(" ".join(base))
        for _ in range(6):
            near = list(base)
            near[random.randrange(400)] = random.choice(vocab)
            texts.append(" ".join(near))
    texts += [texts[8]] * 4
    rows = [(i, t, "x") for i, t in enumerate(texts)]
    random.shuffle(rows)
    df = spark.createDataFrame(rows, "doc_id long, text string, fingerprint string")
    got = {r.doc_id: r for r in near_duplicates(df).collect()}
    marks = [plain_fingerprint(t) for t in texts]
    assert [got[i].fingerprint for i in range(len(texts))] == marks
    assert [got[i].component_id for i in range(len(texts))] == plain_components(range(len(texts)), marks)


def test_links_join_exactly_the_near_fingerprints(spark):
    random.seed(9)
    marks = {random.getrandbits(64) for _ in range(150)}
    for m in list(marks)[:60]:
        for bits in (1, 2, 3):
            near = m
            for b in random.sample(range(64), bits):
                near ^= 1 << b
            marks.add(near)
    names = [f"{m:016x}" for m in marks]
    links = near_links(spark.createDataFrame([(n,) for n in names], "fingerprint string"), 2)
    assert all((int(r.a, 16) ^ int(r.b, 16)).bit_count() <= 16 for r in links.collect())
    root = {r.node: r.root for r in components(links).collect()}
    want = plain_components(names, names)
    assert [root.get(n, n) for n in names] == want


def test_crowded_postings_are_searched_by_flips():
    random.seed(1)
    values = np.unique(np.array([random.getrandbits(16) for _ in range(3000)], dtype=np.uint64))
    free = np.array([1 << i for i in range(16)], dtype=np.uint64)
    a, b = linked(values, free, 2)
    got = {(min(x, y), max(x, y)) for x, y in zip(a.tolist(), b.tolist())}
    want = {(i, j) for i in range(len(values)) for j in np.flatnonzero(np.bitwise_count(values ^ values[i]) <= 2).tolist() if i < j}
    assert got == want


def test_empty_table_and_repeated_rows(spark):
    assert near_duplicates(spark.createDataFrame([], "doc_id long, text string")).count() == 0
    df = spark.createDataFrame([(None, "a b c"), (5, "a b c"), (5, "a b c"), (None, "q r s t u")], "doc_id long, text string")
    assert sorted((r.doc_id, r.component_id) for r in near_duplicates(df).collect() if r.doc_id) == [(5, 5), (5, 5)]
    assert sorted(str(r.component_id) for r in near_duplicates(df).collect()) == ["5", "5", "5", "None"]


def test_components_of_chains_and_stars(spark):
    random.seed(6)
    links = [(i, i + 1) for i in range(200)] + [(1000, 1000 + i) for i in range(1, 300)] + [(5000, 5000), (None, 3), (4, None), (2, 1), (1, 2)]
    random.shuffle(links)
    got = {r.node: r.root for r in components(spark.createDataFrame(links, "a long, b long")).collect()}
    assert got == {**{i: 0 for i in range(201)}, **{1000 + i: 1000 for i in range(300)}}
