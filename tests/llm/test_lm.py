import math
import random
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from creditspark.llm import lm
from creditspark.llm.lm import Mixer, Speller, counted, learned, score_texts
from creditspark.llm.text import held_out, words


def small_model():
    random.seed(2)
    types = sorted({("".join(random.choice(["the", "ing", "re", "on", "é"]) for _ in range(random.randint(1, 4)))).encode() for _ in range(400)})
    tables = np.array([t.reshape(-1, 2) for t in counted(iter([types]))], dtype=np.int32)
    return types, tables, learned(iter([types]), tables)[0]


def test_next_bytes_sum_to_one_and_learning_helps():
    types, tables, mixer = small_model()
    speller, nothing = Speller(tables, mixer), Speller(np.zeros_like(tables), Mixer())
    for prefix in (b"", b"th", b"rething", b"zz"):
        # the last byte before the word's end, over all bytes that can stand there
        last = []
        for b in range(256):
            token = prefix + bytes([b])
            last.append(2 ** speller.log2([token])[len(prefix)])
        assert sum(last) == pytest.approx(1.0, abs=1e-9)
    plain = nothing.log10(types).sum()
    assert plain == pytest.approx(-8 * math.log10(2) * sum(len(t) + 1 for t in types))
    unseen = [b"theonre", b"ingthere", b"rereon"]
    unseen = [u for u in unseen if u not in types]
    assert speller.log10(unseen).sum() > 0.5 * nothing.log10(unseen).sum()
    assert speller.log10(types).sum() > Speller(tables, Mixer()).log10(types).sum()


def plain_base(rows):
    train = Counter()
    tokens = lambda t: [*words(t, lower=True), lm.END]
    for _, text, teaches in rows:
        if teaches:
            train.update(tokens(text))
    n, v = train.total(), len(train)
    return {
        (i, text): (len(tokens(text)), sum(w in train for w in tokens(text)), n, sum(math.log10((train[w] + 1) / (n + v + 1)) for w in tokens(text)))
        for i, text, _ in rows
    }


@pytest.mark.parametrize("hot", [4, 250_000])
def test_rows_equal_plain_counts(spark, monkeypatch, hot):
    monkeypatch.setattr(lm, "HOT", hot)
    random.seed(7)
    vocab = [f"wort{i}" for i in range(40)] + ["The", "the", "É", "w" * 300]
    rows = [(i, " ".join(random.choice(vocab) for _ in range(random.randint(0, 50))), i % 4 > 0) for i in range(120)]
    rows += [(500, None, True), (501, "", False), (502, " \n", None), (503, "new words never met", False), (503, "new words never met", False), (None, "the the", True)]
    df = spark.createDataFrame([(*r, 0) for r in rows], "doc_id long, text string, teaches boolean, score int")
    got = score_texts(df, F.col("teaches")).collect()
    assert len(got) == len(rows)
    want = plain_base(rows)
    by_id = {r.doc_id: r for r in got}
    for (i, _), (n, known, train, base) in want.items():
        r = by_id[i]
        assert (r.n_tokens, r.n_known, r.train_tokens) == (n, known, train)
        assert r.base_score == pytest.approx(base, rel=1e-9)
        assert r.score < 0 and r.bits_per_byte > 0


def test_held_out_texts_cost_few_bits_and_groups_help(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text", "lang")
    out = held_out(F.col("doc_id"), 7)
    grouped, alone = (score_texts(docs, ~out, group=g).where(out).collect() for g in ("lang", None))
    assert np.mean([r.bits_per_byte for r in grouped]) < 3.2
    assert sum(r.score for r in grouped) > sum(r.score for r in alone)


def test_empty_and_untaught_tables(spark):
    df = spark.createDataFrame([(1, "ab c"), (2, None)], "doc_id long, text string")
    assert score_texts(df.limit(0), F.lit(True)).count() == 0
    rows = {r.doc_id: r for r in score_texts(df, F.lit(None).cast("boolean")).collect()}
    assert rows[1].bits_per_byte == pytest.approx(8.0) and rows[1].train_tokens == 0 and rows[2].n_tokens == 1
    assert rows[1].score == pytest.approx(-8 * 6 * math.log10(2))


def test_bits_are_learned_from_whole_texts_across_word_ends(spark):
    # every word is as frequent as any other and follows one other only
    taught = "red fox jumps over nine lazy dogs near old mills"
    shuffled = "mills nine red over dogs fox old lazy jumps near"
    rows = [(i, taught, True) for i in range(60)] + [(100, taught, False), (101, shuffled, False)]
    df = spark.createDataFrame(rows, "doc_id long, text string, teaches boolean")
    got = {r.doc_id: r for r in score_texts(df, F.col("teaches")).collect()}
    assert got[100].base_score == pytest.approx(got[101].base_score)
    assert got[100].score > got[101].score + 5


def test_every_teaching_byte_is_counted_once_as_often_as_it_stands(spark, monkeypatch):
    monkeypatch.setattr(lm, "PIECE", 90)
    texts = ["The cat  sat\n", "", None, "the cat sat", "x" * 500, "word " * 60]
    df = spark.createDataFrame([(t, True, None) for t in [*texts, *texts]], "text string, teaches boolean, grp string")
    learnt = lm.learn_words(df)
    raw = [b" ".join([*words(t, lower=True), lm.END]) for t in texts]
    seen = sum(len(spelled.keys) for _, spelled in learnt.reader.spellings(words(t, lower=True) for t in texts))
    assert seen == sum(map(len, raw))
    tables, _ = lm.teach(df.select("text"), spark.sparkContext.broadcast(learnt.reader))
    bits = 2 * sum(learnt.reader.code.length[s.keys].sum() for _, s in learnt.reader.spellings(words(t, lower=True) for t in texts))
    assert tables.sum(axis=(1, 2)).tolist() == [bits] * lm.PREDICTORS


def test_codes_hold_every_byte_and_next_bytes_sum_to_nearly_one():
    code = lm.Code(np.array([lm.START] * 3 + [lm.STOP[0] * 256 + 97] * 2), np.array([97, 98, 10, 98, 32]), np.array([5, 1, 9, 2, 1]))
    read = lm.Reader(code)
    tables = np.zeros((lm.PREDICTORS, 1 << lm.SLOT_BITS, 2), dtype=np.int32)
    mixer, seen = learned(read.spellings(iter([[b"ab", b"a"], [b"a"]] * 50)), tables, lambda some: some[1])
    assert seen == 50 * 9
    speller = Speller(tables, mixer)
    for prefix in (b"", b"a", b"ab a", b"z"):
        last = [2 ** speller.bytes_log2(lm.Spelling([prefix + bytes([b])], code=code))[len(prefix)] for b in range(256)]
        # what an escape says of bytes that have a path of their own is never used
        assert 1 - 1e-3 < sum(last) < 1 + 1e-6


def test_counters_of_a_byte_lie_together_and_apart_from_one_another():
    pairs = [(lm.START, 97, 5), (lm.START, 98, 2), *((lm.STOP[0] * 256 + 97, b, 1 + b % 7) for b in range(97, 123))]
    code = lm.Code(*np.array(pairs).T)
    spelled = lm.Spelling([b"ab" * 50 + b"\n", b"az" + bytes(range(128, 160)), b"a"], code=code)
    seen = 0
    for _, length, _, slots in spelled.parts():
        byte = np.repeat(np.arange(len(length)), length)
        own = code.length[spelled.keys[seen : seen + len(length)]] <= 6
        for slot in slots:
            # a path of own nodes stays within 64 counters, one cache line of opinions
            assert len(np.unique(np.stack([byte, slot >> 6])[:, own[byte]], axis=1).T) == own.sum()
            assert len(np.unique(np.stack([byte, slot]), axis=1).T) == len(slot)
        seen += len(length)
    assert seen == len(spelled.keys)


def test_frequent_words_are_as_many_as_fit(spark, monkeypatch):
    monkeypatch.setattr(lm, "HOT", 3)
    rows = [(b"a", 90), (b"b", 40), (b"c", 10), (b"d", 2), (b"e", 2), (b"f", 1), (b"w" * 300, 500)]
    counts = spark.createDataFrame(rows, "word binary, n long")
    assert sorted(bytes(r.word) for r in lm.frequent(counts).collect()) == [b"a", b"b", b"c"]
    assert lm.frequent(counts.limit(0)).count() == 0


def test_words_are_tallied_and_read_plainly():
    texts = [None, "", "  ", "The\tthe  É\x0bx ", "a b", "\na", "x y   z"]
    for t in texts:
        assert lm.plain(t) + lm.END == b" ".join([*words(t, lower=True), lm.END])
    tokens = [words(t, lower=True) for t in texts]
    row, word, c, met = lm.tallied(tokens)
    got = [(r, w, n) for r, w, n in zip(row.tolist(), met.take(word).to_pylist(), c.tolist(), strict=True)]
    assert sorted(got) == sorted((i, w, n) for i, t in enumerate(tokens) for w, n in Counter(t).items())
    assert [len(x) for x in lm.tallied([])] == [0] * 4
