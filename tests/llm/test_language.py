import random

import numpy as np
import public_tokenizers
import pytest
from pyspark.sql import functions as F

from creditspark.llm import language
from creditspark.llm.text import held_out

PATH = public_tokenizers.path("piece_bpe_32k.model")


def plain_sum(p, pieces, word):
    """Sum over all segmentations, one by one."""
    if not word:
        return 1.0
    return sum(p[i] * plain_sum(p, pieces, word[len(q):]) for i, q in enumerate(pieces) if word.startswith(q))


def test_forward_and_expected_counts_equal_all_segmentations():
    rng = np.random.default_rng(0)
    pieces = sorted({bytes([b]) for b in b" abc"} | {b" a", b"ab", b"abc", b"bc", b" ab", b"ca"})
    p = rng.random((len(pieces), 2))
    p /= p.sum(axis=0)
    found = language.Pieces(pieces)
    words = ["a", "abc", "abcabca", "b", "cab"]
    places = found.places(words)
    alpha = language.forward(p, places)
    for k in range(2):
        got = alpha[places[4]][:, k]
        assert got == pytest.approx([plain_sum(p[:, k], pieces, b" " + w.encode()) for w in words])
    n = np.array([1.0, 2.0, 3.0, 1.0, 5.0])
    counts = language.expected(p[:, 0], places, n, len(pieces))
    step = 1e-6  # the expected count is p times the slope of the log-likelihood
    like = lambda q: sum(c * np.log(plain_sum(q, pieces, b" " + w.encode())) for c, w in zip(n, words))
    for i in range(len(pieces)):
        up, down = p[:, 0].copy(), p[:, 0].copy()
        up[i] += step
        down[i] -= step
        assert counts[i] == pytest.approx(p[i, 0] * (like(up) - like(down)) / (2 * step), rel=1e-4, abs=1e-6)


def test_words():
    assert language.letter_words("Ab1c ÉÀ_x²y—ß 42 !") == ["ab", "c", "éà", "x", "y", "ß"]
    assert language.letter_words(None) == language.letter_words("12 ½²") == []
    assert [len(w) for w in language.letter_words("q" * 100)] == [40, 40, 20]


def test_held_out_accuracy_and_odd_rows(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text", "lang", F.lit(9).alias("score"))
    odd = [(10_000, None, "en"), (10_001, "", "de"), (10_002, "123 !!", "fr"), (10_003, "the the of and", None), (10_003, "the the of and", None), (None, "der " * 9000, "de"), (10_004, "x" * 50_000, None)]
    docs = docs.union(spark.createDataFrame(odd, "doc_id long, text string, lang string").withColumn("score", F.lit(9)))
    rows = language.identify(docs, ~held_out(F.col("doc_id"), 4), PATH).withColumn("out", held_out(F.col("doc_id"), 4)).collect()
    assert len(rows) == docs.count()
    by_id = {r.doc_id: r for r in rows}
    assert [by_id[i].lang_pred for i in (10_000, 10_001, 10_002)] == ["und"] * 3
    assert by_id[10_003].lang_pred == "en"
    assert all(0 <= r.score <= 1 for r in rows)
    real = [r for r in rows if r.out and r.lang and r.lang_pred != "und"]
    assert np.mean([r.lang == r.lang_pred for r in real]) > 0.95


def test_no_lessons_and_empty_table(spark):
    df = spark.createDataFrame([(1, "some words", None)], "doc_id long, text string, lang string")
    assert [(r.lang_pred, r.score) for r in language.identify(df, F.lit(True), PATH).collect()] == [("und", 0.0)]
    assert language.identify(df.limit(0), F.lit(True), PATH).count() == 0


def test_long_words_outside_the_vocabulary(spark):
    pieces = language.piece_vocabulary(PATH)
    script, han, plain = "\U0001d4b7" * 40, "\u4dae" * 40, "the"
    places = language.Pieces(pieces).places([script, han, plain])
    p = np.full(len(pieces), 1.0 / len(pieces))
    counts = language.expected(p, places, np.array([2.0, 1.0, 1.0]), len(pieces))
    assert np.isfinite(counts).all()
    only_bytes = language.expected(p, language.Pieces(pieces).places([script]), np.array([2.0]), len(pieces))
    assert [only_bytes[pieces.index(bytes([b]))] for b in "\U0001d4b7".encode()] == pytest.approx([80.0] * 4)
    log = language.log_forward(p[:, None], places)[places[4]][:, 0]
    assert np.isfinite(log).all() and log[0] < log[1] < np.log(np.finfo(float).tiny) < log[2]

    texts = [("en", f"the house and {script} of the {han}"), ("en", "the man and the house"), ("de", "der mann und das haus"), ("de", "das ist der hund")]
    taught = [(i, t, k) for i, (k, t) in enumerate(texts * 5)]
    asked = [(100, "the man", None), (101, "der hund", None), (102, f"{script} {han}", None), (103, f"der hund {han}", None)]
    docs = spark.createDataFrame(taught + asked, "doc_id long, text string, lang string")
    rows = {r.doc_id: r for r in language.identify(docs, F.lit(True), PATH).collect()}
    assert all(0 <= r.score <= 1 for r in rows.values())
    assert [rows[i].lang_pred for i in (100, 101, 102)] == ["en", "de", "en"]
    assert all(rows[i].lang_pred == k for i, _, k in taught)
