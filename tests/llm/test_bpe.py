import random

import public_tokenizers
import pytest
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from creditspark.llm import bpe

PATH = public_tokenizers.path("word_bpe_49k.json")
ODD = [
    None, "", " \n\t", "It's 'START don't", "<|startoftext|>a <|ENDOFTEXT|>x<|endoftext|><|endoftext|>", "aaaaaaa" * 400,
    "ΑΣ Σ ΣΑΣ", "e\u0301cole ﬁ İI \x85 \u00a0y", "🙂\u200d🙂 中文 ١٢٣ 42", "x" * 20_000, "same", "same", "\u0558 \u1c89",
]


@pytest.fixture(scope="module")
def tokenizer():
    return Tokenizer.from_file(PATH)


def test_ids_and_texts_equal_the_library(spark, tokenizer):
    random.seed(5)
    texts = ODD + ["".join(random.choice("abAB1 '.,é\n\tΣß中🙂s'") for _ in range(random.randint(0, 50))) for _ in range(500)]
    df = spark.createDataFrame([(i, t, "x") for i, t in enumerate(texts)], "n long, text string, decoded string")
    rows = bpe.decode(bpe.encode(df, PATH), PATH).select("n", "ids", "decoded").collect()
    assert len(rows) == len(texts)
    for n, ids, decoded in rows:
        want = tokenizer.encode(texts[n] or "", add_special_tokens=False).ids
        assert ids == want
        assert decoded == tokenizer.decode(want, skip_special_tokens=False)


def test_every_character_is_split_as_the_library_does(tokenizer):
    own = bpe.Bpe(open(PATH, encoding="utf-8").read())
    points = [c for c in range(0x110000) if not 0xD800 <= c <= 0xDFFF]
    for at in range(0, len(points), 200_000):
        texts = [f"a{chr(c)}b" for c in points[at : at + 200_000]]
        assert [i.tolist() for i in own.encode(texts)] == [e.ids for e in tokenizer.encode_batch(texts, add_special_tokens=False)]


def test_empty_table_and_unknown_ids(spark):
    assert bpe.decode(bpe.encode(spark.createDataFrame([], "text string"), PATH), PATH).count() == 0
    df = spark.createDataFrame([([-1, 0, 99_999_999],), (None,)], "ids array<int>")
    assert [r[0] for r in bpe.decode(df, PATH).select("decoded").collect()] == ["!", ""]


def test_null_column(spark):
    df = spark.range(2).select(F.lit(None).cast("string").alias("text"))
    assert [r[0] for r in bpe.encode(df, PATH).select("ids").collect()] == [[], []]


def test_both_ways_at_once_equals_one_after_the_other(spark):
    texts = [None, "", " ", "Hello, World's", "ab " * 3000, "日本 x", "ab ab"]
    df = spark.createDataFrame([(i, t, "x") for i, t in enumerate(texts * 60)], "id long, text string, ids string")
    both = bpe.decode(bpe.encode(df, PATH), PATH).select("id", "ids", "decoded")
    one = bpe.encode_and_decode(df, PATH, ["id"])
    assert one.columns == ["id", "ids", "decoded"]
    assert sorted(map(repr, one.collect())) == sorted(map(repr, both.collect()))
