import random
import re

import pytest
from pyspark.sql import functions as F
from tokenizers import Tokenizer

import corpus_pipeline
from .test_mixing import plain_targets
from .test_simhash import plain_components, plain_fingerprint

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"


@pytest.fixture(scope="module")
def folder(spark, tmp_path_factory):
    random.seed(21)
    vocab = [f"w{i}" for i in range(80)]
    rows = []
    for i in range(120):
        base = [random.choice(vocab) for _ in range(random.randint(30, 200))]
        text = " ".join(w.upper() + "!!" for w in base) if i % 6 == 0 else " ".join(base)
        rows.append((10 * i, text, "en", random.choice(["a", "a", "b", None]), len(text)))
        if i % 3 == 1:
            rows.append((10 * i + 1, text, "en", "b", None))
        if i % 5 == 2:
            rows.append((10 * i + 2, text + " end", "en", "c", None))
    rows += [(5001, None, None, None, None), (5002, "", None, "a", 0), (5003, " ", "en", "b", 1), (None, "w1 w2 w3 w4", None, None, 5)]
    at = tmp_path_factory.mktemp("corpus")
    spark.createDataFrame(rows, SCHEMA).write.parquet(f"{at}/documents.parquet")
    labels = [(10 * i, int(i % 6 != 0), 0) for i in range(0, 120)]
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int").write.parquet(f"{at}/labels.parquet")
    return str(at)


def test_stages_against_plain_code(spark, folder):
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    columns, stages = docs.columns, dict(corpus_pipeline.STAGES)
    good = stages["quality"](spark, docs, folder).cache()
    assert good.columns == columns
    ids = {r.doc_id for r in good.collect()}
    clean = {r.doc_id for r in docs.collect() if r.text and "!!" not in r.text}
    assert len(clean & ids) >= 0.97 * len(clean) and sum("!!" in (r.text or "") for r in good.collect()) <= 6

    single = stages["exact_dedup"](spark, good, folder).cache()
    best = {}
    for r in good.collect():
        best[r.text or ""] = max(best.get(r.text or "", -1), -1 if r.doc_id is None else r.doc_id)
    assert single.columns == columns
    assert sorted(((r.text or "", -1 if r.doc_id is None else r.doc_id) for r in single.collect())) == sorted(best.items())

    apart = stages["near_dedup"](spark, single, folder).cache()
    rows = single.where("doc_id is not null").collect()
    groups = plain_components([r.doc_id for r in rows], [plain_fingerprint(r.text) for r in rows])
    assert apart.columns == columns
    assert {r.doc_id for r in apart.where("doc_id is not null").collect()} == set(groups)

    mix = stages["mix"](spark, apart, folder).cache()
    size = lambda r: len(re.findall(r"[^\x20\x09-\x0D]+", r.text or ""))
    sizes, took, most = {}, {}, {}
    for r in apart.collect():
        sizes[r.source] = sizes.get(r.source, 0) + size(r)
        most[r.source] = max(most.get(r.source, 0), size(r))
    for r in mix.collect():
        took[r.source] = took.get(r.source, 0) + size(r)
    assert mix.columns == columns
    for s, t in plain_targets(sizes).items():
        assert abs(took.get(s, 0) - t) <= most[s] + 1e-6
    assert mix.groupBy("doc_id").count().agg(F.max("count")).first()[0] <= 2

    tokens = stages["bpe"](spark, mix, folder)
    known, library = {r.doc_id: r.text for r in apart.collect()}, Tokenizer.from_file(corpus_pipeline.TOKENIZER)
    for r in tokens.collect():
        want = library.encode(known[r.doc_id] or "", add_special_tokens=False).ids
        assert (r.ids, r.n_tokens) == (want, len(want)) and r.decoded == library.decode(want, skip_special_tokens=False)
    assert tokens.count() == mix.count()


def test_run_applies_all_stages(spark, folder):
    first, again = (sorted(map(tuple, corpus_pipeline.run(spark, folder).select("doc_id", "n_tokens").collect()), key=repr) for _ in range(2))
    assert first and first == again


def test_empty_table(spark, folder):
    docs = spark.createDataFrame([], SCHEMA)
    for _, stage in corpus_pipeline.STAGES:
        out = stage(spark, docs, folder)
        assert out.count() == 0


def test_columns_with_clashing_names_and_a_long_text_pass(spark, folder, tmp_path):
    docs = spark.read.parquet(f"{folder}/documents.parquet").withColumns({"kept": F.lit("own"), "__salt": F.lit(7), "component_id": F.lit(1.5)})
    long = docs.limit(1).withColumns({"doc_id": F.lit(9000).cast("long"), "text": F.concat_ws(" ", F.transform(F.sequence(F.lit(1), F.lit(60_000)), lambda i: F.concat(F.lit("w"), (i % 80).cast("string"))))})
    docs.union(long).write.parquet(f"{tmp_path}/documents.parquet")
    spark.read.parquet(f"{folder}/labels.parquet").write.parquet(f"{tmp_path}/labels.parquet")
    docs = spark.read.parquet(f"{tmp_path}/documents.parquet")
    columns = docs.columns
    for _, stage in corpus_pipeline.STAGES[:-1]:
        docs = stage(spark, docs, str(tmp_path)).cache()
        assert docs.columns == columns and [tuple(r) for r in docs.select("kept", "__salt", "component_id").distinct().collect()] == [("own", 7, 1.5)]
    last = corpus_pipeline.STAGES[-1][1](spark, spark.read.parquet(f"{tmp_path}/documents.parquet"), str(tmp_path))
    assert last.columns == ["doc_id", "lang", "source", "n_tokens", "ids", "decoded"] and last.agg(F.max("n_tokens")).first()[0] >= 60_000
