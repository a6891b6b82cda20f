import struct

import corpus_pipeline
import pytest
from pyspark.sql import functions as F

from ledgerline.llm import dsir

from .test_bpe import ids
from .test_minhash import brute as components
from .test_pii import plain
from .test_wumanber import brute as passages


@pytest.fixture(scope="module")
def steps(spark, sf_dir, tmp_path_factory):
    docs, out = spark.read.parquet(f"{sf_dir}/documents.parquet"), []
    for k, (_, stage) in enumerate(corpus_pipeline.STAGES):
        path = str(tmp_path_factory.mktemp("pipeline") / str(k))
        stage(spark, docs, sf_dir).write.parquet(path)
        out.append((docs.collect(), spark.read.parquet(path).collect(), docs.columns))
        docs = spark.read.parquet(path)
    return out


def test_stages_keep_the_columns(steps):
    assert [n for n, _ in corpus_pipeline.STAGES][0].startswith("quality") and len(steps) == 5
    assert all(rows[0].__fields__ == columns for _, rows, columns in steps[:-1])


def test_quality(spark, sf_dir, steps):
    before, after, _ = steps[0]
    want = dsir.classify(spark.read.parquet(f"{sf_dir}/documents.parquet"), spark.read.parquet(f"{sf_dir}/labels.parquet"), carry=["doc_id"])
    assert {r.doc_id for r in after} == {r.doc.doc_id for r in want.where("kept").collect()} and 0 < len(after) < len(before)


def test_near_duplicates(steps):
    before, after, _ = steps[1]
    rows = [(r.doc_id, r.text) for r in before]
    heads = {k for (k, _), (n, least) in zip(rows, components(rows, 5), strict=True) if k == least}
    assert {r.doc_id for r in after} == heads and len(after) == len(heads)


def test_passages(spark, sf_dir, steps):
    before, after, _ = steps[2]
    items = [(r.item_id, r.text) for r in spark.read.parquet(f"{sf_dir}/benchmark.parquet").collect()]
    assert {r.doc_id for r in after} == {r.doc_id for r in before if passages(r.text, items)[1] == 0}


def test_personal_data(steps):
    before, after, _ = steps[3]
    assert len(before) == len(after) and not any(plain(r.text) for r in after)
    texts = {r.doc_id: r.text for r in before}
    assert all(r.text == texts[r.doc_id] or "[" in r.text for r in after) and all(r.n_chars == len(r.text) for r in after)
    assert any("[EMAIL]" in r.text for r in after)


def test_ids(steps):
    for r in steps[4][1]:
        assert list(struct.unpack(f"<{r.n_tokens}I", r.ids)) == ids(r.text) and bytes(r.decoded).decode() == r.text


def test_columns_of_the_caller_pass_every_stage(spark, sf_dir, tmp_path):
    names = ["doc", "text2", "own_id", "own_text", "weight", "gumbel_key", "kept", "n", "component", "n_words", "hits", "items", "contaminated", "spans", "_spans", "_text", "ids", "n_tokens", "decoded", "_arg"]
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text", *(F.concat(F.lit(f"{n}:"), F.col("doc_id").cast("string")).alias(n) for n in names)).where("doc_id < 60")
    for k, (_, stage) in enumerate(corpus_pipeline.STAGES):
        stage(spark, docs, sf_dir).write.parquet(str(tmp_path / str(k)))
        back = spark.read.parquet(str(tmp_path / str(k)))
        assert back.columns[: len(docs.columns)] == docs.columns
        assert all(r[n] == f"{n}:{r.doc_id}" for r in back.collect() for n in names)
        docs = back
    assert {"_n_tokens", "_ids", "_decoded"} < set(docs.columns)


def test_run(spark, sf_dir, steps):
    got = corpus_pipeline.run(spark, sf_dir)
    assert {(r.doc_id, r.n_tokens) for r in got.select("doc_id", "n_tokens").collect()} == {(r.doc_id, r.n_tokens) for r in steps[4][1]}
    assert got.where(F.col("ids").isNull()).count() == 0
