import math
import random
from collections import Counter

import numpy as np
from pyspark.sql import functions as F

from ledgerline.llm import dsir
from ledgerline.llm.common import radix_threshold
from ledgerline.llm.queries import QUERIES


def test_counts_and_weights_against_plain_code(spark):
    rng = random.Random(4)
    texts = [None, "", "a", "a b a b a b", "é!! é!!", *(" ".join(rng.choices(["x", "y", "Z", "#"], k=30)) for _ in range(20))]
    rows = [(i, t, "clash") for i, t in enumerate(texts)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, _arg string")
    labels = spark.createDataFrame([(i, i % 2) for i in range(len(texts))] + [(3, 1), (None, 1)], "doc_id long, quality int")
    known = {r.doc_id: r.quality for r in dsir.bounded_labels(labels, "quality").collect()}
    ratios = dsir.log_ratios(docs, dsir.bounded_labels(labels, "quality"))
    features, raw, target = dsir.Features(), Counter(), Counter()
    for i, t in enumerate(texts):
        own = features((t or "").encode()).tolist()
        raw.update(own)
        if known.get(i) == 1:
            target.update(own)
    n = dsir.BUCKETS
    for b in range(n):
        want = math.log((target[b] + dsir.SMOOTHING) / (raw[b] * target.total() / raw.total() + dsir.SMOOTHING))
        assert math.isclose(ratios[b], want, abs_tol=1e-12)
    for r in dsir.weigh(docs, ratios).collect():
        own = features((r.doc.text or "").encode())
        assert r.n_features == len(own) and math.isclose(r.weight, ratios[own].sum() * dsir.TYPICAL / (len(own) + dsir.NEUTRAL), abs_tol=1e-9) and r.doc["_arg"] == "clash"


def test_radix_threshold_is_the_kth_largest(spark):
    rng = random.Random(2)
    values = [rng.choice([0, 1, -1, rng.randint(-(2**63), 2**63 - 1), rng.randint(-50, 50)]) for _ in range(500)]
    df = spark.createDataFrame([(v,) for v in values], "u long")
    ordered = sorted(values, reverse=True)
    for k in (1, 2, 77, 499, 500):
        assert radix_threshold(df, "u", k) == ordered[k - 1]
    assert radix_threshold(df, "u", 501) is None and radix_threshold(df, "u", 0) is None


def test_no_labels_and_no_rows(spark):
    docs = spark.createDataFrame([(1, "a", 2), (1, "a", 2), (None, None, 3)], "doc_id long, text string, kept int")
    labels = spark.createDataFrame([], "doc_id long, quality int")
    kept = dsir.resample(docs, labels)
    assert kept.count() == 3 and kept.columns == ["doc_id", "text", "kept"]
    assert dsir.resample(docs.limit(0), labels).count() == 0


def test_columns_of_the_caller_pass(spark):
    names = ["own_id", "own_text", "n_features", "weight", "gumbel_key", "kept", "doc", "good", "_arg", "a.b"]
    docs = spark.createDataFrame([(i, "x y z" if i % 2 else "# #", *(f"{n}{i}" for n in names)) for i in range(40)], ["doc_id", "text", *names])
    labels = spark.createDataFrame([(i, i % 2) for i in range(40)], "doc_id long, quality int")
    got = dsir.resample(docs, labels, size=25)
    assert got.columns == docs.columns and got.count() == 25
    assert all(r[n] == f"{n}{r.doc_id}" for r in got.collect() for n in names)


def test_size_knows_only_the_labels():
    assert dsir.wanted(0, 50, 1000) is None and dsir.wanted(50, 50, 1000) is None and dsir.wanted(0, 0, 1000) is None
    assert dsir.wanted(80, 100, 1000) == math.ceil(1000 * (0.8 + dsir.SLACK * 0.04))
    assert dsir.wanted(99, 100, 1000) == 1000


def test_inclusion_follows_the_weights(spark):
    """Chances of Gumbel top-k: with c such that they add up to k, 1 - exp(-c * importance)."""
    n, k, seeds = 3000, 600, 12
    weight = F.pmod("id", F.lit(4)).cast("double")
    rows = spark.range(n).select(F.col("id").alias("own_id"), weight.alias("weight")).repartition(4).cache()
    importance = np.exp(np.arange(4.0))
    low, high = 0.0, 10.0
    for _ in range(60):
        c = (low + high) / 2
        low, high = (c, high) if n / 4 * (1 - np.exp(-c * importance)).sum() < k else (low, c)
    kept, fates = np.zeros(4), []
    for seed in range(seeds):
        drawn = dsir.top_k(rows, k, seed).where("kept").select("own_id", "weight").collect()
        assert abs(len(drawn) - k) <= 1
        fates.append({r.own_id for r in drawn})
        kept += np.bincount([int(r.weight) for r in drawn], minlength=4)
    assert np.allclose(kept / (seeds * n / 4), 1 - np.exp(-c * importance), atol=0.03)
    assert len(fates[0] ^ fates[1]) > k / 2


def test_kept_is_the_resample(spark, sf_dir):
    docs, labels = (spark.read.parquet(f"{sf_dir}/{t}.parquet") for t in ("documents", "labels"))
    rows = dsir.classify(docs, labels, carry=["doc_id", "text"]).collect()
    known = dsir.bounded_labels(labels, "quality").collect()
    ids, features, raw, target = {r.doc_id for r in known if r.quality}, dsir.Features(), Counter(), Counter()
    for r in rows:
        own = features((r.doc.text or "").encode()).tolist()
        raw.update(own)
        if r.doc.doc_id in ids:
            target.update(own)
    scale = target.total() / raw.total()
    ratio = {b: math.log((target[b] + dsir.SMOOTHING) / (raw[b] * scale + dsir.SMOOTHING)) for b in raw}
    keys = []
    for r in rows:
        own = features((r.doc.text or "").encode()).tolist()
        weight = sum(ratio[b] for b in own) * dsir.TYPICAL / (len(own) + dsir.NEUTRAL)
        assert math.isclose(weight, r.weight, abs_tol=1e-6)
        keys.append(r.gumbel_key)
    k = dsir.wanted(len(ids), len(known), len(rows))
    least = sorted(keys, reverse=True)[k - 1]
    assert all(r.kept == (math.floor(r.gumbel_key * dsir.UNIT) >= math.floor(least * dsir.UNIT)) for r in rows) and 0 < k < len(rows)
    half = dsir.classify(docs, labels, carry=["doc_id"], size=len(rows) // 2).collect()
    plain = sorted((r.weight for r in half), reverse=True)[len(rows) // 2 - 1]
    assert sum(r.kept for r in half) == len(rows) // 2 and any(r.kept != (r.weight >= plain) for r in half)


def test_query_on_held_out_labels(spark):
    sf_dir = "/root/testdata/sf0.01"
    rows = QUERIES["op1_importance_resampling"](spark, sf_dir)
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet").where(F.crc32(F.col("doc_id").cast("string").cast("binary")) % 5 == 0)
    got = rows.join(labels, "doc_id").collect()
    good, bad = [r.kept for r in got if r.quality == 1], [r.kept for r in got if r.quality == 0]
    assert rows.count() == 1000
    assert np.mean(good) >= 0.97 and np.mean(bad) <= 0.3


def test_noise_is_gumbel(spark):
    mean, sd = spark.range(20_000).select(dsir.noise(F.col("id"), 3).alias("g")).agg(F.avg("g"), F.stddev("g")).first()
    assert abs(mean - 0.5772) < 0.05 and abs(sd - math.pi / math.sqrt(6)) < 0.05
