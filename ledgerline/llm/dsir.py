"""Quality classification by importance resampling.

Two generative models of hashed n-grams, one of target text (documents labelled good) and one of all raw text, give
each document the log ratio of its probabilities, its importance weight.  A resample of k documents is drawn without
replacement with chances in proportion to the importance: standard Gumbel noise is added to the log weights, and the
k largest stay.  k is the number of documents wanted and knows nothing of the weights: by default as many as
the share of good labels says, plus SLACK standard errors of that share (so that a chance shortage of good labels
costs no good document).

Tokens are runs of word characters and runs of other characters, letter case kept; features are the hashed tokens and
pairs of neighbours, and one feature of its own for a pair that the document had before.  The log weight is that of
TYPICAL average features of the text; NEUTRAL features of no weight are mixed into the average, so that few features
say little.  One formula holds for all lengths.  A null or empty text has no features and log weight 0.

Noise comes from the id's hash: a repeated row has the same fate as its twin (all rows that tie with the k-th
stay).  Without labels of both kinds all documents are kept.  Columns of the caller pass, whatever their names.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ledgerline.llm.common import append_columns, cut, discard, pack, quoted, radix_threshold, unpack

BUCKETS = 1 << 14
#: Labelled rows used at most, those whose ids have the least hashes.
LABELLED = 20_000
#: Counts added to each bucket of the target model, and in proportion to the raw one's: rare n-grams decide little.
SMOOTHING = 4.0
TYPICAL, NEUTRAL = 10.0, 10.0
SLACK = 2.0
#: Keys are compared in units of 1 / UNIT.
UNIT = 1_000_000
REMEMBERED = 400_000


class Features:
    def __init__(self, buckets: int = BUCKETS):
        import re
        import zlib

        self.tokens = re.compile(rb"[0-9A-Za-z_\x80-\xff]+|[^\s0-9A-Za-z_\x80-\xff]+").findall
        self.crc, self.known, self.buckets = zlib.crc32, {}, buckets

    def __call__(self, text: bytes | None) -> np.ndarray:
        words = self.tokens(text or b"")
        if not words:
            return np.empty(0, np.int64)
        known = self.known
        if len(known) > REMEMBERED:
            known.clear()
        for w in set(words).difference(known):
            known[w] = self.crc(w)
        ids = np.fromiter(map(known.__getitem__, words), np.uint64, len(words))
        pairs = ids[:-1] * np.uint64(0x9E3779B97F4A7C15) + ids[1:] * np.uint64(0xC2B2AE3D27D4EB4F)
        _, first = np.unique(pairs, return_index=True)
        at = np.zeros(len(pairs), np.int64)  # bucket 0: a pair seen before
        at[first] = ((pairs[first] >> np.uint64(33)) % np.uint64(self.buckets - 1)).astype(np.int64) + 1
        return np.concatenate([(ids % np.uint64(self.buckets - 1)).astype(np.int64) + 1, at])


def bounded_labels(labels: DataFrame, value: str, key: str = "doc_id", most: int = LABELLED, train: bool = True) -> DataFrame:
    """At most `most` rows (key, value) with a value of 0 or 1, an id once (its least value); the same for every run.

    train: without the rows that are held out (crc32 of the id as text, modulo 5, is 0).
    """
    rows = labels.where(F.col(value).isin(0, 1) & F.col(key).isNotNull())
    if train:
        rows = rows.where(F.crc32(F.col(key).cast("string").cast("binary")) % 5 != 0)
    rows = rows.groupBy(key).agg(F.min(value).alias(value))
    return rows.orderBy(F.xxhash64(key), key).limit(most)


def log_ratios(docs: DataFrame, labels: DataFrame, text: str = "text", key: str = "doc_id", buckets: int = BUCKETS) -> np.ndarray:
    """log(target probability / raw probability) by bucket, counted over all documents."""
    # At most LABELLED rows.
    good_ids = labels.where("quality = 1").select(quoted(key).alias("good_id"), F.lit(True).alias("good"))
    rows = docs.select(quoted(key).alias("own_id"), quoted(text).cast("binary").alias("t")).join(F.broadcast(good_ids), F.col("own_id") == F.col("good_id"), "left")
    rows = rows.select("t", F.coalesce("good", F.lit(False)).alias("g"))

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        features, sums = Features(buckets), np.zeros((2, buckets), np.int64)
        for batch in batches:
            for at in range(0, batch.num_rows, 128):
                part = batch.slice(at, 128)
                for t, g in zip(part.column(0).to_pylist(), part.column(1).to_pylist(), strict=True):
                    own = np.bincount(features(t), minlength=buckets)
                    sums[0] += own
                    if g:
                        sums[1] += own
        used = np.flatnonzero(sums[0])
        yield pa.RecordBatch.from_arrays([pa.array(used), pa.array(sums[0][used]), pa.array(sums[1][used])], names=["bucket", "raw", "target"])

    counted = rows.mapInArrow(count, "bucket long, raw long, target long").groupBy("bucket").agg(F.sum("raw"), F.sum("target"))
    sums = np.zeros((2, buckets))
    for bucket, raw, target in counted.collect():  # at most `buckets` rows
        sums[:, bucket] = raw, target
    if not sums[1].sum():
        return np.zeros(buckets)
    raw, target = sums
    return np.log((target + SMOOTHING) / (raw * (target.sum() / raw.sum()) + SMOOTHING))  # the totals are then equal


def weigh(docs: DataFrame, ratios: np.ndarray, text: str = "text", key: str = "doc_id", carry: list[str] | None = None) -> DataFrame:
    """`doc` (the columns `carry` of docs, all by default), `own_id`, `n_features` and `weight` (the log ratio)."""
    shared = docs.sparkSession.sparkContext.broadcast(ratios)

    def make(values) -> Iterator[list[tuple]]:
        features, own = Features(len(shared.value)), shared.value
        for batch in values:
            out = []
            for t in batch:
                f = features(t)
                out.append((len(f), float(own[f].sum()) * TYPICAL / (len(f) + NEUTRAL)))
            yield out

    added = T.StructType([T.StructField("n_features", T.LongType()), T.StructField("weight", T.DoubleType())])
    rows = pack(docs, carry, own_id=key, own_text=text)
    return append_columns(rows, F.col("own_text").cast("binary"), added, make, gone=["own_text"])


def noise(key: Column, seed: int) -> Column:
    """A standard Gumbel variable from the hash of the key."""
    u = (F.shiftrightunsigned(F.xxhash64(key, F.lit(seed)), 12) + 0.5) / float(2**52)
    return -F.log(-F.log(u))


def top_k(weighed: DataFrame, k: int | None, seed: int = 17) -> DataFrame:
    """weighed (own_id, weight; written) with `gumbel_key` and `kept`, the k largest keys; all rows for None."""
    drawn = weighed.withColumn("gumbel_key", F.col("weight") + noise(F.col("own_id"), seed))
    if k is None:
        return drawn.withColumn("kept", F.lit(True))
    units = F.floor(F.col("gumbel_key") * UNIT).cast("long")
    least = radix_threshold(drawn.select(units.alias("u")), "u", k)
    return drawn.withColumn("kept", F.lit(k > 0) if least is None else units >= F.lit(least))


def wanted(good: int, labelled: int, rows: int) -> int | None:
    """How many of the rows are to be kept, by the labels; None if they are all of one kind."""
    if not 0 < good < labelled:
        return None
    share = good / labelled
    return min(rows, math.ceil(rows * (share + SLACK * math.sqrt(share * (1 - share) / labelled))))


def classify(
    docs: DataFrame, labels: DataFrame, text: str = "text", key: str = "doc_id", carry: list[str] | None = None,
    most: int = LABELLED, size: int | None = None, seed: int = 17,
) -> DataFrame:
    """`doc` (the columns `carry` of docs, all by default), n_features, weight, gumbel_key and kept.

    size: how many documents are wanted; None leaves it to the labels (see wanted()).
    """
    known = cut(bounded_labels(labels, "quality", key, most), "quality-labels")
    good, labelled = known.agg(F.coalesce(F.sum("quality"), F.lit(0)), F.count("*")).first()
    ratios = log_ratios(docs, known, text, key)
    discard(known)
    weighed = cut(weigh(docs, ratios, text, key, carry), "quality-weights")
    k = wanted(good, labelled, weighed.count()) if size is None else size
    return top_k(weighed, k, seed).drop("own_id")


def resample(docs: DataFrame, labels: DataFrame, text: str = "text", key: str = "doc_id", size: int | None = None, seed: int = 17) -> DataFrame:
    """The documents kept, with the columns of docs."""
    return unpack(classify(docs, labels, text, key, size=size, seed=seed).where("kept"), docs.columns)
