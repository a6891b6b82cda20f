"""A hashed maximum-entropy language model with class-factored softmax.

A text's probability is the product over its tokens (words, then one end) of P(class | the tokens before) and
P(token | class).  The first factor is a softmax over CLASSES classes whose logits sum the weights of hashed features:
the previous token, the one before it (a skip feature), and both together.  It is trained by gradient updates: each
task computes the gradient of its share of the corpus's context counts, the driver adds the tasks' gradients and moves
the weights.  Frequent tokens are classes of their own, others share one by their ending; one class says that the last
token comes again.  Within a class a token counts as often as in training; each shared class keeps some mass for
tokens never seen, as many as it has tokens seen once.

That model is the prior of a second one, whose size grows with the corpus: all pairs of adjacent tokens are counted by
identity (64-bit hashes; before a text's first token comes the end), and
P(token | before) = (c(before, token) + PULL * prior) / (c(before) + PULL).  The counts stay distributed.

Scoring: tokens with at least 1 in FREQUENT of all training tokens (so at most FREQUENT) go to each task.  The texts are written
in chunks; a chunk asks for the corpus's counts of its distinct pairs and other tokens, by 64-bit hashes, and says how often its
own training texts have each.  Questions are parted by hash into buckets, a bucket adds up and answers each chunk in the order
of its questions, and the chunk, read again, knows its places.  So no task needs the whole vocabulary, no row stands for a single
token, and a key, however frequent, comes but once from each chunk.

Null and empty texts are the end token alone.  Rows with a null id are trained on.  Repeated rows count each.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ledgerline.llm.common import cut, discard

FREQUENT = 100_000
END, SAME, OWN_CLASSES, CLASSES = 0, 1, 30, 64
#: Buckets of a context token (0: none, then the most frequent tokens, then endings), hashed pairs, and endings.
CONTEXTS, OWN_CONTEXTS, PAIRS, ENDINGS = 256, 200, 2048, 4096
STEPS, RATE = 12, 0.5
#: Occurrences that the prior of a pair counts for.
PULL = 100.0
#: Distinct tokens that a task counts before it passes them on.
FLUSH = 300_000
#: Bytes of texts that are read at once (a longer text is alone), and keys that a bucket of counts holds, about.
CHUNK = 2_000_000
BUCKET = 1_500_000
END_TOKEN = b""


def parts(batch: pa.RecordBatch, size: int) -> Iterator[pa.RecordBatch]:
    """Slices of about `size` bytes of texts (the last column)."""
    ends = np.cumsum(pc.binary_length(batch.column(batch.num_columns - 1)).fill_null(0).to_numpy(zero_copy_only=False).astype(np.int64))
    at = 0
    while at < batch.num_rows:
        to = max(at + 1, int(np.searchsorted(ends, (ends[at - 1] if at else 0) + size, "right")))
        yield batch.slice(at, to - at)
        at = to


@dataclass
class Texts:
    """Tokens of some texts: distinct ones, the place of each token among those, and how many each text has."""

    words: list[bytes]
    place: np.ndarray
    sizes: np.ndarray

    @classmethod
    def read(cls, texts: pa.Array) -> Texts:
        lists = pc.ascii_split_whitespace(pc.ascii_lower(texts.cast(pa.binary()).fill_null(b"").view(pa.string())))
        coded = lists.values.view(pa.binary()).dictionary_encode()
        words, place = coded.dictionary.to_pylist(), coded.indices.to_numpy()
        if END_TOKEN not in words:
            words.append(END_TOKEN)
        end = words.index(END_TOKEN)  # also what stands before leading and behind trailing white space
        real = place != end
        sizes = np.bincount(np.repeat(np.arange(len(lists)), np.diff(lists.offsets.to_numpy()))[real], minlength=len(lists)) + 1
        out, inner = np.full(sizes.sum(), end, np.int64), np.ones(sizes.sum(), bool)
        inner[np.cumsum(sizes) - 1] = False
        out[inner] = place[real]
        return cls(words, out, sizes)

    @property
    def first(self) -> np.ndarray:
        """Where each text begins."""
        return np.cumsum(self.sizes) - self.sizes


def held_out(key: Column) -> Column:
    return F.coalesce(F.crc32(key.cast("string").cast("binary")) % 5 == 1, F.lit(False))


def _hash(word: bytes) -> int:
    import xxhash

    h = xxhash.xxh3_64_intdigest(word)
    return h - (1 << 64) if h >> 63 else h


def _ending(word: bytes) -> int:
    import zlib

    return zlib.crc32(word[-2:]) % ENDINGS


def pair_keys(before: np.ndarray, h: np.ndarray) -> np.ndarray:
    """A 64-bit hash of each token and the one before, given by their own hashes."""
    x = before.view(np.uint64) * np.uint64(0x9E3779B97F4A7C15)
    x ^= x >> np.uint64(32)
    x += h.view(np.uint64)
    x *= np.uint64(0xD6E8FEB86659FD93)
    x ^= x >> np.uint64(32)
    return x


def count_tokens(docs: DataFrame, text: str = "text") -> DataFrame:
    """h, token, ending and c: a row for each distinct token."""

    size = CHUNK

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own: dict[bytes, int] = {}

        def out():
            words = list(own)
            return pa.RecordBatch.from_arrays(
                [pa.array([_hash(w) for w in words], pa.int64()), pa.array(words, pa.binary()), pa.array([_ending(w) for w in words], pa.int32()), pa.array(list(own.values()), pa.int64())],
                names=["h", "token", "ending", "c"],
            )

        for batch in batches:
            for part in parts(batch, size):
                read = Texts.read(part.column(0))
                n = np.bincount(read.place, minlength=len(read.words)).tolist()
                own.update((w, own.get(w, 0) + c) for w, c in zip(read.words, n, strict=True))
                if len(own) >= FLUSH:
                    yield out()
                    own.clear()
        yield out()

    counted = docs.select(F.col(text).cast("binary").alias("t")).mapInArrow(count, "h long, token binary, ending int, c long")
    return counted.groupBy("h", "token", "ending").agg(F.sum("c").alias("c"))


@dataclass
class Tables:
    """What tasks know of the tokens: codes 0 to F-1 are frequent tokens, F + ending stands for any other."""

    code: dict[bytes, int]
    classes: np.ndarray
    contexts: np.ndarray
    within: np.ndarray  # log10 P(token | class) of frequent tokens; for endings, what is to be multiplied by the count
    unseen: np.ndarray  # by ending: log10 P(a token never seen | class)
    hashes: np.ndarray  # of frequent tokens
    counts: np.ndarray  # of frequent tokens

    def read(self, words: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Codes and hashes, and the places of tokens that aren't frequent."""
        get, f = self.code.get, len(self.code)
        codes = np.array([get(w, -1) for w in words], np.int64)
        rare = np.flatnonzero(codes < 0)
        hashes = np.empty(len(words), np.int64)
        hashes[codes >= 0] = self.hashes[codes[codes >= 0]]
        hashes[rare] = [_hash(words[i]) for i in rare.tolist()]
        codes[rare] = [_ending(words[i]) + f for i in rare.tolist()]
        return codes, hashes, rare

    def events(self, texts: Texts, codes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The context and the class of each token (codes: of the distinct ones)."""
        first = texts.first
        b, k = self.contexts[codes][texts.place], self.classes[codes][texts.place]
        one, two = np.zeros(len(b), np.int64), np.zeros(len(b), np.int64)
        one[1:], two[2:] = b[:-1], b[:-2]
        one[first] = two[first] = 0
        two[first[texts.sizes > 1] + 1] = 0
        again = np.zeros(len(b), bool)
        again[1:] = texts.place[1:] == texts.place[:-1]
        again[first] = False
        k[again] = SAME
        return two * CONTEXTS + one, k

    def keys(self, texts: Texts, hashes: np.ndarray, rare: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The distinct keys that counts are asked for, in order, and the places of each token's pair and then of each rare token among those."""
        h = hashes[texts.place]
        before = np.empty_like(h)
        before[1:], before[texts.first] = h[:-1], hashes[texts.words.index(END_TOKEN)]  # before a text's first token comes the end
        return np.unique(np.concatenate([pair_keys(before, h), hashes[rare].view(np.uint64)]), return_inverse=True)


def build_tables(counts: DataFrame) -> tuple[Tables, int, int]:
    """counts (written) -> Tables, N, V."""
    n, v = counts.agg(F.coalesce(F.sum("c"), F.lit(0)), F.count("*")).first()
    top = counts.where(F.col("c") * FREQUENT >= n).select("token", "c").collect()  # at most FREQUENT rows
    top = sorted(((bytes(r["token"]), r["c"]) for r in top), key=lambda x: (-x[1], x[0]))
    by_ending = counts.groupBy("ending").agg(F.sum("c").alias("c"), F.sum((F.col("c") == 1).cast("long")).alias("once")).collect()  # at most ENDINGS rows
    f = len(top)
    classes, contexts = np.empty(f + ENDINGS, np.int64), np.empty(f + ENDINGS, np.int64)
    shared, ends = CLASSES - OWN_CLASSES - 2, np.arange(ENDINGS)
    classes[f:], contexts[f:] = ends % shared + OWN_CLASSES + 2, ends % (CONTEXTS - OWN_CONTEXTS - 1) + OWN_CONTEXTS + 1
    owned = 0
    total, once = np.zeros(CLASSES), np.zeros(CLASSES)
    for r in by_ending:
        total[classes[f + r["ending"]]] += r["c"]
        once[classes[f + r["ending"]]] += r["once"]
    for i, (w, c) in enumerate(top):
        e = _ending(w)
        classes[i], contexts[i] = classes[f + e], contexts[f + e]
        if w == END_TOKEN or owned < OWN_CLASSES:
            total[classes[i]] -= c
            once[classes[i]] -= c == 1
            classes[i] = END if w == END_TOKEN else owned + 2
            owned += w != END_TOKEN
        if i < OWN_CONTEXTS:
            contexts[i] = i + 1
    novel = np.clip(once / np.maximum(total, 1), 1e-4, 0.5)
    within = np.zeros(f + ENDINGS)
    per = np.log10((1 - novel) / np.maximum(total, 1))
    for i, (_, c) in enumerate(top):
        within[i] = 0.0 if classes[i] < OWN_CLASSES + 2 else math.log10(c) + per[classes[i]]
    within[f:] = per[classes[f:]]
    hashes, own_counts = np.array([_hash(w) for w, _ in top], np.int64), np.array([c for _, c in top], np.float64)
    return Tables({w: i for i, (w, _) in enumerate(top)}, classes, contexts, within, np.log10(novel)[classes[f:]], hashes, own_counts), n, v


def context_counts(docs: DataFrame, tables: Tables, text: str = "text") -> DataFrame:
    """context, class and n over all of docs: CONTEXTS**2 * CLASSES rows at most."""
    shared, size = docs.sparkSession.sparkContext.broadcast(tables), CHUNK

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own, sums = shared.value, np.zeros(CONTEXTS * CONTEXTS * CLASSES, np.int32)
        for batch in batches:
            for part in parts(batch, size):
                read = Texts.read(part.column(0))
                context, k = own.events(read, own.read(read.words)[0])
                cell, n = np.unique((context * CLASSES + k).astype(np.int32), return_counts=True)
                sums[cell] += n.astype(np.int32)
        cell = np.flatnonzero(sums)
        for at in range(0, len(cell), 100_000):
            part = cell[at : at + 100_000]
            yield pa.RecordBatch.from_arrays([pa.array(part // CLASSES), pa.array(part % CLASSES), pa.array(sums[part].astype(np.int64))], names=["context", "class", "n"])

    rows = docs.select(F.col(text).cast("binary").alias("t")).mapInArrow(count, "context long, class long, n long")
    return rows.groupBy("context", "class").agg(F.sum("n").alias("n"))


def packed(values: np.ndarray) -> bytes:
    """Unsigned 64-bit numbers without the bytes that all of them have as zero."""
    width = max(1, (int(values.max()).bit_length() + 7) // 8)
    planes = np.ascontiguousarray(values.view(np.uint8).reshape(-1, 8)[:, :width].T)
    return bytes([width]) + len(values).to_bytes(4, "little") + pa.compress(planes.tobytes(), "zstd", asbytes=True)


def unpacked(data: bytes) -> np.ndarray:
    width, n = data[0], int.from_bytes(data[1:5], "little")
    planes = np.frombuffer(pa.decompress(data[5:], n * width, "zstd", asbytes=True), np.uint8).reshape(width, n)
    out = np.zeros((n, 8), np.uint8)
    out[:, :width] = planes.T
    return out.reshape(-1).view(np.uint64)


def chunked(rows: DataFrame) -> DataFrame:
    """chunk and data: rows, whose last column is the text, in Arrow's format, CHUNK bytes of texts in each."""
    size = CHUNK

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in parts(batch, size):
                sink = pa.BufferOutputStream()
                with pa.ipc.new_stream(sink, part.schema, options=pa.ipc.IpcWriteOptions(compression="zstd")) as out:
                    out.write_batch(part)
                yield pa.RecordBatch.from_arrays([pa.array([sink.getvalue().to_pybytes()], pa.binary())], names=["data"])

    return rows.mapInArrow(write, "data binary").select(F.monotonically_increasing_id().alias("chunk"), "data")


def asked(chunks: DataFrame, tables: Tables, bits: int) -> DataFrame:
    """bucket, chunk, ks and ns: keys of a chunk that begin with the bucket's bits, and how often its training texts have each."""
    shared = chunks.sparkSession.sparkContext.broadcast(tables)

    def ask(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own, starts = shared.value, np.arange(1 << bits, dtype=np.uint64) << np.uint64(64 - bits)
        for batch in batches:
            for chunk, data in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                part = pa.ipc.open_stream(data.as_buffer()).read_next_batch()
                read = Texts.read(part.column("t"))
                _, hashes, rare = own.read(read.words)
                keys, place = own.keys(read, hashes, rare)
                training = np.repeat(~part.column("held_out").to_numpy(zero_copy_only=False), read.sizes).astype(np.float64)
                of_words = np.bincount(read.place, training, len(read.words))
                n = np.bincount(place, np.concatenate([training, of_words[rare]]), len(keys)).astype(np.uint64)
                bounds = [*np.searchsorted(keys, starts).tolist(), len(keys)]
                full = [b for b in range(1 << bits) if bounds[b] < bounds[b + 1]]
                ks = [packed(np.diff(keys[bounds[b] : bounds[b + 1]], prepend=starts[b])) for b in full]
                ns = [packed(n[bounds[b] : bounds[b + 1]]) for b in full]
                yield pa.RecordBatch.from_arrays([pa.array(full, pa.int32()), pa.array([chunk] * len(full), pa.int64()), pa.array(ks, pa.binary()), pa.array(ns, pa.binary())], names=["bucket", "chunk", "ks", "ns"])

    return chunks.mapInArrow(ask, "bucket int, chunk long, ks binary, ns binary")


def answered(questions: DataFrame, bits: int) -> DataFrame:
    """chunk, bucket and data: the corpus's counts of the keys that the chunk asked the bucket for, in that order."""

    def answer(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bucket, chunks, ks, ns = None, [], [], []

        def out():
            keys, place = np.unique(np.concatenate(ks), return_inverse=True)
            sums = np.bincount(place, np.concatenate(ns), len(keys)).astype(np.uint64)[place]
            data = [packed(x) for x in np.split(sums, np.cumsum([len(k) for k in ks])[:-1])]
            return pa.RecordBatch.from_arrays([pa.array(chunks, pa.int64()), pa.array([bucket] * len(chunks), pa.int32()), pa.array(data, pa.binary())], names=["chunk", "bucket", "data"])

        for batch in batches:
            for b, chunk, k, n in zip(*(batch.column(i).to_pylist() for i in range(4)), strict=True):
                if b != bucket and chunks:
                    yield out()
                    chunks, ks, ns = [], [], []
                bucket = b
                chunks.append(chunk)
                ks.append(np.cumsum(unpacked(k)))
                ns.append(unpacked(n))
        if chunks:
            yield out()

    return questions.repartition(1 << bits, "bucket").sortWithinPartitions("bucket").mapInArrow(answer, "chunk long, bucket int, data binary")


def feature_ids(context: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Rows of the weights: previous token, skip, hashed pair (row 0 is the bias of all)."""
    two, one = context // CONTEXTS, context % CONTEXTS
    pair = (two * 1_000_003 + one * 7919) * 2_654_435_761 >> 8
    return 1 + one, 1 + CONTEXTS + two, 1 + 2 * CONTEXTS + pair % PAIRS


ROWS = 1 + 2 * CONTEXTS + PAIRS


def logits(weights: np.ndarray, context: np.ndarray) -> np.ndarray:
    a, b, c = feature_ids(context)
    z = weights[0] + weights[a] + weights[b] + weights[c]
    z -= z.max(axis=1, keepdims=True)
    return z - np.log(np.exp(z).sum(axis=1, keepdims=True))


def train(cells: DataFrame, steps: int = STEPS, rate: float = RATE) -> np.ndarray:
    """Weights by gradient updates over all context counts (cells: written, bounded)."""
    spark = cells.sparkSession
    totals = {r["class"]: r["n"] for r in cells.groupBy("class").agg(F.sum("n").alias("n")).collect()}  # CLASSES rows
    everything = sum(totals.values())
    weights, speed = np.zeros((ROWS, CLASSES), np.float64), np.full((ROWS, CLASSES), 1e-8)
    weights[0] = np.log([(totals.get(k, 0) + 0.5) / (everything + 0.5 * CLASSES) for k in range(CLASSES)])
    if not everything:
        return weights
    # CONTEXTS**2 * CLASSES counts at most, 4 million, at any size of the corpus: a fixed number of tasks holds them; their gradients are all that comes back.
    cells = cells.coalesce(6)
    for _ in range(steps):
        shared = spark.sparkContext.broadcast(weights)

        def gradient(batches: Iterator[pa.RecordBatch], shared=shared) -> Iterator[pa.RecordBatch]:
            sums, w = np.zeros((ROWS, CLASSES)), shared.value
            for batch in batches:
                for at in range(0, batch.num_rows, 8192):
                    context, k, n = (batch.column(i).slice(at, 8192).to_numpy() for i in range(3))
                    distinct, place = np.unique(context, return_inverse=True)
                    seen = np.zeros((len(distinct), CLASSES))
                    np.add.at(seen, (place, k), n)
                    off = seen - seen.sum(axis=1, keepdims=True) * np.exp(logits(w, distinct))
                    sums[0] += off.sum(axis=0)
                    for ids in feature_ids(distinct):
                        np.add.at(sums, ids, off)
            yield pa.RecordBatch.from_arrays([pa.array([sums.tobytes()], pa.binary())], names=["g"])

        g = sum(np.frombuffer(r["g"]).reshape(ROWS, CLASSES) for r in cells.mapInArrow(gradient, "g binary").collect()) / everything
        speed += g * g
        weights = weights + rate * g / np.sqrt(speed)
        shared.unpersist()
    return weights


def score(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """doc_id, held_out, n_tokens, n_known, train_tokens, base_score and score of every row of docs."""
    rows = docs.select(F.col(key).alias("doc_id"), held_out(F.col(key)).alias("held_out"), F.col(text).cast("binary").alias("t"))
    training = rows.where(~F.col("held_out"))
    counts = cut(count_tokens(training, "t"), "lm-counts")
    tables, n, v = build_tables(counts)
    discard(counts)
    contexts = cut(context_counts(training, tables, "t"), "lm-contexts")
    weights = train(contexts)
    discard(contexts)
    all_contexts = np.arange(CONTEXTS * CONTEXTS)
    table = np.concatenate([logits(weights, c) for c in np.array_split(all_contexts, 64)]).astype(np.float32) / np.float32(math.log(10))
    chunks = cut(chunked(rows), "lm-chunks")
    bits = max(4, (n // BUCKET).bit_length())  # keys of held-out texts come on top, repeated pairs go
    counted = cut(answered(asked(chunks, tables, bits), bits), "lm-counted")
    spark = docs.sparkSession
    shared, known = spark.sparkContext.broadcast(table), spark.sparkContext.broadcast(tables)
    whole, pull = math.log10(n + 0.5 * (v + 1)), PULL

    def of_chunk(data: bytes, answers: list[bytes]) -> pa.RecordBatch:
        logs, own = shared.value, known.value
        part = pa.ipc.open_stream(data).read_next_batch()
        read = Texts.read(part.column("t"))
        codes, hashes, rare = own.read(read.words)
        keys, place = own.keys(read, hashes, rare)
        found = np.concatenate([unpacked(a) for a in answers]).astype(np.float64)
        if len(found) != len(keys):
            raise ValueError(f"{len(found)} counts for {len(keys)} keys")
        c = np.empty(len(codes))
        sure = np.ones(len(codes), bool)
        sure[rare] = False
        c[sure], c[rare] = own.counts[codes[sure]], found[place[len(read.place) :]]
        ending = codes[rare] - len(own.code)
        within = own.within[codes]
        within[rare] = np.where(c[rare] > 0, within[rare] + np.log10(np.maximum(c[rare], 1)), own.unseen[ending])
        context, k = own.events(read, codes)
        prior = logs[context, k] + np.where(k != SAME, within[read.place], 0.0)
        # All tokens of a text come before one, as its end stands for what is before the first.
        model = prior - np.log10(c / pull + 1)[read.place] + np.log10(found[place[: len(read.place)]] / pull / 10.0**prior + 1)
        first = read.first
        sums = [read.sizes, np.add.reduceat((c > 0)[read.place].astype(np.int64), first), np.full(len(first), n), np.add.reduceat((np.log10(c + 0.5) - whole)[read.place], first), np.add.reduceat(model, first)]
        return pa.RecordBatch.from_arrays([part.column("doc_id"), part.column("held_out"), *map(pa.array, sums)], names=names)

    def read_all(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, answers = None, []
        for batch in batches:
            for bucket, data in zip(batch.column(1).to_pylist(), batch.column(2), strict=True):
                if bucket < 0:
                    if held:
                        yield of_chunk(held, answers)
                    held, answers = data.as_py(), []
                else:
                    answers.append(data.as_py())
        if held:
            yield of_chunk(held, answers)

    made = [("n_tokens", T.LongType()), ("n_known", T.LongType()), ("train_tokens", T.LongType()), ("base_score", T.DoubleType()), ("score", T.DoubleType())]
    schema = T.StructType([*rows.schema.fields[:2], *(T.StructField(x, kind) for x, kind in made)])
    names = schema.names
    both = chunks.select("chunk", F.lit(-1).alias("bucket"), "data").unionByName(counted)
    return both.repartition(max(1, chunks.count() // 4), "chunk").sortWithinPartitions("chunk", "bucket").mapInArrow(read_all, schema)
