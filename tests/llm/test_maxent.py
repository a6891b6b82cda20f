import math
import zlib
from collections import Counter

import numpy as np
import pytest

from ledgerline.llm import maxent
from ledgerline.llm.queries import QUERIES


def tokens(text):
    return [*"".join(c.lower() if "A" <= c <= "Z" else c for c in text or "").encode().split(), b""]


def check(rows, docs, model_sums=True):
    """rows of score() against plain counting."""
    out = {i: zlib.crc32(str(i).encode()) % 5 == 1 if i is not None else False for i, _ in docs}
    counts = Counter(w for i, t in docs if not out[i] for w in tokens(t))
    n, v = counts.total(), len(counts)
    whole = math.log10(n + 0.5 * (v + 1))
    assert len(rows) == len(docs)
    want = Counter()
    for i, t in docs:
        own = tokens(t)
        base = sum(math.log10(counts[w] + 0.5) - whole for w in own)
        want[i, out[i], len(own), sum(counts[w] > 0 for w in own), n, round(base, 6)] += 1
    got = Counter((r.doc_id, r.held_out, r.n_tokens, r.n_known, r.train_tokens, round(r.base_score, 6)) for r in rows)
    assert got == want
    assert all(math.isfinite(r.score) and r.score <= 1e-6 for r in rows)


def test_base_counts_and_odd_rows(spark, monkeypatch):
    monkeypatch.setattr(maxent, "FREQUENT", 40)  # so that most tokens take the join
    texts = [None, "", "a a a A b", "é É x", "w " * 30_000, *(f"w{i} v{i % 3} the the end" for i in range(40))]
    docs = [(i, t) for i, t in enumerate(texts)] + [(3, "é É x"), (None, "q the")]
    df = spark.createDataFrame([(i, t, 1) for i, t in docs], "doc_id long, text string, row int")
    check(maxent.score(df).collect(), docs)
    assert maxent.score(df.limit(0)).count() == 0


def test_query(spark, sf_dir):
    docs = [(r.doc_id, r.text) for r in spark.read.parquet(f"{sf_dir}/documents.parquet").collect()]
    check(QUERIES["op7_hashed_maxent"](spark, sf_dir).collect(), docs)


def test_model_beats_the_base_on_held_out_texts(spark):
    rows = [r for r in QUERIES["op7_hashed_maxent"](spark, "/root/testdata/sf0.01").collect() if r.held_out]
    assert sum(r.score for r in rows) > 0.9 * sum(r.base_score for r in rows)


def test_probabilities_sum_to_one(spark):
    docs = spark.createDataFrame([(i, t) for i, t in enumerate(["a b c a b", "b c d d e f", "g h i a"] * 20)], "doc_id long, text string")
    counts = maxent.count_tokens(docs).cache()
    tables, n, v = maxent.build_tables(counts)
    assert (n, v) == (sum(r.c for r in counts.collect()), counts.count())
    weights = maxent.train(maxent.context_counts(docs, tables), steps=3)
    p = np.exp(maxent.logits(weights, np.arange(0, maxent.CONTEXTS**2, 97)))
    assert p.sum(axis=1) == pytest.approx(1)
    f = len(tables.code)
    by_class = Counter()
    for r in counts.collect():
        i = tables.code.get(bytes(r.token))
        k, lp = (tables.classes[i], tables.within[i]) if i is not None else (tables.classes[f + r.ending], tables.within[f + r.ending] + math.log10(r.c))
        by_class[int(k)] += 10**lp
    for k, total in by_class.items():
        spare = 0 if k < maxent.OWN_CLASSES + 2 else 10 ** tables.unseen[k - maxent.OWN_CLASSES - 2]
        assert total + spare == pytest.approx(1), k


def test_training_gains(spark):
    docs = spark.createDataFrame([(i, "a b " * 50) for i in range(4)], "doc_id long, text string")
    tables, *_ = maxent.build_tables(maxent.count_tokens(docs).cache())
    cells = maxent.context_counts(docs, tables).cache()
    rows = cells.collect()
    gain = [sum(r.n * maxent.logits(maxent.train(cells, steps=s), np.array([r.context]))[0, r["class"]] for r in rows) for s in (0, 4, 12)]
    assert gain[0] < gain[1] < gain[2]


@pytest.mark.parametrize("frequent", [40, 100_000])
def test_pairs_count_by_identity(spark, monkeypatch, frequent):
    monkeypatch.setattr(maxent, "FREQUENT", frequent)
    words = [f"w{i:03}x" for i in range(600)]  # more than own contexts, of one ending
    docs = [(i, " ".join(words[i % 50 :: 7])) for i in range(200)] + [(200, "w001x w001x w001x")]
    out = [i for i in range(1000, 1100) if zlib.crc32(str(i).encode()) % 5 == 1][:2]
    docs += [(out[0], " ".join(words[300:500:7])), (out[1], " ".join(words[300:500:7][::-1]))]
    df = spark.createDataFrame(docs, "doc_id long, text string")
    got = {r.doc_id: r for r in maxent.score(df).collect()}
    assert got[out[0]].score > got[out[1]].score + 10
    monkeypatch.setattr(maxent, "PULL", 1e-9)  # the counts alone
    got = {r.doc_id: r for r in maxent.score(df).collect()}
    pairs, before = Counter(), Counter()
    for i, t in docs:
        if zlib.crc32(str(i).encode()) % 5 != 1:
            own = tokens(t)
            pairs.update(zip([b"", *own], own))
            before.update([b"", *own[:-1]])
    for i, t in docs:
        if not got[i].held_out:
            own = tokens(t)
            assert got[i].score == pytest.approx(sum(math.log10(pairs[a, w] / before[a]) for a, w in zip([b"", *own], own)), abs=1e-4)


def test_room_on_disk(spark):
    """Bytes that tasks write into shuffles and into the shared folder, on texts whose pairs hardly come again."""
    rng, size = np.random.default_rng(7), 800_000
    texts = [" ".join(f"w{x:x}" for x in rng.integers(0, 20_000, 400)) for _ in range(size // 400)]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(4).cache()
    assert docs.count() == len(texts)
    sc, jvm = spark.sparkContext._jsc.sc(), spark._jvm

    def written():
        sc.listenerBus().waitUntilEmpty()
        none = jvm.java.util.ArrayList
        stages = sc.statusStore().stageList(none(), False, False, spark.sparkContext._gateway.new_array(jvm.double, 0), none())
        return {stages.apply(i).stageId(): stages.apply(i).shuffleWriteBytes() + stages.apply(i).outputBytes() for i in range(stages.size())}

    old = written()
    assert len(maxent.score(docs).collect()) == len(texts)
    docs.unpersist()
    new = {i: n for i, n in written().items() if i not in old}
    assert 0 < sum(new.values()) < 25 * size  # 33 a token when each occurrence was a row of a join


def test_score_by_plain_code(spark, monkeypatch):
    """Several chunks and buckets, tokens of all kinds, against loops over single tokens."""
    monkeypatch.setattr(maxent, "FREQUENT", 60)
    monkeypatch.setattr(maxent, "CHUNK", 700)
    monkeypatch.setattr(maxent, "BUCKET", 100)
    rng = np.random.default_rng(5)
    texts = [" ".join(f"W{int(x)}e{int(x) % 7}" for x in rng.exponential(25, n)) for n in rng.integers(0, 40, 60)]
    texts += [None, "", " \t\v\f\r\n ", "  x  X x\n", "gone gone only here É", "y " * 3000]
    held = [i for i in range(1000) if zlib.crc32(str(i).encode()) % 5 == 1]
    docs = [*enumerate(texts), *zip(held[50:], ["  x  X x\n", "never never seen w1e1", "", None, "y y w2e2 y"]), (None, "x x"), (0, texts[0])]
    df = spark.createDataFrame(docs, "doc_id long, text string").repartition(2)
    got = Counter((r.doc_id, r.n_tokens, round(r.score, 3)) for r in maxent.score(df).collect())
    training = [t for i, t in docs if i is None or zlib.crc32(str(i).encode()) % 5 != 1]
    train = spark.createDataFrame([(t,) for t in training], "text string")
    counts = maxent.count_tokens(train).cache()
    tables, n, _ = maxent.build_tables(counts)
    weights = maxent.train(maxent.context_counts(train, tables))
    c, pairs = Counter(w for t in training for w in tokens(t)), Counter(x for t in training for x in zip([b"", *tokens(t)], tokens(t)))
    assert {bytes(r.token): r.c for r in counts.collect()} == c
    f, want = len(tables.code), Counter()
    code = {w: tables.code.get(w, f + zlib.crc32(w[-2:]) % maxent.ENDINGS) for _, t in docs for w in tokens(t)}
    assert 0 < f < len(c) and n == c.total()
    for i, t in docs:
        own, total = tokens(t), 0.0
        for at, w in enumerate(own):
            one = tables.contexts[code[own[at - 1]]] if at > 0 else 0
            two = tables.contexts[code[own[at - 2]]] if at > 1 else 0
            same = at > 0 and own[at - 1] == w
            k = maxent.SAME if same else tables.classes[code[w]]
            prior = maxent.logits(weights, np.array([two * maxent.CONTEXTS + one]))[0, k] / math.log(10)
            if not same:
                e = code[w] - f
                prior += tables.within[code[w]] if e < 0 else tables.within[code[w]] + math.log10(c[w]) if c[w] else tables.unseen[e]
            before = own[at - 1] if at else b""
            total += math.log10((pairs[before, w] + maxent.PULL * 10**prior) / (c[before] + maxent.PULL))
        want[i, len(own), round(total, 3)] += 1
    close = sorted(got.elements(), key=str), sorted(want.elements(), key=str)
    assert [x[:2] for x in close[0]] == [x[:2] for x in close[1]]
    assert [x[2] for x in close[0]] == pytest.approx([x[2] for x in close[1]], abs=2e-3)
