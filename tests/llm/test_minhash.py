import random
import re

import numpy as np

from ledgerline.llm import minhash
from ledgerline.llm.graph import components
from ledgerline.llm.queries import QUERIES

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def shingles(text, width):
    w = WORD.findall("".join(c.lower() if "A" <= c <= "Z" else c for c in text or ""))
    if not w:
        return set()
    n = min(width, len(w))
    return {tuple(w[i : i + n]) for i in range(len(w) - n + 1)}


def brute(rows, width, percent=80):
    """rows: (id, text); the least id of each row's group."""
    sets = [shingles(t, width) for _, t in rows]
    top = list(range(len(rows)))

    def find(i):
        while top[i] != i:
            i = top[i]
        return i

    for i, a in enumerate(sets):
        for j in range(i):
            both = len(a & sets[j])
            if a and sets[j] and 100 * both >= percent * (len(a) + len(sets[j]) - both):
                top[find(i)] = find(j)
    least = {}
    for i, (k, _) in enumerate(rows):
        r = find(i)
        least[r] = min(least.get(r, k), k)
    return [(len(sets[i]), least[find(i)]) for i in range(len(rows))]


def say(rng, n):
    return [f"{rng.choice('abcdefgh')}{rng.randint(0, 99)}" for _ in range(n)]


def corpus():
    rng = random.Random(11)
    texts = [None, "", " \n", "a", "A", "a b", "x" * 100_000, "w " * 50_000]
    for n in (3, 8, 40, 200):
        for _ in range(6):
            base = say(rng, n)
            texts.append(" ".join(base))
            for _ in range(rng.randint(0, 6)):
                copy = list(base)
                for _ in range(rng.randint(0, max(1, n // 18))):
                    copy[rng.randrange(n)] = "zz"
                texts.append(" \n".join(copy).upper())
    return [(i * 7 % 1009, t) for i, t in enumerate(texts)]


def test_against_all_pairs(spark):
    rows = corpus()
    own = ["_key", "head", "n", "component", "kept", "doc", "_n", "_row"]
    df = spark.createDataFrame([(k, t, *own) for k, t in rows], ["doc_id", "text", *own])
    for width in (2, 5):
        got = {r.doc.doc_id: r for r in minhash.group(df, width=width).collect()}
        assert len(got) == len(rows)
        for (k, _), (n, least) in zip(rows, brute(rows, width), strict=True):
            assert (got[k].n, got[k].component, got[k].kept, [got[k].doc[c] for c in own]) == (n, least, k == least, own)
    kept = minhash.deduplicate(df)
    assert kept.columns == df.columns and all(r[c] == c for r in kept.collect() for c in own)


def test_one_row_of_each_group_stays(spark):
    text = " ".join(say(random.Random(1), 60))
    rows = [(5, text), (5, text), (None, text), (9, text + " end"), (1, "other words"), (2, None), (3, ""), (None, None)]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    kept = minhash.deduplicate(df)
    assert kept.columns == ["doc_id", "text"]
    assert sorted((r.doc_id or -1, r.text or "") for r in kept.collect()) == sorted([(5, text), (1, "other words"), (2, ""), (3, ""), (-1, "")])
    assert minhash.deduplicate(df.limit(0)).count() == 0


def test_query(spark, sf_dir):
    rows = [(r.doc_id, r.text) for r in spark.read.parquet(f"{sf_dir}/documents.parquet").collect()]
    got = {r.doc_id: r for r in QUERIES["op2_circulant_minhash"](spark, sf_dir).collect()}
    want = {k: v for (k, _), v in zip(rows, brute(rows, 2), strict=True)}
    assert {k: (r.n_shingles, r.component_id) for k, r in got.items()} == want
    assert all(r.kept == (k == r.component_id) for k, r in got.items())


def test_coordinates_are_shifts_of_one_permutation():
    c = minhash.Circulant()
    assert len(np.unique(c.runs[:, 0])) == minhash.PLACES
    assert (c.runs[1:, 0] == c.runs[:-1, 1]).all() and (c.runs[minhash.PLACES - 1, 1:] == c.runs[0, :-1]).all()
    a = np.arange(1, 400, dtype=np.uint64)
    sim = (c.signature(a) == c.signature(a[40:])).mean()
    assert 0.8 < sim <= 1


def test_components(spark):
    chain = [(i, i + 1) for i in range(40)] + [(100, 101), (103, 101), (None, 5), (7, 7), (100, 101)] + [(200, i) for i in range(201, 260)]
    got = {r.node: r.root for r in components(spark.createDataFrame(chain, "a long, b long")).collect()}
    want = {i: 0 for i in range(41)} | {100: 100, 101: 100, 103: 100} | {i: 200 for i in range(200, 260)}
    assert got == want
    assert components(spark.createDataFrame([], "a long, b long")).count() == 0


def test_blocks_find_what_single_comparisons_find(spark, monkeypatch):
    rng = np.random.default_rng(4)
    sets = [np.unique(rng.integers(0, 60, rng.integers(1, 40))) for _ in range(37)]
    got = minhash.shared_counts(sets[:20], sets[20:], columns=7)
    assert all(got[i, j] == len(np.intersect1d(a, b)) for i, a in enumerate(sets[:20]) for j, b in enumerate(sets[20:]))
    monkeypatch.setattr(minhash, "SMALL", 1)
    monkeypatch.setattr(minhash, "BLOCK_NODES", 5)
    say_ = random.Random(9)
    base = say(say_, 60)
    rows = [(0, "other words here")]
    for i in range(1, 40):  # some linked to the base, some only among themselves, some not at all
        copy = list(base)
        for _ in range(i % 7):
            copy[say_.randrange(60)] = f"q{i % 3}{say_.randrange(9)}"
        rows.append((i, " ".join(copy)))
    df, want = spark.createDataFrame(rows, "doc_id long, text string"), {k: least for (k, _), (_, least) in zip(rows, brute(rows, 2), strict=True)}
    assert {r.doc.doc_id: r.component for r in minhash.group(df, width=2).collect()} == want
    monkeypatch.setattr(minhash, "BLOCK_SHINGLES", 90)
    assert {r.doc.doc_id: r.component for r in minhash.group(df, width=2).collect()} == want
