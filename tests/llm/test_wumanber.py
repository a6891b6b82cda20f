import hashlib
import random
import re

from ledgerline.llm import wumanber
from ledgerline.llm.queries import QUERIES

WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def words(text):
    return WORD.findall("".join(c.lower() if "A" <= c <= "Z" else c for c in text or ""))


def brute(text, items):
    own, hit, found = words(text), set(), set()
    where = {}
    for n in {min(10, len(words(t))) for _, t in items} - {0}:
        for i in range(len(own) - n + 1):
            where.setdefault(tuple(own[i : i + n]), []).append(i)
    for item, t in items:
        w = words(t)
        m = min(10, len(w))
        for at in range(len(w) - m + 1 if m else 0):
            for i in where.get(tuple(w[at : at + m]), ()):
                hit.update(range(i, i + m))
                found.add(item)
    return len(own), len(hit), sorted(found)


def test_against_brute_force(spark):
    rng = random.Random(5)
    vocabulary = ["a", "b", "c", "É", "x1", "Z"]
    say = lambda n: " ".join(rng.choices(vocabulary, k=n))
    items = [(i, say(n)) for i, n in enumerate([1, 2, 3, 9, 10, 11, 14, 10])] + [(90, ""), (91, None), (7, say(12)), (92, "...")]
    texts = [None, "", "...", *(say(rng.randint(0, 200)) for _ in range(30))]
    texts += [f"q {items[4][1]} w {items[5][1]}, {items[4][1]}", items[6][1].upper(), "qq " * 50_000 + items[4][1]]
    names = ["n_words", "hits", "items", "n_hit", "n_items", "contaminated", "doc", "own_text", "_arg"]
    docs = spark.createDataFrame([(i, t, *names) for i, t in enumerate(texts)], ["doc_id", "text", *names])
    bench = spark.createDataFrame(items, "item_id long, text string")
    for block_words in (wumanber.BLOCK_WORDS, 3):
        got = {r.doc.doc_id: r for r in wumanber.flag(wumanber.find_passages(docs, bench, block_words=block_words)).collect()}
        assert len(got) == len(texts)
        for i, t in enumerate(texts):
            n, hit, found = brute(t, items)
            assert (got[i].n_words, got[i].n_hit, got[i]["items"], got[i].n_items, got[i].contaminated) == (n, hit, found, len(found), hit > 0)
    kept = wumanber.decontaminate(docs, bench)
    assert kept.columns == docs.columns and all(r[n] == n for r in kept.collect() for n in names)
    assert {r.doc_id for r in kept.collect()} == {i for i, t in enumerate(texts) if not brute(t, items)[1]}


def test_long_items_go_in_pieces(spark):
    rng = random.Random(7)
    item = " ".join(f"w{rng.randrange(40)}" for _ in range(500)) + " a b" * 60
    own = item.split()
    texts = [" ".join(own[at : at + 10]) for at in range(0, len(own) - 9, 7)] + [" ".join(own[5:14]), " ".join(reversed(own))]
    docs, bench = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string"), spark.createDataFrame([(4, item)], "item_id long, text string")
    for block_words in (wumanber.BLOCK_WORDS, 64):
        got = wumanber.flag(wumanber.find_passages(docs, bench, block_words=block_words)).collect()
        assert {r.doc.doc_id: (r.n_hit, r["items"]) for r in got} == {i: brute(t, [(4, item)])[1:] for i, t in enumerate(texts)}


def test_no_benchmark_and_no_documents(spark):
    docs = spark.createDataFrame([(1, "a b")], "doc_id long, text string")
    none = spark.createDataFrame([], "item_id long, text string")
    assert [(r.n_words, r.n_hit, r.contaminated) for r in wumanber.flag(wumanber.find_passages(docs, none)).collect()] == [(2, 0, False)]
    assert wumanber.decontaminate(docs.limit(0), none).count() == 0
    assert wumanber.decontaminate(docs, none).columns == ["doc_id", "text"]


def test_query(spark, sf_dir):
    docs = {r.doc_id: r.text for r in spark.read.parquet(f"{sf_dir}/documents.parquet").collect()}
    items = [(r.item_id, r.text) for r in spark.read.parquet(f"{sf_dir}/benchmark.parquet").collect()]
    rows = QUERIES["op5_wu_manber"](spark, sf_dir).collect()
    assert len(rows) == len(docs) and any(r.contaminated for r in rows)
    for r in rows:
        n, hit, found = brute(docs[r.doc_id], items)
        assert (r.n_words, r.n_hit, r.n_items, r.contaminated) == (n, hit, len(found), hit > 0)
        assert r.items_sha256 == hashlib.sha256(",".join(sorted(map(str, found))).encode()).hexdigest()
