import random
import re
from collections import Counter

from ledgerline.llm import hostrules
from ledgerline.llm.queries import QUERIES

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def brute(text):
    text = text or ""
    w = WORD.findall(text)
    grams = Counter(zip(w, w[1:], w[2:]))
    covered = {k for i, g in enumerate(zip(w, w[1:], w[2:])) if grams[g] > 1 for k in (i, i + 1, i + 2)}
    lines = [x for x in text.split("\n") if WORD.search(x)]
    return len(w), sum(map(len, w)), sum(c in "#*$%&|<>" for c in text), len(lines) - len(set(lines)), len(covered)


def same(row, text):
    n, *rest = brute(text)
    assert (row.n_words, row.word_chars, row.n_symbols, row.n_dup_lines, row.n_repeat_words) == (n, *rest), text
    assert row.base_failed == (n < 50 or 100 * rest[-1] > 50 * n)
    assert not (row.base_failed and row.kept)


def test_counts_on_odd_texts(spark):
    rng = random.Random(3)
    texts = [None, "", " \n ", "a", "a b", "a b c", "a b c a b c", "a a a a a", "x y z\x0bq", "😀 é\n\n a\na\n a\n", "a\nb\na\r\nb"]
    texts += ["".join(rng.choices(["a", "b", "cc", " ", " ", "\n", "\t", "#"], k=400)) for _ in range(25)] + ["w " * 40_000]
    names = ["words", "lines", "t", "doc", "n_words", "rate", "host", "salt", "hot", "kept", "host_failed", "base_failed"]
    rows = [(i, t, None if i % 3 else "h", *names) for i, t in enumerate(texts)]
    df = spark.createDataFrame(rows, ["doc_id", "text", "source", *names])
    got = {r.doc.doc_id: r for r in hostrules.judge(df).collect()}
    assert len(got) == len(texts) and all([r.doc[n] for n in names] == names for r in got.values())
    for i, t in enumerate(texts):
        same(got[i], t)
    assert hostrules.judge(df.limit(0)).count() == 0


def test_a_bad_host_loses_its_documents(spark):
    good = " ".join(f"w{i}" for i in range(60))
    rows = [(i, good if i % 10 == 0 else "short", "bad") for i in range(200)]
    rows += [(1000 + i, good if i % 10 else "short", f"host{i % 7}") for i in range(400)]
    got = hostrules.judge(spark.createDataFrame(rows, "doc_id long, text string, source string")).collect()
    assert not any(r.kept for r in got if r.doc.source == "bad") and all(r.host_failed == (r.doc.source == "bad") for r in got)
    assert all(r.kept == (r.n_words >= 50) for r in got if r.doc.source != "bad")
    rates = {r.doc.source: r.rate for r in got}
    assert 0.7 < rates["bad"] < 0.9 and all(0.05 < v < 0.3 for k, v in rates.items() if k != "bad")


def test_a_host_of_few_documents_is_not_sure_to_be_bad(spark):
    good = " ".join(f"w{i}" for i in range(60))
    rows = [(i, "short", "small") for i in range(2)] + [(100 + i, good if i % 10 else "short", f"host{i % 41}") for i in range(800)]
    rows += [(2000 + i, good if i % 4 == 0 else "short", "large") for i in range(120)]
    got = hostrules.judge(spark.createDataFrame(rows, "doc_id long, text string, source string"), carry=["source"]).collect()
    assert {r.doc.source for r in got if r.host_failed} == {"large"}


def test_query_and_labels(spark, sf_dir):
    docs = {r.doc_id: r.text for r in spark.read.parquet(f"{sf_dir}/documents.parquet").collect()}
    rows = {r.doc_id: r for r in QUERIES["op8_host_rules"](spark, sf_dir).collect()}
    assert set(rows) == set(docs)
    for k, t in docs.items():
        same(rows[k], t)
    labels = {r.doc_id: r.quality for r in spark.read.parquet(f"{sf_dir}/labels.parquet").collect()}
    clean = [rows[k].kept for k, v in labels.items() if v == 1 and rows[k].n_words >= 50]
    assert sum(clean) >= 0.9 * len(clean)
