import numpy as np
from pyspark.sql import functions as F

from ledgerline.llm import grammar
from ledgerline.llm.queries import QUERIES

KIND = lambda threat, neg, rep, aim: ((threat * 2 + neg) * 2 + rep) * 2 + aim


def kinds(text):
    x = grammar.Grammar({b"fool": 3.0, b"vequ": 5.0}).sums(text)
    return {int(k) for k in np.flatnonzero(x)}


def test_clauses_decide_the_kind():
    assert kinds("what a fool") == {KIND(0, 0, 0, 0)} and kinds("You fools!") == {KIND(0, 0, 0, 1)}
    assert kinds("he is not a fool") == {KIND(0, 1, 0, 0)} and kinds("not that it matters much, a fool") == {KIND(0, 0, 0, 0)}
    assert kinds("she said: a fool") == {KIND(0, 0, 1, 0)} and kinds("she said. a fool") == {KIND(0, 0, 0, 0)}
    assert kinds("I will hurt you") == {KIND(1, 0, 0, 1)} and kinds("they hurt nobody") == set() and kinds("hurt. you") == set()
    assert kinds("Véquipe vequité foo") == {KIND(0, 0, 0, 0)}
    assert kinds(None) == kinds("") == kinds("...\n") == set()


def test_composed_machine_matches_its_parts():
    arcs = grammar.compose()
    rng = np.random.default_rng(1)
    for _ in range(200):
        symbols, state, left, rep, aim = rng.integers(0, 6, 12).tolist(), 0, 0, 0, 0
        for s in symbols:
            nxt, out = arcs[state, s]
            assert (out is not None) == (s in (grammar.INSULT, grammar.THREAT))
            if out is not None:
                assert out == KIND(int(s == grammar.THREAT), int(left > 0), rep, 0)
            left = grammar.SCOPE if s == grammar.NEGATION else max(0, left - 1)
            rep, aim = int(rep or s == grammar.REPORT), int(aim or s == grammar.TARGET)
            state = nxt
            assert state == (left * 2 + rep) * 2 + aim


def test_a_lone_match_weighs_less_in_a_long_text():
    g = grammar.Grammar({b"fool": 3.0})
    assert g.sums("fool")[0] > g.sums("fool " + "word " * 500)[0] > 0


def test_scores_against_plain_code(spark, sf_dir):
    """The transducer's sums, read off the definition: negation within SCOPE words before, report and target anywhere before, or in the clause."""
    docs, labels = (spark.read.parquet(f"{sf_dir}/{t}.parquet") for t in ("documents", "labels"))
    model = grammar.train(docs, labels)
    lexicon = grammar.Lexicon(model.prefixes)
    seen = 0
    for r in grammar.score(docs, model, carry=["doc_id", "text"]).collect():
        want, n = np.zeros(grammar.KINDS), grammar.LENGTH
        for clause in grammar.clauses(r.doc.text):
            read = [lexicon(w) for w in clause]
            symbols = [s for s, _ in read]
            aimed = grammar.TARGET in symbols
            for i, (s, weight) in enumerate(read):
                if s == grammar.INSULT or s == grammar.THREAT and aimed:
                    negated = grammar.NEGATION in symbols[max(0, i - grammar.SCOPE) : i]
                    want[KIND(s == grammar.THREAT, negated, grammar.REPORT in symbols[:i], aimed)] += weight
            n += len(clause)
        z = want * grammar.LENGTH / n @ model.weights + model.bias
        assert abs(r.score - 1 / (1 + np.exp(-np.clip(z, -30, 30)))) < 1e-9 and r.predicted == int(r.score >= 0.5)
        seen += bool(want.any())
    assert seen


def test_held_out_accuracy(spark):
    sf_dir = "/root/testdata/sf0.01"
    rows = QUERIES["op6_pattern_grammar"](spark, sf_dir)
    got = rows.join(spark.read.parquet(f"{sf_dir}/labels.parquet"), "doc_id").where("held_out").collect()
    toxic, clean = [r.predicted for r in got if r.toxic == 1], [r.predicted for r in got if r.toxic == 0]
    assert np.mean(toxic) >= 0.6 and np.mean(clean) <= 0.02


def test_odd_rows_and_no_labels(spark):
    names = ["_kinds", "score", "predicted", "doc", "own_text", "toxic", "_k"]
    docs = spark.createDataFrame([(1, None, *names), (1, "", *names), (None, "x " * 100_000, *names)], ["doc_id", "text", *names])
    labels = spark.createDataFrame([], "doc_id long, toxic int")
    got = grammar.score(docs, grammar.train(docs, labels)).collect()
    assert len(got) == 3 and all(0 < r.score < 0.5 and r.predicted == 0 and [r.doc[n] for n in names] == names for r in got)
    assert grammar.score(docs.limit(0), grammar.train(docs.limit(0), labels)).count() == 0
    same = spark.createDataFrame([(1, 1), (2, 1), (3, None)], "doc_id long, toxic int")
    model = grammar.train(docs.withColumn("doc_id", F.coalesce("doc_id", F.lit(2))), same)
    assert model.bias == grammar.PRIOR_BIAS


def test_an_id_in_many_rows_counts_once(spark):
    import zlib

    ids = [i for i in range(50) if zlib.crc32(str(i).encode()) % 5 != 0][:2]
    docs = spark.createDataFrame([(ids[0], "you worthless idiots are scum")] * 60 + [(ids[1], "a calm day at the lake")] * 60, "doc_id long, text string").coalesce(1)
    labels = spark.createDataFrame([(ids[0], 1), (ids[1], 0)], "doc_id long, toxic int")
    model = grammar.train(docs, labels, most=2)
    assert model.prefixes and (model.weights != grammar.PRIOR).any()
