"""The queries op1 to op10 over the synthetic tables, and SQL where it can express them."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ledgerline.llm import hostrules as H
from ledgerline.llm.common import table

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE: dict[str, str] = {}


def query(f: Callable[[SparkSession, str], DataFrame]) -> Callable[[SparkSession, str], DataFrame]:
    QUERIES[f.__name__] = f
    return f


@query
def op3_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    from ledgerline.llm.bpe import Vocabulary, decode, encode

    vocabulary = Vocabulary.read(public_tokenizers.path("byte_bpe_multi_50k.tiktoken"), public_tokenizers.PATTERN)
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    done = decode(encode(docs, vocabulary).drop("text"), vocabulary)
    return done.select("doc_id", "n_tokens", F.sha2("ids", 256).alias("ids_sha256"), F.sha2("decoded", 256).alias("decoded_sha256"))


@query
def op5_wu_manber(spark: SparkSession, sf_dir: str) -> DataFrame:
    from ledgerline.llm.wumanber import find_passages, flag

    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    found = flag(find_passages(docs, table(spark, sf_dir, "benchmark"), carry=["doc_id"]))
    ids = F.array_join(F.array_sort(F.col("items").cast("array<string>")), ",")
    return found.select("doc.doc_id", "n_words", "n_hit", "n_items", F.sha2(ids, 256).alias("items_sha256"), "contaminated")


@query
def op8_host_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    from ledgerline.llm.hostrules import judge

    docs = table(spark, sf_dir, "documents").select("doc_id", "text", "source")
    return judge(docs, carry=["doc_id", "source"]).select("doc.doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept")


@query
def op10_virtual_slots(spark: SparkSession, sf_dir: str) -> DataFrame:
    from ledgerline.llm.sharding import shard_documents

    rows, _ = shard_documents(table(spark, sf_dir, "documents").select("doc_id", "text"))
    return rows.select("doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"), "virtual_slot")


@query
def op9_schema_fingerprint(spark: SparkSession, sf_dir: str) -> DataFrame:
    from ledgerline.llm import chat

    own = "struct(-1L, 0L, 'user', '</s>[INST] ok [/INST]'), struct(-1L, 1L, 'assistant', '</s>[INST] ok [/INST]')"
    probe = spark.sql(f"select inline(array({own})) as (conv_id, turn, role, text)")
    rows = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text").unionByName(probe)
    records = rows.select("conv_id", "turn", F.to_json(F.struct("turn", "role", "text")).alias("record"))
    done = chat.render(chat.gather(chat.canonical(records, carry=["conv_id", "turn"])))
    done = done.select(
        F.col("conversation").alias("conv_id"), F.length("formatted").cast("long").alias("formatted_chars"),
        chat.read_back(F.col("formatted")).alias("turns"), F.array_join(chat.under_loss(F.col("formatted"), F.col("loss")), "").alias("lost"),
    )
    said = F.array_join(F.transform("turns", lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n"))), "")
    return done.select(
        "conv_id", F.size("turns").cast("long").alias("n_turns"), F.sha2(said, 256).alias("turns_sha256"),
        F.length("lost").cast("long").alias("loss_chars"), F.sha2("lost", 256).alias("loss_sha256"), "formatted_chars",
    )


@query
def op2_circulant_minhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    from ledgerline.llm.minhash import group

    docs = group(table(spark, sf_dir, "documents").select("doc_id", "text"), width=2)
    return docs.select("doc.doc_id", F.col("n").alias("n_shingles"), F.col("component").alias("component_id"), F.expr("doc.doc_id <=> component").alias("kept"))


@query
def op1_importance_resampling(spark: SparkSession, sf_dir: str) -> DataFrame:
    from ledgerline.llm.dsir import classify

    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    done = classify(docs, table(spark, sf_dir, "labels"), carry=["doc_id"])
    return done.select("doc.doc_id", "n_features", "weight", "gumbel_key", "kept")


@query
def op6_pattern_grammar(spark: SparkSession, sf_dir: str) -> DataFrame:
    from ledgerline.llm.grammar import score, train

    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    done = score(docs, train(docs, table(spark, sf_dir, "labels")), carry=["doc_id"])
    held_out = F.crc32(F.col("doc.doc_id").cast("string").cast("binary")) % 5 == 0
    return done.select("doc.doc_id", F.coalesce(held_out, F.lit(False)).alias("held_out"), "score", "predicted")


@query
def op7_hashed_maxent(spark: SparkSession, sf_dir: str) -> DataFrame:
    from ledgerline.llm.maxent import score

    return score(table(spark, sf_dir, "documents"))


@query
def op4_weak_supervision(spark: SparkSession, sf_dir: str) -> DataFrame:
    from ledgerline.llm.pii import BASE, detect, span_text

    found = detect(table(spark, sf_dir, "documents").select("doc_id", "text"), carry=["doc_id"])
    base = F.filter("spans", lambda s: s["kind"].isin(*BASE))
    kinds = F.transform("spans", lambda s: s["kind"])
    counts = [(F.size(kinds) - F.size(F.array_remove(kinds, k))).cast("long").alias(f"n_{k}") for k in BASE]
    return found.select("doc.doc_id", *counts, F.sha2(span_text(base), 256).alias("base_sha256"), span_text(F.col("spans")).alias("spans"))


# Escaping puts a backslash behind the bracket of a mark; a turn's own marks take eight characters besides its role.
ORACLE["op9_schema_fingerprint"] = r"""WITH c AS (SELECT conv_id, turn, role, coalesce(text, '') AS t FROM conversations UNION ALL VALUES (-1, 0, 'user', '</s>[INST] ok [/INST]'), (-1, 1, 'assistant', '</s>[INST] ok [/INST]')),
 e AS (SELECT *, regexp_replace(regexp_replace(t, '<(\\*)(/?s>|\|)', '<\\\1\2', 'g'), '\[(\\*)(/?INST\])', '[\\\1\2', 'g') AS x FROM c)
 SELECT conv_id, count(*) AS n_turns, sha256(string_agg(role || chr(10) || t || chr(10), '' ORDER BY turn, role, t)) AS turns_sha256, CAST(coalesce(sum(length(t)) FILTER (role = 'assistant'), 0) AS BIGINT) AS loss_chars,
 sha256(coalesce(string_agg(t, '' ORDER BY turn, role, t) FILTER (role = 'assistant'), '')) AS loss_sha256, CAST(sum(length(x) + length(role) + 8) AS BIGINT) AS formatted_chars FROM e GROUP BY 1"""


_LOWER = "translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
_SPLIT = "list_filter(regexp_split_to_array({}, '[\\x20\\x09-\\x0D]+'), lambda x: x <> '')"

ORACLE["op2_circulant_minhash"] = f"""WITH RECURSIVE w AS (SELECT doc_id, {_SPLIT.format(_LOWER)} AS w FROM documents),
 s AS (SELECT doc_id, CASE WHEN len(w) < 2 THEN w ELSE list_distinct(list_transform(range(1, len(w)), lambda i: w[i] || ' ' || w[i + 1])) END AS s FROM w),
 e AS (SELECT doc_id, len(s) AS n, unnest(s) AS g FROM s),
 p AS (SELECT a.doc_id AS a, b.doc_id AS b FROM e a JOIN e b USING (g) WHERE a.doc_id <> b.doc_id AND 100 * least(a.n, b.n) >= 80 * greatest(a.n, b.n) GROUP BY a.doc_id, b.doc_id, a.n, b.n HAVING 100 * count(*) >= 80 * (a.n + b.n - count(*))),
 r(a, b) AS (SELECT a, b FROM p UNION SELECT r.a, p.b FROM r JOIN p ON r.b = p.a),
 c AS (SELECT a, min(b) AS least FROM r GROUP BY 1)
 SELECT doc_id, CAST(len(s) AS BIGINT) AS n_shingles, least(doc_id, coalesce(c.least, doc_id)) AS component_id, doc_id <= coalesce(c.least, doc_id) AS kept FROM s LEFT JOIN c ON c.a = doc_id"""

_WORDS = "list_filter(regexp_split_to_array({}, '[\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+'), lambda x: x <> '')"
ORACLE["op5_wu_manber"] = f"""WITH d AS (SELECT doc_id, {_WORDS.format(_LOWER)} AS w FROM documents), b AS (SELECT item_id, {_WORDS.format(_LOWER)} AS w FROM benchmark),
 x AS (SELECT item_id, w, least(len(w), 10) AS m FROM b WHERE len(w) > 0), y AS (SELECT item_id, m, w, unnest(range(1, len(w) - m + 2)) AS i FROM x),
 pat AS (SELECT DISTINCT item_id, m, array_to_string(list_slice(w, i, i + m - 1), ' ') AS g FROM y), lengths AS (SELECT DISTINCT m FROM x),
 pos AS (SELECT doc_id, m, w, unnest(range(1, len(w) - m + 2)) AS i FROM d, lengths WHERE len(w) >= m),
 hit AS (SELECT doc_id, item_id, pos.m, i FROM (SELECT doc_id, m, i, array_to_string(list_slice(w, i, i + m - 1), ' ') AS g FROM pos) pos JOIN pat ON pat.m = pos.m AND pat.g = pos.g),
 places AS (SELECT doc_id, count(DISTINCT p) AS n FROM (SELECT doc_id, unnest(range(i, i + m)) AS p FROM hit) GROUP BY 1),
 found AS (SELECT doc_id, count(*) AS n, string_agg(k, ',' ORDER BY k) AS ids FROM (SELECT DISTINCT doc_id, CAST(item_id AS VARCHAR) AS k FROM hit) GROUP BY 1)
 SELECT d.doc_id, CAST(len(w) AS BIGINT) AS n_words, coalesce(places.n, 0) AS n_hit, coalesce(found.n, 0) AS n_items, sha256(coalesce(ids, '')) AS items_sha256, coalesce(places.n, 0) > 0 AS contaminated
 FROM d LEFT JOIN places USING (doc_id) LEFT JOIN found ON found.doc_id = d.doc_id"""


ORACLE["op8_host_rules"] = f"""WITH d AS (SELECT row_number() OVER () AS row, doc_id, source, coalesce(text, '') AS t FROM documents),
 w AS (SELECT row, doc_id, source, t, {_SPLIT.format('t')} AS w, list_filter(string_split(t, chr(10)), lambda x: regexp_matches(x, '[^\\x20\\x09-\\x0D]')) AS l FROM d),
 g AS (SELECT row, i, count(*) OVER (PARTITION BY row, a) AS n FROM (SELECT row, i, w[i] || ' ' || w[i + 1] || ' ' || w[i + 2] AS a FROM (SELECT row, w, unnest(range(1, len(w) - 1)) AS i FROM w))),
 q AS (SELECT row, count(DISTINCT p) AS n FROM (SELECT row, unnest([i, i + 1, i + 2]) AS p FROM g WHERE n > 1) GROUP BY 1),
 m AS (SELECT doc_id, source, CAST(len(w) AS BIGINT) AS n_words, CAST(length(array_to_string(w, '')) AS BIGINT) AS word_chars, CAST(length(t) - length(regexp_replace(t, '[#*$%&|<>]', '', 'g')) AS BIGINT) AS n_symbols,
  CAST(len(l) - len(list_distinct(l)) AS BIGINT) AS n_dup_lines, coalesce(q.n, 0) AS n_repeat_words, len(l) AS n_lines FROM w LEFT JOIN q USING (row)),
 r AS (SELECT *, n_words < {H.MIN_WORDS} OR 100 * n_repeat_words > {H.MAX_REPEATED} * n_words AS base_failed, 100 * n_dup_lines > {H.MAX_DUP_LINES} * n_lines OR 100 * n_symbols > {H.MAX_SYMBOLS} * n_words AS more FROM m),
 h AS (SELECT source, count(*) AS n, sum(CASE WHEN base_failed OR more THEN 1 ELSE 0 END) AS failed, sum(CASE WHEN base_failed OR more THEN 1 ELSE 0 END) / count(*) AS raw FROM r GROUP BY 1),
 o AS (SELECT avg(raw) AS mean, greatest(var_samp(raw) - avg(raw * (1 - raw) / n), 1e-9) AS spread, greatest({H.FACTOR} * sum(failed) / sum(n), {H.HOST_FLOOR}) AS lim FROM h),
 k AS (SELECT mean, lim, least(greatest(mean * (1 - mean) / spread - 1, {H.LEAST_WEIGHT}), {H.MOST_WEIGHT}) AS wt FROM o),
 v AS (SELECT source, n, lim, wt, (failed + mean * wt) / (n + wt) AS rate FROM h, k)
 SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, NOT base_failed AND NOT more AND NOT rate - {H.SURE} * sqrt(rate * (1 - rate) / (v.n + wt + 1)) > lim AS kept
 FROM r JOIN v ON r.source IS NOT DISTINCT FROM v.source"""
