"""Quality rules with host-level verdicts.

Each document is measured against rules; failures are summed by host (the source), the hosts' failure rates are shrunk
towards a beta prior fitted to all hosts by moments, and the hosts' verdicts are joined back.  A host's verdict comes from
its posterior: if it is nearly sure (the posterior mean less SURE standard deviations) that the host's rate is above both FACTOR
times the rate of the whole corpus and HOST_FLOOR, the host loses all its documents; others lose only those that fail a
rule themselves.

A null or empty text has no words and fails the base rule.  Null hosts are one host.  Repeated rows count each.  Columns of the
caller pass, whatever their names.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ledgerline.llm.common import cut, pack

BLANKS = " \t\n\x0b\x0c\r"
SPLIT = "[\\x20\\x09-\\x0D]+"
MIN_WORDS = 50
#: Percent of words in repeated three-word windows, and of repeated lines; symbols by 100 words.
MAX_REPEATED, MAX_DUP_LINES, MAX_SYMBOLS = 50, 30, 30
FACTOR, SURE, HOST_FLOOR = 2.0, 2.0, 0.5
#: The prior weighs as much as so many documents, at least and at most.
LEAST_WEIGHT, MOST_WEIGHT = 1.0, 1000.0
#: Hosts with at least one in so many of all documents are joined by salt.
HOT_SHARE, SALTS = 200, 64

MEASURES = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "n_lines")


def measure(docs: DataFrame, text: str = "text", carry: list[str] | None = None) -> DataFrame:
    """`doc` (the columns `carry` of docs, all by default) with the counts in MEASURES (long)."""
    flat = pack(docs, carry, t=text).withColumn("t", F.coalesce(F.col("t").cast("string"), F.lit("")))
    trimmed = F.btrim(F.col("t"), F.lit(BLANKS))
    split = flat.select(
        "doc",
        F.when(trimmed == "", F.array().cast("array<string>")).otherwise(F.split(trimmed, SPLIT)).alias("words"),
        F.filter(F.split("t", "\n", -1), lambda x: F.btrim(x, F.lit(BLANKS)) != "").alias("lines"),
        F.length(F.translate("t", BLANKS, "")).cast("long").alias("word_chars"),
        (F.length("t") - F.length(F.translate("t", "#*$%&|<>", ""))).cast("long").alias("n_symbols"),
    )
    w = F.col("words")
    gram = F.transform(w, lambda x, i: F.struct(F.xxhash64(x, F.get(w, i + 1), F.get(w, i + 2)).alias("h"), i.alias("i")))
    counted = split.select(
        "doc", "word_chars", "n_symbols",
        F.size(w).cast("long").alias("n_words"),
        F.size("lines").cast("long").alias("n_lines"),
        (F.size("lines") - F.size(F.array_distinct("lines"))).cast("long").alias("n_dup_lines"),
        F.sort_array(F.slice(gram, 1, F.greatest(F.size(w) - 2, F.lit(0)))).alias("ordered"),
    )
    o = F.col("ordered")
    twice = F.filter(
        o, lambda x, j: F.coalesce(F.get(o, j - 1)["h"] == x["h"], F.lit(False)) | F.coalesce(F.get(o, j + 1)["h"] == x["h"], F.lit(False))
    )
    places = F.sort_array(F.transform(twice, lambda x: x["i"]))
    covered = F.aggregate(
        places, F.struct(F.lit(0).alias("end"), F.lit(0).alias("n")),
        lambda s, i: F.struct((i + 3).alias("end"), (s["n"] + i + 3 - F.greatest(i, s["end"])).alias("n")),
    )
    return counted.select("doc", *MEASURES[:4], covered["n"].cast("long").alias("n_repeat_words"), "n_lines")


def rules(measured: DataFrame) -> DataFrame:
    """measured with base_failed and rule_failed (the base or any other rule)."""
    base = (F.col("n_words") < MIN_WORDS) | (100 * F.col("n_repeat_words") > MAX_REPEATED * F.col("n_words"))
    more = (100 * F.col("n_dup_lines") > MAX_DUP_LINES * F.col("n_lines")) | (100 * F.col("n_symbols") > MAX_SYMBOLS * F.col("n_words"))
    return measured.withColumn("base_failed", base).withColumn("rule_failed", F.col("base_failed") | more)


def host_rates(ruled: DataFrame, host: str = "source") -> DataFrame:
    """host, n, failed, rate (shrunk), host_failed and hot: a row for each host."""
    hosts = ruled.groupBy(F.col("doc")[host].alias("host")).agg(F.count("*").alias("n"), F.sum(F.col("rule_failed").cast("long")).alias("failed"))
    hosts = cut(hosts, "host-failures")
    raw = F.col("failed") / F.col("n")
    # Rounded decimals, so that the order of rows doesn't matter.
    exact = lambda c: c.cast("decimal(38,18)")
    own = hosts.agg(
        F.avg(exact(raw)).alias("mean"), F.avg(exact(raw * raw)).alias("square"), F.avg(exact(raw * (1 - raw) / F.col("n"))).alias("noise"),
        F.count("*").alias("hosts"), F.sum("n").alias("total"), F.sum("failed").alias("failed"),
    ).first()
    mean, square, noise = (float(own[k] or 0) for k in ("mean", "square", "noise"))
    spread = max((square - mean**2) * own["hosts"] / max(own["hosts"] - 1, 1) - noise, 1e-9)
    weight = min(max(mean * (1 - mean) / spread - 1, LEAST_WEIGHT), MOST_WEIGHT)
    rate = (F.col("failed") + mean * weight) / (F.col("n") + weight)
    low = F.col("rate") - SURE * F.sqrt(F.col("rate") * (1 - F.col("rate")) / (F.col("n") + weight + 1))
    limit = max(FACTOR * (own["failed"] or 0) / max(own["total"] or 0, 1), HOST_FLOOR)
    return hosts.select("host", "n", "failed", rate.alias("rate")).withColumns({"host_failed": low > limit, "hot": F.col("n") * HOT_SHARE >= F.lit(own["total"] or 0)})


def judge(docs: DataFrame, text: str = "text", host: str = "source", carry: list[str] | None = None) -> DataFrame:
    """`doc` (the columns `carry` of docs, all by default; host among them) with MEASURES, base_failed, rule_failed, rate, host_failed and kept.

    What the rules measured is written once; both the sums by host and the join back read that.  Hosts with a large
    share of all documents (at most HOT_SHARE of them) are known from a broadcast; their rows are salted.
    """
    ruled = cut(rules(measure(docs, text, carry)), "rule-counts")
    rates = cut(host_rates(ruled, host), "host-rates")
    verdicts = rates.select(
        "host", "rate", "host_failed",
        F.explode(F.when(F.col("hot"), F.sequence(F.lit(0), F.lit(SALTS - 1))).otherwise(F.array(F.lit(0)))).alias("salt"),
    )
    known = F.broadcast(rates.where("hot").select(F.col("host").alias("hot_host"), F.lit(True).alias("hot")))  # at most HOT_SHARE rows
    own = F.col("doc")[host]
    salted = ruled.join(known, own.eqNullSafe(F.col("hot_host")), "left")
    salted = salted.withColumn("own_salt", F.when(F.col("hot"), F.pmod(F.xxhash64("doc", *MEASURES), F.lit(SALTS)).cast("int")).otherwise(0))
    joined = salted.join(verdicts, own.eqNullSafe(F.col("host")) & (F.col("own_salt") == F.col("salt")))
    return joined.select(*ruled.columns, "rate", "host_failed", (~F.col("rule_failed") & ~F.col("host_failed")).alias("kept"))
