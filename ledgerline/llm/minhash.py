"""Near-duplicates by circulant MinHash, banding and exact verification.

A permutation sigma scatters a document's shingles over D places; a second one, pi, is a table of D numbers.  Coordinate
k of the signature is the least pi(sigma(shingle) + k mod D): pi shifted circularly by k.  So all coordinates of a
shingle are one run of the table.  BANDS bands of ROWS coordinates make candidates; a pair of similarity 0.8 escapes all
bands with a probability of 1e-7.  Links are confirmed on the full sets of shingle hashes (64 bits).

Texts with equal sets are one class from the start.  In a bucket, all classes are first compared to the most
central one (that shares most buckets with others); only where a bucket still has several components are the remaining
pairs across components compared too, so that no link within a bucket is lost, yet a large group of copies is not
compared pair by pair.

A document without words has no shingles and is linked with nothing; one with fewer words than a shingle is one
shingle.  Null texts are empty.  Repeated rows are duplicates of each other.  Null ids sort last.  Columns of the caller
pass, whatever their names.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ledgerline.llm.common import append_columns, cut, discard, pack, scratch, unpack
from ledgerline.llm.graph import components

ROWS, BANDS = 6, 54
PLACES = 1 << 21
#: Rounds in which buckets are compared to one member before the rest is compared in full.
STARS = 2
#: Members of a bucket up to which its pairs are simply listed.
SMALL = 16
#: Nodes, and shingles of all of them, of a block in the comparison of larger ones (a lone node may have more).
BLOCK_NODES, BLOCK_SHINGLES = 384, 4_000_000
#: Shingles whose runs of the table are compared at once.
BLOCK = 2048
REMEMBERED = 400_000
MULTIPLIER = np.uint64(0x9E3779B97F4A7C15)


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit numbers (the finaliser of splitmix64)."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


class Shingler:
    """Distinct hashed shingles of `width` words of a text."""

    def __init__(self, width: int):
        import xxhash

        self.width, self.hash, self.known = width, xxhash.xxh3_64_intdigest, {}

    def __call__(self, text: bytes | None) -> np.ndarray:
        words = (text or b"").lower().split()
        if not words:
            return np.empty(0, np.uint64)
        known, n = self.known, self.width
        if len(known) > REMEMBERED:
            known.clear()
        for w in set(words).difference(known):
            known[w] = self.hash(w)
        ids = np.fromiter(map(known.__getitem__, words), np.uint64, len(words))
        if len(ids) < n:
            n = len(ids)
        out = mix(ids[: len(ids) - n + 1] + np.uint64(n))
        for k in range(1, n):
            out = mix(out * MULTIPLIER + ids[k : len(ids) - n + 1 + k])
        out = np.unique(out)
        return out


class Circulant:
    def __init__(self, rows: int = ROWS, bands: int = BANDS, seed: int = 7):
        k = rows * bands
        pi = np.random.default_rng(seed).permutation(PLACES).astype(np.uint32)
        self.runs = np.lib.stride_tricks.sliding_window_view(np.concatenate([pi, pi[:k]]), k)
        self.rows, self.bands = rows, bands
        self.salt = mix(np.arange(1, bands + 1, dtype=np.uint64) * MULTIPLIER)
        self.shift = np.uint64(64 - (PLACES.bit_length() - 1))

    def signature(self, shingles: np.ndarray) -> np.ndarray:
        at = (mix(shingles ^ MULTIPLIER) >> self.shift).astype(np.int64)
        out = self.runs[at[:BLOCK]].min(axis=0)
        for i in range(BLOCK, len(at), BLOCK):
            np.minimum(out, self.runs[at[i : i + BLOCK]].min(axis=0), out=out)
        return out

    def keys(self, shingles: np.ndarray) -> np.ndarray:
        """A 64-bit key for each band; the same numbers in another band give another key."""
        parts = self.signature(shingles).reshape(self.bands, self.rows).astype(np.uint64)
        key = self.salt.copy()
        for k in range(self.rows):
            key = mix(key * MULTIPLIER + parts[:, k])
        return key.view(np.int64)


def sketch(docs: DataFrame, text: str, width: int) -> DataFrame:
    """docs with _row, _n (shingles), _key (128-bit identity of the set) and _bands."""
    added = T.StructType([T.StructField("_n", T.LongType()), T.StructField("_key", T.BinaryType()), T.StructField("_bands", T.ArrayType(T.LongType()))])

    def make(values) -> Iterator[list[tuple]]:
        import hashlib

        shingler, circulant = Shingler(width), Circulant()
        for batch in values:
            out = []
            for t in batch:
                s = shingler(t)
                if len(s):
                    out.append((len(s), hashlib.blake2b(s.tobytes(), digest_size=16).digest(), circulant.keys(s)))
                else:
                    out.append((0, None, None))
            yield out

    return append_columns(docs, F.col("doc")[text].cast("binary"), added, make).withColumn("_row", F.monotonically_increasing_id())


def _sets(of: DataFrame, nodes: DataFrame, sketched: DataFrame, text: str, width: int) -> DataFrame:
    """node and _set, all hashed shingles, of the nodes in `of`."""
    rows = sketched.select("_row", F.col("doc")[text].alias("_text")).join(of.select("node").distinct().join(nodes.select("node", "_row"), "node"), "_row")

    def make(values) -> Iterator[list[tuple]]:
        shingler = Shingler(width)
        for batch in values:
            yield [(shingler(t).view(np.int64),) for t in batch]

    added = T.StructType([T.StructField("_set", T.ArrayType(T.LongType()))])
    return cut(append_columns(rows.select("node", "_text"), F.col("_text").cast("binary"), added, make).select("node", "_set"), "near-sets")


def _confirm(pairs: DataFrame, nodes: DataFrame, sketched: DataFrame, text: str, width: int, percent: int) -> DataFrame:
    """The pairs (a: the hub, which may be in many of them, b) of nodes whose full sets are similar enough.

    The sets of b are joined first, so the second join may have most rows at one hub; adaptive execution splits such a partition
    and sends the hub's set to each part.
    """
    sized = nodes.select("node", "_n")
    fits = (
        pairs.join(sized.toDF("a", "na"), "a").join(sized.toDF("b", "nb"), "b")
        .where(100 * F.least("na", "nb") >= percent * F.greatest("na", "nb"))
    )
    pairs = cut(fits, "near-pairs")
    sets = _sets(pairs.select(F.explode(F.array("a", "b")).alias("node")), nodes, sketched, text, width)
    joined = pairs.join(sets.toDF("b", "sb"), "b").join(sets.toDF("a", "sa"), "a")
    both = F.size(F.array_intersect("sa", "sb"))
    return joined.where(100 * both >= percent * (F.col("na") + F.col("nb") - both)).select("a", "b")


def _mixed(rows: DataFrame) -> DataFrame:
    """The rows of buckets with several components, and how many members (k) each has."""
    open_ = rows.groupBy("band").agg(F.min("root").alias("lo"), F.max("root").alias("hi"), F.count("*").alias("k")).where("lo <> hi").select("band", "k")
    return rows.join(cut(open_, "near-mixed"), "band")


def _small(open_: DataFrame, percent: int) -> DataFrame:
    """Pairs (a, b) across components in buckets of at most SMALL members."""
    x = open_.where(F.col("k") <= SMALL).select("band", "node", "root", "n")
    x, y = x.toDF("band", "a", "ra", "na"), x.toDF("band2", "b", "rb", "nb")
    may = (F.col("band") == F.col("band2")) & (F.col("a") < F.col("b")) & (F.col("ra") != F.col("rb")) & (100 * F.least("na", "nb") >= percent * F.greatest("na", "nb"))
    return x.join(y, may).select("a", "b").distinct()


def shared_counts(left: list[np.ndarray], right: list[np.ndarray], columns: int = 4096) -> np.ndarray:
    """Sizes of the intersections of each left with each right set, by products of incidence matrices."""
    out = np.zeros((len(left), len(right)), np.float32)
    rows_l, rows_r = (np.repeat(np.arange(len(x)), [len(s) for s in x]) for x in (left, right))
    all_l, all_r = (np.concatenate(x) if x else np.empty(0, np.int64) for x in (left, right))
    both = np.intersect1d(all_l, all_r)
    for at in range(0, len(both), columns):
        part = both[at : at + columns]
        a, b = np.zeros((len(left), len(part)), np.float32), np.zeros((len(right), len(part)), np.float32)
        for m, rows, values in ((a, rows_l, all_l), (b, rows_r, all_r)):
            place = np.minimum(np.searchsorted(part, values), len(part) - 1)
            hit = part[place] == values
            m[rows[hit], place[hit]] = 1
        out += a @ b.T
    return out


def _large(open_: DataFrame, nodes: DataFrame, sketched: DataFrame, text: str, width: int, percent: int) -> DataFrame:
    """Links (a, b) across components in buckets of more than SMALL members.

    Buckets that share members form a cluster.  A cluster's nodes are dealt to blocks of about BLOCK_NODES and BLOCK_SHINGLES,
    and each task compares the full sets of two blocks at once; one link for each pair of components comes out.  So no pair
    is listed, no task holds more than two blocks, and no component is left apart that a link joins.
    """
    large = cut(open_.where(F.col("k") > SMALL).select("band", "node", "root", "n"), "near-large")
    if large.isEmpty():
        return large.select(F.col("node").alias("a"), F.col("node").alias("b"))
    hubs = cut(large.groupBy("band").agg(F.min("root").alias("hub")), "near-hubs")
    # Over components, not nodes: a bucket here has at least two of them.
    clusters = components(large.join(hubs, "band").select(F.col("hub").alias("a"), F.col("root").alias("b")))
    members = cut(large.select("node", "root", "n").distinct().join(clusters.toDF("root", "cluster"), "root"), "near-clustered")
    sizes = members.groupBy("cluster").agg(F.greatest(F.ceil(F.count("*") / BLOCK_NODES), F.ceil(F.sum("n") / BLOCK_SHINGLES)).cast("int").alias("blocks"))
    placed = members.join(cut(sizes, "near-sizes"), "cluster").withColumn("block", F.pmod(F.xxhash64("node"), F.col("blocks")).cast("int"))
    sets = _sets(members, nodes, sketched, text, width)
    other = F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)).alias("other")
    dealt = placed.join(sets, "node").select("cluster", "node", "root", "block", "_set", other)
    dealt = dealt.select("cluster", F.least("block", "other").alias("i"), F.greatest("block", "other").alias("j"), "node", "root", "block", "_set")

    def compare(group: pa.Table) -> pa.Table:
        i, j = group.column("i")[0].as_py(), group.column("j")[0].as_py()
        blocks, values = group.column("block").to_numpy(), group.column("_set").combine_chunks()
        offsets, flat = values.offsets.to_numpy(), values.values.to_numpy()
        node, root = group.column("node").to_numpy(), group.column("root").to_numpy()
        at = [np.flatnonzero(blocks == k) for k in (i, j)]
        side = [[flat[offsets[r] : offsets[r + 1]] for r in rows] for rows in at]
        both = shared_counts(*side)
        n = [np.array([len(x) for x in s], np.float64) for s in side]
        linked = (100 * both >= percent * (n[0][:, None] + n[1][None, :] - both)) & (root[at[0]][:, None] != root[at[1]][None, :])
        x, y = np.nonzero(linked)
        roots = np.sort(np.stack([root[at[0]][x], root[at[1]][y]], axis=1), axis=1)
        first = np.unique(roots, axis=0, return_index=True)[1] if len(x) else []
        return pa.table({"a": pa.array(node[at[0]][x[first]], pa.int64()), "b": pa.array(node[at[1]][y[first]], pa.int64())})

    return dealt.groupBy("cluster", "i", "j").applyInArrow(compare, "a long, b long")


def group(docs: DataFrame, text: str = "text", key: str = "doc_id", width: int = 2, percent: int = 80) -> DataFrame:
    """`doc` (the row of docs), n (size of the set), component (least id of the group) and kept: one row of each group.

    Which row of a group is kept: that of the least id, the first written one if the id repeats.
    """
    with scratch() as own:
        sketched = own.keep(cut(sketch(pack(docs), text, width), "near-sketches"))
        heads = own.keep(_heads(sketched, text, key, width, percent))
    own_id = F.col("doc")[key]
    done = sketched.drop("_bands").join(heads, "_key", "left")
    alone = F.col("head").isNull()
    return done.select(
        "doc", F.col("_n").alias("n"), F.when(alone, own_id).otherwise(F.col("head.id")).alias("component"), (alone | (F.col("head.row") == F.col("_row"))).alias("kept"),
    )


def _heads(sketched: DataFrame, text: str, key: str, width: int, percent: int) -> DataFrame:
    """_key and head, the row that stays: of all sets that several rows have or that are linked to others (written)."""
    own_id = F.col("doc")[key]
    classes = sketched.where("_n > 0").groupBy("_key").agg(
        F.min(F.struct(own_id.isNull().alias("no"), own_id.alias("id"), F.col("_row").alias("row"))).alias("first"),
        F.count("*").alias("copies"), F.any_value("_n").alias("_n"), F.any_value("_bands").alias("_bands"),
    )
    classes = classes.select("_key", "first", F.col("first.row").alias("_row"), "copies", "_n", "_bands", F.monotonically_increasing_id().alias("node"))
    nodes = cut(classes, "near-classes")  # written: node numbers must not change

    buckets = nodes.select("node", F.explode("_bands").alias("band"))
    shared = cut(buckets.groupBy("band").agg(F.count("*").alias("n")).where("n > 1"), "near-buckets")
    found = cut(buckets.join(shared, "band").select("band", "node", "n"), "near-members")
    # The text that a group of copies comes from shares more buckets with them than they do among themselves.
    central = cut(found.groupBy("node").agg(F.sum("n").alias("near")), "near-central")
    members = cut(found.join(central, "node").select("band", "node", F.struct("near", (-F.col("node")).alias("no")).alias("rank")), "near-members")
    discard(shared, found, central)

    links, roots = None, None
    for _ in range(STARS):
        rooted = members if roots is None else members.join(roots, "node", "left")
        rooted = rooted.select("band", "node", "rank", (F.col("node") if roots is None else F.coalesce("root", "node")).alias("root"))
        rooted = cut(rooted, "near-rooted")
        # Every bucket that isn't one component yet is compared to its most central member; later, to the most central
        # one outside of the component of the first.
        hubs = cut(rooted.groupBy("band").agg(F.max(F.struct("rank", "root")).alias("top"), F.min("root").alias("lo"), F.max("root").alias("hi")).where("lo <> hi"), "near-hubs")
        open_ = rooted.join(hubs.select("band", "top"), "band")
        if links is not None:
            outside = cut(open_.where("root <> top.root").groupBy("band").agg(F.max(F.struct("rank", "root")).alias("top")), "near-hubs")
            open_ = rooted.join(outside, "band")
        stars = open_.select((-F.col("top.rank.no")).alias("a"), F.col("node").alias("b"), "root", F.col("top.root").alias("ra")).where("a <> b and root <> ra").select("a", "b").distinct()
        with scratch() as own:
            more = own.keep(cut(_confirm(stars, nodes, sketched, text, width, percent), "near-links"))
        discard(rooted, hubs)
        if more.isEmpty():
            links = more if links is None else links
            continue
        links = more if links is None else links.unionByName(more)
        roots = components(links)

    # What is left open is compared in full, across components only.
    rooted = cut((members if roots is None else members.join(roots, "node", "left")).select("band", "node", (F.col("node") if roots is None else F.coalesce("root", "node")).alias("root")), "near-rooted")
    open_ = cut(_mixed(rooted).join(nodes.select("node", F.col("_n").alias("n")), "node").select("band", "node", "root", "n", "k"), "near-open")
    discard(members, rooted)
    few = _confirm(cut(_small(open_, percent), "near-across"), nodes, sketched, text, width, percent)
    more = cut(few.unionByName(_large(open_, nodes, sketched, text, width, percent)), "near-links")
    if not more.isEmpty():
        roots = components(more if links is None else links.unionByName(more))
    if roots is None:
        roots = nodes.select("node", F.col("node").alias("root")).limit(0)

    # Only classes of several rows or with links have another component than their row's own id.
    named = nodes.select("_key", "node", "first", "copies").join(roots, "node", "left")
    alone = named.where("root is null and copies > 1").select("_key", F.col("first").alias("head"))
    linked = cut(named.where("root is not null").select("_key", "first", "root"), "near-linked")
    heads = cut(linked.groupBy("root").agg(F.min("first").alias("head")), "near-heads")
    return cut(linked.join(heads, "root").select("_key", "head").unionByName(alone), "near-heads")


def deduplicate(docs: DataFrame, text: str = "text", key: str = "doc_id", width: int = 5, percent: int = 80) -> DataFrame:
    """One document of each group, with the columns of docs."""
    return unpack(group(docs, text, key, width, percent).where("kept"), docs.columns)
