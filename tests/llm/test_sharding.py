import zlib
from collections import defaultdict

import pytest
from pyspark.sql import functions as F

from ledgerline.llm import sharding
from ledgerline.llm.queries import QUERIES


def test_query(spark, sf_dir):
    docs = {r.doc_id: r.text for r in spark.read.parquet(f"{sf_dir}/documents.parquet").collect()}
    rows = QUERIES["op10_virtual_slots"](spark, sf_dir).collect()
    assert sorted(r.doc_id for r in rows) == sorted(docs)
    places, loads, shard_of = defaultdict(list), defaultdict(int), {}
    for r in rows:
        raw = (docs[r.doc_id] or "").encode()
        assert (r["size"], r.text_crc32, r.law, r.grown_shard) == (len(raw) + 8, zlib.crc32(raw), "bytes", None)
        places[r.shard].append(r.slot)
        loads[r.shard] += r["size"]
        assert shard_of.setdefault(r.virtual_slot, r.shard) == r.shard
    assert all(sorted(v) == list(range(len(v))) for v in places.values()) and set(places) <= set(range(24))
    largest = max(r["size"] for r in rows)
    assert max(loads.values()) - min(loads.get(i, 0) for i in range(24)) <= 2 * largest


def test_odd_rows(spark):
    rows = [(1, None, 3), (1, None, 3), (None, "", 4), (2, "x" * 200_000, 5), (3, "é", 6)]
    df = spark.createDataFrame(rows, "doc_id long, text string, shard int")
    got, placed = sharding.shard_documents(df, 3)
    got = got.collect()
    assert sorted(r["size"] for r in got) == [8, 8, 8, 10, 200_008]
    assert placed.count() == sharding.SLOTS and {r.version for r in placed.collect()} == {1}
    empty, spread = sharding.shard_documents(df.limit(0), 3)
    assert empty.count() == 0 and {r.n for r in spread.groupBy("shard").agg(F.count("*").alias("n")).collect()} <= {1365, 1366}


def test_rebalancing_moves_into_new_shards_only(spark, sf_dir, tmp_path):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").unionByName(spark.createDataFrame([(10_000 + i, "y" * 4000, "en", "s", 4000) for i in range(3000)], "doc_id long, text string, lang string, source string, n_chars long"))
    digests = sharding.digest(docs)
    stats = sharding.slot_bytes(digests)
    first = sharding.build_map(stats, 6)
    path = str(tmp_path / "maps")
    sharding.store_map(first, path)
    second = sharding.rebalance(sharding.load_map(spark, path), stats, 8)
    sharding.store_map(second, path)
    a = {r.virtual_slot: r.shard for r in sharding.load_map(spark, path, 1).collect()}
    b = {r.virtual_slot: r.shard for r in sharding.load_map(spark, path).collect()}
    assert set(a) == set(b) and all(b[s] == a[s] or b[s] in (6, 7) for s in a)
    loads = defaultdict(int)
    for r in stats.collect():
        loads[b[r.virtual_slot]] += r.bytes
    assert len(loads) == 8 and max(loads.values()) < 1.1 * sum(loads.values()) / 8
    fewer = {r.virtual_slot: r.shard for r in sharding.rebalance(sharding.load_map(spark, path), stats, 5).collect()}
    assert len(fewer) == sharding.SLOTS and set(fewer.values()) == set(range(5)) and all(fewer[s] == b[s] for s in b if b[s] < 5)


def test_storing_a_map_again_changes_nothing(spark, tmp_path):
    docs = spark.createDataFrame([(i, f"text {i}") for i in range(50)], "doc_id long, text string")
    path, digests = str(tmp_path / "maps"), sharding.digest(docs)
    stats = sharding.slot_bytes(digests)
    first = sharding.build_map(stats, 3)
    for _ in range(2):
        sharding.store_map(first, path)
    assert sharding.assign(digests, sharding.load_map(spark, path), stats).count() == 50
    with pytest.raises(ValueError):
        sharding.store_map(first.withColumn("shard", F.lit(0)), path)


def test_an_earlier_map_places_later_records(spark, tmp_path):
    early = spark.createDataFrame([(i, f"text {i}") for i in range(50)], "doc_id long, text string")
    late = spark.createDataFrame([(i, f"text {i}", 7, "v", "t") for i in range(1000)], "doc_id long, text string, shard int, virtual_slot string, _text string")
    _, placed = sharding.shard_documents(early, 4)
    digests = sharding.digest(late)
    got = sharding.assign(digests, placed, sharding.slot_bytes(digests))
    assert got.count() == 1000
    places = defaultdict(list)
    for r in got.collect():
        places[r.shard].append(r.slot)
    assert all(sorted(v) == list(range(len(v))) for v in places.values())
    sharding.write_shards(late, placed, str(tmp_path / "out"))
    back = spark.read.parquet(str(tmp_path / "out"))
    assert back.count() == 1000 and set(back.columns) == {*late.columns, "_shard"} and {(r.shard, r.virtual_slot, r["_text"]) for r in back.collect()} == {(7, "v", "t")}
    with pytest.raises(Exception, match="a slot is missing"):
        sharding.assign(digests, placed.where("virtual_slot > 100"), sharding.slot_bytes(digests)).collect()


def test_files(spark, sf_dir, tmp_path):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    _, placed = sharding.shard_documents(docs)
    sharding.write_shards(docs, placed, str(tmp_path / "out"))
    back = spark.read.parquet(str(tmp_path / "out"))
    assert back.select("doc_id").exceptAll(docs.select("doc_id")).count() == 0 and back.count() == docs.count()
