import hashlib
import re
import zlib
from collections import Counter, defaultdict

from loomspark.llm import exact_dedup, sharding

from .odd import odd, texts


def test_slots_are_gapless_and_growth_moves_into_the_new_shard_alone(spark):
    df = spark.range(3000).selectExpr("id AS doc_id", "cast(id % 7 AS string) AS x").repartition(5)
    out = sharding.number_slots(sharding.assign_shards(df, "doc_id", [1.0] * 4, grown_weight=1.0), "shard", "doc_id", buckets=16).collect()
    slots = defaultdict(list)
    for r in out:
        slots[r["shard"]].append(r.slot)
        assert r.grown_shard in (r["shard"], 4)
    assert all(sorted(s) == list(range(len(s))) for s in slots.values()) and len(out) == 3000
    assert 0.15 < sum(r.grown_shard == 4 for r in out) / 3000 < 0.25


def test_weights(spark):
    out = Counter(r["shard"] for r in sharding.assign_shards(spark.range(6000).withColumnRenamed("id", "k"), "k", [1.0, 2.0, 3.0]).collect())
    assert abs(out[0] / 6000 - 1 / 6) < 0.03 and abs(out[2] / 6000 - 1 / 2) < 0.03


def test_sharding_of_odd_rows(spark, monkeypatch):
    df = odd(spark)
    monkeypatch.setattr(sharding, "table", lambda *a: df)
    got = Counter((r.doc_id, r["size"], r.text_crc32) for r in sharding.op1_sharding(spark, "").collect())
    assert got == Counter((i, len((t or "").encode()) + 1, zlib.crc32((t or "").encode())) for i, t in texts(df))
    monkeypatch.setattr(sharding, "table", lambda *a: df.limit(0))
    assert sharding.op1_sharding(spark, "").count() == 0


def dedup_by_hand(rows):
    norm = [(i, re.sub(r"[\x20\x09-\x0D]+", " ", t or "")) for i, t in rows]
    groups = defaultdict(list)
    for i, t in norm:
        groups[t].append(i)
    least = lambda ids: min((i for i in ids if i is not None), default=None)
    return Counter((i, least(groups[t]), len(groups[t]), i == least(groups[t]), hashlib.sha256(t.encode()).hexdigest()) for i, t in norm)


def test_block_naming_equals_grouping_by_text(spark):
    df = odd(spark, [(20 + k, "abc" * k) for k in range(12)] + [(40 + k, "abc" * k + "d") for k in range(12)])
    want = dedup_by_hand(texts(df))
    for how in ({}, {"block_bytes": 4096, "hash_bits": 3}):
        assert Counter(tuple(r) for r in exact_dedup.exact_dedup(df, **how).collect()) == want
    assert exact_dedup.exact_dedup(df.limit(0)).count() == 0


def test_stage_keeps_columns_and_one_of_each(spark):
    df = odd(spark).where("doc_id IS NOT NULL").dropDuplicates(["doc_id"])
    out = exact_dedup.keep_first_copies(spark, df, "")
    assert out.columns == df.columns and sorted(r.doc_id for r in out.collect()) == [1, 3, 5, 6, 8, 9, 10, 11, 12]
