"""Top lists, hash tree shards and decontamination."""

import math
import random
import zlib

import numpy as np
import pytest
import xxhash
from helpers import awkward, documents, sentence
from pyspark.sql import functions as F

from tideglass.llm import decontaminate, sharding, toplists


def nearest(rows, k=5, scale=256):
    good = [(i, [math.floor(scale * float(np.float32(x))) for x in v]) for i, v in rows if i is not None and v and all(x is not None and math.isfinite(x) for x in v)]
    out = []
    for i, q in good:
        if i % 10 == 0:
            found = sorted((-sum(a * b for a, b in zip(q, v, strict=True)), j) for j, v in good if j != i and len(v) == len(q))[:k]
            out += [(i, n + 1, j, -s) for n, (s, j) in enumerate(found)]
    return sorted(out)


@pytest.mark.parametrize(("n", "block"), [(400, 64), (30, 8192), (4, 8192)])
def test_top_lists_match_brute_force(spark, n, block):
    rng = np.random.default_rng(n)
    rows = [(i, [float(x) for x in rng.normal(size=12)]) for i in range(n)]
    rows += [(1000 + i, rows[0][1]) for i in range(n // 4)]  # ties
    rows += [(2000, None), (2010, []), (2020, [1.0, None]), (2030, [float("nan")] * 12), (2040, [float("inf")] * 12), (None, rows[1][1]), (2050, [1.0, 2.0]), (2060, [1.0, -2.0]), (2070, [0.0] * 12)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>").withColumn("score", F.lit("x")).withColumn("rank", F.lit(1))
    got = toplists.top_k(df, F.col("vec_id") % 10 == 0, block=block)
    assert got.columns == ["query_id", "rank", "vec_id", "score"]
    assert sorted(map(tuple, got.collect())) == nearest(rows)


def test_bounds_end_the_reading_where_they_can():
    rng = np.random.default_rng(3)
    cand = rng.integers(-50, 50, (3000, 4))
    cand[:12] += 400
    query = rng.integers(1, 50, (7, 4))
    for q, a in zip(query, toplists.search_block(cand, np.arange(3000), query, np.arange(-7, 0), 5), strict=True):
        assert a.scores.tolist() == np.sort(cand @ q)[::-1][:5].tolist()
        assert a.by_bound and a.read <= a.entries / 10


def test_lists_are_read_to_their_ends_where_bounds_cannot_end_it():
    same = np.tile(np.array([[3, -2, 0, 5]]), (400, 1))
    [a] = toplists.search_block(same, np.arange(400), np.array([[1, -1, 7, 2]]), np.array([-1]), 5)
    assert not a.by_bound and a.read == a.entries == 4 * 400
    assert a.places.tolist() == [0, 1, 2, 3, 4] and a.scores.tolist() == [15] * 5
    [zero] = toplists.search_block(same, np.arange(400), np.zeros((1, 4), int), np.array([2]), 3)
    assert zero.places.tolist() == [0, 1, 3] and zero.scores.tolist() == [0, 0, 0] and zero.read == 0


def test_endings_of_the_vectors(spark, sf):
    """Bounds end the reading of every query; nothing is scored that was not read but the few candidates left."""
    vectors = spark.read.parquet(f"{sf}/embeddings.parquet")
    told = {r["by_bound"]: (r["n"], r["share_read"]) for r in toplists.endings(vectors, F.col("vec_id") % 50 == 0).collect()}
    assert told[True][0] == vectors.filter("vec_id % 50 = 0").count() and False not in told and told[True][1] <= 1


def draws(doc_id, topology):
    """The tree's descent with Spark's hash written out."""

    def h(level, node):
        seed = _int(node, xxhash.xxh64_intdigest(level.encode(), 42))
        return _long(doc_id, seed) if doc_id is not None else seed

    def pick(level, first, weights):
        return min((-math.log(((h(level, first + j) >> 11) + 0.5) * 2.0**-53) / w, first + j) for j, w in enumerate(weights))[1]

    region = pick("region", 0, [sum(map(sum, r)) for r in topology.regions])
    rack0 = sum(len(r) for r in topology.regions[:region])
    rack = pick("rack", rack0, [sum(r) for r in topology.regions[region]])
    racks = [r for region_ in topology.regions for r in region_]
    return pick("shard", sum(map(len, racks[:rack])), list(racks[rack]))


M = 2**64 - 1


def _rot(x, r):
    return (x << r | x >> (64 - r)) & M


def _mix(h):
    h = (h ^ h >> 33) * 0xC2B2AE3D27D4EB4F & M
    h = (h ^ h >> 29) * 0x165667B19E3779F9 & M
    return h ^ h >> 32


def _int(value, seed):
    h = (seed + 0x27D4EB2F165667C5 + 4) & M
    h ^= (value & 0xFFFFFFFF) * 0x9E3779B185EBCA87 & M
    return _mix((_rot(h, 23) * 0xC2B2AE3D27D4EB4F + 0x165667B19E3779F9) & M)


def _long(value, seed):
    return xxhash.xxh64_intdigest(int(value).to_bytes(8, "little", signed=True), seed)


def test_shards_match_the_written_out_tree(spark):
    topology = sharding.Topology(((((1.0, 2.0), (3.0,))), (((1.0, 1.0, 4.0),))))
    rows = [(i, f"t{i}") for i in range(300)] + [(None, None), (7, "again"), (8, "")]
    got = sharding.place(documents(spark, rows), topology).collect()
    assert len(got) == len(rows)
    for r in got:
        assert r.shard == draws(r.doc_id, topology)
        assert r.grown_shard in (r.shard, topology.shards) and r.grown_shard == draws(r.doc_id, topology.grow())
    texts = {i: t for i, t in rows[:300] if i not in (7, 8)}
    assert all((r.size, r.text_crc32) == (len(texts[r.doc_id]) + 16, zlib.crc32(texts[r.doc_id].encode())) for r in got if r.doc_id in texts)
    for s in range(topology.shards):
        assert sorted(r.slot for r in got if r.shard == s) == list(range(sum(r.shard == s for r in got)))


def test_weights_decide_shares_and_growth_moves_only_inwards(spark):
    ids = spark.range(40_000).withColumnRenamed("id", "doc_id")
    topology = sharding.Topology.even(40)
    assert topology.shards == 40 and topology.grow().shards == 41
    rows = sharding.assign(sharding.assign(ids, "doc_id", topology, "a"), "doc_id", topology.grow(), "b")
    assert rows.filter("a <> b and b <> 40").count() == 0
    share = [r["count"] / 40_000 * 40 for r in rows.groupBy("a").count().collect()]
    assert len(share) == 40 and 0.85 < min(share) and max(share) < 1.15
    assert abs(rows.filter("b = 40").count() / 40_000 * 41 - 1) < 0.15
    heavy = sharding.Topology(((((1.0,),)), (((3.0,),))))
    assert abs(sharding.assign(ids, "doc_id", heavy, "s").filter("s = 1").count() / 40_000 - 0.75) < 0.02
    with pytest.raises(ValueError):
        sharding.Topology((((0.0,),),))
    assert sharding.place(documents(spark, []), topology).count() == 0


def least_distance(p, t):
    prev = [0] * (len(t) + 1)
    for i in range(1, len(p) + 1):
        cur = [i]
        for j in range(1, len(t) + 1):
            cur.append(min(prev[j] + 1, cur[-1] + 1, prev[j - 1] + (p[i - 1] != t[j - 1])))
        prev = cur
    return min(prev), prev.index(min(prev))


def test_myers_matches_the_table():
    rng = random.Random(1)
    for _ in range(2000):
        p, t = [rng.randint(0, 3) for _ in range(rng.randint(1, 12))], [rng.randint(0, 3) for _ in range(rng.randint(0, 15))]
        expected = least_distance(p, t)
        assert decontaminate.myers(p, t) == expected if expected[0] < len(p) else decontaminate.myers(p, t)[0] == len(p)


def test_edited_passages_are_found_as_by_brute_force(spark):
    rng = random.Random(8)
    items = [(i, sentence(rng, rng.randint(15, 45))) for i in range(12)] + [(50, None), (51, ""), (52, "Short item"), (53, "short, item!")]
    docs = awkward(rng)
    for i in range(60):
        words = items[i % 12][1].split()
        for _ in range(rng.randint(0, 9)):
            at = rng.randrange(len(words))
            words[at : at + rng.randint(0, 1)] = [sentence(rng, 1)] * rng.randint(0, 2)
        docs.append((100 + i, f"{sentence(rng, rng.randint(0, 30))} {' '.join(words).title()}. {sentence(rng, rng.randint(0, 30))}" + (" short item here" if i % 7 == 0 else "")))
    bench = spark.createDataFrame([(i, t, "x") for i, t in items], "item_id long, text string, doc_id string")
    got = {(r.doc_id, r.item_id): r for r in decontaminate.matches(documents(spark, docs), bench).filter("doc_id >= 100").collect()}

    def words(t):
        return [w.strip("!?.,").lower() for w in t.split()]

    expected = {}
    for d, t in docs[-60:]:
        for i, item in items:
            if item:
                p = words(item)
                distance, end = least_distance(p, words(t))
                if distance <= int(decontaminate.RATE * len(p)):
                    expected[d, i] = (distance, end)
    assert {k: (r.distance, r.end_word) for k, r in got.items()} == expected
    for (d, i), r in got.items():
        text = words(dict(docs[-60:])[d])
        assert least_distance(words(dict(items)[i]), text[r.start_word : r.end_word])[0] == r.distance
    small = {(r.doc_id, r.item_id) for r in decontaminate.matches(documents(spark, docs), bench, limit=300).filter("doc_id >= 100").collect()}
    assert small == set(expected)
    kept = decontaminate.clean(documents(spark, docs), bench)
    assert kept.columns == documents(spark, docs).columns
    assert {r.doc_id for r in kept.collect() if r.doc_id and r.doc_id >= 100} == {d for d, _ in docs[-60:]} - {d for d, _ in expected}


def test_items_with_one_id_or_none_are_taken_in_parts_of_the_limit(spark):
    rng = random.Random(5)
    rows = [(i, sentence(rng, 12)) for i in [None] * 30 + [7] * 30] + [(8, sentence(rng, 200)), (8, None)]
    items = spark.createDataFrame(rows, "item_id long, text string")
    parts = list(decontaminate._passes(items, 500))
    assert sorted((r for p in parts for r in p), key=repr) == sorted(rows, key=repr)
    assert len(parts) > 5 and all(len(p) == 1 or sum(len(t or "") for _, t in p) <= 500 for p in parts)
    docs = documents(spark, [(100 + n, f"before {t} after") for n, (_, t) in enumerate(rows[:-1])])
    found = sorted(((r.doc_id, r.item_id) for r in decontaminate.matches(docs, items, limit=500).collect()), key=repr)
    assert found == sorted(((100 + n, i) for n, (i, _) in enumerate(rows[:-1])), key=repr)


def test_assigning_keeps_columns_of_any_name(spark):
    rows = spark.createDataFrame([(i, f"r{i}", i * 2, "x") for i in range(20)], "doc_id long, _region string, _rack long, _Region_ string")
    got = sharding.assign(rows, "doc_id", sharding.Topology.even(10), "shard")
    assert got.columns == [*rows.columns, "shard"]
    assert sorted(map(tuple, got.drop("shard").collect())) == sorted(map(tuple, rows.collect()))
    with pytest.raises(ValueError, match="_RACK"):
        sharding.assign(rows, "doc_id", sharding.Topology.even(10), "_RACK")


def test_no_items_and_no_documents(spark):
    bench = spark.createDataFrame([], "item_id long, text string")
    assert decontaminate.matches(documents(spark, [(1, "a")]), bench).count() == 0
    assert decontaminate.clean(documents(spark, [(1, "a")]), bench).count() == 1
    assert decontaminate.matches(documents(spark, []), spark.createDataFrame([(1, "a b")], "item_id long, text string")).count() == 0
