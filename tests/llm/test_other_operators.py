"""Shards, neighbours, the registered queries on the driver's small tables, and the pipeline."""

from __future__ import annotations

import collections
import os
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from crosspanel.llm import neighbours, sharding
from crosspanel.llm.queries import ORACLES, QUERIES
from tests.oracle import connect, same

SF = "/root/testdata/sf0.001"
tables = pytest.mark.skipif(not os.path.isdir(SF), reason="needs the driver's tables")


def test_shards_are_even_and_keep_groups(spark):
    texts = [f"t{i}" for i in range(500)] + ["hot"] * 300 + [f"g{i // 4}" for i in range(120)] + [None, "", None]
    docs = spark.createDataFrame([(i, t, 1) for i, t in enumerate(texts)], "doc_id bigint, text string, shard int")
    got = sharding.balanced_shards(docs).collect()
    counts = collections.Counter(r.shard for r in got)
    assert len(got) == len(texts) and set(counts) == set(range(16)) and max(counts.values()) - min(counts.values()) <= 1
    slots = collections.defaultdict(list)
    for r in got:
        text = (texts[r.doc_id] or "").encode()
        assert (r.size, r.text_crc32, r.law, r.grown_shard) == (len(text) + 1, zlib.crc32(text), "rows", None)
        slots[r.shard].append(r.slot)
    assert all(sorted(s) == list(range(len(s))) for s in slots.values())
    groups = collections.defaultdict(set)
    for r in got:
        groups[texts[r.doc_id] or ""].add(r.shard)
    assert np.mean([len(s) for t, s in groups.items() if t.startswith("g")]) < 2.5  # drawn at random they would hold 3.6 shards


def test_small_groups_stay_whole_beside_a_hot_one(spark):
    texts = ["hot"] * 2000 + [f"pair{i // 2}" for i in range(2000)] + [f"t{i}" for i in range(2000)]
    got = sharding.balanced_shards(spark.createDataFrame(list(enumerate(texts)), "doc_id bigint, text string")).collect()
    counts = collections.Counter(r.shard for r in got)
    assert len(got) == len(texts) and len(counts) == 16 and max(counts.values()) - min(counts.values()) <= 1
    pairs = collections.defaultdict(set)
    for r in got:
        if texts[r.doc_id].startswith("pair"):
            pairs[texts[r.doc_id]].add(r.shard)
    assert sum(len(s) > 1 for s in pairs.values()) <= 10  # there is room for all of them


def test_shards_do_not_depend_on_files(spark):
    rows = [(i, f"pair{i // 2}" if i < 600 else "hot" if i < 900 else f"t{i}") for i in range(1500)] + [(3, "twice")] * 2
    docs = spark.createDataFrame(rows, "doc_id bigint, text string")
    one, other = (sorted(map(tuple, sharding.balanced_shards(d).collect())) for d in (docs.repartition(7), docs.orderBy(F.desc("doc_id")).coalesce(2)))
    assert one == other


@pytest.mark.parametrize("n", [0, 1, 5])
def test_shards_of_few_rows(spark, n):
    docs = spark.createDataFrame([(7, "same")] * n, "doc_id bigint, text string")
    got = sharding.balanced_shards(docs).collect()
    assert len(got) == n and len({r.shard for r in got}) == n and all(r.slot == 0 for r in got)


def exact(rows, k):
    good = [(i, np.array(v, dtype=np.float32)) for i, v in rows if i is not None and v is not None and len(v) == 8 and None not in v and np.isfinite(np.array(v, dtype=float)).all() and np.any(np.array(v) != 0)]
    out = {}
    for i, q in good:
        if i % 20 == 0:
            scored = sorted((-float(q.astype(float) @ v.astype(float)), j) for j, v in good if j != i)
            out[i] = [j for _, j in scored[:k]]
    return out


@pytest.mark.parametrize(("candidates", "queries", "chunk"), [(32_768, 1024, 4096), (100, 3, 16)])
def test_neighbours_against_brute_force(spark, monkeypatch, candidates, queries, chunk):
    monkeypatch.setattr(neighbours, "CANDIDATE_BLOCK", candidates)
    monkeypatch.setattr(neighbours, "QUERY_BLOCK", queries)
    monkeypatch.setattr(neighbours, "CHUNK", chunk)
    draw = np.random.default_rng(2)
    rows = [(i, [float(np.float32(x)) for x in draw.normal(size=8)]) for i in range(300)]
    rows += [(400 + i, rows[4][1]) for i in range(60)]  # one very common vector
    rows += [(500, None), (520, [0.0] * 8), (540, [1.0] * 7 + [float("nan")]), (560, [1.0] * 7 + [float("inf")]), (580, [1.0] * 7 + [None]), (600, [1.0, 2.0]), (None, [1.0] * 8)]
    df = spark.createDataFrame([(i, v, 3) for i, v in rows], "vec_id bigint, embedding array<float>, rank int")
    got = collections.defaultdict(list)
    vectors = dict(rows)
    for r in sorted(neighbours.nearest(df, df.where("vec_id % 20 = 0")).collect(), key=lambda r: (r.query_id, r.rank)):
        got[r.query_id].append(r.vec_id)
        assert r.rank == len(got[r.query_id]) and r.score == pytest.approx(float(np.dot(np.float64(vectors[r.query_id]), np.float64(vectors[r.vec_id]))))
    want = exact(rows, 20)
    assert set(got) == set(want)
    assert sum(len(set(got[q]) & set(want[q])) for q in want) >= 0.97 * sum(len(w) for w in want.values())


def test_neighbours_of_few_vectors(spark):
    df = spark.createDataFrame([(0, [1.0, 0.0]), (1, [0.5, 0.5]), (2, [1.0, 0.0])], "vec_id bigint, embedding array<float>")
    assert [(r.rank, r.vec_id, r.score) for r in neighbours.nearest(df, df.where("vec_id = 0")).orderBy("rank").collect()] == [(1, 2, 1.0), (2, 1, 0.5)]
    assert neighbours.nearest(df.limit(0), df.limit(0)).count() == 0 and neighbours.nearest(df, df.limit(0)).count() == 0


def test_neighbours_of_doubles(spark):
    third = [1 / 3, 1 / 5, 0.1]
    draw = np.random.default_rng(5)
    rows = [(0, third), (1, [1e300, 0.0, 1.0]), (2, [1e-300, 0.0, 0.0]), (3, [0.1, 0.7, 1 / 7]), (20, [1e300, 1e300, -1e300])]
    rows += [(100 + i, v.tolist()) for i, v in enumerate(draw.normal(size=(200, 3)))]
    df = spark.createDataFrame(rows, "vec_id bigint, embedding array<double>")
    got = collections.defaultdict(list)
    for r in neighbours.nearest(df, df.where("vec_id % 20 = 0"), k=7).orderBy("query_id", "rank").collect():
        got[r.query_id].append((r.vec_id, r.score))
    with np.errstate(over="ignore", invalid="ignore"):
        for q, v in rows:
            if q % 20 == 0:
                scored = sorted((-float(np.dot(v, w)), j) for j, w in rows if j != q)[:7]
                assert [j for j, _ in got[q]] == [j for _, j in scored]
                assert [s for _, s in got[q]] == pytest.approx([-s for s, _ in scored], rel=1e-14)


@tables
def test_recall_on_the_embeddings(spark):
    got = collections.defaultdict(set)
    for r in QUERIES["op10_neighbours"](spark, SF).collect():
        got[r.query_id].add(r.vec_id)
    t = spark.read.parquet(f"{SF}/embeddings.parquet").toPandas()
    v, ids = np.array(t.embedding.tolist(), dtype=np.float64), t.vec_id.to_numpy()
    hits = []
    for i in np.flatnonzero(ids % 20 == 0):
        s = v @ v[i]
        s[i] = -np.inf
        hits.append(len(got[ids[i]] & set(ids[np.lexsort((ids, -s))[:20]])) / 20)
    assert np.mean(hits) >= 0.99


@tables
@pytest.mark.parametrize("name", sorted(ORACLES))
def test_query_against_sql(spark, name):
    same(QUERIES[name](spark, SF).toPandas(), connect(SF), ORACLES[name])


@tables
def test_pipeline(spark):
    import corpus_pipeline as cp
    from crosspanel.llm.common import written

    assert len(cp.STAGES) == 5
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    counts = [docs.count()]
    for name, stage in cp.STAGES[:-1]:
        out = written(stage(spark, docs, SF), name)
        assert out.columns == docs.columns
        docs = out
        counts.append(docs.count())
    assert counts[1] == counts[0] > counts[2] >= counts[3] == counts[4]
    packed = cp.run(spark, SF)
    assert {r.doc_id for r in packed.select("doc_id").distinct().collect()} == {r.doc_id for r in docs.select("doc_id").collect()}


NAMES = "maybe bit_at bit_block bit_map kept key at block bytes changed_id new_text tk goes n kept_0 lang_pred score n_pseudonyms old new start length nth group row spans".split() + ["own n_pseudonyms", "a.b"]


@pytest.mark.parametrize("stage", ["language", "near_duplicates", "substrings", "pii"])
def test_stages_with_odd_rows_and_clashing_names(spark, stage):
    import corpus_pipeline as cp

    run = dict(cp.STAGES)[stage]
    base = " ".join(f"word{i}" for i in range(70))
    rows = [(1, base), (2, base), (2, base), (3, "z " + base), (4, None), (5, ""), (6, " \t"), (None, base), (7, "long " * 30_000), (8, "mail a.b1@c.example"), (8, "123 !?")]
    docs = spark.createDataFrame([(i, t, "en", "s", len(t or "")) for i, t in rows], "doc_id bigint, text string, lang string, source string, n_chars bigint")
    docs = docs.select("*", *[F.lit(f"own {c}").alias(c) for c in NAMES])
    got = run(spark, docs, "")
    assert got.dtypes == docs.dtypes
    found = got.collect()
    assert found and all(r[c] == f"own {c}" for r in found for c in NAMES)
    empty = run(spark, docs.limit(0), "")
    assert empty.dtypes == docs.dtypes and empty.count() == 0
    # rows with nothing to find stay, but texts without letters go in the language stage
    assert (4 in {r.doc_id for r in found}) == (stage != "language") and 7 in {r.doc_id for r in found}


def test_pipeline_of_an_empty_table(spark, tmp_path):
    import corpus_pipeline as cp

    spark.read.parquet(f"{SF}/documents.parquet").limit(0).write.parquet(f"{tmp_path}/documents.parquet")
    assert cp.run(spark, str(tmp_path)).count() == 0


def test_packing_stage_with_odd_rows(spark):
    import corpus_pipeline as cp

    docs = spark.createDataFrame([(1, None), (2, ""), (3, "a b"), (3, "a b"), (None, "c")], "doc_id bigint, text string").select("*", *[F.lit("own").alias(c) for c in NAMES])
    got = dict(cp.STAGES)["packing"](spark, docs, "").collect()
    assert sorted(r.doc_id or 0 for r in got) == [0, 1, 2, 3, 3] and all(r.token_ids[-1] == 1 and len(r.token_ids) == r.length for r in got)
    assert dict(cp.STAGES)["packing"](spark, docs.limit(0), "").count() == 0
