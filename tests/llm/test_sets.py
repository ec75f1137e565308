import math
import os
from collections import Counter

import duckdb
import numpy as np
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from lamina.llm.mixing import mix_sources
from lamina.llm.queries import ORACLE_SQL, QUERIES
from lamina.llm.topk import BallTree, Best, top_k

from .conftest import SF
from .test_near_duplicates import brute
from .test_tokens import check_packing


def plain(rows):
    return sorted((tuple(r) for r in rows), key=repr)


def test_sql_of_queries(spark):
    con = duckdb.connect()
    for t in os.listdir(SF):
        con.sql(f"create view {t.removesuffix('.parquet')} as select * from '{SF}/{t}'")
    for name, sql in ORACLE_SQL.items():
        df = QUERIES[name](spark, SF)
        cols = sorted(df.columns)
        assert plain(df.select(cols).collect()) == plain(con.sql(f"select {', '.join(cols)} from ({sql})").fetchall()), name


def test_mix_meets_its_weights(spark, odd, empty):
    docs = spark.range(6000).selectExpr("id as doc_id", "case when id % 10 < 8 then 'big' when id % 10 = 8 then 'small' else null end as source", "'t' as text", "1 as copy")
    out = mix_sources(docs, {"big": 1, "small": 3}, total=8000).collect()
    share = Counter(r["source"] for r in out)
    assert set(share) == {"big", "small"} and abs(share["small"] / len(out) - 0.75) < 0.03 and abs(len(out) - 8000) < 300
    keys = [r["shuffle_key"] for r in out]
    assert keys == sorted(keys) and len({(r["doc_id"], r["copy"]) for r in out}) == len(out)
    large = spark.range(200).selectExpr("id as doc_id", "'s' as source")
    n = mix_sources(large, {"s": 1}, total=200 * 300).count()  # means above a part's bound
    assert abs(n - 60000) < 6 * math.sqrt(60000)
    assert set(mix_sources(odd).columns) == {*odd.columns, "shuffle_key"}
    assert set(map(tuple, mix_sources(odd).drop("shuffle_key", "copy").collect())) <= set(map(tuple, odd.drop("copy").collect()))
    assert mix_sources(empty).collect() == []


def test_rows_that_share_an_id_draw_for_themselves(spark):
    docs = spark.range(4000).selectExpr("if(id < 2000, null, 7L) as doc_id", "'s' as source", "if(id % 4 = 0, 'same', concat('t', id)) as text")
    out = mix_sources(docs, {"s": 1}, total=8000).collect()
    again = mix_sources(docs.orderBy(F.desc("text")), {"s": 1}, total=8000).collect()
    assert abs(len(out) - 8000) < 6 * math.sqrt(8000) and sorted(map(repr, out)) == sorted(map(repr, again))
    times = Counter((r["doc_id"], r["text"]) for r in out if r["text"] != "same")
    assert len(set(times.values())) > 4  # a Poisson draw of mean 2 for each row, not one for all
    assert len({r["shuffle_key"] for r in out}) == len(out)


def brute_top_k(rows, k=20, every=20):
    """Every query row against every other row of its length, in Python's integers."""
    whole = [(i, [math.floor(64 * x) for x in v]) for i, v in rows if i is not None and v is not None and all(x is not None and math.isfinite(x) for x in v)]
    out = []
    for a, (q, v) in enumerate(whole):
        if q % every == 0:
            found = sorted((-sum(x * y for x, y in zip(v, w, strict=True)), i) for b, (i, w) in enumerate(whole) if b != a and len(w) == len(v))[:k]
            out += [(q, r + 1, i, -s) for r, (s, i) in enumerate(found)]
    return sorted(out)


def test_top_k_with_ties_gaps_and_bad_vectors(spark):
    rng = np.random.default_rng(4)
    rows = [(i, [float(x) for x in rng.integers(-2, 3, 5) / 64]) for i in range(900)]
    rows += [(900, None), (901, [1.0, None, 1.0, 1.0, 1.0]), (920, [float("nan")] * 5), (None, [1.0] * 5), (940, [float("inf")] * 5), (960, [0.5, 0.5])]
    rows += rows[40:42] * 3 + [(60, [9.0, 9.0, 9.0, 9.0, 9.0])]  # repeated rows, of a query too, and an id with two vectors
    df = spark.createDataFrame(rows, "vec_id bigint, embedding array<double>")
    assert sorted(tuple(r) for r in top_k(df, shard_rows=100, block_rows=16).collect()) == brute_top_k(rows)
    assert top_k(df.limit(0)).collect() == []


def test_top_k_of_large_components(spark):
    rng = np.random.default_rng(6)
    rows = [(i, [float(x) for x in rng.normal(size=4) * 3e6]) for i in range(300)]  # beyond what doubles add up exactly
    df = spark.createDataFrame(rows, "vec_id bigint, embedding array<double>")
    assert sorted(tuple(r) for r in top_k(df, shard_rows=100).collect()) == brute_top_k(rows)
    with pytest.raises(Exception, match="64-bit"):
        top_k(spark.createDataFrame([(0, [1e300, 1.0]), (1, [1e300, 1.0])], df.schema)).collect()


def test_ball_tree_cuts_and_stays_exact():
    rng = np.random.default_rng(5)
    centres = rng.normal(size=(20, 8)) * 50
    vectors = np.floor(centres[rng.integers(0, 20, 5000)] + rng.normal(size=(5000, 8)))
    best = Best(np.arange(10) * -1 - 1, np.arange(10), vectors[:10], 5)
    seen = 0
    offer = best.offer

    def counted(who, rows, ids, part):
        nonlocal seen
        seen += len(who) * len(ids)
        offer(who, rows, ids, part)

    best.offer = counted
    best.search(BallTree(np.arange(5000), np.arange(5000), vectors))
    s = vectors[:10] @ vectors.T
    assert (best.scores == -np.sort(-s, axis=1)[:, :5]).all()
    assert seen < 10 * 5000 / 2


def test_pipeline_stage_by_stage(spark):
    """Each stage against plain Python on its own input; the whole of run()."""
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    for name, stage in corpus_pipeline.STAGES:
        out = stage(spark, docs, SF).cache()
        before, after = docs.collect(), out.collect()
        if name == "quality":
            truth = {r["doc_id"]: r["quality"] for r in spark.read.parquet(f"{SF}/labels.parquet").collect()}
            kept = {r["doc_id"] for r in after}
            assert set(map(tuple, after)) <= set(map(tuple, before))
            assert np.mean([(i in kept) == bool(q) for i, q in truth.items()]) > 0.9
        elif name == "near_dedup":
            want = {i for i, (_, c) in brute([(r["doc_id"], r["text"]) for r in before], 5).items() if i == c}
            assert sorted(r["doc_id"] for r in after) == sorted(want)
        elif name == "secrets":
            assert sorted(r["doc_id"] for r in after) == sorted(r["doc_id"] for r in before)
            assert all(r["n_chars"] == len(r["text"]) for r in after if "[secret]" in r["text"])
        elif name == "mixing":
            assert set(map(tuple, after)) <= set(map(tuple, before))
        else:
            check_packing(after, [(r["doc_id"], r["text"]) for r in before], 2048)
        if name != "packing":
            assert out.columns == docs.columns
        docs = out


def test_pipeline_of_odd_and_empty_rows(spark, odd, empty):
    docs = empty
    for _, stage in corpus_pipeline.STAGES:
        docs = stage(spark, docs, SF)
        assert docs.collect() == []
    docs = odd
    for name, stage in corpus_pipeline.STAGES:
        out = stage(spark, docs, SF).cache()
        before, after = (Counter(tuple(r[c] for c in corpus_pipeline.COLUMNS) for r in d.collect()) if name != "packing" else d for d in (docs, out))
        if name == "quality":
            assert all(after[r] in (0, n) for r, n in before.items()) and not after - before  # copies go or stay together
        elif name == "near_dedup":
            classes = brute([(r[0], r[1]) for r in before.elements()], 5)
            want = Counter({r: n if r[0] is None else 1 for r, n in before.items() if r[0] is None or classes[r[0]][1] == r[0]})
            assert after == want
        elif name == "secrets":
            assert after == before  # none of these texts holds one
        elif name == "mixing":
            assert set(after) <= set(before) and sum(after.values()) < 4 * sum(before.values())
        else:
            check_packing(after.collect(), [(r["doc_id"], r["text"]) for r in before.collect()], 2048)
        docs = out
