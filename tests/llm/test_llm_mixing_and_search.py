"""Mixing, the vector index, and the pipeline on small tables."""

import math
import random
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from slink.llm import mixing, permutation_index

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, block string, k string, tokens string"


def mixed_documents(spark, rows):
    return spark.createDataFrame([(i, t, "en", s, 0, "b", "k", "t") for i, t, s in rows], SCHEMA)


def corpus():
    rnd = random.Random(1)
    sizes = {"big": 400, "mid": 60, "small": 25, None: 10}
    rows, i = [], 0
    for source, n in sizes.items():
        for _ in range(n):
            rows.append((i, " ".join(["w"] * rnd.randint(1, 40)) + f" {i}", source))
            i += 1
    return rows


def weights(totals, a):
    powers = {s: (t / sum(totals.values())) ** a for s, t in totals.items()}
    return {s: p / sum(powers.values()) for s, p in powers.items()}


@pytest.mark.parametrize(("entropy", "repeats"), [(0.9, 50.0), (0.999, 2.0), (1.0, 1000.0), (0.1, 50.0)])
def test_exponent_is_the_bisected_one(spark, entropy, repeats):
    totals = {"a": 9000, "b": 700, "c": 250, "d": 50}
    frame = spark.createDataFrame(list(totals.items()), "k string, tokens long")
    got = mixing.bisect_exponent(frame, 10_000.0, entropy, repeats)

    def holds(a):
        w = weights(totals, a)
        h = -sum(p * math.log(p) for p in w.values())
        return h <= entropy * math.log(4) + 1e-12 and max(w[s] * 10_000 / t for s, t in totals.items()) <= repeats + 1e-12

    low, high = 0.0, 1.0
    if holds(0.0):
        high = 0.0
    while high - low > 1e-9:
        middle = (low + high) / 2
        low, high = (low, middle) if holds(middle) else (middle, high)
    assert got == pytest.approx(high, abs=1e-6)


def test_draws_meet_the_weights_and_repeat_evenly(spark):
    rows = corpus()
    docs = mixed_documents(spark, rows)
    out = mixing.draws(docs, target_entropy=0.9, most_repeats=6.0, block_tokens=900).collect()
    tokens = {i: len(t.split()) for i, t, _ in rows}
    totals = {}
    for i, _, s in rows:
        totals[s] = totals.get(s, 0) + tokens[i]
    budget = sum(totals.values())
    frame = spark.createDataFrame([(str(s), t) for s, t in totals.items()], "k string, tokens long")
    a = mixing.bisect_exponent(frame, float(budget), 0.9, 6.0)
    want = weights(totals, a)
    drawn = {s: sum(r["n_tokens"] for r in out if r["source"] == s) for s in totals}
    for s in totals:
        assert want[s] * budget - 1e-3 * totals[s] <= drawn[s] <= want[s] * budget + 41
        turns = [sum(r["doc_id"] == i for r in out) for i, _, own in rows if own == s]
        assert max(turns) - min(turns) <= 1
    blocks = {}
    for r in out:
        blocks.setdefault(r["block"], []).append(r)
    assert sorted(blocks) == list(range(math.ceil(budget / 900)))
    for own in blocks.values():
        assert sorted(r["position"] for r in own) == list(range(len(own)))
        assert abs(sum(r["n_tokens"] for r in own) - 900) < 200
    again = mixing.draws(docs.repartition(7), target_entropy=0.9, most_repeats=6.0, block_tokens=900).collect()
    assert sorted(map(str, again)) == sorted(map(str, out))


def test_mixed_rows_keep_their_columns(spark):
    rows = corpus() + [(None, "no id", "small"), (7, None, "small"), (8, "", "none"), (0, corpus()[0][1], "big")]
    docs = mixed_documents(spark, rows)
    drawn = mixing.draws(docs).groupBy("doc_id", "_h").count().collect()
    out = mixing.mixed(docs)
    assert out.columns == docs.columns
    copies = {(r["doc_id"], r["_h"]): r["count"] for r in drawn}
    counted = out.groupBy("doc_id", F.xxhash64("text").alias("h")).count().collect()
    given = {(r["doc_id"], r["h"]): r["count"] for r in docs.groupBy("doc_id", F.xxhash64("text").alias("h")).count().collect()}
    for r in counted:
        assert r["count"] == copies[r["doc_id"], r["h"]] * given[r["doc_id"], r["h"]]
    assert "none" not in {r["source"] for r in out.collect()}
    assert mixing.mixed(docs.limit(0)).count() == 0


def nearest(rows, k):
    """Brute force over (vec_id, vector): first row of an id counts."""
    known = {}
    for i, v in rows:
        if i is not None and v and all(x is not None and math.isfinite(x) for x in v) and any(v):
            known.setdefault(i, np.array(v, np.float32).astype(np.float64))
    out = {}
    for q in known:
        if q % 20 == 0:
            scores = [(-sum(a * b for a, b in zip(known[q], v, strict=True)), i) for i, v in known.items() if i != q]
            out[q] = [(i, -s) for s, i in sorted(scores)[:k]]
    return out


def vector_table(spark, rows):
    frame = spark.createDataFrame(rows, "vec_id long, embedding array<float>")
    return frame.select("*", *[F.lit("x").alias(c) for c in ("g", "side", "s", "score", "rank")])


def test_search_over_few_vectors_is_complete(spark):
    rnd = np.random.default_rng(3)
    rows = [(i, rnd.standard_normal(8).astype(np.float32).tolist()) for i in range(60)]
    rows += [(60, None), (80, [0.0] * 8), (100, [float("nan")] + [1.0] * 7), (120, [None] + [1.0] * 7), (None, [1.0] * 8)]
    rows += [(140, rows[3][1]), (141, rows[3][1]), (142, rows[3][1]), (143, [1.0, 2.0]), (5, rows[5][1])]
    want = nearest([r for r in rows if r[0] != 143], 20)
    got = {}
    for r in permutation_index.search(vector_table(spark, rows), F.col("vec_id") % 20 == 0).orderBy("query_id", "rank").collect():
        got.setdefault(r["query_id"], []).append((r["vec_id"], r["score"]))
    assert {q: [i for i, _ in v] for q, v in got.items()} == {q: [i for i, _ in v] for q, v in want.items()}
    assert all(a == b for q in want for (_, a), (_, b) in zip(got[q], want[q], strict=True))
    few = permutation_index.search(vector_table(spark, rows[:5]), F.col("vec_id") % 20 == 0).collect()
    assert [r["rank"] for r in sorted(few, key=lambda r: r["rank"])] == [1, 2, 3, 4]
    assert permutation_index.search(vector_table(spark, []), F.col("vec_id") % 20 == 0).count() == 0


def test_search_recall_with_near_copies(spark):
    rnd = np.random.default_rng(4)
    centre = rnd.standard_normal(32)
    plain = rnd.standard_normal((4000, 32)) * rnd.uniform(0.5, 2, (4000, 1))
    near = centre + 0.02 * rnd.standard_normal((2000, 32))
    same = np.repeat(centre[None, :], 1000, axis=0)
    stacked = np.concatenate([plain, near, same]).astype(np.float32)
    ids = rnd.permutation(len(stacked))
    rows = [(int(i), v.tolist()) for i, v in zip(ids, stacked, strict=True)]
    got = {}
    for r in permutation_index.search(vector_table(spark, rows), F.col("vec_id") % 20 == 0).collect():
        got.setdefault(r["query_id"], []).append(r["vec_id"])
    vectors = stacked[np.argsort(ids)].astype(np.float64)
    hits = total = 0
    for q, found in got.items():
        scores = vectors @ vectors[q]
        scores[q] = -np.inf
        worst = np.sort(scores)[-20] - 1e-9
        hits += sum(scores[i] >= worst for i in found)
        total += 20
    assert len(got) == len(stacked) / 20 and hits / total >= 0.9


def test_blocks_and_repeats_do_not_change_the_answer(spark, monkeypatch):
    rnd = np.random.default_rng(5)
    rows = [(i, rnd.standard_normal(8).astype(np.float32).tolist()) for i in range(300)]
    table = vector_table(spark, rows + rows[:50])
    is_query = F.col("vec_id") % 20 == 0
    want = sorted(map(tuple, permutation_index.search(table, is_query).collect()))
    monkeypatch.setattr(permutation_index, "QUERY_BLOCK", 4)
    monkeypatch.setattr(permutation_index, "SHARDS", 2)
    monkeypatch.setattr(permutation_index, "BLOCK", 64)
    assert sorted(map(tuple, permutation_index.search(table, is_query).collect())) == want


def test_pipeline_stages_on_the_small_tables(spark):
    corpus_pipeline = pytest.importorskip("corpus_pipeline")
    sf_dir = "/root/testdata/sf0.001"
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    labels = {r["doc_id"]: r["quality"] for r in spark.read.parquet(f"{sf_dir}/labels.parquet").collect()}
    assert [name for name, _ in corpus_pipeline.STAGES] == ["quality", "near_duplicates", "personal_data", "mix", "encode"]
    good = corpus_pipeline.quality(spark, docs, sf_dir).cache()
    assert good.columns == docs.columns
    kept = {r["doc_id"] for r in good.collect()}
    assert all((i in kept) == (q == 1) for i, q in labels.items() if zlib.crc32(str(i).encode()) % 4 != 2)
    single = corpus_pipeline.near_duplicates(spark, good, sf_dir).cache()
    assert single.count() == single.select("doc_id").distinct().count() <= len(kept)
    clean = corpus_pipeline.personal_data(spark, single, sf_dir).cache()
    assert clean.columns == docs.columns and clean.count() == single.count()
    assert not clean.filter(F.col("text").rlike(r"@[a-z0-9-]+\.")).count()
    assert not clean.filter(F.length("text") != F.col("n_chars")).count()
    drawn = corpus_pipeline.mix(spark, clean, sf_dir)
    assert drawn.columns == docs.columns
    out = corpus_pipeline.encode(spark, drawn, sf_dir)
    assert out.count() == drawn.count()
    assert not out.filter(F.size("token_ids") != F.col("n_tokens")).count()
