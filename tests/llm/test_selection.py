"""Mixing, sharding and quality."""

import itertools
from collections import Counter, defaultdict

import numpy as np
import pytest

from foldwise.llm import mixing, quality, queries, sharding

DATA = "/root/testdata/sf0.01"


def filled(sizes, weights=(5, 2, 1), most=3):
    """Targets by resharing round after round."""
    names = sorted((s for s in sizes if s is not None), key=lambda s: s.encode()) + [None] * (None in sizes)
    weight = {s: weights[i % 3] for i, s in enumerate(names)}
    total, capped = sum(sizes.values()), {}
    while True:
        free = [s for s in names if s not in capped]
        left = total - sum(capped.values())
        share = {s: left * weight[s] / sum(weight[x] for x in free) for s in free}
        over = [s for s in free if share[s] >= most * sizes[s]]
        if not over:
            return capped | share
        capped |= {s: most * sizes[s] for s in over}


@pytest.mark.parametrize("sizes", [{"a": 100, "b": 50, "c": 1000}, {"a": 1, "b": 500, None: 3}, {"a": 0, "b": 0}, {"x": 7}, {f"s{i}": 3**i for i in range(9)}])
def test_targets(spark, sizes):
    rows = mixing.targets(spark.createDataFrame(list(sizes.items()), "source string, source_size long")).collect()
    wanted = filled(sizes)
    assert {r["source"]: round(r["target"], 6) for r in rows} == {s: round(t, 6) for s, t in wanted.items()}


def test_mix_meets_its_targets(spark):
    rows = queries.op1_pareto_mixing(spark, DATA).collect()
    sizes, taken, target = defaultdict(int), defaultdict(int), {}
    source = {r["doc_id"]: r["source"] for r in spark.read.parquet(f"{DATA}/documents.parquet").select("doc_id", "source").collect()}
    for r in rows:
        s = source[r["doc_id"]]
        sizes[s] += r["size"]
        taken[s] += r["taken"]
        target[s] = r["target"]
        assert 0 <= r["taken"] <= 3 * r["size"]
    wanted = filled(dict(sizes))
    for s in sizes:
        assert abs(target[s] - wanted[s]) < 1e-6 * max(1, wanted[s])
        assert abs(taken[s] - target[s]) <= max(0.02 * target[s], 60)
    assert sorted(rows) == sorted(queries.op1_pareto_mixing(spark, DATA).collect())


def test_inclusion_is_unequal_and_as_planned(spark):
    rows = [(i, " w" * (5 if i % 2 else 400), "a") for i in range(3000)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string").unionByName(spark.createDataFrame([(9999, "w " * 900_000, "b")], "doc_id long, text string, source string"))
    kept = Counter((r["size"], r["copies"] > 0) for r in mixing.mix(docs).where("source = 'a'").collect())
    short, long = (kept[n, True] / 1500 for n in (5, 400))
    assert long > short > 0 or min(short, long) == 1


def test_mix_of_odd_rows(spark, odd, none):
    rows = mixing.mix(odd).collect()
    assert len(rows) == odd.count()
    assert all(r["size"] == 0 and r["taken"] == 0 for r in rows if not (r["text"] or "").strip(" \t\n"))
    assert mixing.mixed_rows(odd).columns == odd.columns
    assert mixing.mix(none).count() == 0 and mixing.mixed_rows(none).count() == 0


def test_communication_matrix():
    begins = np.array([0, 10, 10, 47, 90, 101])
    cells = sharding.cell_sizes(101, 8, 3)
    rows = [sharding.matrix_row(begins, cells, p, 5) for p in range(5)]
    assert [int(r.sum()) for r in rows] == np.diff(begins).tolist()
    assert (sum(rows) == cells).all()
    rng = np.random.default_rng(1)
    big = [sharding._hypergeometric(rng, 600_000_000, 1_400_000_000, 1000) for _ in range(400)]
    assert abs(np.mean(big) - 300) < 4 and abs(np.std(big) - np.sqrt(210)) < 3


def test_shards_are_exact_and_gapless(spark):
    rows = queries.op5_hypergeometric_sharding(spark, DATA).collect()
    slots = defaultdict(list)
    for r in rows:
        slots[r["shard"]].append(r["slot"])
    assert sorted(map(len, slots.values())) == [125] * 8
    assert all(sorted(s) == list(range(len(s))) for s in slots.values())
    assert sorted(rows, key=str) == sorted(queries.op5_hypergeometric_sharding(spark, DATA).collect(), key=str)
    # neighbours in the table are spread: about one pair in eight shares a shard
    by_id = {r["doc_id"]: r["shard"] for r in rows}
    same = np.mean([by_id[i] == by_id[i + 1] for i in range(999)])
    assert 0.08 < same < 0.17


def test_shards_of_odd_rows(odd, none):
    rows = sharding.shard(odd).collect()
    sizes = Counter(r["shard"] for r in rows)
    assert sum(sizes.values()) == odd.count() and max(sizes.values()) - min(sizes.values()) <= 1
    assert sharding.shard(none).count() == 0


def test_chains_against_enumeration():
    rng = np.random.default_rng(4)
    first, energy, moves = np.array([0, 1, 4, 9]), rng.normal(0, 2, 9), np.array([[0.0, -0.7], [0.3, 1.1]])
    bad, distance, pairs = quality.chains(energy, first, moves)
    for row, (b, e) in enumerate(itertools.pairwise(first)):
        paths = list(itertools.product((0, 1), repeat=e - b))
        weight = np.exp([sum(energy[b + i] * s for i, s in enumerate(p)) + sum(moves[x, y] for x, y in itertools.pairwise(p)) for p in paths])
        z = weight.sum()
        assert np.isclose(distance[row], np.log(z))
        for i in range(e - b):
            assert np.isclose(bad[b + i], sum(w for w, p in zip(weight, paths, strict=True) if p[i]) / z)
        assert np.isclose(pairs[row, 1, 0], sum(w * sum(x == (1, 0) for x in itertools.pairwise(p)) for w, p in zip(weight, paths, strict=True)) / z)


def test_held_out_accuracy(spark):
    data = "/root/testdata/sf0.1"
    found = queries.op3_crf_quality(spark, data).where("held_out")
    rows = found.join(spark.read.parquet(f"{data}/labels.parquet"), "doc_id").collect()
    assert np.mean([r["predicted"] == r["quality"] for r in rows]) > 0.98
    assert np.mean([r["predicted"] for r in rows if r["quality"] == 1]) > 0.99


def test_quality_of_odd_rows(spark, odd, none):
    labels = spark.read.parquet(f"{DATA}/labels.parquet")
    rows = quality.classify(odd, labels).collect()
    assert len(rows) == odd.count() and all(0 <= r["score"] <= 1 for r in rows)
    by_text = defaultdict(set)
    for r in rows:
        by_text[r["text"] or ""].add(r["score"])
    assert all(len(s) == 1 for s in by_text.values())
    assert quality.classify(none, labels).count() == 0
    assert quality.accepted(odd, labels).columns == odd.columns
    assert {r["score"] for r in quality.classify(odd, labels.where("false")).collect()} == {0.5}
