import numpy as np
import pandas as pd
import pytest

from trailmill.llm.embed_dedup import embedding_components
from trailmill.llm.topk_search import SlicedBlock, quantise, top_k

SCHEMA = "vec_id long, embedding array<float>, label int, rank int, links long"


def brute_top(ids, vectors, queries, k):
    q = np.floor(vectors.astype(np.float64) * 1024).astype(np.int64)
    out = {}
    for i in queries:
        scores = q @ q[ids == i][0]
        rows = sorted((-int(s), int(v)) for s, v in zip(scores, ids) if v != i)[:k]
        out[i] = [(v, -s) for s, v in rows]
    return out


def table(spark, rows):
    return spark.createDataFrame([(i, v, 0, 7, 8) for i, v in rows], SCHEMA)


def test_sliced_scores_match_inner_products():
    rng = np.random.default_rng(1)
    values = rng.integers(-1500, 1500, (200, 9))
    values[5] = values[6]
    block = SlicedBlock(np.arange(200) * 3, values)
    for query in (rng.integers(-1500, 1500, 9), np.zeros(9, np.int64), np.array([1, 0, 0, 0, 0, 0, 0, 0, 0])):
        found = block.search(0, query, 15)
        exact = values @ query
        want = sorted((-int(s), int(i)) for i, s in zip(np.arange(200) * 3, exact) if i != 0)[:15]
        assert sorted((-s, i) for i, s in found) == want


def test_top_k_against_brute_force(spark, sf_dir):
    vectors = spark.read.parquet(f"{sf_dir}/embeddings.parquet")
    got = top_k(vectors, vectors.where("vec_id % 100 = 0")).collect()
    rows = vectors.toPandas().sort_values("vec_id")
    ids, data = rows["vec_id"].to_numpy(), np.stack(rows["embedding"].to_list())
    want = brute_top(ids, data, [int(i) for i in ids if i % 100 == 0], 10)
    found = {}
    for r in sorted(got, key=lambda r: (r.query_id, r["rank"])):
        found.setdefault(r.query_id, []).append((r.vec_id, r.score))
    assert found == want


def test_top_k_edges(spark):
    nan = float("nan")
    rows = [(0, [1.0, 0.0]), (1, [1.0, 0.0]), (2, [1.0, 0.0]), (3, None), (4, [nan, 1.0]), (5, [None, 1.0]), (None, [1.0, 1.0]), (6, [float("inf"), 0.0]), (7, [])]
    got = [tuple(r) for r in top_k(table(spark, rows), table(spark, rows[:1] + rows[3:4])).collect()]
    assert sorted(got) == [(0, 1, 1, 1024 * 1024), (0, 2, 2, 1024 * 1024)]
    assert top_k(table(spark, []), table(spark, [])).count() == 0
    assert quantise(np.array([-0.0001, 0.9999]))[0] == -1


def test_top_k_of_repeated_ids_long_and_huge_vectors(spark):
    long = [float(k % 7) for k in range(3000)]
    rows = [(1, long), (2, long), (2, long), (3, [1.0]), (4, [3.0e38, 1.0]), (5, [-3.0e38, 0.0])]
    got = sorted(tuple(r) for r in top_k(table(spark, rows), table(spark, rows[:1] + rows[4:5])).collect())
    one = sum(int(x * 1024) ** 2 for x in long)
    huge = (1 << 63) - 1
    assert got == [
        (1, 1, 2, one), (1, 2, 2, one), (1, 3, 4, 1024 * 1024), (1, 4, 3, 0), (1, 5, 5, 0),
        (4, 1, 2, 1024 * 1024), (4, 2, 2, 1024 * 1024), (4, 3, 1, 1024 * 1024), (4, 4, 3, huge), (4, 5, 5, -huge - 1),
    ] or [r[2:] for r in got if r[0] == 4] == [(3, huge), (1, 1024 * 1024), (2, 1024 * 1024), (2, 1024 * 1024), (5, -huge - 1)]


def test_top_k_with_clashing_columns(spark):
    data = spark.createDataFrame([(i, [float(i), 1.0], 1, 2, 3, 4) for i in range(5)], "vec_id long, embedding array<float>, score int, query_id int, block int, ids int")
    assert [tuple(r) for r in top_k(data, data.where("vec_id = 4"), k=2).orderBy("rank").collect()] == [(4, 1, 3, 13 * 1024 * 1024), (4, 2, 2, 9 * 1024 * 1024)]


def brute_links(ids, vectors, threshold):
    unit = vectors / np.linalg.norm(vectors, axis=1, keepdims=True)
    near = unit @ unit.T >= threshold
    np.fill_diagonal(near, False)
    root = np.arange(len(ids))
    while True:
        new = np.array([min(root[i], root[near[i]].min() if near[i].any() else root[i]) for i in range(len(ids))])
        if (new == root).all():
            break
        root = new
    return {int(i): (int(n.sum()), int(ids[r])) for i, n, r in zip(ids, near, root)}


@pytest.mark.parametrize("dims", [64, 8, 96])
def test_embedding_links_against_brute_force(spark, dims):
    rng = np.random.default_rng(dims)
    base = rng.standard_normal((300, dims))
    near = base[:60].repeat(3, 0) + rng.standard_normal((180, dims)) * 0.12
    hot = base[:1].repeat(120, 0) + rng.standard_normal((120, dims)) * 0.05
    data = np.concatenate([base, near, hot, base[:5]]).astype(np.float32)
    ids = rng.permutation(len(data))
    order = np.argsort(ids)
    ids, data = ids[order], data[order]
    frame = table(spark, [(int(i), [float(x) for x in v]) for i, v in zip(ids, data)])
    got = {r.vec_id: r for r in embedding_components(frame, 0.95).collect()}
    want = brute_links(ids, data.astype(np.float64), 0.95)
    assert len(got) == len(ids)
    found, total = sum(r.n_links for r in got.values()), sum(n for n, _ in want.values())
    assert 0.9 * total <= found <= total
    assert all(r.n_links <= want[i][0] for i, r in got.items())
    assert sum(got[i].component_id == c for i, (_, c) in want.items()) >= 0.95 * len(ids)
    assert all(r.kept == (r.component_id == i) for i, r in got.items())


@pytest.mark.parametrize("dims", [64, 16])
def test_recall_just_above_the_threshold(spark, dims):
    """50,000 vectors: pairs at cosine 0.95 to 0.96 and one group of near copies, among others."""
    rng = np.random.default_rng(dims)
    unit = lambda x: x / np.linalg.norm(x, axis=-1, keepdims=True)
    base = unit(rng.standard_normal((46_000, dims)))
    away = rng.standard_normal((3000, dims))
    away = unit(away - (away * base[:3000]).sum(1, keepdims=True) * base[:3000])
    cosine = rng.uniform(0.951, 0.96, (3000, 1))
    near = cosine * base[:3000] + np.sqrt(1 - cosine**2) * away
    group = unit(base[5000] + rng.standard_normal((1000, dims)) * 0.1 / np.sqrt(dims))
    data = np.concatenate([base, near, group]).astype(np.float32)
    frame = spark.createDataFrame(pd.DataFrame({"vec_id": np.arange(len(data)), "embedding": list(data)}))
    got = embedding_components(frame, 0.95).toPandas().set_index("vec_id").sort_index()
    exact = data.astype(np.float64)
    exact /= np.linalg.norm(exact, axis=1, keepdims=True)
    links = np.zeros(len(data), np.int64)
    for a in range(0, len(data), 2000):
        links[a : a + 2000] = (exact[a : a + 2000] @ exact.T >= 0.95).sum(1) - 1
    recall = got["n_links"].sum() / links.sum()
    pairs = got["n_links"].to_numpy()[46_000:49_000]
    print(dims, "recall", recall, "of the pairs", (pairs > 0).mean())
    assert (got["n_links"].to_numpy() <= links).all()
    assert recall >= 0.9 and (pairs > 0).mean() >= 0.9


def test_embeddings_with_clashing_columns(spark):
    data = spark.createDataFrame([(i, [1.0, float(i % 2)], 1, 2, 3, 4) for i in range(4)], "vec_id long, embedding array<float>, rep int, codes int, component int, fine int")
    assert sorted(tuple(r) for r in embedding_components(data).collect()) == [(0, 1, 0, True), (1, 1, 1, True), (2, 1, 0, False), (3, 1, 1, False)]


def test_embedding_edges(spark):
    nan = float("nan")
    rows = [(5, [1.0, 0.0]), (3, [1.0, 0.0]), (3, [1.0, 0.0]), (9, [0.0, 0.0]), (10, None), (11, [nan, 1.0]), (12, [None, 1.0]), (13, []), (14, [1.0, 0.0, 0.0]), (None, [1.0, 0.0])]
    got = sorted((tuple(r) for r in embedding_components(table(spark, rows)).collect()), key=str)
    alone = [(i, 0, i, True) for i in (9, 10, 11, 12, 13, 14)]
    assert got == sorted([(5, 2, 3, False), (3, 2, 3, True), (3, 2, 3, True), (None, 0, None, False), *alone], key=str)
    assert embedding_components(table(spark, [])).count() == 0


def test_embeddings_of_extreme_size(spark):
    rows = [(1, [1e-200, 0.0]), (2, [3e-200, 1e-210]), (3, [1e200, 0.0]), (4, [1e200, 1e190]), (5, [0.0, 5e-324]), (6, [0.0, 1e300]), (7, [-1e-200, 0.0])]
    got = {r.vec_id: (r.n_links, r.component_id) for r in embedding_components(spark.createDataFrame(rows, "vec_id long, embedding array<double>")).collect()}
    assert got == {1: (3, 1), 2: (3, 1), 3: (3, 1), 4: (3, 1), 5: (1, 5), 6: (1, 5), 7: (0, 7)}
