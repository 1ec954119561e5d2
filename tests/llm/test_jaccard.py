import re
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest

from trailmill.llm.components import connected_components
from trailmill.llm.jaccard import choose_matches, jaccard_components, left_out, prefix_lengths
from trailmill.llm.textkeys import shingles, words

DOCS = "doc_id long, text string, family string, n long, shingle long"


def brute_sets(texts, width):
    out = []
    for t in texts:
        t = re.sub("[A-Z]", lambda m: m[0].lower(), t or "")
        w = re.findall(r"[^\x20\x09-\x0D]+", t)
        out.append({tuple(w[i : i + width]) for i in range(len(w) - width + 1)} if len(w) >= width else ({tuple(w)} if w else set()))
    return out


def brute_components(ids, sets, percent):
    root = {i: i for i in ids}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    postings = {}
    for i, s in zip(ids, sets):
        for g in s:
            postings.setdefault(g, []).append(i)
    by_id = dict(zip(ids, sets))
    counts = {}
    for p in postings.values():
        for a in range(len(p)):
            for b in range(a):
                counts[p[b], p[a]] = counts.get((p[b], p[a]), 0) + 1
    for (a, b), both in counts.items():
        if 100 * both >= percent * (len(by_id[a]) + len(by_id[b]) - both):
            x, y = find(a), find(b)
            root[max(x, y)] = min(x, y)
    return {i: find(i) for i in ids}


def frame(spark, rows):
    return spark.createDataFrame([(i, t, "f", 1, 2) for i, t in rows], DOCS)


def test_word_and_shingle_keys_follow_the_definition():
    texts = ["A b\tc\r\n d e", "", None, "one", "x y z", "a b c d e a b c d e", "É é A\x0bb\xa0c d", "  lead and trail  "]
    keys, at = words(pa.array(texts))
    names = [re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), t or "")) for t in texts]
    assert np.diff(at).tolist() == [len(w) for w in names]
    flat = [w for ws in names for w in ws]
    assert all((keys[i] == keys[j]) == (flat[i] == flat[j]) for i in range(len(flat)) for j in range(i))
    sets, at = shingles(pa.array(texts).slice(1), 4)
    assert np.diff(at).tolist() == [len(s) for s in brute_sets(texts[1:], 4)]


@pytest.mark.parametrize("width,percent", [(4, 85), (5, 80)])
def test_components_against_brute_force(spark, width, percent):
    rng = np.random.default_rng(width)
    vocab = [f"w{k}" for k in range(400)]
    base = [[vocab[k] for k in rng.integers(0, 400, n)] for n in rng.integers(1, 160, 60)]
    passage = [vocab[k] for k in rng.integers(0, 400, 60)]
    texts = []
    for k, ws in enumerate(base):
        copies = 150 if k == 0 else int(rng.integers(1, 6))
        ws = [vocab[j] for j in rng.integers(0, 400, 140)] if k == 0 else ws + passage * (k % 4 == 0)
        for _ in range(copies):
            new = list(ws)
            for _ in range(int(rng.integers(0, 4))):
                new[int(rng.integers(0, len(new)))] = f"x{rng.integers(0, 10**6)}"
            texts.append(" ".join(new))
        texts += [" ".join(ws).upper()] * (40 if k == 1 else 1)
    texts += ["", None, "  ", "a b", "A  b"]
    ids = [int(i) for i in rng.permutation(len(texts)) * 3 + 1]
    got = {r.doc_id: r for r in jaccard_components(frame(spark, list(zip(ids, texts))), width, percent).collect()}
    sets = brute_sets(texts, width)
    want = brute_components(ids, sets, percent)
    assert {i: r.n_shingles for i, r in got.items()} == {i: len(s) for i, s in zip(ids, sets)}
    assert {i: r.component_id for i, r in got.items()} == want


def test_edges(spark):
    rows = [(1, "p q r s t u"), (1, "p q r s t u"), (2, "P q r s t u"), (None, "p q r s t u"), (3, None), (4, ""), (5, "word " * 60_000)]
    got = sorted((tuple(r) for r in jaccard_components(frame(spark, rows), 4, 85).collect()), key=str)
    assert got == sorted([(1, 3, 1), (1, 3, 1), (2, 3, 1), (None, 3, None), (3, 0, 3), (4, 0, 4), (5, 1, 5)], key=str)
    assert jaccard_components(frame(spark, []), 4, 85).count() == 0


def test_rows_that_repeat_an_id_are_judged_by_their_own_text(spark):
    rng = np.random.default_rng(7)
    a, b, c = ([f"w{k}" for k in rng.integers(0, 10**6, 60)] for _ in range(3))
    near = lambda ws, k: " ".join([*ws[:-1], f"x{k}"])
    rows = [(5, " ".join(a)), (1, " ".join(a)), (5, " ".join(b)), (9, near(b, 1)), (7, " ".join(c)), (7, near(a, 2)), (8, near(c, 3))]
    got = Counter((r.doc_id, r.component_id) for r in jaccard_components(frame(spark, rows), 4, 85).collect())
    assert got == Counter([(5, 1), (1, 1), (5, 5), (9, 5), (7, 7), (7, 1), (8, 7)])


def test_prefixes_grow_with_the_matches_asked_for():
    n = np.array([0, 1, 20, 100])
    assert prefix_lengths(n, 85).tolist() == [0, 1, 4, 16]
    at = np.array([0, 10, 20])
    counts = np.concatenate([np.zeros(10), np.full(10, 1000.0)])
    few, many = choose_matches(counts, at, 85)
    assert few == 2 and many > 2


def test_what_the_index_leaves_out_loses_no_pair():
    """Random similar pairs under a random order, with any m from p on: one indexed shingle is always shared."""
    rng = np.random.default_rng(3)
    for percent in (80, 85):
        for _ in range(400):
            n = int(rng.integers(1, 80))
            a = rng.choice(1000, n, replace=False)
            gone = int(rng.integers(0, n // 4 + 2))
            b = np.union1d(a[gone:], rng.choice(np.arange(1000, 2000), int(rng.integers(0, n // 5 + 2)), replace=False))
            both = len(np.intersect1d(a, b))
            if 100 * both < percent * (len(a) + len(b) - both):
                continue
            order, df = rng.permutation(2000), rng.integers(1, 4, 2000) * 2000 + np.arange(2000)
            kept, need, prefixes = [], [], []
            for x in (a, b):
                size = np.array([len(x)])
                p = int(prefix_lengths(size, percent)[0])
                m = max(p, 1) + int(rng.integers(0, 9))
                m = m if p + m - 1 <= len(x) else max(p, 1)
                prefix = x[np.argsort(order[x])][: p + m - 1]
                kept.append(prefix[np.argsort(df[prefix])][: len(prefix) - int(left_out(size, percent)[0])])
                need.append(m)
                prefixes.append(prefix)
            assert len(np.intersect1d(*prefixes)) >= min(need)
            assert len(np.intersect1d(*kept)) >= 1


@pytest.mark.parametrize("percent", [20, 35, 50])
def test_low_thresholds_lose_no_link(spark, percent):
    """Below one half a prefix would be longer than its set, so the matches asked for are fewer."""
    rng = np.random.default_rng(percent)
    texts = []
    for g in range(40):
        n = int(rng.integers(5, 60))
        for _ in range(3):
            gone = int(n * rng.random() * 0.8)
            texts.append(" ".join([f"g{g}w{k}" for k in range(gone, n)] + [f"x{k}" for k in rng.integers(0, 10**6, gone)]))
    got = {r.doc_id: r.component_id for r in jaccard_components(frame(spark, list(enumerate(texts))), 1, percent).collect()}
    assert got == brute_components(list(range(len(texts))), brute_sets(texts, 1), percent)


def test_components_of_chains_stars_and_loops(spark):
    edges = [(i, i + 1) for i in range(40)] + [(100, k) for k in range(101, 160)] + [(200, 200), (300, 301), (301, 300)]
    got = {r.id: r.component for r in connected_components(spark.createDataFrame(edges, "src long, dst long")).collect()}
    assert {got[i] for i in range(41)} == {0} and {got[i] for i in range(100, 160)} == {100} and got[301] == 300 and 200 not in got
    assert connected_components(spark.createDataFrame([], "src long, dst long")).count() == 0


def test_a_chain_of_weak_links_is_one_component_and_its_unlike_ends_are_not_compared(spark):
    """Each text is the last one moved on by three words of sixty: neighbours link, others don't."""
    texts = [" ".join(f"w{j}" for j in range(3 * k, 3 * k + 60)) for k in range(1200)]
    others = [" ".join(f"o{k}x{j}" if j % 5 else f"w{j}" for j in range(60)) for k in range(300)]
    rows = list(enumerate(texts)) + [(5000 + k, t) for k, t in enumerate(others)]
    got = {r.doc_id: r.component_id for r in jaccard_components(frame(spark, rows), 4, 85).collect()}
    assert {got[k] for k in range(1200)} == {0}
    assert all(got[5000 + k] == 5000 + k for k in range(300))


def test_a_task_holds_one_python_worker(spark, monkeypatch):
    """No table is cut from rows of a Python list, and texts are filtered and cut into sets in different tasks."""
    from trailmill.llm import components, jaccard

    plans, cut = [], jaccard.cut

    def kept(df, name="cut"):
        plans.append((name, df._jdf.queryExecution().executedPlan().toString()))
        return cut(df, name)

    monkeypatch.setattr(jaccard, "cut", kept)
    monkeypatch.setattr(components, "cut", kept)
    rows = [(k, " ".join([*(f"w{k % 4}_{j}" for j in range(60)), f"x{k}"])) for k in range(24)]
    got = {r.doc_id: r.component_id for r in jaccard_components(frame(spark, rows), 5, 80).collect()}
    assert got == {k: k % 4 for k in range(24)}
    assert {"sets", "edges"} <= {name for name, _ in plans}
    listed = "ExistingRDD"  # a test's own rows are a Python list
    assert not [name for name, plan in plans if name in ("edges", "active", "offers", "members", "tiles", "verified") and listed in plan]
    sets = [plan for name, plan in plans if name == "sets"]
    assert all(plan.count("MapInArrow") == 2 and "SortMergeJoin" in plan and "BroadcastHashJoin" not in plan for plan in sets)
