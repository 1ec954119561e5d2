import math
import re
import zlib
from collections import Counter

import numpy as np
from pyspark.sql import functions as F

from trailmill.llm.katz import good_turing, score_documents

DOCS = "doc_id long, text string, fold int, score double, history long"


def brute(rows, train):
    """The same model from plain dictionaries."""
    tokens = {i: re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), t or "")) + ["</s>"] for i, t in rows}
    uni, bi = Counter(), Counter()
    for i in train:
        uni.update(tokens[i])
        bi.update(zip(["<s>", *tokens[i]], tokens[i]))
    n, v = sum(uni.values()), len(uni)
    du, db = good_turing(Counter(uni.values())), good_turing(Counter(bi.values()))
    keep = lambda d, c: float(d(np.array([c]))[0]) * c
    p1 = {w: keep(du, c) / n for w, c in uni.items()}
    unseen = 1 - sum(p1.values())
    hist = Counter()
    for (h, _), c in bi.items():
        hist[h] += c
    mass, lower = Counter(), Counter()
    for (h, w), c in bi.items():
        mass[h] += keep(db, c) / hist[h]
        lower[h] += p1[w]

    def p(h, w):
        if (h, w) in bi:
            return keep(db, bi[h, w]) / hist[h]
        alpha = (1 - mass[h]) / (1 - lower[h]) if h in hist else 1.0
        return alpha * p1.get(w, unseen)

    out = {}
    for i, ts in tokens.items():
        base = sum(math.log10((uni[t] + 0.1) / (n + 0.1 * (v + 1))) for t in ts)
        out[i] = (len(ts), sum(uni[t] > 0 for t in ts), n, base, sum(math.log10(p(h, w)) for h, w in zip(["<s>", *ts], ts)))
    return out, p, uni


def test_scores_against_brute_force(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    rows = [(r.doc_id, r.text) for r in docs.collect()]
    train = [i for i, _ in rows if zlib.crc32(str(i).encode()) % 10]
    want, p, uni = brute(rows, train)
    got = score_documents(docs, F.crc32(F.col("doc_id").cast("string")) % 10 != 0).collect()
    assert len(got) == len(rows)
    for r in got:
        a = want[r.doc_id]
        assert (r.n_tokens, r.n_known, r.train_tokens) == a[:3]
        assert math.isclose(r.base_score, a[3], rel_tol=1e-9) and math.isclose(r.score, a[4], rel_tol=1e-9)
    # Every history's probabilities sum to one over the known words and the unseen event.
    for h in ["<s>", "the", rows[0][1].split()[0].lower(), "never seen"]:
        assert math.isclose(sum(p(h, w) for w in uni) + p(h, "\0"), 1, rel_tol=1e-9)


def test_edges(spark):
    rows = [(1, "a b a b", 1, 5.0, 6), (1, "a b a b", 1, 5.0, 6), (2, None, 1, 5.0, 6), (3, "", None, 5.0, 6), (None, "A c", 0, 5.0, 6), (4, "x " * 50_000, 0, 5.0, 6)]
    out = score_documents(spark.createDataFrame(rows, DOCS), F.col("fold") == 1)
    assert out.columns == ["doc_id", "fold", "history", "n_tokens", "n_known", "train_tokens", "base_score", "score"]
    got = out.collect()
    want, _, _ = brute([(k, t) for k, (_, t, *_) in enumerate(rows)], [0, 1, 2])
    assert sorted((r.n_tokens, r.n_known, round(r.score, 6)) for r in got) == sorted((a[0], a[1], round(a[4], 6)) for a in want.values())
    assert {r.history for r in got} == {6}
    empty = spark.createDataFrame([], DOCS)
    assert score_documents(empty, F.lit(True)).count() == 0
    alone = score_documents(spark.createDataFrame(rows, DOCS), F.lit(False)).collect()
    assert len(alone) == 6 and {(r.train_tokens, r.base_score, r.score) for r in alone} == {(0, 0.0, 0.0)}


def test_discounts_leave_mass():
    for counts in ({}, {1: 5}, {1: 100, 2: 40, 3: 20, 4: 12, 5: 8, 6: 6, 50: 1}, {7: 3, 9: 1}, {1: 3, 2: 900}):
        d = good_turing(counts)(np.arange(1, 200))
        assert ((d > 0) & (d < 1)).all()
