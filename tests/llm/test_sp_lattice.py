import math
import zlib
from collections import Counter

import numpy as np
import pytest

from trailmill.llm import sp_lattice
from trailmill.llm.sp_lattice import build_lattice, decode, log_inclusion, load_vocabulary, sample_segmentations, sample_texts, vocabulary_path
from trailmill.llm.textkeys import mix

DOCS = "doc_id long, text string, ids string, sample int"


@pytest.fixture(scope="module")
def vocabulary():
    return load_vocabulary(vocabulary_path("piece_bpe_32k.model"))


@pytest.fixture(scope="module")
def model():
    import sentencepiece

    return sentencepiece.SentencePieceProcessor(model_file=vocabulary_path("piece_bpe_32k.model"))


def segmentations(text, model, v):
    """All segmentations and their shares, by recursion."""
    x = "▁" + text.replace(" ", "▁")
    names = {model.id_to_piece(i): i for i in range(model.vocab_size()) if not (model.is_byte(i) or model.is_control(i) or model.is_unknown(i))}
    out = []

    def rec(i, ids, w):
        if i == len(x):
            out.append((tuple(ids), w))
            return
        for j in range(i + 1, min(len(x), i + 16) + 1):
            if x[i:j] in names:
                rec(j, [*ids, names[x[i:j]]], w + v.weight[names[x[i:j]]])
        if x[i] not in names:
            b = x[i].encode()
            rec(i + 1, [*ids, *(int(v.byte_ids[c]) for c in b)], w + len(b) * v.byte_weight)

    rec(0, [], 0.0)
    z = math.log(sum(math.exp(w) for _, w in out))
    return {ids: math.exp(w - z) for ids, w in out}


def split(s):
    return [tuple(s.ids[a:b].tolist()) for a, b in zip(s.ends, s.ends[1:])]


def test_samples_follow_the_lattice(vocabulary, model):
    share = segmentations("the cat\nat", model, vocabulary)
    n = 20_000
    (one, two), threshold = sample_texts(["the cat\nat"] * n, np.random.default_rng(0).integers(0, 1 << 60, n), 2, vocabulary)
    first, second = split(one), split(two)
    counts = Counter(first)
    for ids in sorted(share, key=share.get)[-4:]:
        assert abs(counts[ids] / n - share[ids]) < 5 * math.sqrt(share[ids] / n)
    pairs = Counter(zip(first, second))
    a, b = sorted(share, key=share.get)[-2:]
    want = share[a] * share[b] / (1 - share[b])
    assert abs(pairs[b, a] / n - want) < 5 * math.sqrt(want / n)
    assert not any(x == y for x, y in zip(first, second))
    for s, ids in ((one, first), (two, second)):
        assert np.allclose(s.log_probability, [math.log(share[i]) for i in ids], atol=1e-9)
    assert (one.value >= two.value).all() and (two.value >= threshold).all()
    # Inclusion scores are unbiased: sum of p / q over the sample estimates 1.
    estimate = sum(np.exp(s.log_probability - log_inclusion(s.log_probability, threshold)) for s in (one, two))
    assert abs(estimate.mean() - 1) < 0.02


def test_small_lattices_are_listed_whole(vocabulary, model):
    share = segmentations("ab", model, vocabulary)
    samples, threshold = sample_texts(["ab", ""], np.array([5, 6]), len(share) + 3, vocabulary)
    seen = [ids for s in samples for d, ids in zip(s.docs, split(s)) if d == 0]
    assert sorted(seen) == sorted(share) and threshold[0] == -np.inf
    assert [len(s.docs) for s in samples][:2] == [2, 1]


def test_rows_do_not_depend_on_their_batch(vocabulary, sf_dir):
    import pyarrow.parquet as pq

    texts = pq.read_table(f"{sf_dir}/documents.parquet", columns=["text"])["text"].to_pylist()[:40]
    keys = np.arange(40) * 77
    together, _ = sample_texts(texts, keys, 2, vocabulary)
    for k in (0, 7, 39):
        alone, _ = sample_texts(texts[k : k + 1], keys[k : k + 1], 2, vocabulary)
        assert split(alone[1])[0] == split(together[1])[k]


def test_query_round_trip(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    out = sample_segmentations(docs, k=2)
    texts = {r.doc_id: r.text for r in docs.collect()}
    rows = decode(out).collect()
    assert len(rows) > 1.9 * len(texts)
    assert all(r.text == texts[r.doc_id] and r.decoded_crc32 == zlib.crc32(texts[r.doc_id].encode()) and r.log_inclusion <= 0 for r in rows)
    both = {}
    for r in rows:
        assert tuple(r.ids) not in both.setdefault(r.doc_id, set())
        both[r.doc_id].add(tuple(r.ids))


def test_edges(spark):
    strange = "tab\tnul\0 ∞ 日本 \U0001F600 ▁  x\r\n" + "Ω" * 3000 + " " * 500
    rows = [(1, None), (2, ""), (3, strange), (3, strange), (None, strange), (4, "ab " * 30_000)]
    frame = spark.createDataFrame([(i, t, "old", 9) for i, t in rows], DOCS)
    out = decode(sample_segmentations(frame, k=2)).collect()
    by = {}
    for r in out:
        by.setdefault(r.doc_id, []).append(r)
    assert [(r.sample, r.ids, r.text, r.log_inclusion) for r in by[1] + by[2]] == [(1, [], "", 0.0)] * 2
    assert len(by[3]) == 4 and (by[3][0].ids == by[3][2].ids or by[3][0].ids == by[3][1].ids)
    assert all(r.text == strange.replace("▁", " ") for r in by[3] + by[None])
    assert all(r.text == "ab " * 30_000 for r in by[4])
    assert sample_segmentations(frame.limit(0)).count() == 0


def test_a_step_is_drawn_by_one_hash(vocabulary, monkeypatch):
    """The hash of the row, the sample and the unit is made once for all steps of a unit."""
    sizes = []
    monkeypatch.setattr(sp_lattice, "mix", lambda x: sizes.append(len(x)) or mix(x))
    unit = np.zeros(1, np.int64)
    lattice = build_lattice(np.array([97 + k * k % 26 for k in range(400)]), unit, vocabulary)
    search = sp_lattice.Search(lattice, unit, np.array([0, 1]), np.array([5]))
    sizes.clear()
    edges = search.walk(unit, unit, unit, 0)[-1]
    assert len(edges) > 100 and sum(sizes) <= len(edges) + 4
