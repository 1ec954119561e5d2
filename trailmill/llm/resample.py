"""Drawing documents after the distribution of a target corpus.

Features are words and pairs of neighbouring words, hashed into buckets.  A bucket's gain is
the logarithm of how much more frequent it is in the target than in the corpus; a
document's weight is the mean gain of its features, and Gumbel noise seeded by its id makes
the highest scores a draw without replacement in proportion to exp(weight).

Gains are an array that tasks index with the buckets of a batch of texts.  All scores are
whole numbers of a bounded range (1000 times a logarithm of counts), so an exact histogram
of them is small: its suffix sums give the rank that each score begins with, and the
cutoff.  Only documents at or above the cutoff are ordered, by doc_id within one score.

Nulls: a null text has no words; a null doc_id is hashed as an empty one and comes last of
its score.  Repeated rows are documents of their own, ranked next to each other.  Very long
texts and words are read whole.  With an empty table there are no rows, with an empty
target all buckets count zero there.  Columns that are not asked for are not read.
"""

from __future__ import annotations

import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from trailmill.llm.textkeys import as_array, lean, slices, text_bytes
from trailmill.session import bounded_batches, cut

#: Longer words are hashed one by one.
WIDEST = 64
_WORD = np.zeros(256, bool)
_WORD[[*range(0x30, 0x3A), *range(0x61, 0x7B), *range(0x80, 0x100)]] = True
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
_ONES = np.uint32(0xFFFFFFFF)


def _crc_tables() -> tuple[np.ndarray, np.ndarray]:
    """CRC-32 of one byte, and what n zero bytes (n up to WIDEST + 1) make of each byte of a register."""
    step = np.arange(256, dtype=np.uint32)
    for _ in range(8):
        step = np.where(step & 1, (step >> 1) ^ np.uint32(0xEDB88320), step >> 1)
    shift = [np.arange(256, dtype=np.uint32)[None, :] << (8 * np.arange(4, dtype=np.uint32))[:, None]]
    for _ in range(WIDEST + 1):
        shift.append(step[shift[-1] & 255] ^ (shift[-1] >> 8))
    return step, np.stack(shift)


_STEP, _SHIFT = _crc_tables()


def _shifted(register: np.ndarray, n: np.ndarray) -> np.ndarray:
    """CRC registers after n more zero bytes each."""
    out = np.zeros(len(register), np.uint32)
    for k in range(4):
        out ^= _SHIFT[n, k, register >> (8 * k) & 255]
    return out


def feature_hashes(column: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """CRC-32 of every word and of every pair of words, and the number of words before each row and in all.

    The pair that begins with a row's last word does not exist; its place holds 0.
    """
    raw, ends = text_bytes(column)
    n = len(raw)
    if n == 0:
        return np.zeros(0, np.uint32), np.zeros(0, np.uint32), np.zeros(len(ends), np.int64)
    raw = _LOWER[raw]
    inside = _WORD[raw]
    edge = np.zeros(n + 1, bool)  # where a new text starts
    edge[ends] = True
    first = np.flatnonzero(inside & (edge[:-1] | np.concatenate([[True], ~inside[:-1]])))
    last = np.flatnonzero(inside & (edge[1:] | np.concatenate([~inside[1:], [True]]))) + 1
    size = last - first
    at = np.searchsorted(first, ends)
    # registers of the words alone, from an empty register: a column of letters at a time
    plain = np.zeros(len(first), np.uint32)
    order = np.argsort(-np.minimum(size, WIDEST + 1), kind="stable")
    long = int(np.count_nonzero(size > WIDEST))
    begin, length = first[order[long:]], size[order[long:]]
    register = np.zeros(len(begin), np.uint32)
    for k in range(int(length[0]) if len(length) else 0):
        m = int(np.searchsorted(-length, -k, "left"))
        register[:m] = _STEP[(register[:m] ^ raw[begin[:m] + k]) & 255] ^ (register[:m] >> 8)
    plain[order[long:]] = register
    fit = np.minimum(size, WIDEST)
    words = _shifted(np.full(len(first), _ONES), fit) ^ plain ^ _ONES
    for w in order[:long]:
        words[w] = zlib.crc32(raw[first[w] : last[w]].tobytes())
    pairs = np.zeros(len(first), np.uint32)
    if len(first) > 1:
        space = _shifted(np.full(len(first) - 1, _STEP[0x20]), fit[1:])
        pairs[:-1] = _shifted(words[:-1] ^ _ONES, fit[1:] + 1) ^ space ^ plain[1:] ^ _ONES
        for w in order[:long]:
            if w:
                pairs[w - 1] = zlib.crc32(b" " + raw[first[w] : last[w]].tobytes(), int(words[w - 1]))
    rows = np.flatnonzero(np.diff(at))
    pairs[at[rows + 1] - 1] = 0
    return words, pairs, at


def _count(buckets: int):
    def run(batches):
        total = np.zeros(buckets, np.int64)
        for batch in batches:
            column = as_array(batch.column("text"))
            for a, b in slices(column):
                words, pairs, at = feature_hashes(column.slice(a, b - a))
                real = np.ones(len(pairs), bool)
                real[at[1:][np.diff(at) > 0] - 1] = False
                for hashes in (words, pairs[real]):
                    total += np.bincount(hashes % np.uint32(buckets), minlength=buckets)
        found = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(found.astype(np.int32)), pa.array(total[found])], names=["bucket", "n"])

    return run


def bucket_counts(texts: DataFrame, buckets: int) -> np.ndarray:
    """How many features of all `texts` fall into each bucket (`buckets` numbers reach the driver)."""
    counts = texts.select(F.col("text").cast("string").alias("text")).mapInArrow(lean(_count(buckets)), "bucket int, n long")
    out = np.zeros(buckets, np.int64)
    for r in counts.groupBy("bucket").agg(F.sum("n").alias("n")).collect():
        out[r.bucket] = r.n
    return out


def gains(corpus: np.ndarray, target: np.ndarray) -> np.ndarray:
    """floor(1000 * log of the ratio of smoothed shares) of every bucket."""
    top = (target + 1).astype(float) * float(corpus.sum() + len(corpus))
    bottom = (corpus + 1).astype(float) * float(target.sum() + len(target))
    return np.floor(1000 * np.log(top / bottom)).astype(np.int64)


def _weigh(shared, keep: list[str]):
    def run(batches):
        gain = shared.value
        for batch in batches:
            column = as_array(batch.column("text"))
            n_words, weight = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]
            for a, b in slices(column):
                words, pairs, at = feature_hashes(column.slice(a, b - a))
                size = np.diff(at)
                each = gain[words % np.uint32(len(gain))]
                both = gain[pairs % np.uint32(len(gain))]
                both[at[1:][size > 0] - 1] = 0  # no pair
                sums = np.diff(np.concatenate([[0], np.cumsum(each + both)])[at])
                n_words.append(size)
                weight.append(sums // np.maximum(2 * size - 1, 1))
            columns = [*(batch.column(c) for c in keep), pa.array(np.concatenate(n_words)), pa.array(np.concatenate(weight))]
            yield pa.RecordBatch.from_arrays(columns, names=[*keep, "n_words", "weight"])

    return run


def gumbel(seed: str) -> Column:
    """1000 times standard Gumbel noise, rounded down, seeded by `doc_id`."""
    key = F.concat(F.lit(f"{seed}:"), F.coalesce(F.col("doc_id").cast("string"), F.lit("")))
    h = F.conv(F.substring(F.sha2(key, 256), 1, 8), 16, 10).cast("long")
    return F.floor(-1000 * F.log(-F.log((h + 0.5) / 4294967296)))


def resample(docs: DataFrame, target: DataFrame, percent: int = 25, least_words: int = 20, buckets: int = 10_000, seed: str = "7", keep: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """All `docs` (doc_id, text): the columns `keep` (doc_id among them), n_words, n_features, weight, score and rank.

    Of the N documents with at least `least_words` words, floor(percent * N / 100) are drawn
    and ranked from 1; the others' rank is null.  `target` has a column `text`.  Names that
    the result adds can't be kept.
    """
    bounded_batches(docs.sparkSession)
    keep = list(keep)
    gain = docs.sparkSession.sparkContext.broadcast(gains(bucket_counts(docs, buckets), bucket_counts(target, buckets)))
    rows = docs.withColumn("text", F.col("text").cast("string")).select(*dict.fromkeys([*keep, "text"]))
    schema = T.StructType([*rows.select(*keep).schema.fields, T.StructField("n_words", T.LongType()), T.StructField("weight", T.LongType())])
    weighed = rows.mapInArrow(lean(_weigh(gain, keep)), schema)
    features = F.greatest(2 * F.col("n_words") - 1, F.lit(0)).alias("n_features")
    scored = cut(weighed.select(*keep, "n_words", features, "weight", (F.col("weight") + gumbel(seed)).alias("score")), "scored")
    return ranked(scored, percent, F.col("n_words") >= least_words)


def ranked(scored: DataFrame, percent: int, eligible: Column) -> DataFrame:
    """`scored` (doc_id, n_features, weight and a whole-numbered score of bounded range) with the rank of the drawn rows."""
    spark = scored.sparkSession
    histogram = sorted(scored.where(eligible).groupBy("score").count().collect(), reverse=True)
    drawn = percent * sum(r["count"] for r in histogram) // 100
    before, offsets = 0, []
    for score, n in histogram:
        if before >= drawn:
            break
        offsets.append((score, before))
        before += n
    rest = scored.withColumn("rank", F.lit(None).cast("long"))
    if not offsets:
        return rest
    cutoff = offsets[-1][0]
    places = spark.createDataFrame(offsets, "score long, _before long")
    order = Window.partitionBy("score").orderBy(F.col("doc_id").asc_nulls_last(), "n_features")
    above = scored.where(eligible & (F.col("score") >= cutoff)).join(F.broadcast(places), "score")
    rank = F.col("_before") + F.row_number().over(order)
    top = above.withColumn("rank", rank).withColumn("rank", F.when(F.col("rank") <= drawn, F.col("rank"))).select(*rest.columns)
    return top.unionByName(rest.where(~(F.coalesce(eligible, F.lit(False)) & (F.col("score") >= cutoff))))
