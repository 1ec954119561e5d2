"""Language identification with a blended-spectrum string kernel.

The kernel of two texts is the sum over n = 1, 2, 3 of the cosine between their sets of
present byte n-grams (of the lower-cased text).  A Nystroem approximation with landmark
texts turns it into features, and one-versus-rest kernel ridge regression with +-1
targets is fitted on them.  The fit uses a bounded sample of labelled rows: of each
language the rows with the smallest hashed ids, up to `TRAIN_PER_LANGUAGE` rows and, but
for the first, `TRAIN_BYTES` of text (`TRAIN_ROWS` rows and `LANDMARKS` landmarks over all
languages).  Prediction reads every text whole.

Since K(x, landmarks) @ alpha is linear in the presence vector of x, the landmark and
coefficient matrices are multiplied once, and a batch of texts is scored by one product
of its presence matrix per n.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from trailmill.llm.textkeys import lean, slices, text_bytes
from trailmill.session import bounded_batches

TRAIN_PER_LANGUAGE, TRAIN_ROWS = 600, 60_000
LANDMARKS_PER_LANGUAGE, LANDMARKS = 48, 2400
TRAIN_BYTES = 4 << 20
RIDGE = 1e-2
SIZES = (1, 2, 3)
UNDETERMINED = "und"
#: Rows of one presence matrix.
ROWS = 128


@dataclass
class LanguageModel:
    """languages in order, the n-grams known per n, and their weights (n-grams x languages)."""

    languages: list[str]
    grams: list[np.ndarray]
    weights: list[np.ndarray]
    bias: np.ndarray


def gram_codes(raw: np.ndarray, ends: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
    """(row, code) of every byte n-gram that lies within one text."""
    count = len(raw) - n + 1
    if count <= 0:
        return np.zeros(0, np.int64), np.zeros(0, np.uint32)
    code = raw[:count].astype(np.uint32)
    for k in range(1, n):
        code = (code << np.uint32(8)) | raw[k : k + count]
    lengths = np.diff(ends)
    row = np.repeat(np.arange(len(lengths)), lengths)
    whole = row[:count] == row[n - 1 :]
    return row[:count][whole], code[whole]


def presence(raw: np.ndarray, ends: np.ndarray, table: np.ndarray, size: int, n: int) -> np.ndarray:
    """0/1 matrix: texts x known n-grams; `table` maps a code to its column or -1."""
    row, code = gram_codes(raw, ends, n)
    column = table[code]
    known = column >= 0
    out = np.zeros((len(ends) - 1, size), np.float32)
    out[row[known], column[known]] = 1
    return out


def _tables(grams: list[np.ndarray]) -> list[np.ndarray]:
    tables = []
    for n, known in zip(SIZES, grams):
        kind = np.int16 if len(known) < 1 << 15 else np.int32
        table = np.full(1 << (8 * n), -1, kind)
        table[known] = np.arange(len(known), dtype=kind)
        tables.append(table)
    return tables


def _unit(matrix: np.ndarray) -> np.ndarray:
    return matrix / np.sqrt(np.maximum(matrix.sum(1, keepdims=True), 1))


def fit_language_model(labelled: DataFrame) -> LanguageModel:
    """Fit on `labelled` (doc_id, text, lang); null texts and null labels are left out.

    The sample is the rows of each language whose hashed ids are smallest, found by a
    hash threshold from the language's row count, so it needs no sort of the table.
    """
    rows = labelled.where("text is not null and lang is not null")
    rows = rows.select("doc_id", "text", "lang", F.shiftrightunsigned(F.xxhash64("doc_id"), 11).alias("place"))
    counts = {r.lang: r.n for r in rows.groupBy("lang").agg(F.count("*").alias("n")).collect()}
    if not counts:
        return LanguageModel([], [np.zeros(0, np.int64) for _ in SIZES], [np.zeros((0, 0)) for _ in SIZES], np.zeros(0))
    most = max(1, min(TRAIN_PER_LANGUAGE, TRAIN_ROWS // len(counts)))
    share = F.create_map(*[x for lang, n in counts.items() for x in (F.lit(lang), F.lit(min(1.0, 1.5 * most / n)))])
    near = rows.where(F.col("place") < share[F.col("lang")] * float(1 << 53))
    order = Window.partitionBy("lang").orderBy("place", "doc_id", F.octet_length("text"))
    # What a row would be refused by is known before its text travels.
    slim = near.select("lang", "place", "doc_id", F.xxhash64("text").alias("key"), F.row_number().over(order).alias("n"), F.sum(F.octet_length("text")).over(order.rowsBetween(Window.unboundedPreceding, 0)).alias("bytes"))
    taken = slim.where((F.col("n") == 1) | ((F.col("n") <= most) & (F.col("bytes") <= TRAIN_BYTES))).select("lang", "place", "key").distinct()
    picked = near.withColumn("key", F.xxhash64("text")).join(taken, ["lang", "place", "key"], "left_semi").select("lang", "place", "text").toPandas()
    picked = picked.sort_values(["lang", "place", "text"]).groupby("lang").head(most)
    picked["text"] = pc.utf8_lower(pa.array(picked["text"], pa.string())).to_pylist()
    languages = sorted(picked["lang"].unique())
    texts = [t.encode() for t in picked["text"]]
    raw, ends = np.frombuffer(b"".join(texts), np.uint8), np.concatenate([[0], np.cumsum([len(t) for t in texts])]).astype(np.int64)
    mark = np.zeros(len(picked), bool)
    mark[np.flatnonzero(picked.groupby("lang").cumcount().to_numpy() < max(1, min(LANDMARKS_PER_LANGUAGE, LANDMARKS // len(languages))))] = True
    marks = [t for t, m in zip(texts, mark) if m]
    mraw, mends = np.frombuffer(b"".join(marks), np.uint8), np.concatenate([[0], np.cumsum([len(t) for t in marks])]).astype(np.int64)
    grams = [np.unique(gram_codes(mraw, mends, n)[1]).astype(np.int64) for n in SIZES]
    tables = _tables(grams)
    landmarks = [_unit(presence(mraw, mends, t, len(g), n)) for n, g, t in zip(SIZES, grams, tables)]
    inner = sum(m @ m.T for m in landmarks).astype(np.float64)
    kernel = np.zeros((len(texts), len(marks)))
    for a in range(0, len(texts), ROWS):
        b = min(a + ROWS, len(texts))
        part, at = raw[ends[a] : ends[b]], ends[a : b + 1] - ends[a]
        kernel[a:b] = sum(_unit(presence(part, at, t, len(g), n)) @ m.T for n, g, t, m in zip(SIZES, grams, tables, landmarks))
    values, vectors = np.linalg.eigh(inner)
    good = values > 1e-6 * values[-1]
    root = vectors[:, good] / np.sqrt(values[good])
    features = kernel @ root
    target = np.where(picked["lang"].to_numpy()[:, None] == np.array(languages)[None, :], 1.0, -1.0)
    middle, bias = features.mean(0), target.mean(0)
    centred = features - middle
    solved = np.linalg.solve(centred.T @ centred + RIDGE * len(texts) / 100 * np.eye(centred.shape[1]), centred.T @ (target - bias))
    alpha = root @ solved
    return LanguageModel(languages, grams, [m.T.astype(np.float64) @ alpha for m in landmarks], bias - middle @ solved)


def _score(model):
    def run(batches):
        m: LanguageModel = model.value
        tables = _tables(m.grams)
        weights = [w.astype(np.float32) for w in m.weights]
        for batch in batches:
            column = pc.utf8_lower(batch.column("text" if "text" in batch.schema.names else "_text"))
            best, score = [], []
            for a, b in slices(column, 1 << 20):
                for x in range(a, b, ROWS):
                    y = min(x + ROWS, b)
                    raw, ends = text_bytes(column.slice(x, y - x))
                    total = np.tile(m.bias, (y - x, 1))
                    for n, t, g, w in zip(SIZES, tables, m.grams, weights):
                        p = presence(raw, ends, t, len(g), n)
                        total += (p @ w) / np.sqrt(np.maximum(p.sum(1, keepdims=True), 1))
                    best.append(total.argmax(1))
                    score.append(np.clip((total.max(1) + 1) / 2, 0, 1))
            best = np.concatenate(best) if best else np.zeros(0, np.int64)
            score = np.concatenate(score) if score else np.zeros(0)
            letters = batch.column("_letters").to_numpy(zero_copy_only=False).astype(bool)
            names = np.array(m.languages, object)[best]
            names[~letters] = UNDETERMINED
            score[~letters] = 0.0
            keep = [c for c in batch.schema.names if c not in ("_text", "_letters")]
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in keep), pa.array(names, pa.string()), pa.array(score, pa.float64())], names=[*keep, "lang_pred", "lang_score"])

    return run


def held_out(fold: int, key: str = "doc_id") -> Column:
    return F.crc32(F.col(key).cast("string")) % fold == 0


def predict_language(docs: DataFrame, model: LanguageModel, keep: list[str]) -> DataFrame:
    """Columns `keep` of `docs` with lang_pred and lang_score (0 to 1).

    A text that is null or without any letter is `und` with score 0, as is every text
    when there was nothing to learn from; ties go to the first language in order.  Columns of
    these names in `keep` are replaced.
    """
    keep = [c for c in keep if c not in ("lang_pred", "lang_score", "_text", "_letters")]
    letters = F.coalesce(F.col("text").rlike(r"\p{L}"), F.lit(False))
    if not model.languages:
        return docs.select(*keep, F.lit(UNDETERMINED).alias("lang_pred"), F.lit(0.0).alias("lang_score"))
    shared = docs.sparkSession.sparkContext.broadcast(model)
    bounded_batches(docs.sparkSession)
    ready = docs.select(*keep, *([] if "text" in keep else [F.col("text").alias("_text")]), letters.alias("_letters"))
    schema = T.StructType([*docs.select(*keep).schema.fields, T.StructField("lang_pred", T.StringType()), T.StructField("lang_score", T.DoubleType())])
    return ready.mapInArrow(lean(_score(shared)), schema)


def identify(docs: DataFrame, keep: list[str], fold: int = 5) -> DataFrame:
    """Fit on the labelled rows outside the held-out fold of `docs` and predict every row."""
    training = docs.where(~F.coalesce(held_out(fold), F.lit(True))).select("doc_id", "text", "lang")
    return predict_language(docs, fit_language_model(training), keep)
