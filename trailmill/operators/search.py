"""Many tokens searched in many texts, each text read once.

The tokens of a session are the patterns of an Aho-Corasick automaton, which passes over a
text once whatever their number and finds overlapping ones too.  Tokens and texts of a
session meet in one partition: tokens are dealt to blocks (so that an automaton is of
bounded size) and texts to slices of about `SLICE` characters, so that a session with a
large share of all rows is many groups.  A group's tokens come first and its texts stream
past them, batch by batch.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from trailmill.functions import fixed

#: Tokens of one automaton, and characters of the texts that one copy of it passes over, about.
BLOCK, SLICE = 100_000, 32 << 20


def spread(spark: SparkSession) -> int:
    """Partitions for work that costs time per row: Spark would size them by bytes alone."""
    return max(spark.sparkContext.defaultParallelism, int(spark.conf.get("spark.sql.shuffle.partitions")))


def automaton_of(tokens):
    """An automaton whose matches give (last place, number of the token), or nothing for no tokens."""
    import ahocorasick

    found = ahocorasick.Automaton(ahocorasick.STORE_INTS)
    for k, token in enumerate(tokens):
        if token:
            found.add_word(token, k)
    if not len(found):
        return None
    found.make_automaton()
    return found


def by_itself(text: str, start: int, end: int) -> bool:
    """Whether no letter or digit touches the part of the text."""
    return not (start and text[start - 1].isalnum()) and not (end < len(text) and text[end].isalnum())


def _passes(apart: bool):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, session, tokens, automaton, last = None, None, [], None, {}

        def found():
            return pa.RecordBatch.from_arrays(
                [pa.array([session] * len(last), pa.string()), pa.array([tokens[k] for k in last], pa.string()), pa.array(list(last.values()), pa.int64())], names=["session", "token", "last"]
            )

        for batch in batches:
            for row in zip(*(batch.column(c).to_pylist() for c in ("key", "session", "token", "text", "at"))):
                if row[0] != key:
                    if last:
                        yield found()
                    key, session, tokens, automaton, last = row[0], row[1], [], None, {}
                _, _, token, text, at = row
                if token is not None:
                    tokens.append(token)
                    continue
                if automaton is None:
                    if not tokens:
                        continue
                    automaton = automaton_of(tokens) or ()
                if automaton == ():
                    continue
                for end, k in automaton.iter(text):
                    if last.get(k, -1) < at and (not apart or by_itself(text, end + 1 - len(tokens[k]), end + 1)):
                        last[k] = at
        if last:
            yield found()

    return run


def last_places(wanted: DataFrame, texts: DataFrame, apart: bool = False) -> DataFrame:
    """session, token, last: those of `wanted` (session, token) that occur in texts of their session, and the last place.

    `texts` has session, text and at, a number from 0 that orders them.  With `apart` a
    token must stand without a letter or digit on either side.  Empty tokens occur nowhere.
    """
    wanted = wanted.select("session", "token").distinct()
    counts = wanted.groupBy("session").agg(F.ceil(F.count("*") / F.lit(BLOCK)).alias("blocks"))
    sizes = texts.groupBy("session").agg((F.floor(F.sum(F.length("text")) / F.lit(SLICE)) + 1).alias("slices")).join(counts, "session")
    dealt = lambda column, n: F.pmod(F.xxhash64(column), F.col(n))
    every = lambda n: F.explode(F.sequence(F.lit(0).cast("long"), F.col(n) - 1))
    none = F.lit(None).cast("string")
    patterns = wanted.join(sizes, "session").select("session", dealt("token", "blocks").alias("block"), every("slices").alias("slice"), "token", none.alias("text"), F.lit(0).cast("long").alias("at"))
    passed = texts.join(sizes, "session").select("session", dealt("text", "slices").alias("slice"), every("blocks").alias("block"), none.alias("token"), "text", F.col("at").cast("long").alias("at"))
    both = patterns.unionByName(passed).withColumn("key", F.concat_ws("#", "block", "slice", "session"))
    found = both.repartition(spread(wanted.sparkSession), "key").sortWithinPartitions("key", F.col("token").isNull()).select("key", "session", "token", "text", "at").mapInArrow(_passes(apart), "session string, token string, last long")
    return found.groupBy("session", "token").agg(F.max("last").alias("last"))


# --- one text -------------------------------------------------------------

_LETTERS = frozenset("abcdefghijklmnopqrstuvwxyzABCDEFGHIJKLMNOPQRSTUVWXYZ")
_HEX = frozenset("0123456789abcdefABCDEF")


def _shape(token: str) -> tuple[float, float, float, float, float, float]:
    """Has a digit, has a slash, ends like a file name, is a long hexadecimal, log of its length, share of digits."""
    digits = sum("0" <= c <= "9" for c in token)
    _, dot, ending = token.rpartition(".")
    named = bool(dot) and 1 <= len(ending) <= 5 and _LETTERS.issuperset(ending)
    return float(digits > 0), float("/" in token or "\\" in token), float(named), float(len(token) >= 8 and _HEX.issuperset(token)), math.log(len(token)), digits / len(token)


def places_of(tokens: list[str], text: str) -> tuple[list[int], list[int]]:
    """First place (-1: none) and count of each token, from one pass over the text."""
    first, count, free = [-1] * len(tokens), [0] * len(tokens), [0] * len(tokens)
    for end, k in (automaton_of(tokens) or _nothing).iter(text):
        start = end + 1 - len(tokens[k])
        if start >= free[k]:
            if not count[k]:
                first[k] = start
            count[k] += 1
            free[k] = end + 1
    return first, count


class _nothing:
    """The automaton of no tokens."""

    iter = staticmethod(lambda text: ())


def value_features(tokens: list[str], first: list[int], count: list[int], chars: int, last_input: str, prompt: str, distance: int, reused: set[str]) -> list[tuple[float, ...]]:
    """The thirteen features of each of a result's tokens, whose places are known."""
    automaton = automaton_of(tokens)
    if automaton is None:
        return []
    given, asked = ({k for _, k in automaton.iter(x)} for x in (last_input, prompt))
    length, far = float(max(chars, 1)), math.log1p(distance)
    return [
        (*_shape(t), math.log1p(count[k]), float(k in given), float(k in asked), far, first[k] / length, math.log(length), float(t in reused))
        for k, t in enumerate(tokens)
    ]


def _placed(keep: list[str]):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = batch.column("text").to_pylist()
            found = [places_of(tokens, text) for tokens, text in zip(batch.column("tokens").to_pylist(), texts)]
            numbers = [pa.array([x[k] for x in found], pa.list_(pa.int32())) for k in range(2)]
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in keep), *numbers, pa.array([len(x) for x in texts], pa.int32())], names=[*keep, "first", "count", "chars"])

    return run


def with_places(rows: DataFrame, keep: list[str]) -> DataFrame:
    """`keep` columns of rows (with text and tokens), first and count of each token in the text, and its characters."""
    schema = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in rows.select(*keep).schema.fields) + ", first array<int>, count array<int>, chars int"
    return rows.select(*dict.fromkeys([*keep, "text", "tokens"])).mapInArrow(_placed(keep), schema)


def _valued(keep: list[str]):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows == 0:
                continue
            rows, names, sizes = [], [], []
            for tokens, *rest, reused in zip(*(batch.column(c).to_pylist() for c in ("tokens", "first", "count", "chars", "last_input", "prompt", "distance", "reused"))):
                rows += value_features(tokens, *rest, set(reused or ()))
                names += tokens
                sizes.append(len(tokens))
            x = np.array(rows, float).reshape(len(names), len(fixed.MEANS))
            z = np.full(len(names), fixed.INTERCEPT)
            for k, (mean, deviation, weight) in enumerate(zip(fixed.MEANS, fixed.DEVIATIONS, fixed.COEFFICIENTS)):
                z = z + weight * (x[:, k] - mean) / deviation
            pairs = pa.StructArray.from_arrays([pa.array(names, pa.string()), pa.array(1 / (1 + np.exp(-z)))], names=["token", "p"])
            ends = np.concatenate([[0], np.cumsum(sizes)]).astype(np.int32)
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in keep), pa.ListArray.from_arrays(pa.array(ends), pairs)], names=[*keep, "values"])

    return run


def with_values(rows: DataFrame, keep: list[str]) -> DataFrame:
    """`keep` columns of rows with `values`, an array of (token, p): how likely the agent writes each of `tokens` again.

    Rows have tokens, their first, count and chars (of `with_places`), last_input, prompt, distance and reused (tokens that it did).
    """
    kept = rows.select(*keep)
    schema = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in kept.schema.fields) + ", values array<struct<token:string,p:double>>"
    return rows.select(*dict.fromkeys([*keep, "tokens", "first", "count", "chars", "last_input", "prompt", "distance", "reused"])).mapInArrow(_valued(keep), schema)
