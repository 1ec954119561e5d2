"""Equal-size shards by histogram sort, in DataFrame operations only.

Rows are ordered by (hash of the text, hash of the id), so equal texts are neighbours.
The driver holds an interval of keys for every shard border and, in each round, counts
exactly the bytes and rows below evenly spaced probes inside all open intervals with one
aggregation; the interval then shrinks to the probe pair around the wanted byte count.
A border is settled when a probe lies within the tolerance, or when one row is left in
its interval.  An interval that holds one text only (a group of copies larger than the
tolerance) goes on by the id hash.  Rows are then exchanged once, by shard and slot
bucket.
"""

from __future__ import annotations

from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from trailmill.session import cut

LIMIT = 1 << 63
#: Probes per open interval and round.
FAN = 64
FIRST_FAN = 4096
#: Rows of one (shard, bucket) pair that are numbered together, about.
SLOT_ROWS = 20_000
#: Distance from the ideal border, as a part of a shard, at which a border is settled.
TOLERANCE = 0.002


@dataclass
class Border:
    """An interval [low, high) of `column` values (within text hash `key`, if set) around a border."""

    target: int
    low: int = 0
    high: int = LIMIT
    below: int = 0
    key: int | None = None
    settled: tuple[int, int] | None = None

    def settle(self, value: int) -> None:
        self.settled = (value, 0) if self.key is None else (self.key, value)


def _total(conditions: list[Column]) -> Column:
    """How many of the conditions hold (a balanced sum, so that plans stay shallow)."""
    parts = [c.cast("int") for c in conditions] or [F.lit(0)]
    while len(parts) > 1:
        parts = [reduce(lambda a, b: a + b, parts[k : k + 2]) for k in range(0, len(parts), 2)]
    return parts[0]


def _count(keys: DataFrame, spans: list[tuple[int | None, int, int]], fan: int) -> dict:
    """Bytes, rows and first and last text hash in each of `fan` parts of every span."""
    width = [max(1, -(-(high - low) // fan)) for _, low, high in spans]
    value = [F.col("key") if key is None else F.col("tie") for key, _, _ in spans]
    inside = [
        (v >= low) & (v <= high - 1) & (F.lit(True) if key is None else F.col("key") == key)
        for v, (key, low, high) in zip(value, spans)
    ]
    span = F.coalesce(*[F.when(c, F.lit(k)) for k, c in enumerate(inside)])
    part = F.coalesce(*[F.when(c, F.expr(f"({'key' if s[0] is None else 'tie'} - {s[1]}L) div {w}L")) for c, s, w in zip(inside, spans, width)])
    rows = keys.select(span.alias("span"), part.alias("part"), "size", "key").where("span is not null")
    found = rows.groupBy("span", "part").agg(F.sum("size").alias("bytes"), F.count("*").alias("rows"), F.min("key").alias("first"), F.max("key").alias("last")).collect()
    out: dict[int, list] = {k: [] for k in range(len(spans))}
    for r in found:
        out[r.span].append((r.part, r.bytes, r.rows, r["first"], r["last"], width[r.span]))
    return {k: sorted(v) for k, v in out.items()}


def find_borders(keys: DataFrame, shards: int, tolerance: float = TOLERANCE) -> list[tuple[int, int]]:
    """Cut points (text hash, id hash) between `shards` parts of near-equal bytes.

    `keys` has size, key and tie (both from 0 to 2^63 - 1).
    """
    total = keys.agg(F.sum("size")).first()[0] or 0
    if total == 0 or shards < 2:
        return [(LIMIT - 1, LIMIT - 1)] * (shards - 1)
    near = tolerance * total / shards
    borders = [Border(round(total * k / shards)) for k in range(1, shards)]
    fan = FIRST_FAN
    while still := [b for b in borders if b.settled is None]:
        spans = sorted({(b.key, b.low, b.high) for b in still}, key=lambda s: (s[0] or -1, s[1]))
        counted = _count(keys, spans, fan)
        fan = FAN
        for b in still:
            k = spans.index((b.key, b.low, b.high))
            below, low, high = b.below, b.low, b.high
            for part, size, rows, first, last, width in counted[k]:
                start, end = low + part * width, min(high, low + (part + 1) * width)
                if below + size < b.target:
                    below += size
                    continue
                ahead, after = b.target - below, below + size - b.target
                b.low, b.high, b.below = start, end, below
                if min(ahead, after) <= near or rows == 1 or (end - start == 1 and b.key is not None):
                    b.settle(start if ahead <= after else end)
                elif first == last and b.key is None:
                    b.key, b.low, b.high = first, 0, LIMIT
                break
            else:  # the target is the very end of what was counted
                b.settle(high)
    return [b.settled for b in borders]


def shard_documents(docs: DataFrame, shards: int = 40, tolerance: float = TOLERANCE) -> DataFrame:
    """`docs` with size, text_crc32, law, shard, slot and grown_shard (null under this law).

    Size is the text's UTF-8 bytes (null: none) plus 16.  Shards hold near-equal bytes;
    slots number each shard's rows from 0 without gaps, in key order within each bucket of
    ids.  Equal texts share a shard but where the border between two shards must run
    through them.  Columns of these names in the input are replaced; rows that repeat a
    text and an id stay together.  An empty table gives an empty result.
    """
    own = ("size", "text_crc32", "law", "shard", "slot", "grown_shard")
    docs = docs.drop(*own, "_key", "_tie", "_bucket", "_before")
    mask = F.lit(LIMIT - 1)
    named = docs.withColumns(
        {
            "size": F.coalesce(F.octet_length("text").cast("long"), F.lit(0)) + F.lit(16).cast("long"),
            "text_crc32": F.crc32(F.coalesce(F.col("text"), F.lit("")).cast("binary")),
            "_key": F.xxhash64(F.coalesce(F.col("text"), F.lit(""))).bitwiseAND(mask),
            "_tie": F.xxhash64("doc_id").bitwiseAND(mask),
        }
    )
    keys = cut(named.select("size", F.col("_key").alias("key"), F.col("_tie").alias("tie")), "keys")
    borders = find_borders(keys, shards, tolerance)

    def shard(key: str, tie: str) -> Column:
        k, t = F.col(key), F.col(tie)
        past = [(k >= a) if b == 0 else (k > a) | ((k == a) & (t >= b)) for a, b in borders if a < LIMIT]
        return _total(past)

    rows = keys.count()
    buckets = max(1, rows // (shards * SLOT_ROWS))

    def bucket(tie: str) -> Column:
        return F.pmod(F.col(tie), F.lit(buckets)).cast("int")

    counts = keys.select(shard("key", "tie").alias("shard"), bucket("tie").alias("_bucket")).groupBy("shard", "_bucket").agg(F.count("*").alias("n"))
    before = Window.partitionBy("shard").orderBy("_bucket").rowsBetween(Window.unboundedPreceding, -1)
    offsets = counts.select("shard", "_bucket", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("_before"))
    dealt = named.withColumns({"shard": shard("_key", "_tie"), "_bucket": bucket("_tie")})
    order = Window.partitionBy("shard", "_bucket").orderBy("_key", "_tie", "doc_id")
    return dealt.join(offsets, ["shard", "_bucket"]).select(
        *docs.columns, "size", "text_crc32", F.lit("bytes").alias("law"), "shard",
        (F.col("_before") + F.row_number().over(order) - 1).alias("slot"), F.lit(None).cast("int").alias("grown_shard"),
    )
