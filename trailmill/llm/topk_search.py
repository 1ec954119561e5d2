"""Exact top-k inner-product search on a bit-sliced index.

Vectors are quantised to integers, and every block of rows keeps, per attribute and bit,
one bitmap over its rows (two's complement).  A query's scores are built as bitmaps too:
each attribute's slices, shifted by the signed binary digits of the query's component, are
added by carry-save adders, all rows of the block at once.  The top rows are then picked
from the most significant score slice downward: rows that have the bit set are kept while
they fit, the others stay at the boundary; ties that are left at the end are resolved
exactly, by the smaller id.

The slices of a block are built once, where its rows are read.  A block then goes to one
task, and the queries are sent to it in groups: a copy of the queries per block of up to
`ROWS` rows travels, never the rows, and k rows a query and block come back.
"""

from __future__ import annotations

import json

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from trailmill.llm.textkeys import lean
from trailmill.session import cut

#: Rows of one block at most, and queries of one group.
ROWS = 131_072
QUERIES = 128
#: Rows that are worth a block of their own, where cores would be idle otherwise.
LEAST_ROWS = 2048
LONG = (1 << 63) - 1
FULL = np.uint64(0xFFFFFFFFFFFFFFFF)


def quantise(vector: np.ndarray, scale: int = 1024) -> np.ndarray:
    """floor(scale * x) in double precision; Python integers where one is beyond 2^60."""
    whole = np.floor(vector.astype(np.float64) * scale)
    if whole.size and np.abs(whole).max() >= 1 << 60:
        return np.vectorize(int, otypes=[object])(whole)
    return whole.astype(np.int64)


class SlicedBlock:
    """Bitmaps of one block: rows are ids in order, slices[k] is bit weight[k] of attribute dim[k]."""

    def __init__(self, ids: np.ndarray, values: np.ndarray):
        order = np.argsort(ids, kind="stable")
        values = values[order]
        n, dims = values.shape
        words = -(-n // 64)
        wide = lambda x: int(x if x >= 0 else ~x).bit_length() + 1
        bits = [max(wide(a), wide(b)) for a, b in zip(values.min(0), values.max(0))]
        slices = np.zeros((sum(bits), words), np.uint64)
        flags = np.zeros(words * 64, np.uint8)
        at = 0
        for d in range(dims):
            for i in range(bits[d]):
                flags[:n] = values[:, d] >> i & 1
                slices[at] = np.packbits(flags, bitorder="little").view(np.uint64)
                at += 1
        self._set(ids[order], np.array(bits, np.int64), slices)

    def _set(self, ids: np.ndarray, bits: np.ndarray, slices: np.ndarray):
        self.ids, self.bits, self.slices = ids, bits, slices
        self.words = slices.shape[1] if len(slices) else -(-len(ids) // 64)
        self.start = np.concatenate([[0], np.cumsum(bits)]).astype(np.int64)
        self.weight = np.concatenate([np.arange(b) for b in bits]) if len(bits) else np.zeros(0, np.int64)
        self.top = np.zeros(len(self.weight), bool)  # the sign slice counts as -2^weight
        self.top[self.start[1:] - 1] = True
        self.rows = np.packbits(np.arange(self.words * 64) < len(ids), bitorder="little").view(np.uint64)

    def pack(self) -> tuple[bytes, bytes, bytes]:
        return self.ids.tobytes(), self.bits.tobytes(), self.slices.tobytes()

    @classmethod
    def unpack(cls, ids: bytes, bits: bytes, slices: bytes) -> "SlicedBlock":
        block = cls.__new__(cls)
        ids, bits = np.frombuffer(ids, np.int64), np.frombuffer(bits, np.int64)
        block._set(ids, bits, np.frombuffer(slices, np.uint64).reshape(int(bits.sum()), -1))
        return block

    def score(self, query: np.ndarray) -> tuple[list[np.ndarray], int]:
        """(bitmaps of score + offset from the least significant one, offset)."""
        pieces, shifts, negative = [], [], []
        for d, value in enumerate(query.tolist()):
            rest, j = value, 0
            while rest:  # non-adjacent signed digits: a third of them are set
                if rest & 1:
                    digit = 2 - (rest & 3)
                    rest -= digit
                    pieces.append(np.arange(self.start[d], self.start[d + 1]))
                    shifts.append(np.full(len(pieces[-1]), j))
                    negative.append(np.full(len(pieces[-1]), digit < 0))
                rest >>= 1
                j += 1
        if not pieces:
            return [], 0
        row = np.concatenate(pieces)
        minus = np.concatenate(negative) ^ self.top[row]
        weight = self.weight[row] + np.concatenate(shifts)
        # A slice that counts negatively is added inverted: -b = ~b - 1.
        offset = sum(int(n) << w for w, n in enumerate(np.bincount(weight[minus])))
        order = np.argsort(weight, kind="stable")
        row, minus, ends = row[order], minus[order], np.searchsorted(weight[order], np.arange(weight.max() + 2))
        out: list[np.ndarray] = []
        carried: list[np.ndarray] = []
        w = 0
        while w < len(ends) - 1 or carried:
            stacks = carried
            if w < len(ends) - 1 and ends[w] < ends[w + 1]:
                part = slice(ends[w], ends[w + 1])
                stacks = [*carried, self.slices[row[part]] ^ np.where(minus[part], FULL, np.uint64(0))[:, None]]
            stack = np.concatenate(stacks) if stacks else np.zeros((1, self.words), np.uint64)
            carried = []
            while len(stack) > 1:
                third = len(stack) // 3
                if third:
                    a, b, c = stack[:third], stack[third : 2 * third], stack[2 * third : 3 * third]
                    half = a ^ b
                    carried.append((a & b) | (half & c))
                    stack = np.concatenate([half ^ c, stack[3 * third :]])
                else:
                    carried.append((stack[:1] & stack[1:2]))
                    stack = stack[:1] ^ stack[1:2]
            out.append(stack[0])
            w += 1
        return out, offset

    def top_rows(self, scores: list[np.ndarray], rows: np.ndarray, k: int) -> np.ndarray:
        """Positions of the k rows of bitmap `rows` with the largest scores, ties to smaller ids."""
        sure, edge, need = np.zeros_like(rows), rows, k
        for bitmap in reversed(scores):
            set_rows = edge & bitmap
            n = int(np.bitwise_count(set_rows).sum())
            if n > need:
                edge = set_rows
            else:
                sure, edge, need = sure | set_rows, edge & ~bitmap, need - n
        chosen = np.flatnonzero(np.unpackbits(sure.view(np.uint8), bitorder="little"))
        ties = np.flatnonzero(np.unpackbits(edge.view(np.uint8), bitorder="little"))[:need]
        return np.concatenate([chosen, ties])

    def search(self, query_id: int, query: np.ndarray, k: int) -> list[tuple[int, int]]:
        """(id, score) of the top k rows but the query's own."""
        rows = self.rows
        for own in np.flatnonzero(self.ids == query_id):
            rows = rows.copy()
            rows[own >> 6] &= ~(np.uint64(1) << np.uint64(own & 63))
        scores, offset = self.score(query)
        found = self.top_rows(scores, rows, k)
        bits = lambda bitmap: bitmap[found >> 6] >> (found & 63).astype(np.uint64) & np.uint64(1)
        if len(scores) < 62:
            value = np.full(len(found), -offset, np.int64)
            for w, bitmap in enumerate(scores):
                value += bits(bitmap).astype(np.int64) << w
            return list(zip(self.ids[found].tolist(), value.tolist()))
        exact = [sum(1 << w for w, b in enumerate(row) if b) - offset for row in np.stack([bits(x) for x in scores], 1).tolist()]
        return list(zip(self.ids[found].tolist(), exact))


def usable(vector: str = "embedding") -> F.Column:
    """Not null, not empty, without null, NaN or infinite components."""
    x = F.col(vector)
    fine = F.forall(x, lambda v: v.isNotNull() & ~F.isnan(v) & (F.abs(v) != float("inf")))
    return F.coalesce(x.isNotNull() & (F.size(x) > 0) & fine, F.lit(False))


def _dense(column: pa.Array, dims: int) -> np.ndarray:
    """Rows of a list column as a matrix; shorter vectors are filled up with zeros."""
    lists = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    sizes = np.diff(np.asarray(lists.offsets))
    flat = lists.flatten().to_numpy(zero_copy_only=False).astype(np.float64)
    if len(sizes) and (sizes == dims).all():
        return flat.reshape(len(sizes), dims)
    out = np.zeros((len(sizes), dims))
    row = np.repeat(np.arange(len(sizes)), sizes)
    out[row, np.arange(len(flat)) - np.repeat(np.cumsum(sizes) - sizes, sizes)] = flat
    return out


def _blocks(dims: int, scale: int):
    """One row for the partition, whose rows are one block: its number, ids, bits per attribute, and slices."""

    def run(batches):
        kept = [(b.column("vec_id").to_numpy(), quantise(_dense(b.column("embedding"), dims), scale)) for b in batches if b.num_rows]
        if kept:
            done = SlicedBlock(*(np.concatenate(x) for x in zip(*kept))).pack()
            yield pa.RecordBatch.from_arrays([pa.array([TaskContext.get().partitionId()], pa.int32()), *(pa.array([x], pa.binary()) for x in done)], names=["block", "ids", "bits", "slices"])

    return run


def _packed(values: np.ndarray) -> bytes:
    """Integers as 64-bit ones, or as text where one needs more."""
    return b"t" + json.dumps(values.tolist()).encode() if values.dtype == object else b"b" + values.tobytes()


def _unpacked(data: bytes, rows: int) -> np.ndarray:
    return np.array(json.loads(data[1:]), object) if data[:1] == b"t" else np.frombuffer(data[1:], np.int64).reshape(rows, -1)


def _groups(dims: int, scale: int):
    """Groups of queries: their ids and quantised vectors."""

    def run(batches):
        for batch in batches:
            for at in range(0, batch.num_rows, QUERIES):
                part = batch.slice(at, QUERIES)
                values = quantise(_dense(part.column("embedding"), dims), scale)
                yield pa.RecordBatch.from_arrays([pa.array([part.column("vec_id").to_numpy().tobytes()], pa.binary()), pa.array([_packed(values)], pa.binary())], names=["ids", "vectors"])

    return run


def _search(k: int):
    """Rows come by block: the block first, then the groups of queries."""

    def run(batches):
        index, at = None, None
        for batch in batches:
            query, vec, score = [], [], []
            for i in range(batch.num_rows):
                block, ids, bits, payload = (batch.column(c)[i].as_py() for c in ("block", "ids", "bits", "payload"))
                if bits is not None:
                    index, at = SlicedBlock.unpack(ids, bits, payload), block
                elif block == at:  # a number without rows has no block
                    ids = np.frombuffer(ids, np.int64)
                    for q, v in zip(ids, _unpacked(payload, len(ids))):
                        found = index.search(int(q), v, k)
                        query += [int(q)] * len(found)
                        vec += [x for x, _ in found]
                        score += [max(-LONG - 1, min(LONG, s)) for _, s in found]
            yield pa.RecordBatch.from_arrays([pa.array(query, pa.int64()), pa.array(vec, pa.int64()), pa.array(score, pa.int64())], names=["query_id", "vec_id", "score"])

    return run


def top_k(vectors: DataFrame, queries: DataFrame, k: int = 10, scale: int = 1024) -> DataFrame:
    """query_id, rank (from 1), vec_id and score of each query's k best rows but its own.

    Both tables have vec_id and embedding; rows with a null id or an unusable vector take
    no part, and shorter vectors count as filled up with zeros.  Scores are inner products
    of the quantised vectors; ties go to the smaller vec_id, and a query with fewer other
    rows returns them all.  Rows that repeat an id are candidates of their own; a query id
    with several vectors has the best rows of all of them.  Components of any finite size
    are quantised exactly; a score beyond 64 bits is returned as the nearest long, and such
    scores of different blocks are ranked as ties.  Other columns are ignored.
    """
    spark = vectors.sparkSession
    vector = F.col("embedding").cast("array<double>").alias("embedding")
    rows, asked = (t.where(usable() & F.col("vec_id").isNotNull()).select(F.col("vec_id").cast("long").alias("vec_id"), vector) for t in (vectors, queries))
    asked = asked.dropDuplicates()
    sizes = [t.agg(F.count("*").alias("n"), F.max(F.size("embedding")).alias("dims")).first() for t in (rows, asked)]
    dims = max((s.dims or 1) for s in sizes)
    blocks = max(1, -(-sizes[0].n // ROWS), min(spark.sparkContext.defaultParallelism, sizes[0].n // LEAST_ROWS))
    index = cut(rows.repartition(blocks).mapInArrow(_blocks(dims, scale), "block int, ids binary, bits binary, slices binary"), "index")
    groups = cut(asked.mapInArrow(_groups(dims, scale), "ids binary, vectors binary"), "queries")
    rows = index.select("block", F.lit(0).alias("place"), "ids", "bits", F.col("slices").alias("payload"))
    sent = groups.select(F.explode(F.sequence(F.lit(0), F.lit(blocks - 1))).alias("block"), F.lit(1).alias("place"), "ids", F.lit(None).cast("binary").alias("bits"), F.col("vectors").alias("payload"))
    met = rows.unionByName(sent).repartition(2 * blocks, "block").sortWithinPartitions("block", "place").select("block", "ids", "bits", "payload")
    found = met.mapInArrow(lean(_search(k)), "query_id long, vec_id long, score long")
    # Spark keeps k rows a query in each task before it exchanges them.
    order = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    return found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")
