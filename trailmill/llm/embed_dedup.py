"""Near-duplicate embeddings by iterative quantisation and multi-index Hamming tables.

Unit vectors are centred, projected on principal axes and rotated by a learned rotation
that brings them close to the corners of a cube (iterative quantisation), so that signs
make balanced binary codes of 64 bits.  A code is cut into chunks, and there is one Hamming
table for every pair of chunks: codes that agree on any two chunks meet in a bucket.  Keys
grow with the logarithm of the number of rows, so that buckets stay small at any size; as
many codes, each with a rotation of its own, are used as the recall asked for needs at the
threshold (`Tables`).

Tables hold ids and codes only.  In its bucket a pair that meets there first is compared by
Hamming distance over all codes; rows with a partner within a bound that near-duplicates
practically never exceed then get their vectors, and the pairs of these are reranked in
double precision.  Equal vectors are represented by the smallest id among them.  Buckets
are cut into tiles of bounded size, and a tile returns rows, link counts and a spanning
forest, never its pairs.  Rotations are fitted on about `SAMPLE` vectors; every row is
indexed.
"""

from __future__ import annotations

import math
from dataclasses import dataclass
from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from trailmill.llm.components import connected_components
from trailmill.llm.textkeys import lean
from trailmill.llm.topk_search import usable
from trailmill.session import cut, discard

SAMPLE = 20_000
ROUNDS = 50
BITS = 64
#: Expected share of the pairs at the threshold that meet in a table.
RECALL = 0.95
#: Rows that a bucket holds, about, and the least bits of a key.
BUCKET, LEAST_KEY = 16, 12
#: Standard deviations above the expected Hamming distance at the threshold that are let through.
SLACK = 6
#: Rows of one bucket block; a tile holds two.
TILE = 1024
#: Groups up to this size are compared together, many groups at once.
SMALL = 48


@dataclass(frozen=True)
class Tables:
    """How codes are cut: bits of a chunk, chunks of a code, codes with tables, codes in all, and the Hamming bound."""

    width: int
    chunks: int
    keyed: int
    codes: int
    bound: int

    @classmethod
    def for_rows(cls, rows: int, threshold: float) -> "Tables":
        width = max(LEAST_KEY, math.ceil(math.log2(max(rows, 2) / BUCKET))) + 1 >> 1
        chunks = BITS // width
        flip = math.acos(max(-1.0, min(1.0, threshold))) / math.pi
        agree = (1 - flip) ** width
        missed = (1 - agree) ** chunks + chunks * agree * (1 - agree) ** (chunks - 1)
        keyed = max(1, math.ceil(math.log(1 - RECALL) / math.log(missed)))
        codes = max(2, keyed)
        mean = BITS * codes * flip
        return cls(width, chunks, keyed, codes, math.ceil(mean + SLACK * math.sqrt(mean * (1 - flip))))

    @property
    def pairs(self) -> list[tuple[int, int]]:
        return list(combinations(range(self.chunks), 2))

    def first(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """The first table in which codes a[k] and b[k] (rows of words) meet, or -1."""
        place = np.full(1 << self.chunks, -1, np.int64)  # by the set of agreeing chunks
        sets = np.arange(1 << self.chunks)
        for t, (x, y) in reversed(list(enumerate(self.pairs))):
            place[(sets >> x & 1 & (sets >> y)) == 1] = t
        out = np.full(len(a), -1, np.int64)
        mask = np.uint64((1 << self.width) - 1)
        for r in reversed(range(self.keyed)):
            differ, agree = a[:, r] ^ b[:, r], np.zeros(len(a), np.int64)
            for k in range(self.chunks):
                agree |= ((differ >> np.uint64(self.width * k) & mask) == 0).astype(np.int64) << k
            out = np.where(place[agree] >= 0, place[agree] + r * len(self.pairs), out)
        return out

    def keys(self) -> str:
        """SQL of an array of (table, key) of the column `codes`."""
        chunk = lambda r, k: f"(shiftrightunsigned(codes[{r}], {self.width * k}) & {(1 << self.width) - 1}L)"
        each = ((r, t, x, y) for r in range(self.keyed) for t, (x, y) in enumerate(self.pairs))
        return ", ".join(f"named_struct('table', {r * len(self.pairs) + t}, 'key', {chunk(r, x)} * {1 << self.width}L + {chunk(r, y)})" for r, t, x, y in each)


def unit_rows(vectors: np.ndarray) -> np.ndarray:
    """Rows over their norms; first over their largest component, as squares of very small or large ones are 0 or infinite."""
    vectors = vectors / np.abs(vectors).max(axis=1, keepdims=True)
    return vectors / np.linalg.norm(vectors, axis=1, keepdims=True)


def fit_rotation(sample: np.ndarray, seed: int = 0) -> tuple[np.ndarray, np.ndarray]:
    """(mean, projection to code space) of unit vectors; codes are the signs of (x - mean) @ projection.

    Vectors with fewer attributes than bits are first spread over `BITS` axes by a fixed
    random map with orthonormal rows.
    """
    rng = np.random.default_rng(seed)
    mean = sample.mean(0)
    centred = sample - mean
    dims = sample.shape[1]
    if dims >= BITS:
        _, axes = np.linalg.eigh(centred.T @ centred)
        axes = axes[:, ::-1][:, :BITS]
    else:
        axes = np.linalg.qr(rng.standard_normal((BITS, dims)))[0].T
    flat = centred @ axes
    rotation = np.linalg.qr(rng.standard_normal((BITS, BITS)))[0]
    for _ in range(ROUNDS):
        corners = np.sign(flat @ rotation)
        u, _, vt = np.linalg.svd(flat.T @ corners)
        rotation = u @ vt
    return mean, axes @ rotation


def binary_codes(vectors: np.ndarray, mean: np.ndarray, projection: np.ndarray) -> np.ndarray:
    signs = ((vectors - mean) @ projection) > 0
    return np.packbits(signs, axis=1, bitorder="little").view(np.uint64)[:, 0]


def _matrix(column: pa.Array, kind=np.float64) -> np.ndarray:
    n = len(column)
    return column.flatten().to_numpy(zero_copy_only=False).astype(kind).reshape(n, -1) if n else np.zeros((0, 1), kind)


def _encode(fitted):
    def run(batches):
        for batch in batches:
            unit = unit_rows(_matrix(batch.column("embedding"))) if batch.num_rows else np.zeros((0, 1))
            codes = np.stack([binary_codes(unit, *f) for f in fitted.value], 1) if batch.num_rows else np.zeros((0, len(fitted.value)), np.uint64)
            ends = np.arange(len(codes) + 1, dtype=np.int32) * codes.shape[1]
            lists = pa.ListArray.from_arrays(pa.array(ends), pa.array(codes.view(np.int64).ravel()))
            yield pa.RecordBatch.from_arrays([batch.column("rep"), lists], names=["rep", "codes"])

    return run


def _small_pairs(starts: np.ndarray, sizes: np.ndarray):
    """Index pairs within each of many small groups of rows."""
    for size in np.unique(sizes):
        a, b = np.triu_indices(size, 1)
        at = starts[sizes == size]
        for part in np.array_split(at, max(1, len(at) * len(a) // 100_000)):
            yield (part[:, None] + a).ravel(), (part[:, None] + b).ravel()


def near_pairs(codes: np.ndarray, tables: np.ndarray, groups, cut: Tables, near, near_blocks):
    """(a, b) of all pairs of a group that `near` holds of, each in its first table only.

    `groups` are starts, ends and splits: where splits[g] > 0, group g is a tile of two
    blocks and only pairs across the split count.
    """
    starts, ends, splits = groups
    sizes = ends - starts
    small = (sizes <= SMALL) & (splits == 0)
    found = []
    for a, b in _small_pairs(starts[small & (sizes > 1)], sizes[small & (sizes > 1)]):
        good = near(a, b)
        found.append((a[good], b[good]))
    for g in np.flatnonzero(~small):
        x, y = starts[g], ends[g]
        left = slice(x, x + splits[g]) if splits[g] else slice(x, y)
        right = slice(x + splits[g], y)
        a, b = np.nonzero(near_blocks(left, right))
        a, b = a + left.start, b + right.start
        if not splits[g]:
            a, b = a[a < b], b[a < b]
        found.append((a, b))
    a = np.concatenate([x for x, _ in found]) if found else np.zeros(0, np.int64)
    b = np.concatenate([x for _, x in found]) if found else np.zeros(0, np.int64)
    mine = cut.first(codes[a], codes[b]) == tables[a]
    return a[mine], b[mine]


PLACE = ("table", "key", "i", "j")


def _groups(columns: dict[str, np.ndarray]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Starts, ends and splits of the tiles of rows that come sorted by tile and side."""
    n = len(columns["side"])
    same = np.ones(max(n - 1, 0), bool)
    for c in PLACE:
        same &= columns[c][1:] == columns[c][:-1]
    starts = np.flatnonzero(np.concatenate([[True], ~same])) if n else np.zeros(0, np.int64)
    ends = np.append(starts[1:], n)
    firsts = np.concatenate([[0], np.cumsum(columns["side"] == 0)])
    across = columns["i"][starts] != columns["j"][starts]
    splits = np.where(across, firsts[ends] - firsts[starts], 0)
    alone = across & ((splits == 0) | (splits == ends - starts))
    return starts[~alone], ends[~alone], splits[~alone]


def _by_tile(handle):
    """Run `handle` on whole tiles of rows that come sorted by tile, however batches cut them."""

    def run(batches):
        kept: list[pa.RecordBatch] = []
        for batch in batches:
            if batch.num_rows == 0:
                continue
            place = [batch.column(c).to_numpy() for c in PLACE]
            same = np.ones(batch.num_rows, bool)
            for c in place:
                same &= c == c[-1]
            start = batch.num_rows - int(np.argmin(same[::-1])) if not same.all() else 0
            if start:
                yield handle(pa.Table.from_batches([*kept, batch.slice(0, start)]).combine_chunks())
                kept = []
            kept.append(batch.slice(start))
        if kept:
            yield handle(pa.Table.from_batches(kept).combine_chunks())

    return run


def _columns(table: pa.Table, names) -> dict[str, np.ndarray]:
    return {c: table[c].to_numpy() for c in names}


def _chunk(column: pa.ChunkedArray) -> pa.Array:
    return column.chunk(0) if column.num_chunks == 1 else pa.concat_arrays(column.chunks)


def _likely(cut: Tables):
    """Rows of a tile that have a partner within the Hamming bound that they meet here first."""

    def handle(table: pa.Table):
        columns = _columns(table, PLACE + ("side",))
        codes = _matrix(_chunk(table["codes"]), np.int64).view(np.uint64)
        near = lambda a, b: np.bitwise_count(codes[a] ^ codes[b]).sum(1) <= cut.bound
        blocks = lambda x, y: sum(np.bitwise_count(codes[x, r][:, None] ^ codes[y, r][None, :]).astype(np.int16) for r in range(cut.codes)) <= cut.bound
        a, b = near_pairs(codes, columns["table"], _groups(columns), cut, near, blocks)
        some = np.unique(np.concatenate([a, b]))
        columns["rep"] = table["rep"].to_numpy()
        return pa.RecordBatch.from_arrays([pa.array(columns[c][some]) for c in (*PLACE, "side", "rep")], names=[*PLACE, "side", "rep"])

    return _by_tile(handle)


def _links_of_tiles(cut: Tables, threshold: float):
    """Link counts and a spanning forest of the pairs of a tile with cosine >= threshold."""

    def handle(table: pa.Table):
        columns = _columns(table, PLACE + ("side", "rep", "copies"))
        codes = _matrix(_chunk(table["codes"]), np.int64).view(np.uint64)
        vectors = unit_rows(_matrix(_chunk(table["embedding"])))
        near = lambda a, b: np.einsum("ij,ij->i", vectors[a], vectors[b]) >= threshold
        a, b = near_pairs(codes, columns["table"], _groups(columns), cut, near, lambda x, y: vectors[x] @ vectors[y].T >= threshold)
        rep, inverse = np.unique(columns["rep"], return_inverse=True)
        a, b, wa, wb = inverse[a], inverse[b], columns["copies"][a], columns["copies"][b]
        links = np.bincount(a, wb, len(rep)) + np.bincount(b, wa, len(rep))
        root = np.arange(len(rep))
        while len(a):
            before = root.copy()
            low = np.minimum(root[a], root[b])
            np.minimum.at(root, a, low)
            np.minimum.at(root, b, low)
            if (before == root).all():
                break
        some = links > 0
        return pa.RecordBatch.from_arrays([pa.array(rep[some]), pa.array(links[some].astype(np.int64)), pa.array(rep[root[some]])], names=["rep", "links", "low"])

    return _by_tile(handle)


def _links(classes: DataFrame, threshold: float, seed: int) -> DataFrame:
    """rep, links, low from vectors of one length."""
    spark = classes.sparkSession
    n = classes.count()
    share = min(1.0, SAMPLE / max(n, 1))
    place = F.shiftrightunsigned(F.xxhash64("rep"), 11) / float(1 << 53)
    sample = classes.where(place < share).select("embedding").toPandas()["embedding"]
    if len(sample) == 0:
        sample = classes.limit(1).toPandas()["embedding"]
    unit = unit_rows(np.stack(sample.to_list()).astype(np.float64))
    plan = Tables.for_rows(n, threshold)
    fitted = spark.sparkContext.broadcast([fit_rotation(unit, seed + r) for r in range(plan.codes)])
    coded = cut(classes.select("rep", "embedding").mapInArrow(lean(_encode(fitted)), "rep long, codes array<long>"), "codes")
    postings = coded.select("rep", "codes", F.explode(F.expr(f"array({plan.keys()})")).alias("at")).select("at.*", "rep", "codes")
    large = postings.groupBy("table", "key").agg(F.count("*").alias("n")).where(F.col("n") > TILE)
    large = cut(large.select("table", "key", F.ceil(F.col("n") / TILE).cast("int").alias("blocks")), "buckets")
    postings = postings.join(large, ["table", "key"], "left").withColumn("blocks", F.coalesce("blocks", F.lit(1))).withColumn("block", F.pmod(F.hash("rep"), F.col("blocks")))
    tiles = postings.select(
        "table", "key", "block", "rep", "codes",
        F.explode(F.expr("transform(sequence(0, blocks - 1), k -> named_struct('i', least(block, k), 'j', greatest(block, k)))")).alias("tile"),
    ).select("table", "key", "tile.i", "tile.j", F.when(F.col("block") == F.col("tile.i"), 0).otherwise(1).alias("side"), "rep", "codes")
    tiles = tiles.repartition("table", "key", "i", "j").sortWithinPartitions("table", "key", "i", "j", "side")
    likely = cut(tiles.mapInArrow(lean(_likely(plan)), "table int, key long, i int, j int, side int, rep long"), "likely")
    whole = likely.join(classes.select("rep", "copies", "embedding"), "rep").join(coded, "rep")
    whole = whole.repartition("table", "key", "i", "j").sortWithinPartitions("table", "key", "i", "j", "side")
    out = cut(whole.mapInArrow(lean(_links_of_tiles(plan, threshold)), "rep long, links long, low long"), "linked")
    for table in (coded, large, likely):
        discard(table)
    return out


def embedding_components(vectors: DataFrame, threshold: float = 0.95, seed: int = 0) -> DataFrame:
    """vec_id, n_links, component_id, kept for every row of `vectors` (vec_id, embedding).

    Vectors that are null, zero, empty or hold null or non-finite components link with
    nothing, nor do vectors of different lengths.  Rows that repeat a vector link with each
    other; a null vec_id links with nothing and has a null component and kept = false.
    """
    fine = usable() & F.exists("embedding", lambda v: v != 0) & F.col("vec_id").isNotNull()
    base = vectors.select(F.col("vec_id").cast("long").alias("vec_id"), F.col("embedding").cast("array<double>").alias("embedding"))
    base = base.withColumn("fine", F.coalesce(fine, F.lit(False)))
    base = base.withColumns({"key1": F.xxhash64("embedding"), "key2": F.xxhash64(F.lit(7), "embedding")})
    good = base.where("fine")
    classes = cut(good.groupBy("key1", "key2").agg(F.min("vec_id").alias("rep"), F.count("*").alias("copies"), F.first("embedding").alias("embedding")), "classes")
    sizes = sorted(r[0] for r in classes.select(F.size("embedding")).distinct().collect())
    spark = vectors.sparkSession
    linked = spark.createDataFrame([], "rep long, links long, low long")
    for size in sizes:
        linked = linked.unionByName(_links(classes.where(F.size("embedding") == size), threshold, seed))
    links = linked.groupBy("rep").agg(F.sum("links").alias("links"))
    found = connected_components(linked.select(F.col("rep").alias("src"), F.col("low").alias("dst"))).select(F.col("id").alias("rep"), "component")
    classes = classes.drop("embedding").join(links, "rep", "left").join(found, "rep", "left").withColumn("fine", F.lit(True))
    out = base.select("vec_id", "fine", "key1", "key2").join(classes, ["fine", "key1", "key2"], "left")
    component = F.when(F.col("vec_id").isNotNull(), F.coalesce("component", "rep", "vec_id"))
    return out.select(
        "vec_id", (F.coalesce("links", F.lit(0)) + F.coalesce(F.col("copies") - 1, F.lit(0))).alias("n_links"), component.alias("component_id"),
        F.coalesce(F.col("vec_id") == component, F.lit(False)).alias("kept"),
    )
