"""N-gram Jaccard join with adaptive multi-match prefixes.

Every document becomes its set of distinct word shingles, rare ones first in one global
order.  Of two sets of Jaccard similarity t, the prefixes of ``p + m - 1`` shingles, with
``p = n - ceil(t n) + 1``, share at least m.  Each document lengthens its own prefix: it
picks an m from p on (below one half, from ceil(t n) on), at which reading the longer prefix and verifying what then remains
is estimated to cost least from the counts of its shingles.  A pair must share the
smaller m of the two before it is verified.

So a pair shares G = p(smaller n) shingles at least, whatever the two chose (below one
half, ceil(t n) where that is less).  Each document can therefore leave the ``G(ceil(t n)) - 1`` shingles of its prefix that most
documents index out of the index: of G shared ones, the rarest is left out by neither.

1. *profile*: one pass over the texts gives each document's set size and set key, and a
   fixed-size table of shingle counts over all documents (order and cost estimates);
2. documents with equal sets are one node, named by the set's 64-bit key and not by a
   doc_id, which rows may repeat; the row with the smallest id gives its text;
3. *postings*: one exchange by shingle of the adaptive prefixes.  Shingles that the count
   table knows as common are salted, so no list of postings is one task's;
4. *rounds*: each component offers the best of the pivots of its shingles (the node of
   smallest hash under each), is verified with it, and joined; a shingle whose nodes are
   all of one component is done with.  Rounds go on while they join components, so that
   a large group of near copies is joined in linear work;
5. *rest*: nodes of different components that share an indexed shingle.  A node's home is
   the most common shingle it has; nodes of one home are dealt into blocks of bounded
   size, and two blocks with a shingle in common are a tile, which counts what prefixes
   share, verifies the survivors by their whole sets, and returns a spanning forest of
   their links.  So no pair of documents is ever a row;
6. components of the links, carried back to the documents, each by its own set.

Links between nodes that are connected already change nothing, so leaving them out loses
nothing.  Nulls and texts without words have empty sets and link with nothing.
"""

from __future__ import annotations

import itertools
import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from trailmill.llm.components import FILE_ROWS, connected_components
from trailmill.llm.textkeys import U, lean, mix, shingles, slices
from trailmill.session import bounded_batches, cut, discard, release

#: Count table: a fixed number of buckets, so its size does not depend on the data.
BUCKET_BITS = 22
CHUNK_BITS = 16
#: Largest m, and the cost of verifying one candidate against reading one posting.
MOST_MATCHES = 8
VERIFY_COST = 16.0
#: Sets of one home that meet others in a task, and their shingles, about.
BLOCK, BLOCK_SHINGLES = 256, 250_000
#: Postings of one shingle that one task holds, about.
LIST = 8192
#: Files of a table of ids, beside one for each `FILE_ROWS` sets.
FEW = 64
#: Rounds of pivots go on while one candidate in so many is verified.
WORTH = 4
#: Sets that more than one row in so many has are reduced to one row before the join.
HOT_SETS = 10_000
MEMBER_BITS = 24


def _set_keys(keys: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Two order-free 64-bit keys of each row's set."""
    sums = []
    for salt in (U(0x1F123BB5159A55E5), U(0xC2B2AE3D27D4EB4F)):
        run = np.zeros(len(keys) + 1, U)
        np.cumsum(mix(keys ^ salt), out=run[1:])
        sums.append((run[at[1:]] - run[at[:-1]]).view(np.int64))
    return sums[0], sums[1]


def _profile(width: int):
    def run(batches):
        counts = np.zeros(1 << BUCKET_BITS, np.uint32)
        seen = False
        for batch in batches:
            column = batch.column("text")
            for a, b in slices(column):
                keys, at = shingles(column.slice(a, b - a), width)
                one, two = _set_keys(keys, at)
                np.add.at(counts, (keys >> U(64 - BUCKET_BITS)).astype(np.int64), np.uint32(1))
                seen = True
                n = b - a
                yield pa.RecordBatch.from_arrays(
                    [batch.column("doc_id").slice(a, n), batch.column("text_key").slice(a, n), pa.array(np.diff(at), pa.int64()), pa.array(one), pa.array(two), pa.nulls(n, pa.int32()), pa.nulls(n, pa.binary())],
                    names=["doc_id", "text_key", "n", "key1", "key2", "chunk", "counts"],
                )
        if seen:
            size = 1 << CHUNK_BITS
            packed = [zlib.compress(counts[k : k + size].tobytes(), 1) for k in range(0, len(counts), size)]
            n = len(packed)
            yield pa.RecordBatch.from_arrays(
                [*(pa.nulls(n, pa.int64()) for _ in range(5)), pa.array(range(n), pa.int32()), pa.array(packed, pa.binary())],
                names=["doc_id", "text_key", "n", "key1", "key2", "chunk", "counts"],
            )

    return run


def _add_counts(batches):
    total: dict[int, np.ndarray] = {}
    for batch in batches:
        for chunk, packed in zip(batch.column("chunk").to_pylist(), batch.column("counts").to_pylist()):
            part = np.frombuffer(zlib.decompress(packed), np.uint32).astype(np.uint64)
            total[chunk] = total[chunk] + part if chunk in total else part
    for chunk, counts in total.items():
        # Order codes: eight steps to the doubling are all that ordering and costs need.
        code = np.minimum(np.round(8 * np.log2(counts + 1.0)), 255).astype(np.uint8)
        yield pa.RecordBatch.from_arrays([pa.array([chunk], pa.int32()), pa.array([code.tobytes()], pa.binary())], names=["chunk", "code"])


def count_codes(profile: DataFrame) -> np.ndarray:
    """The merged count table: 2^22 one-byte codes, whatever the size of the corpus."""
    parts = profile.where("chunk is not null").select("chunk", "counts")
    rows = parts.repartition(1 << (BUCKET_BITS - CHUNK_BITS), "chunk").mapInArrow(_add_counts, "chunk int, code binary").collect()
    codes = np.zeros(1 << BUCKET_BITS, np.uint8)
    for row in rows:
        codes[row.chunk << CHUNK_BITS : (row.chunk + 1) << CHUNK_BITS] = np.frombuffer(row.code, np.uint8)
    return codes


def ordered(keys: np.ndarray, at: np.ndarray, codes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Each row's shingles with the rare ones first, and their estimated counts."""
    code = codes[(keys >> U(64 - BUCKET_BITS)).astype(np.int64)]
    row = np.repeat(np.arange(len(at) - 1), np.diff(at))
    order = np.lexsort(((code.astype(U) << U(56)) | (keys >> U(8)), row))
    return keys[order], np.exp2(code[order] / 8.0) - 1


def prefix_lengths(n: np.ndarray, percent: int) -> np.ndarray:
    return np.where(n > 0, n + (-percent * n) // 100 + 1, 0)


def left_out(n: np.ndarray, percent: int) -> np.ndarray:
    """How many of a prefix's most-indexed shingles the index can do without."""
    return np.maximum(fewest_matches(-(-percent * n // 100), percent) - 1, 0)


def fewest_matches(n: np.ndarray, percent: int) -> np.ndarray:
    """The least m of a set: p, or below one half what the whole set must share."""
    return np.minimum(prefix_lengths(n, percent), -(-percent * n // 100))


def choose_matches(counts: np.ndarray, at: np.ndarray, percent: int) -> np.ndarray:
    """m of each row: the cheapest, from the least on, of reading a longer prefix and verifying fewer pairs.

    Reading costs the sum of the counts under the prefix, and at most that sum / m
    candidates can share m of its shingles.
    """
    n = np.diff(at)
    base = prefix_lengths(n, percent)
    run = np.concatenate([[0.0], np.cumsum(counts)])
    least = np.maximum(fewest_matches(n, percent), 1)
    best, cheapest = least.copy(), np.full(len(n), np.inf)
    for more in range(MOST_MATCHES + 1):
        m = least + more
        end = np.minimum(base + m - 1, n)
        read = run[at[:-1] + end] - run[at[:-1]]
        cost = np.where((more == 0) | (base + m - 1 <= n), read + VERIFY_COST * read / m, np.inf)
        better = cost < cheapest
        best[better], cheapest[better] = m[better], cost[better]
    return best


def _prefixes(codes, copies, width: int, percent: int):
    """(shingle, node, n, whole, salt) of every document's own prefix, but for repeats of a very common set.

    whole is the prefix's length, and salt -1, or for shingles of more than `LIST` postings a share of them.
    """

    def run(batches):
        hot = copies.value
        hot_keys = np.array(sorted({k for k, _, _ in hot}), np.int64)
        for batch in batches:
            column, ids = batch.column("text"), batch.column("doc_id").to_numpy(zero_copy_only=False)
            for a, b in slices(column):
                keys, at = shingles(column.slice(a, b - a), width)
                n = np.diff(at)
                one, two = _set_keys(keys, at)
                drop = np.isin(one, hot_keys)
                for k in np.flatnonzero(drop):
                    drop[k] = hot.get((int(one[k]), int(two[k]), int(n[k])), ids[a + k]) != ids[a + k]
                keys, counts = ordered(keys, at, codes.value)
                need = choose_matches(counts, at, percent)
                row = np.repeat(np.arange(len(n)), n)
                whole = np.minimum(prefix_lengths(n, percent) + need - 1, n)
                first = (np.arange(len(keys)) - at[:-1][row] < whole[row]) & ~drop[row]
                keys, row = keys[first], row[first]
                parts = np.ceil(counts[first] / LIST).astype(np.int64)
                salt = np.where(parts > 1, (one[row].view(U) >> U(8)).astype(np.int64) % np.maximum(parts, 1), -1)
                yield pa.RecordBatch.from_arrays(
                    [pa.array(keys.view(np.int64)), pa.array(one[row]), *(pa.array(x.astype(np.int32)) for x in (n[row], whole[row], salt))],
                    names=["shingle", "node", "n", "whole", "salt"],
                )

    return run


def _members(words):
    """Rows that may be among the members', each once per task; `at` is the hash of id and text."""

    def run(batches):
        bits, seen = words.value, set()
        for batch in batches:
            at = batch.column("at").to_numpy().view(U)
            hit = np.ones(len(at), bool)
            for shift in (0, MEMBER_BITS):
                place = (at >> U(shift)) & U((1 << MEMBER_BITS) - 1)
                hit &= (bits[(place >> U(6)).astype(np.int64)] >> (place & U(63)) & U(1)).astype(bool)
            for k in np.flatnonzero(hit).tolist():
                hit[k] = at[k] not in seen
                seen.add(at[k])
            yield batch.filter(pa.array(hit)).select(["doc_id", "text_key", "text"])

    return run


def member_filter(rows: DataFrame) -> np.ndarray:
    """A Bloom filter of the rows' ids and text keys, of 2^MEMBER_BITS bits at any size of the data.

    It only spares the shuffle texts that are in no family; what it lets through by mistake
    the join drops.
    """
    at = F.xxhash64("doc_id", "text_key")
    places = [F.shiftrightunsigned(at, shift).bitwiseAND(F.lit((1 << MEMBER_BITS) - 1)) for shift in (0, MEMBER_BITS)]
    rows = rows.select(F.explode(F.array(*places)).alias("place")).groupBy(F.shiftrightunsigned("place", 6).alias("word"))
    found = rows.agg(F.bit_or(F.expr("shiftleft(1L, cast(place & 63 as int))")).alias("bits")).toPandas()
    words = np.zeros(1 << (MEMBER_BITS - 6), U)
    words[found["word"].to_numpy(np.int64)] = found["bits"].to_numpy(np.int64).view(U)
    return words


def _sets(codes, width: int, percent: int):
    """node, need (m) and shingles, rare ones first, of texts."""

    def run(batches):
        for batch in batches:
            column = batch.column("text")
            for a, b in slices(column):
                keys, at = shingles(column.slice(a, b - a), width)
                keys, counts = ordered(keys, at, codes.value)
                need = choose_matches(counts, at, percent)
                packed = pa.array([keys[x:y].tobytes() for x, y in zip(at[:-1], at[1:])], pa.binary())
                yield pa.RecordBatch.from_arrays([batch.column("node").slice(a, b - a), pa.array(need, pa.int32()), packed], names=["node", "need", "shingles"])

    return run


def shared_postings(postings: DataFrame, percent: int) -> DataFrame:
    """shingle, node, n of the indexed shingles that several nodes have.

    Equal sets are one posting.  Salted lists are counted share by share first.  Of each
    prefix the shingles that most nodes index are left out, as many as is safe.
    """
    part = Window.partitionBy("shingle", "salt")
    one = postings.withColumn("last", F.lag("node").over(part.orderBy("node"))).where("last is null or last <> node").drop("last")
    one = cut(one.withColumn("df", F.count("*").over(part)).where("df > 1 or salt >= 0"), "postings")
    salted = one.where("salt >= 0")
    common = salted.drop("df").join(salted.groupBy("shingle").agg(F.count("*").alias("df")).where("df > 1"), "shingle")
    columns = ("shingle", "node", "n", "whole", "df")
    rows = one.where("salt < 0").select(*columns).unionByName(common.select(*columns))
    # Those that a node has alone come before all of these.
    each = Window.partitionBy("node", "n")
    rank = F.row_number().over(each.orderBy("df", "shingle")) + F.col("whole") - F.count("*").over(each)
    small = F.expr(f"({percent} * cast(n as long) + 99) div 100")
    both = F.expr(f"({percent} * ({percent} * cast(n as long) + 99) div 100 + 99) div 100")
    # Below one half, sets of the smallest size that links must share `needed`, less than their p.
    needed = F.expr(f"({percent} * (({percent} * cast(n as long) + 99) div 100) + 99) div 100")
    left = F.greatest(F.least(small - both, needed - 1), F.lit(0))
    shared = cut(rows.withColumn("rank", rank).where(F.col("rank") <= F.col("whole") - left).select("shingle", "node", "n"), "shared")
    discard(one)
    return shared


def with_pivots(rows: DataFrame, salt: int = 0) -> DataFrame:
    """Rows of shingles with several components, with `pivot`, the shingle's node of smallest hash."""
    place = F.struct(F.xxhash64(F.lit(salt), "node").alias("place"), "node", "n", "comp")
    lists = rows.groupBy("shingle").agg(F.min("comp").alias("low"), F.max("comp").alias("high"), F.min(place).alias("pivot"))
    return rows.join(lists.where("low <> high").select("shingle", "pivot"), "shingle")


def _alike_in_size(a: str, b: str, percent: int) -> F.Column:
    return 100 * F.least(F.col(a), F.col(b)).cast("long") >= percent * F.greatest(F.col(a), F.col(b)).cast("long")


def offers(active: DataFrame, percent: int) -> DataFrame:
    """comp, node, other: of each component's nodes and their pivots, the two that share most indexed shingles."""
    near = active.where("comp <> pivot.comp").where(_alike_in_size("n", "pivot.n", percent))
    both = near.groupBy("comp", "node", F.col("pivot.node").alias("other"), F.col("pivot.comp").alias("other_comp")).agg(F.count("*").alias("both"))
    best = both.groupBy("comp").agg(F.max_by(F.struct("node", "other", "other_comp"), "both").alias("best"))
    return best.select("comp", "best.*")


def relabelled(active: DataFrame, found: DataFrame, salt: int) -> DataFrame:
    """`active` with new components and pivots, without the shingles of one component."""
    rows = active.drop("comp", "pivot").join(found.select(F.col("id").alias("node"), "component"), "node", "left")
    return with_pivots(rows.select("shingle", F.coalesce("component", "node").alias("comp"), "node", "n"), salt)


def placed(homes: DataFrame, nodes: DataFrame, files: int) -> DataFrame:
    """node, comp, block, doc_id, text_key: the nodes of each home (node, home, comp) dealt into blocks of bounded size."""
    members = nodes.join(homes, "node")
    sizes = members.groupBy("home").agg(F.greatest(F.ceil(F.count("*") / F.lit(BLOCK)), F.ceil(F.sum("n") / F.lit(BLOCK_SHINGLES))).alias("blocks"))
    block = F.xxhash64("home", F.pmod(F.hash("node"), "blocks"))
    return cut(members.join(sizes, "home").select("node", "comp", block.alias("block"), "doc_id", "text_key").coalesce(files), "members")


def tiles_of_rest(active: DataFrame, members: DataFrame) -> DataFrame:
    """i, j: blocks that have an indexed shingle in common (also with itself, for nodes of different components)."""
    lists = active.select("shingle", "node").join(members.select("node", "block", "comp"), "node")
    lists = lists.groupBy("shingle", "block").agg(F.min("comp").alias("low"), F.max("comp").alias("high"))
    own = lists.where("low <> high").select(F.col("block").alias("i"), F.col("block").alias("j"))
    other = lists.select("shingle", F.col("block").alias("j"), F.col("low").alias("o_low"), F.col("high").alias("o_high"))
    across = lists.join(other, "shingle").where("block < j and not (low = high and o_low = o_high and low = o_low)").select(F.col("block").alias("i"), "j")
    return own.unionByName(across).distinct()


def _shared(sets: list[np.ndarray], left: int) -> np.ndarray:
    """Sizes of the intersections of the first `left` sets with all sets."""
    _, code = np.unique(np.concatenate(sets), return_inverse=True)
    often = np.bincount(code) > 1
    column = np.cumsum(often) - 1
    row = np.repeat(np.arange(len(sets)), [len(s) for s in sets])
    use = often[code]
    code, row = column[code[use]], row[use]
    out = np.zeros((left, len(sets)), np.float32)
    order = np.argsort(code, kind="stable")
    code, row = code[order], row[order]
    step = 4096
    for start in range(0, int(often.sum()), step):
        a, b = np.searchsorted(code, [start, start + step])
        block = np.zeros((len(sets), step), np.float32)
        block[row[a:b], code[a:b] - start] = 1
        out += block[:left] @ block.T
    return out.astype(np.int64)


def link_tile(ids: np.ndarray, comps: np.ndarray, sets: list[np.ndarray], need: np.ndarray, left: int, percent: int) -> list[tuple[int, int]]:
    """Verified links between the first `left` sets and all, as a spanning forest.

    Sets come rare shingles first.  Where left < len(ids), only pairs of the first `left`
    with the others are looked at, as the others' own pairs are another task's; pairs of
    one component are passed over.
    """
    n = np.array([len(s) for s in sets])
    base = prefix_lengths(n, percent)
    shared = _shared([s[: b + m - 1] for s, b, m in zip(sets, base, need)], left)
    candidate = shared >= np.minimum(need[:left, None], need[None, :])
    candidate &= 100 * np.minimum(n[:left, None], n[None, :]) >= percent * np.maximum(n[:left, None], n[None, :])
    candidate &= comps[:left, None] != comps[None, :]
    if left < len(ids):
        candidate[:, :left] = False
    else:
        candidate &= np.tri(left, k=-1, dtype=bool)
    a, b = np.nonzero(candidate)
    if len(a) > 4 * len(ids):
        both = _shared(sets, left)[a, b]
    else:
        both = np.array([len(np.intersect1d(sets[i], sets[j], assume_unique=True)) for i, j in zip(a, b)], np.int64)
    good = 100 * both >= percent * (n[a] + n[b] - both)
    a, b = a[good], b[good]
    root = np.arange(len(ids))
    while len(a):
        low = np.minimum(root[a], root[b])
        before = root.copy()
        np.minimum.at(root, a, low)
        np.minimum.at(root, b, low)
        if (before == root).all():
            break
    return [(int(ids[k]), int(ids[r])) for k, r in enumerate(root) if k != r]


def _tiles(percent: int):
    def flush(key, rows):
        i, j = key
        rows.sort(key=lambda r: (r[0] != i, r[1]))
        left = len(rows) if i == j else sum(r[0] == i for r in rows)
        if left == 0 or len(rows) < 2:
            return []
        ids, comps = (np.array([r[k] for r in rows]) for k in (1, 2))
        return link_tile(ids, comps, [np.frombuffer(r[4], U) for r in rows], np.array([r[3] for r in rows], np.int64), left, percent)

    def run(batches):
        key, rows, seen, out = None, [], set(), []
        for batch in batches:
            for i, j, block, node, comp, need, packed in zip(*(batch.column(c).to_pylist() for c in ("i", "j", "block", "node", "comp", "need", "shingles"))):
                if (i, j) != key:
                    if rows:
                        out += flush(key, rows)
                    key, rows, seen = (i, j), [], set()
                if node not in seen:  # a row repeated with its id gives its set again
                    seen.add(node)
                    rows.append((block, node, comp, need, packed))
            if out:
                yield pa.RecordBatch.from_arrays([pa.array([x for x, _ in out], pa.int64()), pa.array([y for _, y in out], pa.int64())], names=["src", "dst"])
                out = []
        if rows and (out := flush(key, rows)):
            yield pa.RecordBatch.from_arrays([pa.array([x for x, _ in out], pa.int64()), pa.array([y for _, y in out], pa.int64())], names=["src", "dst"])

    return run


def verified(members: DataFrame, tiles: DataFrame, docs: DataFrame, codes, width: int, percent: int, files: int) -> DataFrame:
    """src, dst: links that connect what the similar enough pairs of different components in the tiles connect."""
    wanted = tiles.select(F.col("i").alias("block")).unionByName(tiles.select(F.col("j").alias("block"))).distinct()
    members = cut(members.join(wanted, "block", "left_semi").coalesce(files), "wanted")
    likely = docs.sparkSession.sparkContext.broadcast(member_filter(members))
    texts = docs.where("doc_id is not null").withColumn("at", F.xxhash64("doc_id", "text_key"))
    texts = texts.mapInArrow(lean(_members(likely)), "doc_id long, text_key long, text string")
    # Merged, not broadcast: a task that filtered and cut texts at once would hold two workers, and a core keeps both.
    sets = texts.join(members.drop("comp", "block").hint("merge"), ["doc_id", "text_key"]).select("node", "text").mapInArrow(lean(_sets(codes, width, percent)), "node long, need int, shingles binary")
    sets = cut(sets, "sets")
    sides = tiles.select("i", "j", F.explode(F.array_distinct(F.array("i", "j"))).alias("block")).join(members.select("block", "node", "comp"), "block")
    dealt = sides.join(sets, "node").repartition("i", "j").sortWithinPartitions("i", "j")
    links = cut(dealt.select("i", "j", "block", "node", "comp", "need", "shingles").mapInArrow(lean(_tiles(percent)), "src long, dst long"), "verified")
    discard(sets)
    discard(members)
    return links


def jaccard_components(docs: DataFrame, width: int = 5, percent: int = 80) -> DataFrame:
    """``doc_id, n_shingles, component_id`` for every row of `docs` (doc_id long, text string).

    component_id is the smallest doc_id reachable over links of Jaccard similarity
    >= percent / 100 between sets of `width`-word shingles.  A null doc_id links with
    nothing and has a null component; rows that repeat a doc_id are each judged by their
    own text, so that one id can be in several components.  Other columns are ignored; an
    empty table gives an empty result.
    """
    return judged_rows(docs, width, percent).select("doc_id", F.col("n").alias("n_shingles"), "component_id")


def judged_rows(docs: DataFrame, width: int = 5, percent: int = 80) -> DataFrame:
    """The same with `text_key` (xxhash64 of the text) and `node`, the key of the component's first set.

    Two components that hold the same smallest doc_id, as that id has two texts, have the
    same component_id and differ in `node`.
    """
    spark = docs.sparkSession
    bounded_batches(spark)
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    docs = docs.withColumn("text_key", F.xxhash64("text"))
    profile = cut(docs.mapInArrow(lean(_profile(width)), "doc_id long, text_key long, n long, key1 long, key2 long, chunk int, counts binary"), "profile")
    base = profile.where("chunk is null").select("doc_id", "text_key", "n", "key1", "key2")
    codes = spark.sparkContext.broadcast(count_codes(profile))
    classes = cut(
        base.where("n > 0 and doc_id is not null")
        .groupBy("n", "key1", "key2")
        .agg(F.min(F.struct("doc_id", "text_key")).alias("rep"), F.count("*").alias("copies"))
        .select("n", "key1", "key2", F.col("rep.doc_id").alias("rep"), F.col("rep.text_key").alias("rep_key"), "copies"),
        "classes",
    )
    # Sets of over a ten-thousandth of all rows, of which there can be ten thousand at most.
    total, sets = classes.agg(F.coalesce(F.sum("copies"), F.lit(0)), F.count("*")).first()
    files = FEW + sets // FILE_ROWS
    common = classes.where((F.col("copies") > 8) & (F.col("copies") * HOT_SETS > total)).collect()
    copies = spark.sparkContext.broadcast({(r.key1, r.key2, r.n): r.rep for r in common})

    postings = docs.where("doc_id is not null").select("doc_id", "text").mapInArrow(lean(_prefixes(codes, copies, width, percent)), "shingle long, node long, n int, whole int, salt int")
    shared = shared_postings(postings, percent)
    release(spark)
    active = cut(with_pivots(shared.withColumn("comp", F.col("node"))), "active")
    discard(shared)
    nodes = classes.select(F.col("key1").alias("node"), "n", F.col("rep").alias("doc_id"), F.col("rep_key").alias("text_key"))
    # Rows of a Python list, even of none, would take Python workers of their own in every job.
    links = spark.range(0).select(F.col("id").alias("src"), F.col("id").alias("dst"))
    found = spark.range(0).select("id", F.col("id").alias("component"))
    for turn in itertools.count(1):
        made = cut(offers(active, percent).coalesce(files), "offers")
        offered = made.count()
        if not offered:
            break
        # Those that chose one pivot are a home, which the pivot itself is dealt to by its own choice.
        chosen = made.select("node", F.col("other").alias("home"), "comp")
        pivots = made.select(F.col("other").alias("node"), F.col("other").alias("home"), F.col("other_comp").alias("comp")).distinct().join(chosen.select("node"), "node", "left_anti")
        members = placed(chosen.unionByName(pivots), nodes, files)
        one, two = (members.select(F.col("node").alias(x), F.col("block").alias(y)) for x, y in (("node", "x"), ("other", "y")))
        blocks = made.join(one, "node").join(two, "other").select(F.least("x", "y").alias("i"), F.greatest("x", "y").alias("j"))
        tiles = cut(blocks.distinct().coalesce(files), "tiles")
        new = verified(members, tiles, docs, codes, width, percent, files)
        joined = new.count()
        for table in (made, members, tiles):
            discard(table)
        if not joined:
            break
        links = links.unionByName(new)
        found = connected_components(links)
        further = cut(relabelled(active, found, turn), "active")
        discard(active)
        active = further
        if joined * WORTH < offered:
            break
    sizes = active.groupBy("shingle").agg(F.count("*").alias("size"))
    homes = active.join(sizes, "shingle").groupBy("node", "comp").agg(F.max_by("shingle", F.struct("size", "shingle")).alias("home"))
    members = placed(homes, nodes, files)
    tiles = cut(tiles_of_rest(active, members), "tiles")
    if not tiles.isEmpty():
        links = links.unionByName(verified(members, tiles, docs, codes, width, percent, files))
        found = connected_components(links)
    for table in (members, tiles, active):
        discard(table)
    found = found.select(F.col("id").alias("node"), F.col("component").alias("first"))
    least = found.join(nodes, "node").groupBy("first").agg(F.min("doc_id").alias("least"))
    found = found.join(least, "first").withColumnRenamed("node", "key1")

    return (
        base.join(classes.select("n", "key1", "key2", "rep"), ["n", "key1", "key2"], "left")
        .join(found, "key1", "left")
        .select(
            "doc_id", "text_key", "n", F.coalesce("first", "key1").alias("node"),
            F.when(F.col("doc_id").isNotNull(), F.coalesce("least", "rep", "doc_id")).alias("component_id"),
        )
    )
