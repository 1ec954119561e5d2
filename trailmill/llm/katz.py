"""Bigram language model with Katz backoff, over all tokens of a corpus.

Counts are Good-Turing discounted: Turing's estimate for counts up to `KATZ_K`, and the
log-linear fit of the counts of counts beyond, so that every history keeps some mass for
what it has not seen.  P(w | h) is the discounted count over c(h) for a seen bigram and
alpha(h) P(w) otherwise, where alpha(h) = (1 - seen mass of h) / (1 - sum of P over the
words seen after h); a word never seen is one event that takes the unigrams' left-over
mass.

The corpus is cut into token blocks of about `BLOCK_TOKENS` (word keys and ranks).  Blocks
ask for the corpus counts of their distinct words and bigrams by key range; the answer
carries each count once per block, and marks one block as the owner of each bigram, so
that sums over a history's distinct bigrams need no further exchange of bigrams.  A word
or bigram, however frequent, costs each block one entry, so no key is hot.  The backoff
table, by history, is a table of its own that unseen bigrams are joined with.
"""

from __future__ import annotations

import zlib
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

from trailmill.llm.textkeys import U, mix, slices, words
from trailmill.session import bounded_batches, cut, discard, release

BLOCK_TOKENS = 1_000_000
#: Tokens whose counts are brought together in one task, about.
RANGE_TOKENS = 2_000_000
KATZ_K = 5
#: Counts of counts used for the log-linear fit.
FITTED = 1000
START, END = U(0x5354415254), U(0x454E44)


# --- discounts ------------------------------------------------------------


@dataclass
class Discount:
    """d(r): what part of a count r is kept."""

    low: list[float]
    power: float

    def __call__(self, counts: np.ndarray) -> np.ndarray:
        r = np.maximum(counts, 1).astype(np.float64)
        out = np.power(1 + 1 / r, self.power)
        for k, d in enumerate(self.low, 1):
            out[counts == k] = d
        return out


def good_turing(counts: dict[int, int]) -> Discount:
    """Discounts from counts of counts (r -> number of types with count r).

    The fit's slope is kept below -1.05, so that every discount is below 1.  Turing's
    estimate is used for r up to KATZ_K where it lies between 0 and the fit's next higher
    values; where types are too few for it, the fit stands.
    """
    r = np.array(sorted(k for k, n in counts.items() if n > 0 and k <= FITTED), np.float64)
    slope = -2.0
    if len(r) > 2:
        n = np.array([counts[int(k)] for k in r], np.float64)
        gap = np.diff(r)
        spread = np.concatenate([[r[0]], (r[2:] - r[:-2]) / 2, [gap[-1]]])
        slope = np.polyfit(np.log(r), np.log(n / spread), 1)[0]
    power = min(slope, -1.05) + 1
    fit = Discount([], power)
    low = []
    for k in range(1, KATZ_K + 1):
        here, above = counts.get(k, 0), counts.get(k + 1, 0)
        turing = (k + 1) * above / (k * here) if here else 0.0
        low.append(turing if 0.05 < turing < 0.999 else float(fit(np.array([k]))[0]))
    return Discount(low, power)


# --- blocks ---------------------------------------------------------------


def _planes(x: np.ndarray) -> bytes:
    """Bytes of integers plane by plane, so that their empty upper bytes compress away."""
    return zlib.compress(np.ascontiguousarray(x.view(np.uint8).reshape(len(x), x.dtype.itemsize).T).tobytes(), 1)


def _unplaned(data: bytes, dtype) -> np.ndarray:
    raw = np.frombuffer(zlib.decompress(data), np.uint8)
    width = np.dtype(dtype).itemsize
    return np.ascontiguousarray(raw.reshape(width, -1).T).view(dtype)[:, 0] if len(raw) else np.zeros(0, dtype)


TOKENS = "block long, part int, n long, rows binary, fold binary, sizes binary, words binary, ranks binary"


def _tokenise(batches):
    from pyspark import TaskContext

    task = TaskContext.get().partitionId()
    made, held = 0, []

    def flush():
        nonlocal made, held
        keys = np.concatenate([h[0] for h in held])
        found, inverse, counts = np.unique(keys, return_inverse=True, return_counts=True)
        order = np.argsort(-counts, kind="stable")
        rank = np.empty(len(order), np.uint32)
        rank[order] = np.arange(len(order), dtype=np.uint32)
        fold = np.concatenate([h[3] for h in held])
        sink = pa.BufferOutputStream()
        with pa.ipc.new_stream(sink, held[0][2].schema) as stream:
            for h in held:
                stream.write_batch(h[2])
        row = [
            [(task << 14) | made], [-1], [len(keys) + len(fold)], [sink.getvalue().to_pybytes()], [fold.tobytes()],
            [np.concatenate([h[1] for h in held]).astype(np.int32).tobytes()], [found[order].tobytes()], [_planes(rank[inverse])],
        ]
        made, held = made + 1, []
        types = (pa.int64(), pa.int32(), pa.int64(), *[pa.binary()] * 5)
        return pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(row, types)], names=[c.split()[0] for c in TOKENS.split(", ")])

    for batch in batches:
        column = batch.column("text")
        rows, fold = batch.select([c for c in batch.schema.names if c.startswith("_c")]), batch.column("fold").to_numpy().astype(np.int8)
        for a, b in slices(column):
            keys, at = words(column.slice(a, b - a))
            held.append((keys, np.diff(at), rows.slice(a, b - a), fold[a:b]))
            if sum(len(h[0]) + len(h[1]) for h in held) >= BLOCK_TOKENS:
                yield flush()
    if held:
        yield flush()


class Block:
    """One block's tokens: words by rank, and per document the words and the end."""

    def __init__(self, rows, fold, sizes, keys, ranks):
        self.rows = rows
        self.fold = np.frombuffer(fold, np.int8)
        self.sizes = np.frombuffer(sizes, np.int32).astype(np.int64)
        keys = np.frombuffer(keys, U)
        ranks = _unplaned(ranks, np.uint32)
        n = len(keys)
        self.keys = np.concatenate([keys, [END, START]])
        self.doc = np.repeat(np.arange(len(self.sizes), dtype=np.int32), self.sizes + 1)
        last = np.cumsum(self.sizes + 1) - 1
        self.word = np.full(len(self.doc), n, np.int32)
        inner = np.ones(len(self.doc), bool)
        inner[last] = False
        self.word[inner] = ranks
        self.history = np.empty(len(self.doc), np.int32)
        self.history[1:] = self.word[:-1]
        self.history[last - self.sizes] = n + 1
        self.train = (self.fold == 1)[self.doc]

    def word_counts(self) -> tuple[np.ndarray, np.ndarray]:
        """(word numbers in key order, train counts in that order)."""
        counts = np.bincount(self.word[self.train], minlength=len(self.keys))[: len(self.keys) - 1]
        order = np.argsort(self.keys[:-1], kind="stable")
        return order, counts[order]

    def bigrams(self) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """(histories, words, keys) of the distinct bigrams in key order, and each token's bigram."""
        code, inverse = np.unique(self.history.astype(np.int64) * len(self.keys) + self.word, return_inverse=True)
        history, word = np.divmod(code, len(self.keys))
        keys = mix(self.keys[history] * U(0x9E3779B97F4A7C15) + mix(self.keys[word]))
        order = np.argsort(keys, kind="stable")
        place = np.empty(len(order), np.int64)
        place[order] = np.arange(len(order))
        return history[order], word[order], keys[order], place[inverse]


REQUEST = "part int, block long, keys binary, counts binary"


def _requests(parts: int):
    def run(batches):
        for batch in batches:
            for row in zip(*(batch.column(c) for c in ("block", "rows", "fold", "sizes", "words", "ranks"))):
                number, *data = (x.as_py() for x in row)
                block = Block(*data)
                order, counts = block.word_counts()
                _, _, keys, token = block.bigrams()
                pairs = np.bincount(token[block.train], minlength=len(keys))
                for kind, k, c in ((0, block.keys[order], counts), (1, keys, pairs)):
                    part = ((k >> U(32)) * U(parts) >> U(32)).astype(np.int64)
                    ends = np.searchsorted(part, np.arange(parts + 1))
                    rows = []
                    for p, (a, b) in enumerate(zip(ends[:-1], ends[1:])):
                        if a < b:
                            rows.append((kind * parts + p, number, _planes(np.diff(k[a:b], prepend=U(0))), _planes(c[a:b].astype(np.uint32))))
                    if rows:
                        yield pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(zip(*rows), (pa.int32(), pa.int64(), pa.binary(), pa.binary()))], names=["part", "block", "keys", "counts"])

    return run


ANSWER = "block long, part int, counts binary, owned binary, histogram array<long>, total long"


def _answers(batches):
    def flush(part, rows):
        keys = [np.cumsum(_unplaned(r[1], U), dtype=U) for r in rows]
        sizes = [len(k) for k in keys]
        counts = np.concatenate([_unplaned(r[2], np.uint32) for r in rows]).astype(np.int64)
        keys = np.concatenate(keys)
        order = np.argsort(keys, kind="stable")
        lead = np.ones(len(keys), bool)
        lead[1:] = keys[order][1:] != keys[order][:-1]
        group = np.cumsum(lead) - 1
        total = np.bincount(group, counts[order], group[-1] + 1).astype(np.int64)
        answer, owned = np.empty(len(keys), np.int64), np.empty(len(keys), bool)
        answer[order], owned[order] = total[group], lead
        out, at = [], 0
        for row, n in zip(rows, sizes):
            out.append((row[0], part, _planes(answer[at : at + n].astype(np.uint32)), np.packbits(owned[at : at + n]).tobytes(), None, None))
            at += n
        out.append((None, part, None, None, np.bincount(total[total <= FITTED], minlength=FITTED + 1).tolist() + [int((total > 0).sum())], int(total.sum())))
        columns = zip(*out)
        return pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(columns, (pa.int64(), pa.int32(), pa.binary(), pa.binary(), pa.list_(pa.int64()), pa.int64()))], names=["block", "part", "counts", "owned", "histogram", "total"])

    part, rows = None, []
    for batch in batches:
        for p, block, keys, counts in zip(*(batch.column(c).to_pylist() for c in ("part", "block", "keys", "counts"))):
            if p != part:
                if rows:
                    yield flush(part, rows)
                part, rows = p, []
            rows.append((block, keys, counts))
    if rows:
        yield flush(part, rows)


# --- scores ---------------------------------------------------------------


@dataclass
class Model:
    """What is known once the counts are: totals, discounts and the mass of unseen words."""

    tokens: int
    types: int
    word_discount: Discount
    pair_discount: Discount
    unseen: float

    def unigram(self, counts: np.ndarray) -> np.ndarray:
        if self.tokens == 0:
            return np.ones(len(counts))
        return np.where(counts > 0, self.word_discount(counts) * counts / self.tokens, self.unseen)


SCORED = "kind int, row long, n_tokens long, n_known long, base double, score double, history long, mass double, lower double, total long"


def _score(model, parts: int, kept: pa.Schema):
    names = [c.split()[0] for c in SCORED.split(", ")]
    types = (pa.int32(), pa.int64(), pa.int64(), pa.int64(), pa.float64(), pa.float64(), pa.int64(), pa.float64(), pa.float64(), pa.int64())

    def batch(kind: int, n: int, **columns):
        return pa.RecordBatch.from_arrays(
            [
                *(pa.array(np.full(n, kind), t) if c == "kind" else pa.array(columns[c], t) if c in columns else pa.nulls(n, t) for c, t in zip(names, types)),
                *(columns["rows"].column(k) if "rows" in columns else pa.nulls(n, f.type) for k, f in enumerate(kept)),
            ],
            names=[*names, *kept.names],
        )

    def flush(number, data, answers):
        m: Model = model.value
        block = Block(*data)
        docs = len(block.sizes)
        ids = (number << 24) | np.arange(docs)
        rows = pa.ipc.open_stream(block.rows).read_all().combine_chunks().cast(kept).to_batches()
        rows = rows[0] if rows else pa.RecordBatch.from_arrays([pa.nulls(docs, f.type) for f in kept], schema=kept)
        order, _ = block.word_counts()
        found = {k: [_unplaned(c, np.uint32).astype(np.int64) for p, c, _ in answers if p // parts == k] for k in (0, 1)}
        count = np.zeros(len(block.keys), np.int64)
        count[order] = np.concatenate(found[0])
        history, word, _, token = block.bigrams()
        pair = np.concatenate(found[1])
        owned = np.concatenate([np.unpackbits(np.frombuffer(o, np.uint8), count=len(c)) for (p, _, o), c in zip((a for a in answers if a[0] // parts == 1), found[1])]).astype(bool)
        below = m.unigram(count)
        below[-1] = 0.0
        # c(h): each word is followed by another token; the start once in every train document,
        # which is what the end is counted as.
        before = count.copy()
        before[-1] = count[-2]
        seen = pair > 0
        reduced = m.pair_discount(pair) * pair
        own = np.zeros(len(pair))
        own[seen] = np.log10(reduced[seen]) - np.log10(before[history[seen]])
        own[~seen] = np.log10(below[word[~seen]])
        total = lambda x: np.bincount(block.doc, x, docs)
        known = count[block.word] > 0
        base = np.log10(count[block.word] + 0.1) - np.log10(m.tokens + 0.1 * (m.types + 1))
        yield batch(0, docs, rows=rows, row=ids, n_tokens=block.sizes + 1, n_known=total(known).astype(np.int64), base=total(base), score=total(own[token]))
        mine = seen & owned
        if mine.any():
            h, at = np.unique(history[mine], return_inverse=True)
            yield batch(1, len(h), history=block.keys[h].view(np.int64), mass=np.bincount(at, reduced[mine], len(h)), lower=np.bincount(at, below[word[mine]], len(h)), total=before[h])
        miss = ~seen[token] & (before[block.history] > 0)
        if miss.any():
            code, n = np.unique(block.doc[miss].astype(np.int64) * len(block.keys) + block.history[miss], return_counts=True)
            doc, h = np.divmod(code, len(block.keys))
            yield batch(2, len(n), row=ids[doc], history=block.keys[h].view(np.int64), total=n)

    def run(batches):
        number, data, answers = None, None, []
        for part in batches:
            for row in zip(*(part.column(c).to_pylist() for c in ("block", "part", "rows", "fold", "sizes", "words", "ranks", "counts", "owned"))):
                if row[0] != number:
                    if data is not None:
                        yield from flush(number, data, answers)
                    number, data, answers = row[0], None, []
                if row[1] < 0:
                    data = row[2:7]
                else:
                    answers.append((row[1], row[7], row[8]))
        if data is not None:
            yield from flush(number, data, answers)

    return run


def score_documents(docs: DataFrame, train: Column) -> DataFrame:
    """`docs` (with a text column) with n_tokens, n_known, train_tokens, base_score and score.

    The model learns from the rows where `train` is true (null counts as false); tokens are
    words and one end per text, and a null text is empty.  n_known counts tokens that occur
    in training, base_score is the log10 probability under add-0.1 unigrams, score under
    the Katz model.  Columns of these names in the input are replaced.  With nothing to
    learn from, base_score and score are 0.
    """
    spark = docs.sparkSession
    own = ("n_tokens", "n_known", "train_tokens", "base_score", "score")
    bounded_batches(docs.sparkSession)
    columns = [c for c in docs.columns if c not in (*own, "text")]
    fold = F.coalesce(train, F.lit(False)).cast("int").alias("fold")
    ready = docs.select(*[F.col(c).alias(f"_c{k}") for k, c in enumerate(columns)], fold, F.col("text").cast("string").alias("text"))
    fields = [f for f in ready.schema.fields if f.name.startswith("_c")]
    kept = to_arrow_schema(T.StructType(fields))
    tokens = cut(ready.mapInArrow(_tokenise, TOKENS), "tokens")
    n = tokens.agg(F.sum("n")).first()[0] or 0
    parts = max(1, -(-n // RANGE_TOKENS))
    asked = tokens.mapInArrow(_requests(parts), REQUEST).repartition(2 * parts, "part").sortWithinPartitions("part", "block")
    answers = cut(asked.mapInArrow(_answers, ANSWER), "counts")
    del asked
    release(spark)
    totals = answers.where("block is null").select((F.col("part") >= parts).cast("int").alias("kind"), "histogram", "total")
    histogram = totals.select("kind", F.posexplode("histogram").alias("r", "n")).groupBy("kind", "r").agg(F.sum("n").alias("n")).collect()
    by_kind = [{r.r: r.n for r in histogram if r.kind == k} for k in (0, 1)]
    sums = {r.kind: r.n for r in totals.groupBy("kind").agg(F.sum("total").alias("n")).collect()}
    types = [k.pop(FITTED + 1, 0) for k in by_kind]
    for k in by_kind:
        k.pop(0, None)
    word_discount, pair_discount = (good_turing(k) for k in by_kind)
    trained = sums.get(0, 0)
    mass = answers.where("block is not null").where(F.col("part") < parts)
    seen = cut(mass.mapInArrow(_owned_mass(word_discount), "mass double"), "mass").agg(F.sum("mass")).first()[0] or 0.0
    model = spark.sparkContext.broadcast(Model(trained, types[0], word_discount, pair_discount, max(1e-300, 1 - seen / trained) if trained else 1.0))

    both = tokens.drop("n").unionByName(answers.where("block is not null").select("block", "part", "counts", "owned"), allowMissingColumns=True)
    blocks = both.repartition("block").sortWithinPartitions("block", "part")
    schema = T.StructType([*T._parse_datatype_string(SCORED).fields, *fields])
    scored = cut(blocks.mapInArrow(_score(model, parts, kept), schema), "scored")
    del both, blocks
    for table in (tokens, answers):
        discard(table)
    release(spark)
    backoff = (
        scored.where("kind = 1").groupBy("history").agg(F.sum("mass").alias("mass"), F.sum("lower").alias("lower"), F.max("total").alias("total"))
        .select("history", F.log10((1 - F.col("mass") / F.col("total")) / (1 - F.col("lower"))).alias("alpha"))
    )
    missed = scored.where("kind = 2").select("history", "row", "total").join(backoff, "history")
    missed = missed.groupBy("row").agg(F.sum(F.col("total") * F.col("alpha")).alias("backed_off"))
    empty = trained == 0
    done = scored.where("kind = 0").join(missed, "row", "left")
    return done.select(
        *[F.col(f"_c{k}").alias(c) for k, c in enumerate(columns)], "n_tokens", "n_known", F.lit(trained).cast("long").alias("train_tokens"),
        (F.lit(0.0) if empty else F.col("base")).alias("base_score"),
        (F.lit(0.0) if empty else F.col("score") + F.coalesce("backed_off", F.lit(0.0))).alias("score"),
    )


def _owned_mass(discount: Discount):
    def run(batches):
        total = 0.0
        for batch in batches:
            for counts, owned in zip(batch.column("counts").to_pylist(), batch.column("owned").to_pylist()):
                c = _unplaned(counts, np.uint32).astype(np.int64)
                c = c[np.unpackbits(np.frombuffer(owned, np.uint8), count=len(c)).astype(bool)]
                total += float((discount(c) * c).sum())
        yield pa.RecordBatch.from_arrays([pa.array([total])], names=["mass"])

    return run
