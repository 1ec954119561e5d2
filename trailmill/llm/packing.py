"""Best-fit packing of documents into fixed-length sequences by minimum bin slack.

Tokenised documents are cut into pieces of at most the sequence length (only longer ones
are cut; the first piece takes the remainder).  How full sequences can be made depends on
the piece lengths alone, so the plan is computed from their histogram, which has at most
`length` entries whatever the corpus: starting from the longest piece left, a bitset
subset-sum program over the lengths still available finds the fullest combination that
fits beside it, and that combination is removed as often as the counts allow.

Pieces are then dealt to the planned places by their rank among the pieces of the same
length.  Ranks come from counts per (length, bucket), so no length, however common, is
gathered in one task.
"""

from __future__ import annotations

import json
import re
import sys
import zlib
from array import array
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from trailmill.llm.textkeys import lean
from trailmill.session import bounded_batches, cut

#: Pieces of one (length, bucket) pair that one task ranks, about.
RANK_ROWS = 20_000


# --- plan -----------------------------------------------------------------


@dataclass
class PackingPlan:
    """Combinations in order: how often each is used and the first sequence it fills.

    For each length, `ranks[length]` lists where its pieces go: first rank, combination,
    uses per sequence and offset in the sequence.
    """

    combinations: list[tuple[int, dict[int, int]]]
    ranks: dict[int, np.ndarray]
    sequences: int


def fullest(counts: dict[int, int], lengths: list[int], room: int) -> dict[int, int]:
    """A combination of available lengths with the largest sum within `room`.

    Bit s of `reach` says that sum s can be made; each length is added by binary powers of
    its count.  Among equal sums, longer pieces are preferred.
    """
    mask = (1 << (room + 1)) - 1
    reach, steps = 1, []
    for length in lengths:
        if length > room:
            continue
        left, power = min(counts[length], room // length), 1
        while left > 0:
            take = min(power, left)
            left, power = left - take, power * 2
            before = reach
            reach |= (reach << (take * length)) & mask
            if reach != before:
                steps.append((length, take, before))
        if reach >> room & 1:
            break
    at, out = reach.bit_length() - 1, {}
    for length, take, before in reversed(steps):
        if not before >> at & 1:
            out[length] = out.get(length, 0) + take
            at -= take * length
    return out


def plan_packing(histogram: dict[int, int], length: int) -> PackingPlan:
    counts = {k: n for k, n in histogram.items() if n > 0 and 0 < k <= length}
    lengths = sorted(counts, reverse=True)
    combinations: list[tuple[int, dict[int, int]]] = []
    while lengths:
        first = lengths[0]
        counts[first] -= 1
        chosen = fullest(counts, lengths, length - first)
        counts[first] += 1
        chosen[first] = chosen.get(first, 0) + 1
        times = min(counts[k] // n for k, n in chosen.items())
        combinations.append((times, chosen))
        for k, n in chosen.items():
            counts[k] -= times * n
        lengths = [k for k in lengths if counts[k] > 0]
    ranks: dict[int, list] = {}
    used: dict[int, int] = {}
    sequence = 0
    for times, chosen in combinations:
        offset = 0
        for k in sorted(chosen, reverse=True):
            start = used.get(k, 0)
            ranks.setdefault(k, []).append((start, sequence, chosen[k], offset))
            used[k] = start + times * chosen[k]
            offset += k * chosen[k]
        sequence += times
    return PackingPlan(combinations, {k: np.array(v, np.int64) for k, v in ranks.items()}, sequence)


def place(plan: PackingPlan, lengths: np.ndarray, ranks: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(sequence, offset) of the pieces with these lengths and ranks."""
    sequence, offset = np.zeros(len(lengths), np.int64), np.zeros(len(lengths), np.int64)
    order = np.argsort(lengths, kind="stable")
    values, starts = np.unique(lengths[order], return_index=True)
    for k, a, b in zip(values, starts, [*starts[1:], len(lengths)]):
        rows = order[a:b]
        table = plan.ranks[int(k)]
        at = np.searchsorted(table[:, 0], ranks[rows], "right") - 1
        inside = ranks[rows] - table[at, 0]
        sequence[rows] = table[at, 1] + inside // table[at, 2]
        offset[rows] = table[at, 3] + inside % table[at, 2] * k
    return sequence, offset


# --- tokens ---------------------------------------------------------------

#: White space as the tokenizers' pattern has it (fixed values).
WHITE = "\t-\r \x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000"
#: Words, and pieces without a space, kept with their ids by one worker: a cache of work, emptied when full.
CACHED = 1_000_000
#: Longer ones are not kept.
CACHED_LENGTH = 200
#: What byte-level tokenizers cut a text into before they merge.
PIECES = regex.compile(rf"'s|'t|'re|'ve|'m|'ll|'d| ?\p{{L}}+| ?\p{{N}}+| ?[^{WHITE}\p{{L}}\p{{N}}]+|[{WHITE}]+(?![^{WHITE}])|[{WHITE}]+")
#: White space that is a token of its own: a run up to its last character, which stays before the word, or up to the text's end.
GAPS = re.compile(f"([{WHITE}]+(?=[{WHITE}][^{WHITE}])|[{WHITE}]+\\Z)")
#: Nothing, or white space, after the space or line feed that a word stands behind.
BLANK = re.compile(f"\n?+(?:[{WHITE}]|\\Z)").match
#: What ends words: neither letter nor number, and no apostrophe.
MARKS = '.,;:!?"()[]{}<>*#%&$|+-=_~/'
#: Letters in every version of Unicode, if str.isalpha() says so.
LATIN = re.compile("[\x00-ɏ]+").fullmatch
_PRINTED = [*range(33, 127), *range(161, 173), *range(174, 256)]
#: Bytes as the characters that byte-level vocabularies write them with.
BYTE_CHARS = {b: chr(b) for b in _PRINTED} | {b: chr(256 + k) for k, b in enumerate(b for b in range(256) if b not in _PRINTED)}


class Uneven(Exception):
    """A text with more than one white space in a row, or with white space at its end."""


class WordEncoder(dict):
    """ids (little-endian uint32 bytes) of a text, as `Tokenizer.encode(text, add_special_tokens=False)` has them.

    The byte-level pattern never joins a token across the border between a non-space and
    the white space after it, and takes the last space before a word with the word.  So a
    text without runs of white space is cut before each space and line feed, other texts
    are first cut at their runs, and frequent words need encoding once.  A word is cut as
    the tokenizer cuts it, and each piece is merged by the tokenizer's own model.  Keys are
    words without the space before them; a line feed stays.  A text that spells one of the
    vocabulary's added tokens is encoded whole, as such a token is found before the pattern
    is applied; so is every text of a vocabulary that is not plainly byte-level.
    """

    def __init__(self, tokenizer_path: str):
        from tokenizers import Tokenizer

        super().__init__()
        self.tokenizer = Tokenizer.from_file(tokenizer_path)
        self.merge, self.merged = self.tokenizer.model.tokenize, {}
        # The pattern's own settings: the whole plan would be the vocabulary once more.
        before = json.loads(self.tokenizer.pre_tokenizer.__getstate__()) if self.tokenizer.pre_tokenizer else {}
        plain = before.get("type") == "ByteLevel" and before.get("use_regex") and not before.get("add_prefix_space") and self.tokenizer.normalizer is None
        added = [t.content for t in self.tokenizer.get_added_tokens_decoder().values()]
        self.whole = re.compile("|".join(map(re.escape, added)) or r"(?!)").search if plain else lambda text: True

    def _merged(self, piece: str) -> bytes:
        spelled = piece.encode().decode("latin-1").translate(BYTE_CHARS)
        ids = array("I", [t.id for t in self.merge(spelled)])
        if sys.byteorder == "big":
            ids.byteswap()
        return ids.tobytes()

    def _piece(self, piece: str) -> bytes:
        """ids of a piece; that of a word behind a space is found, and kept, under the word."""
        behind = piece[0] == " " and not piece.isspace()
        kept, key = (self, piece[1:]) if behind else (self.merged, piece)
        ids = kept.get(key)
        if ids is None:
            ids = self._merged(piece)
            if len(key) <= CACHED_LENGTH:
                kept[key] = ids
        return ids

    def _pieces(self, chunk: str) -> bytes:
        return b"".join(map(self._piece, PIECES.findall(chunk)))

    def __missing__(self, word: str) -> bytes:
        letters = word.rstrip(MARKS)
        if letters.isalpha() and (letters.isascii() or LATIN(letters)):  # one piece, and one of the marks
            ids = self._merged(" " + word) if letters == word else self[letters] + self._piece(word[len(letters) :])
        elif BLANK(word):
            raise Uneven
        else:
            ids = self._pieces(word if word[0] == "\n" else " " + word)
        if len(word) <= CACHED_LENGTH:
            self[word] = ids
        return ids

    def _even(self, text: str) -> bytes:
        first, *words = text.replace("\n", " \n").split(" ")
        return self._pieces(first) + b"".join(map(self.__getitem__, words))

    def encode(self, text: str) -> bytes:
        if self.whole(text):
            return np.array(self.tokenizer.encode(text, add_special_tokens=False).ids, "<u4").tobytes()
        for cache in (self, self.merged):
            if len(cache) > CACHED:
                cache.clear()
        try:
            return self._even(text)
        except Uneven:
            return b"".join(self._piece(x) if k % 2 else self._even(x) for k, x in enumerate(GAPS.split(text)))


def byte_bpe_encoder(name: str = "byte_bpe_50k.json") -> WordEncoder:
    """Encoder for a public vocabulary by its file name."""
    import public_tokenizers

    return WordEncoder(public_tokenizers.path(name))


def _pieces(tokenizer: str, length: int, end: int, with_ids: bool):
    names = ["doc_id", "piece", "start", "length", "ids_crc32"]

    def run(batches):
        encoder = byte_bpe_encoder(tokenizer)
        close = np.array([end], "<u4").tobytes()
        for batch in batches:
            out = ([], [], [], [], [], [])
            for doc, text in zip(batch.column("doc_id").to_pylist(), batch.column("text").to_pylist()):
                ids = encoder.encode(text or "") + close
                n = len(ids) // 4
                first = n % length or length
                for k, start in enumerate([0, *range(first, n, length)]):
                    size = first if k == 0 else length
                    part = ids[4 * start : 4 * (start + size)]
                    for column, value in zip(out, (doc, k, start, size, zlib.crc32(part), part)):
                        column.append(value)
            columns = [pa.array(x, t) for x, t in zip(out, (pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64()))]
            if with_ids:
                flat = pa.array(np.frombuffer(b"".join(out[5]), "<u4").astype(np.int32))
                ends = np.concatenate([[0], np.cumsum(out[3])]).astype(np.int32)
                columns.append(pa.ListArray.from_arrays(pa.array(ends), flat))
            yield pa.RecordBatch.from_arrays(columns, names=[*names, *["ids"] * with_ids])

    return run


def tokenise_pieces(docs: DataFrame, length: int = 1024, tokenizer: str = "byte_bpe_50k.json", end: int = 2, with_ids: bool = False) -> DataFrame:
    """One row per piece: doc_id, piece, start, length, ids_crc32 and, if asked for, ids.

    A null text is empty and has the end id alone; an empty table has no pieces.
    """
    bounded_batches(docs.sparkSession)
    schema = "doc_id long, piece int, start long, length long, ids_crc32 long" + ", ids array<int>" * with_ids
    return docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")).mapInArrow(lean(_pieces(tokenizer, length, end, with_ids)), schema)


def pack_pieces(pieces: DataFrame, length: int = 1024) -> DataFrame:
    """`pieces` (which are read three times, so cut their lineage first) with sequence_id and offset.

    Any further columns are kept.  Rows are identified by doc_id and piece for ranking;
    equal ones are ranked in any order.
    """
    spark = pieces.sparkSession
    rows = pieces.count()
    buckets = max(1, rows // RANK_ROWS)
    dealt = pieces.withColumn("_bucket", F.pmod(F.xxhash64("doc_id", "piece"), F.lit(buckets)).cast("int"))
    counts = cut(dealt.groupBy("length", "_bucket").agg(F.count("*").alias("n")), "lengths")
    histogram = {r.length: r.n for r in counts.groupBy("length").agg(F.sum("n").alias("n")).collect()}
    plan = spark.sparkContext.broadcast(plan_packing(histogram, length))
    before = Window.partitionBy("length").orderBy("_bucket").rowsBetween(Window.unboundedPreceding, -1)
    offsets = counts.select("length", "_bucket", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("_before"))
    order = Window.partitionBy("length", "_bucket").orderBy("doc_id", "piece")
    ranked = dealt.join(offsets, ["length", "_bucket"]).withColumn("_rank", F.col("_before") + F.row_number().over(order) - 1)
    keep = [c for c in pieces.columns]

    def run(batches):
        for batch in batches:
            sequence, offset = place(plan.value, batch.column("length").to_numpy(), batch.column("_rank").to_numpy())
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in keep), pa.array(sequence), pa.array(offset)], names=[*keep, "sequence_id", "offset"])

    schema = T.StructType([*pieces.schema.fields, T.StructField("sequence_id", T.LongType()), T.StructField("offset", T.LongType())])
    return ranked.select(*keep, "_rank").mapInArrow(run, schema)


def pack_documents(docs: DataFrame, length: int = 1024, tokenizer: str = "byte_bpe_50k.json", end: int = 2, with_ids: bool = False) -> DataFrame:
    """Pieces of all `docs` (doc_id, text) with their places in sequences of `length` ids."""
    return pack_pieces(cut(tokenise_pieces(docs, length, tokenizer, end, with_ids), "pieces"), length)
