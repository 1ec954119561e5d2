"""Token ids of a corpus in flat binary files.

A folder of token files holds, for each part,

* ``<part>.bin``: the ids of its documents end to end, little-endian unsigned integers of
  the smallest width (16 or 32 bits) that holds every id of the vocabulary and the end id,
* ``<part>.off``: documents + 1 little-endian unsigned 64-bit starts within the part,
* ``<part>.doc``: the doc_ids, little-endian signed 64 bits (0 for a null, and nulls come first),

and ``manifest.json``, which lists the parts in ascending doc_id order with their numbers of
documents, of null doc_ids and of ids, and their `base`: how many ids the parts before hold.
Bases are prefix sums of the parts' counts, so parts are written side by side, without any
task knowing what another writes.  A part is mapped into memory when read.

Documents are dealt to parts by ranges of doc_id (a doc_id that very many rows share is
split by the hash of its text).  Every attempt of a task writes files of its own names, and
the manifest lists only what the attempt that Spark counted has written; what lost or
repeated attempts leave behind is deleted.

Nulls: a null text is an empty one and has the end id alone; documents with a null doc_id
come first.  Repeated rows are documents of their own; rows with one doc_id are in order of
their texts' hashes.  Texts of any length are encoded whole.  An empty table has no parts.
Other columns of the table are not read.
"""

from __future__ import annotations

import json
import re
import sys
import uuid
from array import array
from itertools import accumulate

import numpy as np
import pyarrow as pa
import pyarrow.fs
import regex
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from trailmill.llm.packing import BYTE_CHARS
from trailmill.llm.textkeys import lean
from trailmill.session import bounded_batches, cut, shared_dir

#: What the tokenizers' pattern takes as a token before merging (fixed values).
PIECES = regex.compile(r"'s|'t|'re|'ve|'m|'ll|'d|\p{L}+|\p{N}|[^\s\p{L}\p{N}]+")
MARKS = regex.compile(r"\p{M}")
#: Characters whose lower case and composed form are the same in every version of Unicode.
LATIN = re.compile("[\x00-įĲ-ɏ]+")
#: Chunks, and pieces, kept with their ids by one worker: a cache of work, emptied when full.
CACHED = 1_000_000
#: Bytes of ids that a batch read back holds, about.
BATCH = 8 << 20


# --- encoding -------------------------------------------------------------


class ChunkEncoder(dict):
    """ids (little-endian, `kind`) of a text, as `Tokenizer.encode(text, add_special_tokens=False)` has them.

    The vocabulary's pattern drops white space and never joins a token across it, so a
    text's ids are those of its chunks between white space, and a chunk needs encoding once.
    Chunks of Latin letters are lower-cased, cut as the tokenizer cuts them and merged by
    the tokenizer's own model; other chunks go through the whole tokenizer.  A text that
    spells an added token is encoded whole, since such tokens are found before anything
    else, and so is every text of a vocabulary of another kind.
    """

    def __init__(self, tokenizer_path: str, kind: str):
        from tokenizers import Tokenizer

        super().__init__()
        self.tokenizer, self.kind = Tokenizer.from_file(tokenizer_path), kind
        self.code = {"<u2": "H", "<u4": "I"}[kind] if sys.byteorder == "little" else None
        self.merge, self.merged = self.tokenizer.model.tokenize, {}
        plan = json.loads(self.tokenizer.to_str())
        steps = [x["type"] for x in (plan["normalizer"] or {}).get("normalizers", [])]
        cuts = (plan["pre_tokenizer"] or {}).get("pretokenizers", [])
        plain = steps == ["NFC", "Replace", "Lowercase"] and [x["type"] for x in cuts] == ["Split", "ByteLevel"] and cuts[0]["invert"] and not cuts[1]["use_regex"]
        added = [re.escape(t.content) for t in self.tokenizer.get_added_tokens_decoder().values()]
        self.whole = re.compile("|".join(added) or "(?!)", re.IGNORECASE).search if plain else lambda text: True

    def _piece(self, piece: str) -> bytes:
        found = self.merged.get(piece)
        if found is None:
            spelled = piece if piece.isascii() and piece.isprintable() else piece.encode().decode("latin-1").translate(BYTE_CHARS)
            found = self.merged[piece] = self.pack([t.id for t in self.merge(spelled)])
        return found

    def __missing__(self, chunk: bytes) -> bytes:
        text = chunk.decode()
        if not text.isascii() and not LATIN.fullmatch(text):
            found = self.pack(self.tokenizer.encode(text, add_special_tokens=False).ids)
        else:
            text = text.lower()
            found = self._piece(text) if text.isalpha() else b"".join(map(self._piece, PIECES.findall(text)))
        self[chunk] = found
        return found

    def pack(self, ids: list[int]) -> bytes:
        return array(self.code, ids).tobytes() if self.code else np.array(ids, self.kind).tobytes()

    def encode(self, text: str) -> bytes:
        if self.whole(text):
            return self.pack(self.tokenizer.encode(text, add_special_tokens=False).ids)
        for cache in (self, self.merged):
            if len(cache) > CACHED:
                cache.clear()
        raw = text.encode()
        if text.isascii() or not MARKS.search(text):  # nothing composes with the letters A-Z, so they can be lower-cased first
            raw = raw.lower()
        return b"".join(map(self.__getitem__, raw.split()))


_encoders: dict[tuple[str, str], ChunkEncoder] = {}


def encoder_of(name: str, kind: str) -> ChunkEncoder:
    """A worker's encoder for a public vocabulary by its file name; what it has encoded serves the worker's later tasks, too."""
    import public_tokenizers

    if (name, kind) not in _encoders:
        _encoders[name, kind] = ChunkEncoder(public_tokenizers.path(name), kind)
    return _encoders[name, kind]


def id_kind(tokenizer_path: str, end: int) -> str:
    """The smallest unsigned type for every id of the vocabulary and the end id."""
    from tokenizers import Tokenizer

    ids = Tokenizer.from_file(tokenizer_path).get_vocab(with_added_tokens=True).values()
    return "<u2" if max(end, *ids) < 1 << 16 else "<u4"


# --- files ----------------------------------------------------------------


def _store(uri: str) -> tuple[pyarrow.fs.FileSystem, str]:
    return pyarrow.fs.FileSystem.from_uri(uri)


def mapped(uri: str, kind: str) -> np.ndarray:
    """A flat file as an array: mapped into memory where the store is a mounted folder, else read."""
    store, path = _store(uri)
    if isinstance(store, pyarrow.fs.LocalFileSystem):
        with pa.memory_map(path) as source:
            return np.frombuffer(source.read_buffer(), kind)
    with store.open_input_file(path) as source:
        return np.frombuffer(source.read_buffer(), kind)


def _write(folder: str, tokenizer: str, end: int, kind: str):
    def run(batches):
        encoder, close = None, np.array([end], kind).tobytes()
        width, n, nulls, at = np.dtype(kind).itemsize, 0, 0, 0
        part = TaskContext.get().partitionId()
        name = f"part-{part:06d}-{uuid.uuid4().hex}"
        files = []
        try:
            for batch in batches:
                if batch.num_rows == 0:
                    continue
                if encoder is None:
                    encoder = encoder_of(tokenizer, kind)
                    store, path = _store(f"{folder}/{name}")
                    files = [store.open_output_stream(path + x) for x in (".bin", ".off", ".doc")]
                    files[1].write(np.zeros(1, "<u8").tobytes())
                sizes = []
                for text in batch.column("text"):
                    ids = encoder.encode(text.as_py() or "") + close
                    files[0].write(ids)
                    sizes.append(len(ids) // width)
                starts = at + np.cumsum(sizes)
                files[1].write(starts.astype("<u8").tobytes())
                docs = batch.column("doc_id")
                files[2].write(docs.fill_null(0).to_numpy(zero_copy_only=False).astype("<i8").tobytes())
                n, nulls, at = n + batch.num_rows, nulls + docs.null_count, int(starts[-1])
        finally:
            for file in files:
                file.close()
        if n:
            yield pa.RecordBatch.from_pylist([{"part": part, "name": name, "docs": n, "nulls": nulls, "ids": at}])

    return run


def write_token_files(docs: DataFrame, folder: str, tokenizer: str = "word_bpe_49k.json", end: int = 1) -> list[dict]:
    """Write the ids of all `docs` (doc_id, text) into the new folder `folder`; returns the manifest's parts.

    The manifest has a row per non-empty partition, so its size is bounded by the number of
    shuffle partitions, not by the rows.
    """
    import public_tokenizers

    spark = docs.sparkSession
    bounded_batches(spark)
    kind = id_kind(public_tokenizers.path(tokenizer), end)
    store, path = _store(folder)
    store.create_dir(path, recursive=True)
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).withColumn("tie", F.xxhash64("text"))
    order = [F.col("doc_id").asc_nulls_first(), F.col("tie")]
    dealt = rows.repartitionByRange(*order).sortWithinPartitions(*order, "text").select("doc_id", "text")
    written = cut(dealt.mapInArrow(lean(_write(folder, tokenizer, end, kind)), "part long, name string, docs long, nulls long, ids long"), "parts")
    parts = [r.asDict() for r in written.orderBy("part").collect()]
    for part, base in zip(parts, accumulate((p["ids"] for p in parts), initial=0)):
        part["base"] = base
    kept = {p["name"] for p in parts}
    for info in store.get_file_info(pyarrow.fs.FileSelector(path)):
        if info.is_file and info.base_name.rpartition(".")[0] not in kept:
            store.delete_file(info.path)
    with store.open_output_stream(f"{path}/manifest.json") as out:
        out.write(json.dumps({"kind": kind, "end": end, "tokenizer": tokenizer, "parts": parts}).encode())
    return parts


def read_token_files(spark: SparkSession, folder: str) -> DataFrame:
    """One row per document of a folder of token files: doc_id, start, n_tokens and ids.

    `start` counts the ids of all documents before it, `ids` are little-endian unsigned
    32-bit integers whatever the width in the files.  One task reads one part.
    """
    store, path = _store(folder)
    with store.open_input_stream(f"{path}/manifest.json") as source:
        manifest = json.loads(source.read())
    parts, kind = manifest["parts"], manifest["kind"]
    names = ["doc_id", "start", "n_tokens", "ids"]

    def run(batches):
        for batch in batches:
            for k in batch.column("id").to_pylist():
                part = parts[k]
                ids, off, docs = (mapped(f"{folder}/{part['name']}{x}", t) for x, t in ((".bin", kind), (".off", "<u8"), (".doc", "<i8")))
                most, a = BATCH // 4, 0
                while a < part["docs"]:
                    b = max(a + 1, int(np.searchsorted(off, off[a] + np.uint64(most), "right")) - 1)
                    ends = off[a : b + 1].astype(np.int64)
                    flat = ids[ends[0] : ends[-1]].astype("<u4")
                    value = pa.LargeBinaryArray.from_buffers(pa.large_binary(), b - a, [None, pa.py_buffer(4 * (ends - ends[0])), pa.py_buffer(flat)])
                    mask = np.arange(a, b) < part["nulls"]
                    columns = [pa.array(docs[a:b], mask=mask), pa.array(part["base"] + ends[:-1]), pa.array(np.diff(ends)), value.cast(pa.binary())]
                    yield pa.RecordBatch.from_arrays(columns, names=names)
                    a = b

    n = len(parts)
    return spark.range(0, n, 1, max(1, n)).mapInArrow(lean(run), "doc_id long, start long, n_tokens long, ids binary")


def scratch_folder(spark: SparkSession) -> str:
    """A new folder in the session's shared one, deleted when the driver ends."""
    path = f"{shared_dir(spark)}/token-files-{uuid.uuid4().hex}"
    jpath = spark._jvm.org.apache.hadoop.fs.Path(path)
    files = jpath.getFileSystem(spark._jsc.hadoopConfiguration())
    files.mkdirs(jpath)
    files.deleteOnExit(jpath)
    return path
