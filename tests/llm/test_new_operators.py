import hashlib
import itertools
import json
import math
import random
import re
import zlib
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from trailmill.llm import conversations as conv
from trailmill.llm import queries, resample
from trailmill.llm.token_files import ChunkEncoder, id_kind, mapped, read_token_files, scratch_folder, write_token_files

# --- conversation repair --------------------------------------------------

GRAMMAR = re.compile(r"(s?(ua)+)?")


def plain_repair(rows):
    """Every string of edits by growing cost, in ASCII order (rows: role, text in order)."""
    seen, kinds = set(), []
    for role, text in rows:
        body = text.rstrip(" \t\n\x0b\x0c\r")
        kind = "blank" if not body else "duplicate" if (role, text) in seen else "truncated" if body[-1] not in ".!?" else "fine"
        seen.add((role, text))
        kinds.append(kind)
    costs, known = {0: [("", "", 0)]}, set()  # cost -> (audit, roles' initials, rows used)
    for cost in itertools.count():
        for audit, roles, used in costs.get(cost, []):  # grows with edits that cost nothing
            steps = [("I", r, 3, used) for r in "ua"]
            if used < len(rows):
                kind, initial = kinds[used], rows[used][0][:1]
                more = 3 * (kind == "truncated")
                steps.append(("D", "", 4, used + 1))
                if kind in ("fine", "truncated"):
                    steps += [("K", initial, more, used + 1), *(("R", r, 3 + more, used + 1) for r in "ua")]
            for letter, role, price, after in steps:
                found = (audit + letter, roles + role, after)
                if re.fullmatch(r"s?(ua)*u?|", roles + role) and found not in known:
                    known.add(found)
                    costs.setdefault(cost + price, []).append(found)
        done = sorted(a for a, roles, used in costs.get(cost, []) if used == len(rows) and GRAMMAR.fullmatch(roles))
        if done:
            return Counter(kinds), cost, done[0]


def applied(rows, audit):
    """The repaired rows: roles follow from the audit and the first row kept."""
    out, at = [], 0
    for letter in audit:
        role, text = rows[at] if letter != "I" else (None, "")
        at += letter != "I"
        if letter == "D":
            continue
        turns = len(out) - bool(out and out[0][0].startswith("s"))
        out.append((role if letter == "K" else ("user", "assistant")[turns % 2], text))
    return "\n".join(f"{a}:{b}" for a, b in out)


def test_repairs_against_every_string_of_edits(spark):
    rng = random.Random(5)
    data, expected = [], {}
    for c in range(60):
        rows = [(rng.choice(["system", "user", "assistant", "tool", "user", "assistant"]), rng.choice(["a.", "b!", "c", "", " \n", "d?  ", "ü"])) for _ in range(rng.randint(1, 6))]
        data += [(c, t, role, text, "x") for t, (role, text) in enumerate(rows)]
        expected[c] = rows
    rng.shuffle(data)
    found = conv.repaired_digests(spark.createDataFrame(data, "conv_id long, turn long, role string, text string, audit string")).collect()
    assert len(found) == len(expected)
    for r in found:
        kinds, cost, audit = plain_repair(expected[r.conv_id])
        assert (r.cost, r.audit) == (cost, audit), expected[r.conv_id]
        assert (r.blank, r.duplicate, r.truncated) == (kinds["blank"], kinds["duplicate"], kinds["truncated"])
        pairs = list(itertools.pairwise(role[0] for role, _ in expected[r.conv_id]))
        assert r.illegal == sum(a + b not in ("su", "ua", "au") for a, b in pairs)
        assert r.repaired_sha256 == hashlib.sha256(applied(expected[r.conv_id], audit).encode()).hexdigest()


def test_states_are_few_and_long_conversations_linear():
    automaton = conv.Determinised()
    rng = random.Random(1)
    cost, audit = automaton.cheapest([rng.randrange(9) for _ in range(200_000)])
    assert len(automaton.vectors) < 200 and len(audit) >= 200_000 and cost > 0
    assert automaton.cheapest([]) == (0, "")


def test_conversations_with_nulls_ties_and_clashing_columns(spark):
    rows = [
        (None, 3, "user", "Hi.", 1), (None, None, "assistant", "Yes.", 1),  # nulls first, so the assistant comes first
        (1, 5, None, None, 1), (2, 1, "user", "A.", 1), (2, 1, "user", "A.", 1), (2, 9, "assistant", "B.", 1), (2, None, "user", "C.", 1),
        (3, -(1 << 63), "user", "A.", 1), (3, (1 << 63) - 1, "assistant", "B.", 1),
    ]
    frame = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string, place int")
    found = {r.conv_id: r for r in conv.repaired_digests(frame).collect()}
    assert (found[None].audit, found[None].gaps, found[None].illegal) == ("IKKI", 0, 0)
    assert (found[1].blank, found[1].audit, found[1].gaps) == (1, "D", 0)
    assert (found[2].duplicate, found[2].gaps, found[2].illegal, found[2].audit) == (1, 7, 2, "KIKDK")
    assert found[3].gaps == (1 << 63) - 1 and found[3].audit == "KK"
    assert conv.repaired_digests(frame.limit(0)).collect() == []
    turns = conv.repair(frame, conv.diagnose(frame)).where("conv_id is null").orderBy("place").collect()
    assert [(t.place, t.turn, t.role, t.text, t.edit) for t in turns] == [
        (0, None, "user", "", "I"), (1, None, "assistant", "Yes.", "K"), (2, 3, "user", "Hi.", "K"), (3, None, "assistant", "", "I"),
    ]


def test_groups_over_many_batches():
    rng = random.Random(2)
    keys = sorted(rng.choices(range(9), k=200))
    whole = pa.table({"k": keys, "v": range(200)})
    for size in (1, 3, 50, 500):
        back = []
        for table, starts in conv.whole_groups(whole.to_batches(max_chunksize=size), "k"):
            assert [table["k"][int(s)].as_py() for s in starts] == sorted(set(table["k"].to_pylist()))
            back += table["v"].to_pylist()
        assert back == list(range(200))


def test_conversations_over_many_arrow_batches(spark):
    rng = random.Random(9)
    rows = [(c, t, rng.choice(["system", "user", "assistant"]), rng.choice(["a.", "b", "c!", "", f"t{t}."])) for c in range(4) for t in range(40)]
    frame = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")
    expected = sorted(conv.repaired_digests(frame).collect())
    before = spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "3")
    try:
        assert sorted(conv.repaired_digests(frame).collect()) == expected and len(expected) == 4
    finally:
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", before)
    for r in expected:
        assert r.repaired_sha256 == hashlib.sha256(applied([(role, text) for c, _, role, text in rows if c == r.conv_id], r.audit).encode()).hexdigest()


def test_damage_drops_whole_conversations(spark, tmp_path):
    lost = next(c for c in range(999) if zlib.crc32(f"{c}:0".encode()) % 20 == 0)
    again = next(c for c in range(999) if zlib.crc32(f"{c}:0".encode()) % 20 == 3)
    rows = [(lost, 0, "user", "Hi."), (again, 0, "user", None), (None, 0, "user", "Hi.")]
    spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").write.parquet(f"{tmp_path}/conversations.parquet")
    found = {r.conv_id: r for r in queries.op11_conversation_repair(spark, str(tmp_path)).collect()}
    empty = hashlib.sha256(b"").hexdigest()
    assert found[lost][1:] == (0, 0, 0, 0, 0, 0, "", empty)
    assert found[again][1:] == (0, 2, 0, 0, 1, 8, "DD", empty) and None in found


# --- resampling -----------------------------------------------------------

LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def plain_features(text):
    words = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", (text or "").translate(LOWER))
    return words, [*words, *(f"{a} {b}" for a, b in itertools.pairwise(words))]


def test_feature_hashes_against_zlib():
    texts = ["", None, "One", "one TWO, three-4 ÄÖ élan", "x" * 300 + " y " + "z" * 64 + " " + "w" * 65 + " end", "a" * 5000, "... !", "日本語 text\x00more", "q w " * 500]
    words, pairs, at = resample.feature_hashes(pa.array(texts))
    for k, text in enumerate(texts):
        plain, features = plain_features(text)
        mine = [*words[at[k] : at[k + 1]], *pairs[at[k] : max(at[k], at[k + 1] - 1)]]
        assert mine == [zlib.crc32(f.encode()) for f in features], text


def test_resampling_against_a_plain_loop(spark):
    rng = random.Random(3)
    vocabulary = [f"w{i}" for i in range(200)] + ["Ü", "naïve", "x" * 90]
    text = lambda n, k: " ".join(rng.choices(vocabulary[:k], k=n))
    docs = [(i, text(rng.choice([0, 1, 19, 20, 50]), rng.choice([20, 200, 203])), i) for i in range(300)] + [(7, text(30, 50), 0), (5, None, 0), (None, text(25, 60), 0)]
    docs.append(docs[9])
    target = [(text(40, 30),) for _ in range(20)] + [(None,)]
    corpus, wanted, rows = Counter(), Counter(), []
    for _, t, _ in docs:
        corpus.update(zlib.crc32(f.encode()) % 1000 for f in plain_features(t)[1])
    for (t,) in target:
        wanted.update(zlib.crc32(f.encode()) % 1000 for f in plain_features(t)[1])
    s_all, t_all = sum(corpus.values()), sum(wanted.values())
    gain = {b: math.floor(1000 * math.log((wanted[b] + 1) * (s_all + 1000) / ((corpus[b] + 1) * (t_all + 1000)))) for b in range(1000)}
    for i, t, _ in docs:
        words, features = plain_features(t)
        weight = sum(gain[zlib.crc32(f.encode()) % 1000] for f in features) // len(features) if features else 0
        h = int(hashlib.sha256(f"s:{'' if i is None else i}".encode()).hexdigest()[:8], 16)
        rows.append((i, len(words), len(features), weight, weight + math.floor(-1000 * math.log(-math.log((h + 0.5) / 4294967296)))))
    able = sorted((r for r in rows if r[1] >= 20), key=lambda r: (-r[4], r[0] is None, r[0] or 0, r[2]))
    drawn = 30 * len(able) // 100
    expected = Counter([(*r, k + 1 if k < drawn else None) for k, r in enumerate(able)] + [(*r, None) for r in rows if r[1] < 20])
    frame = spark.createDataFrame(docs, "doc_id long, text string, score long")
    wish = spark.createDataFrame(target, "text string")
    done = resample.resample(frame, wish, percent=30, buckets=1000, seed="s")
    assert Counter(map(tuple, done.select("doc_id", "n_words", "n_features", "weight", "score", "rank").collect())) == expected
    kept = resample.resample(frame, wish.limit(0), buckets=50, keep=("doc_id", "text")).where("rank is not null").collect()
    assert len(kept) == 25 * len(able) // 100 and all(len(r.text) > 0 for r in kept)
    assert resample.resample(frame.limit(0), wish).collect() == []


# --- token files ----------------------------------------------------------

TEXTS = [
    "", None, "Hello wörld  don't 123   x", "The <|endoftext|> and <|ENDOFTEXT|>", "Ünï İstanbul ΣΑΣ ς J̌ é", "tab\tnew\nline\x0b\x1c\x85 　wide", "日本語 テスト", "a" * 3000, "!!!---'''s't 're'll", "Å Ⅷ ① ﬁ",
    "word " * 4000, "🙂🙂 ok", "éÅ",
]


@pytest.mark.parametrize("name", ["word_bpe_49k.json", "byte_bpe_50k.json"])
def test_chunks_are_encoded_as_texts_are(name):
    import public_tokenizers
    from tokenizers import Tokenizer

    plain = Tokenizer.from_file(public_tokenizers.path(name))
    mine = ChunkEncoder(public_tokenizers.path(name), "<u2")
    for text in TEXTS:
        assert np.frombuffer(mine.encode(text or ""), "<u2").tolist() == plain.encode(text or "", add_special_tokens=False).ids, text
    assert id_kind(public_tokenizers.path(name), 1) == "<u2" and id_kind(public_tokenizers.path(name), 1 << 16) == "<u4"


@pytest.mark.parametrize("end", [1, 1 << 20])
def test_token_files_round_trip(spark, end):
    import public_tokenizers
    from tokenizers import Tokenizer

    plain = Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json"))
    docs = [(i * 7 % 100 - 20, t, i) for i, t in enumerate(TEXTS * 6)] + [(None, "no id", 0), (None, None, 0), (3, "again", 0), (3, "again", 0)]
    folder = scratch_folder(spark)
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        parts = write_token_files(spark.createDataFrame(docs, "doc_id long, text string, start int"), folder, end=end)
    finally:
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    assert len(parts) > 1 and [p["base"] for p in parts] == [0, *itertools.accumulate(p["ids"] for p in parts)][:-1]
    rows = sorted(read_token_files(spark, folder).collect(), key=lambda r: r.start)
    assert [r.doc_id for r in rows] == sorted((d[0] for d in docs), key=lambda i: (i is not None, i or 0))
    at = 0
    for r in rows:
        assert r.start == at and len(r.ids) == 4 * r.n_tokens
        at += r.n_tokens
    ids = lambda t: [*plain.encode(t or "", add_special_tokens=False).ids, end]
    assert Counter((r.doc_id, bytes(r.ids)) for r in rows) == Counter((i, np.array(ids(t), "<u4").tobytes()) for i, t, _ in docs)
    flat = mapped(f"{folder}/{parts[0]['name']}.bin", "<u2" if end == 1 else "<u4")
    assert flat[-1] == end and len(flat) == parts[0]["ids"]


def test_token_files_of_an_empty_table_and_of_lost_attempts(spark):
    folder = scratch_folder(spark)
    assert write_token_files(spark.createDataFrame([], "doc_id long, text string"), folder) == []
    assert read_token_files(spark, folder).collect() == []
    folder = scratch_folder(spark)
    path = folder.removeprefix("file://")
    open(f"{path}/part-000000-lost.bin", "wb").write(b"junk")
    parts = write_token_files(spark.createDataFrame([(1, "one")], "doc_id long, text string"), folder)
    import os

    assert sorted(os.listdir(path)) == sorted([f"{parts[0]['name']}{x}" for x in (".bin", ".off", ".doc")] + ["manifest.json"])
    assert json.load(open(f"{path}/manifest.json"))["parts"] == parts


def test_token_file_query_from_files(spark, sf_dir):
    import public_tokenizers
    from tokenizers import Tokenizer

    plain = Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json"))
    at, expected = 0, {}
    for r in spark.read.parquet(f"{sf_dir}/documents.parquet").orderBy("doc_id").collect():
        ids = np.array([*plain.encode(r.text or "", add_special_tokens=False).ids, 1], "<u4")
        expected[r.doc_id] = (at, len(ids), zlib.crc32(ids.tobytes()))
        at += len(ids)
    found = queries.op13_token_files(spark, sf_dir).collect()
    assert {r.doc_id: (r.start, r.n_tokens, r.ids_crc32) for r in found} == expected and len(found) == len(expected)


def test_resampling_query_draws_a_quarter(spark, sf_dir):
    done = queries.op12_importance_resampling(spark, sf_dir)
    ranks = sorted(r.rank for r in done.where(F.col("rank").isNotNull()).collect())
    assert ranks == list(range(1, len(ranks) + 1)) and len(ranks) > 10
