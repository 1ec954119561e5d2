"""URL rules by Bloom filter cascades: exact membership without a join.

A cascade answers "is this key listed?" exactly for every key of a known universe.  Level
1 encodes the listed keys; level 2 the keys of the universe that level 1 takes for listed
though they aren't; level 3 the listed keys that level 2 holds by mistake; and so on,
until a level makes no mistake.  The universe here is complete: every (host suffix, path
prefix) key that any URL of the corpus can be matched by.  Each level is hashed anew, so
no pair of keys collides at all levels.

The filters' size follows the list and its mistakes, not the corpus.  `MOST_BYTES` bounds
what is broadcast: keys of a longer list are dealt into classes by hash, each with its own
cascades, and the URLs go through one class after the other.
"""

from __future__ import annotations

import math
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from trailmill.session import cut

MOST_BYTES = 256 << 20
#: False positives of levels after the first.
LATER_RATE = 0.5
#: Bits of a filter that are put together and gathered as one value.
PLANE = 1 << 22
SEED = 42  # Spark's xxhash64


@dataclass
class Level:
    name: str
    bits: int
    probes: int
    words: np.ndarray

    def holds(self, key: str) -> bool:
        one = xxhash.xxh64_intdigest(f"{self.name}a{key}", SEED)
        two = xxhash.xxh64_intdigest(f"{self.name}b{key}", SEED) | 1
        for j in range(self.probes):
            at = ((one + j * two) & ((1 << 63) - 1)) % self.bits
            if not int(self.words[at >> 6]) >> (at & 63) & 1:
                return False
        return True


@dataclass
class Cascade:
    levels: list[Level] = field(default_factory=list)

    def __contains__(self, key: str) -> bool:
        for k, level in enumerate(self.levels):
            if not level.holds(key):
                return k % 2 == 1
        return len(self.levels) % 2 == 1


def build_level(keys: DataFrame, name: str, rate: float) -> Level:
    """A filter of the distinct `key` values, put together by a distributed bit-or."""
    n = keys.count()
    bits = max(64, 64 * math.ceil(-n * math.log(rate) / math.log(2) ** 2 / 64))
    probes = max(1, round(bits / max(n, 1) * math.log(2)))
    probes = min(probes, max(1, math.ceil(-math.log2(rate))))
    one = F.xxhash64(F.concat(F.lit(f"{name}a"), "key"))
    two = F.xxhash64(F.concat(F.lit(f"{name}b"), "key")).bitwiseOR(F.lit(1))
    hashed = keys.select(one.alias("one"), two.alias("two"))
    # (one + j * two) mod 2^63, as in Level.holds; decimals keep the 64-bit sums exact.
    at = F.expr(f"pmod(pmod(cast(one as decimal(38,0)) + j * cast(two as decimal(38,0)), cast({1 << 63} as decimal(38,0))), cast({bits} as decimal(38,0)))")
    spread = hashed.select("one", "two", F.explode(F.array(*[F.lit(j) for j in range(probes)])).alias("j")).select(at.cast("long").alias("at"))
    planes = spread.select("at", F.expr(f"cast(at div {PLANE} as int)").alias("plane")).repartition("plane").mapInArrow(_planes, "plane int, bytes binary").collect()
    table = np.zeros(-(-bits // PLANE) * (PLANE // 64), np.uint64)
    for r in planes:  # a plane may come from several tasks
        table[r.plane * (PLANE // 64) : (r.plane + 1) * (PLANE // 64)] |= np.frombuffer(r.bytes, np.uint64)
    return Level(name, bits, probes, table[: bits // 64].copy())


def _planes(batches):
    """Bits at `at` of each plane of `PLANE` bits, as bytes."""
    held: dict[int, np.ndarray] = {}
    for batch in batches:
        at, plane = batch.column("at").to_numpy(), batch.column("plane").to_numpy()
        for p in np.unique(plane):
            words = held.setdefault(int(p), np.zeros(PLANE // 64, np.uint64))
            inside = (at[plane == p] - int(p) * PLANE).astype(np.uint64)
            np.bitwise_or.at(words, (inside >> np.uint64(6)).astype(np.int64), np.uint64(1) << (inside & np.uint64(63)))
    for p, words in held.items():
        yield pa.RecordBatch.from_arrays([pa.array([p], pa.int32()), pa.array([words.tobytes()], pa.binary())], names=["plane", "bytes"])


def _passing(level, wanted: bool = True):
    def run(batches):
        for batch in batches:
            keys = batch.column("key")
            mask = pa.array([level.value.holds(k) == wanted for k in keys.to_pylist()], pa.bool_())
            yield pa.RecordBatch.from_arrays([keys.filter(mask)], names=["key"])

    return run


def build_cascade(listed: DataFrame, universe: DataFrame, name: str) -> Cascade:
    """A cascade of the `key` column of `listed`, exact on `universe` (one column, `key`)."""
    spark = universe.sparkSession
    listed = cut(listed.select("key").where("key is not null").distinct(), "listed")
    n = listed.count()
    if n == 0:
        return Cascade()
    others = universe.agg(F.approx_count_distinct("key")).first()[0] or 1
    rate = min(LATER_RATE, max(1e-6, n / (math.sqrt(2) * others)))
    levels: list[Level] = []
    encoded, tested = listed, universe
    while True:
        level = build_level(encoded, f"{name}{len(levels)}", rate)
        levels.append(level)
        passing = tested.mapInArrow(_passing(spark.sparkContext.broadcast(level)), "key string").distinct()
        if len(levels) == 1:
            passing = passing.join(listed, "key", "left_anti")
        mistaken = cut(passing, "mistaken")
        if mistaken.isEmpty():
            return Cascade(levels)
        encoded, tested = mistaken, encoded
        rate = LATER_RATE


def url_parts(url: str = "url") -> tuple:
    """(host, path): host up to `/ ? #` in lower ASCII case, path up to `? #`; without `://` both empty."""
    rest = F.when(F.instr(url, "://") > 0, F.expr(f"substring({url}, instr({url}, '://') + 3)")).otherwise(F.lit(""))
    host = F.translate(F.regexp_extract(rest, r"^([^/?#]*)", 1), "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    path = F.regexp_extract(rest, r"^[^/?#]*([^?#]*)", 1)
    return F.coalesce(host, F.lit("")), F.coalesce(path, F.lit(""))


def candidate_keys(host: str, path: str, lengths: list[int]):
    """All rules that could fit, longest first: each host suffix with each path prefix of a rule's length."""
    suffixes = f"transform(sequence(1, size(split({host}, '[.]'))), i -> array_join(slice(split({host}, '[.]'), i, size(split({host}, '[.]'))), '.'))"
    prefixes = f"transform(filter(array({','.join(map(str, lengths)) or '0'}), n -> n <= char_length({path})), n -> left({path}, n))"
    pairs = f"flatten(transform({suffixes}, h -> transform({prefixes}, p -> named_struct('a', -char_length(h) - char_length(p), 'b', -char_length(h), 'key', concat(h, p)))))"
    return F.expr(f"transform(array_distinct(array_sort({pairs})), x -> x.key)")


def _judge(allow, block, default: str):
    def run(batches):
        for batch in batches:
            rules, verdicts = [], []
            for keys in batch.column("_keys").to_pylist():
                rule, verdict = None, default
                for key in keys:
                    if key in block.value:
                        rule, verdict = key, "block"
                        break
                    if key in allow.value:
                        rule, verdict = key, "allow"
                        break
                rules.append(rule)
                verdicts.append(verdict)
            names = [c for c in batch.schema.names if c != "_keys"]
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in names), pa.array(rules, pa.string()), pa.array(verdicts, pa.string())], names=[*names, "rule", "verdict"])

    return run


def judge_urls(pages: DataFrame, rules: DataFrame, keep: list[str], default: str = "allow", most_bytes: int = MOST_BYTES) -> DataFrame:
    """Columns `keep` of `pages` with host, path, rule and verdict of each `url`.

    `rules` has verdict (allow or block), host and path.  A rule fits its host and all its
    subdomains where the path starts with the rule's; the longest wins (then the longer
    host), and block wins over allow for the same rule.  What no rule fits is not listed,
    and gets `default`.  A null url has an empty host and path.  Columns of these names in
    `keep` are replaced.
    """
    spark = pages.sparkSession
    keep = [c for c in keep if c not in ("host", "path", "rule", "verdict", "_keys")]
    rules = cut(rules.select("verdict", F.concat("host", "path").alias("key"), F.char_length("path").alias("n")).where("key is not null"), "rules")
    lengths = sorted(r.n for r in rules.select("n").distinct().collect())
    host, path = url_parts()
    keyed = pages.select(*keep, host.alias("host"), path.alias("path")).withColumn("_keys", candidate_keys("host", "path", lengths))
    universe = cut(keyed.select(F.explode("_keys").alias("key")).distinct(), "universe")
    # The first level takes at most ln(10^6) / ln(2)^2 = 29 bits a key; all others together less.
    classes = max(1, -(-rules.count() * 58 // 8 // most_bytes))
    part = lambda table, c: table if classes == 1 else table.where(F.pmod(F.xxhash64("key"), F.lit(classes)) == c)
    schema = T.StructType([*keyed.drop("_keys").schema.fields, T.StructField("rule", T.StringType()), T.StructField("verdict", T.StringType())])

    def cascades(c: int) -> list:
        return [spark.sparkContext.broadcast(build_cascade(part(rules.where(F.col("verdict") == v), c), part(universe, c), f"{v}{c}")) for v in ("allow", "block")]

    if classes == 1:
        return keyed.mapInArrow(_judge(*cascades(0), default), schema)
    # Of what the classes find for a host and path, the longest rule holds: the first of its keys.
    urls = cut(keyed.select("host", "path").distinct().withColumn("_keys", candidate_keys("host", "path", lengths)), "urls")
    slim = T.StructType([f for f in schema.fields if f.name in ("host", "path", "rule", "verdict")])
    found = None
    for c in range(classes):
        mine = urls.withColumn("_keys", F.filter("_keys", lambda k: F.pmod(F.xxhash64(k), F.lit(classes)) == c)).where(F.size("_keys") > 0)
        hits = cut(mine.mapInArrow(_judge(*cascades(c), default), slim).where("rule is not null"), "hits")
        found = hits if found is None else found.unionByName(hits)
    best = found.join(urls, ["host", "path"]).groupBy("host", "path").agg(F.min_by(F.struct("rule", "verdict"), F.array_position("_keys", F.col("rule"))).alias("best"))
    out = keyed.drop("_keys").join(best, ["host", "path"], "left")
    return out.select(*keep, "host", "path", F.col("best.rule").alias("rule"), F.coalesce("best.verdict", F.lit(default)).alias("verdict"))
