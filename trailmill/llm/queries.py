"""The registered queries of this subpackage and the SQL that checks them."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from trailmill.llm.conversations import repaired_digests
from trailmill.llm.embed_dedup import embedding_components
from trailmill.llm.jaccard import jaccard_components
from trailmill.llm.katz import score_documents
from trailmill.llm.langid import held_out, identify
from trailmill.llm.packing import pack_documents
from trailmill.llm.pii import KINDS, pseudonymise_documents
from trailmill.llm.resample import resample
from trailmill.llm.sharding import shard_documents
from trailmill.llm.sp_lattice import sample_segmentations
from trailmill.llm.token_files import read_token_files, scratch_folder, write_token_files
from trailmill.llm.topk_search import top_k
from trailmill.llm.url_filter import judge_urls


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    done = pseudonymise_documents(_table(spark, sf_dir, "documents"))
    found = [F.coalesce(F.try_element_at("pii", F.lit(k)), F.lit(0)).alias(f"n_{k}") for k in KINDS]
    return done.select("doc_id", "text", *found)


def op2_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack_documents(_table(spark, sf_dir, "documents"))


def op3_topk_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    vectors = _table(spark, sf_dir, "embeddings")
    return top_k(vectors, vectors.where("vec_id % 100 = 0"))


#: Scores are sums of products of whole numbers, which doubles hold exactly at this size.
OP3_SQL = """
with v as (
  select vec_id, list_transform(embedding, lambda x: floor(1024 * cast(x as double))) as q
  from embeddings where len(embedding) > 0 and len(list_filter(embedding, lambda x: x is null or not isfinite(x))) = 0
), scored as (
  select a.vec_id as query_id, b.vec_id, cast(list_dot_product(a.q, b.q) as bigint) as score
  from v a join v b on a.vec_id % 100 = 0 and a.vec_id <> b.vec_id
), ranked as (
  select *, row_number() over (partition by query_id order by score desc, vec_id) as rank from scored
)
select query_id, cast(rank as int) as rank, vec_id, score from ranked where rank <= 10
"""


def op4_embedding_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return embedding_components(_table(spark, sf_dir, "embeddings"), 0.95)


OP4_SQL = """
with recursive v as (
  select vec_id, list_transform(embedding, lambda x: cast(x as double)) as e from embeddings
  where len(embedding) > 0 and len(list_filter(embedding, lambda x: x is null or not isfinite(x))) = 0 and len(list_filter(embedding, lambda x: x <> 0)) > 0
), links as (
  select a.vec_id as src, b.vec_id as dst from v a join v b on a.vec_id <> b.vec_id where list_cosine_similarity(a.e, b.e) >= 0.95
), reached as (
  select vec_id as src, vec_id as dst from embeddings union select r.src, l.dst from reached r join links l on l.src = r.dst
), counts as (select src, count(*) as n from links group by src), least as (select src, min(dst) as c from reached group by src)
select e.vec_id, coalesce(n, 0) as n_links, c as component_id, e.vec_id = c as kept
from embeddings e left join counts on counts.src = e.vec_id join least on least.src = e.vec_id
"""


def op5_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    done = shard_documents(_table(spark, sf_dir, "documents"), 40)
    return done.select("doc_id", "size", "text_crc32", "law", "shard", "slot", "grown_shard")


#: verdict, host and path of the rules (fixed values).
URL_RULES = [
    ("allow", "org", "/"),
    ("block", "example.org", "/es/"),
    ("block", "example.org", "/en/1"),
    ("allow", "com", "/fr/"),
    ("block", "com", "/de/"),
]


def op6_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    rules = spark.createDataFrame(URL_RULES, "verdict string, host string, path string")
    return judge_urls(_table(spark, sf_dir, "pages"), rules, ["page_id"])


OP6_SQL = """
with parts as (
  select page_id, case when url like '%://%' then substr(url, strpos(url, '://') + 3) else '' end as rest from pages
), split as (
  select page_id,
    translate(regexp_extract(rest, '^[^/?#]*'), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') as host,
    regexp_extract(rest, '^[^/?#]*([^?#]*)', 1) as path
  from parts
), judged as (
  select *, case
    when ('.' || host) like '%.example.org' and path like '/en/1%' then 'example.org/en/1'
    when ('.' || host) like '%.example.org' and path like '/es/%' then 'example.org/es/'
    when ('.' || host) like '%.com' and path like '/fr/%' then 'com/fr/'
    when ('.' || host) like '%.com' and path like '/de/%' then 'com/de/'
    when ('.' || host) like '%.org' and path like '/%' then 'org/'
  end as rule from split
)
select page_id, host, path, rule,
  case when rule in ('example.org/en/1', 'example.org/es/', 'com/de/') then 'block' else 'allow' end as verdict
from judged
"""


def op7_sentencepiece_sampling(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents").select("doc_id", "text")
    done = sample_segmentations(docs, k=2)
    return done.select("doc_id", "sample", F.size("ids").cast("long").alias("n_pieces"), "ids", "log_probability", "perturbed", "log_inclusion", "decoded_crc32")


def op8_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    done = identify(_table(spark, sf_dir, "documents"), ["doc_id"])
    return done.select("doc_id", held_out(5).alias("held_out"), "lang_pred", F.col("lang_score").alias("score"))


def op9_ngram_jaccard(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard_components(_table(spark, sf_dir, "documents"), width=4, percent=85)


def op10_lm_scoring(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents").select("doc_id", "text")
    done = score_documents(docs, ~held_out(10))
    return done.select("doc_id", held_out(10).alias("held_out"), "n_tokens", "n_known", "train_tokens", "base_score", "score")


def damaged(rows: DataFrame) -> DataFrame:
    """Conversations with faults planted by a checksum of their places; nulls become one space."""
    space = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(" "))
    fault = F.crc32(F.concat_ws(":", space("conv_id"), space("turn"))) % 20
    text = F.when(fault == 1, "").when(fault == 2, F.regexp_replace(space("text"), "[.!?]", "")).otherwise(space("text"))
    role = F.when(fault == 4, "user").otherwise(space("role"))
    times = F.explode(F.when(fault == 3, F.array(F.lit(0), F.lit(1))).otherwise(F.array(F.lit(0))))
    return rows.where(fault != 0).select("conv_id", "turn", role.alias("role"), text.alias("text"), times.alias("_")).drop("_")


def op11_conversation_repair(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    done = repaired_digests(damaged(rows))
    every = rows.select(F.col("conv_id").alias("_id")).distinct()
    joined = every.join(done, F.col("_id").eqNullSafe(F.col("conv_id")), "left")
    counts = [F.coalesce(c, F.lit(0)).alias(c) for c in ("gaps", "blank", "duplicate", "truncated", "illegal", "cost")]
    return joined.select(F.col("_id").alias("conv_id"), *counts, F.coalesce("audit", F.lit("")).alias("audit"), F.coalesce("repaired_sha256", F.sha2(F.lit(""), 256)).alias("repaired_sha256"))


def op12_importance_resampling(spark: SparkSession, sf_dir: str) -> DataFrame:
    done = resample(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "benchmark"))
    return done.select("doc_id", "n_features", "weight", "score", "rank")


def op13_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    folder = scratch_folder(spark)
    write_token_files(_table(spark, sf_dir, "documents"), folder)
    return read_token_files(spark, folder).select("doc_id", "start", "n_tokens", F.crc32("ids").alias("ids_crc32"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_pii": op1_pii,
    "op2_best_fit_packing": op2_best_fit_packing,
    "op3_topk_search": op3_topk_search,
    "op4_embedding_dedup": op4_embedding_dedup,
    "op5_sharding": op5_sharding,
    "op6_url_filter": op6_url_filter,
    "op7_sentencepiece_sampling": op7_sentencepiece_sampling,
    "op8_language_id": op8_language_id,
    "op9_ngram_jaccard": op9_ngram_jaccard,
    "op10_lm_scoring": op10_lm_scoring,
    "op11_conversation_repair": op11_conversation_repair,
    "op12_importance_resampling": op12_importance_resampling,
    "op13_token_files": op13_token_files,
}

#: CRC-32 in SQL: the table of one byte by its rule, then a byte after another of a text's UTF-8.
_CRC_SQL = r"""
crc_table as (
  select list(list_reduce(range(8), lambda c, i: case when c % 2 = 1 then xor(c // 2, 3988292384) else c // 2 end, n) order by n) as t from range(256) r(n)
), crc_of as (
  select s, xor(list_reduce(list_transform(range(1, length(hex(encode(s))), 2), lambda i: cast('0x' || hex(encode(s))[i:i + 1] as bigint)),
    lambda c, b: xor(c // 256, t[1 + xor(c % 256, b)]), 4294967295), 4294967295) as crc
  from (select distinct s from crc_input), crc_table
)"""

#: Places in the grammar are 1 nothing yet, 2 after s, 3 after u, 4 after a; a place holds the least cost so far and its least audit.
OP11_SQL = (
    r"""
with recursive plain as (
  select conv_id, turn, coalesce(role, ' ') as role, coalesce(text, ' ') as text, coalesce(cast(conv_id as varchar), ' ') || ':' || coalesce(cast(turn as varchar), ' ') as s
  from conversations
), crc_input as (select s from plain), """
    + _CRC_SQL
    + r""", damaged as (
  select conv_id, turn, case when crc % 20 = 4 then 'user' else role end as role,
    case crc % 20 when 1 then '' when 2 then regexp_replace(text, '[.!?]', '', 'g') else text end as text
  from plain join crc_of using (s), range(2) r(n) where crc % 20 <> 0 and (n = 0 or crc % 20 = 3)
), numbered as (
  select *, row_number() over (partition by conv_id order by turn nulls first, role, text) as k, rtrim(text, chr(32) || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)) as body,
    case when left(role, 1) in ('s', 'u', 'a') then left(role, 1) else '?' end as i from damaged
), faults as (
  select *, lag(i) over (partition by conv_id order by k) as before, body = '' as blank,
    body <> '' and row_number() over (partition by conv_id, role, text order by k) > 1 as duplicate from numbered
), judged as (select *, not blank and not duplicate and right(body, 1) not in ('.', '!', '?') as truncated from faults),
counts as (
  select conv_id, coalesce(max(turn) - min(turn) + 1 - count(distinct turn), 0) as gaps, count(*) filter (where blank) as blank, count(*) filter (where duplicate) as duplicate,
    count(*) filter (where truncated) as truncated, count(*) filter (where before is not null and before || i not in ('su', 'ua', 'au')) as illegal, count(*) as n
  from judged group by conv_id
), reached as (
  select conv_id, 0::bigint as k, p as place, c as cost, a as audit from (select distinct conv_id from damaged), (values (1, 0, ''), (3, 3, 'I'), (4, 6, 'II')) v(p, c, a)
  union all
  select conv_id, k, place, best.cost, best.audit from (
    select conv_id, k, place, min(struct_pack(cost := cost, audit := audit)) as best from (
      select conv_id, k, i.target as place, x.cost + i.cost as cost, x.audit || i.letters as audit from (
        select r.conv_id, j.k, e.target, r.cost + e.cost as cost, r.audit || e.letter as audit
        from reached r join judged j on j.conv_id is not distinct from r.conv_id and j.k = r.k + 1,
        lateral (select * from (values
          ('D', 4, r.place, true),
          ('K', 3 * j.truncated::int, case j.i when 's' then 2 when 'u' then 3 else 4 end,
            not j.blank and not j.duplicate and case j.i when 's' then r.place = 1 when 'u' then r.place <> 3 when 'a' then r.place = 3 else false end),
          ('R', 3 + 3 * j.truncated::int, case when r.place = 3 then 4 else 3 end, not j.blank and not j.duplicate)
        ) v(letter, cost, target, allowed) where allowed) e
      ) x join (values (1, 1, 0, ''), (2, 2, 0, ''), (3, 3, 0, ''), (4, 4, 0, ''), (1, 3, 3, 'I'), (1, 4, 6, 'II'), (2, 3, 3, 'I'), (2, 4, 6, 'II'), (3, 4, 3, 'I'), (4, 3, 3, 'I')) i(source, target, cost, letters) on i.source = x.target
    ) group by conv_id, k, place
  )
), best as (
  select conv_id, min(struct_pack(cost := r.cost, audit := r.audit)) as b from reached r join counts c using (conv_id) where r.k = c.n and r.place in (1, 4) group by conv_id
), letters as (
  select conv_id, b.audit as audit, unnest(range(1, length(b.audit) + 1)) as pos from best
), edits as (
  select conv_id, pos, audit[pos] as letter, sum(case when audit[pos] <> 'I' then 1 else 0 end) over (partition by conv_id order by pos) as k,
    sum(case when audit[pos] <> 'D' then 1 else 0 end) over (partition by conv_id order by pos) as place from letters
), kept as (
  select e.*, j.role, j.text, j.i, first_value(case when letter = 'K' and j.i = 's' then 1 else 0 end) over (partition by e.conv_id order by e.pos) as first_system
  from edits e left join judged j on j.conv_id = e.conv_id and j.k = e.k and e.letter <> 'I' where letter <> 'D'
), texts as (
  select conv_id, string_agg(case letter when 'K' then role || ':' || text else case when (place - first_system) % 2 = 1 then 'user' else 'assistant' end || ':' || case when letter = 'I' then '' else text end end,
    chr(10) order by pos) as whole from kept group by conv_id
)
select d.conv_id, coalesce(gaps, 0) as gaps, coalesce(blank, 0) as blank, coalesce(duplicate, 0) as duplicate, coalesce(truncated, 0) as truncated, coalesce(illegal, 0) as illegal,
  coalesce(b.cost, 0) as cost, coalesce(b.audit, '') as audit, sha256(coalesce(whole, '')) as repaired_sha256
from (select distinct conv_id from conversations) d left join counts using (conv_id) left join best using (conv_id) left join texts using (conv_id)
"""
)

OP12_SQL = (
    r"""
with words as (
  select true as corpus, doc_id, text from documents union all select false, null, text from benchmark
), split as (
  select corpus, doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') as w from words
), features as (
  select corpus, doc_id, unnest(list_concat(w, list_transform(range(1, len(w)), lambda i: w[i] || ' ' || w[i + 1]))) as s from split
), crc_input as (select s from features), """
    + _CRC_SQL
    + r""", bucketed as (select corpus, doc_id, crc % 10000 as bucket from features join crc_of using (s)),
totals as (select count(*) filter (where corpus) as s_all, count(*) filter (where not corpus) as t_all from bucketed),
gains as (
  select bucket, floor(1000 * ln((t + 1)::double * (s_all + 10000)::double / ((s + 1)::double * (t_all + 10000)::double)))::bigint as gain
  from (select bucket, count(*) filter (where corpus) as s, count(*) filter (where not corpus) as t from bucketed group by bucket), totals
), weights as (
  select doc_id, count(*) as n_features, floor(sum(gain)::double / count(*))::bigint as weight from bucketed join gains using (bucket) where corpus group by doc_id
), scored as (
  select doc_id, len(w) as n_words, coalesce(n_features, 0) as n_features, coalesce(weight, 0) as weight,
    coalesce(weight, 0) + floor(-1000 * ln(-ln((cast('0x' || left(sha256('7:' || doc_id), 8) as bigint) + 0.5::double) / 4294967296)))::bigint as score
  from split left join weights using (doc_id) where corpus
), ranks as (
  select *, row_number() over (partition by n_words >= 20 order by score desc, doc_id) as r, floor(25 * count(*) filter (where n_words >= 20) over () / 100) as drawn from scored
)
select doc_id, n_features, weight, score, case when n_words >= 20 and r <= drawn then r end as rank from ranks
"""
)

OP9_SQL = r"""
with recursive w as (
  select doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') as words from documents
), s as (
  select distinct doc_id, unnest(case when len(words) = 0 then [] when len(words) < 4 then [array_to_string(words, ' ')]
    else list_transform(range(1, len(words) - 2), lambda i: concat_ws(' ', words[i], words[i + 1], words[i + 2], words[i + 3])) end) as shingle from w
), n as (select doc_id, count(*) as n from s group by doc_id),
common as (select a.doc_id as src, b.doc_id as dst, count(*) as k from s a join s b on a.shingle = b.shingle and a.doc_id <> b.doc_id group by 1, 2),
links as (select src, dst from common join n x on x.doc_id = src join n y on y.doc_id = dst where 100 * k >= 85 * (x.n + y.n - k)),
reached as (select doc_id as src, doc_id as dst from documents union select r.src, l.dst from reached r join links l on l.src = r.dst),
least as (select src, min(dst) as c from reached group by src)
select d.doc_id, coalesce(n.n, 0) as n_shingles, c as component_id from documents d left join n using (doc_id) join least on least.src = d.doc_id
"""

ORACLE_SQL: dict[str, str] = {"op3_topk_search": OP3_SQL, "op4_embedding_dedup": OP4_SQL, "op6_url_filter": OP6_SQL, "op9_ngram_jaccard": OP9_SQL, "op11_conversation_repair": OP11_SQL, "op12_importance_resampling": OP12_SQL}
