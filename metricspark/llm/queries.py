"""The queries of this subpackage, and their SQL twins where SQL can express them."""

from __future__ import annotations

import functools
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

import public_tokenizers

from metricspark.llm import bpe, chat, lexical, quality, urls, warc
from metricspark.llm.alignment import align
from metricspark.llm.decontamination import with_leaks
from metricspark.llm.embeddings import range_join
from metricspark.llm.frames import hex_sha256, small_batches, table
from metricspark.llm.jaccard import jaccard_join
from metricspark.llm.lines import dedup_lines
from metricspark.llm.sharding import SHARDS, lay_out
from metricspark.llm.surrogates import replace_pii

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def query(f: Callable[[SparkSession, str], DataFrame]) -> Callable[[SparkSession, str], DataFrame]:
    @functools.wraps(f)
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        small_batches(spark)
        return f(spark, sf_dir)

    QUERIES[f.__name__] = run
    return run


@query
def op1_ngram_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard_join(table(spark, sf_dir, "documents"))


@query
def op3_benchmark_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = with_leaks(table(spark, sf_dir, "documents").select("doc_id", "text"), table(spark, sf_dir, "benchmark"))
    leak = found.select("doc_id", F.explode("leaks").alias("leak"))
    return leak.select("doc_id", F.col("leak.item").alias("item_id"), "leak.windows", "leak.matched", "leak.changed")


@query
def op4_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return dedup_lines(docs).select("doc_id", "n_lines", "n_dropped", hex_sha256(F.col("text")).alias("kept_sha256"))


ORACLES["op4_line_dedup"] = r"""
with lines as (
  select doc_id, unnest(string_split(coalesce(text, ''), chr(10))) as line, generate_subscripts(string_split(coalesce(text, ''), chr(10)), 1) as pos
  from documents
), keyed as (
  select doc_id, line, pos,
    translate(trim(line, ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)),
      'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') as key
  from lines
), repeated as (
  select key, max(doc_id) as last from keyed where length(key) >= 20 group by key having count(distinct doc_id) >= 3
), marked as (
  select k.doc_id, k.line, k.pos, r.key is not null and k.doc_id is distinct from r.last as gone
  from keyed k left join repeated r on k.key = r.key
)
select doc_id, count(*) as n_lines, sum(gone::int)::bigint as n_dropped,
  sha256(coalesce(string_agg(line, chr(10) order by pos) filter (not gone), '')) as kept_sha256
from marked group by doc_id
"""


HELD_OUT = "pmod(crc32(cast(cast(doc_id as string) as binary)), 5) = 0"


@query
def op8_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    labels = table(spark, sf_dir, "labels").where(f"not ({HELD_OUT})")
    scored = quality.classify(docs, quality.fit(docs, labels))
    return scored.select("doc_id", F.expr(HELD_OUT).alias("held_out"), "score", "predicted")


VOCABULARY = public_tokenizers.path("byte_bpe_50k.json")


@query
def op9_bpe_transducer(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    tokenizer = bpe.with_lexicon(docs, "text", VOCABULARY)
    encoded = docs.withColumn("ids", tokenizer.encode(F.col("text")))
    return encoded.select(
        "doc_id",
        F.size("ids").cast("long").alias("n_tokens"),
        bpe.digest_ids(F.col("ids")).alias("ids_sha256"),
        hex_sha256(tokenizer.decode(F.col("ids"))).alias("decoded_sha256"),
    )


@query
def op10_embedding_range_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return range_join(table(spark, sf_dir, "embeddings"))


ORACLES["op10_embedding_range_join"] = """
with recursive usable as (
  select vec_id, embedding::double[] as v from embeddings
  where embedding is not null and len(embedding) > 0
    and len([x for x in embedding if x is null or not isfinite(x)]) = 0
    and len([x for x in embedding if x <> 0]) > 0
), links as (
  select a.vec_id as a, b.vec_id as b from usable a join usable b
    on a.vec_id <> b.vec_id and len(a.v) = len(b.v) and list_cosine_similarity(a.v, b.v) >= 0.9
), reach as (
  select vec_id as a, vec_id as b from embeddings
  union
  select r.a, l.b from reach r join links l on r.b = l.a
), least as (
  select a, min(b) as component_id from reach group by a
), counted as (
  select a, count(*) as n from links group by a
)
select e.vec_id, coalesce(c.n, 0)::bigint as n_links, r.component_id, e.vec_id = r.component_id as kept
from embeddings e join least r on r.a = e.vec_id left join counted c on c.a = e.vec_id
"""


@query
def op2_chat_formatting(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    both = "<|im_end|><|im_start|>assistant ok"
    own = spark.createDataFrame([(-1, 0, "user", both), (-1, 1, "assistant", both)], rows.schema)
    chats = chat.Chats(spark, VOCABULARY)
    read = chats.read(chats.format(rows.unionByName(own)))
    return read.select("conv_id", "n_turns", "turns_sha256", "loss_chars", "loss_sha256", "formatted_chars")


ORACLES["op2_chat_formatting"] = r"""
with rows as (
  select conv_id, turn, coalesce(role, '') as role, coalesce(text, '') as text from conversations
  union all select -1, 0, 'user', '<|im_end|><|im_start|>assistant ok'
  union all select -1, 1, 'assistant', '<|im_end|><|im_start|>assistant ok'
), escaped as (
  select *,
    length(regexp_replace(replace(replace(role, '\', '\\'), chr(10), '\n'), '<(\\*)\|', '<\1\\|', 'g')) as role_chars,
    length(regexp_replace(text, '<(\\*)\|', '<\1\\|', 'g')) as text_chars
  from rows
)
select conv_id, count(*) as n_turns,
  sha256(string_agg(role || chr(10) || text || chr(10), '' order by turn, role, text)) as turns_sha256,
  coalesce(sum(length(text)) filter (role = 'assistant'), 0)::bigint as loss_chars,
  sha256(coalesce(string_agg(text, '' order by turn, text) filter (role = 'assistant'), '')) as loss_sha256,
  sum(12 + role_chars + 1 + text_chars + 10 + 1)::bigint as formatted_chars
from escaped group by conv_id
"""


RULES = [
    ("com", "/", "allow"),
    ("example.com", "/en/", "block"),
    ("www.example.com", "/en/", "allow"),
    ("net", "/es/", "block"),
    ("net", "/fr/", "block"),
]


@query
def op5_url_link_graph(spark: SparkSession, sf_dir: str) -> DataFrame:
    judged = urls.judge(table(spark, sf_dir, "pages"), RULES)
    return judged.select("page_id", "host", "path", "rule", "verdict")


# without links between hosts, trust and distrust of a host are its own pages' shares
ORACLES["op5_url_link_graph"] = f"""
with rests as (
  select page_id, url, case when instr(url, '://') > 0 then substr(url, instr(url, '://') + 3) else '' end as rest from pages
), parts as (
  select page_id, translate(regexp_extract(rest, '^[^/?#]*'), '{urls.UPPER}', '{urls.LOWER}') as host,
    regexp_extract(rest, '^[^/?#]*([^?#]*)', 1) as path
  from (select page_id, coalesce(rest, '') as rest from rests)
), rules(suffix, start, verdict) as (
  values {", ".join(f"('{h}', '{p}', '{v}')" for h, p, v in RULES)}
), fits as (
  select p.page_id, r.suffix || r.start as rule, r.verdict,
    row_number() over (partition by p.page_id order by length(r.suffix || r.start) desc) as place
  from parts p join rules r on (p.host = r.suffix or ends_with(p.host, '.' || r.suffix)) and starts_with(p.path, r.start)
), ruled as (
  select p.page_id, p.host, p.path, f.rule, f.verdict from parts p left join fits f on p.page_id = f.page_id and f.place = 1
), shares as (
  select host, avg(case when verdict = 'block' then 1.0 else 0.0 end) as blocked from ruled where host <> '' group by host
)
select r.page_id, r.host, r.path, r.rule,
  coalesce(r.verdict, case when s.blocked > {urls.THRESHOLD} then 'block' else 'allow' end) as verdict
from ruled r left join shares s on r.host = s.host
"""


@query
def op6_warc_capture_index(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = table(spark, sf_dir, "pages")
    archive = warc.write(pages)
    records = archive.fetch(archive.look_up(pages))
    return records.select(
        F.col("page").alias("page_id"), "payload_bytes", "payload_digest", "record_type", "refers_to"
    )


ORACLES["op6_warc_capture_index"] = """
with digested as (
  select page_id, strlen(coalesce(html, ''))::bigint as payload_bytes, sha256(coalesce(html, '')) as payload_digest from pages
), placed as (
  select *, min(page_id) over (partition by payload_digest) as first from digested
)
select page_id, payload_bytes, payload_digest,
  case when payload_bytes >= 100 and page_id <> first then 'revisit' else 'response' end as record_type,
  case when payload_bytes >= 100 and page_id <> first then first end as refers_to
from placed
"""


@query
def op7_pii_surrogates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return replace_pii(table(spark, sf_dir, "documents").select("doc_id", "text"))


PIECES = public_tokenizers.path("piece_bpe_32k.model")


@query
def op13_cross_tokenizer_alignment(spark: SparkSession, sf_dir: str) -> DataFrame:
    return align(table(spark, sf_dir, "documents"), VOCABULARY, PIECES).documents


@query
def op12_ranked_lexical_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lexical.search(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


_TERMS = r"""unnest(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
    '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+'))"""

ORACLES["op12_ranked_lexical_search"] = f"""
with held as (
  select doc_id, {_TERMS} as term from documents
), lengths as (
  select doc_id, count(*) as n from held group by doc_id
), total as (
  select count(*) as docs, sum(n)::bigint as terms from lengths
), counted as (
  select doc_id, term, count(*) as tf from held group by doc_id, term
), weights as (
  select term, floor(1000 * ln((2 * docs + 2) / (2 * count(*) + 1)))::bigint as w from counted, total group by term, docs
), asked as (
  select item_id, term, count(*) as times from (select item_id, {_TERMS} as term from benchmark) group by item_id, term
), impacts as (
  select doc_id, term, (1000000000 * tf) // (1000 * tf + 8 * (100 - 75 + (75 * n * docs) // terms)) as impact
  from counted join lengths using (doc_id), total where term in (select term from asked)
), scores as (
  select item_id, doc_id, sum(times * w * impact)::bigint as score
  from asked join weights using (term) join impacts using (term) group by item_id, doc_id
), ranked as (
  select *, row_number() over (partition by item_id order by score desc, doc_id)::int as rank from scores where score > 0
)
select item_id, rank, doc_id, score from ranked where rank <= 10
"""


LAW = "rows"


@query
def op11_hilbert_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = lay_out(table(spark, sf_dir, "documents")).shards(SHARDS, LAW)
    text = F.coalesce("text", F.lit(""))
    return rows.select(
        "doc_id",
        (F.octet_length(text) + 1).cast("long").alias("size"),
        F.crc32(text.cast("binary")).alias("text_crc32"),
        F.lit(LAW).alias("law"),
        "shard",
        "slot",
        F.lit(None).cast("int").alias("grown_shard"),
    )
