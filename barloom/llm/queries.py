"""The registered queries of this package: each applies one operator to the whole of its table."""

from __future__ import annotations

from collections.abc import Callable
from functools import wraps

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import bpe, chat, langid, mixing, neighbors, prefixes, quality, sentences, simhash, substring, token_files, warc, whitening
from .common import small_batches


def op1_llr_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.judge(spark.read.parquet(f"{sf_dir}/documents.parquet"), spark.read.parquet(f"{sf_dir}/labels.parquet"))


def op2_chat_snapshots(spark: SparkSession, sf_dir: str) -> DataFrame:
    return chat.format_chats(spark.read.parquet(f"{sf_dir}/conversations.parquet"))


def tokenizer_file(name: str) -> str:
    """The path of a public tokenizer's file; the operators themselves take any path."""
    import public_tokenizers

    return public_tokenizers.path(name)


def op3_bpe_roundtrip(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = tokenizer_file("byte_bpe_50k.json")
    documents = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    return bpe.digests(bpe.encode(documents, path, decoded=True))


def op4_multiprobe_neighbors(spark: SparkSession, sf_dir: str) -> DataFrame:
    return neighbors.nearest(spark.read.parquet(f"{sf_dir}/embeddings.parquet"), F.col("vec_id") % 20 == 0, 20)


def op5_token_planes(spark: SparkSession, sf_dir: str) -> DataFrame:
    documents = spark.read.parquet(f"{sf_dir}/documents.parquet")
    files = token_files.write_tokens(documents, tokenizer_file("word_bpe_49k.json"))
    return token_files.read_tokens(files).select("doc_id", "start", "n_tokens", F.crc32("ids").alias("ids_crc32"))


def op6_substring_repeats(spark: SparkSession, sf_dir: str) -> DataFrame:
    return substring.repeats(spark.read.parquet(f"{sf_dir}/documents.parquet")).drop("spans")


def op7_simhash_components(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash.near_duplicates(spark.read.parquet(f"{sf_dir}/documents.parquet"))


def op8_source_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    documents = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "source", "text")
    rows = mixing.with_copies(documents).withColumn("size", mixing.n_words(F.col("text")))
    return rows.select("doc_id", "size", "source_size", "target", (F.col("copies") * F.col("size")).alias("taken"))


def op9_warc_roundtrip(spark: SparkSession, sf_dir: str) -> DataFrame:
    files = warc.archive(spark, spark.read.parquet(f"{sf_dir}/pages.parquet"))
    return warc.read_warc(files, payloads=False).select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


def op10_ppm_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    return langid.identify(spark.read.parquet(f"{sf_dir}/documents.parquet"))


def op11_prefix_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    return prefixes.prefix_trie(spark.read.parquet(f"{sf_dir}/conversations.parquet"))


def op12_whitening(spark: SparkSession, sf_dir: str) -> DataFrame:
    return whitening.whiten(spark.read.parquet(f"{sf_dir}/embeddings.parquet"))


def op13_sentence_spans(spark: SparkSession, sf_dir: str) -> DataFrame:
    documents = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    return sentences.digests(sentences.encode(documents, tokenizer_file("piece_bpe_32k.model"), decoded=True))


_QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_llr_quality": op1_llr_quality,
    "op2_chat_snapshots": op2_chat_snapshots,
    "op3_bpe_roundtrip": op3_bpe_roundtrip,
    "op4_multiprobe_neighbors": op4_multiprobe_neighbors,
    "op5_token_planes": op5_token_planes,
    "op6_substring_repeats": op6_substring_repeats,
    "op7_simhash_components": op7_simhash_components,
    "op8_source_mix": op8_source_mix,
    "op9_warc_roundtrip": op9_warc_roundtrip,
    "op10_ppm_language": op10_ppm_language,
    "op11_prefix_trie": op11_prefix_trie,
    "op12_whitening": op12_whitening,
    "op13_sentence_spans": op13_sentence_spans,
}


def _with_small_batches(f: Callable[[SparkSession, str], DataFrame]) -> Callable[[SparkSession, str], DataFrame]:
    return wraps(f)(lambda spark, sf_dir: f(small_batches(spark), sf_dir))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {name: _with_small_batches(f) for name, f in _QUERIES.items()}

ORACLES: dict[str, str] = {
    "op2_chat_snapshots": r"""
with rows as (
  select distinct conv_id, coalesce(turn, -1) as turn, coalesce(role, '') as role, coalesce(text, '') as text
  from conversations where conv_id is not null),
turns as (
  select conv_id, turn, row_number() over (partition by conv_id order by turn) as place, count(*) as n,
    string_agg(role || chr(31) || text || chr(30), '' order by role, text) as said,
    string_agg('<|' || role || '|>' || chr(10) || text || '<|end|>' || chr(10), '' order by role, text) as shown
  from rows group by conv_id, turn),
prefixes as (
  select conv_id, turn, sum(n) over w as n, md5(string_agg(place || ':' || said, '') over w) as h
  from turns window w as (partition by conv_id order by turn rows between unbounded preceding and current row)),
ends as (select conv_id, max(n) as n, arg_max(h, n) as h from prefixes group by conv_id),
whole as (select n, h, min(conv_id) as conv_id, count(*) as n_copies from ends group by n, h),
proper as (select distinct p.n, p.h from prefixes p join ends e on p.conv_id = e.conv_id where p.n < e.n),
kept as (select * from whole where not exists (select 1 from proper where proper.n = whole.n and proper.h = whole.h))
select k.conv_id, cast(floor(t.turn / 512) as bigint) as part, cast(any_value(k.n) as bigint) as n_turns,
  any_value(k.n_copies) as n_copies, string_agg(t.shown, '' order by t.turn) as rendered
from kept k join turns t on k.conv_id = t.conv_id group by k.conv_id, floor(t.turn / 512)
""",
    "op8_source_mix": r"""
with sized as (
  select doc_id, source, coalesce(len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')), 0) as size from documents),
sources as (
  select source, cast(sum(size) as bigint) as source_size, row_number() over (order by source nulls last) as nth from sized group by source),
weighed as (
  select *, cast([5, 2, 1][1 + (nth - 1) % 3] as double) as weight, cast(source_size * 2 as double) as most from sources),
levels as (
  select *, (sum(source_size) over () * 1.5 - coalesce(sum(most) over before, 0.0))
    / (sum(weight) over () - coalesce(sum(weight) over before, 0.0)) as level
  from weighed window before as (order by most / weight, nth rows between unbounded preceding and 1 preceding)),
found as (select arg_min(level, struct_pack(r := most / weight, nth := nth)) as level from levels where most >= weight * level),
targets as (
  select source, source_size, coalesce(least(most, weight * (select level from found)), most) as target from levels),
rated as (select *, case when source_size > 0 then target / source_size else 0.0 end as rate from targets)
select doc_id, size, source_size, target,
  cast((floor(rate) + case when
    cast('0x' || substr(md5(coalesce(cast(doc_id as varchar), 'null') || ':0'), 1, 13) as bigint) / 4503599627370496.0
    < rate - floor(rate) then 1 else 0 end) * size as bigint) as taken
from sized s join rated r on s.source is not distinct from r.source
""",
    "op9_warc_roundtrip": r"""
with p as (select page_id, coalesce(html, '') as html from pages),
w as (select page_id, html, strlen(html) as n, max(page_id) over (partition by html) as response from p)
select page_id, n as payload_bytes, sha1(html) as payload_digest,
  case when n >= 1000 and page_id < response then 'revisit' else 'response' end as record_type,
  case when n >= 1000 and page_id < response then response end as refers_to
from w
""",
    "op11_prefix_trie": r"""
with said as (
  select conv_id, turn, md5(length(coalesce(role, '')) || ':' || coalesce(role, '') || coalesce(text, '')) as said,
    coalesce(len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')), 0) as words
  from conversations where conv_id is not null),
numbered as (select conv_id, said, words, row_number() over (partition by conv_id order by turn nulls first, said) as nth from said),
known as (
  select conv_id, conv_id - conv_id % 20 as family,
    (4294967295 - list_reduce(list_prepend(4294967295::bigint, list_transform(string_split(conv_id::varchar, ''), lambda x: ascii(x)::bigint)),
      lambda c, b: list_reduce(list_prepend(xor(c, b), [0, 0, 0, 0, 0, 0, 0, 0]::bigint[]), lambda u, v: xor(u >> 1, (u & 1) * 3988292384)))) % 4 as h
  from (select distinct conv_id from numbered)),
turns as (
  select k.conv_id, t.nth as depth, t.said, t.words from known k join numbered t on t.conv_id = k.family where t.nth <= k.h
  union all
  select k.conv_id, t.nth - k.h + least(k.h, coalesce(f.n, 0)), t.said, t.words
  from known k join numbered t on t.conv_id = k.conv_id left join (select conv_id, count(*) as n from numbered group by conv_id) f on f.conv_id = k.family
  where t.nth > k.h),
ways as (
  select conv_id, depth, words, md5(string_agg(said, '') over (partition by conv_id order by depth rows unbounded preceding)) as node from turns
  union all select conv_id, 0, 0, '' from known),
steps as (select *, lag(node) over (partition by conv_id order by depth) as parent, depth = max(depth) over (partition by conv_id) as last from ways),
nodes as (
  select node, min(conv_id) as conv_id, any_value(depth) as depth, any_value(parent) as parent, count(*) as n_convs, (count(*) - 1) * any_value(words) as saved,
    sha256(coalesce(string_agg(conv_id::varchar, ',' order by conv_id) filter (last), '')) as ends_sha256
  from steps group by node),
children as (select parent as node, count(*) as n from nodes where parent is not null group by parent),
rolled as (
  select w.node, count(*) filter (c.n is null) as n_leaves, sum(x.saved) as saved_tokens
  from nodes x left join children c on c.node = x.node join ways w on w.conv_id = x.conv_id and w.depth <= x.depth group by w.node)
select n.conv_id, n.depth::bigint as depth, p.conv_id as parent_conv_id, n.n_convs, coalesce(c.n, 0) as n_children, r.n_leaves, r.saved_tokens::bigint as saved_tokens, n.ends_sha256
from nodes n join rolled r on r.node = n.node left join nodes p on p.node = n.parent left join children c on c.node = n.node
""",
}
