"""The registered queries of this subpackage and, where SQL can express them, their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from panelspark.llm import _common as C
from panelspark.llm import chat, crf, decontaminate, importance, jaccard, lines, merkle, packing, pieces, quality, sharding, tokens, warc


def tokenizer_file(name: str = "byte_bpe_50k.json") -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def op4_jaccard(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard.jaccard_groups(C.table(spark, sf_dir, "documents"), percent=75, width=5)


def op5_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, cache = C.table(spark, sf_dir, "documents"), C.scratch_path(spark, "token-cache")
    tokens.token_counts(docs.select("doc_id", "text"), tokenizer_file(), cache)  # fills the cache: every content is a miss
    out = tokens.token_counts(docs, tokenizer_file(), cache, limit=512)  # every content is a hit
    return out.select("doc_id", "n_bytes", "n_tokens", "over_limit")


def op1_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = quality.quality_rules(C.table(spark, sf_dir, "documents"))
    return out.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept", "removed_lines", "removed_chars")


def op2_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = lines.dedup_lines(C.table(spark, sf_dir, "documents"), min_docs=10, shortest=1)
    return out.select("doc_id", "n_lines", "n_dropped", F.sha2("kept_text", 256).alias("kept_sha256"))


def op3_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = packing.pack_documents(C.table(spark, sf_dir, "documents"), tokenizer_file(), window=1024)
    return out.select("doc_id", "start", "length", F.crc32("ids").alias("ids_crc32"), "doc_tokens", "sequence_id", "offset")


def op6_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = sharding.hilbert_shards(C.table(spark, sf_dir, "documents"), shards=40, law="rows")
    return out.select("doc_id", "size", "text_crc32", F.lit("rows").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"), "curve")


def op7_chat_repair(spark: SparkSession, sf_dir: str) -> DataFrame:
    return chat.repair_roles(C.table(spark, sf_dir, "conversations"))


def op8_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = C.table(spark, sf_dir, "documents")
    model = crf.fit(docs.where(~crf.held_out("doc_id")))
    out = crf.label_languages(docs.select("doc_id", "text"), model)
    return out.select("doc_id", crf.held_out("doc_id").alias("held_out"), "lang_pred", "score")


def op9_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = C.table(spark, sf_dir, "pages")
    index = warc.write_archives(pages, C.scratch_path(spark, "warc"), least_revisit=1000)
    return index.read(pages.select("url")).select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


def op10_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = decontaminate.find_leaks(C.table(spark, sf_dir, "documents"), C.table(spark, sf_dir, "benchmark"))
    return found.select("doc_id", "item_id", F.round("cosine", 4).alias("cosine"), F.round("lcs", 4).alias("lcs"), F.round("answer", 4).alias("answer"))


def op11_merkle(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = C.table(spark, sf_dir, "documents")
    lowered = F.translate("text", "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    tampered = F.when(F.crc32(F.col("doc_id").cast("string").cast("binary")) % 3 == 0, lowered).otherwise(F.col("text"))
    columns = ["doc_id", "source", "lang", "n_chars", "text"]
    altered = merkle.leaf_digest(*[F.col(c) if c != "text" else tampered for c in columns])
    manifest = merkle.build_manifest(docs, columns, tree="lang", order="doc_id", carry={"doc_id": F.col("doc_id"), "altered": altered})
    out = merkle.fold(manifest.witnesses(), "altered", ["doc_id", "leaf", "subroot", "root"])
    text = lambda c: F.lower(F.hex(c)).alias(c)
    return out.select("doc_id", text("leaf"), text("subroot"), text("root"), "proof_sha256", text("folded_root"), (F.col("folded_root") == F.col("root")).alias("verified"))


def op12_sentencepiece(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = pieces.encode_pieces(C.table(spark, sf_dir, "documents").select("doc_id", "text"), tokenizer_file("piece_bpe_32k.model"), decode=True)
    ids = F.array_join(F.col("ids").cast("array<string>"), ",")
    return out.select("doc_id", F.size("ids").cast("bigint").alias("n_tokens"), F.sha2(ids, 256).alias("ids_sha256"), F.sha2("decoded", 256).alias("decoded_sha256"))


def op13_importance(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = importance.resample(C.table(spark, sf_dir, "documents"), C.table(spark, sf_dir, "benchmark"), percent=10, least_words=20, longest=1, buckets=10000, seed=2024)
    return out.select("doc_id", "n_features", "weight", "score", "rank")


QUERIES = {
    "op1_quality": op1_quality,
    "op2_line_dedup": op2_line_dedup,
    "op3_packing": op3_packing,
    "op4_jaccard": op4_jaccard,
    "op5_token_counts": op5_token_counts,
    "op6_sharding": op6_sharding,
    "op7_chat_repair": op7_chat_repair,
    "op8_language": op8_language,
    "op9_warc": op9_warc,
    "op10_decontamination": op10_decontamination,
    "op11_merkle": op11_merkle,
    "op12_sentencepiece": op12_sentencepiece,
    "op13_importance": op13_importance,
}
#: The white space of line and word contracts, for trim().
_SPACE = "' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)"
_LOWER = "translate({}, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"

#: Unsigned CRC-32 of a blob's bytes, bit by bit: each byte is xor-ed in at the first of its eight steps.
_CRC = """xor(list_reduce(
    list_prepend(4294967295::bigint, flatten(list_transform(range(1, octet_length({0}) + 1), lambda i: [('0x' || hex({0})[2 * i - 1 : 2 * i])::bigint, 0, 0, 0, 0, 0, 0, 0]))),
    lambda c, b: xor(xor(c, b) >> 1, (xor(c, b) & 1) * 3988292384)), 4294967295)"""

_TOLD = " || ".join(f"coalesce(octet_length(encode(cast({c} as varchar))) || ':' || {c}, '-')" for c in ("doc_id", "source", "lang", "n_chars", "{text}"))

ORACLE_SQL: dict[str, str] = {
    "op11_merkle": f"""
with recursive
     leaf as (select doc_id, lang, row_number() over (partition by lang order by doc_id) - 1 as pos, count(*) over (partition by lang) as n,
                     sha256({_TOLD.format(text="text")}) as h,
                     sha256({_TOLD.format(text=f"(case when {_CRC.format('encode(cast(doc_id as varchar))')} % 3 = 0 then {_LOWER.format('text')} else text end)")}) as altered
              from documents),
     node as (select lang, 0 as lev, pos, n, h from leaf
              union all
              select lang, lev + 1, pos // 8, (n + 7) // 8, sha256(string_agg(h, '' order by pos)) from node where n > 1 group by lang, lev, pos // 8, n),
     tree as (select lang, h as subroot, row_number() over (order by lang nulls first) - 1 as pos, count(*) over () as n from node where n = 1),
     top as (select 0 as lev, pos, n, subroot as h from tree
             union all
             select lev + 1, pos // 8, (n + 7) // 8, sha256(string_agg(h, '' order by pos)) from top where n > 1 group by lev, pos // 8, n),
     path as (select doc_id, lang, 0 as lev, pos, n, altered as cur, '' as sib from leaf
              union all
              select p.doc_id, p.lang, p.lev + 1, p.pos // 8, (p.n + 7) // 8, sha256(string_agg(case when x.pos = p.pos then p.cur else x.h end, '' order by x.pos)),
                     p.sib || coalesce(string_agg(x.h, '' order by x.pos) filter (where x.pos <> p.pos), '')
              from path p join node x on x.lang is not distinct from p.lang and x.lev = p.lev and x.pos // 8 = p.pos // 8
              where p.n > 1 group by p.doc_id, p.lang, p.lev, p.pos, p.n, p.sib),
     up as (select p.doc_id, 0 as lev, t.pos, t.n, p.cur, p.sib, t.subroot from path p join tree t on t.lang is not distinct from p.lang where p.n = 1
            union all
            select p.doc_id, p.lev + 1, p.pos // 8, (p.n + 7) // 8, sha256(string_agg(case when x.pos = p.pos then p.cur else x.h end, '' order by x.pos)),
                   p.sib || coalesce(string_agg(x.h, '' order by x.pos) filter (where x.pos <> p.pos), ''), p.subroot
            from up p join top x on x.lev = p.lev and x.pos // 8 = p.pos // 8
            where p.n > 1 group by p.doc_id, p.lev, p.pos, p.n, p.sib, p.subroot)
select up.doc_id, leaf.h as leaf, subroot, top.h as root, sha256(sib) as proof_sha256, cur as folded_root, cur = top.h as verified
from up join leaf using (doc_id), top where up.n = 1 and top.n = 1""",
    "op13_importance": f"""
with w as (select 'd' as side, doc_id as id, regexp_extract_all({_LOWER.format("coalesce(text, '')")}, '[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+') as w from documents
           union all
           select 'b', row_number() over (), regexp_extract_all({_LOWER.format("coalesce(text, '')")}, '[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+') from benchmark),
     f as (select side, id, unnest(w) as f from w),
     k as (select f, encode(f) as e from (select distinct f from f)),
     b as (select f, {_CRC.format("e")} % 10000 as b from k),
     c as (select b, count(*) filter (side = 'd') as s, count(*) filter (side = 'b') as t from f join b using (f) group by b),
     a as (select coalesce(sum(s), 0)::double as s, coalesce(sum(t), 0)::double as t from c),
     g as (select b, floor(1000 * ln((c.t + 1.0::double) * (a.s + 10000) / ((c.s + 1.0::double) * (a.t + 10000))))::bigint as gain from c, a),
     d as (select id, sum(gain)::bigint as weight from f join b using (f) join g using (b) where side = 'd' group by id),
     p as (select id as doc_id, len(w)::bigint as n_features, coalesce(weight, 0) as weight,
                  coalesce(weight, 0) + floor(-1000 * ln(-ln((('0x' || sha256('2024:' || id)[1:8])::bigint + 0.5::double) / 4294967296)))::bigint as score
           from w left join d using (id) where side = 'd'),
     r as (select doc_id, row_number() over (order by score desc, doc_id) as rank from p where n_features >= 20)
select p.doc_id, n_features, weight, score, case when rank <= 10 * (select count(*) from r) // 100 then rank end as rank
from p left join r using (doc_id)""",
    "op9_warc": """
with p as (select page_id, encode(coalesce(html, '')) as payload from pages),
     s as (select *, max(page_id) over (partition by payload) as keeper, octet_length(payload) as n from p)
select page_id, n as payload_bytes, sha1(payload) as payload_digest,
       case when n >= 1000 and page_id <> keeper then 'revisit' else 'response' end as record_type,
       case when n >= 1000 and page_id <> keeper then keeper end as refers_to
from s""",
    "op4_jaccard": f"""
with recursive w as (
       select doc_id, list_filter(regexp_split_to_array({_LOWER.format("coalesce(text, '')")}, '[\\x20\\x09-\\x0D]+'), lambda x: x <> '') as w
       from documents),
     s as (select distinct doc_id, g from (
             select doc_id, array_to_string(w[i : i + 4], ' ') as g from (select doc_id, w, unnest(range(1, greatest(len(w) - 3, 2))) as i from w where len(w) > 0))),
     n as (select doc_id, count(*) as n from s group by doc_id),
     p as (select a.doc_id as a, b.doc_id as b, count(*) as c from s a join s b on a.g = b.g and a.doc_id <> b.doc_id group by 1, 2),
     e as (select a, b from p join n x on x.doc_id = a join n y on y.doc_id = b where 100 * c >= 75 * (x.n + y.n - c)),
     r(doc_id, reached) as (select doc_id, doc_id from w union select r.doc_id, e.b from r join e on e.a = r.reached)
select w.doc_id, coalesce(n.n, 0) as n_shingles, min(r.reached) as component_id
from w left join n using (doc_id) join r on r.doc_id = w.doc_id group by w.doc_id, n.n""",
    "op1_quality": f"""
with d as (select doc_id, coalesce(text, '') as text, source as host,
                  list_filter(regexp_split_to_array(coalesce(text, ''), '[\\x20\\x09-\\x0D]+'), lambda x: x <> '') as w from documents),
     g as (select doc_id, i, w[i] || ' ' || w[i + 1] || ' ' || w[i + 2] as gram
           from (select doc_id, w, unnest(range(1, len(w) - 1)) as i from d)),
     r as (select doc_id, count(distinct p) as n from (
             select doc_id, unnest([i, i + 1, i + 2]) as p
             from (select *, count(*) over (partition by doc_id, gram) as n from g) where n > 1) group by doc_id),
     l as (select doc_id, host, text, line, trim(line, {_SPACE}) as bare
           from (select *, unnest(string_split(text, chr(10))) as line from d)),
     k as (select doc_id, host, text, line, lower(bare) as key from l where bare <> ''),
     h as (select host, count(distinct doc_id) as n from d group by host),
     c as (select k.host, key from k join h on h.host is not distinct from k.host
           group by k.host, key, h.n having count(distinct doc_id) >= 10 and count(distinct doc_id) > 0.05 * h.n),
     s as (select doc_id, count(*) - count(distinct line) as dups, sum(length(k.key)) as chars,
                  coalesce(sum(length(k.key)) filter (where c.key is not null), 0) as gone, count(c.key) as gone_lines
           from k left join c on c.key = k.key and c.host is not distinct from k.host group by doc_id),
     m as (select d.doc_id, len(w) as n_words, length(array_to_string(w, '')) as word_chars,
                  len(regexp_extract_all(text, '[#*$%&|<>]')) as n_symbols, coalesce(dups, 0) as n_dup_lines,
                  coalesce(r.n, 0) as n_repeat_words, coalesce(chars, 0) as chars, coalesce(gone, 0) as removed_chars, coalesce(gone_lines, 0) as removed_lines
           from d left join r using (doc_id) left join s on s.doc_id = d.doc_id)
select doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words,
       (n_words < 50 or n_repeat_words * 100 > n_words * 50) as base_failed,
       not (n_words < 50 or n_repeat_words * 100 > n_words * 50) and chars - removed_chars >= chars * 0.3 as kept,
       cast(removed_lines as bigint) as removed_lines, cast(removed_chars as bigint) as removed_chars
from m""",
    "op2_line_dedup": f"""
with l as (select doc_id, unnest(string_split(coalesce(text, ''), chr(10))) as line,
                  generate_subscripts(string_split(coalesce(text, ''), chr(10)), 1) as pos from documents),
     k as (select *, {_LOWER.format(f"trim(line, {_SPACE})")} as key from l),
     f as (select key from k where length(key) >= 1 group by key having count(distinct doc_id) >= 10),
     d as (select k.*, f.key is not null as gone from k left join f on k.key = f.key)
select doc_id, count(*) as n_lines, count_if(gone) as n_dropped,
       sha256(coalesce(string_agg(line, chr(10) order by pos) filter (where not gone), '')) as kept_sha256
from d group by doc_id""",
}
