"""Queries over ``documents`` as sources and their lines as spans."""

from __future__ import annotations

from pyspark.sql import functions as F

from factloom.functions import ids, numbers, text
from factloom.operators import dedup, select
from factloom.sources import pages
from factloom.sources.tables import table

#: Words of the synthetic languages: the default lexicon has no hit in invented prose.
LEXICON = ("the", "and", "der", "und", "les", "que", "los", "para")
SPAN_BUDGET, FIT_BUDGET, CHUNK, PIECE = 2000, 300, 2000, 400


def document_spans(spark, sf_dir, *more):
    """``(doc_id, ord, text)``: lines with text, from 1."""
    lines = F.filter(F.transform(F.split("text", "\n", -1), text.clean_text), lambda x: x != "")
    rows = table(spark, sf_dir, "documents").select("doc_id", *more, F.posexplode(lines).alias("pos", "text"))
    return rows.select("doc_id", *more, (F.col("pos") + 1).cast("long").alias("ord"), "text")


SPANS = r"""spans as (
  select doc_id, lang, source, unnest(l) as text, unnest(range(1, len(l) + 1)) as ord
  from (select doc_id, lang, source, list_filter(list_transform(string_split(text, chr(10)), lambda x: trim(regexp_replace(x, '\s+', ' ', 'g'))), lambda x: x <> '') as l from documents))"""


def span_split(spark, sf_dir):
    """Ordered spans of every document."""
    return document_spans(spark, sf_dir).select("doc_id", "ord", F.length("text").cast("long").alias("chars"), F.sha2("text", 256).alias("digest"))


SPAN_SPLIT = f"with {SPANS} select doc_id, ord, length(text)::bigint as chars, sha256(text) as digest from spans"


def span_word_boundary_split(spark, sf_dir):
    """Lines in pieces of at most 400 characters, cut at words."""
    rows = document_spans(spark, sf_dir).withColumn("p", pages.split_words(F.col("text"), size=PIECE))
    return rows.select("doc_id", "ord", F.posexplode("p").alias("piece", "t")).select("doc_id", "ord", F.col("piece").cast("long").alias("piece"), F.length("t").cast("long").alias("chars"), F.sha2("t", 256).alias("digest"))


SPAN_WORD_BOUNDARY_SPLIT = f"""
with recursive {SPANS},
cut as (
  select doc_id, ord, 0 as piece, text as rest, '' as t, true as seed from spans
  union all
  select doc_id, ord, case when seed then 0 else piece + 1 end,
         ltrim(substring(rest, stop + 1)), trim(left(rest, stop)), false
  from (
    select *, case when length(rest) <= {PIECE} then length(rest)
              when strpos(reverse(left(rest, {PIECE} + 1)), ' ') > 0 and {PIECE} + 1 - strpos(reverse(left(rest, {PIECE} + 1)), ' ') > {PIECE // 2}
              then {PIECE} + 1 - strpos(reverse(left(rest, {PIECE} + 1)), ' ') else {PIECE} end as stop
    from cut where rest <> ''))
select doc_id, ord, piece::bigint as piece, length(t)::bigint as chars, sha256(t) as digest from cut where not seed"""


def span_stats_by_lang(spark, sf_dir):
    """Spans and sizes by language."""
    rows = document_spans(spark, sf_dir, "lang")
    return rows.groupBy("lang").agg(F.count_distinct("doc_id").alias("documents"), F.count("*").alias("spans"), F.sum(F.length("text")).alias("chars"), F.sum(F.octet_length("text")).alias("bytes"))


SPAN_STATS_BY_LANG = f"with {SPANS} select lang, count(distinct doc_id) as documents, count(*) as spans, sum(length(text))::bigint as chars, sum(strlen(text))::bigint as bytes from spans group by lang"


def span_rank_topk(spark, sf_dir):
    """The six spans of most substance of each document."""
    rows = document_spans(spark, sf_dir).withColumn("rank", text.span_rank(F.col("text"), lexicon=LEXICON))
    return select.top_k(rows, ["doc_id"], [F.desc("rank"), F.asc("ord")], 6).select("doc_id", "ord", F.col("rank").cast("long").alias("rank"), F.col("rn").cast("long").alias("rn"))


_RANK = f"least(12, len(list_filter(regexp_extract_all(lower(text), '[\\pL\\pN_]+'), lambda w: w in ({', '.join(repr(w) for w in LEXICON)}))))"
SPAN_RANK_TOPK = f"""
with {SPANS}, ranked as (select *, {_RANK}::bigint as rank from spans),
numbered as (select *, row_number() over (partition by doc_id order by rank desc, ord) as rn from ranked)
select doc_id, ord, rank, rn from numbered where rn <= 6"""


def byte_budget_prefix(spark, sf_dir):
    """Whole spans, longest first, while their bytes stay within 2000 a document."""
    rows = document_spans(spark, sf_dir).withColumn("bytes", F.octet_length("text"))
    out = select.running_prefix(rows, ["doc_id"], [F.desc("bytes"), F.asc("ord")], "bytes", SPAN_BUDGET)
    return out.select("doc_id", "ord", "used")


BYTE_BUDGET_PREFIX = f"""
with {SPANS}, running as (
  select doc_id, ord, sum(strlen(text)) over (partition by doc_id order by strlen(text) desc, ord rows unbounded preceding)::bigint as used from spans)
select * from running where used <= {SPAN_BUDGET}"""


def byte_budget_exact(spark, sf_dir):
    """Spans in order until 2000 bytes of a document are used up, the last one cut at a whole character."""
    rows = document_spans(spark, sf_dir)
    return select.byte_budget(rows, ["doc_id"], ["ord"], "text", "ord", budget=SPAN_BUDGET).select("doc_id", "ord", F.octet_length("text").cast("long").alias("bytes"))


BYTE_BUDGET_EXACT = f"""
with recursive {SPANS}, queue as (select doc_id, ord, text, row_number() over (partition by doc_id order by ord) as rn from spans),
fold as (
  select doc_id, 0::bigint as rn, 0::bigint as ord, 0::bigint as bytes, {SPAN_BUDGET}::bigint as room from (select distinct doc_id from queue)
  union all
  select doc_id, rn, ord, bytes, room - bytes from (
    select q.doc_id, q.rn, q.ord, f.room, case when f.room <= 0 then 0 when strlen(q.text) <= f.room then case when trim(q.text) <> '' then strlen(q.text) else 0 end
      else list_max(list_transform(list_filter(range(0, length(q.text)), lambda k: strlen(q.text[1:k]) <= f.room and (k = 0 or trim(q.text[1:k]) <> '')), lambda k: case when k = 0 then 0 else strlen(q.text[1:k]) end)) end as bytes
    from fold f join queue q on q.doc_id = f.doc_id and q.rn = f.rn + 1))
select doc_id, ord, bytes from fold where bytes > 0"""


def first_fit_budget(spark, sf_dir):
    """Spans, longest first, that still fit in 300 characters a document; others are passed over."""
    rows = document_spans(spark, sf_dir).withColumn("chars", F.length("text"))
    return select.first_fit(rows, ["doc_id"], [("chars", True), ("ord", False)], "chars", FIT_BUDGET, item="ord").select("doc_id", "ord", "chars", F.col("pos").cast("long").alias("pos"))


FIRST_FIT_BUDGET = f"""
with recursive {SPANS},
queue as (select doc_id, ord, length(text) as chars, row_number() over (partition by doc_id order by length(text) desc, ord) as rn from spans),
fold as (
  select doc_id, 0::bigint as rn, 0::bigint as used, null::bigint as ord, 0::bigint as chars, false as kept, -1::bigint as pos from (select distinct doc_id from spans)
  union all
  select q.doc_id, q.rn, case when f.used + q.chars <= {FIT_BUDGET} then f.used + q.chars else f.used end, q.ord, q.chars,
         f.used + q.chars <= {FIT_BUDGET}, case when f.used + q.chars <= {FIT_BUDGET} then f.pos + 1 else f.pos end
  from fold f join queue q on q.doc_id = f.doc_id and q.rn = f.rn + 1)
select doc_id, ord, chars, pos from fold where kept"""


def round_robin_interleave(spark, sf_dir):
    """Turns of spans when sources take them by length, one each."""
    rows = document_spans(spark, sf_dir, "source").withColumn("chars", F.length("text"))
    out = select.interleaved(rows, ["source"], [F.desc("chars"), F.asc("doc_id"), F.asc("ord")], [F.col("source")])
    return out.select("source", "doc_id", "ord", F.col("turn").cast("long").alias("turn"))


ROUND_ROBIN_INTERLEAVE = f"with {SPANS} select source, doc_id, ord, row_number() over (partition by source order by length(text) desc, doc_id, ord) as turn from spans"


def bucket_round_robin(spark, sf_dir):
    """Documents of each language in turns over sources, sources in order of their longest document."""
    rows = table(spark, sf_dir, "documents").select("doc_id", "lang", "source", "n_chars")
    out = select.bucket_round_robin(rows, ["lang"], ["source"], [F.desc("n_chars"), F.asc("doc_id")])
    return out.select("lang", "source", "doc_id", F.col("turn").cast("long").alias("turn"), F.col("bucket_order").cast("long").alias("bucket_order"))


BUCKET_ROUND_ROBIN = """
with ranked as (select lang, source, doc_id, row_number() over (partition by lang order by n_chars desc, doc_id) as r from documents)
select lang, source, doc_id, row_number() over (partition by lang, source order by r) as turn, min(r) over (partition by lang, source) as bucket_order from ranked"""


def chunk_pack(spark, sf_dir):
    """Consecutive spans in chunks of at most 2000 characters, 150 of them for each span's frame."""
    rows = document_spans(spark, sf_dir).withColumn("chars", F.length("text"))
    out = select.chunks(rows, ["doc_id"], "ord", "chars", limit=CHUNK)
    return out.select("doc_id", "ord", F.col("chunk").cast("long").alias("chunk"))


CHUNK_PACK = f"""
with recursive {SPANS},
fold as (
  select doc_id, 0::bigint as ord, 0::bigint as size, 0::bigint as chunk from (select distinct doc_id from spans)
  union all
  select s.doc_id, s.ord, case when f.size > 0 and f.size + length(s.text) + 150 > {CHUNK} then length(s.text) + 150 else f.size + length(s.text) + 150 end,
         case when f.size > 0 and f.size + length(s.text) + 150 > {CHUNK} then f.chunk + 1 else f.chunk end
  from fold f join spans s on s.doc_id = f.doc_id and s.ord = f.ord + 1)
select doc_id, ord, chunk from fold where ord > 0"""


def chunk_halving(spark, sf_dir):
    """Each document's spans in halves until a part fits 2000 characters or is one span."""
    rows = document_spans(spark, sf_dir).withColumn("chars", F.length("text")).select("doc_id", "ord", "chars")
    return select.halved(rows, ["doc_id"], "ord", "chars", limit=CHUNK).select("doc_id", "ord", F.col("part").cast("long").alias("part"))


CHUNK_HALVING = f"""
with recursive {SPANS}, numbered as (select doc_id, ord, row_number() over w - 1 as i, sum(length(text) + 150) over w as total from spans window w as (partition by doc_id order by ord)),
node as (
  select doc_id, 0::bigint as low, count(*) as high, sum(length(text) + 150)::bigint as size from spans group by doc_id
  union all
  select doc_id, low, high, size from (
    select n.doc_id, case when side = 0 then low else low + (high - low) // 2 end as low, case when side = 0 then low + (high - low) // 2 else high end as high,
      (select max(total) from numbered x where x.doc_id = n.doc_id and x.i = (case when side = 0 then low + (high - low) // 2 else high end) - 1)
        - coalesce((select max(total) from numbered x where x.doc_id = n.doc_id and x.i = (case when side = 0 then low else low + (high - low) // 2 end) - 1), 0) as size
    from node n, (values (0), (1)) t(side) where high - low > 1 and size > {CHUNK})),
leaf as (select *, row_number() over (partition by doc_id order by low) - 1 as part from node where high - low = 1 or size <= {CHUNK})
select x.doc_id, ord, part from numbered x join leaf l on l.doc_id = x.doc_id and i >= low and i < high"""


def batch_shrink(spark, sf_dir):
    """Each source's documents as one batch, spans dropped or halved until 20000 characters are left."""
    rows = document_spans(spark, sf_dir, "source")
    return select.shrunk(rows, ["source"], "doc_id", "ord", "text", limit=20_000).select("source", "doc_id", "ord", F.length("text").cast("long").alias("chars"))


def chunk_coverage_ratio(spark, sf_dir):
    """Spans of at least 200 characters against all, where they differ."""
    return select.coverage(document_spans(spark, sf_dir), ["doc_id"], F.length("text") >= 200)


CHUNK_COVERAGE_RATIO = f"with {SPANS} select * from (select doc_id, count(*) filter (length(text) >= 200) as chosen, count(*) as total from spans group by doc_id) where chosen <> total"


def chunk_best_rank(spark, sf_dir):
    """Chunks by the best rank of their spans."""
    rows = document_spans(spark, sf_dir).withColumn("chars", F.length("text")).withColumn("rank", text.span_rank(F.col("text"), lexicon=LEXICON))
    out = select.chunks(rows, ["doc_id"], "ord", "chars", limit=CHUNK)
    return out.groupBy("doc_id", F.col("chunk").cast("long").alias("chunk")).agg(F.max("rank").cast("long").alias("rank"), F.count("*").alias("spans"))


CHUNK_BEST_RANK = f"""
with recursive {SPANS},
fold as (
  select doc_id, 0::bigint as ord, 0::bigint as size, 0::bigint as chunk from (select distinct doc_id from spans)
  union all
  select s.doc_id, s.ord, case when f.size > 0 and f.size + length(s.text) + 150 > {CHUNK} then length(s.text) + 150 else f.size + length(s.text) + 150 end,
         case when f.size > 0 and f.size + length(s.text) + 150 > {CHUNK} then f.chunk + 1 else f.chunk end
  from fold f join spans s on s.doc_id = f.doc_id and s.ord = f.ord + 1)
select f.doc_id, f.chunk, max({_RANK})::bigint as rank, count(*) as spans from fold f join spans s using (doc_id, ord) group by f.doc_id, f.chunk"""


def content_hash_dedup(spark, sf_dir):
    """Every document with the first one of the same content."""
    rows = table(spark, sf_dir, "documents").select("doc_id", F.sha2("text", 256).alias("content_hash"))
    return dedup.first_of(rows, "content_hash", "doc_id").select("doc_id", "content_hash", "kept_id")


CONTENT_HASH_DEDUP = "select doc_id, sha256(text) as content_hash, min(doc_id) over (partition by sha256(text)) as kept_id from documents"


def kept_documents(spark, sf_dir):
    """In each source, documents that share content, or a made-up URL (id modulo 40), with a kept one give way to it."""
    rows = table(spark, sf_dir, "documents").select("source", F.col("doc_id").alias("ord"), F.concat(F.lit("https://a.com/"), (F.col("doc_id") % 40).cast("string")).alias("url"), F.sha2("text", 256).alias("content_hash"))
    return dedup.kept_documents(rows, ["source"]).select("source", F.col("ord").alias("doc_id"), "kept_ord")


KEPT_DOCUMENTS = """
with recursive queue as (select source, doc_id, 'u' || doc_id % 40 as u, 'd' || sha256(text) as d, row_number() over (partition by source order by doc_id) as rn from documents),
fold as (
  select source, 0::bigint as rn, 0::bigint as doc_id, 0::bigint as kept_ord, map {}::map(varchar, bigint) as seen from (select distinct source from documents)
  union all
  select source, rn, doc_id, coalesce(old, doc_id), case when old is null then map_concat(seen, map([u, d], [doc_id, doc_id])) else seen end from (
    select q.source, q.rn, q.doc_id, q.u, q.d, f.seen, coalesce(map_extract_value(f.seen, q.u), map_extract_value(f.seen, q.d)) as old
    from fold f join queue q on q.source = f.source and q.rn = f.rn + 1))
select source, doc_id, kept_ord from fold where rn > 0"""


def stable_ids(spark, sf_dir):
    """Ids from canonical JSON of ASCII fields."""
    canon = ids.ascii_json(doc_id=F.col("doc_id"), n_chars=F.col("n_chars"), source=F.col("source"))
    return table(spark, sf_dir, "documents").select("doc_id", ids.stable_id("doc", canon).alias("id"), ids.fingerprint(canon).alias("fingerprint"))


_CANON = """'{"doc_id":' || doc_id || ',"n_chars":' || coalesce(n_chars::varchar, 'null') || ',"source":' || coalesce('"' || source || '"', 'null') || '}'"""
STABLE_IDS = f"select doc_id, 'doc_' || left(sha256({_CANON}), 16) as id, sha256({_CANON}) as fingerprint from documents"


def span_identities(spark, sf_dir):
    """Identities of sources and spans from URL and content hash."""
    rows = document_spans(spark, sf_dir)
    docs = table(spark, sf_dir, "documents").select("doc_id", ids.source_identity(F.concat(F.lit("https://a.com/"), F.col("doc_id").cast("string")), F.sha2("text", 256)).alias("identity"))
    return rows.join(docs, "doc_id").select("doc_id", "ord", ids.span_id(F.col("identity"), F.col("ord")).alias("span_id"))


SPAN_IDENTITIES = f"""
with {SPANS}, named as (select doc_id, left(sha256('https://a.com/' || doc_id || chr(0) || sha256(text)), 24) as identity from documents)
select s.doc_id, s.ord, 'sp_' || identity || '_' || lpad(ord::varchar, 4, '0') as span_id from spans s join named n using (doc_id)"""


def readability_filter(spark, sf_dir):
    """Documents with enough text and letters, and no short page behind a barrier."""
    return table(spark, sf_dir, "documents").where(text.readable(F.col("text"))).select("doc_id")


READABILITY_FILTER = f"""
select doc_id from documents
where length(text) >= 40 and length(regexp_replace(text, '[^\\pL]', '', 'g')) >= 20
  and not (length(text) < 500 and ({' or '.join(f"contains(lower(text), '{b}')" for b in text.BARRIERS)}))"""


def nested_documents(spark, sf_dir):
    """Documents put together again from their spans."""
    from factloom.operators.report import nested

    rows = document_spans(spark, sf_dir).withColumn("span_id", F.col("ord").cast("string")).withColumn("section", F.lit(None).cast("string"))
    return nested(rows, ["doc_id"]).select("doc_id", F.size("spans").cast("long").alias("spans"), F.sha2("text", 256).alias("digest"))


NESTED_DOCUMENTS = f"with {SPANS} select doc_id, count(*) as spans, sha256(string_agg(text, chr(10) || chr(10) order by ord)) as digest from spans group by doc_id"


def token_estimates(spark, sf_dir):
    """Budgeted tokens of each document as one request."""
    return table(spark, sf_dir, "documents").select("doc_id", numbers.token_estimate(F.length("text")).alias("tokens"))


TOKEN_ESTIMATES = "select doc_id, (ceil((ceil(length(text) / 4) + 64) * 1.25) + 256)::bigint as tokens from documents"


def gap_dedup_cap(spark, sf_dir):
    """Gaps (source, language) noted by documents: once each, in order of first note, ten a language, the last counting the rest."""
    gaps = table(spark, sf_dir, "documents").select("lang", F.col("source").alias("area"), (F.col("doc_id") % 3).cast("string").alias("detail"), F.col("doc_id").alias("ord"))
    return select.capped_gaps(gaps, ["lang"], 10).select("lang", "area", "detail", F.col("rn").cast("long").alias("rn"))


GAP_DEDUP_CAP = """
with own as (select lang, source as area, (doc_id % 3)::varchar as detail, min(doc_id) as ord from documents group by all),
ranked as (select *, row_number() over (partition by lang order by ord, area, detail) as rn, count(*) over (partition by lang) as n from own)
select lang, case when n > 10 and rn = 10 then 'limits' else area end as area,
       case when n > 10 and rn = 10 then (n - 9) || ' more gaps' else detail end as detail, rn
from ranked where rn <= 10"""

QUERIES = (
    span_split, span_word_boundary_split, span_stats_by_lang, span_rank_topk, byte_budget_prefix, byte_budget_exact, first_fit_budget, round_robin_interleave,
    bucket_round_robin, chunk_pack, chunk_halving, batch_shrink, chunk_coverage_ratio, chunk_best_rank, content_hash_dedup, kept_documents, stable_ids,
    span_identities, readability_filter, nested_documents, token_estimates, gap_dedup_cap,
)
