"""Queries over one-page documents: counts, masking, search, blocks, vectors, redaction."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quire.functions.expressions import word_count
from quire.operators import ledger, meaning, redact, search, text
from quire.plans.catalog import query
from quire.sources.adapters import document_lines, table

# Fixed value for SQL: what separates words.
W = r"[^\x{0000}-\x{0020}\x{00A0}\x{202A}-\x{202E}]+"
WS = r"[ \t\n\r\f\x0b]+"
PHRASE = "of the"
EMAIL = r"[A-Za-z0-9._%+-]+@[A-Za-z0-9.-]+\.[A-Za-z]{2,}"


@query(f"""select source, count(*) page_count, sum(len(regexp_extract_all(text, '{W}')))::bigint word_count,
  sum(length(text))::bigint char_count from documents group by source""")
def doc_count(spark: SparkSession, sf_dir: str) -> DataFrame:
    return text.counts(table(spark, sf_dir, "documents"), "source")


@query(f"""select lang, count(*) page_count, sum(len(regexp_extract_all(text, '{W}')))::bigint word_count,
  sum(length(text))::bigint char_count, count(distinct text) distinct_texts from documents group by lang""")
def doc_count_by_lang(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    distinct = docs.groupBy("lang", F.sha2("text", 256).alias("h")).count().groupBy("lang").agg(F.count("*").alias("distinct_texts"))
    return text.counts(docs, "lang").join(distinct, "lang")


@query(f"""with c as (select source, count(*) page_count, sum(len(regexp_extract_all(text, '{W}')))::bigint word_count,
    sum(length(text))::bigint char_count from documents group by source),
  h as (select source, count(*) hit_pages, sum(len(regexp_extract_all(text, '(?i)of{WS}the')))::bigint hits from documents
    where regexp_matches(text, '(?i)of{WS}the') group by source)
  select c.*, coalesce(hit_pages, 0) hit_pages, coalesce(hits, 0)::bigint hits from c left join h using (source)""")
def doc_count_with_hits(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    hits = search.hits(docs, PHRASE).groupBy("source").agg(F.count("*").alias("hit_pages"), F.sum("hits").alias("hits"))
    zero = lambda c: F.coalesce(c, F.lit(0)).alias(c)
    return text.counts(docs, "source").join(hits, "source", "left").select("source", "page_count", "word_count", "char_count", zero("hit_pages"), zero("hits"))


@query(rf"""select doc_id, regexp_replace(text, '({EMAIL})|([0-9]{{3,}})', '[REDACTED]', 'g') as text,
  len(regexp_extract_all(text, '({EMAIL})|([0-9]{{3,}})'))::bigint masks from documents""")
def text_mask(spark: SparkSession, sf_dir: str) -> DataFrame:
    return text.mask(table(spark, sf_dir, "documents").select("doc_id", "text"), rf"({EMAIL})|([0-9]{{3,}})")


@query(f"""select doc_id, len(regexp_extract_all(text, '(?i)of{WS}the'))::bigint hits from documents
  where regexp_matches(text, '(?i)of{WS}the')""")
def search_all(spark: SparkSession, sf_dir: str) -> DataFrame:
    return search.hits(table(spark, sf_dir, "documents").select("doc_id", "text"), PHRASE).select("doc_id", "hits")


@query(f"""select doc_id, line, len(regexp_extract_all(t, '(?i)in{WS}the'))::bigint hits from (
  select doc_id, unnest(string_split(text, chr(10))) t, generate_subscripts(string_split(text, chr(10)), 1) - 1 line from documents)
  where regexp_matches(t, '(?i)in{WS}the')""")
def search_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    return search.hits(document_lines(spark, sf_dir), "in the").select("doc_id", "line", "hits")


@query(f"""with c as (select source, doc_id, len(regexp_extract_all(text, '(?i)the'))::bigint hits from documents),
  b as (select *, coalesce(sum(hits) over (partition by source order by doc_id rows between unbounded preceding and 1 preceding), 0) before from c)
  select source, count(*) filter (before < 40) pages_visited, least(sum(case when before < 40 then hits else 0 end), 40)::bigint hits,
  (sum(case when before < 40 then hits else 0 end) > 40 or bool_or(before >= 40)) truncated from b group by source""")
def search_limited(spark: SparkSession, sf_dir: str) -> DataFrame:
    return search.limited(table(spark, sf_dir, "documents"), "the", 40, "source", "doc_id")


@query(f"""with d as (select doc_id, trim(regexp_replace(text, '{WS}', ' ', 'g')) t from documents),
  b as (select item_id, trim(regexp_replace(text, '{WS}', ' ', 'g')) t from benchmark)
  select doc_id, item_id from d join b on contains(d.t, b.t) where b.t <> ''""")
def search_many(spark: SparkSession, sf_dir: str) -> DataFrame:
    return search.many(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"), "doc_id", "item_id")


@query("""with l as (select doc_id, unnest(string_split(text, chr(10))) t, generate_subscripts(string_split(text, chr(10)), 1) - 1 line from documents),
  b as (select *, row_number() over (partition by doc_id order by line) - 1 block from l where regexp_matches(t, '[^ \\t\\n\\r\\f\\x0b]')),
  s as (select *, max(block) over (partition by doc_id) m from b where block between 5 and 15)
  select doc_id, line, block, t as text, case when m = 15 then 15::bigint end next_block from s where block < 15""")
def text_blocks_page(spark: SparkSession, sf_dir: str) -> DataFrame:
    return text.blocks(document_lines(spark, sf_dir), [F.col("line")], start=5, most=10).select("doc_id", "line", "block", "text", "next_block")


@query("""with f as (select user_id, ts, event_id, event_type, value, case when lag(event_type) over w is not distinct from event_type
    and row_number() over w > 1 then 0 else 1 end n from events window w as (partition by user_id order by ts, event_id)),
  i as (select *, sum(n) over (partition by user_id order by ts, event_id rows unbounded preceding)::bigint island from f)
  select user_id, island, event_type, count(*) runs, min(ts) first_ts, max(ts) last_ts, sum(value::decimal(18,2))::decimal(38,2) total
  from i group by user_id, island, event_type""")
def passages(spark: SparkSession, sf_dir: str) -> DataFrame:
    marked = text.islands(table(spark, sf_dir, "events"), ["user_id"], ["ts", "event_id"], "event_type")
    total = F.sum(F.col("value").cast("decimal(18,2)")).cast("decimal(38,2)").alias("total")
    return marked.groupBy("user_id", "island", "event_type").agg(F.count("*").alias("runs"), F.min("ts").alias("first_ts"), F.max("ts").alias("last_ts"), total)


_COS = "list_dot_product(e.embedding::double[], q.query::double[]) / (sqrt(list_dot_product(e.embedding::double[], e.embedding::double[])) * sqrt(list_dot_product(q.query::double[], q.query::double[])))"


@query(f"""with q as (select embedding as query from embeddings where vec_id = 0)
  select vec_id, label, floor({_COS} * 10000 + 0.5)::bigint score4 from embeddings e, q order by score4 desc, vec_id limit 20""")
def meaning_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    vectors = table(spark, sf_dir, "embeddings")
    one = vectors.where("vec_id = 0").select(F.col("embedding").alias("query"))
    return meaning.top(meaning.scored(vectors, one), 20, "vec_id").select("vec_id", "label", "score4")


@query(f"""with f as (select label, unnest(embedding) x, generate_subscripts(embedding, 1) i from embeddings),
  m as (select label, i, sum(floor(x::double * 1000000 + 0.5)::bigint) / count(*) x from f group by label, i),
  q as (select label, list(x order by i) as query from m group by label),
  s as (select vec_id, e.label, floor({_COS} * 10000 + 0.5)::bigint score4 from embeddings e join q on e.label = q.label)
  select vec_id, label, score4, row_number() over (partition by label order by score4 desc, vec_id) as rank from s""")
def meaning_rank_all(spark: SparkSession, sf_dir: str) -> DataFrame:
    vectors = table(spark, sf_dir, "embeddings")
    return meaning.ranks(vectors, meaning.centroids(vectors, "label"), "label", "vec_id").select("vec_id", "label", "score4", "rank")


@query(f"""with t as (select doc_id, unnest(regexp_extract_all(text, '{W}')) w from documents)
  select doc_id, count(*) word_count, count(*) filter (regexp_matches(w, '(?i)^(the|token)')) redactions,
  count(*) filter (not regexp_matches(w, '(?i)^(the|token)')) kept from t group by doc_id""")
def redact_words(spark: SparkSession, sf_dir: str) -> DataFrame:
    return redact.word_counts(table(spark, sf_dir, "documents"), "(?i)^(the|token)")


@query("""with f as (select distinct doc_id from labels where toxic = 1 or quality = 0)
  select source, count(*) cleared, sum(n_chars)::bigint chars from documents d where exists (select 1 from f where f.doc_id = d.doc_id) group by source""")
def redact_semi(spark: SparkSession, sf_dir: str) -> DataFrame:
    flagged = table(spark, sf_dir, "labels").where("toxic = 1 or quality = 0")
    cleared = redact.by_name(table(spark, sf_dir, "documents"), flagged, "doc_id")
    return cleared.groupBy("source").agg(F.count("*").alias("cleared"), F.sum("n_chars").alias("chars"))


@query("""select d.doc_id, d.source, coalesce(l.quality, -1) quality, coalesce(l.toxic, 0) toxic,
  case when l.toxic = 1 then 'high' when l.quality = 0 then 'medium' else 'low' end risk from documents d left join labels l on d.doc_id = l.doc_id""")
def findings_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, labels = table(spark, sf_dir, "documents").select("doc_id", "source"), table(spark, sf_dir, "labels")
    joined = docs.join(labels, "doc_id", "left")
    risk = F.when(F.col("toxic") == 1, "high").when(F.col("quality") == 0, "medium").otherwise("low")
    return joined.select("doc_id", "source", F.coalesce("quality", F.lit(-1)).alias("quality"), F.coalesce("toxic", F.lit(0)).alias("toxic"), risk.alias("risk"))


@query("""select doc_id, replace(text, 'The', 'THE') as text, ((length(text) - length(replace(text, 'The', ''))) // 3)::bigint replacements
  from documents where contains(text, 'The')""")
def edit_replace(spark: SparkSession, sf_dir: str) -> DataFrame:
    return redact.replace_text(table(spark, sf_dir, "documents").select("doc_id", "text"), "The", "THE")


@query("""with r as (select doc_id, doc_id as last_used, octet_length(encode(text))::bigint row_bytes from documents),
  s as (select *, sum(row_bytes) over (order by last_used desc, doc_id desc rows unbounded preceding)::bigint running_bytes from r)
  select doc_id, row_bytes, running_bytes from s where running_bytes <= 1000000""")
def cache_lru(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    cache = docs.select("doc_id", F.col("doc_id").alias("last_used"), F.octet_length("text").cast("bigint").alias("row_bytes"))
    return ledger.evict(cache, 1_000_000, "doc_id").select("doc_id", "row_bytes", "running_bytes")


@query("""select source, count(*) page_count, sum(octet_length(encode(text)))::bigint row_bytes,
  case when sum(octet_length(encode(text))) >= 1048576 then printf('%.1fMB', sum(octet_length(encode(text))) / 1048576.0)
  when sum(octet_length(encode(text))) >= 1024 then printf('%.1fKB', sum(octet_length(encode(text))) / 1024.0)
  else sum(octet_length(encode(text)))::bigint::varchar || 'B' end size from documents group by source""")
def cache_sizes(spark: SparkSession, sf_dir: str) -> DataFrame:
    from quire.functions.expressions import human_size

    rows = table(spark, sf_dir, "documents").withColumn("row_bytes", F.octet_length("text").cast("bigint"))
    return ledger.cache_sizes(rows, "source").withColumn("size", human_size(F.col("row_bytes")))


@query("""with o as (select doc_id, n_chars, 0 v from documents where lang <> 'fr'), n as (select doc_id, n_chars + 1 n_chars, 1 v from documents where lang in ('fr', 'en'))
  select doc_id, n_chars, v from n union all select * from o where doc_id not in (select doc_id from n)""")
def cache_upsert(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    old = docs.where("lang <> 'fr'").select("doc_id", "n_chars", F.lit(0).alias("v"))
    new = docs.where("lang in ('fr', 'en')").select("doc_id", (F.col("n_chars") + 1).alias("n_chars"), F.lit(1).alias("v"))
    return ledger.upsert(old, new, ["doc_id"])


@query(rf"""select doc_id, len(regexp_extract_all(text, '{EMAIL}'))::bigint hits from documents where regexp_matches(text, '{EMAIL}')""")
def search_regex(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = search.python_hits(table(spark, sf_dir, "documents"), EMAIL)
    return found.groupBy("doc_id").agg(F.count("*").alias("hits"))


@query(f"""select doc_id, len(regexp_extract_all(text, '{W}'))::bigint word_count from documents
  where len(regexp_extract_all(text, '{W}')) > 1000""")
def long_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", word_count(F.col("text")).alias("word_count"))
    return docs.where("word_count > 1000")
