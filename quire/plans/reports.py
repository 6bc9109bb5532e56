"""Queries over the ledger, web pages, intervals, outlines, annotations, forms and metadata."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quire.functions.expressions import permissions
from quire.operators import annotations, intervals, ledger, outline, preflight
from quire.plans.catalog import query
from quire.sources.adapters import conversation_pages, jobs, table


@query("select event_id id, ts, event_type verb, value duration from events order by event_id desc limit 20")
def jobs_recent(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ledger.recent(jobs(spark, sf_dir)).select("id", "ts", "verb", "duration")


@query("select event_id id, event_type verb from events")
def jobs_all(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ledger.recent(jobs(spark, sf_dir), -1).select("id", "verb")


@query("""select event_type verb, count(*) runs, min(value) least, max(value) most, sum(value::decimal(18,2))::decimal(38,2) total
  from events group by event_type""")
def jobs_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ledger.summary(jobs(spark, sf_dir))


@query("""select event_id id, json_extract_string(props, '$.k') k, length(event_type)::varchar verb_length from events""")
def ledger_detail(spark: SparkSession, sf_dir: str) -> DataFrame:
    detail = F.to_json(F.struct(F.get_json_object("detail", "$.k").cast("bigint").alias("k"), F.col("verb").alias("query")))
    kept = ledger.reduced(detail)
    return jobs(spark, sf_dir).select("id", kept["k"].alias("k"), kept["query"].alias("verb_length"))


@query("""select user_id, event_type, min(event_id) as position, max_by(value, event_id) as value, max_by(props, event_id) props from events group by user_id, event_type""")
def fonts_last_wins(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ledger.first_kept_last_wins(table(spark, sf_dir, "events"), ["user_id", "event_type"], "event_id", ["value", "props"])


@query("""select l_orderkey, l_partkey, l_linenumber from lineitem qualify row_number() over (partition by l_orderkey, l_partkey order by l_linenumber) = 1""")
def images_first_seen(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ledger.newest_entry(table(spark, sf_dir, "lineitem"), ["l_orderkey", "l_partkey"], [F.col("l_linenumber")]).select("l_orderkey", "l_partkey", "l_linenumber")


@query("""select o_custkey, o_orderkey, o_orderdate, o_totalprice from orders
  qualify row_number() over (partition by o_custkey order by o_orderdate desc, o_orderkey desc) = 1""")
def newest_entry_wins(spark: SparkSession, sf_dir: str) -> DataFrame:
    newest = [F.desc("o_orderdate"), F.desc("o_orderkey")]
    return ledger.newest_entry(table(spark, sf_dir, "orders"), ["o_custkey"], newest).select("o_custkey", "o_orderkey", "o_orderdate", "o_totalprice")


_HREF = """regexp_extract_all(html, '(?i)<a [^>]*?href="([^"]*)"', 1)"""


@query(f"select page_id, unnest({_HREF}) href, generate_subscripts({_HREF}, 1) - 1 ord from pages")
def html_links(spark: SparkSession, sf_dir: str) -> DataFrame:
    return preflight.links(table(spark, sf_dir, "pages"))


@query(f"""with l as (select page_id, unnest({_HREF}) u from pages union all select page_id, url from pages
    union all select page_id, replace(url, 'http:', case page_id % 3 when 0 then 'ftp:' when 1 then 'MAILTO:' else 'javascript:' end) from pages),
  k as (select page_id, u, regexp_matches(u, '^[A-Za-z][A-Za-z0-9+.-]*:') or starts_with(u, '//') x, case when contains(u, ':') then lower(split_part(u, ':', 1)) else '' end s from l)
  select page_id, count(*) links, count(*) filter (x) external, count(*) filter (x and s not in ('http', 'https', 'mailto')) unsafe from k group by page_id""")
def unsafe_links(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = table(spark, sf_dir, "pages")
    other = F.when(F.col("page_id") % 3 == 0, "ftp:").when(F.col("page_id") % 3 == 1, "MAILTO:").otherwise("javascript:")
    found = preflight.links(p).select("page_id", "href").union(p.select("page_id", "url")).union(p.select("page_id", F.replace("url", F.lit("http:"), other)))
    return preflight.classified(found).groupBy("page_id").agg(F.count("*").alias("links"), F.count_if(F.col("kind") == "uri").alias("external"), F.count_if("unsafe").alias("unsafe"))


@query(f"""with l as (select page_id, unnest({_HREF}) u from pages union all select page_id, url from pages)
  select page_id, u as href from l where not (regexp_matches(u, '^[A-Za-z][A-Za-z0-9+.-]*:') or starts_with(u, '//'))""")
def links_remove_external(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = table(spark, sf_dir, "pages")
    found = preflight.classified(preflight.links(p).select("page_id", "href").union(p.select("page_id", "url")))
    return found.where("kind <> 'uri'").select("page_id", "href")


@query("""with r as (select page_id, len(regexp_extract_all(html, '(?i)<script'))::bigint scripts, len(regexp_extract_all(html, '(?i)<a '))::bigint links,
    len(regexp_extract_all(html, '(?i)<img'))::bigint images, regexp_extract(html, '(?is)<title>(.*?)</title>', 1) title,
    regexp_extract(html, '(?i)<html[^>]* lang="([^"]*)"', 1) lang, length(html)::bigint size from pages)
  select *, array_to_string(list_filter([case when trim(title) = '' then 'no_title' end, case when lang = '' then 'no_language' end,
    case when links > 8 then 'many_links' end, case when size < 1000 then 'short' end], lambda x: x is not null), ',') issues,
  case when scripts > 1 then 'high' when links > 8 or trim(title) = '' or lang = '' then 'medium' else 'low' end risk from r""")
def html_preflight(spark: SparkSession, sf_dir: str) -> DataFrame:
    return preflight.html_report(table(spark, sf_dir, "pages")).drop("alternatives")


@query("""with i as (select l_suppkey, date_diff('day', date '1970-01-01', l_shipdate::date) low, date_diff('day', date '1970-01-01', l_shipdate::date) + l_quantity::bigint high from lineitem),
  m as (select *, max(high) over (partition by l_suppkey order by low, high rows between unbounded preceding and 1 preceding) r from i),
  c as (select *, sum(case when r is null or low - r > 1 then 1 else 0 end) over (partition by l_suppkey order by low, high rows unbounded preceding) cluster from m)
  select l_suppkey, cluster::bigint as cluster, min(low) low, max(high) high, count(*) members from c group by l_suppkey, cluster""")
def column_cluster(spark: SparkSession, sf_dir: str) -> DataFrame:
    day = F.datediff("l_shipdate", F.lit("1970-01-01").cast("date")).cast("bigint")
    rows = table(spark, sf_dir, "lineitem").select("l_suppkey", day.alias("low"), (day + F.col("l_quantity").cast("bigint")).alias("high"))
    return intervals.merged(rows, ["l_suppkey"], "low", "high", 1)


@query("""with v as (select event_type, (value::decimal(18,2) * 100)::bigint c from events),
  d as (select distinct event_type, c from v), l as (select *, lag(c) over (partition by event_type order by c) p from d),
  k as (select event_type, c, sum(case when p is null or c > p + 3 then 1 else 0 end) over (partition by event_type order by c rows unbounded preceding)::bigint cluster from l)
  select event_type, cluster, min(c) low, max(c) high, count(*) members, sum(c)::bigint total from v join k using (event_type, c) group by event_type, cluster""")
def cluster_1d(spark: SparkSession, sf_dir: str) -> DataFrame:
    cents = (F.col("value").cast("decimal(18,2)") * 100).cast("bigint").alias("c")
    rows = intervals.clustered(table(spark, sf_dir, "events").select("event_type", cents), ["event_type"], "c", 3)
    return rows.groupBy("event_type", "cluster").agg(F.min("c").alias("low"), F.max("c").alias("high"), F.count("*").alias("members"), F.sum("c").alias("total"))


@query("""select o_orderkey, l_linenumber, date_diff('day', o_orderdate::date, l_shipdate::date) as days from orders join lineitem on o_orderkey = l_orderkey
  where abs(date_diff('day', o_orderdate::date, l_shipdate::date)) <= 30""")
def band_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    o = table(spark, sf_dir, "orders").select("o_orderkey", "o_orderdate")
    items = table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("o_orderkey"), "l_linenumber", "l_shipdate")
    days = F.datediff("l_shipdate", "o_orderdate")
    return intervals.band(o, items, ["o_orderkey"], F.abs(days) <= 30).select("o_orderkey", "l_linenumber", days.cast("bigint").alias("days"))


@query("""with p as (select p_partkey, p_retailprice v from part), s as (select s_suppkey, abs(s_acctbal) / 5 w from supplier)
  select p_partkey, s_suppkey from p, s where abs(v - w) <= 2.0""")
def band_join_keyless(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = table(spark, sf_dir, "part").select("p_partkey", F.col("p_retailprice").alias("v"))
    s = table(spark, sf_dir, "supplier").select("s_suppkey", (F.abs("s_acctbal") / 5).alias("w"))
    return intervals.band_buckets(p, s, "v", "w", 2.0).select("p_partkey", "s_suppkey")


@query("""with t as (select * from (values ('Winter', '-01-01', '-03-31'), ('Spring', '-01-01', '-06-30'), ('Summer', '-06-01', '-08-31'), ('Fall', '-08-01', '-12-31')) t(season, f, l)),
  y as (select distinct year(o_orderdate) y from orders), b as (select season, y, (y || f)::date a, (y || l)::date z from t, y)
  select season, y::int as year, count(*) orders, max(o_orderdate) latest from b join orders on o_orderdate::date between a and z group by season, y""")
def term_cover(spark: SparkSession, sf_dir: str) -> DataFrame:
    o = table(spark, sf_dir, "orders").select("o_orderdate", F.year("o_orderdate").alias("year"))
    terms = o.select("year").distinct().select("year", F.explode(F.array(*map(F.lit, ["Winter", "Spring", "Summer", "Fall"]))).alias("season"))
    bounds = terms.withColumn("b", intervals.season_bounds(F.col("season"), F.col("year").cast("string"))).select("year", "season", "b.*")
    joined = intervals.band(o, bounds, ["year"], F.col("o_orderdate").cast("date").between(F.col("first"), F.col("last")))
    return joined.groupBy("season", "year").agg(F.count("*").alias("orders"), F.max("o_orderdate").alias("latest"))


@query("""with o as (select o_custkey, case when o_orderkey % 9 = 0 then null else strftime(o_orderdate, '%Y-%m-%d') end d, o_totalprice p, o_orderkey k from orders)
  select o_custkey, k as o_orderkey, coalesce(d, '0000-00-00') issue_date, row_number() over (partition by o_custkey order by coalesce(d, '0000-00-00') desc, p desc, k) as rank from o""")
def transcript_rank(spark: SparkSession, sf_dir: str) -> DataFrame:
    from quire.operators.transcript import ranked

    issue = F.when(F.col("o_orderkey") % 9 != 0, F.date_format("o_orderdate", "yyyy-MM-dd"))
    rows = table(spark, sf_dir, "orders").select("o_custkey", "o_orderkey", issue.alias("issue_date"), F.col("o_totalprice").alias("modified"))
    return ranked(rows, ["o_custkey"], "o_orderkey").select("o_custkey", "o_orderkey", "issue_date", "rank")


def outline_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = conversation_pages(spark, sf_dir)
    level = F.when(F.col("page") == 0, F.col("doc_id") % 5).otherwise(F.col("page") % 3 + F.when(F.col("doc_id") % 4 == 0, 1).otherwise(0))
    level = F.when((F.col("page") == 0) & (F.col("doc_id") % 5 != 0), 1).otherwise(level)
    return p.select("doc_id", F.col("page").alias("ord"), level.alias("level"), F.substring("text", 1, 20).alias("title"), (F.col("page") * 2 - 2).alias("page"))


@query("""with r as (select conv_id doc_id, turn ord, case when turn = 0 then case when conv_id % 5 <> 0 then 1 else 0 end else turn % 3 + case when conv_id % 4 = 0 then 1 else 0 end end as level, turn * 2 - 2 page,
    count(*) over (partition by conv_id) n from conversations),
  l as (select *, lag(level) over w p, lead(ord) over w x from r window w as (partition by doc_id order by ord))
  select doc_id, ord, case when p is null and level <> 1 then 'hierarchy level of item 0 must be 1' when p is not null and (level < 1 or level > p + 1) then 'bad hierarchy level'
    when x is not null and (page < -1 or page > n) then 'page number out of range' end error from l""")
def outline_validate(spark: SparkSession, sf_dir: str) -> DataFrame:
    counts = conversation_pages(spark, sf_dir).groupBy("doc_id").agg(F.count("*").alias("page_count"))
    return outline.validate(outline_rows(spark, sf_dir), counts).select("doc_id", "ord", "error")


@query("""with r as (select conv_id doc_id, turn ord, turn % 3 + 1 as level from conversations)
  select a.doc_id, a.ord, (select max(b.ord) from r b where b.doc_id = a.doc_id and b.ord < a.ord and b.level = a.level - 1) parent from r a""")
def outline_parents(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = conversation_pages(spark, sf_dir).select("doc_id", F.col("page").alias("ord"), (F.col("page") % 3 + 1).alias("level"))
    return outline.parents(rows).select("doc_id", "ord", "parent")


@query("""with d as (select conv_id, role, max_by(turn, turn) t from conversations group by conv_id, role)
  select c.conv_id doc_id, c.turn as ord, d.t resolved from conversations c left join d on d.conv_id = c.conv_id and d.role = case when c.turn % 2 = 0 then 'assistant' else 'nobody' end""")
def named_destinations(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = conversation_pages(spark, sf_dir)
    links = p.select("doc_id", F.col("page").alias("ord"), F.when(F.col("page") % 2 == 0, "assistant").otherwise("nobody").alias("name"))
    named = p.select("doc_id", F.col("label").alias("name"), F.col("page").alias("target"), F.col("page").alias("ord"))
    return outline.resolve(links, named).select("doc_id", "ord", "resolved")


def annotation_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    kinds = F.array(*map(F.lit, ["Highlight", "Link", "Text", "Popup", "Widget", "Square", "Ink"]))
    item = table(spark, sf_dir, "lineitem")
    kind = F.get(kinds, (F.col("l_partkey") % 7).cast("int"))
    popup = F.when(kind == "Text", F.col("l_linenumber").cast("bigint") + 1)
    return item.select(F.col("l_orderkey").alias("doc_id"), F.col("l_linenumber").cast("bigint").alias("ord"), (F.col("l_suppkey") % 4).alias("page"), kind.alias("subtype"), F.when(F.col("l_returnflag") != "N", F.col("l_returnflag")).otherwise("").alias("contents"), F.col("l_linestatus").alias("author"), popup.alias("popup"))


_ANNOTS = """with a as (select l_orderkey doc_id, l_linenumber::bigint ord, l_suppkey % 4 page, ['Highlight', 'Link', 'Text', 'Popup', 'Widget', 'Square', 'Ink'][l_partkey % 7 + 1] subtype,
    case when l_returnflag <> 'N' then l_returnflag else '' end contents, l_linestatus author, case when l_partkey % 7 = 2 then l_linenumber + 1 end popup from lineitem)"""


@query(f"{_ANNOTS} select doc_id, ord, page + 1 page, subtype as type, nullif(contents, '') contents, nullif(author, '') author from a where subtype not in ('Link', 'Popup', 'Widget')")
def annotate_list(spark: SparkSession, sf_dir: str) -> DataFrame:
    return annotations.listed(annotation_rows(spark, sf_dir))


@query(f"""{_ANNOTS}, g as (select * from a where lower(subtype) = 'text' and page in (0, 2))
  select doc_id, ord, subtype from a where not exists (select 1 from g where g.doc_id = a.doc_id and (g.ord = a.ord or g.popup = a.ord))""")
def annotate_delete(spark: SparkSession, sf_dir: str) -> DataFrame:
    return annotations.delete(annotation_rows(spark, sf_dir), "TEXT", [0, 2]).select("doc_id", "ord", "subtype")


def widget_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    n, r = table(spark, sf_dir, "nation"), table(spark, sf_dir, "region")
    joined = n.join(r, n["n_regionkey"] == r["r_regionkey"])
    return joined.select(F.col("r_regionkey").alias("doc_id"), F.col("n_nationkey").alias("ord"), F.concat_ws(".", "r_name", "n_name").alias("qualified"), F.col("n_name").alias("local"), F.lit("old").alias("value"))


@query("""select r_regionkey doc_id, n_nationkey as ord, r_name || '.' || n_name qualified, case when n_nationkey % 5 = 0 then 'full' when n_nationkey % 3 = 0 then 'local' else 'old' end as value,
  (n_nationkey % 5 = 0 or n_nationkey % 3 = 0) filled from nation join region on n_regionkey = r_regionkey""")
def form_fill(spark: SparkSession, sf_dir: str) -> DataFrame:
    w = widget_rows(spark, sf_dir)
    values = w.where("ord % 5 = 0").select(F.col("qualified").alias("name"), F.lit("full").alias("new")).union(w.where("ord % 3 = 0").select("local", F.lit("local")))
    return annotations.fill(w, values).select("doc_id", "ord", "qualified", "value", "filled")


@query("""select r_regionkey doc_id, '{' || string_agg('"' || r_name || '.' || n_name || '":"old"', ',' order by n_nationkey) || '}' json from nation join region on n_regionkey = r_regionkey group by 1""")
def form_export(spark: SparkSession, sf_dir: str) -> DataFrame:
    return annotations.exported(widget_rows(spark, sf_dir))


@query("""select r_regionkey doc_id, '<?xml version="1.0" encoding="UTF-8"?><xfdf xmlns="http://ns.adobe.com/xfdf/"><fields>' ||
  string_agg('<field name="' || r_name || '.' || n_name || '"><value>old</value></field>', '' order by n_nationkey) || '</fields></xfdf>' xfdf from nation join region on n_regionkey = r_regionkey group by 1""")
def form_export_xfdf(spark: SparkSession, sf_dir: str) -> DataFrame:
    return annotations.xfdf(widget_rows(spark, sf_dir))


@query("""select 'r' || r_regionkey id, r_name qualified from region union all select 'n' || n_nationkey, r_name || '.' || n_name from nation join region on n_regionkey = r_regionkey
  union all select 'c' || c_custkey, r_name || '.' || n_name || '.' || c_name from customer join nation on c_nationkey = n_nationkey join region on n_regionkey = r_regionkey""")
def form_field_tree(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = lambda name, kind, key, up, label: table(spark, sf_dir, name).select(F.lit(0).alias("doc_id"), F.concat(F.lit(kind), key).alias("id"), up.alias("parent"), F.col(label).alias("name"))
    fields = t("region", "r", "r_regionkey", F.lit(None).cast("string"), "r_name").union(t("nation", "n", "n_nationkey", F.concat(F.lit("r"), "n_regionkey"), "n_name")).union(t("customer", "c", "c_custkey", F.concat(F.lit("n"), "c_nationkey"), "c_name"))
    return annotations.qualified_names(fields).select("id", "qualified")


@query("""select c_custkey, c_name title, case when c_custkey % 4 = 0 then null else 'Ann' end author, case when c_custkey % 3 = 0 then null else c_mktsegment end subject from customer""")
def meta_set(spark: SparkSession, sf_dir: str) -> DataFrame:
    blank = F.when(F.col("c_custkey") % 3 == 0, "").otherwise(F.col("c_mktsegment"))
    info = F.create_map(F.lit("title"), F.lit("old"), F.lit("author"), F.lit("Ann"), F.lit("subject"), blank)
    rows = table(spark, sf_dir, "customer").select("c_custkey", "c_name", info.alias("info"))
    removed = annotations.set_metadata(F.col("info"), {"author": "None"})
    info = annotations.metadata(F.when(F.col("c_custkey") % 4 == 0, removed).otherwise(F.col("info")))
    named = rows.select("c_custkey", "c_name", F.map_concat(F.map_filter(info, lambda k, _: k != "title"), F.create_map(F.lit("title"), F.col("c_name"))).alias("info"))
    return named.select("c_custkey", F.col("info")["title"].alias("title"), F.try_element_at("info", F.lit("author")).alias("author"), F.try_element_at("info", F.lit("subject")).alias("subject"))


@query("""with a as (select o_custkey doc_id, list_sort(list(distinct o_orderstatus)) v from orders group by 1)
  select doc_id, array_to_string(list_filter(v, lambda x: x not in ('F', 'X')), ',') kept, array_to_string(list_filter(['F', 'X'], lambda x: not list_contains(v, x)), ',') missing from a""")
def detach(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "orders").select(F.col("o_custkey").alias("doc_id"), F.col("o_orderstatus").alias("name"))
    return annotations.detach(rows, ["F", "X"]).select("doc_id", F.array_join("kept", ",").alias("kept"), F.array_join("missing", ",").alias("missing"))


@query("""with a as (select o_custkey doc_id, o_orderkey, case when o_orderkey % 2 = 0 then o_orderpriority else lower(o_orderpriority) end as name from orders)
  select doc_id, o_orderkey, name, n as same from (select *, count(*) over (partition by doc_id, lower(name)) n from a) where n > 1""")
def attachment_collisions(spark: SparkSession, sf_dir: str) -> DataFrame:
    from quire.functions.pytext import nfc_key

    name = F.when(F.col("o_orderkey") % 2 == 0, F.col("o_orderpriority")).otherwise(F.lower("o_orderpriority"))
    rows = table(spark, sf_dir, "orders").select(F.col("o_custkey").alias("doc_id"), "o_orderkey", name.alias("name"))
    return annotations.collisions(rows, nfc_key("name"))


@query("""select o_orderkey, ((-3904 + o_orderkey % 3900) & 4) <> 0 print, ((-3904 + o_orderkey % 3900) & 16) <> 0 as copy, ((-3904 + o_orderkey % 3900) & 2048) <> 0 print_high from orders""")
def security_permissions(spark: SparkSession, sf_dir: str) -> DataFrame:
    flags = (F.col("o_orderkey") % 3900 - 3904).cast("int")
    p = permissions(flags)
    return table(spark, sf_dir, "orders").select("o_orderkey", p["print"].alias("print"), p["copy"].alias("copy"), p["print_high"].alias("print_high"))
