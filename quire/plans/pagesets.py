"""Queries over multi-page documents: selection, reports, page-set operators, labels, comparison."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quire.functions.expressions import label, text_lines
from quire.operators import compare, intervals, pages, text
from quire.plans.catalog import query
from quire.plans.documents import W
from quire.sources.adapters import conversation_pages, table

C = "conv_id as doc_id, turn as page, role as label, text"


def source(spark: SparkSession, sf_dir: str) -> DataFrame:
    return conversation_pages(spark, sf_dir)


@query(f"""with n as (select conv_id, count(*) c from conversations group by conv_id)
  select conv_id doc_id, turn + 1 page, role label, length(text)::bigint text_chars, len(regexp_extract_all(text, '{W}'))::bigint word_count,
  case when c > 4 then 5::bigint end next_page from conversations join n using (conv_id) where turn between 1 and 3""")
def page_inventory(spark: SparkSession, sf_dir: str) -> DataFrame:
    return text.inventory(source(spark, sf_dir), start_page=2, limit=3)


@query("""select conv_id doc_id, count(*) page_count, bool_or(regexp_matches(text, '[^ \\t\\n\\r\\f\\x0b]')) has_text,
  sum(octet_length(encode(text)))::bigint size_bytes, array_to_string(list_sort(list(distinct role)), ',') labels from conversations group by conv_id""")
def doc_info(spark: SparkSession, sf_dir: str) -> DataFrame:
    return text.info(source(spark, sf_dir))


@query("""select c.conv_id doc_id, s.pos::bigint pos, c.turn page, c.text from conversations c
  join (values (0, 1), (1, 2), (2, 3), (3, 0), (4, 0)) s(pos, wanted) on c.turn = s.wanted""")
def page_select(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pages.select_pages(source(spark, sf_dir), "2-4,1,1").select("doc_id", "pos", "page", "text")


@query("""select conv_id doc_id, string_agg(text, chr(10) order by turn) as text, (sum(length(text)) + count(*) - 1)::bigint char_count
  from conversations group by conv_id""")
def text_export(spark: SparkSession, sf_dir: str) -> DataFrame:
    return text.export(source(spark, sf_dir))


@query("""with a as (select 0 file, conv_id % 10 doc_id, conv_id * 1000 + turn source_page from conversations where conv_id % 2 = 0),
  b as (select 1 file, conv_id % 10 doc_id, conv_id * 1000 + turn source_page from conversations where conv_id % 2 = 1),
  u as (select * from a union all select file, doc_id - 1, source_page from b)
  select doc_id, file::bigint file, source_page, row_number() over (partition by doc_id order by file, source_page) - 1 page from u""")
def pages_merge(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = source(spark, sf_dir).select((F.col("doc_id") % 10).alias("doc_id"), (F.col("doc_id") * 1000 + F.col("page")).alias("page"))
    even = rows.where("doc_id % 2 = 0")
    odd = rows.where("doc_id % 2 = 1").withColumn("doc_id", F.col("doc_id") - 1)
    return pages.merge(even, odd).select("doc_id", "file", "source_page", "page")


@query("select conv_id doc_id, turn page, turn // 3 + 1 part, turn % 3 part_page from conversations")
def pages_split(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pages.split(source(spark, sf_dir), 3).select("doc_id", "page", "part", "part_page")


@query("""with s as (select conv_id doc_id, turn source_page, pos from conversations join (values (0, 2), (1, 1), (2, 0), (3, 2)) v(pos, w) on turn = w)
  select doc_id, source_page, row_number() over (partition by doc_id order by pos) - 1 page from s""")
def pages_extract(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pages.extract(source(spark, sf_dir), "3-1,3").select("doc_id", "source_page", "page")


@query("""select conv_id doc_id, turn source_page, row_number() over (partition by conv_id order by turn) - 1 page from conversations where turn not in (1, 3)""")
def pages_delete(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pages.delete(source(spark, sf_dir), "2,4,2").select("doc_id", "source_page", "page")


@query("""select conv_id doc_id, turn source_page, row_number() over (partition by conv_id order by case turn when 2 then 0 when 0 then 1 else 2 + turn end) - 1 page from conversations""")
def pages_reorder(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pages.reorder(source(spark, sf_dir), "3,1").select("doc_id", "source_page", "page")


@query("""select conv_id doc_id, turn page, case when turn in (0, 2) then (-450 + (turn * 90) % 360 + 360) % 360 else (turn * 90) % 360 end rotation from conversations""")
def pages_rotate(spark: SparkSession, sf_dir: str) -> DataFrame:
    rotated = source(spark, sf_dir).withColumn("rotation", (F.col("page") * 90) % 360)
    return pages.rotate(rotated, -450, "1,3").select("doc_id", "page", "rotation")


@query("""with d as (select conv_id doc_id, turn, 0 c from conversations union all select conv_id, turn, 1 from conversations where turn in (0, 1))
  select doc_id, turn source_page, c::int as copy, row_number() over (partition by doc_id order by turn, c) - 1 page from d""")
def pages_duplicate(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pages.duplicate(source(spark, sf_dir), "2,1,2").select("doc_id", "source_page", "copy", "page")


@query("""with n as (select conv_id, count(*) c from conversations group by conv_id),
  u as (select conv_id, turn, 0 s, turn::double b from conversations union all
    select conv_id, turn, 1, least(c, 1) - 0.5 from conversations join n using (conv_id) where role = 'user')
  select conv_id doc_id, turn source_page, s::int from_source, row_number() over (partition by conv_id order by b, turn) - 1 page from u""")
def pages_insert(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = source(spark, sf_dir)
    return pages.insert(p, p.where("label = 'user'"), at=2).select("doc_id", "source_page", "from_source", "page")


@query("""with u as (select conv_id, turn, 0 s, turn::double b from conversations where turn not in (1, 2) union all
    select conv_id, turn, 1, 0.5 from conversations where role = 'user')
  select conv_id doc_id, turn source_page, s::int from_source, row_number() over (partition by conv_id order by b, turn) - 1 page from u""")
def pages_replace(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = source(spark, sf_dir)
    return pages.replace(p, p.where("label = 'user'"), "2,3").select("doc_id", "source_page", "from_source", "page")


@query("""with n as (select conv_id, count(*) c from conversations group by conv_id),
  u as (select conv_id, turn, 0 k, turn::double b from conversations union all
    select conv_id, turn, k, case when c <= 2 then turn + 0.5 else turn - 0.5 end from conversations join n using (conv_id), (values (1), (2)) v(k) where turn = least(2, c - 1))
  select conv_id doc_id, k > 0 blank, case when k = 0 then turn end kept_page, row_number() over (partition by conv_id order by b, k) - 1 page from u""")
def pages_blank(spark: SparkSession, sf_dir: str) -> DataFrame:
    made = pages.blank(source(spark, sf_dir), at=2, count=2)
    return made.select("doc_id", "blank", F.when(~F.col("blank"), F.col("source_page")).alias("kept_page"), "page")


@query("""select conv_id doc_id, turn page, turn // 2 sheet, turn % 2 slot from conversations""")
def pages_nup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pages.nup(source(spark, sf_dir), 2).select("doc_id", "page", "sheet", "slot")


@query("""with n as (select conv_id, count(*) c, (count(*) + 3) // 4 * 4 t from conversations group by conv_id),
  s as (select conv_id, c, t, unnest(range(t)) p from n),
  o as (select conv_id, c, p, case p % 4 when 0 then t - 1 - p // 4 * 2 when 1 then p // 4 * 2 when 2 then p // 4 * 2 + 1 else t - 2 - p // 4 * 2 end g from s)
  select conv_id doc_id, p as position, g as page, g >= c as blank from o""")
def pages_booklet(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pages.booklet(source(spark, sf_dir)).select("doc_id", "position", "page", F.col("label").isNull().alias("blank"))


@query("""with m as (select max(r_regionkey) m from region)
  select conv_id doc_id, turn page, least(turn, m)::bigint stamp_page, r_name stamp from conversations, m join region on r_regionkey = least(turn, m)""")
def pages_overlay(spark: SparkSession, sf_dir: str) -> DataFrame:
    stamp = table(spark, sf_dir, "region").select(F.col("r_regionkey").cast("bigint").alias("stamp_page"), F.col("r_name").alias("stamp"))
    return pages.overlay(source(spark, sf_dir), stamp).select("doc_id", "page", "stamp_page", "stamp")


@query("""select conv_id doc_id, turn page, 'Page ' || (turn + 1) || ' of ' || count(*) over (partition by conv_id) header from conversations""")
def pages_header(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pages.header(source(spark, sf_dir), "Page {page} of {pages}").select("doc_id", "page", "header")


@query("""select conv_id doc_id, turn page, (turn + 1) || '/' || count(*) over (partition by conv_id) footer from conversations""")
def pages_footer(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pages.header(source(spark, sf_dir), "{page}/{pages}", name="footer").select("doc_id", "page", "footer")


@query("""select conv_id doc_id, turn page, '- ' || (turn + 5) || ' -' number from conversations""")
def pages_numbers(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pages.numbers(source(spark, sf_dir), "- {page} -", start=5).select("doc_id", "page", "number")


@query("""select conv_id doc_id, turn page, printf('ACME%06d', turn - 2) bates from conversations""")
def pages_bates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pages.bates(source(spark, sf_dir), "ACME", start=-2, digits=6).select("doc_id", "page", "bates")


def sized(spark: SparkSession, sf_dir: str) -> DataFrame:
    return source(spark, sf_dir).withColumns({"width": F.lit(612.0), "height": F.col("page") * 8.0 + 700})


@query("""select conv_id doc_id, turn page, 612.0::double * case when turn = 0 then 0.5 else 1 end width, (turn * 8.0 + 700)::double * case when turn = 0 then 0.5 else 1 end height from conversations""")
def pages_scale(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pages.scale(sized(spark, sf_dir), 0.5, "1").select("doc_id", "page", "width", "height")


@query("""select conv_id doc_id, turn page, case when turn < 2 then [10.0, 20.0, 300.0, 400.0]::double[] else [0.0, 0.0, 612.0, turn * 8.0 + 700]::double[] end crop_box from conversations""")
def pages_crop(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pages.crop(sized(spark, sf_dir), (10, 20, 300, 400), "1,2").select("doc_id", "page", "crop_box")


@query("""select conv_id doc_id, turn page, case when turn = 1 then [1.0, 2.0, 3.0, 4.0]::double[] end trim_box from conversations""")
def pages_boxes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pages.set_box(sized(spark, sf_dir), "trim", (1, 2, 3, 4), "2").select("doc_id", "page", "trim_box")


@query("""select conv_id doc_id, turn page, 'FOR REVIEW' watermark_text, 45.0::double angle from conversations""")
def pages_watermark(spark: SparkSession, sf_dir: str) -> DataFrame:
    made = pages.watermark(source(spark, sf_dir), "FOR\tREVIEW")
    return made.select("doc_id", "page", F.col("watermark.text").alias("watermark_text"), F.col("watermark.angle").alias("angle"))


RULES = [(0, "r", "", 1), (2, "D", "A-", 7), (4, "A", "", 26), (6, "R", "x", 3)]


@query("""with r(start, style, prefix, first) as (values (1, 'r', '', 1), (2, 'D', 'A-', 7), (4, 'A', '', 26), (6, 'R', 'x', 3)),
  j as (select conv_id, turn, max(start) s from conversations left join r on start <= turn group by conv_id, turn)
  select conv_id doc_id, turn page, coalesce(prefix || case style when 'D' then (first + turn - start)::varchar
    when 'r' then ['i', 'ii', 'iii'][first + turn - start] when 'R' then ['I', 'II', 'III', 'IV', 'V', 'VI'][first + turn - start]
    when 'A' then case when first + turn - start <= 26 then chr((64 + first + turn - start)::int) else repeat(chr((64 + first + turn - start - 26)::int), 2) end end, '') page_label
  from j left join r on r.start = j.s""")
def page_labels(spark: SparkSession, sf_dir: str) -> DataFrame:
    rules = spark.createDataFrame([(1, *RULES[0][1:]), *RULES[1:]], "start bigint, style string, prefix string, first bigint")
    at = intervals.as_of(source(spark, sf_dir).select("doc_id", "page"), rules, "page", "start", ["style", "prefix", "first"], by=["doc_id"])
    text_ = F.concat("prefix", label(F.col("style"), F.col("first") + F.col("page") - F.col("start")))
    return at.select("doc_id", "page", F.coalesce(text_, F.lit("")).alias("page_label"))


@query("""with o as (select o_orderkey k, o_orderstatus s, case when o_totalprice > 200000 then 'X' else o_orderpriority end p from orders where o_orderstatus <> 'P'),
  n as (select o_orderkey k, case when o_totalprice < 50000 then null else o_orderstatus end s, o_orderpriority p from orders where o_orderpriority <> '1-URGENT'),
  j as (select coalesce(o.k, n.k) k, o.s a, n.s b, o.p c, n.p d from o full join n on o.k = n.k)
  select k, 'status' field, a as "left", b as "right" from j where a is distinct from b union all select k, 'priority', c, d from j where c is distinct from d""")
def compare_structure(spark: SparkSession, sf_dir: str) -> DataFrame:
    o = table(spark, sf_dir, "orders")
    key, status, priority = F.col("o_orderkey").alias("k"), F.col("o_orderstatus"), F.col("o_orderpriority")
    left = o.where(status != "P").select(key, status.alias("status"), F.when(F.col("o_totalprice") > 200000, "X").otherwise(priority).alias("priority"))
    right = o.where(priority != "1-URGENT").select(key, F.when(F.col("o_totalprice") >= 50000, status).alias("status"), priority.alias("priority"))
    return compare.structure(left, right, "k", ["status", "priority"])


_LINES = "list_filter(list_transform(regexp_split_to_array(text, '[\\n\\r\\x0b\\x0c]'), lambda x: trim(x, chr(32) || chr(9))), lambda x: x <> '')"


@query(f"""with l as (select doc_id, array_to_string({_LINES}, chr(10)) h from documents where len({_LINES}) > 0)
  select a.doc_id, min(b.doc_id) as candidate from l a join l b on a.h = b.h group by a.doc_id""")
def compare_exact_pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return compare.exact_pages(docs, docs.withColumnRenamed("doc_id", "candidate"), "doc_id", "candidate")


@query("""with w as (select doc_id, unnest(list_filter(regexp_split_to_array(text, '[ \\t\\n\\r]+'), lambda x: x <> '')) w from documents),
  v as (select item_id, unnest(list_filter(regexp_split_to_array(text, '[ \\t\\n\\r]+'), lambda x: x <> '')) w from benchmark),
  a as (select doc_id, w, count(*) n from w group by all), b as (select item_id, w, count(*) m from v group by all),
  na as (select doc_id, sum(n) n from a group by 1), nb as (select item_id, sum(m) m from b group by 1),
  s as (select doc_id, item_id, sum(least(n, m)) s from a join b using (w) group by 1, 2),
  r as (select doc_id, item_id, s, 2 * s / (na.n + nb.m) r from s join na using (doc_id) join nb using (item_id))
  select doc_id, item_id, s::bigint shared, floor(r * 10000 + 0.5)::bigint ratio4 from r where r >= 0.3
  qualify row_number() over (partition by doc_id order by r desc, item_id) = 1""")
def compare_quick_ratio(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = compare.quick_ratio(table(spark, sf_dir, "documents").select("doc_id", "text"), table(spark, sf_dir, "benchmark"), "doc_id", "item_id", least=0.3)
    best = found.groupBy("doc_id").agg(F.max(F.struct("ratio", (-F.col("item_id")).alias("i"), "shared")).alias("b"))
    return best.select("doc_id", (-F.col("b.i")).alias("item_id"), F.col("b.shared").alias("shared"), F.floor(F.col("b.ratio") * 10000 + 0.5).cast("bigint").alias("ratio4"))


def versions(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """Conversations of three versions: as they are, and reordered with one line changed."""
    p = source(spark, sf_dir).select("doc_id", "page", "text")
    other = p.withColumn("page", F.when(F.col("page") == 0, 1).when(F.col("page") == 1, 0).otherwise(F.col("page")))
    return p, other.withColumn("text", F.when(F.col("page") == 1, F.concat("text", F.lit("\nAn added line."))).otherwise(F.col("text")))


@query()
def compare_text_ratio(spark: SparkSession, sf_dir: str) -> DataFrame:
    left, right = versions(spark, sf_dir)
    return compare.diffs(left, right, compare.best_match(left, right), context=1, most_lines=20)


@query("""select item_id from benchmark b where not exists (select 1 from documents d where contains(
  regexp_replace(d.text, '[ \\t\\n\\r\\f\\x0b]+', ' ', 'g'), trim(regexp_replace(b.text, '[ \\t\\n\\r\\f\\x0b]+', ' ', 'g'))))""")
def compare_unmatched(spark: SparkSession, sf_dir: str) -> DataFrame:
    from quire.operators.search import many

    items = table(spark, sf_dir, "benchmark")
    return compare.unmatched(items.select("item_id"), many(table(spark, sf_dir, "documents"), items, "doc_id", "item_id"), ["item_id"])


@query("""with a as (select conv_id, turn, role from conversations where conv_id % 2 = 0), b as (select conv_id - 1 conv_id, turn, role from conversations where conv_id % 2 = 1)
  select a.conv_id doc_id, count(*) compared, count(*) filter (a.role is distinct from b.role) changed from a join b using (conv_id, turn) group by 1""")
def compare_positions(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = source(spark, sf_dir)
    a, b = p.where("doc_id % 2 = 0"), p.where("doc_id % 2 = 1").select((F.col("doc_id") - 1).alias("doc_id"), "page", F.col("label").alias("other"))
    joined = a.join(b, ["doc_id", "page"])
    return joined.groupBy("doc_id").agg(F.count("*").alias("compared"), F.count_if(~F.col("label").eqNullSafe(F.col("other"))).alias("changed"))


@query(f"""select conv_id doc_id, turn page, len({_LINES})::bigint n_lines from conversations""")
def page_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    return source(spark, sf_dir).select("doc_id", "page", F.size(text_lines(F.col("text"))).cast("bigint").alias("n_lines"))


@query("""with k as (select conv_id, turn, row_number() over (partition by conv_id order by turn) - 1 n from conversations where turn <> 1),
  l as (select conv_id, turn page, turn + 1 target from conversations where turn % 2 = 0)
  select l.conv_id doc_id, a.n new_page, b.n new_target from l join k a on a.conv_id = l.conv_id and a.turn = l.page join k b on b.conv_id = l.conv_id and b.turn = l.target""")
def links_after_delete(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = source(spark, sf_dir)
    links = p.where("page % 2 = 0").select("doc_id", "page", (F.col("page") + 1).alias("target_page"))
    return pages.surviving_links(links, pages.delete(p, "2")).select("doc_id", "new_page", "new_target")
