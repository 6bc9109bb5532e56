"""The registered queries of this package: thin shapes over the operators, with production parameters."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def held_out(modulus: int, rest: int, equal: bool) -> "F.Column":
    """Whether crc32 of the id as text has (or, with equal false, has not) that remainder."""
    hit = F.coalesce(F.crc32(F.col("doc_id").cast("string")), F.lit(0)) % modulus == rest
    return hit if equal else ~hit


def op1_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    from quire.llm.language_id import identify

    docs = table(spark, sf_dir, "documents")
    found = identify(docs, docs.where(held_out(5, 0, False)))
    return found.withColumn("held_out", held_out(5, 0, True)).select("doc_id", "held_out", "lang_pred", "score")


def op8_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    from quire.llm.simhash import near_duplicates

    found = near_duplicates(table(spark, sf_dir, "documents"), k=4, distance=4)
    return found.select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


def op9_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    from quire.llm.quality import judge

    found = judge(table(spark, sf_dir, "documents"))
    names = ["doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept", "log_ppl"]
    return found.select(*names)


def op2_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    from quire.llm.decontaminate import contaminated

    return contaminated(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def tokenizer_path() -> str:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json")


def op10_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    from quire.llm.packing import pack

    return pack(table(spark, sf_dir, "documents"), tokenizer_path(), window=1024, end_id=0)


def op7_substrings(spark: SparkSession, sf_dir: str) -> DataFrame:
    from quire.llm.substrings import remove_repeats

    return remove_repeats(table(spark, sf_dir, "documents"), window=35).select("doc_id", "n_words", "n_removed", "kept_sha256")


def op5_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    from quire.llm.toxicity import toxicity

    docs = table(spark, sf_dir, "documents")
    train = held_out(3, 1, False)
    found = toxicity(docs, docs.where(train), table(spark, sf_dir, "labels").where(train), threshold=0.7)
    return found.select("doc_id", held_out(3, 1, True).alias("held_out"), "score", "predicted")


def op3_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    from quire.llm.warc import archive, captures

    found = captures(spark, archive(table(spark, sf_dir, "pages"), least_revisit=0), payloads=False)
    fields = F.col("metadata.fields")
    return found.select(
        fields["sourceId"].cast("bigint").alias("page_id"),
        F.col("response.payload_bytes").alias("payload_bytes"),
        F.col("response.payload_digest").alias("payload_digest"),
        F.col("response.type").alias("record_type"),
        F.when(F.col("response.type") == "revisit", fields["refersToSourceId"].cast("bigint")).alias("refers_to"),
    )


def op4_chat(spark: SparkSession, sf_dir: str) -> DataFrame:
    from quire.llm.chat import format_conversations, loss_text, read_back

    turns = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    said = "</s>[INST] ok [/INST]"
    probe = spark.createDataFrame([(-1, 0, "user", said), (-1, 1, "assistant", said)], turns.schema)
    made = format_conversations(turns.unionByName(probe))
    read = made.select("conv_id", "formatted", read_back(F.col("formatted")).alias("turns"), loss_text(F.col("formatted"), F.col("loss_spans")).alias("loss"))
    spelled = F.array_join(F.transform("turns", lambda t: F.concat(t.role, F.lit("\n"), t.text, F.lit("\n"))), "")
    return read.select(
        "conv_id",
        F.size("turns").cast("bigint").alias("n_turns"),
        F.sha2(spelled, 256).alias("turns_sha256"),
        F.length("loss").cast("bigint").alias("loss_chars"),
        F.sha2("loss", 256).alias("loss_sha256"),
        F.length("formatted").cast("bigint").alias("formatted_chars"),
    )


def op6_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    from quire.llm.secrets import KINDS, find_secrets, spelled

    found = find_secrets(table(spark, sf_dir, "documents").select("doc_id", "text"))
    count = lambda k: F.size(F.filter("base", lambda s: s.kind == KINDS.index(k))).cast("bigint").alias(f"n_{k}")
    return found.select("doc_id", *map(count, KINDS[:3]), F.sha2(spelled(F.col("base")), 256).alias("base_sha256"), spelled(F.col("spans")).alias("spans"))


_WARC_SQL = """
with p as (select page_id, encode(coalesce(html, '')) b from pages),
d as (select page_id, octet_length(b)::bigint n, sha1(b) h from p),
f as (select *, min(page_id) over (partition by h, n) first from d)
select page_id, n payload_bytes, array_to_string(list_transform(range(0, 32), lambda i: substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567',
    (('0x' || substr(h, (i // 4 * 5 + 1)::int, 5))::bigint >> (15 - i % 4 * 5)::int & 31)::int + 1, 1)), '') payload_digest,
  case when page_id = first then 'response' else 'revisit' end record_type, case when page_id <> first then first end refers_to from f
"""

_CHAT_SQL = r"""
with c as (select conv_id, turn, coalesce(role, '') role, coalesce(text, '') as text from conversations
    union all select -1, 0, 'user', '</s>[INST] ok [/INST]' union all select -1, 1, 'assistant', '</s>[INST] ok [/INST]'),
e as (select *, regexp_replace(text, '([<\[])(\\*)(\|im_start\|>|\|im_sep\|>|\|im_turn\|>|\|im_end\|>|\|endoftext\|>|s>|/s>|INST\]|/INST\])', '\1\\\2\3', 'g') x,
    lag(role) over (partition by conv_id order by turn, role, text) is distinct from role as opens from c)
select conv_id, count(*) n_turns, sha256(string_agg(role || chr(10) || text || chr(10), '' order by turn, role, text)) turns_sha256,
  coalesce(sum(length(text)) filter (role = 'assistant'), 0)::bigint loss_chars,
  sha256(coalesce(string_agg(text, '' order by turn, role, text) filter (role = 'assistant'), '')) loss_sha256,
  (sum(length(x)) + sum(case when opens then 12 + length(role) + 10 + 10 + 1 else 11 end))::bigint formatted_chars
from e group by conv_id
"""

_SUBSTRING_SQL = r"""
with d as (select doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') w from documents),
s as (select doc_id, unnest(range(1, len(w) + 1)) i, w from d),
g as (select doc_id, i, w[i] as word, case when i + 34 <= len(w) then array_to_string(w[i:i + 34], ' ') end g from s),
c as (select *, g is not null and count(*) over (partition by g) > 1 twice from g),
k as (select doc_id, i, word, max(twice::int) over (partition by doc_id order by i rows between 34 preceding and current row) gone from c)
select d.doc_id, len(w)::bigint n_words, coalesce(sum(gone), 0)::bigint n_removed,
  sha256(coalesce(string_agg(word, ' ' order by i) filter (gone = 0), '')) kept_sha256
from d left join k on k.doc_id = d.doc_id group by d.doc_id, w
"""

QUERIES = {f.__name__: f for f in (op1_language_id, op2_decontaminate, op3_warc, op4_chat, op5_toxicity, op6_secrets, op7_substrings, op8_simhash, op9_quality, op10_packing)}
SQL = {"op3_warc": _WARC_SQL, "op4_chat": _CHAT_SQL, "op7_substrings": _SUBSTRING_SQL}
