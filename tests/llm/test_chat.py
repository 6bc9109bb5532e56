from hypothesis import given, settings
from hypothesis import strategies as st

from quire.llm import chat
from quire.llm.chat import F

PIECES = ["</s>", "<s>", "[INST]", "[/INST]", "<|im_start|>", "<|im_end|>", "<|im_turn|>", "<|im_sep|>", "\\", "<", "[", "a", "\n", "|im_end|>", "é"]
SAID = st.one_of(st.none(), st.lists(st.sampled_from(PIECES), max_size=6).map("".join))


@settings(max_examples=25, deadline=None)
@given(st.lists(st.tuples(st.integers(0, 2), st.one_of(st.none(), st.integers(0, 4)), st.sampled_from(["user", "assistant", "system", None, "<|im_sep|>"]), SAID), min_size=1, max_size=12))
def test_round_trip(spark, rows):
    df = spark.createDataFrame(rows, "conv_id bigint, turn bigint, role string, text string")
    made = chat.format_conversations(df)
    read = made.select("conv_id", "formatted", "loss_spans", chat.read_back(F.col("formatted")).alias("turns"), chat.loss_text(F.col("formatted"), F.col("loss_spans")).alias("loss"))
    for r in read.collect():
        own = sorted(((-1 if t is None else t), role or "", text or "") for c, t, role, text in rows if c == r.conv_id)
        assert [(t.role, t.text) for t in r.turns] == [(role, text) for _, role, text in own]
        assert r.loss == "".join(text for _, role, text in own if role == "assistant")
        assert len(r.loss_spans) == sum(role == "assistant" for _, role, _ in own)


def test_neighbours_of_one_role_share_a_block(spark):
    df = spark.createDataFrame([(1, 0, "user", "a"), (1, 1, "user", "b"), (1, 2, "assistant", "c"), (None, 0, "user", "x")], "conv_id bigint, turn bigint, role string, text string")
    made = {r.conv_id: r.formatted for r in chat.format_conversations(df.withColumn("turns", F.lit(1))).collect()}
    assert made[1] == "<|im_start|>user<|im_sep|>a<|im_turn|>b<|im_end|>\n<|im_start|>assistant<|im_sep|>c<|im_end|>\n"
    assert made[None] == "<|im_start|>user<|im_sep|>x<|im_end|>\n"
    assert chat.format_conversations(df.limit(0)).count() == 0


def test_long_conversations(spark):
    df = spark.range(3000).selectExpr("0L as conv_id", "id as turn", "if(id % 3 = 0, 'user', 'assistant') as role", "repeat('x', cast(id % 7 as int)) as text")
    r = chat.format_conversations(df).select(F.size("loss_spans").alias("n"), F.length(chat.loss_text(F.col("formatted"), F.col("loss_spans"))).alias("k")).first()
    assert r.n == 2000 and r.k == sum(i % 7 for i in range(3000) if i % 3)


SQL_FIXTURE = "/root/testdata/sf0.01"


def test_query_like_sql(spark):
    from quire.llm.queries import QUERIES, SQL
    from tests.compare import difference

    for name in sorted(SQL):
        assert difference(spark, QUERIES[name], SQL[name], SQL_FIXTURE) == "", name
