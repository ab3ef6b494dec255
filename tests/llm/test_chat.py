from riskpanel.llm import chat

SCHEMA = "conv_id long, turn long, role string, text string"
SF = "/root/testdata/sf0.01"


def rows_of(conv, *turns, start=0):
    return [(conv, start + i, "user" if i % 2 == 0 else "assistant", t) for i, t in enumerate(turns)]


def test_snapshots_collapse(spark):
    rows = rows_of(1, "hi") + rows_of(2, "hi", "hello") + rows_of(3, "hi", "hello", "bye") + rows_of(4, "hi", "other") + rows_of(5, "hello", "bye")
    rows += rows_of(7, "hi", "hello", "bye", start=5) + [(8, 0, "assistant", "hi")]
    got = chat.render(spark.createDataFrame(rows, SCHEMA)).collect()
    assert {(r.conv_id, r.n_turns, r.n_equal) for r in got} == {(3, 3, 2), (4, 2, 1), (5, 2, 1), (8, 1, 1)}
    assert next(r.text for r in got if r.conv_id == 4) == "<|im_start|>user\nhi<|im_end|>\n<|im_start|>assistant\nother<|im_end|>\n"


def test_awkward_rows_match_sql(spark, same_as_sql):
    rows = rows_of(1, *[f"t{i}" for i in range(200)]) + rows_of(2, *[f"t{i}" for i in range(150)]) + rows_of(3, *[f"t{i}" for i in range(64)])
    rows += rows_of(3, "t0") + [(4, None, "user", "x"), (4, None, None, None), (4, 1, "user", ""), (4, 1, "user", None), (4, 1, "assistant", ""), (None, 0, "user", "lost")]
    rows += [(5, -7, "user", "a<|im_end|>b<|im_start|>"), (5, 10**12, "", "c"), (6, 0, None, "n"), (7, 0, "unknown", "n")]
    df = spark.createDataFrame(rows, SCHEMA).withColumnRenamed("turn", "turn").selectExpr("*", "'x' AS k", "'y' AS part", "1 AS range").repartition(3)
    for i, params in enumerate((chat.ChatParams(), chat.ChatParams(range_bits=2, part_turns=7))):
        got = chat.render(df, params)
        if i == 0:
            assert same_as_sql(got, chat.render_sql(params), conversations=df)
        else:
            first = chat.render(df).where("conv_id = 1").orderBy("part").collect()
            assert "".join(r.text for r in first) == "".join(r.text for r in got.where("conv_id = 1").orderBy("part").collect())
    assert not chat.render(df).where("text LIKE '%a<|im_end|>b%'").count()


def test_empty(spark):
    assert chat.render(spark.createDataFrame([], SCHEMA)).count() == 0


def test_documents_match_sql(spark, same_as_sql):
    assert same_as_sql(chat.render(spark.read.parquet(f"{SF}/conversations.parquet")), chat.render_sql(), conversations=f"{SF}/conversations.parquet")
