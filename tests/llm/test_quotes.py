import pytest

from boxwise.llm import catalog, quotes

ROWS = [
    (1, 0, "user", "Hello there my friend\nHow are you doing today?\n\nPara two is here now."),
    (1, 1, "assistant", "On Monday X wrote:\n> Hello   there MY friend\n> how are you doing today?\n\nI am fine thanks a lot."),
    (1, 2, "user", "> > Hello there my friend\n> > How are you doing today?\n> I am fine thanks a lot.\nGood to hear that from you."),
    (1, 3, "assistant", "> Para two is here now.\nok"),
    (2, 0, "user", "> I am fine thanks a lot.\nforwarded"),
    (2, 1, "user", None),
    (2, 2, "user", ""),
    (None, 1, "u", "> ok"),
    (3, None, "u", "x"),
    (1, 4, "user", ">never said\nhm\n> Good to hear that from you."),
    (1, 4, "user", ">never said\nhm\n> Good to hear that from you."),
]
SCHEMA = "conv_id long, turn long, role string, text string"


def test_links_and_reply_order(spark):
    df = spark.createDataFrame(ROWS, SCHEMA).selectExpr("*", "1 AS level", "2 AS h", "3 AS quotes_seen")
    got = {(r.conv_id, r.turn): r for r in quotes.conversations(df).collect()}
    assert quotes.conversations(df).count() == len(ROWS)
    short = lambda k: (got[k].own_text, got[k].n_quotes, got[k].n_linked, got[k].reply_to_conv, got[k].reply_to_turn, got[k].thread_conv, got[k].thread_turn, got[k].reply_depth)
    assert short((1, 0)) == (ROWS[0][3], 0, 0, None, None, 1, 0, 0)
    assert short((1, 1)) == ("I am fine thanks a lot.", 1, 1, 1, 0, 1, 0, 1)
    assert short((1, 2)) == ("Good to hear that from you.", 2, 2, 1, 1, 1, 0, 2)
    assert short((1, 3)) == ("ok", 1, 1, 1, 0, 1, 0, 1)
    assert short((1, 4)) == ("hm", 2, 1, 1, 2, 1, 0, 3)
    assert short((2, 0)) == ("forwarded", 1, 1, 1, 1, 1, 0, 2)
    assert short((2, 1)) == (None, 0, 0, None, None, 2, 1, 0)
    assert got[2, 2].own_text == "" and got[None, 1].n_linked == 0 and got[3, None].own_text == "x"


def test_long_chains_and_long_messages(spark):
    rows = [(1, 0, "u", "the very first message here")]
    for i in range(1, 70):
        before = rows[-1][3].split("\n")[-1]
        rows.append((1, i, "u", f"> {before}\nanswer number {i} to that"))
    rows.append((2, 0, "u", "\n".join(f"line number {i} of many" for i in range(5000))))
    rows.append((2, 1, "u", "\n".join(f">> line number {i} of many" for i in range(5000)) + "\ndone"))
    got = {(r.conv_id, r.turn): r for r in quotes.conversations(spark.createDataFrame(rows, SCHEMA)).collect()}
    assert all(got[1, i].reply_depth == i and got[1, i].thread_turn == 0 for i in range(70))
    assert got[2, 1].own_text == "done" and got[2, 1].reply_to_turn == 0


def test_empty_table_and_clashes(spark):
    df = spark.createDataFrame(ROWS, SCHEMA)
    assert quotes.conversations(df.limit(0)).count() == 0
    with pytest.raises(ValueError):
        quotes.conversations(df.selectExpr("*", "1 AS reply_depth"))


def test_query(spark, small):
    from pyspark.sql import functions as F

    source = spark.read.parquet(f"{small}/conversations.parquet")
    got = catalog.QUERIES["op8_quotations"](spark, small)
    assert got.count() == source.count()
    plan = got._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "Arrow" not in plan
    unquoted = source.filter(~F.coalesce(F.col("text"), F.lit("")).rlike("(?m)^[ \t]{0,3}>"))
    same = unquoted.join(got, ["conv_id", "turn", "role"]).filter(F.col("own_text").eqNullSafe(F.col("text")))
    assert same.count() == unquoted.count()
