from pyspark.sql import functions as F

from docloom.operators.session import sessions

SAID = "conv_id long, turn long, text string"


def steps(spark, rows):
    got = sessions(spark.createDataFrame(rows, SAID)).collect()
    return {(r["conv_id"], r["turn"]): (r["action"], r["query"], r["history"], r["category"], r["brand"], r["reset"]) for r in got}


def test_a_session_asks_back_talks_and_starts_again(spark):
    got = steps(spark, [
        (1, 0, "How do I clean my dishwasher?"), (1, 1, "some model"), (1, 2, "  "), (1, 3, "Whirlpool W10"), (1, 4, " it smells "), (1, 5, "yes"),
        (1, 6, "the dishwasher is leaking again"), (1, 7, "my washer is leaking"), (1, 8, "a GE"), (1, 9, "water on the floor"), (1, 10, "washer?"),
        (2, 0, "hello"), (2, 1, "my dryer is broken"), (3, None, None), (3, 1, "My fridge is not cooling"),
    ])
    assert [got[1, t] for t in range(11)] == [
        ("ask_product", None, 1, "dishwasher", None, False),
        ("ask_brand", None, 1, "dishwasher", None, False),
        ("none", None, 1, "dishwasher", None, False),
        ("ask_issue", None, 2, "dishwasher", "Whirlpool", False),
        ("query", "it smells (Whirlpool W10)", 4, "dishwasher", "Whirlpool", False),
        ("query", "yes", 6, "dishwasher", "Whirlpool", False),
        ("query", "the dishwasher is leaking again", 8, "dishwasher", "Whirlpool", False),
        ("ask_product", None, 1, "washer", None, True),
        ("ask_issue", None, 2, "washer", "GE Appliances", False),
        ("query", "water on the floor (a GE)", 4, "washer", "GE Appliances", False),
        ("query", "washer?", 6, "washer", "GE Appliances", False),
    ]
    # no category before: the talk goes on; the server's test asks of no dryer
    assert [got[2, t] for t in (0, 1)] == [("query", "hello", 2, None, None, False), ("query", "my dryer is broken", 4, None, None, False)]
    assert [got[3, t] for t in (None, 1)] == [("none", None, 0, None, None, False), ("ask_product", None, 1, "refrigerator", None, False)]


def test_sessions_of_many_batches_and_null_ids(spark):
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "7")
    rows = [(c, t, "my washer is leaking" if t == 0 else "ge" if t == 1 else f"word {t}") for c in (None, 1, 2) for t in range(50)]
    got = steps(spark, rows)
    spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
    assert len(got) == 150
    for c in (None, 1, 2):
        assert [got[c, t][0] for t in range(4)] == ["ask_product", "ask_issue", "query", "query"] and got[c, 2][1] == "word 2 (ge)" and got[c, 49][2] == 98
    assert sessions(spark.createDataFrame([], SAID).withColumn("action", F.lit("x"))).count() == 0
