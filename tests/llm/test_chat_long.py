from pyspark.sql import functions as F

from flowgrain.llm.chat import from_records, to_records

LONG = 20_000_010


def test_texts_beyond_the_parser_limit(spark):
    turns = spark.createDataFrame([(1, 0, "user"), (1, 1, "assistant"), (2, 0, "tool"), (3, 0, "user"), (3, 1, "assistant")],
                                  "conv_id long, turn long, role string")
    text = F.when((F.col("turn") == 0) & (F.col("conv_id") < 3), F.repeat(F.lit("y"), LONG)).otherwise("ok \"q\"")
    rows = from_records(to_records(turns.withColumn("text", text))).select(
        "conv_id", F.transform("turns", lambda t: F.struct(t["role"], F.length(t["text"]), F.right(t["text"], F.lit(2)))).alias("t"))
    got = {r.conv_id: [tuple(t) for t in r.t] for r in rows.collect()}
    assert got == {1: [("user", LONG, "yy"), ("assistant", 6, "q\"")], 2: [("tool", LONG, "yy")],
                   3: [("user", 6, "q\""), ("assistant", 6, "q\"")]}
