import hashlib
import json

import duckdb
from pyspark.sql import functions as F

from flowgrain.llm import chat
from flowgrain.llm.chat import chat_format, format_chats, loss_mask, masked_text, read_back
from flowgrain.llm.queries_layout import CHAT_SQL, ODD, op8

from .cases import SMALL, folder

COLUMNS = ["conv_id", "n_turns", "turns_sha256", "loss_chars", "loss_sha256", "formatted_chars"]


def twin(path):
    con = duckdb.connect()
    con.execute(f"CREATE VIEW conversations AS SELECT * FROM '{path}'")
    return sorted(con.execute(f"SELECT {', '.join(COLUMNS)} FROM ({CHAT_SQL})").fetchall(), key=str)


def got(df):
    return sorted((tuple(r) for r in df.select(COLUMNS).collect()), key=str)


def test_query_against_sql(spark):
    assert got(op8(spark, SMALL)) == twin(f"{SMALL}/conversations.parquet")


def test_awkward_rows(spark, tmp_path):
    rows = [(1, 0, "user", None), (1, 1, "assistant", ""), (2, 0, "assistant", ODD), (2, 1, "a: b###</turn>", ": \\b\\\\t"),
            (3, 0, "user", "same"), (3, 0, "user", "same"), (4, None, None, "#### ## </turn> </turn>\n\\"),
            (None, 1, "user", "lost"), (5, 0, "system", "x"), (5, 1, "user", "y" * 30000), (5, 2, "assistant", "\u0000\U0001f600"),
            (6, 0, "user", "ends with </turn"), (6, 1, "assistant", " </turn>"), (7, 0, "tool", "{\"a\": 1}")]
    turns = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").selectExpr(
        "*", "1 as record", "2 as turns", "3 as formatted")
    sf = folder(tmp_path, spark, conversations=turns)
    assert got(op8(spark, sf)) == twin(f"{sf}/conversations.parquet/*.parquet")
    odd = [r for r in op8(spark, sf).collect() if r.conv_id == -7]
    assert odd[0].loss_sha256 == hashlib.sha256(ODD.encode()).hexdigest() and odd[0].n_turns == 2


def test_empty_table(spark, tmp_path):
    turns = spark.createDataFrame([], "conv_id long, turn long, role string, text string")
    assert [r.conv_id for r in op8(spark, folder(tmp_path, spark, conversations=turns)).collect()] == [-7]


def test_layouts_give_the_same_turns(spark):
    pair = [("user", "hi"), ("assistant", "yo")]
    three = [("system", "be brief"), *pair]
    cases = [({"prompt": "hi", "response": "yo"}, pair), ({"prompt": "hi", "completion": "yo"}, pair),
             ({"instruction": "hi", "output": "yo"}, pair),
             ({"instruction": "be brief", "input": "hi", "output": "yo"}, three),
             ({"response": "yo", "system": "be brief", "prompt": "hi"}, three),
             ({"messages": [{"role": r, "content": t} for r, t in three]}, three),
             ({"conversations": [{"from": "human", "value": "hi"}, {"from": "gpt", "value": "yo"}]}, pair),
             ({"prompt": None, "response": "yo"}, [("user", ""), ("assistant", "yo")]),
             ({"data": {"prompt": "hi", "response": "yo"}}, pair),
             ({"messages": [{"role": "user", "content": [{"type": "text", "text": "h"}, {"type": "text", "text": "i"}]},
                            {"role": "assistant", "content": [{"type": "text", "text": "yo"}]}]}, pair),
             ({"other": 1}, None), ([1, 2], None)]
    rows = [(i, json.dumps(c)) for i, (c, _) in enumerate(cases)] + [(90, None), (91, "{broken")]
    df = format_chats(spark.createDataFrame(rows, "id int, record string").selectExpr("*", "1 as schema_print"))
    found = {r.id: r.turns and [tuple(t) for t in r.turns] for r in df.collect()}
    assert found == {i: want for i, (_, want) in enumerate(cases)} | {90: None, 91: None}


ODD_FIELDS = [{"prompt": "p", "response": "r", **more} for more in (
    {}, {"sys-prompt": "SECRET"}, {"sys.tem": "x"}, {"\u00e9": "x"}, {"a b": 1}, {"`": 1}, {"a: STRING": None}, {"": "x"})] + [
    {"prompt": ["p"], "response": "r"}, {"prompt": {"x": "p"}, "response": "r"}, {"prompt": 1, "response": "r"},
    {"prompt": "a \" : b", "response": "{\"x\": [1]}\\"}, {"data": {"prompt": "p", "response": "r", "more": 1}},
    {"messages": []}, {"messages": [{"role": "user", "content": "x", "name": "y"}]},
    {"messages": [{"role": "user", "content": "x"}, {"role": "assistant", "content": ["y"]}]}]


def test_odd_names_short_and_long(spark, monkeypatch):
    """An unknown layout never passes for a known one, whichever way a record is read."""
    rows = [(i, json.dumps(c)) for i, c in enumerate(ODD_FIELDS)] + [(99, '{"prompt" : "p" , "response":"r"}')]
    frame = spark.createDataFrame(rows, "id int, record string")
    short = {r.id: (r.schema_print, r.turns) for r in chat.from_records(frame).collect()}
    assert {i for i, (_, t) in short.items() if t is not None} == {0, 10, 11, 99}
    assert short[11][1][1].text == ODD_FIELDS[11]["response"]
    outlined = frame.withColumn("long", F.try_parse_json(chat._outline(F.col("record")))).withColumn(
        "print", chat.fingerprint(F.schema_of_variant("long"))).withColumn("turns", chat._long_turns(F.col("record"), F.col("print")))
    assert {r.id: (r.print, r.turns) for r in outlined.collect()} == short


def test_round_trip_and_mask(spark):
    texts = ["", "\\", "\\h", "###", "####", "</turn>", " </turn>\n", "\\### Assistant: </turn> ok", "### assistant: x", "\\\\b", "a: b", "\U0001f600"]
    turns = [{"role": r, "text": t} for t in texts for r in ("user", "assistant")]
    df = spark.createDataFrame([(turns,)], "turns array<struct<role:string,text:string>>")
    df = df.withColumn("f", chat_format(F.col("turns"))).withColumn("spans", loss_mask(F.col("f")))
    r = df.select("f", read_back(F.col("f")).alias("back"), masked_text(F.col("f"), F.col("spans")).alias("m")).first()
    assert [tuple(t) for t in r.back] == [(t["role"], t["text"]) for t in turns]
    assert r.m == "".join(texts)
    assert r.f.count("</turn>") == len(turns)
