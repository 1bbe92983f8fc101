import datetime as dt

import pytest
from pyspark.sql import functions as F

from flowgrain.sources import files, sinks
from flowgrain.streaming import feeds

NET = """<NUMBER OF ZONES> 3\t\t
<FIRST THRU NODE> 1
<END OF METADATA>\t

~ \tInit node \tTerm node \tcapacity\tlength\tfree_flow_time\tb\tpower\tspeed\ttoll\tlink_type\t;
\t1\t2\t25900.20064\t6\t6\t0.15\t4\t0\t0\t1\t;
\t2\t3\t4958.180928\t5\tbad\t0.15\t4\t0\t0\t1\t;
"""
TRIPS = """<NUMBER OF ZONES> 3
<TOTAL OD FLOW> 700.0
<END OF METADATA>

Origin \t1
    1 :      0.0;     2 :    100.0;     3 :    200.0;

Origin  2
    3 :    400.5;
"""


def test_tntp_files(spark, tmp_path):
    folder = tmp_path / "Three"
    folder.mkdir()
    (folder / "Three_net.tntp").write_text(NET)
    (folder / "Three_trips.tntp").write_text(TRIPS)
    links = files.read_tntp_links(spark, str(folder / "Three_net.tntp")).orderBy("init_node").collect()
    assert [(r["network"], r["init_node"], r["term_node"], r["free_flow_time"]) for r in links] == [
        ("Three", 0, 1, 6.0), ("Three", 1, 2, None)]
    assert files.read_tntp_header(spark, str(folder / "Three_net.tntp")).first()["names"][:3] == [
        "init node", "term node", "capacity"]
    od = {(r["o"], r["d"]): r["q"] for r in
          files.read_tntp_trips(spark, str(folder / "Three_trips.tntp")).collect()}
    assert od == {(1, 1): 0.0, (1, 2): 100.0, (1, 3): 200.0, (2, 3): 400.5}


def test_dynamic_demand(spark, tmp_path):
    f = tmp_path / "od.txt"
    f.write_text("Origin: 7\nDest: 8\n 1 2 3 4 5 6\nDest: 9\n10  20 30 40 50 60\nOrigin: 9\nDest: 7\n0 0 1 0 0 2\n")
    got = {(r["o"], r["d"]): r["q"] for r in files.read_dynamic_od(spark, str(f), [1, 3, 6]).collect()}
    assert got == {(7, 8): 10.0, (7, 9): 100.0, (9, 7): 3.0}
    with pytest.raises(ValueError):
        files.read_dynamic_od(spark, str(f), [0])


def test_repeated_demand_last_line_counts(spark, tmp_path):
    f = tmp_path / "od.csv"
    f.write_text("origin,destination,demand\n10,20,1\n20,10,2\n10,20,5\n99,10,7\n")
    nodes = spark.createDataFrame([(10, 0), (20, 1)], "id int, key int")
    got = {(r["o"], r["d"]): r["q"] for r in files.read_od_csv(spark, str(f), nodes).collect()}
    assert got == {(0, 1): 5.0, (1, 0): 2.0}


def test_paths_and_matrix(spark, tmp_path):
    f = tmp_path / "p.csv"
    f.write_text("0,1,3\n0,2,3\n\n")
    got = files.read_paths(spark, str(f)).orderBy("path_id").collect()
    assert [(r["path_id"], r["o"], r["d"], len(r["segs"])) for r in got] == [
        ("0/1/3", 0, 3, 2), ("0/2/3", 0, 3, 2)]
    m = tmp_path / "m.csv"
    m.write_text("0,1.5,0\n0,0,0\n2,0,-3\n")
    cells = {(r["row"], r["col"]): r["value"] for r in files.read_dense_matrix(spark, str(m)).collect()}
    assert cells == {(0, 1): 1.5, (2, 0): 2.0, (2, 2): -3.0}


def test_link_keys_from_text(spark):
    df = spark.createDataFrame([("(3, 17, '0')",), ("(4, 5)",), ("(1, 2, '12')",)], "k string")
    rows = df.select(*files.parse_link_key("k")).collect()
    assert [tuple(r) for r in rows] == [(3, 17, "0"), (4, 5, "0"), (1, 2, "12")]


def test_days_are_folders(spark, tmp_path):
    df = spark.createDataFrame([(i, dt.date(2024, 1, 1 + i % 3)) for i in range(30)], "id int, dt date")
    sinks.write_days(df, str(tmp_path / "days"))
    assert sorted(p.name for p in (tmp_path / "days").glob("dt=*")) == [
        f"dt=2024-01-0{i}" for i in (1, 2, 3)]
    assert spark.read.parquet(str(tmp_path / "days")).count() == 30


def test_replicates_accumulate(spark, tmp_path):
    df = spark.range(3)
    for rep in (1, 2, 3):
        sinks.write_replicate(df, str(tmp_path / "r"), rep)
    assert sinks.cumulative_replicates(spark, str(tmp_path / "r"), 2).count() == 6


def test_stream_changes_across_batches(spark, tmp_path):
    """Four files, four batches: readings that come late but inside the watermark, missing
    readings and one that comes far too late."""
    src = tmp_path / "in"
    src.mkdir()
    start = dt.datetime(2024, 1, 1)
    rows = [(n, n % 3, start + dt.timedelta(minutes=n), None if n % 11 == 5 else float(n * n % 17)) for n in range(120)]
    batches = [rows[i:i + 30] for i in range(0, 120, 30)]
    for i in (25, 28, 55):  # late by less than a quarter of an hour
        late = rows[i]
        batches[i // 30].remove(late)
        batches[i // 30 + 1].insert(0, late)
    lost = (500, 1, start + dt.timedelta(minutes=2, seconds=30), 99.0)
    for i, part in enumerate(batches):
        part = part + [lost] if i == 3 else part
        (spark.createDataFrame(part, "event_id long, station_id int, ts timestamp, flow_total double")
         .coalesce(1).write.parquet(str(src / f"b{i}")))
    schema = spark.read.parquet(str(src / "b0")).schema
    stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(f"{src}/*")
    got = [(r["event_id"], r["change"]) for r in feeds.run_to_files(feeds.changes(stream)).collect()]
    last, want = {}, []
    for e, s, ts, x in rows:
        before = last.get(s)
        if ts < rows[-1][2] - dt.timedelta(minutes=15):
            want.append((e, None if before is None or x is None else x - before))
        last[s] = x
    assert sorted(got, key=str) == sorted(want, key=str)


def test_stream_windows_equal_batch(spark, tmp_path):
    rows = [(i % 2, dt.datetime(2024, 1, 1) + dt.timedelta(minutes=7 * i), float(i)) for i in range(60)]
    df = spark.createDataFrame(rows, "station_id int, ts timestamp, flow_total double")
    df.coalesce(1).write.parquet(str(tmp_path / "w"))
    stream = feeds.file_stream(spark, str(tmp_path / "w"), df.schema, "*.parquet")
    got = feeds.run_to_files(feeds.window_sums(stream))
    from flowgrain.operators.aggregates import resample
    want = resample(df, fill=False)
    end = df.agg(F.max("ts")).first()[0] - dt.timedelta(minutes=45)
    same = got.join(want.withColumnRenamed("flow_total", "w"), ["station_id", "bin"])
    assert got.count() == want.where(F.col("bin") <= F.lit(end)).count() == same.count()
    assert same.where("flow_total <> w").count() == 0
