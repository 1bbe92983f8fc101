"""Readers. Every file format becomes a DataFrame with an explicit schema; bad cells are NULL."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.scalars import clean_text, feed_time, km_to_miles, text_flag
from ..operators.filters import clock_interval, date_parts, period_filter
from ..operators.joins import remap_nodes
from ..operators.network import paths_from_nodes
from ..scale import lookup, ranked
from ..session import pin
from . import schemas as S

C = F.col
Paths = str | Sequence[str]


def _files(paths: Paths) -> list[str]:
    return [paths] if isinstance(paths, str) else list(paths)


def _line_order() -> Column:
    """Sorts like the lines of the files: by file name, then by place in the file."""
    return F.struct("_metadata.file_path", "_metadata.file_block_start",
                    F.monotonically_increasing_id().alias("at"))


# feeds ---------------------------------------------------------------------------------

def read_counts(spark: SparkSession, paths: Paths, hour: int | None = None,
                minutes: int | None = None, compat: bool = False) -> DataFrame:
    """Loop counts with ``ts_casted`` and its parts, of one clock interval when given."""
    df = spark.read.schema(S.COUNTS).csv(_files(paths))
    df = df.withColumn("ts_casted", feed_time("ts"))
    df = date_parts(df, "ts_casted")
    if hour is not None and minutes is not None:
        df = clock_interval(df, hour, minutes, "ts_casted", compat)
    return df


def read_probe(spark: SparkSession, paths: Paths, period: Mapping[str, object] | None = None,
               time_basis: str = "mixed") -> DataFrame:
    """Probe speeds in miles per hour, closures as 0/1.

    Dates come from the local date column and clock times from the UTC column;
    ``time_basis='ts'`` takes both from the latter.
    """
    df = spark.read.schema(S.PROBE).option("header", True).csv(_files(paths))
    df = df.withColumn("dt", F.try_to_date("dt")).withColumn("ts", C("ts").try_cast("timestamp_ntz"))
    df = df.withColumn("road_closure_num", text_flag("road_closure"))
    for name in ("speed", "speed_hist", "speed_ref"):
        df = df.withColumn(name, km_to_miles(name))
    df = date_parts(df, "ts", "dt" if time_basis == "mixed" else "ts")
    return period_filter(df, period or {})


def read_incidents(spark: SparkSession, paths: Paths, county: str,
                   period: Mapping[str, object] | None = None) -> DataFrame:
    """Incidents of a county from a wide file with a header; only chosen columns are read."""
    df = spark.read.option("header", True).csv(_files(paths)).select(*S.INCIDENT_COLUMNS)
    df = df.where(C("County") == county)
    df = df.withColumn("start_ts", C("Start_Time").try_cast("timestamp_ntz"))
    return period_filter(date_parts(df, "start_ts"), period or {})


def read_stops(spark: SparkSession, paths: Paths) -> DataFrame:
    return spark.read.schema(S.STOPS).option("header", True).csv(_files(paths))


def read_stations(spark: SparkSession, paths: Paths, county: int) -> DataFrame:
    """Station metadata, tab separated with a header, of one county code."""
    df = spark.read.option("header", True).option("sep", "\t").csv(_files(paths))
    return df.where(C("County").try_cast("int") == county).select(
        C("ID").try_cast("int").alias("station_id"), C("Latitude").try_cast("double").alias("lat"),
        C("Longitude").try_cast("double").alias("lon"))


# network files -------------------------------------------------------------------------

def read_tntp_links(spark: SparkSession, paths: Paths) -> DataFrame:
    """Link tables of any number of networks in one job; node ids become 0-based.

    Metadata (``<``), header (``~``) and empty lines are dropped; the network is the
    name of the folder that holds the file.
    """
    raw = spark.read.text(_files(paths)).select(
        F.regexp_extract(C("_metadata.file_path"), r"(?:network=)?([^/=]+)/[^/]+$", 1)
        .alias("network"), F.trim(F.regexp_replace("value", r"[\t ;]+$", "")).alias("line"))
    rows = raw.where((C("line") != "") & ~C("line").rlike(r"^\s*[<~]"))
    cells = F.split(F.regexp_replace("line", r"^[\t ]+", ""), r"\t")
    cell = {n: F.trim(F.get(cells, F.lit(i))).try_cast("double") for i, n in enumerate(S.TNTP_LINK)}
    out = rows.select("network", *[e.alias(n) for n, e in cell.items()])
    return out.withColumns({"init_node": C("init_node").cast("int") - 1,
                            "term_node": C("term_node").cast("int") - 1,
                            "link_type": C("link_type").cast("int")})


def read_tntp_header(spark: SparkSession, paths: Paths) -> DataFrame:
    """Column names of the header line, trimmed and lower case."""
    raw = spark.read.text(_files(paths)).where(C("value").rlike(r"^\s*~"))
    names = F.filter(F.transform(F.split("value", r"\t"), clean_text),
                     lambda n: ~n.isin("~", ";", ""))
    return raw.select(names.alias("names")).distinct()


def read_tntp_trips(spark: SparkSession, paths: Paths) -> DataFrame:
    """Demand rows from ``Origin`` blocks of ``dest : flow;`` pairs, 1-based ids.

    A block is one record, so a big file splits by origin.
    """
    blocks = spark.read.option("lineSep", "Origin").text(_files(paths)).where(
        C("value").rlike(r"^\s*\d+"))
    pair = F.explode(F.regexp_extract_all("value", F.lit(r"(\d+\s*:\s*[-+.0-9eE]+)\s*;"), 1))
    rows = blocks.select(F.regexp_extract("value", r"^\s*(\d+)", 1).cast("int").alias("o"),
                         pair.alias("cell"))
    part = F.split("cell", r"\s*:\s*")
    return rows.select("o", F.get(part, F.lit(0)).cast("int").alias("d"),
                       F.get(part, F.lit(1)).try_cast("double").alias("q"))


def read_tntp_network(spark: SparkSession, paths: Paths) -> tuple[DataFrame, DataFrame]:
    """Links keyed (u, v, idx) and the adjacency they imply."""
    from ..operators.network import adjacency
    links = read_tntp_links(spark, paths).select(
        "network", C("init_node").alias("u"), C("term_node").alias("v"),
        F.lit("0").alias("idx"), *S.TNTP_LINK[2:])
    return links, adjacency(links)


def number_nodes(nodes: DataFrame) -> DataFrame:
    """Sequential 0-based keys by node id."""
    return ranked(nodes, [], [C("id")], "key").withColumn("key", (C("key") - 1).cast("int"))


def read_city_network(spark: SparkSession, node_paths: Paths, link_paths: Paths,
                      variant: str = "a") -> tuple[DataFrame, DataFrame]:
    """Tab-separated node and link files of a city; link ends remapped to node keys.

    ``variant`` picks the column layout of the first (a) or second (b) city.
    """
    ns, ls = (S.NODES, S.LINKS) if variant == "a" else (S.NODES_B, S.LINKS_B)
    tab = {"sep": "\t", "header": "true"}
    nodes = number_nodes(spark.read.schema(ns).options(**tab).csv(_files(node_paths)))
    links = spark.read.schema(ls).options(**tab).csv(_files(link_paths))
    links = remap_nodes(links, nodes, "init_node_id", "term_node_id")
    for name in ("length", "ff_speed", "capacity", "lane"):
        links = links.withColumn(name, F.trim(name).try_cast("double"))
    return nodes, links


def read_edge_network(spark: SparkSession, edge_paths: Paths, link_paths: Paths,
                      node_paths: Paths) -> tuple[DataFrame, DataFrame]:
    """Third city: an edge list, a link attribute file and a node file, comma separated."""
    csv = spark.read.option("header", True)
    nodes = number_nodes(csv.schema(S.NODES_B).csv(_files(node_paths)))
    edges = spark.read.option("header", True).schema(S.EDGES_C).csv(_files(edge_paths))
    attrs = spark.read.option("header", True).csv(_files(link_paths))
    both = edges.join(attrs, "link_id")
    return nodes, remap_nodes(both, nodes, "init_node_id", "term_node_id")


def read_wide_counts(spark: SparkSession, paths: Paths) -> DataFrame:
    """Counts with one column per interval, turned long; empty cells are NULL.

    The interval ``07:15`` is named ``07.15``.
    """
    df = spark.read.option("header", True).csv(_files(paths))
    link, times = df.columns[0], df.columns[1:]
    cells = F.array(*[F.struct(F.lit(t.replace(":", ".")).alias("time_interval"),
                               F.expr(f"try_cast(`{t}` AS double)").alias("count"))
                      for t in times])
    return df.select(C(link).alias("link_id"), F.explode(cells).alias("c")).select("link_id", "c.*")


def read_od_csv(spark: SparkSession, paths: Paths, nodes: DataFrame) -> DataFrame:
    """Demand by node keys; of repeated pairs the last line counts."""
    df = spark.read.schema(S.OD_CSV).option("header", True).csv(_files(paths))
    df = df.withColumn("_line", _line_order())
    last = df.groupBy("origin", "destination").agg(F.max_by("demand", "_line").alias("q"))
    out = remap_nodes(last, nodes, "origin", "destination")
    return out.select(C("u").alias("o"), C("v").alias("d"), "q")


def read_dynamic_od(spark: SparkSession, paths: Paths, periods: Sequence[int]) -> DataFrame:
    """Sum of the chosen periods (1..6) from ``Origin: n`` / ``Dest: n`` / demands lines."""
    if any(p not in range(1, 7) for p in periods):
        raise ValueError("periods must be among 1..6")
    blocks = spark.read.option("lineSep", "Origin").text(_files(paths)).where(
        C("value").rlike(r"^\s*:\s*\d+"))
    rows = blocks.select(
        F.regexp_extract("value", r"^\s*:\s*(\d+)", 1).cast("int").alias("o"),
        F.explode(F.slice(F.split("value", "Dest"), 2, 1 << 30)).alias("part"))
    nums = F.split(F.trim(F.regexp_extract("part", r"^\s*:\s*\d+\s*\n([^\n]*)", 1)), r"\s+")
    picked = sum((F.coalesce(F.get(nums, F.lit(p - 1)).try_cast("double"), F.lit(0.0))
                  for p in periods), F.lit(0.0))
    return rows.select("o", F.regexp_extract("part", r"^\s*:\s*(\d+)", 1).cast("int").alias("d"),
                       picked.alias("q"))


def read_paths(spark: SparkSession, paths: Paths, sep: str = ",",
               nodes: DataFrame | None = None) -> DataFrame:
    """One path per line. With ``nodes`` the ids are remapped to keys position by position."""
    lines = spark.read.text(_files(paths)).where(F.trim("value") != "")
    ids = F.transform(F.filter(F.split(F.trim("value"), sep), lambda t: F.trim(t) != ""),
                      lambda t: F.trim(t).try_cast("int"))
    df = lines.select(ids.alias("nodes"))
    if nodes is not None:
        df = df.select(F.array_join(F.transform("nodes", lambda n: n.cast("string")), "/")
                       .alias("_line"), F.posexplode("nodes").alias("_pos", "id"))
        hit = lookup(df, nodes.select("id", "key"), "id", "inner")
        # a path holds few nodes; equal lines are one path
        df = hit.groupBy("_line").agg(F.sort_array(F.collect_set(F.struct("_pos", "key")))
                                      .alias("_n"))
        df = df.select(F.transform("_n", lambda s: s.key.cast("int")).alias("nodes"))
    return paths_from_nodes(df)


def read_dense_matrix(spark: SparkSession, paths: Paths, sep: str = ",") -> DataFrame:
    """Nonzero cells (row, col, value), 0-based, of a dense text matrix."""
    lines = pin(spark.read.text(_files(paths)).select("value", _line_order().alias("_id")))
    lines = ranked(lines, [], [C("_id")], "row")
    cells = lines.select((C("row") - 1).alias("row"),
                         F.posexplode(F.split("value", sep)).alias("col", "text"))
    out = cells.select("row", C("col").cast("long").alias("col"),
                       F.trim("text").try_cast("double").alias("value"))
    return out.where(C("value") != 0)


def read_network(spark: SparkSession, folder: str, tables: Sequence[str]) -> dict[str, DataFrame]:
    """Chosen network tables from Parquet folders."""
    return {t: spark.read.parquet(f"{folder}/{t}") for t in tables}


# layers --------------------------------------------------------------------------------

def census_blocks(geometry: DataFrame, income: DataFrame, age: DataFrame, fips: str) -> DataFrame:
    """Blocks of a county with income and age; tables join on the tail of the block id."""
    key = F.substr(C("GEOID"), F.lit(8))
    geo = geometry.where(F.substring("GEOID", 1, 5) == fips).withColumn("_k", key)
    inc = income.select(key.alias("_k"), "median_inc")
    old = age.select(key.alias("_k"), "median_age")
    return geo.join(inc, "_k").join(old, "_k").drop("_k")


def county_segments(segments: DataFrame, county: str) -> DataFrame:
    return segments.where(C("County") == county)


def read_layer(spark: SparkSession, paths: Paths, kind: str = "line") -> DataFrame:
    """Geometry layer from WKT text: x1..y2 for lines, x and y for points."""
    df = spark.read.parquet(*_files(paths))
    nums = F.regexp_extract_all("wkt", F.lit(r"(-?\d+(?:\.\d+)?)"), 1)
    names = ("x1", "y1", "x2", "y2") if kind == "line" else ("x", "y")
    return df.withColumns({n: F.get(nums, F.lit(i)).try_cast("double")
                           for i, n in enumerate(names)}).drop("wkt")


def parse_link_key(text: Column | str) -> list[Column]:
    """u, v, idx from key text such as ``(3, 7, '0')``."""
    text = C(text) if isinstance(text, str) else text
    parts = F.regexp_extract_all(text, F.lit(r"(\w+)"), 1)
    return [F.get(parts, F.lit(0)).try_cast("int").alias("u"),
            F.get(parts, F.lit(1)).try_cast("int").alias("v"),
            F.coalesce(F.get(parts, F.lit(2)), F.lit("0")).alias("idx")]


def read_link_table(spark: SparkSession, paths: Paths, numeric: Sequence[str] = ()) -> DataFrame:
    """Processed link table with tuple-text keys in ``link_key``."""
    df = spark.read.option("header", True).csv(_files(paths))
    rest = [c for c in df.columns if c != "link_key"]
    return df.select(*parse_link_key("link_key"),
                     *[(C(c).try_cast("double").alias(c) if c in numeric else C(c)) for c in rest])
