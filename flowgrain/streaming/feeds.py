"""Feed aggregations as Structured Streaming jobs.

The same operators as in batch, with event time: file sources, watermarks, Parquet
sinks, one checkpoint folder per query.
"""

from __future__ import annotations

import json
import uuid

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from ..operators.spatial import points_near_links
from ..session import shared_dir

C = F.col


def file_stream(spark: SparkSession, folder: str, schema: StructType, pattern: str,
                files_per_trigger: int | None = None) -> DataFrame:
    """Parquet files of a folder as a stream; zoneless times become timestamps."""
    reader = spark.readStream.schema(schema).option("pathGlobFilter", pattern)
    if files_per_trigger:
        reader = reader.option("maxFilesPerTrigger", files_per_trigger)
    df = reader.parquet(folder)
    for f in schema.fields:
        if f.dataType.typeName() == "timestamp_ntz":
            df = df.withColumn(f.name, C(f.name).cast("timestamp"))
    return df


def window_sums(counts: DataFrame, minutes: int = 30, late: str = "15 minutes",
                flow: str = "flow_total") -> DataFrame:
    """Tumbling sums per station; a window is final once the watermark passes its end."""
    w = F.window("ts", f"{minutes} minutes")
    return (counts.withWatermark("ts", late).groupBy(w.alias("w"), "station_id")
            .agg(F.coalesce(F.sum(flow), F.lit(0.0)).alias(flow), F.count(F.lit(1)).alias("n"))
            .select("station_id", C("w.start").alias("bin"), flow, "n"))


def rolling_statistics(probe: DataFrame, length: str = "1 hour", slide: str = "15 minutes",
                       late: str = "15 minutes") -> DataFrame:
    """Sliding mean, deviation and number of speeds per segment."""
    return (probe.withWatermark("ts", late)
            .groupBy(F.window("ts", length, slide).alias("w"), "segment_id")
            .agg(F.avg("speed").alias("speed_avg"), F.stddev("speed").alias("speed_sd"),
                 F.count("speed").alias("n"))
            .select("segment_id", C("w.start").alias("bin"), "speed_avg", "speed_sd", "n"))


def incidents_near_links(incidents: DataFrame, links: DataFrame, reach: float,
                         size: float | None = None) -> DataFrame:
    """Arriving incidents joined to the static links within reach."""
    return points_near_links(incidents, links, reach, size)


def changes(stream: DataFrame, key: str = "station_id", value: str = "flow_total", late: str = "15 minutes"
            ) -> DataFrame:
    """Change of each reading (key, event_id, ts, value) against the one before it in its
    station, in order of event time.

    The state of a station is its last final reading and the readings the watermark has not
    passed yet. A timer at the first of these releases them in order once it is passed, so
    rows that come late but inside ``late`` stand where they belong; later ones are dropped. A
    NULL reading gives NULL, and so does the one after it. The open readings of a station are
    those of ``late``, whatever the length of the stream.
    """
    kind = stream.schema[key].dataType.simpleString()
    rows = (stream.where(C(key).isNotNull() & C("ts").isNotNull()).withWatermark("ts", late)
            .select(key, "ts", C("event_id").cast("long").alias("event_id"), C(value).cast("double").alias("value"),
                    F.unix_micros("ts").alias("at")))

    def step(name, frames, state):
        last, open_ = (json.loads(x) for x in state.get) if state.exists else (None, [])
        passed = state.getCurrentWatermarkMs() * 1000
        for frame in frames:
            for at, event, v in zip(frame["at"], frame["event_id"], frame["value"]):
                one = [int(at), int(event), None if pd.isna(v) else float(v)]
                if last is None or one[:2] > last[:2]:
                    open_.append(one)
        open_.sort(key=lambda x: x[:2])
        ready = [x for x in open_ if x[0] < passed]
        open_ = open_[len(ready):]
        out = []
        for one in ready:
            before = last[2] if last else None
            out.append((name[0], one[1], None if before is None or one[2] is None else one[2] - before))
            last = one
        state.update((json.dumps(last), json.dumps(open_)))
        if open_:
            state.setTimeoutTimestamp(max(passed, open_[0][0]) // 1000 + 1)
        if out:
            yield pd.DataFrame({key: [r[0] for r in out], "event_id": [r[1] for r in out],
                                "change": pd.Series([r[2] for r in out], dtype="float64")})

    # a missing change arrives as NaN, which no difference of readings is
    changed = rows.groupBy(key).applyInPandasWithState(
        step, f"{key} {kind}, event_id long, change double", "last string, open string", "append", "EventTimeTimeout")
    return changed.withColumn("change", F.when(~F.isnan("change"), C("change")))


def run_to_files(stream: DataFrame, mode: str = "append") -> DataFrame:
    """Process all available input into a Parquet folder and return it."""
    spark = stream.sparkSession
    base = f"{shared_dir(spark)}/stream-{uuid.uuid4().hex}"
    query = (stream.writeStream.outputMode(mode).format("parquet")
             .option("path", f"{base}/out").option("checkpointLocation", f"{base}/state")
             .trigger(availableNow=True).start())
    query.awaitTermination()
    return spark.read.schema(stream.schema).parquet(f"{base}/out")
