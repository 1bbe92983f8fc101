"""Explicit schemas of feed and network files. Column orders are fixed by the formats."""

from __future__ import annotations

from pyspark.sql.types import (DoubleType, IntegerType, StringType, StructField, StructType)

_T = {"i": IntegerType(), "d": DoubleType(), "s": StringType()}


def schema(spec: str) -> StructType:
    """Schema from ``name:type`` words; types are i(nt), d(ouble), s(tring)."""
    pairs = [w.split(":") for w in spec.split()]
    return StructType([StructField(n, _T[t]) for n, t in pairs])


# Loop counts, 5 minutes, no header: 12 columns, then 5 for each of 8 lanes.
COUNTS = schema(
    "ts:s station_id:i district_id:i freeway_id:i travel_direction:s lane_type:s "
    "observed_lanes_pct:d station_length:d samples:i flow_total:d occupancy_avg:d speed_avg:d "
    + " ".join(f"samples_lane_{i}:i flow_total_lane_{i}:d occupancy_avg_lane_{i}:d "
               f"speed_avg_lane_{i}:d observed_lane_{i}:d" for i in range(1, 9)))

# Probe speeds, 15 minutes, header; columns are renamed by position.
PROBE = schema("dt:s segment_id:i ts:s speed:d speed_hist:d speed_ref:d travel_time:d "
               "confidence:d pct30:d pct20:d pct10:d road_closure:s name:s")

INCIDENT_COLUMNS = ["Severity", "Start_Time", "End_Time", "Start_Lat", "Start_Lng", "End_Lat",
                    "End_Lng", "County"]

STOPS = schema("stop_id:s stop_code:s stop_name:s stop_desc:s stop_lat:d stop_lon:d zone_id:s "
               "stop_url:s location_type:s parent_station:s stop_timezone:s "
               "wheelchair_boarding:s")

NODES = schema("id:i type:s x:d y:d")
LINKS = schema("id:i link_type:s name:s init_node_id:i term_node_id:i length:s ff_speed:s "
               "capacity:s rhoj:s lane:s")
# The second city's files: same roles, other columns and order.
NODES_B = schema("id:i x:d y:d")
LINKS_B = schema("id:i init_node_id:i term_node_id:i length:s ff_speed:s capacity:s lane:s "
                 "link_type:s")
EDGES_C = schema("link_id:s init_node_id:i term_node_id:i")
OD_CSV = schema("origin:i destination:i demand:d")
TNTP_LINK = ["init_node", "term_node", "capacity", "length", "free_flow_time", "b", "power",
             "speed", "toll", "link_type"]
