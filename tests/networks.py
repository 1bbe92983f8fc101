"""Small networks with hand-checkable numbers."""

from pyspark.sql import functions as F

from flowgrain.operators.network import paths_from_nodes

LINK_SCHEMA = "u int, v int, idx string, tf double, k double, alpha double, beta double, tt double"


def links(spark, rows, k):
    ks = k if isinstance(k, (list, tuple)) else [k] * len(rows)
    data = [(u, v, idx, float(tf), float(kk), 0.15, 4.0, float(tf))
            for (u, v, idx, tf), kk in zip(rows, ks)]
    return spark.createDataFrame(data, LINK_SCHEMA)


def toy(spark):
    rows = [(1, 3, "0", 1), (2, 3, "0", 2), (3, 4, "0", 3), (3, 4, "1", 4)]
    net = links(spark, rows, 1800)
    od = spark.createDataFrame([(1, 4, 500.0), (2, 4, 500.0), (3, 4, 500.0)],
                               "o int, d int, q double")
    return net, od


# The published nine-node example, its links with free-flow times and
# capacities, and its demand.
YANG = [(1, 2), (1, 4), (1, 5), (2, 3), (2, 5), (3, 6), (4, 5), (4, 7), (5, 6), (5, 8), (5, 9),
        (6, 9), (7, 8), (8, 9)]
YANG_TF = [2, 1.5, 3, 1, 1, 2, 2, 1, 1.5, 1, 2, 1, 1, 1]
YANG_K = [280, 290, 280, 280, 600, 300, 500, 400, 500, 700, 250, 300, 350, 220]
YANG_Q = {(1, 6): 120, (1, 8): 150, (1, 9): 100, (2, 6): 130, (2, 8): 200, (2, 9): 90,
          (4, 6): 80, (4, 8): 180, (4, 9): 110}


def yang(spark):
    rows = [(u, v, "0", 1.5 * t) for (u, v), t in zip(YANG, YANG_TF)]
    od = spark.createDataFrame([(o, d, float(q)) for (o, d), q in YANG_Q.items()],
                               "o int, d int, q double")
    net = links(spark, rows, YANG_K).withColumn("c", (F.col("u") * 3 + F.col("v") * 5) % 7 / 10.0)
    return net, od


def simple_paths(edges, o, d, cutoff):
    """Node lists of all simple paths, by plain recursion."""
    out, nbrs = [], {}
    for u, v in edges:
        nbrs.setdefault(u, []).append(v)

    def go(path):
        if path[-1] == d:
            out.append(list(path))
            return
        if len(path) > cutoff:
            return
        for v in nbrs.get(path[-1], []):
            if v not in path:
                go([*path, v])
    go([o])
    return out


def yang_paths(spark):
    nodes = [p for o, d in YANG_Q for p in simple_paths(YANG, o, d, 8)]
    return paths_from_nodes(spark.createDataFrame([(n,) for n in nodes], "nodes array<int>"))
