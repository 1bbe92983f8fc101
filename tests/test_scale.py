import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from flowgrain import scale


@pytest.fixture(scope="module")
def skewed(spark):
    """A third of all rows under one key; many equal values."""
    rng = np.random.default_rng(7)
    n = 600
    key = np.where(rng.random(n) < 0.35, 0, rng.integers(1, 20, n))
    pdf = pd.DataFrame({"id": np.arange(n), "key": key, "t": rng.permutation(n),
                        "x": rng.integers(0, 25, n).astype(float)})
    return pdf, spark.createDataFrame(pdf).repartition(4)


@pytest.mark.parametrize("bound", [10, 1_000_000])
def test_ranked_by_key(skewed, bound):
    pdf, df = skewed
    got = scale.ranked(df, ["key"], [F.col("t")], "pos", {"run": "x"}, "total",
                       group_rows=bound).toPandas().set_index("id").sort_index()
    want = pdf.sort_values("t")
    pos = (want.groupby("key").cumcount() + 1).sort_index()
    run = want.groupby("key")["x"].cumsum().sort_index()
    assert (got["pos"] == pos).all() and np.allclose(got["run"], run)
    assert (got["total"] == pdf.groupby("key")["x"].transform("size")).all()


def test_ranked_whole_table(skewed):
    pdf, df = skewed
    got = scale.ranked(df, [], [F.col("t")], "pos", {"run": "x"}).toPandas().sort_values("pos")
    assert got["pos"].tolist() == list(range(1, len(pdf) + 1))
    assert np.allclose(got["run"], pdf.sort_values("t")["x"].cumsum())


@pytest.mark.parametrize("bound", [9, 1_000_000])
def test_lagged(skewed, bound):
    pdf, df = skewed
    got = scale.lagged(df, ["key"], [F.col("t")], {"a": ("x", 1), "b": ("x", 5)},
                       group_rows=bound).toPandas().set_index("id").sort_index()
    want = pdf.sort_values("t").groupby("key")["x"]
    assert len(got) == len(pdf)
    for name, steps in (("a", 1), ("b", 5)):
        pd.testing.assert_series_equal(got[name], want.shift(steps).sort_index(),
                                       check_names=False, check_index=False)


@pytest.mark.parametrize("bound", [10, 1_000_000])
@pytest.mark.parametrize("keys", [["key"], []])
def test_percentiles(skewed, bound, keys):
    pdf, df = skewed
    got = scale.percentiles(df, keys, "x", {"p10": 0.1, "p50": 0.5, "p97": 0.97},
                            group_rows=bound).toPandas()
    for q, name in ((0.1, "p10"), (0.5, "p50"), (0.97, "p97")):
        if keys:
            want = pdf.groupby("key")["x"].quantile(q)
            assert np.allclose(got.set_index("key")[name].sort_index(), want)
        else:
            assert np.isclose(got[name].iloc[0], pdf["x"].quantile(q))


@pytest.mark.parametrize("how", ["inner", "left"])
def test_lookup_both_ways(spark, skewed, how):
    pdf, df = skewed
    dim_pdf = pd.DataFrame({"key": np.arange(0, 15), "w": np.arange(15) * 1.5})
    dim = spark.createDataFrame(dim_pdf)
    want = pdf.merge(dim_pdf, on="key", how=how).sort_values("id")["w"].to_numpy()
    for rows in (100, 3):
        got = scale.lookup(df, dim, "key", how, rows).toPandas().sort_values("id")
        assert np.allclose(got["w"].to_numpy(), want, equal_nan=True)


def test_salt_ignores_floats_and_spreads_a_hot_key(spark, skewed):
    _, df = skewed
    salted = df.withColumn("s", scale.salt_of(df, 8, ["key"]))
    moved = df.withColumn("x", F.col("x") * 1.0000001)
    again = moved.withColumn("s", scale.salt_of(moved, 8, ["key"]))
    assert salted.join(again, ["id", "s"]).count() == df.count()
    assert salted.where("key = 0").select("s").distinct().count() == 8


def test_group_join(skewed):
    pdf, df = skewed
    got = scale.group_join(df, ["key"], {"m": F.max("x")}).toPandas().sort_values("id")
    assert (got["m"].to_numpy() == pdf.groupby("key")["x"].transform("max").to_numpy()).all()


def test_fits_measures_wide_rows(spark):
    df = spark.range(10).withColumn("s", F.repeat(F.lit("x"), 1000))
    assert scale.fits(df, 10) and not scale.fits(df, 9)
    assert not scale.fits(df, 10, 5000) and scale.fits(df, 10, 20000)
    assert not scale.fits(df.withColumn("a", F.array_repeat("s", 50)), 10, 200000)


@pytest.mark.parametrize("bound", [3, 1_000_000])
def test_rows_without_a_key_are_a_group(spark, bound):
    rows = [(i, None if i % 4 == 0 else i % 3, float(i % 7)) for i in range(60)]
    df = spark.createDataFrame(rows, "id int, key int, x double")
    pdf = df.toPandas()
    pdf["key"] = pdf["key"].astype("float")
    by = pdf.sort_values("id").groupby("key", dropna=False)["x"]
    ranked = scale.ranked(df, ["key"], [F.col("id")], "pos", {"run": "x"}, group_rows=bound).toPandas()
    ranked = ranked.sort_values("id")
    assert len(ranked) == 60 and np.allclose(ranked["run"], by.cumsum().sort_index())
    lagged = scale.lagged(df, ["key"], [F.col("id")], {"p": ("x", 2)}, group_rows=bound).toPandas()
    assert np.allclose(lagged.sort_values("id")["p"], by.shift(2).sort_index(), equal_nan=True)
    cuts = scale.percentiles(df, ["key"], "x", {"m": 0.5}, group_rows=bound).toPandas()
    assert sorted(cuts["m"]) == sorted(by.median())
    joined = scale.group_join(df, ["key"], {"top": F.max("x")}).toPandas()
    assert len(joined) == 60 and joined["top"].notna().all()
