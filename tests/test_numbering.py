"""Split groups give the same numbers as a plain window."""

import random

import pytest
from pyspark.sql import Window, functions as F

from trialspark.operators import numbering as W
from trialspark.operators.quantiles import exact_median, most_frequent

LIMITS = [{}, {"min_rows": 5, "slices": 30}, {"min_rows": 1, "slices": 5000}]


@pytest.fixture(scope="module")
def rows(spark, tmp_path_factory):
    """A third of the rows in one group, a null group, null and tied keys."""
    rng = random.Random(1)
    data = []
    for i in range(2000):
        g = 1 if i % 3 == 0 else (None if i % 11 == 0 else rng.randrange(60))
        day = f"2024-{rng.randrange(1, 13):02d}-{rng.randrange(1, 29):02d}"
        value = None if i % 13 == 0 else round(rng.lognormvariate(0, 2), 1)
        data.append((i, g, day, value, f"AB-{rng.randrange(50):03d}é{i:05d}"))
    path = str(tmp_path_factory.mktemp("numbering") / "rows")
    spark.createDataFrame(data, "i int, g int, day string, v double, s string").write.parquet(path)
    df = spark.read.parquet(path)
    return df.withColumn("d", F.to_date("day")).withColumn("ts", F.col("d").cast("timestamp_ntz"))


@pytest.mark.parametrize("limits", LIMITS)
@pytest.mark.parametrize("order", [["i"], ["day", "i"], ["d", "i"], ["ts", "i"], ["v", "i"], ["s"]])
def test_numbered_equals_window(rows, order, limits):
    w = Window.partitionBy("g")
    got = W.numbered(rows, ["g"], order, "n", total="of", **limits)
    want = rows.select(
        "i", F.row_number().over(w.orderBy(*order)).alias("n"), F.count("*").over(w).alias("of")
    )
    assert got.columns == [*rows.columns, "n", "of"]
    assert sorted(got.select("i", "n", "of").collect()) == sorted(want.collect())


@pytest.mark.parametrize("limits", LIMITS)
def test_global_sequence_equals_window(rows, limits):
    got = W.global_sequence(rows, "g", ["s"], "n", **limits).select("i", "n").collect()
    want = rows.select("i", F.row_number().over(Window.orderBy("g", "s")).alias("n")).collect()
    assert sorted(got) == sorted(want)


@pytest.mark.parametrize("limits", LIMITS)
def test_arms_rotate_within_site(rows, limits):
    got = W.allocate_arms(rows, "g", ["i"], **limits)
    sizes = got.groupBy("g", "TRT01PN").count().groupBy("g").agg(
        (F.max("count") - F.min("count")).alias("gap")
    )
    assert sizes.agg(F.max("gap")).first()[0] <= 1


def test_first_last_flags(rows):
    for limits in LIMITS:
        got = W.first_last(rows, "g", ["day", "i"], **limits)
        per = got.groupBy("g").agg(
            F.sum((F.col("FIRSTFL") == "Y").cast("int")).alias("f"),
            F.sum((F.col("LASTFL") == "Y").cast("int")).alias("l"),
            F.min(F.struct("day", "i")).alias("lo"), F.max(F.struct("day", "i")).alias("hi"),
            F.max(F.when(F.col("FIRSTFL") == "Y", F.struct("day", "i"))).alias("first"),
            F.max(F.when(F.col("LASTFL") == "Y", F.struct("day", "i"))).alias("last"),
        )
        assert per.filter("f <> 1 or l <> 1 or lo <> first or hi <> last").count() == 0


@pytest.mark.parametrize("limits", LIMITS)
@pytest.mark.parametrize("descending", [False, True])
def test_running_equals_window(rows, limits, descending):
    counts = rows.groupBy("g", "v").agg(F.count("*").alias("c")).filter("v is not null")
    got = W.running(
        counts, ["g"], "v", {"up": F.col("c"), "p": F.lit(1.001)}, descending=descending,
        products=["p"], group_totals={"all": "up"}, **limits,
    )
    key = F.desc("v") if descending else F.asc("v")
    w = Window.partitionBy("g").orderBy(key).rowsBetween(Window.unboundedPreceding, 0)
    want = counts.select(
        "g", "v", "c", F.sum("c").over(w).alias("up"), F.row_number().over(
            Window.partitionBy("g").orderBy(key)).alias("n"),
        F.sum("c").over(Window.partitionBy("g")).alias("all"),
    )
    a = {(r["g"], r["v"]): r for r in got.collect()}
    b = {(r["g"], r["v"]): r for r in want.collect()}
    assert a.keys() == b.keys()
    for k, r in b.items():
        assert (a[k]["up"], a[k]["all"]) == (r["up"], r["all"])
        assert a[k]["p"] == pytest.approx(1.001 ** r["n"])


@pytest.mark.parametrize("limits", LIMITS)
def test_median_and_mode(rows, limits):
    got = {r["g"]: r["m"] for r in exact_median(rows, ["g"], "v", "m", **limits).collect()}
    want = {r["g"]: r["m"] for r in rows.groupBy("g").agg(F.median("v").alias("m")).collect()}
    assert got == pytest.approx({k: v for k, v in want.items() if v is not None})
    tied = rows.sparkSession.createDataFrame(
        [("a", 2), ("a", 1), ("a", 2), ("a", 1), ("b", None), ("b", 3)], "k string, x int"
    )
    modes = {r["k"]: r["MODE"] for r in most_frequent(tied, ["k"], "x").collect()}
    assert modes == {"a": 1, "b": 3}


def test_hot_key_is_spread(spark):
    """The rows of a key with all rows land in many parts, copies included by their sequence."""
    many = spark.range(1000).select(F.lit(7).alias("k"), F.col("id").alias("seq"))
    ranges = W.split_ranges(many, ["k"], ["seq"], min_rows=10, slices=100)
    sizes = [r["count"] for r in ranges.groupBy("__range").count().collect()]
    assert len(sizes) == 100 and max(sizes) <= 20


@pytest.mark.parametrize(
    "key",
    [
        "CASE WHEN id = 0 THEN 1e18 ELSE CAST(id AS DOUBLE) END",
        "date_format(date_add(DATE'2023-01-01', CAST(id % 700 AS INT)), 'yyyy-MM-dd')",
        "array(id % 10, id)",
        "encode(CAST(id AS STRING), 'UTF-8')",
        "IF(id % 3 = 0, NULL, id)",
    ],
)
def test_ranges_are_even_for_every_kind_of_key(spark, key):
    """An outlier, day texts, arrays, bytes and nulls: no range holds much more than its share."""
    rows = spark.range(4000).select(F.lit(7).alias("g"), F.expr(key).alias("k"), F.col("id").alias("i"))
    marked = W.split_ranges(rows, ["g"], ["k", "i"], min_rows=200, slices=20)
    sizes = [r["count"] for r in marked.groupBy("__range").count().collect()]
    assert len(sizes) >= 15 and max(sizes) <= 2 * 200
    w = Window.partitionBy("g").orderBy("k", "i")
    want = rows.select("i", F.row_number().over(w).alias("n"))
    got = W.numbered(rows, ["g"], ["k", "i"], "n", min_rows=200, slices=20).select("i", "n")
    assert sorted(got.collect()) == sorted(want.collect())


def test_hot_value_inside_a_hot_group_is_split(spark):
    """Most rows of the hot group share one day and one term; the last column tells them apart."""
    i = F.col("id")
    rows = spark.range(3000).select(
        F.when(i % 3 < 2, 1).otherwise(i % 50).alias("g"),
        F.when(i % 5 < 3, "2024-05-05").when(i % 5 == 3, None)
        .otherwise(F.concat(F.lit("2024-0"), (i % 9 + 1).cast("string"), F.lit("-11"))).alias("day"),
        F.when(i % 7 < 5, "rash").otherwise(F.concat(F.lit("r"), (i % 20).cast("string"))).alias("t"),
        F.pmod(F.xxhash64(i), F.lit(10**6)).alias("h"), i.alias("i"),
    )
    order = ["day", "t", "h", "i"]
    limits = {"min_rows": 20, "slices": 200}
    marked = W.split_ranges(rows, ["g"], order, **limits)
    sizes = marked.filter("__range is not null").groupBy("g", "__range").count()
    assert sizes.agg(F.max("count")).first()[0] <= 80
    w = Window.partitionBy("g").orderBy(*order)
    want = rows.select("i", F.row_number().over(w).alias("n"))
    got = W.numbered(rows, ["g"], order, "n", **limits).select("i", "n")
    assert sorted(got.collect()) == sorted(want.collect())
