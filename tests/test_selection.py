"""Selection by leading digits against sorting."""

import random
from collections import defaultdict

import pytest
from pyspark.sql import functions as F

from trialspark.operators.selection import CUT, REST, cut_points
from trialspark.operators.split import stratified_split


@pytest.mark.parametrize("bits, few", [(63, True), (20, False)])
def test_cut_points(spark, bits, few):
    rng = random.Random(bits)
    rows = [(rng.choice(["a", "b", None]), rng.choice([0, 1, 5, (1 << bits) - 1, rng.getrandbits(bits)]), rng.randint(0, 9)) for _ in range(400)]
    wanted = {"a": 300, "b": 10_000, None: 0}
    df = spark.createDataFrame(rows, "g string, k long, w long")
    need = spark.createDataFrame([*wanted.items()], "g string, amount long")
    got = {r["g"]: (r[CUT], r[REST]) for r in cut_points(df, ["g"], "k", need, "amount", F.col("w"), bits, few).collect()}
    sums = defaultdict(lambda: defaultdict(int))
    for g, k, w in rows:
        sums[g][k] += w
    want = {}
    for g, amount in wanted.items():
        upto = 0
        for k, w in sorted(sums[g].items()):
            if upto + w > amount:
                want[g] = (k, amount - upto)
                break
            upto += w
    assert got == want and "b" not in got


def test_split_shares_of_classes(spark):
    """Every class keeps its share to the row; the null class and classes of one row too."""
    rows = [(f"s{i:04}", None if i % 7 == 0 else i % 3) for i in range(1000)] + [("only", 9)]
    out = stratified_split(spark.createDataFrame(rows, "USUBJID string, DPTN int")).collect()
    size, train = defaultdict(int), defaultdict(int)
    for r in out:
        size[r["DPTN"]] += 1
        train[r["DPTN"]] += r["PART"] == "train"
    assert len(out) == 1001 and all(train[c] == int(size[c] * 0.7) for c in size)
