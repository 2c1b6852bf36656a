"""Two-level windows equal plain ones for any stretch length."""

import random

import pytest
from conftest import rows
from pyspark.sql import Window
from pyspark.sql import functions as F

from sceneloom.functions import ordered as O


@pytest.fixture(scope="module")
def data(spark):
    rnd = random.Random(5)
    recs = [(k, p, i, rnd.randint(0, 9)) for k in range(6) for i, p in enumerate(sorted(rnd.choices(range(300), k=rnd.randint(1, 120))))]
    return spark.createDataFrame(recs, "k int, p long, t int, x long").cache()


@pytest.mark.parametrize("bucket", [1, 7, 64, 4096])
def test_all_forms(data, bucket):
    w = Window.partitionBy("k").orderBy("p", "t")
    got = O.global_row_number(data, ["k"], "p", ["t"], "rn", bucket, count="n")
    want = data.withColumn("rn", F.row_number().over(w)).withColumn("n", F.count("*").over(Window.partitionBy("k")))
    assert rows(got, "k", "t", "rn", "n") == rows(want, "k", "t", "rn", "n")
    got = O.with_previous(data, ["k"], "p", "x", "prev", ["t"], bucket)
    assert rows(got, "k", "t", "prev") == rows(data.withColumn("prev", F.lag("x").over(w)), "k", "t", "prev")
    got = O.running_sum(data, ["k"], "p", F.col("x"), "s", ["t"], bucket)
    assert rows(got, "k", "t", "s") == rows(data.withColumn("s", F.sum("x").over(w.rowsBetween(Window.unboundedPreceding, 0))), "k", "t", "s")
    got = O.gap_segments(data, ["k"], "p", 5, "g", ["t"], bucket)
    brk = F.when(F.col("p") - F.lag("p").over(w) - 1 >= 5, 1).otherwise(0)
    want = data.withColumn("b", brk).withColumn("g", F.sum("b").over(w.rowsBetween(Window.unboundedPreceding, 0)))
    assert rows(got, "k", "t", "g") == rows(want, "k", "t", "g")
