"""Windows in chunks against plain loops, with chunks of two places and of many."""

import random

import pytest
from pyspark.sql import functions as F

from docketry.functions.chunks import carried_down, neighbours, running_total


@pytest.fixture(scope="module")
def rows():
    dice = random.Random(5)
    out = []
    for g in (1, 2, 3, None):
        for o in sorted(dice.sample(range(-20, 60), 30)):
            out.append((g, o, dice.choice([None, None, dice.randint(1, 9)]), dice.choice([None, 1, 2])))
    return [*out, (4, 7, None, None), (5, 7, 3, 1)]


def grouped(rows):
    found = {}
    for g, o, v, w in rows:
        if g is not None:
            found.setdefault(g, []).append((o, v, w))
    return found


@pytest.mark.parametrize("bits", [1, 3, 16])
def test_chunks(spark, rows, bits):
    df = spark.createDataFrame(rows, "g long, ord long, v long, w long").repartition(3).filter("g is not null")
    last, total, pairs = {}, {}, {}
    for g, own in grouped(rows).items():
        seen, sum_, before, checked, agreed = None, None, None, 0, 0
        for o, v, w in own:
            seen = v if v is not None else seen
            sum_ = (sum_ or 0) + w if w is not None else sum_
            last[g, o], total[g, o] = seen, sum_
            if before is not None and w is not None:
                checked += 1
                agreed += before == w
            before = w
        pairs[g] = (checked, agreed)
    assert {(r.g, r.ord): r.x for r in carried_down(df, F.col("v"), "x", "g", bits).collect()} == last
    assert {k: v or 0 for k, v in total.items()} == {(r.g, r.ord): r.x or 0 for r in running_total(df, F.coalesce("w", F.lit(0)), "x", "g", bits).collect()}
    found = neighbours(df.select("g", "ord", "w"), F.col("w"), F.col("_before") == F.col("w"), "g", bits)
    assert {r.g: (r.checked, r.agreed) for r in found.collect()} == pairs


def test_nothing(spark):
    df = spark.createDataFrame([], "g long, ord long, v long")
    assert carried_down(df, F.col("v"), "x", "g").count() == running_total(df, F.col("v"), "x", "g").count() == neighbours(df, F.col("v"), F.col("_before") == F.col("v"), "g").count() == 0
