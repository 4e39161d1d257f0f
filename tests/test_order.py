"""Row numbers, chunks and greedy batches against plain loops."""

import random

import pytest
from pyspark.sql import functions as F

from docketry.functions import order


def greedy(sizes, most_rows, most_size):
    out, batch, rows, total = [], 0, 0, 0
    for s in sizes:
        if not batch or rows >= most_rows or rows and total + s > most_size:
            batch, rows, total = batch + 1, 0, 0
        rows, total = rows + 1, total + s
        out.append(batch)
    return out


def test_row_numbers(spark):
    rng = random.Random(1)
    rows = [(rng.choice(["a", "b", None]), rng.randint(0, 5), i) for i in range(500)] + [("hot", 1, 7)] * 400
    df = spark.createDataFrame(rows, "g string, k int, i long").repartition(7)
    got = order.numbered(df, ["k", F.desc("i")], range_rows=60).collect()
    assert sorted(r.position for r in got) == list(range(1, len(rows) + 1))
    assert [(r.k, r.i) for r in sorted(got, key=lambda r: r.position)] == sorted(((k, i) for _, k, i in rows), key=lambda x: (x[0], -x[1]))
    own = order.numbered(df, ["k", "i"], "n", within=["g"], range_rows=60).collect()
    for g in {r[0] for r in rows}:
        mine = sorted((r for r in own if r.g == g), key=lambda r: r.n)
        assert [r.n for r in mine] == list(range(1, len(mine) + 1)) and [(r.k, r.i) for r in mine] == sorted((k, i) for x, k, i in rows if x == g)
    assert order.numbered(df.limit(0), ["k"]).collect() == []


def test_chunks(spark):
    got = order.chunks(spark.range(1001), ["id"], 400).groupBy("chunk").count().orderBy("chunk").collect()
    assert [(r.chunk, r["count"]) for r in got] == [(1, 400), (2, 400), (3, 201)]


@pytest.mark.parametrize(("most_rows", "most_size", "bits"), [(6, 100, 3), (6, 100, 4), (1, 5, 2), (5, 0, 3), (40, 10**9, 6), (3, 70, 16)])
def test_batches_are_those_of_a_sequential_pass(spark, most_rows, most_size, bits):
    rng = random.Random(most_size)
    sizes = [rng.choice([0, 0, 1, 20, 40, 99, 100, 101, 5000]) for _ in range(rng.randint(150, 260))]
    df = spark.createDataFrame([(i, None if s == 0 and i % 2 else s) for i, s in enumerate(sizes)], "i long, s long").repartition(5)
    got = order.packed(df, ["i"], F.col("s"), most_rows, most_size, block_bits=bits).orderBy("i").collect()
    assert [r.batch for r in got] == greedy(sizes, most_rows, most_size)


def test_no_rows_and_one(spark):
    df = spark.createDataFrame([(1, 9)], "i long, s long")
    assert [r.batch for r in order.packed(df, ["i"], F.col("s"), 6, 1).collect()] == [1]
    assert order.packed(df.limit(0), ["i"], F.col("s"), 6, 1).collect() == []
    with pytest.raises(ValueError):
        order.packed(df, ["i"], F.col("s"), 0, 1)
