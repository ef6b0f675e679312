"""Shared budgets against a walk in rounds, and texts cut around a mark."""

import random

from pyspark.sql import functions as F

from quillstone.operators import budget as bg


def rounds(sizes, weights, total, floor):
    order = sorted(range(len(sizes)), key=lambda i: (-weights[i], i))
    kept = [i for n, i in enumerate(order, 1) if n * floor <= total]
    quota = [min(sizes[i], floor) if i in kept else 0 for i in range(len(sizes))]
    pool = total - sum(quota)
    open_ = [i for i in kept if sizes[i] > quota[i] and weights[i] > 0]
    while open_ and pool > 0:
        whole, now = sum(weights[i] for i in open_), pool
        full = [i for i in open_ if (sizes[i] - quota[i]) * whole <= now * weights[i]]
        for i in full:
            pool -= sizes[i] - quota[i]
            quota[i] = sizes[i]
        if not full:
            for i in open_:
                quota[i] += now * weights[i] // whole
            break
        open_ = [i for i in open_ if i not in full]
    return quota


def test_shares_equal_the_rounds(spark):
    rng = random.Random(4)
    cases = [([rng.choice([0, 50, 300, 900, 4000]) for _ in range(n)], [rng.randrange(0, 4) for _ in range(n)], rng.choice([0, 100, 700, 2500, 9000])) for n in (1, 2, 3, 5, 8, 13) for _ in range(25)]
    rows = [(k, i, s, w, t) for k, (sizes, weights, t) in enumerate(cases) for i, (s, w) in enumerate(zip(sizes, weights))]
    df = spark.createDataFrame(rows, "k int, i int, size int, weight int, total int").repartition(3)
    for floor in (0, 120):
        got = {(r.k, r.i): r.quota for r in bg.shared(df, ["k"], "size", "weight", "i", F.col("total"), floor).collect()}
        for k, (sizes, weights, total) in enumerate(cases):
            mine = [got[k, i] for i in range(len(sizes))]
            assert mine == rounds(sizes, weights, total, floor), (sizes, weights, total)
            assert sum(mine) <= total and all(q <= s for q, s in zip(mine, sizes))
    odd = spark.createDataFrame([(1, 1, None, None, None), (2, 1, 10, None, 5), (3, 1, -4, 1, 9)], "k int, i int, size int, weight int, total int")
    assert {r.k: r.quota for r in bg.shared(odd, ["k"], "size", "weight", "i", F.col("total"), 0).collect()} == {1: 0, 2: 5, 3: 0}
    assert bg.shared(df.limit(0), ["k"], "size", "weight", "i", F.col("total"), 1).isEmpty()


def test_texts_are_cut_around_a_mark(spark):
    text = "".join(chr(97 + i % 26) for i in range(1000))
    cases = [(text, 1000), (text, 999), (text, 210), (text, 211), (text, 5), (text, 0), (text, -3), (None, 5), ("", 0)]
    got = [(r.a, r.b) for r in spark.createDataFrame([(i, *c) for i, c in enumerate(cases)], "i int, t string, n int").orderBy("i").select(bg.fitted(F.col("t"), F.col("n"), F.lit("<cut>")).alias("a"), bg.fitted(F.col("t"), F.col("n"), F.lit("<cut>"), F.lit(False)).alias("b")).collect()]
    assert got[0] == (text, text) and got[1] == (text[:596] + "<cut>" + text[-398:], "<cut>" + text[-994:])
    assert got[2][0] == text[:123] + "<cut>" + text[-82:] and len(got[3][0]) == 211
    assert got[4] == (text[-5:], text[-5:]) and got[5] == got[6] == ("", "") and got[7] == (None, None) and got[8] == ("", "")
