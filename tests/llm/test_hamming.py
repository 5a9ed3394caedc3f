import random

from pyspark.sql import functions as F

from caseloom.llm import hamming


def expected(rows, queries, k):
    out = []
    for q in queries:
        code = dict(rows)[q]
        near = sorted(((code ^ c) & (1 << 64) - 1).bit_count() * 10**6 + i for i, c in set(rows) if i != q)[:k]
        out += [(q, place + 1, x % 10**6, x // 10**6) for place, x in enumerate(near)]
    return sorted(out)


def test_nearest(spark):
    rng = random.Random(2)
    centres = [rng.getrandbits(64) for _ in range(6)]
    codes = [centres[i % 6] ^ sum(1 << b for b in rng.sample(range(64), rng.randint(0, 7))) for i in range(300)]
    codes += [codes[0]] * 30 + [rng.getrandbits(64) for _ in range(40)]
    rows = [(i, c - (1 << 64) if c >> 63 else c) for i, c in enumerate(codes)]
    table = spark.createDataFrame(rows + rows[:5] + [(None, 5), (999, None)], "id long, code long")
    asked = table.where("id % 20 = 0")
    got = sorted(map(tuple, hamming.nearest(table, asked, 10).collect()))
    assert got == expected(rows, range(0, len(rows), 20), 10)


def test_fewer_rows_than_asked(spark):
    table = spark.createDataFrame([(100, 0), (1, 7), (2, -1)], "id long, code long")
    assert sorted(map(tuple, hamming.nearest(table, table.where("id = 100"), 10).collect())) == [(100, 1, 1, 3), (100, 2, 2, 64)]
    assert hamming.nearest(table.limit(0), table.limit(0), 10).collect() == []


def test_codes(spark):
    rows = [([1.0, -1.0, 2.0],), ([None, 1.0],), (None,), ([1.0] * 65,), ([],)]
    got = spark.createDataFrame(rows, "v array<float>").select(hamming.sign_code(F.col("v")).alias("c")).collect()
    assert [r.c for r in got] == [5, 2, None, -2, 0]
