import random

from caseloom.llm.graph import components


def test_components(spark):
    rng = random.Random(1)
    edges = [(i, i + 1) for i in range(60)] + [(100, x) for x in range(101, 140)] + [(500, 500), (None, 3), (7, 6), (7, 6)]
    edges += [(200 + rng.randrange(50), 200 + rng.randrange(50)) for _ in range(40)]
    rng.shuffle(edges)
    names = {n: n for e in edges if None not in e for n in e}
    for a, b in edges:
        if a is not None and names[a] != names[b]:
            old, new = max(names[a], names[b]), min(names[a], names[b])
            names = {n: new if v == old else v for n, v in names.items()}
    got = components(spark.createDataFrame(edges, "a long, b long")).collect()
    assert {r.node: r.label for r in got} == names and len(got) == len(names)


def test_no_edges(spark):
    assert components(spark.createDataFrame([], "a long, b long")).collect() == []
