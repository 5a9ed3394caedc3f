"""SimHash classes against comparisons of all pairs."""

import random

import numpy as np
import pytest
import xxhash

from caseloom.llm import simhash


def expected_fingerprint(text):
    words = (text or "").encode().lower().split()
    if not words:
        return 0
    shingles = [b" ".join(words[i:i + 3]) for i in range(max(1, len(words) - 2))]
    counts = [sum(xxhash.xxh64_intdigest(s, 42) >> b & 1 for s in shingles) for b in range(64)]
    return sum(1 << b for b in range(64) if counts[b] * 2 > len(shingles))


def classes(fps):
    """Class number of each fingerprint, pair by pair."""
    names = list(range(len(fps)))
    for i in range(len(fps)):
        for j in range(i):
            if (fps[i] ^ fps[j]).bit_count() <= 3 and names[i] != names[j]:
                names = [names[j] if n == names[i] else n for n in names]
    return names


def expected(rows):
    fps = [expected_fingerprint(text) for _, text in rows]
    names = classes(fps)
    least = {}
    for name, (doc_id, _) in zip(names, rows):
        if doc_id is not None:
            least[name] = min(doc_id, least.get(name, doc_id))
    return sorted(((d, f"{f:016x}", least.get(n)) for (d, _), f, n in zip(rows, fps, names)), key=repr)


@pytest.mark.parametrize("which", ["documents", "odd_docs"])
def test_classes(request, which):
    docs = request.getfixturevalue(which)
    rows = [tuple(r) for r in docs.select("doc_id", "text").collect()]
    got = sorted((tuple(r) for r in simhash.near_duplicates(docs).collect()), key=repr)
    assert got == expected(rows)


def test_empty(no_docs):
    assert simhash.near_duplicates(no_docs).collect() == []
    assert simhash.keep_one(no_docs).collect() == []


def test_keep_one(odd_docs):
    kept = simhash.keep_one(odd_docs)
    assert kept.columns == odd_docs.columns
    ids = [r.doc_id for r in kept.collect()]
    assert ids.count(None) == 2 and ids.count(1) == 1 and 3 not in ids
    # Empty texts are one class.
    assert [i for i in ids if i in (4, 5, 6)] == [4]


def test_keep_one_of_repeated_rows(spark):
    """Copies fold to one row whatever the other columns hold; of two texts of one doc_id and class one stays."""
    long = " ".join(f"word{i}" for i in range(200))
    rows = [(1, long, "a", {"k": 1}), (1, long, "b", {"k": 2}), (1, long + " ", "c", None), (2, long.upper(), "d", None),
            (3, "other words here", "e", None), (3, "quite another text of its own", "f", None), (None, long, "g", None)]
    docs = spark.createDataFrame(rows, "doc_id int, text string, `_Tid` string, first map<string, int>")
    kept = simhash.keep_one(docs)
    assert kept.columns == docs.columns
    got = sorted(((r.doc_id, (r.text or "").strip().lower()) for r in kept.collect()), key=repr)
    assert got == sorted([(1, long), (3, "other words here"), (3, "quite another text of its own"), (None, long)], key=repr)
    assert sorted(map(repr, kept.collect())) == sorted(map(repr, simhash.keep_one(docs.repartition(5)).collect()))


@pytest.mark.parametrize("cell_rows", [4, 4096])
def test_links_of_dense_cells(spark, cell_rows):
    """Cells of many fingerprints, split into parts and not, connect what all pairs connect."""
    rng = random.Random(3)
    fps = set()
    for _ in range(12):
        centre = rng.getrandbits(64)
        for _ in range(25):
            fps.add(centre ^ sum(1 << b for b in rng.sample(range(64), rng.randint(0, 4))))
    signed = [f - (1 << 64) if f >> 63 else f for f in fps]
    table = spark.createDataFrame([(f,) for f in signed], "fp long")
    edges = [(r.a, r.b) for r in simhash.links(table, cell_rows=cell_rows).collect()]
    assert all(((a ^ b) & (1 << 64) - 1).bit_count() <= 3 for a, b in edges)
    names = {f: f for f in signed}
    for a, b in edges:
        if names[a] != names[b]:
            old = names[a]
            names = {f: names[b] if n == old else n for f, n in names.items()}
    want = classes([f & (1 << 64) - 1 for f in signed])
    pairs = {(names[f], w) for f, w in zip(signed, want)}
    assert len(pairs) == len(set(want)) == len(set(names.values()))


def test_distance_bound():
    rng = np.random.default_rng(1)
    a, b = rng.integers(0, 2**63, (2, 1000)).astype(np.uint64)
    near = a ^ (np.uint64(1) << rng.integers(0, 64, 1000).astype(np.uint64))
    for x, y in ((a, b), (a, near)):
        assert (np.bitwise_count(simhash._sorted_bits(x) ^ simhash._sorted_bits(y)) <= np.bitwise_count(x ^ y)).all()
