import zlib

import numpy as np
import pytest
from tokenizers import Tokenizer

from caseloom.llm import window_packing as wp
from caseloom.llm.queries import WORD_TOKENIZER


@pytest.mark.parametrize("which, capacity", [("documents", 2048), ("odd_docs", 2048), ("odd_docs", 96), ("documents", 256)])
def test_pieces(request, which, capacity):
    """Every id in one piece, sequences gapless, all full but the last ones, which have powers of two."""
    docs = request.getfixturevalue(which)
    tokenizer = Tokenizer.from_file(WORD_TOKENIZER)
    texts = [[*tokenizer.encode(text or "", add_special_tokens=False).ids, 1] for _, text in docs.select("doc_id", "text").collect()]
    got = wp.pack(docs, WORD_TOKENIZER, capacity, with_ids=True).collect()
    assert all(len(r.ids) == 4 * r.length and zlib.crc32(r.ids) == r.ids_crc32 for r in got)
    assert sum(r.length for r in got) == sum(map(len, texts))
    by_doc = {}
    for (doc_id, _), ids in zip(docs.select("doc_id", "text").collect(), texts):
        by_doc.setdefault(doc_id, []).append(ids)
    for doc_id, own in by_doc.items():
        rows = sorted((r for r in got if r.doc_id == doc_id), key=lambda r: (r.doc_tokens, r.start))
        assert sum(r.length for r in rows) == sum(map(len, own))
        for r in rows:
            assert any(len(ids) == r.doc_tokens and np.array(ids[r.start:r.start + r.length], "<u4").tobytes() == r.ids for ids in own)
        if len(own) == 1:
            assert b"".join(r.ids for r in rows) == np.array(own[0], "<u4").tobytes()
    ends = {}
    for r in sorted(got, key=lambda r: (r.sequence_id, r.offset)):
        assert r.offset == ends.get(r.sequence_id, 0)
        ends[r.sequence_id] = r.offset + r.length
    short = sorted(n for n in ends.values() if n != capacity)
    assert max(ends.values()) <= capacity and len(short) == len(set(short)) and all(n & (n - 1) == 0 for n in short)


def test_empty(no_docs):
    assert wp.pack(no_docs, WORD_TOKENIZER).collect() == []


def test_one_document(spark):
    docs = spark.createDataFrame([(None, None, "x")], "doc_id long, text string, position string")
    assert [tuple(r) for r in wp.pack(docs, WORD_TOKENIZER).collect()] == [
        (None, 0, 1, zlib.crc32(b"\1\0\0\0"), 1, 0, 0)]


def test_plan_uses_every_piece_once():
    rng = np.random.default_rng(5)
    for capacity in (16, 100, 256):
        counts = {int(n): int(c) for n, c in zip(rng.integers(1, capacity + 1, capacity // 2), rng.integers(1, 300, capacity // 2))}
        kinds, left = wp.plan(counts, capacity)
        total = dict(left)
        for parts, n in kinds:
            assert n > 0 and sum(parts) == capacity and len(parts) <= 3
            for length in parts:
                total[length] = total.get(length, 0) + n
        assert total == counts
        # No exact filling of up to three is left.
        lengths = [n for n, c in left.items() for _ in range(min(c, 3))]
        assert not any(a + b == capacity or any(a + b + c == capacity for c in lengths[j + 1:])
                       for i, a in enumerate(lengths) for j, b in enumerate(lengths[i + 1:], i + 1))


def test_repeats_are_found():
    """A histogram made of full combinations is used up."""
    rng = np.random.default_rng(2)
    columns = wp.combinations(np.arange(1, 65), 64)
    counts = {}
    for row in columns[rng.choice(len(columns), 12, replace=False)]:
        for length in row[row > 0].tolist():
            counts[length] = counts.get(length, 0) + 1000
    kinds, left = wp.plan(counts, 64)
    assert sum(n * c for n, c in left.items()) < 0.02 * sum(n * c for n, c in counts.items())


def test_least_squares_meets_its_conditions():
    rng = np.random.default_rng(4)
    capacity = 48
    columns = wp.combinations(np.arange(1, capacity + 1), capacity)
    wanted = np.concatenate([[0], rng.integers(0, 500, capacity)]).astype(float)
    weights = np.sqrt(np.arange(capacity + 1) / capacity)
    chosen, x = wp.least_squares(columns, wanted, weights, rounds=400, tolerance=1e-7)
    assert (x >= 0).all()
    use = np.bincount(columns[chosen].ravel(), np.repeat(x, 3), minlength=capacity + 1)
    use[0] = 0
    slope = (weights ** 2 * (wanted - use))[columns].sum(axis=1)
    scale = np.abs((weights ** 2 * wanted)[columns].sum(axis=1)).max()
    assert slope.max() < 2e-3 * scale
    assert np.abs(slope[chosen][x > 1]).max() < 2e-3 * scale


def test_combinations():
    rows = {tuple(r) for r in wp.combinations(np.arange(1, 13), 12).tolist()}
    want = {(a, b, 12 - a - b) for a in range(1, 13) for b in range(0, a + 1) if 0 <= 12 - a - b <= b}
    assert rows == want and all(sum(r) == 12 for r in rows)
