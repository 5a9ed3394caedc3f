import hashlib
import math
import re
from collections import Counter
from zlib import crc32

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from caseloom.llm import resampling

WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def words_of(text):
    return WORD.findall("".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or ""))


def buckets_of(text, buckets):
    words = words_of(text)
    return [crc32(f.encode()) % buckets for f in words + [f"{a} {b}" for a, b in zip(words, words[1:])]]


def brute(docs, target, buckets=10_000, least=20, percent=25):
    """Rows (doc_id, n_features, weight, score, rank) by plain counting."""
    source, wanted = Counter(), Counter()
    for _, text in docs:
        source.update(buckets_of(text, buckets))
    for text in target:
        wanted.update(buckets_of(text, buckets))
    S, T = sum(source.values()), sum(wanted.values())
    gain = [math.floor(1000 * math.log((wanted[b] + 1) * (S + buckets) / ((source[b] + 1) * (T + buckets)))) for b in range(buckets)]
    rows = []
    for doc_id, text in docs:
        held = buckets_of(text, buckets)
        weight = sum(gain[b] for b in held) // len(held) if held else 0
        h = int(hashlib.sha256(f"7:{'' if doc_id is None else doc_id}".encode()).hexdigest()[:8], 16)
        score = weight + math.floor(-1000 * math.log(-math.log((h + 0.5) / 4294967296)))
        rows.append((doc_id, len(held), weight, score, len(words_of(text)) >= least))
    eligible = sorted((r for r in rows if r[4]), key=lambda r: (-r[3], r[0] is None, r[0] or 0, -r[2], -r[1]))
    drawn = percent * len(eligible) // 100
    out = [(*r[:4], i + 1 if i < drawn else None) for i, r in enumerate(eligible)]
    return out + [(*r[:4], None) for r in rows if not r[4]]


@pytest.mark.parametrize("which, least, percent", [("documents", 20, 25), ("odd_docs", 1, 60), ("odd_docs", 0, 100)])
def test_resample(request, spark, which, least, percent):
    docs = request.getfixturevalue(which)
    target = spark.read.parquet("/root/testdata/sf0.001/benchmark.parquet")
    got = resampling.resample(docs, target, percent=percent, least_words=least).collect()
    want = brute([tuple(r) for r in docs.select("doc_id", "text").collect()], [r.text for r in target.collect()],
                 least=least, percent=percent)
    assert sorted(map(tuple, got), key=repr) == sorted(want, key=repr)


def test_hot_scores(spark):
    """Copies of one text and repeated rows: ranks follow doc_id and every place is taken once."""
    rows = [(i // 2, "one and the same text " * 9) for i in range(3000)] + [(None, "one and the same text " * 9)] * 3
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(7)
    got = resampling.resample(docs, docs.limit(0), percent=100).collect()
    assert sorted(r.rank for r in got) == list(range(1, len(rows) + 1))
    by_rank = sorted(got, key=lambda r: r.rank)
    assert by_rank == sorted(by_rank, key=lambda r: (-r.score, r.doc_id is None, r.doc_id or 0))


def test_empty(spark, no_docs, documents):
    assert resampling.resample(no_docs, documents).collect() == []


@settings(deadline=None, max_examples=60)
@given(st.integers(1, 200).flatmap(lambda width: st.tuples(
    st.lists(st.lists(st.integers(0, 5000), min_size=width, max_size=width), min_size=1, max_size=5),
    st.lists(st.integers(-40_000, 40_000), min_size=width, max_size=width))))
def test_sums(case):
    counts, gains = (np.array(x, np.int64) for x in case)
    assert resampling.sums(counts, resampling.gain_slices(gains)).tolist() == (counts @ gains).tolist()


@given(st.lists(st.text(max_size=60), max_size=5), st.integers(1, 3))
def test_features(texts, run_words):
    crcs, owners, sizes = resampling.features([t.encode() for t in texts], run_words)
    want = []
    for i, text in enumerate(texts):
        words = words_of(text)
        want += [(i, crc32(" ".join(words[j:j + k]).encode())) for k in range(1, run_words + 1) for j in range(len(words) - k + 1)]
    assert sorted(zip(owners.tolist(), crcs.tolist())) == sorted(want)
    assert sizes.tolist() == [len(words_of(t)) for t in texts]
