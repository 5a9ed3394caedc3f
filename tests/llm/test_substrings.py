"""Removed words against windows kept in a set."""

import numpy as np
import pytest
import xxhash

from caseloom.llm import substrings
from caseloom.llm.common import hashes


def expected(rows):
    seen, done = set(), {}
    out = []

    def place(row):
        digest = xxhash.xxh64_intdigest((row[1] or "").encode(), 42)
        return row[0], digest - (1 << 64) * (digest >> 63)

    for doc_id, text in sorted(((d, t) for d, t in rows if d is not None), key=place):
        words = (text or "").encode().split()
        if (doc_id, text) not in done:
            covered = [False] * len(words)
            for i in range(len(words) - 19):
                window = tuple(words[i:i + 20])
                if window in seen:
                    covered[i:i + 20] = [True] * 20
                seen.add(window)
            done[doc_id, text] = (len(words), sum(covered), b" ".join(w for w, c in zip(words, covered) if not c).decode())
        out.append((doc_id, *done[doc_id, text]))
    for doc_id, text in rows:
        if doc_id is None:
            words = (text or "").encode().split()
            out.append((None, len(words), 0, b" ".join(words).decode()))
    return sorted(out, key=repr)


@pytest.mark.parametrize("which", ["documents", "odd_docs"])
@pytest.mark.parametrize("anchor_segments", [1, 8192])
def test_removed(request, monkeypatch, which, anchor_segments):
    monkeypatch.setattr(substrings, "ANCHOR_SEGMENTS", anchor_segments)
    docs = request.getfixturevalue(which)
    got = sorted((tuple(r) for r in substrings.remove_repeats(docs).collect()), key=repr)
    assert got == expected([tuple(r) for r in docs.select("doc_id", "text").collect()])


def test_repeated_first_occurrences(spark):
    """A first occurrence stays in every row that repeats it, and in the first of several texts of one doc_id."""
    shared = " ".join(f"s{i}" for i in range(40))
    one, two = f"a b c d e f g h i j k l m {shared}", f"{shared} n o p q r s t u v w x y z"
    for rows in ([(1, one), (1, one), (2, two)], [(1, one), (1, two), (2, one)], [(1, one)] * 5 + [(1, two)] * 3 + [(0, None)]):
        got = sorted((tuple(r) for r in substrings.remove_repeats(spark.createDataFrame(rows, "doc_id long, text string")).collect()), key=repr)
        assert got == expected(rows)
        assert min(removed for _, n, removed, _ in got if n) == 0


def test_empty(no_docs):
    assert substrings.remove_repeats(no_docs).collect() == []


def test_index_counts_occurrences():
    rng = np.random.default_rng(4)
    segments = [[bytes([97 + c]) for c in rng.integers(0, 3, 40)] for _ in range(30)]
    index = substrings.FMIndex(segments)
    text = b"|".join(b"".join(s) for s in segments)
    for _ in range(40):
        words = segments[rng.integers(30)][5:5 + rng.integers(1, 12)]
        low, high = np.array([0]), np.array([len(index.suffixes)])
        for word in reversed(words):
            code = index.coded[0][segments[0].index(word)]
            low, high = index.extend(np.array([code]), low, high)
        pattern = b"".join(words)
        assert high[0] - low[0] == sum(text.startswith(pattern, i) for i in range(len(text)))


def test_wavelet_rank():
    rng = np.random.default_rng(5)
    symbols = rng.integers(0, 13, 500)
    tree = substrings.WaveletTree(symbols, 4)
    asked, places = rng.integers(0, 13, 200), rng.integers(0, 501, 200)
    assert tree.rank(asked, places).tolist() == [int((symbols[:p] == s).sum()) for s, p in zip(asked, places)]


def test_equal_windows_have_one_anchor():
    words = [f"w{i % 37}".encode() for i in range(400)]
    starts, sizes, anchors, _ = substrings.segments_of(hashes(words, len(words)))
    assert sizes.sum() == len(words) - 19 and (starts == np.append(0, sizes.cumsum()[:-1])).all()
    of_window = {}
    for start, n, anchor in zip(starts, sizes, anchors):
        for i in range(start, start + n):
            assert of_window.setdefault(tuple(words[i:i + 20]), anchor) == anchor
