import hashlib

import numpy as np
import pytest

from caseloom.llm import sketches


def shingles(text):
    words = (text or "").encode().lower().split()
    return {tuple(words[i:i + 5]) for i in range(max(1, len(words) - 4))} if words else set()


def likeness(a, b):
    a, b = shingles(a), shingles(b)
    return len(a & b) / len(a | b) if a | b else 1.0


@pytest.mark.parametrize("which", ["documents", "odd_docs"])
def test_edits(request, which):
    docs = request.getfixturevalue(which)
    rows = [(d, t or "") for d, t in docs.select("doc_id", "text").collect()]
    named = sorted((r for r in rows if r[0] is not None), key=lambda r: (-r[0], r[1]))
    pairs = list(zip(named, named[1:] + named[:1])) + [(r, r) for r in rows if r[0] is None]
    got = sorted(map(tuple, sketches.with_edits(docs).select(
        "doc_id", "n_chars", "edited_sha256", "near_edited", "near_next", "fingerprint").collect()), key=repr)
    want = []
    for (doc_id, text), (_, after) in pairs:
        cut = len(text) // 3
        edited = text[:len(text) - cut] + after[:cut]
        want.append((doc_id, len(text), hashlib.sha256(edited.encode()).hexdigest(), likeness(text, edited),
                     likeness(text, after), sketches.as_string(sketches.sketch(text.encode()))))
    want.sort(key=repr)
    assert [g[:3] + g[5:] for g in got] == [w[:3] + w[5:] for w in want]
    errors = [abs(g[i] - w[i]) for g, w in zip(got, want) for i in (3, 4)]
    assert max(errors) < 0.25 and np.mean(errors) < 0.03


def test_empty(no_docs):
    assert sketches.with_edits(no_docs).collect() == []


def test_single_row(spark):
    row = sketches.with_edits(spark.createDataFrame([(5, "abcdef")], "doc_id long, text string")).first()
    assert row.edited_sha256 == hashlib.sha256(b"abcdab").hexdigest() and row.near_next == 1.0


def test_estimates():
    a = b" ".join(b"w%d" % i for i in range(6000))
    b = b" ".join(b"w%d" % i for i in range(3000, 9000))
    one, two = sketches.sketch(a), sketches.sketch(b)
    assert abs(sketches.resemblance(one, two) - 2996 / 8996) < 0.15
    assert abs(sketches.containment(one, two) - 2996 / 5996) < 0.25
    assert abs(sketches.distinct_shingles(one) / 5996 - 1) < 0.3
    assert (sketches.of_string(sketches.as_string(one)) == one).all()
    assert sketches.distinct_shingles(sketches.sketch(b"only four words here")) == 1


def test_groups_merge_parts(documents):
    got = {r.source: r.hashes for r in sketches.of_groups(documents, "source").collect()}
    for source, rows in documents.toPandas().groupby("source"):
        whole = np.empty(0, np.uint64)
        for text in rows.text:
            whole = sketches.merged(whole, sketches.sketch(text.encode()))
        assert got[source] == sketches.as_string(whole)
