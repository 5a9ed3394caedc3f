import hashlib
import re

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from caseloom.llm import fill_in_middle as fim

UNITS = {"token": r"[\x20\x09-\x0D]*[^\x20\x09-\x0D]+|[\x20\x09-\x0D]+", "line": r"[^\n]*\n|[^\n]+"}


def brute(doc_id, text, rate, spm, unit="token", seed=42):
    text = text or ""
    units = re.findall(UNITS[unit], text)
    digits = hashlib.sha256(f"{seed}:{'' if doc_id is None else doc_id}".encode()).hexdigest()
    h1, h2, h3, h4 = (int(digits[i:i + 8], 16) for i in range(0, 32, 8))
    if not text or any(mark in text for mark in ("<P>", "<S>", "<M>")) or h3 % 100 >= rate:
        return doc_id, len(units), "plain", None, None, text
    a, b = sorted((h1 % (len(units) + 1), h2 % (len(units) + 1)))
    prefix, middle, suffix = "".join(units[:a]), "".join(units[a:b]), "".join(units[b:])
    if h4 % 100 < spm:
        return doc_id, len(units), "spm", len(prefix), len(middle), f"<S>{suffix}<P>{prefix}<M>{middle}"
    return doc_id, len(units), "psm", len(prefix), len(middle), f"<P>{prefix}<S>{suffix}<M>{middle}"


@pytest.mark.parametrize("which, rate, spm, unit", [
    ("documents", 50, 80, "token"), ("odd_docs", 100, 50, "token"), ("odd_docs", 100, 0, "line"), ("documents", 100, 100, "line")])
def test_transform(request, which, rate, spm, unit):
    docs = request.getfixturevalue(which)
    got = fim.transform(docs, rate, spm, unit).withColumn("back", fim.restored(F.col("output"), F.col("form"))).collect()
    rows = docs.select("doc_id", "text").collect()
    assert sorted((tuple(r)[:6] for r in got), key=repr) == sorted((brute(*r, rate, spm, unit) for r in rows), key=repr)
    assert sorted((r.doc_id or -1, r.back) for r in got) == sorted((r.doc_id or -1, r.text or "") for r in rows)


def test_marks_in_texts(spark):
    texts = ["a <P> b", "<S>", "x<M", "< P>", "<<P", "a<", "<M>", "S> <", " ", "\n\n", "é 漢 字", None, ""]
    docs = spark.createDataFrame([(i % 7, t) for i, t in enumerate(texts)], "doc_id int, text string")
    for spm in (0, 100):
        got = fim.transform(docs, 100, spm).withColumn("back", fim.restored(F.col("output"), F.col("form"))).collect()
        assert sorted(tuple(r)[:6] for r in got) == sorted(brute(i % 7, t, 100, spm) for i, t in enumerate(texts))
        assert sorted(r.back for r in got) == sorted(t or "" for t in texts)


def test_small_matrices(spark, odd_docs, monkeypatch):
    want = sorted(fim.transform(odd_docs).collect(), key=repr)
    monkeypatch.setattr(fim, "BATCH_BYTES", 50)
    assert sorted(fim.transform(odd_docs).collect(), key=repr) == want


def test_empty(no_docs):
    assert fim.transform(no_docs).collect() == []


@settings(deadline=None, max_examples=200)
@given(st.lists(st.text(alphabet=" \n\tabé漢", max_size=80), max_size=6), st.sampled_from(sorted(UNITS)), st.integers(0, 90))
def test_cuts(texts, unit, k):
    parts = fim.Texts([t.encode() for t in texts], unit)
    units = [re.findall(UNITS[unit], t) for t in texts]
    assert parts.units.tolist() == [len(u) for u in units]
    place = parts.after(np.minimum(k, parts.units))
    assert (place - parts.starts).tolist() == [len("".join(u[:k]).encode()) for u in units]
    assert parts.chars(parts.starts, place).tolist() == [len("".join(u[:k])) for u in units]


@settings(deadline=None)
@given(st.lists(st.integers(0, 7), max_size=300))
def test_ranks(symbols):
    symbols = np.array(symbols, np.uint8)
    matrix, places = fim.WaveletMatrix(symbols), np.arange(len(symbols) + 1)
    for depth in range(1, 4):
        for lead in range(1 << depth):
            want = np.concatenate([[0], np.cumsum(symbols >> (3 - depth) == lead)])
            assert matrix.rank(lead, depth, places).tolist() == want.tolist()
