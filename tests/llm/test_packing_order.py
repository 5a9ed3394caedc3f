"""Sequences in the order of the mixture, after the documents were written and read again."""

import corpus_pipeline
from llm.conftest import SMALL

from caseloom.llm import mixing, packing


def firsts(rows, position):
    least = {}
    for r in rows:
        least[r.sequence_id] = min(position[r.doc_id], least.get(r.sequence_id, position[r.doc_id]))
    assert sorted(least) == list(range(len(least)))
    return [least[i] for i in sorted(least)]


def test_stage(spark, documents, tmp_path):
    corpus_pipeline.mixed_by_weight(spark, documents, SMALL).write.parquet(f"{tmp_path}/mixed")
    reread = spark.read.parquet(f"{tmp_path}/mixed")
    position = {r.doc_id: r.position for r in mixing.mix(documents).collect()}
    rows = corpus_pipeline.packed(spark, reread, SMALL).collect()
    order = firsts(rows, position)
    assert order == sorted(order)
    # Of one length the earlier document comes in the earlier sequence of a kind; nothing else changes.
    plain = packing.pack(reread, corpus_pipeline.TOKENIZER).collect()
    assert sorted((r.doc_id, r.piece, r.start, r.length, r.ids_crc32) for r in rows) == sorted(
        (r.doc_id, r.piece, r.start, r.length, r.ids_crc32) for r in plain)
    ends = {}
    for r in sorted(rows, key=lambda r: (r.sequence_id, r.offset)):
        assert r.offset == ends.get(r.sequence_id, 0)
        ends[r.sequence_id] = r.offset + r.length
    assert max(ends.values()) <= packing.CAPACITY and len(ends) == len({r.sequence_id for r in plain})


def test_weights(spark, tmp_path):
    """Documents of one length: every prefix of sequences has the shares of the weights, whatever they are."""
    spark.createDataFrame([(i, "some words", "ab"[i % 2]) for i in range(400)], "doc_id long, text string, source string").write.parquet(
        f"{tmp_path}/docs")
    docs = spark.read.parquet(f"{tmp_path}/docs")
    source = {i: "ab"[i % 2] for i in range(400)}
    for weights in ({"a": 3, "b": 1}, {"a": 1, "b": 4}):
        placed = mixing.placed(docs, weights, "place")
        rows = packing.pack(placed, corpus_pipeline.TOKENIZER, capacity=8, order="place").collect()
        by_sequence = [source[r.doc_id] for r in sorted(rows, key=lambda r: (r.sequence_id, r.offset))]
        want = weights["a"] / sum(weights.values())
        assert abs(by_sequence[:100].count("a") / 100 - want) < 0.05
