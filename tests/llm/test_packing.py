import zlib

import numpy as np
import pytest
from tokenizers import Tokenizer

from caseloom.llm import packing
from caseloom.llm.queries import WORD_TOKENIZER


@pytest.mark.parametrize("which", ["documents", "odd_docs"])
def test_pieces(request, which):
    """Ids against the tokenizer on whole texts; every sequence gapless and within capacity."""
    docs = request.getfixturevalue(which)
    tokenizer = Tokenizer.from_file(WORD_TOKENIZER)
    got = packing.pack(docs, WORD_TOKENIZER, with_ids=True).collect()
    want = []
    for doc_id, text in docs.select("doc_id", "text").collect():
        ids = np.array([*tokenizer.encode(text or "", add_special_tokens=False).ids, 0], "<u4")
        want += [(doc_id, i // 2048, i, len(ids[i:i + 2048]), zlib.crc32(ids[i:i + 2048].tobytes())) for i in range(0, len(ids), 2048)]
    assert sorted((tuple(r)[:5] for r in got), key=repr) == sorted(want, key=repr)
    assert all(zlib.crc32(np.array(r.ids, "<u4").tobytes()) == r.ids_crc32 for r in got)
    ends = {}
    for r in sorted(got, key=lambda r: (r.sequence_id, r.offset)):
        assert r.offset == ends.get(r.sequence_id, 0)
        ends[r.sequence_id] = r.offset + r.length
    assert max(ends.values()) <= 2048
    least = -(-sum(ends.values()) // 2048)
    assert len(ends) <= least + 2


def test_empty(no_docs):
    assert packing.pack(no_docs, WORD_TOKENIZER).collect() == []


def test_kinds_place_every_piece():
    rng = np.random.default_rng(3)
    for _ in range(20):
        counts = {int(n): int(c) for n, c in zip(rng.integers(1, 101, 40), rng.integers(1, 50, 40))}
        kinds = packing.kinds_of(counts, 100)
        placed = {}
        for runs, n in kinds:
            assert n > 0 and sum(length * times for length, times in runs) <= 100
            assert sum(times for length, times in runs if 3 * length > 100) <= 2
            for length, times in runs:
                placed[length] = placed.get(length, 0) + n * times
        assert placed == counts


def test_large_pieces_match_as_many_as_can_be():
    # 60 + 40 and 55 + 45 fit; taking 60 + 45 would not.
    assert sum(n for _, n in packing.kinds_of({60: 1, 55: 1, 45: 1, 40: 1}, 100)) == 2
