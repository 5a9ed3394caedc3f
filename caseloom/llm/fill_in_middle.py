"""Fill-in-the-middle: texts cut at two unit boundaries and laid out for infilling.

Every byte of a text has a class of three bits: blank or not, last of its unit or
not, continuation of a code point or not. The classes of a batch of texts form a
wavelet matrix, three bit vectors with a running popcount per 64 bits. How many
bytes before a place have a class, or a prefix of one, is a rank query that reads
one word per level; sums of such ranks count unit ends and code points between
any two places. A cut after k units is the first place with k unit ends before
it, found for all texts of the batch at once by bisection on those counts.

Units are ``token`` (a run of non-blanks with the blanks before it) or ``line``;
what follows the last unit end, trailing blanks or an unfinished line, is one
more unit.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from caseloom.llm.common import utf8

PREFIX, SUFFIX, MIDDLE = "<P>", "<S>", "<M>"
# Bits of a class, from the first level of the matrix on.
BLANK, LAST, CONTINUED = 4, 2, 1
# Classes, as (leading bits, how many), whose bytes end a unit.
ENDS = {"token": [(0b01, 2)], "line": [(0b11, 2)]}
# Classes of bytes that continue a code point: those with the last bit.
INSIDE = [(c, 3) for c in range(1, 8, 2)]
# Bytes of the texts that share a matrix; a longer text has one of its own.
BATCH_BYTES = 4 << 20

_KIND = np.zeros(256, np.uint8)
_KIND[[0x20, *range(0x09, 0x0E)]] = BLANK
_KIND[0x0A] = BLANK | LAST
_KIND[0x80:0xC0] = CONTINUED


def classes(data: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """Class of every byte of texts laid end to end; ``ends`` are their ends."""
    kinds = _KIND[data]
    solid = kinds < BLANK
    # A non-blank is the last of its run before a blank and at the end of its text.
    closes = np.ones(len(data), bool)
    closes[:-1] = ~solid[1:]
    closes[ends[ends > 0] - 1] = True
    kinds[solid & closes] |= LAST
    return kinds


class BitVector:
    """Bits with the number of ones before every 64th."""

    def __init__(self, bits: np.ndarray) -> None:
        packed = np.packbits(bits, bitorder="little")
        self.words = np.zeros(len(bits) // 64 + 1, "<u8")
        self.words.view(np.uint8)[:len(packed)] = packed
        self.before = np.zeros(len(self.words), np.int64)
        np.cumsum(np.bitwise_count(self.words[:-1]), out=self.before[1:])

    def ones(self, place: np.ndarray) -> np.ndarray:
        """How many ones lie before each place."""
        word = place >> 6
        below = (np.uint64(1) << (place & 63).astype(np.uint64)) - np.uint64(1)
        return self.before[word] + np.bitwise_count(self.words[word] & below)


class WaveletMatrix:
    """Rank of classes of ``levels`` bits: each level holds one bit of all, zeros of the level before first."""

    def __init__(self, symbols: np.ndarray, levels: int = 3) -> None:
        self.levels, self.zeros = [], []
        for level in range(levels - 1, -1, -1):
            bits = (symbols >> level) & 1
            self.levels.append(BitVector(bits))
            self.zeros.append(int(len(bits) - bits.sum()))
            ones = bits.astype(bool)
            symbols = np.concatenate([symbols[~ones], symbols[ones]])

    def rank(self, lead: int, depth: int, place: np.ndarray) -> np.ndarray:
        """How many symbols before each place begin with the ``depth`` bits ``lead``."""
        first, last = np.zeros(1, np.int64), place
        for level in range(depth):
            vector = self.levels[level]
            if lead >> (depth - 1 - level) & 1:
                first, last = self.zeros[level] + vector.ones(first), self.zeros[level] + vector.ones(last)
            else:
                first, last = first - vector.ones(first), last - vector.ones(last)
        return last - first

    def count(self, kinds: list[tuple[int, int]], place: np.ndarray) -> np.ndarray:
        """Symbols before each place that begin with any of the disjoint ``kinds``."""
        return sum(self.rank(lead, depth, place) for lead, depth in kinds)


class Texts:
    """Units and code points of a batch of texts, counted by rank."""

    def __init__(self, texts: list[bytes], unit: str = "token") -> None:
        bounds = np.concatenate([[0], np.cumsum([len(t) for t in texts], dtype=np.int64)])
        self.starts, self.ends = bounds[:-1], bounds[1:]
        symbols = classes(np.frombuffer(b"".join(texts), np.uint8), self.ends)
        self.matrix = WaveletMatrix(symbols)
        self.kinds = ENDS[unit]
        self.before = self.matrix.count(self.kinds, self.starts)
        self.whole = self.matrix.count(self.kinds, self.ends) - self.before
        # Where the last unit that has an end ends; what follows is one more unit.
        self.closed = self._reach(self.whole)
        self.units = self.whole + (self.closed < self.ends)

    def _reach(self, wanted: np.ndarray) -> np.ndarray:
        """First place of each text with ``wanted`` unit ends before it, which it must have."""
        low, high = self.starts.copy(), self.ends.copy()
        while (open_ := low < high).any():
            middle = (low + high) >> 1
            enough = self.matrix.count(self.kinds, middle) - self.before >= wanted
            high = np.where(open_ & enough, middle, high)
            low = np.where(open_ & ~enough, middle + 1, low)
        return low

    def after(self, units: np.ndarray) -> np.ndarray:
        """Place in each text after so many of its units, from 0 to all."""
        return np.where(units > self.whole, self.ends, self._reach(np.minimum(units, self.whole)))

    def chars(self, start: np.ndarray, end: np.ndarray) -> np.ndarray:
        """Code points from each start to each end."""
        return end - start - self.matrix.count(INSIDE, end) + self.matrix.count(INSIDE, start)


def _hash_parts(key: Column, seed: int, parts: int) -> list[Column]:
    digits = F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(key.cast("string"), F.lit(""))), 256)
    return [F.conv(F.substring(digits, 8 * i + 1, 8), 16, 10).cast("bigint") for i in range(parts)]


def transform(docs: DataFrame, rate: int = 50, spm: int = 80, unit: str = "token", seed: int = 42) -> DataFrame:
    """Every document's doc_id, ``n`` units, ``form``, ``prefix_chars``, ``middle_chars`` and ``output``.

    Of the texts, ``rate`` percent are cut in three at unit boundaries drawn from
    a hash of doc_id, and of these ``spm`` percent give their suffix first. A
    text that is empty or holds one of the marks stays plain, so ``restored``
    finds the parts of any output. Null text is empty. Rows of one doc_id draw
    the same numbers, whatever their texts; a null doc_id draws as no digits.
    Lengths are null for plain forms. Only doc_id and text are read, every row
    gives one row, an empty table none.
    """
    first, second, third, fourth = _hash_parts(F.col("doc_id"), seed, 4)
    rows = docs.select(
        F.col("doc_id").cast("bigint"), F.col("text").cast("string"), first.alias("first"), second.alias("second"),
        F.when(third % 100 >= rate, "plain").when(fourth % 100 < spm, "spm").otherwise("psm").alias("form"))
    marks = {name: mark.encode() for name, mark in (("p", PREFIX), ("s", SUFFIX), ("m", MIDDLE))}

    def work(batch: pa.RecordBatch) -> pa.RecordBatch:
        texts = utf8(batch.column("text"))
        parts = Texts(texts, unit)
        drawn = [np.asarray(batch.column(c).to_numpy(zero_copy_only=False)) % (parts.units + 1) for c in ("first", "second")]
        cuts = [parts.after(np.minimum(*drawn)), parts.after(np.maximum(*drawn))]
        prefix, middle = parts.chars(parts.starts, cuts[0]), parts.chars(cuts[0], cuts[1])
        forms, outputs = batch.column("form").to_pylist(), []
        for i, text in enumerate(texts):
            if not text or any(mark in text for mark in marks.values()):
                forms[i] = "plain"
            if forms[i] == "plain":
                outputs.append(text)
                continue
            a, b = (int(cut[i] - parts.starts[i]) for cut in cuts)
            lead = (marks["s"], text[b:], marks["p"], text[:a]) if forms[i] == "spm" else (marks["p"], text[:a], marks["s"], text[b:])
            outputs.append(b"".join((*lead, marks["m"], text[a:b])))
        cut = np.array([form != "plain" for form in forms], bool)
        return pa.RecordBatch.from_arrays(
            [batch.column("doc_id"), pa.array(parts.units, pa.int64()), pa.array(forms, pa.string()),
             pa.array(prefix, pa.int64(), mask=~cut), pa.array(middle, pa.int64(), mask=~cut),
             pa.array(outputs, pa.binary()).cast(pa.string(), safe=False)],
            ["doc_id", "n", "form", "prefix_chars", "middle_chars", "output"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            # Only as many texts share a matrix as stay small.
            sizes = np.cumsum([len(t) for t in utf8(batch.column("text"))], dtype=np.int64) // BATCH_BYTES
            for start, end in _runs(sizes):
                yield work(batch.slice(start, end - start))

    return rows.mapInArrow(run, "doc_id bigint, n bigint, form string, prefix_chars bigint, middle_chars bigint, output string")


def _runs(values: np.ndarray) -> Iterator[tuple[int, int]]:
    """Runs of equal values, as (start, end)."""
    if len(values):
        edges = [0, *(np.flatnonzero(np.diff(values)) + 1).tolist(), len(values)]
        yield from zip(edges, edges[1:])


def restored(output: Column, form: Column) -> Column:
    """The exact text that ``transform`` turned into ``output``, from it and its form alone."""
    def between(lead: str, end: str) -> Column:
        return F.substring_index(F.substring_index(output, lead, -1), end, 1)

    middle = F.substring_index(output, MIDDLE, -1)
    return (F.when(form == "psm", F.concat(between(PREFIX, SUFFIX), middle, between(SUFFIX, MIDDLE)))
            .when(form == "spm", F.concat(between(PREFIX, MIDDLE), middle, between(SUFFIX, PREFIX)))
            .otherwise(output))


def transform_sql() -> str:
    """The query's rows by a regular expression over whole texts."""
    return r"""
WITH units AS (
    SELECT doc_id, coalesce(text, '') AS text, sha256('42:' || coalesce(doc_id::VARCHAR, '')) AS h,
           regexp_extract_all(coalesce(text, ''), '[\x20\x09-\x0D]*[^\x20\x09-\x0D]+|[\x20\x09-\x0D]+') AS units
    FROM documents
), drawn AS (
    SELECT *, len(units) AS n, ('0x' || h[25:32])::BIGINT % 100 AS fourth,
           ('0x' || h[1:8])::BIGINT % (len(units) + 1) AS first, ('0x' || h[9:16])::BIGINT % (len(units) + 1) AS second,
           text = '' OR contains(text, '<P>') OR contains(text, '<S>') OR contains(text, '<M>')
               OR ('0x' || h[17:24])::BIGINT % 100 >= 50 AS plain
    FROM units
), parts AS (
    SELECT *, CASE WHEN plain THEN 'plain' WHEN fourth < 80 THEN 'spm' ELSE 'psm' END AS form,
           array_to_string(units[1:least(first, second)], '') AS prefix,
           array_to_string(units[least(first, second) + 1:greatest(first, second)], '') AS middle,
           array_to_string(units[greatest(first, second) + 1:n], '') AS suffix
    FROM drawn
)
SELECT doc_id, n::BIGINT AS n, form,
       CASE WHEN NOT plain THEN length(prefix) END::BIGINT AS prefix_chars,
       CASE WHEN NOT plain THEN length(middle) END::BIGINT AS middle_chars,
       sha256(CASE form WHEN 'plain' THEN text WHEN 'psm' THEN '<P>' || prefix || '<S>' || suffix || '<M>' || middle
                        ELSE '<S>' || suffix || '<P>' || prefix || '<M>' || middle END) AS output_sha256,
       sha256(text) AS restored_sha256
FROM parts
"""
