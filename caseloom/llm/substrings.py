"""Removal of passages that occur earlier in the corpus, by FM-indexes.

A window is ``WINDOW`` consecutive words of one document. A window is a repeat
if the same words also start earlier: in a document of smaller doc_id, or in the
same one further ahead. Words covered by a repeat go. Different texts of one
doc_id are documents of their own, its versions, in the order of their hashes.

Which windows meet: the smallest hash of a window's runs of ``ANCHOR`` words is
its anchor. Equal windows have equal anchors, and consecutive windows of one
anchor form a segment. Segments whose anchor is unique repeat nothing. Copies of
a segment fold to the first one, and all others are repeats as a whole. What is
left, different segments of one anchor, is dealt into shards by anchor.

A shard is indexed: its segments are one text, of which the Burrows-Wheeler
transform is kept as a wavelet tree of packed bits. All segments are streamed
through it from their last word to the first. Each backward step extends the
interval of suffixes that start with the words read so far; at full window
length the interval holds all places of the window in the shard, the earliest
one first. Before the next step the interval is widened to the window without
its last word.

An anchor with too many segments is dealt into several shards. Windows that no
earlier segment of their own shard repeats are then met once more by their hash.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from caseloom.llm.common import hashes, mixed, rolled, utf8, words_of
from caseloom.session import materialize, remove_table

WINDOW, ANCHOR = 20, 5
# A shard is closed when it has as many words.
SHARD_WORDS = 500_000
# Segments of one anchor that go into one shard.
ANCHOR_SEGMENTS = 1_024

_BASE = np.uint64(0x9E3779B97F4A7C15)


def _powers(n: int, base: int) -> np.ndarray:
    steps = np.full(n, base, np.uint64)
    steps[:1] = 1
    return np.multiply.accumulate(steps)


_INVERSE = pow(int(_BASE), -1, 1 << 64)


def segments_of(word_hashes: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """First window, number of windows, anchor and content hash of each segment."""
    windows = len(word_hashes) - WINDOW + 1
    if windows <= 0:
        return np.empty(0, int), np.empty(0, int), np.empty(0, np.uint64), np.empty(0, np.uint64)
    runs = rolled(word_hashes, ANCHOR)
    # Leftmost place of the smallest run, over spans that double and then overlap.
    at, span, wanted = np.arange(len(runs)), 1, WINDOW - ANCHOR + 1
    while span < wanted:
        step = min(span, wanted - span)
        left, right = at[:-step], at[step:]
        at = np.where(runs[right] < runs[left], right, left)
        span += step
    starts = np.flatnonzero(np.append(True, at[1:] != at[:-1]))
    sizes = np.diff(np.append(starts, windows))
    # Polynomial hash of the words of a segment, wherever it starts.
    terms = word_hashes * _powers(len(word_hashes), _INVERSE)
    sums = np.append(np.uint64(0), np.add.accumulate(terms))
    whole = (sums[starts + sizes + WINDOW - 1] - sums[starts]) * _powers(len(word_hashes), int(_BASE))[starts]
    return starts, sizes, runs[at[starts]], mixed(whole + sizes.astype(np.uint64))


def _segments(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for whole in batches:
        for batch in (whole.slice(i, 1024) for i in range(0, whole.num_rows, 1024)):
            found, ids = [], []
            names = zip(batch.column("doc_id").to_pylist(), batch.column("version").to_pylist())
            for name, text in zip(names, utf8(batch.column("text"))):
                words = words_of(text)
                if len(words) >= WINDOW:
                    found.append(segments_of(hashes(words, len(words))))
                    ids.append(np.tile(np.array(name, np.int64), (len(found[-1][0]), 1)))
            if found:
                starts, sizes, anchors, contents = (np.concatenate(x) for x in zip(*found))
                doc_ids, versions = np.concatenate(ids).T
                yield pa.RecordBatch.from_arrays(
                    [pa.array(doc_ids), pa.array(versions.astype(np.int32)), pa.array(starts.astype(np.int32)), pa.array(sizes.astype(np.int32)),
                     pa.array(anchors.view(np.int64)), pa.array(contents.view(np.int64))],
                    ["doc_id", "version", "start", "n", "anchor", "content"])


class WaveletTree:
    """Symbols below ``2 ** levels``, one packed bit vector per bit, with counts of ones every 64 bits."""

    def __init__(self, symbols: np.ndarray, levels: int) -> None:
        self.levels = levels
        self.bits: list[tuple[np.ndarray, np.ndarray, int]] = []
        for level in reversed(range(levels)):
            bit = (symbols >> level) & 1
            packed = np.packbits(np.append(bit, np.zeros(-len(bit) % 64 + 64, bit.dtype)).astype(np.uint8),
                                 bitorder="little").view(np.uint64)
            ones = np.append(0, np.cumsum(np.bitwise_count(packed), dtype=np.int64))[:-1]
            self.bits.append((packed, ones.astype(np.int32), int(len(bit) - bit.sum())))
            symbols = np.concatenate([symbols[bit == 0], symbols[bit == 1]])

    def _descend(self, symbols: np.ndarray, places: np.ndarray) -> np.ndarray:
        for level, (packed, ones, zeros) in zip(reversed(range(self.levels)), self.bits):
            block = places >> 6
            below = (np.uint64(1) << (places & 63).astype(np.uint64)) - np.uint64(1)
            rank = ones[block] + np.bitwise_count(packed[block] & below)
            places = np.where((symbols >> level) & 1, zeros + rank, places - rank)
        return places

    def rank(self, symbols: np.ndarray, places: np.ndarray) -> np.ndarray:
        """How many of the first ``places`` are ``symbols``."""
        return self._descend(symbols, places) - self._descend(symbols, np.zeros_like(places))


class FMIndex:
    """Index of segments (lists of words), in their order, for patterns up to ``WINDOW`` words."""

    def __init__(self, segments: list[list[bytes]]) -> None:
        known: dict[bytes, int] = {}
        # 0 ends a segment.
        self.coded = [np.array([known.setdefault(w, len(known) + 1) for w in words], np.int64) for words in segments]
        lengths = np.array([len(c) + 1 for c in self.coded])
        self.begins = np.append(0, np.cumsum(lengths))[:-1]
        text = np.zeros(int(lengths.sum()), np.int64)
        for begin, coded in zip(self.begins, self.coded):
            text[begin:begin + len(coded)] = coded
        shorter, ranks = self._ranks(text)
        # Equal windows stay in text order, so the first row of an interval is the earliest place.
        self.suffixes = np.argsort(ranks, kind="stable")
        before = text[self.suffixes - 1]
        before[self.suffixes == 0] = 0
        self.tree = WaveletTree(before, int(len(known)).bit_length())
        self.first_row = np.append(0, np.cumsum(np.bincount(text, minlength=len(known) + 1)))
        # Rows whose suffixes share all but the last word of a window.
        group = shorter[self.suffixes]
        edges = np.append(True, group[1:] != group[:-1])
        number = np.cumsum(edges) - 1
        bounds = np.append(np.flatnonzero(edges), len(text))
        self.group_low, self.group_high = bounds[number], bounds[number + 1]

    @staticmethod
    def _ranks(text: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Ranks of the suffixes by their first ``WINDOW - 1`` and ``WINDOW`` words, by doubling."""
        def joined(a: np.ndarray, shift: int) -> np.ndarray:
            shifted = np.append(a[shift:], np.zeros(min(shift, len(a)), a.dtype)) if shift else a
            return np.unique(a * (int(a.max()) + 1) + shifted, return_inverse=True)[1].ravel()

        ranks, depth = text, 1
        while 2 * depth < WINDOW:
            # Past the end counts as the end of a segment, whose rank is 0.
            ranks, depth = joined(ranks, depth), 2 * depth
        return joined(ranks, WINDOW - 1 - depth), joined(ranks, WINDOW - depth)

    def extend(self, words: np.ndarray, low: np.ndarray, high: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Intervals of the suffixes that start with ``words`` before what the given ones start with."""
        ends = self.first_row[words] + self.tree.rank(np.concatenate([words, words]), np.concatenate([low, high])
                                                      ).reshape(2, -1)
        return ends[0], ends[1]

    def repeated(self) -> list[np.ndarray]:
        """For each segment, which of its windows start earlier in the text too.

        Streams all segments at once, longest first, one backward step of each
        at a time. The length matched so far is the number of words read, at
        most ``WINDOW``, for every segment is in the index.
        """
        order = sorted(range(len(self.coded)), key=lambda i: -len(self.coded[i]))
        lengths = np.array([len(self.coded[i]) for i in order])
        begins = self.begins[order]
        text = np.concatenate([np.append(c, 0) for c in self.coded]) if self.coded else np.empty(0, np.int64)
        found = [np.zeros(max(0, len(c) - WINDOW + 1), bool) for c in self.coded]
        hits = np.zeros(len(text), bool)
        low, high = np.zeros(len(order), np.int64), np.full(len(order), len(text))
        for step in range(int(lengths.max(initial=0))):
            active = int(np.searchsorted(-lengths, -step))
            low, high = low[:active], high[:active]
            if step >= WINDOW:
                low, high = self.group_low[low], self.group_high[low]
            places = begins[:active] + lengths[:active] - 1 - step
            low, high = self.extend(text[places], low, high)
            if step >= WINDOW - 1:
                hits[places] = self.suffixes[low] < places
        for i, windows in enumerate(found):
            windows[:] = hits[self.begins[i]:self.begins[i] + len(windows)]
        return found


def _shards(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Repeats of each shard as runs of windows; first windows of anchors in several shards."""
    names = ["kind", "a", "b", "doc_id", "version", "start", "n"]

    def shard(rows: list[tuple]) -> pa.RecordBatch:
        rows.sort(key=lambda r: r[2:5])
        split = [r[5].encode().split(b" ") for r in rows]
        out: list[tuple] = []
        for (anchor, shards, doc_id, version, start, _), words, repeats in zip(rows, split, FMIndex(split).repeated()):
            edges = np.flatnonzero(np.diff(np.concatenate([[0], repeats.astype(np.int8), [0]])))
            out += [(0, doc_id, start + int(a), doc_id, version, start + int(a), int(b - a)) for a, b in edges.reshape(-1, 2)]
            if shards > 1 and not repeats.all():
                windows = rolled(hashes(words, len(words)), WINDOW).view(np.int64)
                out += [(1, anchor, int(windows[i]), doc_id, version, start + int(i), 1) for i in np.flatnonzero(~repeats)]
        columns = list(zip(*out)) or [()] * 7
        kinds = [pa.int32(), pa.int64(), pa.int64(), pa.int64(), pa.int32(), pa.int32(), pa.int32()]
        return pa.RecordBatch.from_arrays([pa.array(list(c), k) for c, k in zip(columns, kinds)], names)

    rows: list[tuple] = []
    words, last = 0, None
    for batch in batches:
        for row in zip(*(batch.column(n).to_pylist() for n in ("anchor", "shards", "salt", "doc_id", "version", "start", "words"))):
            key = row[:3]
            if key != last and words >= SHARD_WORDS:
                yield shard(rows)
                rows, words = [], 0
            last = key
            rows.append((row[0], row[1], *row[3:]))
            words += row[6].count(" ") + 1
    if rows:
        yield shard(rows)


def _segment_words(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for whole in batches:
        for batch in (whole.slice(i, 256) for i in range(0, whole.num_rows, 256)):
            out: list[tuple] = []
            for doc_id, version, text, wanted in zip(batch.column("doc_id").to_pylist(), batch.column("version").to_pylist(),
                                                 utf8(batch.column("text")), batch.column("wanted").to_pylist()):
                words = words_of(text)
                out += [(w["anchor"], w["shards"], w["salt"], doc_id, version, w["start"],
                         b" ".join(words[w["start"]:w["start"] + w["n"] + WINDOW - 1]).decode()) for w in wanted]
            columns = list(zip(*out)) or [()] * 7
            kinds = [pa.int64(), pa.int32(), pa.int32(), pa.int64(), pa.int32(), pa.int32(), pa.string()]
            yield pa.RecordBatch.from_arrays([pa.array(list(c), k) for c, k in zip(columns, kinds)],
                                             ["anchor", "shards", "salt", "doc_id", "version", "start", "words"])


def repeats(docs: DataFrame, repeated: bool = True) -> DataFrame:
    """doc_id, version, ``start`` and ``n``: runs of windows that start earlier in the corpus too.

    ``docs`` has doc_id, never null, text and version. Rows that repeat doc_id
    and version count once; ``repeated`` says whether there may be any.
    """
    segments = materialize(docs.mapInArrow(
        _segments, "doc_id bigint, version int, start int, n int, anchor bigint, content bigint"), "segments")
    # Hot anchors fold before the shuffle. The counts are written, for Spark splits the hot partitions of a
    # join only if nothing is aggregated between the shuffle and the join.
    shared = materialize(segments.groupBy("anchor").agg(F.count("*").alias("met")).where("met > 1").select("anchor"),
                         "shared")
    met = materialize(segments.join(shared, "anchor"), "met")
    remove_table(segments)
    remove_table(shared)
    contents = materialize(
        met.groupBy("anchor", "content").agg(F.min(F.struct("doc_id", "version", "start")).alias("first"), F.max("n").alias("n"))
        .select("anchor", "content", "first.doc_id", "first.version", "first.start", "n"), "contents")
    place = ["doc_id", "version", "start"]
    copies = met.select(*place, "n").distinct().join(contents.select(*place), place, "left_anti")
    # A segment alone under its anchor shares no window with another one.
    several = (contents.groupBy("anchor").agg(F.count("*").alias("segments")).where("segments > 1")
               .select("anchor", F.ceil(F.col("segments") / F.lit(ANCHOR_SEGMENTS)).cast("int").alias("shards")))
    wanted = (contents.join(several, "anchor")
              .withColumn("salt", F.pmod(F.col("content"), F.col("shards")).cast("int"))
              .groupBy("doc_id", "version").agg(F.collect_list(F.struct("anchor", "shards", "salt", "start", "n")).alias("wanted")))
    named = docs.join(wanted, ["doc_id", "version"])
    if repeated:
        # They fold to one, in the partitions and the order that the join leaves.
        named = named.groupBy("doc_id", "version").agg(F.first("text").alias("text"), F.first("wanted").alias("wanted"))
    found = (named.mapInArrow(_segment_words,
                              "anchor bigint, shards int, salt int, doc_id bigint, version int, start int, words string")
             .repartition("anchor", "salt").sortWithinPartitions("anchor", "salt")
             .mapInArrow(_shards, "kind int, a bigint, b bigint, doc_id bigint, version int, start int, n int"))
    # Of the windows with one hash the first stays; as many rows share one as an anchor has shards.
    earlier = Window.partitionBy("kind", "a", "b").orderBy(*place)
    inside = (found.withColumn("place", F.row_number().over(earlier)).where("kind = 0 or place > 1")
              .select(*place, "n"))
    return copies.unionByName(inside)


def _with_versions(texts: DataFrame) -> tuple[DataFrame, bool]:
    """``texts`` with ``version``, the number from 0 of a text among those of its doc_id, and whether any row repeats.

    Hashes alone move; only versions beyond the first are joined, if there are any.
    """
    tid = F.xxhash64(F.coalesce("text", F.lit("")))
    each = texts.where("doc_id is not null").groupBy("doc_id", tid.alias("tid")).agg(F.count("*").alias("n"))
    order = Window.partitionBy("doc_id").orderBy("tid")
    unusual = materialize(each.withColumn("version", F.row_number().over(order) - 1).where("n > 1 or version > 0"), "versions")
    found = unusual.agg(F.max("n").alias("n"), F.max("version").alias("version")).first()
    if not found["version"]:
        return texts.withColumn("version", F.lit(0)), (found["n"] or 1) > 1
    versions = unusual.where("version > 0").select("doc_id", "tid", "version")
    joined = texts.withColumn("tid", tid).join(versions, ["doc_id", "tid"], "left")
    return joined.select("doc_id", "text", F.coalesce("version", F.lit(0)).alias("version")), True


def _kept(words: list[bytes], runs: list[dict] | None) -> tuple[int, int, str]:
    removed = 0
    if runs:
        change = np.zeros(len(words) + 1, np.int64)
        for run in runs:
            change[run["start"]] += 1
            change[min(len(words), run["start"] + run["n"] + WINDOW - 1)] -= 1
        stays = np.cumsum(change)[:-1] == 0
        removed = len(words) - int(stays.sum())
        words = [w for w, s in zip(words, stays) if s]
    return removed + len(words), removed, b" ".join(words).decode()


def remove_repeats(docs: DataFrame) -> DataFrame:
    """doc_id, ``n_words``, ``n_removed`` and ``kept_text``, the kept words joined by blanks; one row per row.

    Null text has no words. Rows that repeat doc_id and text are one document and
    get the same repeats; other texts of a doc_id are other documents, in the
    order of their hashes. Rows without a doc_id have no place in the order: they
    keep all words and make no other a repeat. Only doc_id and text are read.
    Windows are judged on the input. An empty table gives no rows.
    """
    texts = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), F.col("text").cast("string").alias("text"))
    texts, repeated = _with_versions(texts)
    named = texts.where("doc_id is not null")
    runs = repeats(named, repeated).groupBy("doc_id", "version").agg(F.collect_list(F.struct("start", "n")).alias("runs"))

    def finish(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for batch in (whole.slice(i, 1024) for i in range(0, whole.num_rows, 1024)):
                rows = [_kept(words_of(text), own) for text, own in
                        zip(utf8(batch.column("text")), batch.column("runs").to_pylist())]
                columns = list(zip(*rows)) or [()] * 3
                yield pa.RecordBatch.from_arrays(
                    [batch.column("doc_id"), *[pa.array(list(c), k) for c, k in
                                               zip(columns, [pa.int64(), pa.int64(), pa.string()])]],
                    ["doc_id", "n_words", "n_removed", "kept_text"])

    without = F.lit(None).cast("array<struct<start:int,n:int>>").alias("runs")
    return (named.join(runs, ["doc_id", "version"], "left").unionByName(texts.where("doc_id is null").select("*", without))
            .mapInArrow(finish, "doc_id bigint, n_words bigint, n_removed bigint, kept_text string"))


def remove_repeats_sql() -> str:
    """Counts and digests of ``remove_repeats`` for the table documents, window by window."""
    return rf"""
    WITH split AS (SELECT doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS ws FROM documents),
    windows AS (SELECT doc_id, i, array_to_string(ws[i:i + {WINDOW - 1}], ' ') AS words
      FROM (SELECT doc_id, ws, unnest(range(1, len(ws) - {WINDOW - 2})) AS i FROM split WHERE len(ws) >= {WINDOW})),
    repeats AS (SELECT doc_id, i FROM windows QUALIFY row_number() OVER (PARTITION BY words ORDER BY doc_id, i) > 1),
    covered AS (SELECT DISTINCT doc_id, i + j AS place FROM repeats CROSS JOIN (SELECT unnest(range({WINDOW})) AS j)),
    each AS (SELECT doc_id, unnest(ws) AS word, generate_subscripts(ws, 1) AS place FROM split)
    SELECT s.doc_id, any_value(len(ws))::BIGINT AS n_words, count(c.place)::BIGINT AS n_removed,
      sha256(coalesce(string_agg(word, ' ' ORDER BY e.place) FILTER (WHERE c.place IS NULL), '')) AS kept_sha256
    FROM split s LEFT JOIN each e USING (doc_id) LEFT JOIN covered c ON c.doc_id = e.doc_id AND c.place = e.place
    GROUP BY s.doc_id"""
