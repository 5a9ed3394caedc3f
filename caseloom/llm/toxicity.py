"""Toxicity by compression distance.

Two zstandard dictionaries are trained, one on ordinary and one on toxic text.
A window is a word between boundaries of pad bytes, so that a match of the whole
word is worth more than one inside it, and any window can be compressed. Its
gain is how many bytes shorter it gets when the toxic dictionary precedes the
ordinary one. For most windows that is nothing; a document is scored from how
many windows reach each gain, by a logistic curve fitted on documents that did
not train the dictionaries.

Toxic training text is what tells toxic documents apart: words seen after at
least ``contexts`` different words in toxic documents, and far less often in
ordinary ones. Copies of one document show a word in one context only. The
toxic dictionary keeps those words whole; zstandard's trainer, which makes the
ordinary one, would cut them.
"""

from __future__ import annotations

import zlib
from collections import defaultdict
from collections.abc import Sequence
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Bounds of the training sample: documents of each kind, whole.
TOXIC_DOCS, ORDINARY_DOCS = 1_600, 3_200
# Bytes of the dictionaries. Together they stay below 128 KB, where zstandard changes its search.
TOXIC_BYTES, ORDINARY_BYTES = 16_384, 65_536
LEVEL = 12
CONTRAST = 8.0
PAD = b"\n" * 16
MARKS = ".,;:!?\"'()"
# Gains a document's windows are counted by.
GAINS = range(2, 9)
MEMORY_WORDS = 250_000
THRESHOLD = 0.5


def words_of(text: str) -> list[str]:
    return text.lower().split()


def _framed(words: Sequence[str]) -> bytes:
    return PAD + PAD.join(w.encode() for w in words) + PAD


def _dictionary(samples: list[bytes], size: int) -> bytes:
    """A trained dictionary, or the samples themselves where they are too few to train one."""
    try:
        return zstandard.train_dictionary(size, samples).as_bytes()
    except zstandard.ZstdError:
        return b"".join(samples)[-size:]


@dataclass(frozen=True)
class Model:
    """Dictionaries and the curve; ``weights`` is empty when there was nothing to learn from."""

    toxic: bytes
    ordinary: bytes
    weights: tuple[float, ...]


class Scorer:
    """Scores texts; remembers the gains of words."""

    def __init__(self, model: Model) -> None:
        self.model = model
        self.gains: dict[str, int] = {}
        self.compressors = [self._compressor(model.ordinary), self._compressor(model.toxic + model.ordinary)]

    @staticmethod
    def _compressor(content: bytes) -> zstandard.ZstdCompressor:
        dictionary = zstandard.ZstdCompressionDict(content, dict_type=zstandard.DICT_TYPE_RAWCONTENT)
        dictionary.precompute_compress(level=LEVEL)
        return zstandard.ZstdCompressor(dict_data=dictionary, level=LEVEL, write_content_size=False,
                                        write_checksum=False, write_dict_id=False)

    def _learn(self, words: list[str]) -> None:
        for start in range(0, len(words), 10_000):
            some = words[start:start + 10_000]
            windows = [_framed([w.strip(MARKS)]) for w in some]
            plain, toxic = [[len(s) for s in c.multi_compress_to_buffer(windows, threads=1)] for c in self.compressors]
            self.gains.update((w, a - b) for w, a, b in zip(some, plain, toxic))

    def features(self, texts: list[str]) -> np.ndarray:
        """Per text: log counts of windows by gain, the largest gain, log count of words."""
        split = [words_of(text) for text in texts]
        if len(self.gains) > MEMORY_WORDS:
            self.gains = {}
        self._learn(sorted(set().union(*split).difference(self.gains)))
        rows = np.zeros((len(texts), len(GAINS) + 2))
        for row, words in zip(rows, split):
            if words:
                gains = np.fromiter(map(self.gains.__getitem__, words), np.int64, count=len(words))
                counts = np.bincount(np.clip(gains, 0, GAINS[-1]), minlength=GAINS[-1] + 1)
                row[:-2] = np.log1p(counts[::-1].cumsum()[::-1][GAINS[0]:])
                row[-2] = max(0, gains.max())
                row[-1] = np.log1p(len(words))
        return rows

    def scores(self, texts: list[str]) -> np.ndarray:
        if not self.model.weights:
            return np.zeros(len(texts))
        weights = np.array(self.model.weights)
        return 1 / (1 + np.exp(-np.clip(self.features(texts) @ weights[1:] + weights[0], -40, 40)))


def _logistic(x: np.ndarray, y: np.ndarray, ridge: float = 1.0) -> np.ndarray:
    """Weights of a logistic curve, intercept first, by Newton steps."""
    x = np.hstack([np.ones((len(x), 1)), x])
    penalty = ridge * np.eye(x.shape[1])
    penalty[0, 0] = 1e-6
    weights = np.zeros(x.shape[1])
    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip(x @ weights, -40, 40)))
        step = np.linalg.solve((x * (p * (1 - p))[:, None]).T @ x + penalty, x.T @ (y - p) - penalty @ weights)
        weights += step
        if np.abs(step).max() < 1e-8:
            break
    return weights


def _contrast_words(toxic: list[list[str]], ordinary: list[list[str]]) -> dict[str, int]:
    """Words that tell toxic documents apart, with the number of contexts they were seen in."""
    seen = []
    for texts in (ordinary, toxic):
        contexts: defaultdict[str, set[int]] = defaultdict(set)
        for words in texts:
            bare = [w.strip(MARKS) for w in words]
            for before, word in zip(["", *bare], bare):
                if word:
                    contexts[word].add(zlib.crc32(before.encode()))
        seen.append({w: len(c) for w, c in contexts.items()})
    share = sum(map(len, toxic)) / max(1, sum(map(len, ordinary)))
    least = max(3, round(0.0075 * len(toxic)))
    return {w: n for w, n in seen[1].items() if n >= least and n >= CONTRAST * (seen[0].get(w, 0) * share + 0.5)}


def _dictionaries(kept: list[tuple[int, list[str], int]]) -> tuple[bytes, bytes]:
    toxic = [words for _, words, y in kept if y]
    ordinary = [words for _, words, y in kept if not y]
    telling = _contrast_words(toxic, ordinary)

    bare = [[w for w in (w.strip(MARKS) for w in words) if w and w not in telling] for words in ordinary]
    # Words of most contexts last, where references are shortest.
    return (_framed(sorted(telling, key=lambda w: (telling[w], w)))[-TOXIC_BYTES:],
            _dictionary([_framed(words) for words in bare if words], ORDINARY_BYTES))


def train(sample: list[tuple[int, str, int]], toxic_share: float) -> Model:
    """``sample`` has (id, text, 0 or 1); ``toxic_share`` is that of all labelled documents.

    Two thirds of the sample train the dictionaries, the rest fits the curve.
    """
    kept = [(zlib.crc32(f"third {i}".encode()) % 3 == 0, words_of(text), y) for i, text, y in sample]
    if len({(rest, y) for rest, _, y in kept}) < 4:
        return Model(b"", b"", ())
    toxic, ordinary = _dictionaries([k for k in kept if not k[0]])
    y = np.array([label for rest, _, label in kept if rest], float)
    weights = _logistic(Scorer(Model(toxic, ordinary, ())).features(
        [" ".join(words) for rest, words, _ in kept if rest]), y)
    # The sample holds more toxic documents than the labels do.
    share = min(max(toxic_share, 1e-6), 1 - 1e-6)
    weights[0] += np.log(share / (1 - share)) - np.log(y.mean() / (1 - y.mean()))
    return Model(toxic, ordinary, tuple(weights.tolist()))


def held_out(doc_id: Column) -> Column:
    """Whether a document's label is never learned from; false without a doc_id."""
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % 5 == 0, F.lit(False))


def fit(docs: DataFrame, labels: DataFrame) -> Model:
    """A model from the labels that are not held out (doc_id, toxic; null marks and ids are no labels).

    A label that repeats a document counts as toxic if any of them does. The
    sample is the labelled documents with the smallest hashes, at most
    ``TOXIC_DOCS`` and ``ORDINARY_DOCS``, so the same ones however rows lie.
    Hashes far above what so many need are left out first, so that what tasks
    send to the driver does not grow with their number.
    """
    known = (labels.select(F.col("doc_id").cast("bigint").alias("doc_id"), F.col("toxic").cast("int").alias("toxic"))
             .where("doc_id is not null and toxic is not null").where(~held_out(F.col("doc_id")))
             .groupBy("doc_id").agg(F.max("toxic").alias("toxic")))
    share, n, bad = known.agg(F.avg("toxic"), F.count("*"), F.coalesce(F.sum("toxic"), F.lit(0))).first()

    def first(toxic: int, most: int) -> DataFrame:
        of = bad if toxic else n - bad
        hashed = known.withColumn("hash", F.xxhash64("doc_id").bitwiseAND(F.lit((1 << 62) - 1)))
        near = hashed.where((F.col("toxic") == toxic) & (F.col("hash") < F.lit(min(1 << 62, (1 << 62) * 2 * most // max(1, of)))))
        return near.orderBy("hash", "doc_id").limit(most).drop("hash")

    chosen = first(1, TOXIC_DOCS).unionByName(first(0, ORDINARY_DOCS))
    # At most TOXIC_DOCS + ORDINARY_DOCS rows are broadcast, and as many texts collected.
    rows = (docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), F.col("text").cast("string").alias("text"))
            .where("text is not null").join(F.broadcast(chosen), "doc_id")
            .select("doc_id", "text", "toxic").collect())
    sample = sorted((row["doc_id"], row["text"], row["toxic"]) for row in rows)
    return train(sample, share or 0.0)


_SCORERS: dict[Model, Scorer] = {}


def score(text: Column, model: Model) -> Column:
    """0 to 1, higher for texts likelier toxic; null counts as empty."""
    @F.arrow_udf("double")
    def scores(texts: pa.Array) -> pa.Array:
        scorer = _SCORERS.get(model)
        if scorer is None:
            _SCORERS.clear()
            scorer = _SCORERS[model] = Scorer(model)
        found = [scorer.scores([t or "" for t in texts.slice(i, 512).to_pylist()]) for i in range(0, len(texts), 512)]
        return pa.array(np.concatenate(found) if found else [], pa.float64())

    return scores(text)


def classify(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """doc_id, ``held_out``, ``score`` and ``predicted`` of every document; one row per row.

    Only doc_id and text are read, so other columns may have any name, and a
    score depends on the text alone. Null text is empty. Without labels of both
    kinds every score is 0. An empty table gives no rows.
    """
    model = fit(docs, labels)
    return (docs.select("doc_id", held_out(F.col("doc_id")).alias("held_out"),
                        score(F.col("text").cast("string"), model).alias("score"))
            .withColumn("predicted", (F.col("score") >= THRESHOLD).cast("int")))


def drop_toxic(docs: DataFrame, model: Model) -> DataFrame:
    """``docs`` without the texts predicted toxic; all columns stay as they are."""
    return docs.where(score(F.col("text").cast("string"), model) < THRESHOLD)
