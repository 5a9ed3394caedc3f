"""Secrets in texts: fixed rules, and a character network for what they miss.

Rules find assignments to secret names, access keys and long hex numbers. Every
other string that could be a secret is a candidate; a convolutional network in
numpy reads its characters and those around it. It is trained on labelled
findings: all different candidates of the corpus that the rules label, and
generated ones of formats the rules do not know, in the context of every other
candidate. Half of the findings of rules have their secret's name taken away, so
the network learns what secrets look like and not the rules. Findings are dealt
by hash into shards; each epoch goes through all shards at once from the same
weights, whose mean begins the next one. The output is calibrated on a quarter
of the findings, on which it was not trained, and the threshold is the highest
that still finds ``RECALL`` of the secrets among those.
"""

from __future__ import annotations

import base64
import hashlib
import random
import re
import string
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from caseloom.session import materialize

# The rules.
ASSIGN = re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.I | re.A)
ACCESS = re.compile(r"AKIA[A-Z0-9]+")
HEX = re.compile(r"[0-9a-f]+")
KINDS = ("assign", "access", "hex", "model")

# Strings of secrets' characters: of 8 and more with a digit, a change to capitals or a sign inside; any of 16 and more.
_SIGN = r"[A-Za-z0-9+/_.=@!#$%&*^~-]"
CANDIDATE = re.compile(
    rf"(?<!{_SIGN})(?:(?={_SIGN}*(?:[0-9]|[a-z][A-Z]|[A-Za-z0-9][@!#$%&*^~][A-Za-z0-9])){_SIGN}{{8,}}|{_SIGN}{{16,}})", re.A)
# Signs at the ends that belong to the text around.
AROUND = ".!%&*#$^~"
SHORTEST = 8
# Names of secrets beyond the rules' own, whose values are candidates from six characters on.
NAMED = re.compile(r"""(?:pwd|passphrase|credential|bearer|auth|access_?key|private_?key)["']?[\x20]*[:=\x20][\x20]*["']?"""
                   r"""([A-Za-z0-9+/_.=-]{6,})""", re.I | re.A)

# Characters read at once of a candidate, and on each side of it.
VALUE, SIDE = 48, 24
WIDTH = VALUE + 2 * SIDE
FILTERS, REACH, EMBED, HIDDEN = 24, 5, 12, 24
# The fewest generated findings, and how many there are at least for each of the rules.
GENERATED, FOR_EACH = 4_000, 2
# Pieces of findings that one task trains on between two means of weights.
SHARD = 6_000
# Steps of a logit that are counted apart when the output is calibrated, and the largest logit told from others.
STEPS, FARTHEST = 1_024, 64
EPOCHS, BATCH, RATE, DECAY = 8, 64, 0.003, 0.002
RECALL = 0.98

Span = tuple[str, int, int]


def rule_spans(text: str) -> list[Span]:
    """Findings of the rules by start, then kind; leftmost, not overlapping within a kind."""
    spans = [("assign", *m.span()) for m in ASSIGN.finditer(text) if len(m[2]) >= 6]
    if "AKIA" in text:
        spans += [("access", *m.span()) for m in ACCESS.finditer(text) if len(m[0]) >= 20]
    if re.search("[0-9]", text) or re.search("[a-f]{24}", text):
        spans += [("hex", *m.span()) for m in re.finditer("[0-9a-f]{24,}", text)]
    return sorted(spans, key=lambda s: (s[1], KINDS.index(s[0])))


def candidates(text: str) -> list[tuple[int, int]]:
    """Strings that could be secrets, by place; the network decides."""
    found = set()
    for m in CANDIDATE.finditer(text):
        value = m[0].strip(AROUND)
        if len(value) >= SHORTEST:
            start = m.start() + m[0].index(value)
            found.add((start, start + len(value)))
    found.update(m.span(1) for m in NAMED.finditer(text))
    return sorted(found)


def around(text: str, start: int, end: int) -> tuple[str, str, str]:
    return text[max(0, start - SIDE):start], text[start:end], text[end:end + SIDE]


def scan(text: str) -> tuple[list[Span], list[dict]]:
    """Findings of the rules, and candidates with their surroundings and whether a rule's span covers them."""
    spans = rule_spans(text)
    out = []
    for start, end in candidates(text):
        left, value, right = around(text, start, end)
        ruled = any(a <= start and end <= b for _, a, b in spans)
        out.append({"start": start, "end": end, "left": left, "value": value, "right": right, "ruled": ruled})
    return spans, out


def _coded(left: str, value: str, right: str) -> list[np.ndarray]:
    """Characters as numbers below 128, twice that for the candidate's own; long candidates give several pieces."""
    def codes(text: str) -> np.ndarray:
        raw = np.frombuffer(text.encode("utf-32-le"), np.uint32)
        return np.where(raw < 127, raw, 127).astype(np.int16)

    pieces = []
    for at in range(0, max(1, len(value)), VALUE):
        row = np.zeros(WIDTH, np.int16)
        before, own, after = codes((left + value[:at])[-SIDE:]), codes(value[at:at + VALUE]), codes(
            (value[at + VALUE:] + right)[:SIDE])
        row[SIDE - len(before):SIDE] = before
        row[SIDE:SIDE + len(own)] = own + 128
        row[SIDE + len(own):SIDE + len(own) + len(after)] = after
        pieces.append(row)
    return pieces


@dataclass
class Network:
    """Embedding, one convolution, maxima over the candidate and over its surroundings, two dense layers."""

    weights: dict[str, np.ndarray]
    slope: float = 1.0
    offset: float = 0.0
    threshold: float = 2.0

    @staticmethod
    def fresh(seed: int = 7) -> Network:
        rng = np.random.default_rng(seed)

        def normal(*shape: int) -> np.ndarray:
            return rng.normal(0, np.sqrt(2 / shape[0]), shape).astype(np.float32)

        return Network({"embed": rng.normal(0, 0.5, (256, EMBED)).astype(np.float32),
                        "conv": normal(REACH * EMBED, FILTERS), "conv0": np.zeros(FILTERS, np.float32),
                        "dense": normal(3 * FILTERS, HIDDEN), "dense0": np.zeros(HIDDEN, np.float32),
                        "out": normal(HIDDEN, 1), "out0": np.zeros(1, np.float32)})

    def forward(self, rows: np.ndarray) -> tuple[np.ndarray, tuple]:
        w = self.weights
        embedded = w["embed"][rows]
        n, steps = len(rows), WIDTH - REACH + 1
        windows = np.lib.stride_tricks.sliding_window_view(embedded, REACH, axis=1).transpose(0, 1, 3, 2)
        windows = np.ascontiguousarray(windows).reshape(n, steps, REACH * EMBED)
        active = np.maximum(windows @ w["conv"] + w["conv0"], 0)
        # Windows whose middle is the candidate's own; the others are surroundings.
        own = (rows[:, REACH // 2:REACH // 2 + steps] >= 128)[:, :, None]
        inside, outside = np.where(own, active, 0), np.where(own, 0, active)
        count = np.maximum(own.sum(axis=1), 1)
        pooled = np.concatenate([inside.max(axis=1), outside.max(axis=1), inside.sum(axis=1) / count], axis=1)
        hidden = np.maximum(pooled @ w["dense"] + w["dense0"], 0)
        logits = (hidden @ w["out"] + w["out0"])[:, 0]
        return logits, (rows, windows, active, own, inside, outside, count, pooled, hidden)

    def gradients(self, state: tuple, slope: np.ndarray) -> dict[str, np.ndarray]:
        rows, windows, active, own, inside, outside, count, pooled, hidden = state
        w, n, steps = self.weights, len(rows), active.shape[1]
        grads = {"out": hidden.T @ slope[:, None], "out0": slope.sum(keepdims=True)}
        d_hidden = (slope[:, None] @ w["out"].T) * (hidden > 0)
        grads |= {"dense": pooled.T @ d_hidden, "dense0": d_hidden.sum(axis=0)}
        d_pooled = d_hidden @ w["dense"].T
        d_active = np.broadcast_to((d_pooled[:, 2 * FILTERS:] / count)[:, None, :], active.shape) * own
        d_active = np.ascontiguousarray(d_active)
        row, column = np.arange(n)[:, None], np.arange(FILTERS)[None, :]
        for part, values in ((0, inside), (1, outside)):
            best = values.argmax(axis=1)
            mine = own[row, best, 0] == (part == 0)
            d_active[row, best, column] += d_pooled[:, part * FILTERS:(part + 1) * FILTERS] * mine
        d_active *= active > 0
        flat = d_active.reshape(n * steps, FILTERS)
        grads |= {"conv": windows.reshape(n * steps, -1).T @ flat, "conv0": flat.sum(axis=0)}
        d_windows = (flat @ w["conv"].T).reshape(n, steps, REACH, EMBED)
        d_embedded = np.zeros((n, WIDTH, EMBED), np.float32)
        for i in range(REACH):
            d_embedded[:, i:i + steps] += d_windows[:, :, i]
        codes, flat = rows.ravel(), d_embedded.reshape(-1, EMBED)
        grads["embed"] = np.stack([np.bincount(codes, flat[:, i], len(w["embed"])) for i in range(EMBED)], axis=1).astype(w["embed"].dtype)
        return grads

    def logits(self, findings: list[tuple[str, str, str]]) -> np.ndarray:
        """The highest of a long candidate's pieces."""
        pieces = [_coded(*f) for f in findings]
        owner = np.repeat(np.arange(len(pieces)), [len(p) for p in pieces])
        rows = np.array([row for p in pieces for row in p], np.int16).reshape(-1, WIDTH)
        logits = np.concatenate([np.empty(0, np.float32), *[
            self.forward(rows[i:i + 512])[0] for i in range(0, len(rows), 512)]])
        best = np.full(len(pieces), -np.inf)
        np.maximum.at(best, owner, logits)
        return best

    def probabilities(self, findings: list[tuple[str, str, str]]) -> np.ndarray:
        """Calibrated."""
        return self.calibrated(self.logits(findings))

    def calibrated(self, logits: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(self.slope * logits + self.offset, -40, 40)))


def _calibration(logits: np.ndarray, y: np.ndarray, n: np.ndarray) -> tuple[float, float]:
    """Slope and offset of a logistic curve through the logits, each there ``n`` times."""
    # Steps stay small where the marks are almost parted.
    spread = max(1.0, float(np.abs(logits).max()))
    logits, a, b = logits / spread, 1.0, 0.0
    for _ in range(200):
        p = 1 / (1 + np.exp(-np.clip(a * logits + b, -40, 40)))
        q = n * (p * (1 - p) + 1e-6)
        x = np.stack([logits, np.ones_like(logits)])
        step = np.linalg.solve((x * q) @ x.T + 0.01 * np.eye(2), x @ (n * (p - y)) + 0.01 * np.array([a, b]))
        a, b = a - step[0], b - step[1]
        if np.abs(step).max() < 1e-9:
            break
    return float(a) / spread, float(b)


def _held(left: str, value: str, right: str) -> bool:
    """A quarter of the findings calibrates and sets the threshold."""
    return int(hashlib.md5("\0".join((left, value, right)).encode()).hexdigest(), 16) % 4 == 0


def _trained(weights: dict[str, np.ndarray], rows: np.ndarray, y: np.ndarray, epochs: int, seed: int) -> dict[str, np.ndarray]:
    """Weights after some epochs over coded pieces, by Adam in small batches."""
    net = Network({name: w.copy() for name, w in weights.items()})
    rng, moments, step = np.random.default_rng(seed), {}, 0
    for _ in range(epochs):
        order = rng.permutation(len(rows))
        for some in (order[i:i + BATCH] for i in range(0, len(order), BATCH)):
            logits, state = net.forward(rows[some])
            slope = (1 / (1 + np.exp(-np.clip(logits, -40, 40))) - y[some]) / len(some)
            step += 1
            for name, grad in net.gradients(state, slope.astype(np.float32)).items():
                m, v = moments.get(name, (0.0, 0.0))
                m, v = 0.9 * m + 0.1 * grad, 0.999 * v + 0.001 * grad * grad
                moments[name] = m, v
                net.weights[name] *= 1 - RATE * DECAY * (grad.ndim > 1)
                net.weights[name] -= RATE * (m / (1 - 0.9 ** step)) / (np.sqrt(v / (1 - 0.999 ** step)) + 1e-8)
    return net.weights


def _calibrate(net: Network, logits: np.ndarray, marks: np.ndarray, n: np.ndarray) -> Network:
    """Sets the curve and the threshold by logits of held findings, each there ``n`` times."""
    net.slope, net.offset = _calibration(logits, marks, n)
    secret = marks == 1
    order = np.argsort(-logits[secret], kind="stable")
    upto = np.cumsum(n[secret][order])
    last = logits[secret][order][np.searchsorted(upto, np.ceil(RECALL * upto[-1]))]
    net.threshold = float(net.calibrated(last))
    return net


def train(findings: list[tuple[str, str, str, int]]) -> Network:
    """``findings``: left, value, right, and 1 for a secret. A few, in this process."""
    net = Network.fresh()
    pieces = [(row, f[3]) for f in findings if not _held(*f[:3]) for row in _coded(*f[:3])]
    test = [f for f in findings if _held(*f[:3])]
    y = np.array([label for _, label in pieces], np.float32)
    if len(set(y.tolist())) < 2 or len({f[3] for f in test}) < 2:
        return net
    net.weights = _trained(net.weights, np.array([row for row, _ in pieces], np.int16), y, EPOCHS, 11)
    marks = np.array([f[3] for f in test], float)
    return _calibrate(net, net.logits([f[:3] for f in test]).astype(float), marks, np.ones(len(test)))


def _generated(contexts: list[tuple[str, str]], rng: random.Random, count: int = GENERATED, first: int = 0) -> list[tuple[str, str, str, int]]:
    """Findings of formats beyond the rules, secrets and others in turn, in contexts of the corpus."""
    alnum, hexes = string.ascii_letters + string.digits, "0123456789abcdef"

    def some(signs: str, n: int) -> str:
        return "".join(rng.choice(signs) for _ in range(n))

    def word() -> str:
        return "".join(rng.choice("bcdfghjklmnprstvw") + rng.choice("aeiou") + rng.choice(("", "", "n", "r", "st"))
                       for _ in range(rng.randint(2, 4)))

    secrets = [
        lambda: "ghp_" + some(alnum, 36), lambda: "sk_live_" + some(alnum, 24), lambda: "ASIA" + some(alnum.upper(), 16),
        lambda: "xoxb-" + some(string.digits, 12) + "-" + some(alnum, 24),
        lambda: "eyJ" + some(alnum, 30) + "." + some(alnum, 40) + "." + some(alnum + "_-", 30),
        lambda: base64.b64encode(rng.randbytes(rng.randint(18, 40))).decode(),
        lambda: some(hexes, rng.randint(18, 64)), lambda: some(hexes.upper(), rng.choice((32, 40, 64))),
        lambda: some(alnum, rng.randint(20, 40)), lambda: word().title() + some(string.digits, 4) + some(alnum, 8),
        # Passwords: a word with digits for letters and signs; letters of both cases; signs of all kinds.
        lambda: "".join(rng.choice((c, {"a": "4", "e": "3", "i": "1", "o": "0", "s": "5"}.get(c, c))) for c in word()).capitalize()
        + rng.choice("!@#$%&*") + some(string.digits, rng.randint(1, 4)),
        lambda: word() + rng.choice("!@#$%&*") + some(alnum, rng.randint(4, 8)), lambda: some(string.ascii_letters, rng.randint(12, 24)),
        lambda: some(alnum + "!@#$%&*", rng.randint(10, 20))]
    # Words without a sign between them are secrets only after a name.
    named = [lambda: "".join(word() for _ in range(rng.randint(3, 5))), lambda: word() + some(string.digits, rng.randint(1, 4)),
             lambda: some(string.ascii_lowercase, rng.randint(8, 16)), lambda: some(string.ascii_uppercase, rng.randint(10, 20))]
    others = [
        lambda: f"{word()}.{word()}.example.com", lambda: f"mail{rng.randint(0, 99)}.{word()}.com",
        lambda: some(string.digits, rng.randint(12, 19)), lambda: ".".join(str(rng.randint(10, 255)) for _ in range(4)),
        lambda: f"{rng.randint(1990, 2030)}-{rng.randint(10, 12)}-{rng.randint(10, 28)}T10",
        lambda: f"{word()}_{word()}_{rng.randint(1, 99)}", lambda: f"{word()}-{word()}-{word()}-{rng.randint(1, 999)}",
        lambda: f"{word()}/{word()}/{word()}{rng.randint(1, 9)}.txt", lambda: f"version-{rng.randint(1, 9)}.{rng.randint(10, 99)}.{rng.randint(0, 9)}",
        lambda: f"{some(string.digits, 3)}-{some(string.digits, 3)}-{some(string.digits, 4)}",
        lambda: word() + word().title() + word().title() + str(rng.randint(1, 99)), lambda: word() + word().title() + word().title(),
        lambda: f"{word()}.{word()}{rng.randint(1, 99)}@{word()}.example.com", lambda: f"{word()}&{word()}", lambda: f"#{word()}{rng.randint(1, 99)}",
        lambda: f"{word()}-{word()}-{word()}", lambda: f"{word()}/{word()}-{word()}", lambda: f"{rng.randint(1, 9)}.{rng.randint(100, 999)}.{rng.randint(100, 999)}",
        lambda: "".join(word() for _ in range(rng.randint(3, 5))), lambda: word() + str(rng.randint(1, 999)), lambda: f"{word().title()}_{word().title()}",
        lambda: f"{rng.randint(10, 23)}:{rng.randint(10, 59)}"[:2] + word() + some(string.digits, 4)]
    names = ["pwd=", "key: ", "passphrase = ", "bearer ", "auth: ", "credential=", "", "", "", ""]
    out = []
    for i in range(first, first + count):
        left, right = contexts[rng.randrange(len(contexts))]
        secret = i % 2 == 0
        weak = secret and rng.random() < 0.15
        value = rng.choice(named if weak else secrets if secret else others)()
        name = rng.choice(names[:6] if weak else names) if secret else rng.choice(["", "", "", "id=", "file: ", "see "])
        out.append(((left + name)[-SIDE:], value, right, int(secret)))
    return out


def _marked(left: str, value: str, right: str, ruled: bool, rng: random.Random) -> list[tuple[str, str, str, int]]:
    """What a candidate of the corpus teaches by itself.

    What a rule found is a secret, letters of one case without a name before them
    are words. No rule is no answer: other candidates only lend their
    surroundings to generated findings.
    """
    if ruled:
        # The value alone, in half of the cases without the name before it.
        own = ASSIGN.search(value)
        value = own[2] if own else value
        bare = re.sub(r"(?i)\w*[\"']?\s*[:=]?\s*[\"']?$", "", left)
        return [(bare if rng.random() < 0.5 else left, value, right, 1)]
    if value.isalpha() and (value[1:].islower() or value.isupper()) and not re.search(r"[:=]\s*[\"']?$", left):
        return [(left, value, right, 0)]
    return []


def labelled(sample: list[tuple[str, str, str, bool]]) -> list[tuple[str, str, str, int]]:
    """Training findings from a few candidates (left, value, right, found by a rule)."""
    rng = random.Random(5)
    out, contexts = [], [("", "")]
    for left, value, right, ruled in sorted(set(sample)):
        if not ruled:
            contexts.append((left, right))
        out += _marked(left, value, right, ruled, rng)
    return out + _generated(contexts, rng)


_SPANS = "array<struct<kind: string, start: int, end: int>>"
_CANDIDATES = "array<struct<start: int, end: int, left: string, value: string, right: string, ruled: boolean>>"


def scanned(docs: DataFrame) -> DataFrame:
    """doc_id, ``base`` spans and ``candidates`` of every text."""
    kinds = [pa.int64(), pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int32()), ("end", pa.int32())])),
             pa.list_(pa.struct([("start", pa.int32()), ("end", pa.int32()), ("left", pa.string()), ("value", pa.string()),
                                 ("right", pa.string()), ("ruled", pa.bool_())]))]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [scan(t.as_py() or "") for t in batch.column("text")]
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id"),
                 pa.array([[dict(zip(("kind", "start", "end"), s)) for s in spans] for spans, _ in found], kinds[1]),
                 pa.array([c for _, c in found], kinds[2])], ["doc_id", "base", "candidates"])

    return docs.select(F.col("doc_id").cast("bigint"), F.col("text").cast("string")).mapInArrow(
        run, f"doc_id bigint, base {_SPANS}, candidates {_CANDIDATES}")


def findings(each: DataFrame, times: int) -> DataFrame:
    """Training findings of all rows of ``each`` (left, value, right, ruled; no value: a context only) as coded ``piece``,
    ``label``, ``held`` and ``finding``, a number that tells pieces of one finding from others.

    Every candidate that no rule covers lends its surroundings to ``times`` generated findings. What a row
    gives is drawn by its own text, so it does not depend on how rows are spread.
    """
    names = ["finding", "piece", "label", "held"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for row in batch.to_pylist():
                left, value, right, ruled = row["left"], row["value"], row["right"], row["ruled"]
                rng = random.Random("\0".join((left, value or "", right)))
                own = _marked(left, value, right, ruled, rng) if value is not None else []
                if not ruled:
                    own += _generated([(left, right)], rng, times, rng.randrange(2))
                for finding in own:
                    number = int.from_bytes(hashlib.md5("\0".join(finding[:3]).encode()).digest()[8:], "big", signed=True)
                    out += [(number, piece.astype(np.uint8).tobytes(), finding[3], _held(*finding[:3])) for piece in _coded(*finding[:3])]
            yield pa.RecordBatch.from_arrays([pa.array([o[i] for o in out], t) for i, t in enumerate(
                (pa.int64(), pa.binary(), pa.int32(), pa.bool_()))], names)

    return each.select("left", "value", "right", "ruled").mapInArrow(run, "finding bigint, piece binary, label int, held boolean")


def _epoch(pieces: DataFrame, weights: dict[str, np.ndarray], epochs: int, seed: int) -> dict[str, np.ndarray]:
    """The mean of the weights that each shard of ``pieces`` reaches from the same start.

    Weights are added as whole numbers of 2^-32, so their order does not matter;
    as many numbers as there are weights reach the driver.
    """
    def run(shard: pd.DataFrame) -> pd.DataFrame:
        shard = shard.sort_values(["finding", "piece", "label"])
        rows = np.frombuffer(b"".join(shard["piece"]), np.uint8).reshape(-1, WIDTH)
        reached = _trained(weights, rows.astype(np.int16), shard["label"].to_numpy(np.float32), epochs, seed)
        flat = np.concatenate([reached[name].ravel() for name in weights]).astype(float)
        return pd.DataFrame({"place": np.arange(len(flat)), "weight": np.round(flat * 2.0 ** 32).astype(np.int64)})

    ends = pieces.groupBy("shard").applyInPandas(run, "place bigint, weight bigint")
    sums = ends.groupBy("place").agg(F.sum(F.col("weight").cast("decimal(20,0)")).alias("total"), F.count(F.lit(1)).alias("n"))
    means = np.array([float(r.total) / 2.0 ** 32 / r.n for r in sorted(sums.collect())])
    cuts = np.cumsum([w.size for w in weights.values()])[:-1]
    return {name: part.reshape(weights[name].shape).astype(np.float32) for name, part in zip(weights, np.split(means, cuts))}


def _held_logits(pieces: DataFrame, net: Network) -> DataFrame:
    """How often each ``step`` of a logit is reached by findings of each ``label``."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = np.frombuffer(b"".join(batch.column("piece").to_pylist()), np.uint8).reshape(-1, WIDTH).astype(np.int16)
            logits = np.concatenate([np.empty(0), *[net.forward(rows[i:i + 512])[0] for i in range(0, len(rows), 512)]])
            yield pa.RecordBatch.from_arrays([batch.column("finding"), batch.column("label"), pa.array(logits, pa.float64())],
                                             ["finding", "label", "logit"])

    each = pieces.select("finding", "piece", "label").mapInArrow(run, "finding bigint, label int, logit double")
    step = F.floor(F.greatest(F.lit(-FARTHEST), F.least(F.lit(FARTHEST), F.max("logit"))) * STEPS).alias("step")
    return each.groupBy("finding", "label").agg(step).groupBy("step", "label").agg(F.count(F.lit(1)).alias("n"))


def fit(found: DataFrame) -> Network:
    """The network from all candidates of ``scanned``: every different one teaches or lends its surroundings, and all held
    findings calibrate, counted by steps of their logits.
    """
    spark = found.sparkSession
    each = materialize(found.select(F.explode("candidates").alias("c")).select("c.left", "c.value", "c.right", "c.ruled").distinct(), "different")
    n = {r.ruled: r["count"] for r in each.groupBy("ruled").count().collect()}
    times = -(-max(GENERATED, FOR_EACH * n.get(True, 0)) // (n.get(False, 0) + 1))
    nowhere = spark.range(1).selectExpr("'' as left", "cast(null as string) as value", "'' as right", "false as ruled")
    # By number: the rows are few bytes, which Spark would put into one task.
    made = n.get(True, 0) + times * (n.get(False, 0) + 1)
    spread = each.unionByName(nowhere).repartition(-(-made // SHARD) + 1, "left", "value", "right")
    pieces = materialize(findings(spread, times), "findings")
    counts = {(r.held, r.label): r["count"] for r in pieces.groupBy("held", "label").count().collect()}
    net = Network.fresh()
    if len(counts) < 4:
        return net
    shards = -(-(counts[False, 0] + counts[False, 1]) // SHARD)
    shard = F.pmod(F.xxhash64("finding"), F.lit(shards))
    taught = pieces.where("not held").select("finding", "piece", "label", shard.alias("shard")).repartition(2 * shards, "shard")
    # A single shard has no mean to wait for.
    for seed in range(11, 11 + (EPOCHS if shards > 1 else 1)):
        net.weights = _epoch(taught, net.weights, 1 if shards > 1 else EPOCHS, seed)
    held = _held_logits(pieces.where("held"), net).orderBy("step", "label").collect()
    logits, marks, often = (np.array([r[c] for r in held], float) for c in ("step", "label", "n"))
    return _calibrate(net, logits / STEPS, marks, often)


def model_spans(found: Column, net: Network) -> Column:
    """Spans of kind ``model``: candidates no rule found that reach the threshold."""
    @F.arrow_udf(_SPANS)
    def spans(lists: pa.Array) -> pa.Array:
        all_ = lists.to_pylist()
        open_ = [(i, c) for i, own in enumerate(all_) for c in own or [] if not c["ruled"]]
        sure = net.probabilities([(c["left"], c["value"], c["right"]) for _, c in open_])
        out: list[list[dict]] = [[] for _ in all_]
        for (i, c), p in zip(open_, sure):
            if p >= net.threshold:
                out[i].append({"kind": "model", "start": c["start"], "end": c["end"]})
        return pa.array(out, pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int32()), ("end", pa.int32())])))

    return spans(found)


def find_secrets(docs: DataFrame) -> DataFrame:
    """doc_id, ``base`` and ``spans`` (kind, start, end; code points, end exclusive) of every document; one row per row.

    Spans are by start, then by kind in the order of ``KINDS``. Null text is
    empty. doc_id is passed on as it is. Only doc_id and text are read. Texts
    are read once; what is scored are the candidates. An empty table gives no
    rows.
    """
    found = materialize(scanned(docs), "candidates")
    rank = F.array(*[F.lit(k) for k in KINDS])
    added = F.concat(F.col("base"), model_spans(F.col("candidates"), fit(found)))
    ordered = F.transform(
        F.array_sort(F.transform(added, lambda s: F.struct(
            s["start"].alias("start"), F.array_position(rank, s["kind"]).alias("rank"), s["end"].alias("end"), s["kind"].alias("kind")))),
        lambda s: F.struct(s["kind"].alias("kind"), s["start"].alias("start"), s["end"].alias("end")))
    return found.select("doc_id", "base", ordered.alias("spans"))


def joined(spans: Column) -> Column:
    """``kind:start:end`` joined by commas."""
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"], s["end"])), ",")


def counted(spans: Column, kind: str) -> Column:
    return F.size(F.filter(spans, lambda s: s["kind"] == kind)).cast("bigint")
