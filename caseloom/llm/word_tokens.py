"""Ids of texts by a byte-pair tokenizer with word ends, word by word.

The tokenizer drops white space and never joins across it, so a text's ids are
those of its words in turn, and frequent words are looked up. Of new words those
of plain letters, with or without marks behind them, are merged together in one
call; any other takes the tokenizer's whole way.

The merging goes by ranks: two neighbours merge if their bytes are a token, the
lowest id first, with a blank for the word end. That equals merging by pairs if
every token's own bytes, merged up to the ids below its own, come down to its
pair; the tests show it for the whole vocabulary.
"""

from __future__ import annotations

import json
import os
import re
from functools import cache
from itertools import accumulate, chain

import numpy as np

# Words whose ids a worker remembers, and the longest it remembers.
MEMORY_WORDS, MEMORY_BYTES = 500_000, 48
# Longer words take the tokenizer's whole way, whose time grows less with their length.
LONG = 256
# Words that normalisation only puts in lower case: one run of letters, then at most one of marks.
_PLAIN = re.compile(r"([a-zß-öø-ÿ]+)([!-&(-/:-@\[-`{-~]*)")
WORD_END = "</w>"


def byte_letters() -> dict[str, int]:
    """Byte by the letter that stands for it: itself if it prints, else the next letter from 256 on."""
    shown = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    hidden = [b for b in range(256) if b not in set(shown)]
    return {chr(b): b for b in shown} | {chr(256 + i): b for i, b in enumerate(hidden)}


def ranks_of(vocabulary: dict[str, int]) -> dict[bytes, int]:
    """Id by the bytes of a token, with a blank for its word end."""
    letters = byte_letters()

    def data(token: str) -> bytes:
        body = token.removesuffix(WORD_END)
        return bytes(letters[c] for c in body) + b" " * (body != token)

    return {data(token): i for token, i in vocabulary.items()}


class WordTokens:
    """One per worker process, by ``word_tokens``: reading the file takes longer than many texts."""

    def __init__(self, path: str) -> None:
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        import tiktoken
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        with open(path, encoding="utf-8") as file:
            ranks = ranks_of(json.load(file)["model"]["vocab"])
        self.merging = tiktoken.Encoding("words", pat_str="[^ ]+ ", mergeable_ranks=ranks, special_tokens={})
        self.ends_word = np.zeros(max(ranks.values()) + 1, bool)
        self.ends_word[[i for data, i in ranks.items() if data.endswith(b" ")]] = True
        self.known: dict[bytes, bytes] = {}

    def _whole(self, word: str) -> bytes:
        return np.array(self.tokenizer.encode(word, add_special_tokens=False).ids, "<u4").tobytes()

    def _learn(self, fresh: list[bytes]) -> None:
        joined = b"\n".join(fresh).decode(errors="replace")
        plain, runs, pieces = [], [], []
        for word, text, lower in zip(fresh, joined.split("\n"), joined.lower().split("\n")):
            found = _PLAIN.fullmatch(lower) if len(text) == len(lower) <= LONG else None
            if found is None:
                self.known[word] = self._whole(text)
                continue
            plain.append(word)
            pieces.append(found[1])
            runs.append(1)
            if found[2]:
                pieces.append(found[2])
                runs[-1] = 2
        if plain:
            ids = np.array(self.merging.encode_ordinary(" ".join([*pieces, ""])), "<u4")
            ends = (np.flatnonzero(self.ends_word[ids]) + 1)[np.cumsum(runs) - 1] * 4
            data, bounds = ids.tobytes(), [0, *ends.tolist()]
            self.known.update(zip(plain, map(data.__getitem__, map(slice, bounds, bounds[1:]))))

    def ids(self, texts: list[bytes]) -> list[bytes]:
        """Ids of each text as little-endian unsigned 32-bit numbers."""
        if len(self.known) > MEMORY_WORDS:
            self.known = {}
        known, split = self.known, [text.split() for text in texts]
        words = list(chain.from_iterable(split))
        found = list(map(known.get, words))
        missing = [i for i, ids in enumerate(found) if ids is None]
        fresh = list({words[i] for i in missing})
        self._learn(fresh)
        for i in missing:
            found[i] = known[words[i]]
        for word in fresh:
            if len(word) > MEMORY_BYTES:
                del known[word]
        ends = [0, *accumulate(map(len, split))]
        return [b"".join(found[start:end]) for start, end in zip(ends, ends[1:])]


@cache
def word_tokens(path: str) -> WordTokens:
    return WordTokens(path)
