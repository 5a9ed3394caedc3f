import json

import numpy as np

from caseloom.llm import word_tokens as wt
from caseloom.llm.queries import WORD_TOKENIZER


def test_words_as_a_whole():
    texts = ["it's <|endoftext|>x Straße, É.", "a<|STARTOFTEXT|> don't 12x3 İstanbul ΑΣ. µm ªº é", "x" * 5000, "",
             "end... what?! (yes) a-b C++ naïve,' x' can't!' ÿµ ẞ K Å é́", "word " * 50 + "Word. WORD.. wörd##"]
    tokens = wt.WordTokens(WORD_TOKENIZER)
    want = [np.array(tokens.tokenizer.encode(t, add_special_tokens=False).ids, "<u4").tobytes() for t in texts]
    assert tokens.ids([t.encode() for t in texts]) == want
    # From memory, too.
    assert tokens.ids([t.encode() for t in texts]) == want


def test_ranks_merge_as_pairs_do():
    """Every token's bytes, merged by ids below its own, come down to the pair that makes it."""
    with open(WORD_TOKENIZER, encoding="utf-8") as file:
        model = json.load(file)["model"]
    ranks = wt.ranks_of(model["vocab"])
    names = {i: token for token, i in model["vocab"].items()}
    data = {names[i]: b for b, i in ranks.items()}
    assert len(ranks) == len(model["vocab"])
    for left, right in (m if isinstance(m, list) else m.split(" ") for m in model["merges"]):
        token = model["vocab"][left + right]
        whole = data[left + right]
        parts = [whole[i:i + 1] for i in range(len(whole))]
        while True:
            found = [(r, i) for i, pair in enumerate(zip(parts, parts[1:])) if (r := ranks.get(b"".join(pair), token)) < token]
            if not found:
                break
            i = min(found)[1]
            parts[i:i + 2] = [parts[i] + parts[i + 1]]
        assert parts == [data[left], data[right]]
