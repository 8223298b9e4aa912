"""The sieve before op8's search: what it holds back has no passage, and it holds most texts back."""

import random

import numpy as np

from tidemark.llm import decontamination
from tidemark.llm.block_sieve import within_one


def syllables(rng, n):
    return " ".join("".join(rng.choice(["th", "er", "on", "an", "re", "he", "in", "ed"]) for _ in range(rng.randrange(1, 5))) for _ in range(n))


def test_most_texts_are_not_searched(monkeypatch):
    """Texts made of the items' own syllables, of which one in fifty quotes an item."""
    rng = random.Random(5)
    index = decontamination.Index(list(range(100)), [syllables(rng, 40)[:220] for _ in range(100)])
    texts = [syllables(rng, 400) for _ in range(100)]
    for k in (10, 60):
        texts[k] += " " + decontamination._words(index.codes[k])
    searched, plain = [], decontamination.Index.regions
    monkeypatch.setattr(decontamination.Index, "regions", lambda self, codes: searched.append(1) or plain(self, codes))
    found = index.found([*texts, texts[10], ""])
    assert [k for k, x in enumerate(found) if x] == [10, 60, 100] and found[10] == found[100]
    assert len(searched) <= 20


def test_nothing_is_lost():
    """Items of all lengths, quoted with about as many edits as they may have, beside other texts or at an end."""
    rng = random.Random(6)
    for trial in range(6):
        items = [syllables(rng, 60)[: rng.randrange(1, 140) if trial % 2 else rng.randrange(66, 300)].strip() for _ in range(60)]
        texts = []
        for _ in range(80):
            quote = list(rng.choice(items))
            for _ in range(decontamination.budget(len(quote)) + rng.randrange(-2, 1)):
                j = rng.randrange(len(quote))
                quote[j : j + rng.randrange(2)] = rng.choice(["", "x", "9", " "])
            texts.append(syllables(rng, rng.choice([0, 3, 50])) + rng.choice(["", " ", " .. "]) + "".join(quote) + syllables(rng, rng.choice([0, 3, 50])))
        index = decontamination.Index(list(range(len(items))), items)
        want = [decontamination.found_in(t, index) for t in texts]
        assert index.found(texts) == want and any(want)


def test_within_one():
    """Against all ways to make one edit."""
    rng = random.Random(7)
    pack = lambda s: np.frombuffer(s.encode().ljust(8, b"\0")[:8], "<u8").astype(np.uint64)

    def near(a, b):
        heads = [a, *(a[:k] + a[k + 1 :] for k in range(6)), *(a[:k] + c + a[k:] for k in range(7) for c in "abz"), *(a[:k] + c + a[k + 1 :] for k in range(6) for c in "abz")]
        return any(b.startswith(h) for h in heads)

    for _ in range(3000):
        a, b = ("".join(rng.choice("ab") for _ in range(n)) for n in (6, 8))
        assert bool(within_one(pack(a), pack(b))[0]) == near(a, b), (a, b)
