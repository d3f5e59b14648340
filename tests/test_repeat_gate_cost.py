"""The gate's judgement costs what the repeats in a window cost, and is the same."""

import random
from itertools import product

from seglake.functions import repeats as RP


def crowded(words, least=4, gap=5, share=0.6):
    for n in (1, 2):
        grams = [tuple(words[i:i + n]) for i in range(len(words) - n + 1)]
        for gram in set(grams):
            places = [i for i, g in enumerate(grams) if g == gram]
            for a, b in product(range(len(places)), repeat=2):
                own = places[a:b + 1]
                if len(own) >= max(least, share * len(places)) and all(y - x - n <= gap for x, y in zip(own, own[1:])):
                    return True
    return False


def test_clustered_as_stated():
    r = random.Random(8)
    said = [[r.choice("abcdefgh"[:k]) for _ in range(n)] for k in (1, 2, 5, 8) for n in (0, 1, 3, 4, 12, 40) for _ in range(20)]
    assert [RP.clustered(w) for w in said] == [crowded(w) for w in said]


def test_windows_without_restarts_are_not_searched(monkeypatch):
    """Words come back, but no five of them three times."""
    def numbered(words):
        raise AssertionError("searched")

    monkeypatch.setattr(RP, "numbered", numbered)
    assert not RP.regrows([f"w{i * i % 41}" for i in range(80)]) and not RP.regrows([f"w{i}" for i in range(40)] * 2)
    assert not RP.clustered([f"w{i}" for i in range(40)])
