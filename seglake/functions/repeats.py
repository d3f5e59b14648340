"""Repetition in a window of words, as arithmetic on the places where n-grams come back."""

from __future__ import annotations

from collections import Counter
from itertools import pairwise
from math import ceil

import numpy as np


def returns(codes: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
    """Places of all n-grams, ordered by gram and then by place, and which of them continue the gram of the one before."""
    if len(codes) < n:
        return np.zeros(0, dtype=int), np.zeros(0, dtype=bool)
    grams = np.lib.stride_tricks.sliding_window_view(codes, n)
    _, kind = np.unique(grams, axis=0, return_inverse=True)
    kind = kind.ravel()
    places = np.argsort(kind, kind="stable")
    return places, np.concatenate(([False], np.diff(kind[places]) == 0))


def numbered(words: list[str]) -> np.ndarray:
    known: dict[str, int] = {}
    return np.array([known.setdefault(w, len(known)) for w in words], dtype=np.int64)


def clustered(words: list[str], least: int = 4, gap: int = 5, share: float = 0.6) -> bool:
    """A 1- or 2-gram comes back ``least`` times with at most ``gap`` words between, and these are most of its places."""
    def crowded(places: list[int], n: int) -> bool:
        most = size = 1
        for a, b in pairwise(places):
            size = size + 1 if b - a - n <= gap else 1
            most = max(most, size)
        return most >= least and most >= share * len(places)

    at: dict[str, list[int]] = {}
    for i, w in enumerate(words):
        at.setdefault(w, []).append(i)
    for own in at.values():
        if len(own) < least:
            continue
        if crowded(own, 1):
            return True
        pairs: dict[str, list[int]] = {}
        for i in own:
            if i + 1 < len(words):
                pairs.setdefault(words[i + 1], []).append(i)
        if any(len(p) >= least and crowded(p, 2) for p in pairs.values()):
            return True
    return False


def common_ahead(codes: np.ndarray, lag: int) -> np.ndarray:
    """For every place how many words from there on equal those ``lag`` words later."""
    differ = np.flatnonzero(np.append(codes[:-lag] != codes[lag:], True))
    places = np.arange(len(codes) - lag)
    return differ[np.searchsorted(differ, places)] - places


def regrows(words: list[str], block: int = 6, cover: float = 0.7, least: int = 3) -> bool:
    """A phrase restarts ``least`` times in a row, at least ``block`` words apart; every restart repeats most of the way from the
    one before, and at some restart more words are repeated than at the one before."""
    # two restarts in a row begin with the same words, as many as the shortest repeat has, and so does the phrase before them
    shortest = max(1, ceil(cover * block))
    begins = list(zip(*(words[i:] for i in range(shortest))))
    if len(set(begins)) == len(begins) or max(Counter(begins).values()) < max(least, 3):
        return False
    codes = numbered(words)
    reach: dict[int, np.ndarray] = {}
    for n in (2, 1):
        places, same = returns(codes, n)
        if not len(places):
            continue
        lag = np.diff(places, prepend=places[0])
        common = np.zeros(len(places), dtype=int)
        for d in np.unique(lag[same & (lag >= block)]):
            if d not in reach:
                reach[d] = common_ahead(codes, d)
            own = np.flatnonzero(same & (lag == d))
            common[own] = reach[d][places[own] - d]
        again = same & (lag >= block) & (common >= cover * lag)
        chain = np.cumsum(~again)
        length = np.bincount(chain[again], minlength=chain[-1] + 1)
        more = again & np.concatenate(([False], again[:-1])) & (common > np.concatenate(([0], common[:-1])))
        if (more & (length[chain] >= least - 1)).any():
            return True
    return False


def runs(words: list[str], longest: int, shortest: int, least: int, gap: int, share: float) -> list[tuple]:
    """Runs of n-grams: (n, first word, word after the last, repeats, n-gram) in order of place.

    The next of a gram's places, right behind it or after at most ``gap`` words, continues it. A chain of such places is a run if it
    is at least ``least`` long and holds ``share`` of all places of its gram. Long grams choose first, each from left to right, and
    the words of a run are not used again."""
    found = runs_of_texts(numbered(words), np.array([len(words)]), longest, shortest, least, gap, share)
    return [(n, start, end, count, " ".join(words[start:start + n])) for n, start, end, count in found.tolist()]


def runs_of_texts(codes: np.ndarray, sizes: np.ndarray, longest: int, shortest: int, least: int, gap: int, share: float) -> np.ndarray:
    """``runs`` of many texts at once, a row (n, first word, word after the last, repeats) each. The texts stand one behind the
    other in ``codes``, ``sizes`` words each, and places count through all of them. No gram reaches over the end of a text or
    is the same in two texts."""
    total_words = len(codes)
    text = np.repeat(np.arange(len(sizes)), sizes)
    own = np.cumsum(sizes)[text] - np.arange(total_words) if total_words else text  # words from here to the end of the text
    levels, places, gram, wide = [], np.arange(total_words), text, int(codes.max(initial=0)) + 1
    for n in range(1, longest + 1):
        # a gram that comes often enough begins with one that does
        inside = own[places] >= n
        places = places[inside]
        _, gram, total = np.unique(gram[inside] * wide + codes[places + n - 1], return_inverse=True, return_counts=True)
        often = total[gram] >= least
        places, gram = places[often], gram[often]
        levels.append((n, places, gram, total))
    used, found = np.zeros(total_words + 1, dtype=np.int64), []
    for n, places, gram, total in reversed(levels[shortest - 1:]):
        upto = np.cumsum(used)
        free = upto[places + n - 1] == np.where(places > 0, upto[places - 1], 0)
        key = np.sort(gram[free] * (2 * total_words + gap) + places[free])
        gram, places = np.divmod(key, 2 * total_words + gap)
        ahead = np.searchsorted(key, key + n)
        near = ahead < len(key)
        near[near] = key[ahead[near]] <= key[near] + n + gap
        count, last = 1 + near, places + n
        last[near] = places[ahead[near]] + n
        longer = near.copy()
        longer[near] = near[ahead[near]]
        for i in np.flatnonzero(longer)[::-1].tolist():
            count[i], last[i] = count[ahead[i]] + 1, last[ahead[i]]
        good = np.flatnonzero((count >= least) & (count >= share * total[gram]))
        good, end = good[np.argsort(places[good])], 0
        for start, stop, times in zip(places[good].tolist(), last[good].tolist(), count[good].tolist()):
            if start >= end:
                end = stop
                used[start:end] = 1
                found.append((n, start, end, times))
    table = np.array(found, dtype=np.int64).reshape(-1, 4)
    return table[np.argsort(table[:, 1])]
