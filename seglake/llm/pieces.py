"""Exact token ids of whole texts from a tokenizer of the tokenizers library, with ids of repeated pieces kept.

A blank or a line feed parts a text exactly for the tokenizers used here: their pre-tokenizer drops white space, no
normalisation reaches over it and no special token contains it. Any other white space stays inside a piece and is left to
the library. Every piece is encoded by the library itself."""

from __future__ import annotations

import os
import re
from functools import lru_cache

import numpy as np

#: Pieces that a worker keeps before it starts anew; about 200 bytes each.
MOST_PIECES = 500_000
#: Characters of these pieces, per piece on average.
MEAN_CHARS = 20


class _Index(dict):
    def __init__(self):
        super().__init__()
        self.new: list[str] = []
        self.chars = 0

    def __missing__(self, piece: str) -> int:
        place = self[piece] = len(self)
        self.new.append(piece)
        self.chars += len(piece)
        return place


def load(path: str):
    os.environ["TOKENIZERS_PARALLELISM"] = "false"
    from tokenizers import Tokenizer

    tokenizer = Tokenizer.from_file(path)
    tokenizer.no_truncation()
    tokenizer.no_padding()
    return tokenizer


#: Letters with other marks behind them: the pre-tokenizer parts them, so both halves are looked up.
LETTERS_AND_MARKS = re.compile(r"([^\W\d_]+)([^\w\s'<]+)")
#: Words that the library gets in one text.
TOGETHER = 1000


def plain(text: str) -> bool:
    """No special string, and only characters below 256: lower-casing such a text first changes nothing in its ids."""
    try:
        text.encode("latin-1")
    except UnicodeEncodeError:
        return False
    return "<|" not in text


class PieceEncoder:
    def __init__(self, path: str, most: int = MOST_PIECES):
        self.most = most
        self.tokenizer = load(path)
        suffix = getattr(self.tokenizer.model, "end_of_word_suffix", None)
        #: Which ids end a word; without such ids every piece is encoded alone.
        vocabulary = self.tokenizer.get_vocab(with_added_tokens=False) if suffix else {}
        self.ends = np.zeros(1 + max(vocabulary.values(), default=0), dtype=bool)
        self.ends[[i for token, i in vocabulary.items() if token.endswith(suffix)]] = bool(vocabulary)
        self.lowers = suffix is not None and self._same_lowered()
        self._anew()

    def _same_lowered(self) -> bool:
        sample = "".join(map(chr, range(256)))
        return all(self.tokenizer.normalizer.normalize_str(c) == self.tokenizer.normalizer.normalize_str(c.lower()) for c in sample)

    def _anew(self) -> None:
        self.index = _Index()
        self.flat = np.zeros(1 << 16, dtype=np.uint32)
        self.used = 0
        self.starts = np.zeros(1 << 16, dtype=np.int64)
        self.sizes = np.zeros(1 << 16, dtype=np.int64)

    def _gather(self, places: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Ids of the pieces at ``places`` in a row, and where each piece's ids begin (one more entry)."""
        sizes = self.sizes[places]
        bounds = np.concatenate(([0], np.cumsum(sizes)))
        return self.flat[np.repeat(self.starts[places] - bounds[:-1], sizes) + np.arange(bounds[-1])], bounds

    def _keep(self, pieces: list[str], ids: np.ndarray, sizes: np.ndarray) -> None:
        places = np.fromiter(map(self.index.__getitem__, pieces), dtype=np.int64, count=len(pieces))
        while len(self.flat) < self.used + len(ids):
            self.flat = np.concatenate((self.flat, np.zeros_like(self.flat)))
        self.flat[self.used:self.used + len(ids)] = ids
        self.sizes[places] = sizes
        self.starts[places] = self.used + np.cumsum(sizes) - sizes
        self.used += len(ids)

    def _encoded(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        lists = [e.ids for e in self.tokenizer.encode_batch_fast(texts, add_special_tokens=False)]
        sizes = np.fromiter(map(len, lists), dtype=np.int64, count=len(lists))
        return np.fromiter((i for own in lists for i in own), dtype=np.uint32, count=int(sizes.sum())), sizes

    def _learn(self) -> None:
        """The library encodes plain words many at a time, parted again after the ids that end a word; anything else alone."""
        words, others, halves = [], [], []
        new = self.index.new
        for piece in new:  # grows while halves are asked for
            if self.lowers and plain(piece) and piece == piece.lower():
                if piece.isalpha():
                    words.append(piece)
                    continue
                both = LETTERS_AND_MARKS.fullmatch(piece)
                if both and len(piece) < 64:
                    self.index[both[1]], self.index[both[2]]
                    halves.append((piece, both[1], both[2]))
                    continue
            others.append(piece)
        while len(self.starts) < len(self.index):
            self.starts, self.sizes = (np.concatenate((x, np.zeros_like(x))) for x in (self.starts, self.sizes))
        groups = [words[i:i + TOGETHER] for i in range(0, len(words), TOGETHER)]
        ids, sizes = self._encoded([" ".join(g) for g in groups])
        for group, end, size in zip(groups, np.cumsum(sizes), sizes):
            own = ids[end - size:end]
            last = np.flatnonzero(self.ends[np.minimum(own, len(self.ends) - 1)])
            if len(last) == len(group):
                self._keep(group, own, np.diff(last, prepend=-1))
            else:
                others += group
        if others:
            self._keep(others, *self._encoded(others))
        if halves:
            places = np.fromiter((self.index[h] for _, *both in halves for h in both), dtype=np.int64, count=2 * len(halves))
            ids, bounds = self._gather(places)
            self._keep([p for p, _, _ in halves], ids, np.diff(bounds[::2]))
        self.index.new = []

    def encode(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """All ids in a row, and where each text's ids begin (one more entry than texts)."""
        if len(self.index) > self.most or self.index.chars > self.most * MEAN_CHARS:
            self._anew()
        parts = [(t.lower() if self.lowers and plain(t) else t).replace("\n", " ").split(" ") for t in texts]
        counts = np.fromiter(map(len, parts), dtype=np.int64, count=len(parts))
        get = self.index.__getitem__
        places = np.fromiter((get(p) for part in parts for p in part), dtype=np.int64, count=int(counts.sum()))
        if self.index.new:
            self._learn()
        ids, bounds = self._gather(places)
        return ids, bounds[np.concatenate(([0], np.cumsum(counts)))]


@lru_cache(maxsize=2)
def encoder(path: str, most: int = MOST_PIECES) -> PieceEncoder:
    """Kept by a worker from task to task."""
    return PieceEncoder(path, most)
