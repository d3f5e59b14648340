"""Token counts of byte-level byte-pair encoding without any identifier.

A pretoken starts as one symbol per byte in a doubly linked list. A heap gives the adjacent pair of the lowest rank, the
leftmost first; stale entries are passed over. Each merge takes one symbol away, so the count is symbols less merges."""

from __future__ import annotations

import json
from functools import lru_cache
from heapq import heapify, heappop, heappush

import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql.types import BooleanType, LongType

from .common import append_columns

#: Splits text into pretokens; the published pattern of byte-level encodings of this kind.
PRETOKENS = regex.compile(r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+")
LIMIT = 512
#: Counts, and characters of their pieces, that a worker keeps before it starts anew. Longer pieces are not kept.
MOST_PIECES, LONG_PIECE = 700_000, 200


def byte_letters() -> list[str]:
    """The letter that stands for each byte in vocabulary files: printable bytes for themselves, others from 256 on."""
    plain = {*range(33, 127), *range(161, 173), *range(174, 256)}
    others = iter(range(256, 512))
    return [chr(b) if b in plain else chr(next(others)) for b in range(256)]


class MergeCounter:
    def __init__(self, path: str):
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        step = spec.get("pre_tokenizer") or {}
        if spec["model"]["type"] != "BPE" or step.get("type") != "ByteLevel" or not step.get("use_regex") or step.get("add_prefix_space") or spec.get("normalizer"):
            raise ValueError("only byte-level files without normaliser and prefix blank are counted")
        vocabulary = spec["model"]["vocab"]
        pairs = [m.split(" ") if isinstance(m, str) else m for m in spec["model"]["merges"]]
        #: (left, right) -> (rank, merged)
        self.rank = {(vocabulary[a], vocabulary[b]): (i, vocabulary[a + b]) for i, (a, b) in enumerate(pairs)}
        self.letter = [vocabulary[c] for c in byte_letters()]
        added = spec.get("added_tokens") or []
        if any(t["lstrip"] or t["rstrip"] or t["single_word"] or t["normalized"] for t in added):
            raise ValueError("added tokens with conditions are not counted")
        strings = sorted((t["content"] for t in added), key=len, reverse=True)
        self.special = regex.compile("|".join(map(regex.escape, strings))) if strings else None
        self.bare, self.led = _Counts(self, ""), _Counts(self, " ")

    def merged_length(self, raw: bytes) -> int:
        """Number of tokens of one pretoken."""
        n = len(raw)
        if n < 2:
            return n
        symbol = [self.letter[b] for b in raw]
        after, before = list(range(1, n + 1)), list(range(-1, n - 1))
        rank = self.rank
        heap = []
        for i in range(n - 1):
            found = rank.get((symbol[i], symbol[i + 1]))
            if found:
                heap.append((found[0], i, symbol[i], symbol[i + 1], found[1]))
        heapify(heap)
        left = n
        while heap:
            _, i, a, b, made = heappop(heap)
            j = after[i]
            if symbol[i] != a or j >= n or symbol[j] != b:
                continue
            symbol[i], symbol[j] = made, -1
            k = after[i] = after[j]
            left -= 1
            if k < n:
                before[k] = i
                found = rank.get((made, symbol[k]))
                if found:
                    heappush(heap, (found[0], i, made, symbol[k], found[1]))
            h = before[i]
            if h >= 0:
                found = rank.get((symbol[h], made))
                if found:
                    heappush(heap, (found[0], h, symbol[h], made, found[1]))
        return left

    def pieces(self, text: str) -> int:
        return sum(self.merged_length(t.encode("utf-8", "replace")) for t in PRETOKENS.findall(text))

    def plain(self, text: str) -> int:
        """Tokens of text without special strings. Where words are parted by single blanks and line feeds only, a pretoken
        begins at each of them, so counts of words with their blank add up."""
        words = text.split()
        if words != text.replace("\n", " ").split(" "):
            return self.pieces(text)
        lines = text.split("\n")
        total, led = len(lines) - 1, self.led.__getitem__
        for line in lines:
            first, *rest = line.split(" ")
            total += self.bare[first] + sum(map(led, rest))
        return total

    def count(self, text: str | None) -> int:
        if not text:
            return 0
        if len(self.bare) + len(self.led) > MOST_PIECES:
            self.bare.clear()
            self.led.clear()
        if self.special is None or not self.special.search(text):
            return self.plain(text)
        rest = self.special.split(text)
        return len(rest) - 1 + sum(self.plain(t) for t in rest if t)


class _Counts(dict):
    """Counts of words behind ``lead``, computed once."""

    def __init__(self, counter: MergeCounter, lead: str):
        super().__init__()
        self.counter, self.lead = counter, lead

    def __missing__(self, word: str) -> int:
        n = self.counter.pieces(self.lead + word)
        if len(word) < LONG_PIECE:
            self[word] = n
        return n


@lru_cache(maxsize=2)
def counter(path: str) -> MergeCounter:
    """Kept by a worker from task to task."""
    return MergeCounter(path)


def with_token_counts(docs: DataFrame, path: str, text: str = "text", limit: int = LIMIT) -> DataFrame:
    """Adds n_bytes (UTF-8), n_tokens and over_limit (more than ``limit`` tokens) to every row; null texts count as empty.

    Special strings inside a text count as one token each, as the library takes them by default. Texts are counted whole.
    A column named like a result is replaced, others stay."""

    def kernel():
        own = counter(path)

        def work(column):
            texts = column.to_pylist()
            counts = [own.count(t) for t in texts]
            sizes = [len(t.encode("utf-8", "replace")) if t else 0 for t in texts]
            return [pa.array(sizes, pa.int64()), pa.array(counts, pa.int64()), pa.array([n > limit for n in counts], pa.bool_())]

        return work

    return append_columns(docs, [text], [("n_bytes", LongType()), ("n_tokens", LongType()), ("over_limit", BooleanType())], kernel)
