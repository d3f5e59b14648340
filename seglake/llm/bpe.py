"""BPE encoding and decoding with content-defined chunk reuse.

A rolling hash over the last sixteen bytes cuts texts at places that depend on content only, so documents with common
passages have common chunks. Documents are dealt to tasks by ranges of their least chunk digest: those that share chunks
meet, and a large group of copies is spread over several tasks. A task encodes each chunk once. Cuts fall inside words, so
the joins are repaired: the last piece of one chunk and the first of the next are encoded again together, and further chunks
are taken in until both ends of the fragment agree with the pieces around it."""

from __future__ import annotations

import hashlib
from itertools import pairwise

import numpy as np
import pyarrow as pa
import xxhash
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, BinaryType, IntegerType, LongType, StringType

from .common import append_columns, spans
from .pieces import PieceEncoder

#: A cut falls where so many low bits of the rolling hash are zero: every 512 bytes on average.
CUT_BITS = 9
#: Characters of chunks that a task remembers before it starts anew. Sharing documents come one after another.
MOST_CHARS = 6_000_000
GEAR = np.random.default_rng(2024).integers(0, 1 << 32, 256, dtype=np.uint32)


def cuts(raw: bytes) -> np.ndarray:
    """Byte positions where chunks begin (without 0), never inside a character."""
    if len(raw) < 32:
        return np.zeros(0, dtype=np.int32)
    data = np.frombuffer(raw, dtype=np.uint8)
    rolled = GEAR[data]
    for back in (1, 2, 4, 8):
        rolled[back:] += rolled[:-back] << np.uint32(back)
    mask = np.uint32(((1 << CUT_BITS) - 1) << 7)
    at = np.flatnonzero((rolled & mask) == 0) + 1
    at = at[(at >= 16) & (at < len(raw))]
    return at[(data[at] & 0xC0) != 0x80].astype(np.int32)


def route(docs: DataFrame, text: str = "text") -> DataFrame:
    """Adds _chunks (cut positions), _packed (the text, compressed) and _route (least digest of its chunks)."""

    def kernel():
        squeeze = zstandard.ZstdCompressor(level=1)

        def work(column):
            places, packed, least = [], [], []
            for text in column.to_pylist():
                raw = (text or "").encode("utf-8", "replace")
                at = cuts(raw)
                places.append(at)
                packed.append(squeeze.compress(raw))
                edges = [0, *at.tolist(), len(raw)]
                least.append(min(xxhash.xxh3_64_intdigest(raw[a:b]) for a, b in pairwise(edges)) >> 1)
            return [pa.array(places, pa.list_(pa.int32())), pa.array(packed, pa.binary()), pa.array(least, pa.int64())]

        return work

    return append_columns(docs, [text], [("_chunks", ArrayType(IntegerType())), ("_packed", BinaryType()), ("_route", LongType())], kernel)


class ChunkEncoder:
    """Ids of whole texts put together from chunks that are encoded once."""

    def __init__(self, path: str):
        self.pieces = PieceEncoder(path)
        self.known: dict[str, tuple[str, str, np.ndarray] | None] = {}
        self.chars = self.asked = self.found = 0

    def learn(self, chunks: list[str]) -> None:
        """Encode the chunks not yet known: first and last piece are kept as text, the ids between them as they are. A chunk
        without two blanks has no inner part and is joined as a whole."""
        self.asked += len(chunks)
        new = [c for c in dict.fromkeys(chunks) if c not in self.known]
        self.found += len(chunks) - len(new)
        inner, edges = [], []
        for chunk in new:
            blanks = chunk.replace("\n", " ")
            a, b = blanks.find(" "), blanks.rfind(" ")
            edges.append((chunk[:a], chunk[b + 1:]) if a >= 0 else None)
            inner.append(chunk[a + 1:b] if 0 <= a < b else "")
        ids, bounds = self.pieces.encode(inner)
        for i, chunk in enumerate(new):
            self.chars += len(chunk)
            self.known[chunk] = edges[i] and (*edges[i], ids[bounds[i]:bounds[i + 1]].copy())

    def encode(self, documents: list[list[str]]) -> list[np.ndarray]:
        if self.chars > MOST_CHARS:
            self.known, self.chars = {}, 0
        self.learn([c for chunks in documents for c in chunks])
        layout, joints = [], []
        for chunks in documents:
            parts, open_end = [], ""
            for chunk in chunks:
                known = self.known[chunk]
                if known is None:  # no blank in it: the fragment goes on
                    open_end += chunk
                    continue
                head, tail, ids = known
                parts.append(len(joints))
                joints.append(open_end + head)
                parts.append(ids)
                open_end = tail
            parts.append(len(joints))
            joints.append(open_end)
            layout.append(parts)
        ids, bounds = self.pieces.encode(joints)
        return [np.concatenate([ids[bounds[p]:bounds[p + 1]] if isinstance(p, int) else p for p in parts]) for parts in layout]


class Decoder:
    """Text of ids as the library's decode(ids, skip_special_tokens=False) gives it for a tokenizer without a decoder part."""

    def __init__(self, tokenizer):
        self.tokenizer = tokenizer
        self.plain = tokenizer.decoder is None
        size = tokenizer.get_vocab_size(with_added_tokens=True)
        self.token = [tokenizer.id_to_token(i) or "" for i in range(size)] if self.plain else []

    def decode(self, ids: np.ndarray) -> str:
        if self.plain:
            return " ".join(map(self.token.__getitem__, ids.tolist()))
        return self.tokenizer.decode(ids.tolist(), skip_special_tokens=False)


def encode_decode(docs: DataFrame, path: str, keep: tuple[str, ...] = ("ids", "decoded"), text: str = "text") -> DataFrame:
    """Adds to every row any of ids (array of integers), decoded, n_tokens, ids_sha256 and decoded_sha256.

    ``path`` is a tokenizer file whose pre-tokenizer drops white space; no special token is added, but their strings in a text
    are taken as the library takes them. Null and empty texts have no ids and decode to the empty text. Texts are taken
    whole. Rows come back in another order. A column named like a result is replaced."""
    kinds = {"ids": (ArrayType(IntegerType()), pa.list_(pa.int32())), "decoded": (StringType(), pa.string()), "n_tokens": (LongType(), pa.int64()),
             "ids_sha256": (StringType(), pa.string()), "decoded_sha256": (StringType(), pa.string())}
    wanted = [name for name in kinds if name in keep]
    routed = route(docs, text).drop(text)
    own = F.xxhash64(*[f"`{c}`" for c in routed.columns if c != "_route"])  # parts a group of copies among several tasks
    spread = routed.repartitionByRange("_route", own).sortWithinPartitions("_route")

    def kernel():
        chunks = ChunkEncoder(path)
        decoder = Decoder(chunks.pieces.tokenizer) if {"decoded", "decoded_sha256"} & set(wanted) else None
        expand = zstandard.ZstdDecompressor()

        def work(packed, places):
            packed, places = packed.to_pylist(), places.to_pylist()
            out: dict[str, list] = {name: [] for name in wanted}
            for lo, hi in spans([3 * len(p) for p in packed]):
                documents = []
                for p, at in zip(packed[lo:hi], places[lo:hi]):
                    raw = expand.decompress(p)
                    documents.append([raw[a:b].decode("utf-8") for a, b in pairwise([0, *at, len(raw)])])
                for ids in chunks.encode(documents):
                    told = {"ids": ids, "n_tokens": len(ids)}
                    if "ids_sha256" in wanted:
                        told["ids_sha256"] = hashlib.sha256(ids.astype("<u4").tobytes()).hexdigest()
                    if decoder:
                        told["decoded"] = decoder.decode(ids)
                    if "decoded_sha256" in wanted:
                        told["decoded_sha256"] = hashlib.sha256(told["decoded"].encode("utf-8")).hexdigest()
                    for name in wanted:
                        out[name].append(told[name])
            return [pa.array(out[name], kinds[name][1]) for name in wanted]

        return work

    done = append_columns(spread, ["_packed", "_chunks"], [(name, kinds[name][0]) for name in wanted], kernel)
    return done.drop("_packed", "_chunks", "_route")
