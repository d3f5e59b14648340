"""Brute-force versions of the operators, straight from their contracts."""

import hashlib
import re

import numpy as np
import xxhash

WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
SAMPLE = "/root/testdata/sf0.001"


def lowered(text):
    return re.sub("[A-Z]", lambda m: m[0].lower(), text or "")


def fingerprint(text):
    words = [w for w in re.split("[\x20\x09-\x0d]+", lowered(text)) if w]
    if not words:
        return 0
    shingles = [" ".join(words[i:i + 4]) for i in range(max(1, len(words) - 3))]
    hashes = [xxhash.xxh64_intdigest(s.encode(), 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def components(prints, distance=4):
    """Least index that can be reached from each index."""
    root = list(range(len(prints)))

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for i, a in enumerate(prints):
        for j in range(i + 1, len(prints)):
            if (a ^ prints[j]).bit_count() <= distance:
                x, y = sorted((find(i), find(j)))
                root[y] = x
    return [find(i) for i in range(len(prints))]


def windows(items, size=10):
    found = {}
    for item, text in items:
        words = WORD.findall(lowered(text))
        n = min(size, len(words))
        for i in range(len(words) - n + 1 if n else 0):
            found.setdefault(tuple(words[i:i + n]), set()).add(str(item))
    return found


def hits(text, found):
    words = WORD.findall(lowered(text))
    hit, items = set(), set()
    for n in {len(w) for w in found}:
        for i in range(len(words) - n + 1):
            own = found.get(tuple(words[i:i + n]))
            if own:
                hit.update(range(i, i + n))
                items |= own
    return len(words), hit, items


def ids_sha256(ids):
    return hashlib.sha256(np.array(ids, dtype="<u4").tobytes()).hexdigest()
