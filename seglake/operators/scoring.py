"""Word alignment and the scores built on it.

``align`` turns reference / hypothesis pairs into one row per edit operation.
All other scores are joins and rollups of that table."""

from __future__ import annotations

from bisect import bisect_left
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions import text as X
from ..functions.ordered import rows_block, running_sum, scan, shared

MATCH, SUB, DEL, INS = 0, 1, 2, 3
NAMES = np.array(["match", "sub", "del", "ins"], dtype=object)
STRIP = 256
#: Bits of place masks a pair may keep; masks beyond are made again when their word returns.
MASK_BITS = 1 << 28


def edit_path(ref: np.ndarray, hyp: np.ndarray) -> np.ndarray:
    """Operations of the cheapest path; among equal paths the diagonal wins, then
    a deletion, then an insertion. A row of the cost table is held as its differences, one bit per heard word in whole numbers,
    so a row costs a few operations on them. Beyond CELLS, rows are kept every STRIP rows and rebuilt on the way back."""
    n, m = len(ref), len(hyp)
    words, heard = ref.tolist(), hyp.tolist()
    full = (1 << m) - 1
    places: dict[int, list[int]] = {}
    for j, w in enumerate(heard):
        places.setdefault(w, []).append(j)
    masks: dict[int, int] = {}
    most = max(1024, MASK_BITS // (m + 1))

    def where(w: int) -> int:
        if w not in places:
            return 0
        if w not in masks:
            if len(masks) >= most:
                masks.clear()
            marks = bytearray(m // 8 + 1)
            for j in places[w]:
                marks[j >> 3] |= 1 << (j & 7)
            masks[w] = int.from_bytes(marks, "little")
        return masks[w]

    def rows(up: int, down: int, some: list[int], out: list[tuple[int, int]] | None) -> tuple[int, int]:
        """The differences after the rows of the words ``some``, from those before: where the cost goes up and down along the
        heard words. ``out`` takes per row where the diagonal is free, and where the cost is one more than above."""
        for w in some:
            equal = masks.get(w)
            if equal is None:
                equal = where(w)
            free = ((((equal & up) + up) ^ up) | equal | down) & full
            more = down | (full ^ (free | up))
            left = ((more << 1) | 1) & full
            up, down = (((up & free) << 1) & full) | (full ^ (free | left)), left & free
            if out is not None:
                out.append((free, more))
        return up, down

    strip = max(n, 1) if n * m <= CELLS else STRIP
    kept = [(full, 0)]
    for top in range(0, (n - 1) // strip * strip, strip):
        kept.append(rows(*kept[-1], words[top:top + strip], None))
    ops, i, j = [], n, m
    while i > 0:
        top = (i - 1) // strip * strip
        seen: list[tuple[int, int]] = []
        rows(*kept[top // strip], words[top:i], seen)
        while i > top:
            free, more = seen[i - top - 1]
            if j > 0 and words[i - 1] == heard[j - 1]:
                ops.append(MATCH)
                i, j = i - 1, j - 1
            elif j > 0 and not free >> (j - 1) & 1:
                ops.append(SUB)
                i, j = i - 1, j - 1
            elif j == 0 or more >> (j - 1) & 1:
                ops.append(DEL)
                i -= 1
            else:
                ops.append(INS)
                j -= 1
    ops.extend([INS] * j)
    return np.array(ops[::-1], dtype=np.int8)


#: A pair with more cells than this in its cost table is cut where the cheapest paths are known to pass.
CELLS = 1 << 28
#: Words of the longest n-grams that count as evidence.
LONGEST = 3


def numbered(r, h) -> tuple[np.ndarray, np.ndarray]:
    code: dict[str, int] = {}
    return tuple(np.array([code.setdefault(w, len(code)) for w in words], dtype=np.int64) for words in (r, h))


def _grams(a: np.ndarray, b: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]]:
    """For n = 1 to LONGEST the n-grams of both texts as numbers, and how often each number occurs in them."""
    x, y = a, b
    for n in range(1, LONGEST + 1):
        if n > 1:
            x, y = x[:-1] * (len(a) + len(b)) + a[n - 1:], y[:-1] * (len(a) + len(b)) + b[n - 1:]
        if not len(x) or not len(y):
            return
        _, both = np.unique(np.concatenate((x, y)), return_inverse=True)
        x, y = both[:len(x)], both[len(x):]
        yield x, y, np.bincount(x, minlength=both.max() + 1), np.bincount(y, minlength=both.max() + 1)


def _increasing(values: np.ndarray) -> list[int]:
    """Indexes of a longest increasing subsequence."""
    ends: list[int] = []
    at: list[int] = []
    before = []
    for i, v in enumerate(values.tolist()):
        k = bisect_left(ends, v)
        ends[k:k + 1], at[k:k + 1] = [v], [i]
        before.append(at[k - 1] if k else -1)
    out, i = [], at[-1] if at else -1
    while i >= 0:
        out.append(i)
        i = before[i]
    return out[::-1]


def _stretches(a: np.ndarray, b: np.ndarray, x: np.ndarray, y: np.ndarray, in_a: np.ndarray, in_b: np.ndarray) -> list[list[int]]:
    """Equal stretches (place in a, place in b, words) in order, grown around n-grams that occur once in both texts."""
    place = np.zeros(len(in_b), dtype=np.int64)
    place[y] = np.arange(len(y))
    once = np.flatnonzero((in_a[x] == 1) & (in_b[x] == 1))
    out: list[list[int]] = []
    end_a = end_b = 0
    for k in _increasing(place[x[once]]):
        i, j = int(once[k]), int(place[x[once[k]]])
        if i < end_a or j < end_b:
            continue
        while i > end_a and j > end_b and a[i - 1] == b[j - 1]:
            i, j = i - 1, j - 1
        most = min(len(a) - i, len(b) - j)
        n = 1
        while n < most and a[i + n] == b[j + n]:
            n += 1
        out.append([i, j, n])
        end_a, end_b = i + n, j + n
    return out


def sure_cuts(a: np.ndarray, b: np.ndarray) -> list[tuple[int, int]]:
    """Points (words of ``a``, words of ``b``) through which every cheapest path passes.

    A unit is an n-gram that occurs once in ``b``: a path that does not match it in place pays at least one. Between two equal
    stretches the cheapest path pays no more than the longer sides of the gaps. So a path that leaves out the first units of a
    stretch, or the last, loses as soon as they are more than the gap beside them; it meets both ends of the stretch and
    therefore follows it in between, where the cut is made. Stretches with too few units are no evidence."""
    grams = list(_grams(a, b))
    if not grams:
        return []
    runs = _stretches(a, b, *grams[-1])
    units: list[list[int]] = []  # per stretch the places after its units
    for i, j, n in runs:
        ends, k = [], 0
        while k < n:
            size = next((g + 1 for g, (_, y, _, in_b) in enumerate(grams) if k + g < n and in_b[y[j + k]] == 1), 0)
            k += max(size, 1)
            if size:
                ends.append(k)
        units.append(ends)
    before, after = list(range(-1, len(runs) - 1)), list(range(1, len(runs) + 1))

    borders = [(0, 0), *((i + n, j + n) for i, j, n in runs)]
    heads = [*((i, j) for i, j, _ in runs), (len(a), len(b))]
    upto = np.cumsum([0, *(max(k - i, m - j) for (i, j), (k, m) in zip(borders, heads))]).tolist()

    def gap(p: int, q: int) -> int:
        """At most so much is paid between stretches ``p`` and ``q``: what lies between is matched, or passed over."""
        return upto[q + 1] - upto[p + 1]

    alive, todo = [True] * len(runs), list(range(len(runs)))
    while todo:
        k = todo.pop()
        if not alive[k]:
            continue
        p, q = before[k], after[k]
        if len(units[k]) < gap(p, k) + gap(k, q) + 2:
            alive[k] = False
            if p >= 0:
                after[p] = q
                todo.append(p)
            if q < len(runs):
                before[q] = p
                todo.append(q)
    cuts = []
    for k, (i, j, _) in enumerate(runs):
        if alive[k]:
            low, high = gap(before[k], k) + 1, len(units[k]) - gap(k, after[k]) - 1
            place = units[k][(low + high) // 2 - 1]
            cuts.append((i + place, j + place))
    return cuts


#: Most 64-bit numbers of a pair that is aligned beside others; a longer one alone is no slower.
GROUP_NUMBERS = 16
#: Bytes of the operations of a group of pairs that are aligned side by side, the most 64-bit numbers in a row of the group, and
#: the fewest pairs for which a group is worth it.
GROUP_BYTES, GROUP_WIDTH, GROUP_PAIRS = 48 << 20, 2048, 12


def _side_by_side(pairs: list[tuple[np.ndarray, np.ndarray]], width: int) -> list[np.ndarray]:
    """``edit_path`` of many pairs of about one size. A row of the cost tables of all pairs is one array, with 64 heard words in a
    number and ``width`` numbers per pair; two bits per cell keep the operation that leads into it."""
    lanes, top = len(pairs), max(len(r) for r, _ in pairs)
    one, last = np.uint64(1), np.uint64(63)
    kinds = 1 + max(int(max(r.max(), h.max())) for r, h in pairs)
    heard = np.concatenate([h + b * kinds for b, (_, h) in enumerate(pairs)])
    known, own = np.unique(heard, return_inverse=True)
    place = np.concatenate([np.arange(len(h)) for _, h in pairs])
    masks = np.zeros((len(known) + 1, width), dtype=np.uint64)
    order = np.argsort(place & 63, kind="stable")
    for at in np.split(order, np.searchsorted(place[order] & 63, np.arange(1, 64))):
        if len(at):  # no two of these share a number of the masks
            masks[own[at], place[at] >> 6] |= one << np.uint64(place[at[0]] & 63)
    wanted = np.full((top, lanes), len(known), dtype=np.int64)
    for b, (r, _) in enumerate(pairs):
        key = r + b * kinds
        spot = np.minimum(np.searchsorted(known, key), len(known) - 1)
        wanted[:len(r), b] = np.where(known[spot] == key, spot, len(known))
    high, low = (np.empty((top, lanes, width), dtype=np.uint64) for _ in range(2))
    full, spots = ~np.uint64(0), np.arange(2, 2 * width + 2, 2, dtype=np.int16)
    up, down = np.full((lanes, width), full), np.zeros((lanes, width), dtype=np.uint64)
    for i in range(top):
        equal = masks[wanted[i]]
        total = (equal & up) + up
        if width > 1:  # a number of ones only hands on the carry of the last number before it that has other bits
            carry = np.maximum.accumulate((spots + (total < up)) * (total != full), axis=1)
            total[:, 1:] += (carry[:, :-1] & 1).astype(np.uint64)
        free = (total ^ up) | equal | down
        more = down | ~(free | up)
        left = more << one
        left[:, 1:] |= more[:, :-1] >> last
        left[:, 0] |= one
        np.bitwise_and(free, ~equal, out=high[i])
        np.bitwise_or(high[i] & ~more, ~free, out=low[i])
        kept = up & free
        up = kept << one
        up[:, 1:] |= kept[:, :-1] >> last
        up |= ~(free | left)
        down = left & free
    high, low = high.ravel(), low.ravel()
    i, j = (np.array([len(x[side]) for x in pairs], dtype=np.int64) for side in (0, 1))
    alive, base = np.arange(lanes), np.arange(lanes) * width
    ends = np.zeros((3, lanes), dtype=np.int64)
    out = np.empty((int((i + j).max()), lanes), dtype=np.int8)
    step = 0
    while len(alive):
        at, bit = (i - 1) * (lanes * width) + base + ((j - 1) >> 6), ((j - 1) & 63).astype(np.uint64)
        op = (((high[at] >> bit) & one) << one | ((low[at] >> bit) & one)).astype(np.int8)
        out[step, alive] = op
        step += 1
        i, j = i - (op != INS), j - (op != DEL)
        going = (i > 0) & (j > 0)
        if not going.all():
            done = ~going
            ends[:2, alive[done]] = i[done], j[done]
            ends[2, alive[done]] = step
            i, j, alive, base = i[going], j[going], alive[going], base[going]
    paths = []
    for b, (rest_r, rest_h, steps) in enumerate(ends.T.tolist()):
        paths.append(np.concatenate((np.full(rest_r, DEL, dtype=np.int8), np.full(rest_h, INS, dtype=np.int8), out[:steps, b][::-1])))
    return paths


def edit_paths(pairs: list[tuple[np.ndarray, np.ndarray]]) -> list[np.ndarray]:
    """``edit_path`` of every pair of numbered words. Pairs of like size are aligned side by side; long, empty and odd ones alone."""
    paths: list[np.ndarray | None] = [None] * len(pairs)
    width = [-(-len(h) // 64) for _, h in pairs]
    fit = [k for k, (r, h) in enumerate(pairs) if len(r) and len(h) and width[k] <= GROUP_NUMBERS and len(r) * width[k] * 16 * GROUP_PAIRS <= GROUP_BYTES]
    fit.sort(key=lambda k: (width[k], len(pairs[k][0])))
    at = 0
    while at < len(fit):
        end, top = at, 0
        while end < len(fit):
            longest, lanes = max(top, len(pairs[fit[end]][0])), (end + 1 - at) * width[fit[end]]
            if lanes > GROUP_WIDTH or longest * lanes * 16 > GROUP_BYTES:
                break
            end, top = end + 1, longest
        group, at = fit[at:max(end, at + 1)], max(end, at + 1)
        if len(group) >= GROUP_PAIRS:
            for k, path in zip(group, _side_by_side([pairs[k] for k in group], width[group[-1]])):
                paths[k] = path
    return [edit_path(*pairs[k]) if path is None else path for k, path in enumerate(paths)]


#: Words of the pairs that a task numbers and aligns at once.
SLICE_WORDS = 1 << 20


def _words(column: pa.Array) -> pa.Array:
    """Lists of words; a text is its words with one blank between them, and an empty one has none."""
    if pa.types.is_list(column.type):
        return column
    return pc.split_pattern(pc.if_else(pc.equal(column, ""), pa.scalar(None, column.type), column), " ")


def _sliced(batch: pa.RecordBatch) -> Iterator[tuple[pa.RecordBatch, pa.Array, pa.Array, list[np.ndarray]]]:
    """Parts of a batch of pairs (_r, _h) with about SLICE_WORDS words: the part, all its words of both sides, and its paths.
    Words are numbered as a column and become no Python objects."""
    for c in ("_r", "_h"):
        batch = batch.set_column(batch.schema.get_field_index(c), c, _words(batch.column(c)))
    count = lambda own, c: pc.list_value_length(own.column(c)).fill_null(0).to_numpy(zero_copy_only=False)
    size = sum(count(batch, c) for c in ("_r", "_h"))
    part = np.cumsum(size) // SLICE_WORDS
    for at in np.flatnonzero(np.diff(part, prepend=-1)).tolist():
        own = batch.slice(at, int(np.searchsorted(part, part[at], side="right")) - at)
        ref, hyp = own.column("_r").flatten(), own.column("_h").flatten()
        code = pa.concat_arrays([ref, hyp]).dictionary_encode().indices.fill_null(-1).to_numpy(zero_copy_only=False).astype(np.int64) + 1
        ends = np.cumsum(np.concatenate([count(own, c) for c in ("_r", "_h")]))
        texts = np.split(code, ends[:-1])
        yield own, ref, hyp, edit_paths(list(zip(texts[:own.num_rows], texts[own.num_rows:])))


#: Rows of a frame that a task hands back at once.
FRAME_ROWS = 65_536


def _framed(rows: Iterator[dict]) -> Iterator[pd.DataFrame]:
    """Frames of about FRAME_ROWS rows from columns of one pair after the other; a scalar stands for a whole column."""
    held: list[dict] = []
    size = 0

    def frame() -> pd.DataFrame:
        return pd.DataFrame({c: np.concatenate([h[c] if isinstance(h[c], np.ndarray) else np.full(len(h["op_no"]), h[c], dtype=object) for h in held]) for c in held[0]})

    for one in rows:
        held.append(one)
        size += len(one["op_no"])
        if size >= FRAME_ROWS:
            yield frame()
            held, size = [], 0
    if held:
        yield frame()


def _kinds(df: DataFrame, keys: list[str]) -> str:
    return ", ".join(f"{k} {df.schema[k].dataType.simpleString()}" for k in keys)


#: Least tasks per slot of the cluster: pairs are few bytes and much work, so their partitions are not put together by size.
PARTS_PER_SLOT = 6


def _split(pairs: DataFrame, keys: list[str], ref: str, hyp: str, cells: int, *more: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Pairs that are aligned whole with the columns ``more``, the pieces of the others that can be aligned alone: keys, part, r0 and
    h0 (words before the piece), _r, _h; and these others with ``more``. All come from one shuffle of the pairs, in which texts stay
    texts."""
    text = pairs.schema[ref].dataType == T.StringType()
    none = F.lit("") if text else F.array().cast("array<string>")
    texts = pairs.select(*keys, F.coalesce(F.col(ref), none).alias("_r"), F.coalesce(F.col(hyp), none).alias("_h"), *more)
    src = shared(texts, *keys, parts=PARTS_PER_SLOT * texts.sparkSession.sparkContext.defaultParallelism)
    count = lambda c: (F.when(F.col(c) == "", 0).otherwise(F.length(c) - F.length(F.replace(F.col(c), F.lit(" "), F.lit(""))) + 1) if text else F.size(c)).cast("long")
    large = count("_r") * count("_h") > cells
    zero = F.lit(0).cast("long")
    whole = src.where(~large).select(*keys, zero.alias("part"), zero.alias("r0"), zero.alias("h0"), "_r", "_h", *more)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            for key, r, h in zip(pdf[keys].itertuples(index=False, name=None), pdf["_r"], pdf["_h"]):
                if text:
                    r, h = (np.array(x.split(" ") if x else [], dtype=object) for x in (r, h))
                points = [(0, 0)]
                for i, j in sure_cuts(*numbered(r, h)):
                    if (i - points[-1][0]) * (j - points[-1][1]) * 4 > cells:
                        points.append((i, j))
                points.append((len(r), len(h)))
                rows = [(*key, n, i, j, r[i:k], h[j:m]) for n, ((i, j), (k, m)) in enumerate(zip(points, points[1:]))]
                yield pd.DataFrame(rows, columns=[*keys, "part", "r0", "h0", "_r", "_h"])

    schema = f"{_kinds(pairs, keys)}, part long, r0 long, h0 long, _r array<string>, _h array<string>"
    others = src.where(large)
    return whole, shared(others.select(*keys, "_r", "_h").mapInPandas(run, schema), *keys, "part"), others


def _parts(pairs: DataFrame, keys: list[str], ref: str, hyp: str, cells: int) -> tuple[DataFrame, DataFrame]:
    return _split(pairs, keys, ref, hyp, cells)[:2]


def _keys(key: str | list[str]) -> list[str]:
    return [key] if isinstance(key, str) else list(key)


#: The columns of an operation, and the words among them.
PLACES, WORDS = ("ref_idx", "hyp_idx", "ref_pos", "hyp_pos"), ("ref_word", "hyp_word")


class Operations:
    """The operations of many pairs as columns, one pair after the other: ``op``, the pair of each as ``row``, whether it takes a
    word (``ref``, ``hyp``), the words of the pair taken so far (``ref_pos``, ``hyp_pos``) and those of earlier pairs (``ref0``, ``hyp0``)."""

    def __init__(self, paths: list[np.ndarray]):
        size = np.array([len(p) for p in paths], dtype=np.int64)
        self.op = np.concatenate(paths) if len(paths) else np.zeros(0, dtype=np.int8)
        self.first = np.cumsum(size) - size
        self.row = np.repeat(np.arange(len(paths)), size)
        self.ref, self.hyp = self.op != INS, self.op != DEL
        self.ref0, self.ref_pos = self._upto(self.ref)
        self.hyp0, self.hyp_pos = self._upto(self.hyp)

    def _upto(self, taken: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        upto = np.concatenate(([0], np.cumsum(taken)))
        before = upto[self.first]
        return before, upto[1:] - before[self.row]

    def of_words(self, side: str, values: np.ndarray) -> np.ndarray:
        """Per operation the value of the word that it takes, 0 if none. ``values`` has one number per word of all pairs."""
        taken = self.ref if side == "ref" else self.hyp
        out = np.zeros(len(self.op), dtype=values.dtype)
        out[taken] = values
        return out


def align(pairs: DataFrame, key: str | list[str], ref: str, hyp: str, cells: int = CELLS, words: bool = True) -> DataFrame:
    """(key, op_no, op, ref_idx, hyp_idx, ref_pos, hyp_pos, ref_word, hyp_word), one row per pair key and operation.
    ``ref`` and ``hyp`` are word arrays, or texts with one blank between words; ref_pos and hyp_pos count the words consumed after
    the operation. Long pairs are cut where every cheapest path passes, and their pieces are aligned in tasks of their own."""
    keys = _keys(key)
    whole, pieces = _parts(pairs, keys, ref, hyp, cells)
    earlier = Window.partitionBy(*keys).orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    ops = F.col("hyp_words") + F.col("deletions")  # every other operation takes a heard word
    offsets = _counted(pieces, [*keys, "part"]).select(*keys, "part", F.coalesce(F.sum(ops).over(earlier), F.lit(0)).alias("_op0"))
    more = WORDS if words else ()

    def aligned(own: pa.RecordBatch, paths: list[np.ndarray]) -> Iterator[dict]:
        from_r = from_h = at = 0  # words of the earlier pairs
        op0, r0, h0 = (own.column(c).to_numpy() for c in ("_op0", "r0", "h0"))
        size = np.array([len(p) for p in paths], dtype=np.int64)
        part = np.cumsum(size) // FRAME_ROWS
        for at in np.flatnonzero(np.diff(part, prepend=-1)).tolist():
            end = int(np.searchsorted(part, part[at], side="right"))
            o = Operations(paths[at:end])
            row = o.row + at
            some = {"row": row, "op": o.op, "op_no": np.arange(len(o.op)) - o.first[o.row] + op0[row], "ref_idx": np.where(o.ref, o.ref_pos - 1 + r0[row], -1),
                    "hyp_idx": np.where(o.hyp, o.hyp_pos - 1 + h0[row], -1), "ref_pos": o.ref_pos + r0[row], "hyp_pos": o.hyp_pos + h0[row]}
            if words:
                some["ref_word"] = np.where(o.ref, o.ref0[o.row] + o.ref_pos - 1 + from_r, -1)
                some["hyp_word"] = np.where(o.hyp, o.hyp0[o.row] + o.hyp_pos - 1 + from_h, -1)
            from_r, from_h = from_r + int(o.ref.sum()), from_h + int(o.hyp.sum())
            yield some

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for own, ref, hyp, paths in (x for batch in batches for x in _sliced(batch)):
            for f in _framed(aligned(own, paths)):
                optional = lambda c: pa.array(f[c].to_numpy(), mask=f[c].to_numpy() < 0)
                yield pa.RecordBatch.from_arrays(
                    [*(own.column(k).take(pa.array(f["row"])) for k in keys), pa.array(f["op_no"]), pa.array(NAMES, pa.string()).take(pa.array(f["op"])),
                     *map(optional, PLACES[:2]), *(pa.array(f[c]) for c in PLACES[2:]), *(all_.take(optional(c)) for all_, c in zip((ref, hyp), more))],
                    names=[*keys, "op_no", "op", *PLACES, *more])

    schema = f"{_kinds(pairs, keys)}, op_no long, op string, " + ", ".join([f"{c} long" for c in PLACES] + [f"{c} string" for c in more])
    placed = pieces.join(offsets, [*keys, "part"])
    return whole.withColumn("_op0", F.lit(0).cast("long")).mapInArrow(run, schema).unionByName(placed.mapInArrow(run, schema))


Fold = Callable[[pa.RecordBatch, Operations], tuple[np.ndarray | None, dict[str, pa.Array]]]


def folded(pairs: DataFrame, key: str | list[str], ref: str, hyp: str, more: list[str], fold: Fold, kinds: str, cells: int = CELLS) -> DataFrame:
    """What ``fold`` makes of the operations of each pair, without a row per operation: they leave the task that found them only
    for pairs that are aligned in pieces, as one byte each.

    ``fold`` takes pairs with the columns ``more``, and their operations; it returns the pairs of its rows by number (None: one row
    per pair) and the columns of ``kinds``. The keys are put before them."""
    keys = _keys(key)
    whole, pieces, others = _split(pairs, keys, ref, hyp, cells, *more)
    schema = f"{_kinds(pairs, keys)}, {kinds}"

    def result(own: pa.RecordBatch, paths: list[np.ndarray]) -> pa.RecordBatch:
        rows, columns = fold(own, Operations(paths))
        kept = [own.column(k) if rows is None else own.column(k).take(pa.array(rows)) for k in keys]
        return pa.RecordBatch.from_arrays([*kept, *columns.values()], names=[*keys, *columns])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for own, _, _, paths in (x for batch in batches for x in _sliced(batch)):
            yield result(own, paths)

    def found(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for own, _, _, paths in (x for batch in batches for x in _sliced(batch)):
            yield pa.RecordBatch.from_arrays([*(own.column(k) for k in keys), own.column("part"), pa.array([p.tobytes() for p in paths], pa.binary())], names=[*keys, "part", "_path"])

    def put_together(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for own in (batch.slice(at, 1) for batch in batches for at in range(batch.num_rows)):
            yield result(own, [np.frombuffer(b"".join(own.column("_paths")[0].as_py()), dtype=np.int8)])

    paths = pieces.mapInArrow(found, f"{_kinds(pairs, keys)}, part long, _path binary").groupBy(*keys).agg(F.array_sort(F.collect_list(F.struct("part", "_path"))).alias("_p"))
    same = [F.col(f"a.{k}").eqNullSafe(F.col(f"b.{k}")) for k in keys]
    both = others.select(*keys, *more).alias("a").join(paths.alias("b"), same).select(*[f"a.{k}" for k in keys], *[f"a.{c}" for c in more], F.transform("b._p", lambda x: x["_path"]).alias("_paths"))
    return whole.mapInArrow(run, schema).unionByName(both.mapInArrow(put_together, schema))


def _counted(parts: DataFrame, keys: list[str]) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for own, _, _, paths in (x for batch in batches for x in _sliced(batch)):
            n = np.array([np.bincount(p, minlength=len(NAMES)) for p in paths], dtype=np.int64)
            counts = [n[:, SUB], n[:, INS], n[:, DEL], n[:, MATCH] + n[:, SUB] + n[:, DEL], n[:, MATCH] + n[:, SUB] + n[:, INS]]
            yield pa.RecordBatch.from_arrays([*(own.column(k) for k in keys), *map(pa.array, counts)], names=[*keys, *COUNTS])

    return parts.mapInArrow(run, f"{_kinds(parts, keys)}, " + ", ".join(f"{c} long" for c in COUNTS))


def edit_counts(pairs: DataFrame, key: str | list[str], ref: str, hyp: str, cells: int = CELLS) -> DataFrame:
    """(key, substitutions, insertions, deletions, ref_words, hyp_words) per pair, without a row per operation."""
    keys = _keys(key)
    whole, pieces = (_counted(p, [*keys, "part"]) for p in _parts(pairs, keys, ref, hyp, cells))
    return whole.unionByName(pieces).groupBy(*keys).agg(*[F.sum(c).alias(c) for c in COUNTS])


COUNTS = ("substitutions", "insertions", "deletions", "ref_words", "hyp_words")


def wer(pairs: DataFrame, key: str | list[str], ref: str, hyp: str) -> DataFrame:
    """Counts and rate per pair. An empty reference scores 0 or the number of
    hypothesis words."""
    j = edit_counts(pairs, key, ref, hyp)
    errors = F.col("substitutions") + F.col("insertions") + F.col("deletions")
    return j.withColumn("wer", F.when(F.col("ref_words") > 0, errors / F.col("ref_words")).otherwise(F.col("hyp_words").cast("double")))


def corpus_wer(scores: DataFrame, keys: list[str]) -> DataFrame:
    errors = F.sum(F.col("substitutions") + F.col("insertions") + F.col("deletions"))
    return scores.groupBy(*keys).agg(errors.alias("errors"), F.sum("ref_words").alias("ref_words"),
                                     (errors / F.greatest(F.sum("ref_words"), F.lit(1))).alias("wer"))


def _runs(places: Column) -> Column:
    """Length of the longest run of consecutive numbers, and how many runs have three or more. A run counts when it gets there."""
    zero = F.lit(0).cast("long")
    start = F.struct(F.lit(-2).cast("long").alias("last"), zero.alias("n"), zero.alias("longest"), zero.alias("long"))

    def step(a: Column, x: Column) -> Column:
        n = F.when(x == a["last"] + 1, a["n"] + 1).otherwise(F.lit(1).cast("long"))
        return F.struct(x.alias("last"), n.alias("n"), F.greatest(a["longest"], n).alias("longest"), (a["long"] + (n == 3).cast("long")).alias("long"))

    return F.aggregate(places, start, step)


def language_mismatch(ops: DataFrame, keys: list[str], script: Callable[[Column], Column] = X.script) -> DataFrame:
    """Where reference words of each script went, insertions by script, and
    insertion runs. A rate is NULL when its script does not occur."""
    rs, hs = script(F.col("ref_word")), script(F.col("hyp_word"))
    o = ops.withColumn("rs", F.when(F.col("ref_word").isNotNull(), rs)).withColumn("hs", F.when(F.col("hyp_word").isNotNull(), hs))
    c = lambda cond: F.count_if(F.coalesce(cond, F.lit(False)))
    op, r, h = F.col("op"), F.col("rs"), F.col("hs")
    counts = []
    for mine, other, a, b in (("KO", "EN", "ko", "en"), ("EN", "KO", "en", "ko")):
        counts += [
            c(r == mine).alias(f"{a}_ref_words"), c((r == mine) & (op == "match")).alias(f"{a}_ok"), c((r == mine) & (op == "del")).alias(f"{a}_del"),
            c((r == mine) & (op == "sub") & (h == other)).alias(f"{a}_to_{b}"), c((r == mine) & (op == "sub") & (h != other)).alias(f"{a}_to_{a}")]
    counts += [c((op == "ins") & (h == "KO")).alias("ins_ko"), c((op == "ins") & (h == "EN")).alias("ins_en"),
               c((op == "ins") & ~h.isin("KO", "EN")).alias("ins_neu"), F.count("ref_word").alias("ref_words")]
    at = F.array_sort(F.collect_list(F.when(op == "ins", F.col("op_no"))))
    g = o.groupBy(*keys).agg(*counts, _runs(at).alias("_runs"))
    return _mismatch_rates(g.select("*", F.col("_runs.longest").alias("max_ins_run"), F.col("_runs.long").alias("ins_runs_ge3")).drop("_runs"))


def _mismatch_rates(j: DataFrame) -> DataFrame:
    rate = lambda a, b: F.when(F.col(b) > 0, F.col(a) / F.col(b))
    return j.withColumn("lmr_ko", rate("ko_to_en", "ko_ref_words")).withColumn("lmr_en", rate("en_to_ko", "en_ref_words")).withColumn(
        "lmr_wer_pp", F.coalesce((F.col("ko_to_en") + F.col("en_to_ko")) / F.nullif("ref_words", F.lit(0)), F.lit(0.0)))


#: Scripts of words as digits. 0 stands for no word.
KO, EN = 1, 2


def _digits(words: str, script: Callable[[Column], Column], text: bool) -> Column:
    """The scripts of the words of an array or text, one digit per word."""
    each = F.filter(F.split(words, " "), lambda w: w != "") if text else F.col(words)
    found = F.transform(each, lambda w: F.when(w.isNotNull(), F.coalesce(script(w), F.lit(""))))
    digit = lambda x: F.when(x == "KO", str(KO)).when(x == "EN", str(EN)).when(x == "", "4").when(x.isNotNull(), "3").otherwise("0")
    return F.coalesce(F.array_join(F.transform(found, digit), ""), F.lit(""))


def _with_scripts(pairs: DataFrame, ref: str, hyp: str, script: Callable[[Column], Column]) -> DataFrame:
    text = pairs.schema[ref].dataType == T.StringType()
    return pairs.withColumn("_rs", _digits(ref, script, text)).withColumn("_hs", _digits(hyp, script, text))


def _numbers(digits: pa.Array) -> np.ndarray:
    return np.frombuffer("".join(digits.to_pylist()).encode(), dtype=np.int8) - ord("0")


def pair_mismatch(pairs: DataFrame, key: str | list[str], ref: str, hyp: str, script: Callable[[Column], Column] = X.script, cells: int = CELLS) -> DataFrame:
    """``language_mismatch`` of pairs, counted where they are aligned. A pair without words has no row."""
    names = [c for a, b in (("ko", "en"), ("en", "ko")) for c in (f"{a}_ref_words", f"{a}_ok", f"{a}_del", f"{a}_to_{b}", f"{a}_to_{a}")]
    names += ["ins_ko", "ins_en", "ins_neu", "ref_words", "max_ins_run", "ins_runs_ge3"]

    def fold(own: pa.RecordBatch, o: Operations) -> tuple[np.ndarray, dict[str, pa.Array]]:
        lanes = own.num_rows
        r, h = o.of_words("ref", _numbers(own.column("_rs"))), o.of_words("hyp", _numbers(own.column("_hs")))
        n = np.bincount(((o.row * 4 + o.op) * 5 + r) * 5 + h, minlength=lanes * 100).reshape(lanes, 4, 5, 5)
        counts = []
        for mine, other in ((KO, EN), (EN, KO)):
            own_words = n[:, :, mine, :]
            counts += [own_words.sum((1, 2)), own_words[:, MATCH].sum(1), own_words[:, DEL].sum(1), own_words[:, SUB, other], own_words[:, SUB, mine] + own_words[:, SUB, 3]]
        ins = n[:, INS].sum(1)
        counts += [ins[:, KO], ins[:, EN], ins[:, 3], n[:, :, 1:, :].sum((1, 2, 3))]
        inserted = o.op == INS
        first = inserted.copy()
        first[1:] &= ~inserted[:-1] | (o.row[1:] != o.row[:-1])
        length, pair = np.bincount(np.cumsum(first)[inserted] - 1, minlength=int(first.sum())), o.row[first]
        longest = np.zeros(lanes, dtype=np.int64)
        np.maximum.at(longest, pair, length)
        counts += [longest, np.bincount(pair[length >= 3], minlength=lanes)]
        rows = np.flatnonzero(np.bincount(o.row, minlength=lanes))
        return rows, {c: pa.array(x[rows].astype(np.int64)) for c, x in zip(names, counts)}

    return _mismatch_rates(folded(_with_scripts(pairs, ref, hyp, script), key, ref, hyp, ["_rs", "_hs"], fold, ", ".join(f"{c} long" for c in names), cells))


def flip_events(pairs: DataFrame, key: str | list[str], ref: str, hyp: str, sizes: str, script: Callable[[Column], Column] = X.script, cells: int = CELLS) -> DataFrame:
    """Reference sentences whose dominant script is the opposite of that of the
    hypothesis words aligned to them. ``sizes`` has the words of each sentence, which together are the reference; sentences are
    counted from 0. A hypothesis word belongs to the last reference word consumed before it."""
    names = pa.array([None, "KO", "EN"])

    def fold(own: pa.RecordBatch, o: Operations) -> tuple[np.ndarray, dict[str, pa.Array]]:
        sentences = pc.list_value_length(own.column("_sizes")).to_numpy()
        size = own.column("_sizes").flatten().to_numpy()
        owned = o.ref_pos > 0
        at = np.repeat(np.arange(len(size)), size)[(o.ref0[o.row] + o.ref_pos - 1)[owned]]
        r, h = (o.of_words(side, _numbers(own.column(c)))[owned] for side, c in (("ref", "_rs"), ("hyp", "_hs")))
        count = lambda x: np.bincount(at[x], minlength=len(size))
        dominant = [np.sign(count(x == KO) - count(x == EN)) for x in (r, h)]
        flips = np.flatnonzero(dominant[0] * dominant[1] < 0)
        pair = np.repeat(np.arange(own.num_rows), sentences)
        script_of = lambda d: names.take(pa.array(np.where(d[flips] > 0, KO, EN)))
        return pair[flips], {"sentence": pa.array((np.arange(len(size)) - (np.cumsum(sentences) - sentences)[pair])[flips]), "ref_script": script_of(dominant[0]),
                             "hyp_script": script_of(dominant[1]), "ref_words": pa.array(count(r > 0)[flips])}

    src = _with_scripts(pairs, ref, hyp, script).withColumn("_sizes", F.col(sizes).cast("array<bigint>"))
    return folded(src, key, ref, hyp, ["_rs", "_hs", "_sizes"], fold, "sentence long, ref_script string, hyp_script string, ref_words long", cells)


@F.arrow_udf(T.ArrayType(T.LongType()))
def upto(sizes: pa.Array) -> pa.Array:
    """Running sums within each list."""
    n = pc.list_value_length(sizes).fill_null(0).to_numpy(zero_copy_only=False)
    total = np.concatenate(([0], np.cumsum(sizes.flatten().to_numpy(zero_copy_only=False)))).astype(np.int64)
    ends = np.concatenate(([0], np.cumsum(n))).astype(np.int32)
    return pa.ListArray.from_arrays(pa.array(ends), pa.array(total[1:] - np.repeat(total[ends[:-1]], n)))


def project(pairs: DataFrame, key: str | list[str], ref: str, hyp: str, bounds: str, more: list[str], cells: int = CELLS) -> DataFrame:
    """Hypothesis boundaries on the reference word axis: keys, the columns ``more``, and ``projected`` in the order of ``bounds``."""

    def fold(own: pa.RecordBatch, o: Operations) -> tuple[None, dict[str, pa.Array]]:
        n = pc.list_value_length(own.column("_bounds")).to_numpy()
        bound, pair = own.column("_bounds").flatten().to_numpy(), np.repeat(np.arange(own.num_rows), n)
        width = 2 + max(int(o.hyp_pos.max(initial=0)), int(bound.max(initial=0)))
        reached, wanted = o.row * width + o.hyp_pos, pair * width + bound
        last = np.searchsorted(reached, wanted, side="right") - 1
        met = (last >= 0) & (np.append(reached, -1)[last] == wanted)
        ends = np.concatenate(([0], np.cumsum(np.bincount(pair[met], minlength=own.num_rows)))).astype(np.int32)
        return None, {"projected": pa.ListArray.from_arrays(pa.array(ends), pa.array(o.ref_pos[last[met]])), **{c: own.column(c) for c in more}}

    src = pairs.withColumn("_bounds", F.array_sort(F.coalesce(F.col(bounds), F.array()).cast("array<bigint>")))
    kinds = ", ".join(["projected array<bigint>", *(f"{c} {pairs.schema[c].dataType.simpleString()}" for c in more)])
    return folded(src, key, ref, hyp, ["_bounds", *more], fold, kinds, cells)


def greedy(projected: list[int], bounds: list[int], tolerance: int) -> list[int]:
    """Indexes of projected boundaries that take the first free reference one. ``bounds`` ascend."""
    free, hits = list(bounds), []
    for i, p in enumerate(projected):
        k = bisect_left(free, p - tolerance)
        if k < len(free) and free[k] <= p + tolerance:
            del free[k]
            hits.append(i)
    return hits


@F.pandas_udf(T.ArrayType(T.IntegerType()))
def _greedy(projected: pd.Series, bounds: pd.Series, tolerance: pd.Series) -> pd.Series:
    empty: list[int] = []
    return pd.Series([greedy(list(p) if p is not None else empty, list(b) if b is not None else empty, int(t))
                      for p, b, t in zip(projected, bounds, tolerance)])


def _prf(matched: Column, n_ref: Column, n_hyp: Column, name: str) -> list[Column]:
    p = F.when(n_hyp > 0, matched / n_hyp).otherwise(0.0)
    r = F.when(n_ref > 0, matched / n_ref).otherwise(0.0)
    none = (n_ref == 0) & (n_hyp == 0)
    f = F.when(p + r > 0, 2 * p * r / (p + r)).otherwise(0.0)
    return [F.when(none, 1.0).otherwise(x).alias(f"{name}_{n}") for x, n in ((p, "precision"), (r, "recall"), (f, "f1"))]


def segmentation_f1(pairs: DataFrame, key: str | list[str], ref: str, hyp: str, ref_bounds: str, hyp_bounds: str, tolerance: int = 1) -> DataFrame:
    """Boundary precision, recall and F1 with greedy matching. Boundaries are arrays of word counts, ascending."""
    j = project(pairs, key, ref, hyp, hyp_bounds, [ref_bounds]).withColumn("m", F.size(_greedy("projected", ref_bounds, F.lit(tolerance))))
    n_ref, n_hyp = F.size(ref_bounds), F.size("projected")
    return j.select(*_keys(key), *_prf(F.col("m"), n_ref, n_hyp, "boundary"), F.col("m").alias("matched"), n_ref.alias("n_ref"), n_hyp.alias("n_hyp"))


def speaker_sentence_f1(pairs: DataFrame, key: str | list[str], ref: str, hyp: str, speaker_bounds: str, sentence_bounds: str, hyp_bounds: str, tolerance: int = 1) -> DataFrame:
    """Speaker and sentence boundary F1 from one alignment. A hypothesis boundary
    explained by the other kind does not count against precision; the sentence
    score is NULL when the reference has no inner sentence boundary."""
    keys, tol = _keys(key), F.lit(tolerance)
    j = project(pairs, key, ref, hyp, hyp_bounds, [speaker_bounds, sentence_bounds])
    j = j.withColumn("ms", _greedy("projected", speaker_bounds, tol)).withColumn("me", _greedy("projected", sentence_bounds, tol))
    loose = F.size("projected") - F.size(F.array_union("ms", "me"))
    ns, ne = F.size("ms"), F.size("me")
    speaker = _prf(ns, F.size(speaker_bounds), ns + loose, "speaker")
    sentence = _prf(ne, F.size(sentence_bounds), ne + loose, "sentence")
    names = [f"sentence_{n}" for n in ("precision", "recall", "f1")]
    full = j.select(*keys, *speaker, *sentence, F.size(sentence_bounds).alias("n_sentence"), F.size(speaker_bounds).alias("n_speaker"), loose.alias("unexplained"))
    for n in names:
        full = full.withColumn(n, F.when(F.col("n_sentence") > 0, F.col(n)))
    return full


#: Pairs whose words and times a task holds as Python objects at once.
SLICE_ROWS = 256


def greedy_times(pred: list, ref: list, ahead: int = 3) -> list[float]:
    """Start differences of words matched left to right with a short look-ahead."""
    at, deltas = 0, []
    for word, start in pred:
        if not word:
            continue
        hit = next((i for i in range(at, min(at + ahead, len(ref))) if ref[i][0] == word), None)
        if hit is not None:
            deltas.append(start - ref[hit][1])
            at = hit + 1
    return deltas


def timestamp_accuracy(words: DataFrame, keys: list[str]) -> DataFrame:
    """``words``: keys, pred and ref arrays of (word, start) in order. Mean, median
    and largest absolute start difference; NULL without a match."""

    def matched(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, SLICE_ROWS):
                own = batch.slice(at, SLICE_ROWS)
                pick = lambda xs: [(x["word"], x["start"]) for x in xs]
                d = [[abs(float(x)) for x in greedy_times(pick(p), pick(r))] for p, r in zip(own.column("pred").to_pylist(), own.column("ref").to_pylist())]
                yield pa.RecordBatch.from_arrays([*(own.column(k) for k in keys), pa.array([len(x) for x in own.column("ref")], pa.int32()),
                                                  pa.array([len(x) for x in own.column("pred")], pa.int32()), pa.array(d, pa.list_(pa.float64()))], names=[*keys, "n_ref", "n_pred", "d"])

    found = words.select(*keys, "pred", "ref").mapInArrow(matched, f"{_kinds(words, keys)}, n_ref int, n_pred int, d array<double>")
    d = found.withColumn("d", F.array_sort("d"))
    n = F.size("d")
    mid = (F.get("d", F.floor((n - 1) / 2).cast("int")) + F.get("d", F.floor(n / 2).cast("int"))) / 2
    has = n > 0
    return d.select(*keys, "n_ref", "n_pred", n.alias("n_matched"),
                    F.when(has, F.aggregate("d", F.lit(0.0), lambda a, x: a + x) / n).alias("mae_start"),
                    F.when(has, F.array_max("d")).alias("max_delta_start"), F.when(has, mid).alias("median_delta_start"))


def midword_splits(ops: DataFrame, line_starts: DataFrame, keys: list[str]) -> DataFrame:
    """Reference words that are heard in two or more pieces with a line start between them.

    A run of operations without a match that takes one reference word and two or more heard ones is such a split if the pieces
    put together are the word. ``line_starts`` has hyp_idx of the words that begin a line. Runs are measured before their pieces
    are collected, so no more is put together than a word has letters."""
    s = scan(ops.select(*keys, "op_no", "op", "hyp_idx", "ref_word", "hyp_word"), keys, ["op_no"], rows_block("op_no"), run=running_sum(F.when(F.col("op") == "match", 1).otherwise(0)))
    s = shared(s.filter("op <> 'match'"), *keys, "run")
    size = s.groupBy(*keys, "run").agg(F.count("ref_word").alias("_r"), F.count("hyp_word").alias("pieces"), F.sum(F.length("hyp_word")).alias("_n"),
                                       F.max("ref_word").alias("ref_word"), F.min("hyp_idx").alias("_first"))
    size = size.filter("_r = 1 AND pieces >= 2 AND _n = length(ref_word)").drop("_r", "_n")
    own = s.select(*keys, "run", "op_no", "hyp_idx", "hyp_word").join(size, [*keys, "run"])
    own = own.join(line_starts.select(*keys, "hyp_idx", F.lit(True).alias("_begins")), [*keys, "hyp_idx"], "left")
    inner = F.bool_or(F.coalesce("_begins", F.lit(False)) & (F.col("hyp_idx") > F.col("_first")))
    word = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("op_no", F.coalesce("hyp_word", F.lit("")).alias("w")))), lambda x: x["w"]), "")
    g = own.groupBy(*keys, "run", "ref_word", "pieces", "_first").agg(inner.alias("_inner"), word.alias("_word"))
    return g.filter("_inner AND _word = ref_word").select(*keys, "ref_word", F.col("_first").alias("hyp_idx"), "pieces")


def missing_kinds(ops: DataFrame, keys: list[str]) -> DataFrame:
    """Per reference word: match, sub or del."""
    return ops.filter(F.col("ref_idx").isNotNull()).select(*keys, "ref_idx", "op", F.col("ref_word").alias("word"))
