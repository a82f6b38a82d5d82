"""Passages that repeat across documents, by common-prefix interval trees of suffix arrays.

A repeat is a byte string of at least `least` bytes that stands in two documents. Three steps find
all of them, byte for byte, without ever gathering the corpus:

1. Anchors. Of the grams of GRAM bytes in each window of `least` bytes the ones of the least hash
   are the window's anchors, so that equal windows have equal anchors, wherever they stand. Texts
   are dealt into blocks; a block names each of its grams once, as five bytes, to the bucket of the
   gram's hash, which answers with a bit for each gram that another document has too.
2. Suffix arrays. The stretch of text whose windows chose a shared anchor goes, once for each
   different stretch of a block, to the bucket of its anchor. The bucket sorts the suffixes of its
   stretches, takes the common prefix of neighbours, scans these with a stack into the intervals of
   the common-prefix tree, and keeps an interval if what stands left of its suffixes differs, or is
   the edge of a stretch: a maximal repeat of the stretches, with all its occurrences. A longer
   repeat is found as groups that overlap, one for each of its anchors.
3. Each block lays its groups over its own texts.

Scale. What travels is one entry of a gram or a stretch for each block, however many copies there
are. A gram with over HOT different stretches is split: each window of these stretches is a stretch
of its own and goes to the bucket of its own hash, so that no bucket grows with the documents that
share a phrase. Blocks and buckets hold a bounded part of the text; tables between the steps are
written, so that a lost executor costs a re-read. A repeated row of one id and text costs its own
block memory.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from docloom.llm.scratch import Scratch
from docloom.llm.wordhash import mix, trim

LEAST, GRAM = 50, 24
#: Bytes of text of a block, of which anchors are sought at a time, and for each bucket of grams and of stretches.
BLOCK, PIECE, GRAM_BUCKET, STRETCH_BUCKET = 8 << 20, 1 << 17, 16 << 20, 4 << 20
#: Suffixes that are sorted at a time; those of one window are sorted together.
SORTED = 1 << 18
#: Different stretches of a gram from which it is split.
HOT = 1024
_U = np.uint64
_MUL = [_U(0x9E3779B97F4A7C15), _U(0xC2B2AE3D27D4EB4F), _U(0x165667B19E3779F9), _U(0xD6E8FEB86659FD93), _U(0xA0761D6478BD642F)]
_LOW = _U((1 << 40) - 1)


def gram_hashes(data: np.ndarray) -> np.ndarray:
    """The hash of the GRAM bytes from each place on; none is 0."""
    n = len(data) - GRAM + 1
    if n < 1:
        return np.zeros(0, _U)
    words = data.astype(_U)  # of 1, 2, 4 and then 8 bytes
    for size in (1, 2, 4):
        words = words[:-size] | (words[size:] << _U(8 * size))
    out = words[:n] * _MUL[0]
    for i in range(1, GRAM // 8):
        out += words[8 * i : 8 * i + n] * _MUL[i]
    out ^= out >> _U(32)
    out *= _MUL[3]
    out ^= out >> _U(29)
    return out | _U(1)


def span_hashes(grams: np.ndarray, start: np.ndarray, length: np.ndarray, several: int = 1) -> list[np.ndarray]:
    """Independent hashes of stretches of GRAM bytes at least, from those of grams that cover them."""
    found = [mix(length.astype(_U) * _MUL[3] + _U(k)) for k in range(several)]
    end = start + length - GRAM
    for k in range(-(-int(length.max(initial=0)) // GRAM)):
        gram = grams[np.minimum(start + k * GRAM, end)]
        for j, out in enumerate(found):
            out *= _MUL[4 - j]
            out += gram
            out ^= out >> _U(31)
    return [mix(out) for out in found]


def _sliding_minimum(values: np.ndarray, width: int) -> np.ndarray:
    size = 1
    while 2 * size <= width:
        values = np.minimum(values[:-size], values[size:])
        size *= 2
    return np.minimum(values[: len(values) - (width - size)], values[width - size :]) if size < width else values


class Anchors:
    """Stretches of a block of texts. gram: the least hash of a gram in each window of the stretch; first
    and last: where its first and last window start; keys: hashes of its bytes, as many as asked for."""

    def __init__(self, texts: pa.ChunkedArray, least: int, keys: int):
        whole = texts.cast(pa.large_binary()).combine_chunks()
        n = len(whole)
        self.least, self.n_keys = least, keys
        self.offsets = np.frombuffer(whole.buffers()[1], np.int64)[whole.offset : whole.offset + n + 1] if n else np.zeros(1, np.int64)
        data = np.frombuffer(whole.buffers()[2] or b"", np.uint8) if n else np.zeros(0, np.uint8)
        self.data = data[self.offsets[0] : self.offsets[-1]]
        self.offsets = self.offsets - self.offsets[0]
        found = [self._piece(s) for s in range(0, max(0, len(self.data) - least + 1), PIECE)]
        none = [np.zeros(0, _U), *[np.zeros(0, np.int64)] * 2, *[np.zeros(0, _U)] * keys]
        self.gram, self.first, self.last, *self.keys = [np.concatenate(x) for x in zip(*found, strict=True)] if found else none
        self.text = np.searchsorted(self.offsets, self.first, "right") - 1

    def _piece(self, begin: int) -> tuple:
        least, w = self.least, self.least - GRAM + 1
        grams = gram_hashes(self.data[begin : begin + PIECE + least - 1])
        level = _sliding_minimum(grams, w)
        # windows that no text holds have no gram
        ends = self.offsets[1:]
        for e in (ends[np.searchsorted(ends, begin, "right") :] - begin).tolist():
            if e - least + 1 >= len(level):
                break
            level[max(0, e - least + 1) : e] = 0
        cuts = _firsts(level)
        size = np.diff(np.append(cuts, len(level)))
        real = level[cuts] != 0
        cuts, size = cuts[real], size[real]
        # a gram that stands again within its window makes longer runs, of which all parts count, so that
        # what is a repeat in one part is one in all; they are equal but for a few
        parts = np.maximum(size - w, 0) + 1
        if (parts > 1).any():
            cuts, size = _runs(cuts, parts), np.repeat(np.minimum(size, w), parts)
        return level[cuts], begin + cuts, begin + cuts + size - 1, *span_hashes(grams, cuts, size + least - 1, self.n_keys)


def _firsts(values: np.ndarray) -> np.ndarray:
    """Where runs of equal values start."""
    return np.flatnonzero(np.concatenate([[True], values[1:] != values[:-1]])) if len(values) else np.zeros(0, np.int64)


class _Grams:
    """The distinct grams of a block, by bucket and hash, and of which of them each anchor is."""

    def __init__(self, a: Anchors, buckets: int):
        value = (((a.gram >> _U(40)) % _U(buckets)) << _U(40)) | (a.gram & _LOW)
        self.values, self.of = np.unique(value, return_inverse=True)
        self.bucket = (self.values >> _U(40)).astype(np.int64)


def _name_grams(least: int, buckets: int):
    def run(table: pa.Table) -> pa.Table:
        block = table["block"][0].as_py()
        a = Anchors(table["text"], least, 1)
        g = _Grams(a, buckets)
        n = len(g.values)
        lo, hi = np.full(n, len(a.offsets)), np.full(n, -1)
        np.minimum.at(lo, g.of, a.text)
        np.maximum.at(hi, g.of, a.text)
        _, each = np.unique(a.keys[0], return_index=True)
        count = np.minimum(np.bincount(g.of[each], minlength=n), 127).astype(np.uint8) * 2 + (hi > lo)
        low = g.values & _LOW
        cuts = _firsts(g.bucket).tolist()
        rows = []
        for s, e in zip(cuts, [*cuts[1:], n], strict=True) if n else ():
            rows.append((int(g.bucket[s]), (low[s:e] & _U(0xFFFFFFFF)).astype(np.uint32).tobytes() + (low[s:e] >> _U(32)).astype(np.uint8).tobytes(), count[s:e].astype(np.uint8).tobytes()))
        trim()
        return pa.table({"bucket": pa.array([r[0] for r in rows], pa.int32()), "block": pa.array([block] * len(rows), pa.int64()), "names": pa.array([r[1] for r in rows], pa.binary()), "counts": pa.array([r[2] for r in rows], pa.binary())})

    return run


def _answer_grams(table: pa.Table) -> pa.Table:
    """A bit for each gram that two documents have, and one for each that is split."""
    names, counts = table["names"].to_pylist(), table["counts"].to_pylist()
    sizes = [len(c) for c in counts]
    whole = np.empty(sum(sizes), _U)
    at = 0
    for name, n in zip(names, sizes, strict=True):
        whole[at : at + n] = np.frombuffer(name, np.uint32, n) | (np.frombuffer(name, np.uint8, n, 4 * n).astype(_U) << _U(32))
        at += n
    count = np.frombuffer(b"".join(counts), np.uint8)
    order = np.argsort(whole, kind="stable")
    cuts = _firsts(whole[order])
    lengths = np.diff(np.append(cuts, len(whole)))
    several = (np.maximum.reduceat(count[order] & 1, cuts) > 0) | (lengths > 1)
    split = several & (np.add.reduceat((count[order] >> 1).astype(np.int64), cuts) > HOT)
    shared, hot = np.empty(len(whole), bool), np.empty(len(whole), bool)
    shared[order], hot[order] = np.repeat(several, lengths), np.repeat(split, lengths)
    ends = np.cumsum(sizes)
    bits = [(np.packbits(shared[e - n : e]).tobytes(), np.packbits(hot[e - n : e]).tobytes()) for n, e in zip(sizes, ends.tolist(), strict=True)]
    return pa.table({"block": table["block"], "bucket": table["bucket"], "shared": pa.array([b[0] for b in bits], pa.binary()), "hot": pa.array([b[1] for b in bits], pa.binary())})


class _Stretches:
    """The stretches of a block that go to buckets: start, length and text of each occurrence, of which
    distinct stretch it is, and of distinct ones the bucket, least and greatest id; in order of bucket and hash."""

    def __init__(self, a: Anchors, ids: np.ndarray, answers: pa.Table, gram_buckets: int, buckets: int):
        g = _Grams(a, gram_buckets)
        shared, hot = np.zeros(len(g.values), bool), np.zeros(len(g.values), bool)
        for bucket, s, h in zip(answers["bucket"].to_pylist(), answers["shared"].to_pylist(), answers["hot"].to_pylist(), strict=True):
            lo, hi = np.searchsorted(g.bucket, [bucket, bucket + 1])
            shared[lo:hi], hot[lo:hi] = (np.unpackbits(np.frombuffer(x, np.uint8), count=hi - lo).astype(bool) for x in (s, h))
        plain, split = np.flatnonzero(shared[g.of] & ~hot[g.of]), np.flatnonzero(hot[g.of])
        n = a.last[split] - a.first[split] + 1
        windows = _runs(a.first[split], n)
        more = []
        if len(windows):
            for s in range(0, len(a.data), PIECE):
                part = windows[(windows >= s) & (windows < s + PIECE)] - s
                grams = gram_hashes(a.data[s : s + PIECE + a.least - 1])
                more.append((part + s, *span_hashes(grams, part, np.full(len(part), a.least), 2)))
        where, key, check = (np.concatenate(x) for x in zip(*more, strict=True)) if more else (np.zeros(0, np.int64), np.zeros(0, _U), np.zeros(0, _U))
        self.start = np.concatenate([a.first[plain], where])
        self.length = np.concatenate([a.last[plain] - a.first[plain], np.zeros(len(where), np.int64)]) + a.least
        key, check = (np.concatenate([own[plain], x]) for own, x in zip(a.keys, (key, check), strict=True))
        to = np.concatenate([a.gram[plain] * _MUL[1] >> _U(33), key[len(plain) :] * _MUL[1] >> _U(33)]) % _U(buckets)
        self.text = np.searchsorted(a.offsets, self.start, "right") - 1
        order = np.lexsort((check, key, to))
        new = np.zeros(len(order), bool)
        for x in (to, key, check):
            new[1:] |= x[order][1:] != x[order][:-1]
        new[:1] = True
        cuts = np.flatnonzero(new)
        self.of = np.empty(len(order), np.int64)
        self.of[order] = np.cumsum(new) - 1
        self.example, self.bucket = order[cuts], to[order[cuts]].astype(np.int64)
        own = ids[self.text[order]]
        self.least, self.most = (f.reduceat(own, cuts) if len(cuts) else own for f in (np.minimum, np.maximum))

    def groups(self):
        """(bucket, slice of distinct stretches)"""
        cuts = _firsts(self.bucket).tolist()
        return [(int(self.bucket[s]), slice(s, e)) for s, e in zip(cuts, [*cuts[1:], len(self.bucket)], strict=True)] if cuts else []


def _bytes_of(data: np.ndarray, start: np.ndarray, length: np.ndarray) -> np.ndarray:
    return data[_runs(start, length)]


def _send_stretches(least: int, gram_buckets: int, buckets: int):
    def run(table: pa.Table, answers: pa.Table) -> pa.Table:
        rows = []
        block = None
        if table.num_rows and answers.num_rows:
            block = table["block"][0].as_py()
            a = Anchors(table["text"], least, 2)
            s = _Stretches(a, table["id"].to_numpy(), answers, gram_buckets, buckets)
            for bucket, of in s.groups():
                start, length = s.start[s.example[of]], s.length[s.example[of]]
                rows.append((bucket, length.astype(np.uint16).tobytes(), _bytes_of(a.data, start, length).tobytes(), s.least[of].tobytes(), s.most[of].tobytes()))
        trim()
        return pa.table({"bucket": pa.array([r[0] for r in rows], pa.int32()), "block": pa.array([block] * len(rows), pa.int64()), **{c: pa.array([r[i] for r in rows], pa.binary()) for i, c in enumerate(("lengths", "bytes", "least", "most"), 1)}})

    return run


def interval_tree(common: list[int], least: int) -> list[tuple[int, int, int]]:
    """(length, first, last) of the intervals of the common-prefix tree of least bytes or more; common:
    the common prefix of each suffix and the next."""
    found, stack = [], []
    for i, h in enumerate([*common, 0]):
        left = i
        while stack and stack[-1][0] > h:
            length, left = stack.pop()
            found.append((length, left, i))
        if h >= least and not (stack and stack[-1][0] == h):
            stack.append((h, left))
    return found


def _runs(first: np.ndarray, size: np.ndarray) -> np.ndarray:
    """The numbers first, first + 1, ..., size of them, for each."""
    return np.repeat(first - np.cumsum(size) + size, size) + np.arange(size.sum())


def maximal_repeats(data: np.ndarray, lengths: np.ndarray, several: np.ndarray, least: int) -> tuple[np.ndarray, ...]:
    """Of different strings that stand one after the other in data: (group, length, string, place) for
    each occurrence of each of their maximal repeats. several: strings that have copies, so that their
    leaf in the tree is a repeat too."""
    ends = np.cumsum(lengths)
    begins = ends - lengths
    n = np.maximum(lengths - least + 1, 0)
    start = _runs(begins, n)
    window = span_hashes(gram_hashes(data), start, np.full(len(start), least))[0]
    # suffixes whose first bytes stand there once are leaves without a repeat
    order = np.argsort(window)
    cuts = _firsts(window[order])
    size = np.diff(np.append(cuts, len(order)))
    cuts, size = cuts[size > 1], size[size > 1]
    parts, leaf, number = [], several.copy(), 0
    batch = np.cumsum(size) // SORTED
    for k in np.unique(batch).tolist():
        of = batch == k
        group, length, string, place, whole = _tree_of(data, begins, ends, start[order[_runs(cuts[of], size[of])]], least)
        leaf[whole] = False
        parts.append((group + number, length, string, place))
        number += int(group.max(initial=-1)) + 1
    leaf = np.flatnonzero(leaf)
    parts.append((number + np.arange(len(leaf)), lengths[leaf], leaf, np.zeros(len(leaf), np.int64)))
    return tuple(np.concatenate(x) for x in zip(*parts, strict=True))


def _tree_of(data: np.ndarray, begins: np.ndarray, ends: np.ndarray, start: np.ndarray, least: int) -> tuple[np.ndarray, ...]:
    """(group, length, string, place) of some suffixes, and the strings that stand whole in another one."""
    string = np.searchsorted(begins, start, "right") - 1
    rest = ends[string] - start
    by_rest = np.argsort(rest, kind="stable")  # of equal bytes the suffix that ends first comes first
    string, start, rest = string[by_rest], start[by_rest], rest[by_rest]
    width = int(rest[-1])
    rows = np.lib.stride_tricks.sliding_window_view(np.append(data, np.zeros(width, np.uint8)), width)[start]
    for k in range(least, width):
        rows[: np.searchsorted(rest, k, "right"), k] = 0
    order = np.argsort(rows.view(f"S{width}").ravel(), kind="stable")
    rows, string, start, rest = rows[order], string[order], start[order], rest[order]
    differ = rows[1:] != rows[:-1]
    common = np.where(differ.any(1), differ.argmax(1), width)
    common = np.minimum(common, np.minimum(rest[1:], rest[:-1]))
    edge = start == begins[string]
    none = np.zeros(1, np.int64)
    whole = string[edge & (np.maximum(np.append(common, none), np.append(none, common)) == rest)]
    tree = interval_tree(common.tolist(), least)
    length, first, last = (np.array(x, np.int64) for x in zip(*tree, strict=True)) if tree else (np.zeros(0, np.int64),) * 3
    # left extension: another byte than the suffix before it has, or the edge of a stretch
    left = np.where(edge, -1, data[start - 1].astype(np.int64))
    change = np.concatenate([[0], np.cumsum(edge[1:] | (left[1:] != left[:-1]))])
    diverse = (change[last] > change[first]) | edge[first]
    length, first, last = length[diverse], first[diverse], last[diverse]
    size = last - first + 1
    at = _runs(first, size)
    return np.repeat(np.arange(len(size)), size), np.repeat(length, size), string[at], start[at] - begins[string[at]], whole


def _not_inside(string: np.ndarray, place: np.ndarray, length: np.ndarray, smallest: np.ndarray) -> np.ndarray:
    """Places of the entries of each string but for those inside an entry of the string's smallest id."""
    order = np.lexsort((-length, place, string))
    string, end, smallest = string[order], (place + length)[order], smallest[order]
    cuts = _firsts(string)
    best = np.minimum.reduceat(smallest, cuts) if len(cuts) else smallest
    best = smallest == np.repeat(best, np.diff(np.append(cuts, len(string))))
    # strings rise, so that those before reach no further
    key = string * (int(end.max(initial=0)) + 1)
    far = np.maximum.accumulate(np.where(best, key + end, key)) if len(key) else key
    before = np.concatenate([[-1], far[:-1]])
    return order[key + end > np.maximum(before, key)]


def _find_groups(least: int, whole: bool):
    """whole: all occurrences; else those that have a smaller id beside them."""

    def run(table: pa.Table) -> pa.Table:
        bucket = table["bucket"][0].as_py()
        sizes = [len(x) // 2 for x in table["lengths"].to_pylist()]
        join = lambda c, kind: np.frombuffer(b"".join(table[c].to_pylist()), kind)
        lengths, data, low, high = join("lengths", np.uint16).astype(np.int64), join("bytes", np.uint8), join("least", np.int64), join("most", np.int64)
        # what several blocks have is one string
        begins = np.cumsum(lengths) - lengths
        key, check = span_hashes(gram_hashes(data), begins, lengths, 2)
        order = np.lexsort((check, key))
        cuts = np.flatnonzero(np.concatenate([[True], (key[order][1:] != key[order][:-1]) | (check[order][1:] != check[order][:-1])]))
        size = np.diff(np.append(cuts, len(order)))
        example = order[cuts]
        least_id, most_id = np.minimum.reduceat(low[order], cuts), np.maximum.reduceat(high[order], cuts)
        group, length, string, place = maximal_repeats(_bytes_of(data, begins[example], lengths[example]), lengths[example], least_id != most_id, least)
        starts = _firsts(group)
        smallest = np.minimum.reduceat(least_id[string], starts) if len(starts) else low[:0]
        smallest = np.repeat(smallest, np.diff(np.append(starts, len(group))))
        if not whole:
            use = np.flatnonzero(smallest < most_id[string])
            use = use[_not_inside(string[use], place[use], length[use], smallest[use])]
            group, length, string, place, smallest = (x[use] for x in (group, length, string, place, smallest))
        # back to the blocks that sent the strings
        times = size[string]
        entry = order[_runs(cuts[string], times)]
        group, length, place, smallest = (np.repeat(x, times) for x in (group, length, place, smallest))
        if not whole:
            use = smallest < high[entry]
            group, length, entry, place, smallest = (x[use] for x in (group, length, entry, place, smallest))
        order = np.argsort(entry, kind="stable")
        group, length, entry, place, smallest = (x[order] for x in (group, length, entry, place, smallest))
        rows, ends = [], np.cumsum(sizes)
        spots = np.searchsorted(entry, np.concatenate([[0], ends])).tolist()
        for i, (block, begin) in enumerate(zip(table["block"].to_pylist(), (ends - sizes).tolist(), strict=True)):
            of = slice(spots[i], spots[i + 1])
            if of.start < of.stop:
                rows.append((block, (entry[of] - begin).astype(np.uint32).tobytes(), place[of].astype(np.uint16).tobytes(), length[of].astype(np.uint16).tobytes(), smallest[of].tobytes(), group[of].astype(np.uint32).tobytes() if whole else b""))
        trim()
        return pa.table({"block": pa.array([r[0] for r in rows], pa.int64()), "bucket": pa.array([bucket] * len(rows), pa.int32()), **{c: pa.array([r[i] for r in rows], pa.binary()) for i, c in enumerate(("stretch", "place", "length", "smallest", "number"), 1)}})

    return run


_ANSWER = "block long, bucket int, shared binary, hot binary"
_GROUP = "block long, bucket int, stretch binary, place binary, length binary, smallest binary, number binary"


def _occurrences(s: _Stretches, groups: pa.Table, ids: np.ndarray, whole: bool) -> tuple[np.ndarray, ...]:
    """(text, start, length, number of the group) for occurrences in the block; of all groups, or of those with a smaller id."""
    found, at = [], dict(s.groups())
    by = np.argsort(s.of, kind="stable")
    spots = np.searchsorted(s.of[by], np.arange(len(s.bucket) + 1))
    for row in groups.to_pylist():
        kind = np.frombuffer(row["stretch"], np.uint32).astype(np.int64) + at[row["bucket"]].start
        n = spots[kind + 1] - spots[kind]
        which = by[_runs(spots[kind], n)]
        entry = np.repeat(np.arange(len(kind)), n)
        if not whole:
            use = np.frombuffer(row["smallest"], np.int64)[entry] < ids[s.text[which]]
            which, entry = which[use], entry[use]
        place, length = (np.frombuffer(row[c], np.uint16).astype(np.int64)[entry] for c in ("place", "length"))
        number = np.frombuffer(row["number"], np.uint32).astype(np.int64)[entry] | row["bucket"] << 32 if whole else entry
        found.append((s.text[which], s.start[which] + place, length, number))
    return tuple(np.concatenate(x) for x in zip(*found, strict=True)) if found else (np.zeros(0, np.int64),) * 4


def _read_block(table: pa.Table, right: pa.Table, least: int, gram_buckets: int, buckets: int, whole: bool) -> tuple:
    a = Anchors(table["text"], least, 2)
    marked = right.filter(pa.compute.is_valid(right["stretch"]))
    if not marked.num_rows:
        return a, (np.zeros(0, np.int64),) * 4
    ids = table["id"].to_numpy()
    s = _Stretches(a, ids, right.filter(pa.compute.is_valid(right["shared"])), gram_buckets, buckets)
    return a, _occurrences(s, marked, ids, whole)


def _cut_out(least: int, gram_buckets: int, buckets: int):
    def run(table: pa.Table, right: pa.Table) -> pa.Table:
        if not table.num_rows:
            return pa.table({"n_bytes": pa.array([], pa.int64()), "spans": pa.array([], _SPANS), "kept": pa.array([], pa.binary()), "row": table["row"]})
        a, (text, start, length, _) = _read_block(table, right, least, gram_buckets, buckets, False)
        end = start + length
        order = np.argsort(start, kind="stable")
        text, start, end = text[order], start[order], np.maximum.accumulate(end[order])
        # a run starts beyond the end of what came before, or in another text
        cuts = np.flatnonzero(np.concatenate([[True], (start[1:] > end[:-1]) | (text[1:] != text[:-1])])) if len(start) else np.zeros(0, np.int64)
        of, start, end = text[cuts], start[cuts], end[np.append(cuts[1:], len(end))[: len(cuts)] - 1]
        at = np.searchsorted(of, np.arange(table.num_rows + 1))
        whole, offsets = a.data.tobytes(), a.offsets.tolist()
        kept, begins, stops, spots = [], start.tolist(), end.tolist(), at.tolist()
        for i, (x, y) in enumerate(zip(offsets[:-1], offsets[1:], strict=True)):
            parts = []
            for k in range(spots[i], spots[i + 1]):
                parts.append(whole[x : begins[k]])
                x = stops[k]
            kept.append(b"".join([*parts, whole[x:y]]) if parts else whole[x:y])
        marks = pa.StructArray.from_arrays([pa.array(start - a.offsets[of]), pa.array(end - a.offsets[of])], names=["start", "end"])
        out = pa.table({"n_bytes": pa.array(np.diff(a.offsets)), "spans": pa.ListArray.from_arrays(pa.array(at.astype(np.int32)), marks), "kept": pa.array(kept, pa.binary()), "row": table["row"]})
        trim()
        return out

    return run


_SPANS = pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())]))


def _list_groups(least: int, gram_buckets: int, buckets: int):
    def run(table: pa.Table, right: pa.Table) -> pa.Table:
        if not table.num_rows:
            text = start = length = number = np.zeros(0, np.int64)
            ids, a = np.zeros(0, np.int64), None
        else:
            a, (text, start, length, number) = _read_block(table, right, least, gram_buckets, buckets, True)
            ids, start = table["id"].to_numpy(), start - a.offsets[text]
        return pa.table({"group": pa.array(number), "length": pa.array(length), "doc_id": pa.array(ids[text]), "start": pa.array(start)})

    return run


_NULL_ID = -(1 << 63)


class _Run:
    """The written tables of one call."""

    def __init__(self, docs: DataFrame, least: int, doc_id: str, text: str, whole: bool):
        if least < GRAM:
            raise ValueError(f"a repeat has {GRAM} bytes at least")
        scratch = Scratch(docs.sparkSession, "repeats")
        body = F.coalesce(F.col(f"`{text}`").cast("string"), F.lit(""))
        size = docs.agg(F.sum(F.octet_length(body))).first()[0] or 0
        block = min(64 << 20, max(BLOCK, size >> 12))
        blocks = size // block + 1
        self.args = least, size // (GRAM_BUCKET * block // BLOCK) + 1, size // (STRETCH_BUCKET * block // BLOCK) + 1
        # the columns to carry are one column, so that no name clashes
        carried = F.struct(*(F.col(f"`{c}`") for c in docs.columns if c != text), F.lit(0).alias("_")).alias("row")
        rows = docs.select(carried, F.coalesce(F.col(f"`{doc_id}`").cast("long"), F.lit(_NULL_ID)).alias("id"), body.cast("binary").alias("text"))
        rows = rows.withColumn("block", F.pmod(F.xxhash64("id", "text"), F.lit(blocks)))
        files = min(blocks, 50_000)
        self.texts = scratch.keep_bucketed(rows.repartition(files, "block"), "texts", files, "block", [])
        scratch.free()
        slim = self.texts.select("block", "id", "text")
        least, gram_buckets, buckets = self.args
        named = slim.groupBy("block").applyInArrow(_name_grams(least, gram_buckets), "bucket int, block long, names binary, counts binary")
        answers = scratch.keep(named.groupBy("bucket").applyInArrow(_answer_grams, _ANSWER), "answers")
        scratch.free()
        sent = slim.groupBy("block").cogroup(answers.groupBy("block")).applyInArrow(_send_stretches(*self.args), "bucket int, block long, lengths binary, bytes binary, least binary, most binary")
        groups = scratch.keep(sent.groupBy("bucket").applyInArrow(_find_groups(least, whole), _GROUP), "groups")
        scratch.free()
        self.right = answers.unionByName(groups, allowMissingColumns=True)
        self.row_type = rows.schema["row"].dataType.simpleString()

    def per_block(self, function, columns: list[str], schema: str) -> DataFrame:
        return self.texts.select("block", *columns).groupBy("block").cogroup(self.right.groupBy("block")).applyInArrow(function(*self.args), schema)


def remove_repeats(docs: DataFrame, least: int = LEAST, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """docs without text, with n_bytes, spans and kept: of the UTF-8 bytes of the text, all are removed
    that a string of least bytes covers which also starts in a document of a smaller id.

    spans are the maximal removed runs (start, end), kept the remaining bytes, which may end inside a
    character. A null text is empty. A null id is smaller than all others. Rows of one id are one
    document: they take nothing from each other. Texts under least bytes stay whole. Other columns are
    carried, whatever their names; an empty table gives an empty result.
    """
    run = _Run(docs, least, doc_id, text, False)
    out = run.per_block(_cut_out, ["id", "text", "row"], f"n_bytes long, spans array<struct<start: long, end: long>>, kept binary, row {run.row_type}")
    return out.select(*(F.col(f"row.`{c}`").alias(c) for c in docs.columns if c != text and c not in ("n_bytes", "spans", "kept")), "n_bytes", "spans", "kept")


def repeat_groups(docs: DataFrame, least: int = LEAST, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """group, length, doc_id, start: all occurrences of the groups of repeats between documents.

    The bytes from start on are the same in all rows of a group; its occurrences are all of the
    corpus. Every string of least bytes that two documents share lies in a group. Null ids and texts
    as in remove_repeats."""
    run = _Run(docs, least, doc_id, text, True)
    out = run.per_block(_list_groups, ["id", "text"], "group long, length long, doc_id long, start long").distinct()
    return out.withColumn("doc_id", F.when(F.col("doc_id") != _NULL_ID, F.col("doc_id")))
