"""External suffix sorting of one shard by recursive induction.

Suffixes are tuples (position, common prefix with the suffix before) in one first-in-first-out queue for each first character.
Emptied in order of the characters the queues are a priority queue. What exceeds a memory bound goes to files in a scratch
folder that any file system of Arrow can hold, so a shard needs memory for its text, two bytes a character, and not for its tuples.
"""

from __future__ import annotations

import uuid

import numpy as np

#: Common prefixes are counted up to here: callers ask for lengths of at most 100.
CAP = 120
#: Bytes of tuples that a sort holds in memory; tuples handled at a time; length from which a reduced string is not sorted in memory.
MEMORY, CHUNK, BASE = 2_000_000, 1 << 16, 4_000_000


class Queues:
    """Queues of tuples by key. In memory up to ``memory`` bytes; then all that are in memory go to one file of ``folder``, a
    URI, and are read back in pieces. ``spilled`` counts the bytes written. Without a folder nothing spills."""

    def __init__(self, kinds: tuple, folder: str | None = None, memory: int = MEMORY):
        self.kinds, self.folder, self.memory = [np.dtype(k) for k in kinds], folder, memory
        self.pieces: dict = {}
        self.used = self.spilled = 0
        self.files: list[str] = []
        self.fs = None

    def put(self, key, *columns: np.ndarray) -> None:
        self.pieces.setdefault(key, []).append(columns)
        self.used += sum(c.nbytes for c in columns)
        if self.folder and self.used > self.memory:
            self._spill()

    def _spill(self) -> None:
        from pyarrow import fs

        if self.fs is None:
            self.fs, self.root = fs.FileSystem.from_uri(self.folder)
            self.fs.create_dir(self.root, recursive=True)
        path, at = f"{self.root}/queue-{uuid.uuid4().hex}", 0
        self.files.append(path)
        with self.fs.open_output_stream(path) as out:
            for key, pieces in self.pieces.items():
                kept = [p for p in pieces if isinstance(p[0], str)]
                fresh = pieces[len(kept) :]
                if fresh:
                    n = sum(len(p[0]) for p in fresh)
                    for i, kind in enumerate(self.kinds):
                        out.write(np.concatenate([p[i] for p in fresh]).astype(kind, copy=False).tobytes())
                    kept.append((path, at, n))
                    at += n * sum(k.itemsize for k in self.kinds)
                    self.pieces[key] = kept
        self.spilled += at
        self.used = 0

    def _read(self, piece: tuple, a: int, b: int) -> tuple:
        path, at, n = piece
        out = []
        with self.fs.open_input_file(path) as f:
            for kind in self.kinds:
                out.append(np.frombuffer(f.read_at((b - a) * kind.itemsize, at + a * kind.itemsize), kind))
                at += n * kind.itemsize
        return tuple(out)

    def take(self, key, backwards: bool = False):
        """The tuples of a queue in pieces of at most CHUNK, first to last or last to first; the queue is empty then."""
        pieces = self.pieces.pop(key, [])
        self.used -= sum(c.nbytes for p in pieces if not isinstance(p[0], str) for c in p)
        for p in pieces[::-1] if backwards else pieces:
            stored = isinstance(p[0], str)
            n = p[2] if stored else len(p[0])
            cuts = [(i, min(i + CHUNK, n)) for i in range(0, n, CHUNK)]
            for a, b in cuts[::-1] if backwards else cuts:
                part = self._read(p, a, b) if stored else tuple(c[a:b] for c in p)
                yield tuple(c[::-1] for c in part) if backwards else part

    def close(self) -> None:
        for path in self.files:
            self.fs.delete_file(path)
        self.files, self.pieces = [], {}


def _run(s: np.ndarray, p: int) -> int:
    """Length of the run of one character at a position, to CAP."""
    part = s[p : p + CAP + 1]
    other = np.flatnonzero(part != part[0])
    return min(int(other[0]) if len(other) else len(part), CAP)


def _types(s: np.ndarray) -> np.ndarray:
    """Whether each suffix is smaller than the one a place on; the last, the end mark, is."""
    small = np.ones(len(s), bool)
    after = True
    for z in range(len(s) - 1, 0, -CHUNK):
        a = max(0, z - CHUNK)
        here, nxt = s[a:z], s[a + 1 : z + 1]
        known = here != nxt
        at = np.where(known, np.arange(z - a, dtype=np.int32), np.int32(z - a))
        at = np.minimum.accumulate(at[::-1])[::-1]
        less = np.append(here < nxt, after)
        small[a:z] = less[at]
        after = small[a]
    return small


class _Induction:
    """One pass: suffixes of one type in order, from the sorted suffixes of the other type.

    ``buckets`` are read in their order. In a bucket the induced suffixes come first: those that a suffix read before precedes
    by one place, of the pass's type; each is one longer in common with the induced one before it than the least common
    prefix between the two that they come from. Then come the seeds. ``seen(bucket, pos, lcp, induced)`` gets every tuple in order.
    """

    def __init__(self, s, flag, queues: Queues, with_lcp: bool):
        self.s, self.flag, self.queues, self.with_lcp = s, flag, queues, with_lcp
        self.low = np.zeros(256, np.uint8)

    def _spread(self, c: int, pos: np.ndarray, lcp: np.ndarray) -> None:
        """Puts what precedes the suffixes of a piece of bucket ``c`` where it belongs."""
        before = pos - 1
        at = np.flatnonzero(before >= 0)
        at = at[self.flag[before[at]]]
        first = self.s[before[at]]
        order = np.argsort(first, kind="stable")
        at, first = at[order], first[order]
        cuts = np.flatnonzero(first[1:] != first[:-1]) + 1
        heads = np.concatenate([[0], cuts]).astype(np.int64) if len(at) else np.zeros(0, np.int64)
        got = before[at].astype(np.int32)
        value = np.zeros(0, np.uint8)
        if self.with_lcp:
            least = np.minimum.accumulate(lcp)
            value = np.empty(len(at), np.uint8)
            if len(at):
                if len(at) > 1:
                    pairs = np.stack([at[:-1] + 1, at[1:] + 1], axis=1).ravel()
                    value[1:] = np.minimum.reduceat(np.append(lcp, lcp[-1:]), pairs)[::2]
                value[heads] = np.minimum(self.low[first[heads]], least[at[heads]])
            np.minimum(self.low, least[-1], out=self.low)
            if len(at):
                lasts = np.append(cuts, len(at)) - 1
                tail = np.append(np.minimum.accumulate(lcp[::-1])[::-1], np.uint8(CAP))
                self.low[first[heads]] = tail[at[lasts] + 1]
            value = np.minimum(value, CAP - 1) + np.uint8(1)
        ends = np.append(cuts, len(at))
        for h, e in zip(heads.tolist(), ends.tolist()):
            f = int(first[h])
            self.queues.put((f, True) if f == c else f, got[h:e], *([value[h:e]] if self.with_lcp else []))

    def run(self, buckets, seeds, seen) -> None:
        none = np.zeros(0, np.uint8)
        for c in buckets:
            self.low[:] = 0
            last, length, key = -1, 0, c
            while True:  # runs of one character: each round is one longer
                empty = True
                for pos, *rest in self.queues.take(key):
                    lcp = rest[0] if self.with_lcp else none
                    if self.with_lcp and empty:
                        lcp = lcp.copy()
                        lcp[0] = min(length, CAP)
                    empty = False
                    seen(c, pos, lcp, True)
                    self._spread(c, pos, lcp)
                    last = int(pos[-1])
                if empty:
                    break
                length, key = length + 1, (c, True)
                # what the round has put under its own key is read next
            begin = True
            for pos, lcp in seeds(c):
                if self.with_lcp and begin:
                    lcp = lcp.copy()
                    lcp[0] = min(_run(self.s, last), _run(self.s, int(pos[0]))) if last >= 0 else 0
                begin = False
                seen(c, pos, lcp, False)
                self._spread(c, pos, lcp)


def _words(s: np.ndarray, at: np.ndarray) -> np.ndarray:
    """The next 8 bytes (of bytes) or 2 ranks (of ranks) at each position as one number that sorts like them. Room after the end is zeros."""
    if s.dtype.itemsize == 1:
        return np.lib.stride_tricks.sliding_window_view(s, 8)[at].view(">u8").ravel().astype(np.uint64)
    return (s[at].astype(np.uint64) << np.uint64(32)) | s[at + 1].astype(np.uint64)


def _names(s: np.ndarray, starts: np.ndarray, depth: int) -> np.ndarray:
    """Ranks of the strings from each sampled position to the next one, both included, to ``depth`` characters. A string that begins another is the larger."""
    width, bits = 8 // s.dtype.itemsize, 8 * s.dtype.itemsize
    size = np.append(np.diff(starts) + 1, 1)
    s = np.append(s, np.zeros(width, s.dtype))
    name = np.zeros(len(starts), np.int32)
    rest = np.arange(len(starts))
    for k in range(0, depth, width):
        word = np.zeros(len(rest), np.uint64)
        for a in range(0, len(rest), CHUNK):
            some = rest[a : a + CHUNK]
            over = np.clip(k + width - size[some], 0, width)
            high = np.array([(1 << (bits * i)) - 1 for i in range(width + 1)], np.uint64)
            word[a : a + CHUNK] = _words(s, starts[some].astype(np.int64) + k) | high[over]
        if k == 0:
            name[:] = np.searchsorted(np.unique(word), word)
        else:
            order = np.lexsort((word, name[rest]))
            r, w = rest[order], word[order]
            grows = np.concatenate([[False], (w[1:] != w[:-1]) & (name[r][1:] == name[r][:-1])])
            head = np.concatenate([[True], name[r][1:] != name[r][:-1]])
            more = np.cumsum(grows)
            inside = more - np.maximum.accumulate(np.where(head, more, 0))
            moved = np.cumsum(np.bincount(name[r][grows] + 1, minlength=int(name.max()) + 2))
            name += moved[name].astype(np.int32)
            name[r] += inside.astype(np.int32)
        rest = rest[size[rest] >= k + width]
        if not len(rest):
            break
    return name


def _doubled(name: np.ndarray, depth: int) -> np.ndarray:
    """Suffix order of a short string of ranks by prefix doubling; what stands alone is not looked at again."""
    rank = name.astype(np.int64)
    order = np.argsort(rank, kind="stable")
    width = 1
    first = np.concatenate([[True], rank[order][1:] != rank[order][:-1]])
    rank[order] = np.maximum.accumulate(np.where(first, np.arange(len(rank)), 0))
    while width < depth:
        head = np.flatnonzero(first)
        alone = np.diff(np.append(head, len(rank))) == 1
        mark = np.zeros(len(rank), bool)
        mark[head[alone]] = True
        open_ = np.flatnonzero(~mark)
        if not len(open_):
            break
        who = order[open_]
        after = np.where(who + width < len(rank), rank[np.minimum(who + width, len(rank) - 1)], -1)
        key = rank[who] * (len(rank) + 1) + after + 1
        sub = np.argsort(key)
        order[open_] = who[sub]
        del who, after
        key = key[sub]
        change = np.concatenate([[True], key[1:] != key[:-1]])
        first[open_] |= change
        rank[order[open_]] = open_[np.maximum.accumulate(np.where(change, np.arange(len(open_)), 0))]
        width *= 2
    return order.astype(np.int32)


def _order(s: np.ndarray, depth: int, folder: str | None, memory: int) -> np.ndarray:
    """Suffix order of a string of ranks that ends in a single least one: by induction from its own sample while it is long."""
    if len(s) <= BASE:
        return _doubled(s, depth)
    small = _types(s)
    sample = (np.flatnonzero(small[1:] & ~small[:-1]) + 1).astype(np.int32)
    name = _names(s, sample, depth)
    top = int(s.max())
    sorted_sample = sample[_order(name, depth // 2 + 2, folder, memory)]
    groups = np.searchsorted(s[sorted_sample], np.arange(top + 2))
    queues, large = Queues((np.int32,), folder, memory), Queues((np.int32,), folder, memory)
    none = np.zeros(0, np.uint8)
    _Induction(s, ~small, queues, False).run(range(top + 1), lambda c: [(sorted_sample[groups[c] : groups[c + 1]], none)] if groups[c + 1] > groups[c] else [], lambda c, pos, lcp, own: large.put(c, pos) if own else None)
    end = np.array([len(s) - 1], np.int32)
    parts: list[np.ndarray] = []
    back = lambda c: [(end, none)] if c == 0 else ((p, none) for (p,) in large.take(c, True))
    _Induction(s, small, queues, False).run(range(top, -1, -1), back, lambda c, pos, lcp, own: parts.append(pos))
    queues.close()
    large.close()
    return np.concatenate(parts)[::-1]


def visit_suffixes(s: np.ndarray, seen, depth: int = 100, folder: str | None = None, memory: int | None = None) -> int:
    """Calls ``seen(positions, common prefix with the one before)`` with pieces of all suffixes of ``s`` in descending order of
    their first ``depth`` characters at least; ties beyond are in any order. Returns the bytes that went to ``folder``.

    ``s`` holds bytes of at most 246; its last one is the only 0. Common prefixes are exact to ``depth`` at least.

    1. Suffixes smaller than the next one and after a larger one, a third of all or less, are the sample. The strings between
       them are ranked, and the string of ranks, a third as long, is sorted in the same way; in memory once it is short (BASE).
    2. Larger-type suffixes are induced from the sample in ascending order, and kept in queues.
    3. Smaller-type suffixes are induced from those in descending order, and all suffixes pass by in that order.
    """
    memory = MEMORY if memory is None else memory
    small = _types(s)
    sample = (np.flatnonzero(small[1:] & ~small[:-1]) + 1).astype(np.int32)
    if len(s) < 2:
        return 0
    name = _names(s, sample, depth + 8)
    sample = sample[_order(name, depth // 2 + 2, folder, memory)]
    del name
    lcp = np.zeros(len(sample), np.uint8)
    padded = np.append(s, np.zeros(CAP + 8, np.uint8))
    for a in range(0, len(sample), CHUNK):
        b = min(a + CHUNK, len(sample))
        x, y = sample[max(a - 1, 0) : b - 1].astype(np.int64), sample[max(a, 1) : b].astype(np.int64)
        lcp[max(a, 1) : b] = _common(padded, x, y, depth)
    del padded
    groups = np.searchsorted(s[sample], np.arange(257))
    kinds = (np.int32, np.uint8)
    queues, large = Queues(kinds, folder, memory), Queues(kinds, folder, memory)

    def seeds(c):
        for a in range(groups[c], groups[c + 1], CHUNK):
            b = min(a + CHUNK, groups[c + 1])
            yield sample[a:b], lcp[a:b]

    def backwards(c):
        if c == 0:
            yield np.array([len(s) - 1], np.int32), np.zeros(1, np.uint8)
            return
        carry = np.uint8(0)
        for pos, before in large.take(c, True):
            yield pos, np.append(carry, before[:-1])
            carry = before[-1]

    _Induction(s, ~small, queues, True).run(range(256), seeds, lambda c, pos, v, own: large.put(c, pos, v) if own else None)
    del sample, lcp
    _Induction(s, small, queues, True).run(range(255, -1, -1), backwards, lambda c, pos, v, own: seen(pos, v))
    spilled = queues.spilled + large.spilled
    queues.close()
    large.close()
    return spilled


def _common(s: np.ndarray, x: np.ndarray, y: np.ndarray, depth: int) -> np.ndarray:
    """Common prefix of the suffixes at x and y, counted on the text itself, to CAP. The end mark ends it."""
    out = np.zeros(len(x), np.uint8)
    at = np.arange(len(x))
    for k in range(0, min(depth + 8, CAP - 7), 8):
        differ = _words(s, x[at] + k) ^ _words(s, y[at] + k)
        lead = np.zeros(len(at), np.uint8)
        for b in range(1, 9):
            lead += (differ >> np.uint64(64 - 8 * b)) == 0
        out[at] += lead
        at = at[differ == 0]
        if not len(at):
            break
    return np.minimum(out, CAP)
