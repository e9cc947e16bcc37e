"""Sparse suffix arrays over content-chosen positions, and a logarithmic family of them.

Every window of `MIN` bytes holds an anchor: the leftmost of its k-mers with the smallest hash.
Equal windows hold the same anchor at the same place, so comparing the text around anchors finds
all of them. A suffix array here sorts anchors by the text from the anchor on; a second order sorts
them by the reversed text before it; with the common-prefix lengths of both, the window that begins
a bytes before an anchor equals another one if a bytes to the left and MIN - a to the right agree.
"""

from __future__ import annotations

import numpy as np

MIN, K = 50, 16
#: Places for an anchor in a window, and so windows around an anchor.
PLACES = MIN - K + 1
LEFT_WORDS, RIGHT_WORDS = -(-(PLACES - 1) // 8), -(-MIN // 8)
_CHUNK = 1 << 18


def mix(x: np.ndarray) -> np.ndarray:
    x = x * np.uint64(0x9E3779B97F4A7C15)
    x ^= x >> np.uint64(29)
    x *= np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(32)
    return x


def lanes(data: np.ndarray) -> np.ndarray:
    """The 8 bytes from each position as a number, first byte lowest. data ends in 8 spare bytes."""
    return np.ndarray((len(data) - 7,), np.uint64, data.data, strides=(1,))


def kmer_hashes(words: np.ndarray, at: np.ndarray | slice, shifted: np.ndarray | slice) -> np.ndarray:
    return mix(mix(words[at]) ^ words[shifted])


def sliding(a: np.ndarray, width: int, best) -> np.ndarray:
    """best over each run of `width` neighbours, by doubling."""
    have = 1
    while have * 2 <= width:
        a = best(a[:-have], a[have:])
        have *= 2
    return best(a[: len(a) - (width - have)], a[width - have :]) if have < width else a


def anchors_of(padded: np.ndarray, n: int) -> np.ndarray:
    """Positions that are the smallest of some window, for n bytes followed by spare ones; windows
    across documents may add some, which `places` then leaves without a window."""
    found = []
    words = lanes(padded)
    for lo in range(0, max(0, n - MIN + 1), _CHUNK):
        hi = min(n - MIN + 1, lo + _CHUNK)  # windows that begin in [lo, hi)
        h = kmer_hashes(words, slice(lo, hi + PLACES - 1), slice(lo + 8, hi + PLACES + 7))
        least = sliding(h, PLACES, np.minimum)
        edge = np.zeros(PLACES - 1, np.uint64)
        most = sliding(np.concatenate([edge, least, edge]), PLACES, np.maximum)
        found.append(np.flatnonzero(most == h) + lo)
    return np.unique(np.concatenate(found)) if found else np.zeros(0, np.int64)


def places(pos: np.ndarray, h: np.ndarray, begin: np.ndarray, end: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(first, last) of the distances a such that the window from a bytes before the anchor lies in
    its document and has the anchor as the leftmost smallest; first > last if there is none."""
    n = len(pos)
    low = np.maximum(pos - (PLACES - 1), begin)  # where windows may begin
    high = np.minimum(pos, end - MIN)
    for j in range(1, PLACES):
        if n <= j:
            break
        gap = pos[j:] - pos[:-j] < PLACES
        if not gap.any():
            break
        left = gap & (h[:-j] <= h[j:])
        low[j:] = np.where(left, np.maximum(low[j:], pos[:-j] + 1), low[j:])
        right = gap & (h[j:] < h[:-j])
        high[:-j] = np.where(right, np.minimum(high[:-j], pos[j:] - PLACES), high[:-j])
    return pos - high, pos - low


def sides(padded: np.ndarray, front: int, pos: np.ndarray, first: np.ndarray, last: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The text before each anchor, reversed, and from it on, as big-endian numbers in columns; what
    the anchor's windows don't reach is zero. padded has `front` spare bytes before the text."""
    left = padded[front + pos[:, None] - 1 - np.arange(LEFT_WORDS * 8)]
    left[np.arange(LEFT_WORDS * 8) >= last[:, None]] = 0
    right = padded[front + pos[:, None] + np.arange(RIGHT_WORDS * 8)]
    right[np.arange(RIGHT_WORDS * 8) >= MIN - first[:, None]] = 0
    return left.view(">u8").astype(np.uint64), right.view(">u8").astype(np.uint64)


def sorted_order(words: np.ndarray, start: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
    """The lexicographic order of rows, and each sorted row's common bytes with the one before.

    Word by word; only rows that are still tied are sorted further. start: rows in an order that is
    made of sorted runs, which the stable sort merges in one pass instead of sorting anew."""
    n, width = words.shape
    start = np.arange(n) if start is None else start
    order = start[np.argsort(words[start, 0], kind="stable")] if n else np.zeros(0, np.int64)
    lcp = np.zeros(n, np.int64)
    if not n:
        return order, lcp
    group = np.zeros(n, np.int64)
    slots = np.arange(n)
    for w in range(width):
        if w:
            by = np.lexsort((words[order[slots], w], group[slots]))
            order[slots] = order[slots][by]
        column = words[order[slots], w]
        same = np.zeros(len(slots), bool)
        same[1:] = group[slots][1:] == group[slots][:-1]
        differ = same.copy()
        differ[1:] &= column[1:] != column[:-1]
        rows = np.flatnonzero(differ)
        lcp[slots[rows]] = 8 * w + _common_bytes(column[rows] ^ column[rows - 1])
        head = ~same | differ
        lcp[slots[same & ~differ]] = 8 * (w + 1)
        group[slots] = slots[np.maximum.accumulate(np.where(head, np.arange(len(slots)), 0))]
        alone = head & np.concatenate([head[1:], [True]])
        slots = slots[~alone]
        if not len(slots):
            break
    return order, lcp


def _common_bytes(x: np.ndarray) -> np.ndarray:
    """Leading zero bytes of nonzero numbers."""
    out = np.zeros(len(x), np.int64)
    for shift, step in ((32, 4), (16, 2), (8, 1)):
        zero = x >> np.uint64(64 - shift) == 0
        out += step * zero
        x = np.where(zero, x << np.uint64(shift), x)
    return out


class Level:
    """Contexts of anchors, with their suffix orders. doc: the smallest document that a context occurs
    in; name: numbers its creator gives; hit: bit a is set if the window from a bytes before the
    anchor begins in a smaller document too, so far as merged; by_right, by_left: the orders of the
    text from the anchor on and, reversed, before it."""

    def __init__(self, left, right, first, last, doc, name, batches: int = 1):
        self.left, self.right, self.first, self.last = left, right, first, last
        self.doc, self.name, self.batches = doc, name, batches
        self.hit = np.zeros(len(doc), np.uint64)
        self.by_right = self.by_left = None

    @classmethod
    def merged(cls, parts: list[Level]) -> Level:
        out = cls(*(np.concatenate([getattr(p, f) for p in parts]) for f in ("left", "right", "first", "last", "doc", "name")), sum(p.batches for p in parts))
        out.hit = np.concatenate([p.hit for p in parts])
        begins = np.cumsum([0, *(len(p.doc) for p in parts)]).tolist()
        out.by_right, out.by_left = (np.concatenate([getattr(p, f) + b for p, b in zip(parts, begins, strict=False)]) for f in ("by_right", "by_left"))
        return out

    def scan(self) -> None:
        """Finds equal windows among the contexts by both orders and their common prefixes. A level
        merged from others merges their orders.

        What a context shares with any other is what it shares with its neighbours in an order, so
        contexts whose two neighbours' shares don't make a window are left out first."""
        n = len(self.doc)
        self.by_right, right_lcp = sorted_order(self.right, self.by_right)
        self.by_left, left_lcp = sorted_order(self.left, self.by_left)
        shared = []
        for order, lcp in ((self.by_right, right_lcp), (self.by_left, left_lcp)):
            most = np.empty(n, np.int64)
            most[order] = np.maximum(lcp, np.append(lcp[1:], 0))
            shared.append(most)
        low, high = np.maximum(self.first, MIN - shared[0]), np.minimum(self.last, shared[1])
        some = low <= high
        kept = np.flatnonzero(some)
        if len(kept) < 2:
            return
        low, high, doc = low[kept], high[kept], self.doc[kept]
        place = np.cumsum(some) - 1
        (by_right, right_lcp), (by_left, left_lcp) = (_only(order, lcp, some, place) for order, lcp in ((self.by_right, right_lcp), (self.by_left, left_lcp)))
        right, left = np.empty(len(kept), np.int64), np.empty(len(kept), np.int64)
        for a in range(PLACES):
            rows = np.flatnonzero((low <= a) & (a <= high))
            if len(rows) < 2:
                continue
            right[by_right] = np.cumsum(right_lcp < MIN - a)
            left[by_left] = np.cumsum(left_lcp < a) if a else 0
            key = left[rows] << 32 | right[rows]
            order = np.argsort(key, kind="stable")
            key = key[order]
            starts = np.flatnonzero(np.concatenate([[True], key[1:] != key[:-1]]))
            if len(starts) == len(rows):
                continue
            docs = doc[rows][order]
            least = np.repeat(np.minimum.reduceat(docs, starts), np.diff(np.append(starts, len(rows))))
            self.hit[kept[rows[order[docs > least]]]] |= np.uint64(1 << a)


def _only(order: np.ndarray, lcp: np.ndarray, some: np.ndarray, place: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """An order and its common prefixes over some of the rows, which are numbered by place."""
    at = np.flatnonzero(some[order])
    between = np.minimum.reduceat(lcp[: at[-1] + 1], np.append(0, at[:-1] + 1)) if len(at) else lcp
    return place[order[at]], between


class Family:
    """Levels of sizes that double. A new batch becomes a level of its own; while the two last levels
    hold equally many batches they are merged, and a merge scans both for equal windows. Once all
    are merged, every batch has met every other one, in about log2(batches) merges."""

    def __init__(self):
        self.levels: list[Level] = []

    def add(self, batch: Level) -> None:
        batch.scan()
        self.levels.append(batch)
        while len(self.levels) > 1 and self.levels[-1].batches >= self.levels[-2].batches:
            self._merge(2)

    def _merge(self, count: int) -> None:
        level = Level.merged(self.levels[-count:])
        level.scan()
        self.levels[-count:] = [level]

    def finish(self) -> Level | None:
        """All contexts with all their hits."""
        while len(self.levels) > 1:
            self._merge(2)
        return self.levels[0] if self.levels else None
