"""A suffix array of contexts over one shard of a corpus, and vectorised longest-match search in it.

A shard is a run of documents, each as START, its tokens and END; tokens are 64-bit hashes. Position p stands after
token p - 1; its context is the tokens before it, nearest first, back to its document's START. Positions are sorted by
context, by prefix doubling with only the unresolved groups sorted again, so contexts that share their nearest m tokens
stand together for every m.

For each position of a query text the search narrows a range of the array: by binary search on the next token, and
after a few tokens, by binary search for the place of the whole context, compared by rolling hashes. It ends
where no context of the shard has the query's next token: the longest match, of any length, and how often it occurs.
"""

from __future__ import annotations

import numpy as np

START, END = np.uint64(1), np.uint64(2)
BASE = 0x9E3779B97F4A7C15
_PLAIN = 6  # tokens that are matched one by one before stretches are tried


def powers(n: int, base: int) -> np.ndarray:
    """base**0 to base**n, modulo 2**64."""
    out = np.empty(n + 1, np.uint64)
    out[0] = 1
    size = 1
    while size <= n:
        m = min(size, n + 1 - size)
        out[size : size + m] = out[:m] * np.uint64(pow(base, size, 1 << 64))
        size += m
    return out


def rolled(tokens: np.ndarray) -> np.ndarray:
    """r with hash(tokens[a:b]) = r[b] - r[a] * base**(b - a), modulo 2**64, without a loop over tokens."""
    out = np.zeros(len(tokens) + 1, np.uint64)
    np.cumsum(tokens * powers(len(tokens), pow(BASE, -1, 1 << 64))[1:], dtype=np.uint64, out=out[1:])
    out *= powers(len(tokens), BASE)
    return out


class Shard:
    def __init__(self, documents: list[np.ndarray]):
        """documents: token hashes of each, without START and END."""
        sizes = np.array([len(d) + 2 for d in documents], np.int64)
        n = int(sizes.sum())
        self.tokens = np.empty(n, np.uint64)
        ends = np.cumsum(sizes)
        starts = ends - sizes
        self.tokens[starts] = START
        self.tokens[ends - 1] = END
        inner = np.ones(n, bool)
        inner[starts] = inner[ends - 1] = False
        if documents:
            self.tokens[inner] = np.concatenate(documents)
        self.sizes, self.ends_of = sizes, ends
        self.most = int(sizes.max(initial=1))
        self.power = powers(self.most, BASE)
        self.vocabulary, ids = np.unique(self.tokens, return_inverse=True)
        self.ids = ids.astype(np.int32)
        del ids, inner
        self.order = self._sorted(n)
        counts = np.bincount(self.ids, minlength=len(self.vocabulary))
        self.ends = np.cumsum(counts)  # of the ranges of contexts by their nearest token
        self.starts = self.ends - counts
        self.pairs = self._pair(self.order)  # ascending
        self.rolled = rolled(self.tokens)
        del self.tokens

    def _pair(self, at: np.ndarray) -> np.ndarray:
        """The two nearest tokens of each position as one number; at a shard's very start the second counts as 0."""
        second = np.where(at > 1, self.ids[np.maximum(at - 2, 0)] + 1, 0)
        return self.ids[at - 1].astype(np.int64) << 32 | second

    def _sorted(self, n: int) -> np.ndarray:
        """Positions 1 to n by context."""
        keys = self._pair(np.arange(1, n + 1))
        order = np.argsort(keys) + 1
        rank = np.zeros(n + 1, np.int64)
        loose = self._rank(order, keys[order - 1], np.arange(n), rank)
        del keys
        step = 2
        while len(loose) and step <= self.most:
            at = order[loose]
            key = rank[at] << 32 | rank[np.maximum(at - step, 0)]
            again = np.argsort(key)
            order[loose] = at[again]
            loose = self._rank(order, key[again], loose, rank)
            step *= 2
        return order.astype(np.int32)

    @staticmethod
    def _rank(order: np.ndarray, keys: np.ndarray, places: np.ndarray, rank: np.ndarray) -> np.ndarray:
        """Sets ranks (the place of a group's first member, plus 1) at the given places and returns the places of groups of two and more."""
        first = np.ones(len(keys), bool)
        first[1:] = keys[1:] != keys[:-1]
        group = np.cumsum(first) - 1
        rank[order[places]] = places[first][group] + 1
        return places[np.bincount(group)[group] > 1]

    def _stretch(self, a_rolled: np.ndarray, a: np.ndarray, b_rolled: np.ndarray, b: np.ndarray, most: np.ndarray, least: np.ndarray) -> np.ndarray:
        """How many of the tokens before a and b agree, known to be ``least`` at least and ``most`` at most."""
        low, high = least.copy(), most.copy()
        live = np.flatnonzero(low < high)
        while len(live):
            middle = (low[live] + high[live] + 1) >> 1
            p, q = a[live], b[live]
            scale = self.power[middle]
            same = a_rolled[p] - a_rolled[p - middle] * scale == b_rolled[q] - b_rolled[q - middle] * scale
            low[live] = np.where(same, middle, low[live])
            high[live] = np.where(same, high[live], middle - 1)
            live = live[low[live] < high[live]]
        return low

    def _agree(self, own: np.ndarray, end: np.ndarray, at: np.ndarray, most: np.ndarray, least: np.ndarray) -> np.ndarray:
        """How many tokens the query's contexts and the array's at those places share."""
        a = self.order[at].astype(np.int64)
        together = np.minimum(np.minimum(a, most), self.most)
        return self._stretch(self.rolled, a, own, end, together, np.minimum(least, together))

    def _whole(self, own: np.ndarray, end: np.ndarray, room: np.ndarray, ids: np.ndarray, low: np.ndarray, high: np.ndarray, depth: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(low, high, depth) of the longest matches within ranges that share depth tokens with the query: binary search for the place of the
        whole context, whose neighbours share most with it, and for the range that shares as much. However alike the contexts are, it takes
        logarithmic steps."""
        first, last = low.copy(), high.copy()
        live = np.flatnonzero(first < last)
        while len(live):
            middle = (first[live] + last[live]) >> 1
            shared = self._agree(own, end[live], middle, room[live], depth[live])
            at = self.order[middle].astype(np.int64) - shared - 1
            have = np.where(at >= 0, self.ids[np.maximum(at, 0)], -1)
            below = (shared < room[live]) & (have < ids[np.maximum(end[live] - shared - 1, 0)])
            first[live] = np.where(below, middle + 1, first[live])
            last[live] = np.where(below, last[live], middle)
            live = live[first[live] < last[live]]
        place = first
        before, after = np.maximum(place - 1, low), np.minimum(place, high - 1)
        best = np.maximum(self._agree(own, end, before, room, depth), self._agree(own, end, after, room, depth))
        wanted = own[end] - own[end - best] * self.power[best]
        ends = []
        for right in (False, True):
            first, last = (place.copy(), high.copy()) if right else (low.copy(), place.copy())
            live = np.flatnonzero(first < last)
            while len(live):
                middle = (first[live] + last[live]) >> 1
                a, m = self.order[middle].astype(np.int64), best[live]
                same = (a >= m) & (self.rolled[a] - self.rolled[np.maximum(a - m, 0)] * self.power[m] == wanted[live])
                up = same if right else ~same
                first[live] = np.where(up, middle + 1, first[live])
                last[live] = np.where(up, last[live], middle)
                live = live[first[live] < last[live]]
            ends.append(first)
        return ends[0], ends[1], best

    def _bound(self, low: np.ndarray, high: np.ndarray, depth: np.ndarray, want: np.ndarray, right: bool) -> np.ndarray:
        """In each range, the first place whose token at that depth is not below (right: is above) the wanted one."""
        low, high = low.copy(), high.copy()
        live = np.flatnonzero(low < high)
        while len(live):
            middle = (low[live] + high[live]) >> 1
            at = self.order[middle] - depth[live] - 1
            have = np.where(at >= 0, self.ids[np.maximum(at, 0)], -1)
            left = have <= want[live] if right else have < want[live]
            low[live] = np.where(left, middle + 1, low[live])
            high[live] = np.where(left, high[live], middle)
            live = live[low[live] < high[live]]
        return low

    def whole_counts(self) -> np.ndarray:
        """For each token of the documents in order, START and END included, how many positions have the same whole context as the one after it: the sizes of ranges of the array."""
        at = self.order.astype(np.int64)
        room = np.arange(1, len(at) + 1) - np.repeat(self.ends_of - self.sizes, self.sizes)
        own = room[at - 1]
        whole = self.rolled[at] - self.rolled[at - own] * self.power[own]
        new = np.ones(len(at), bool)
        new[1:] = (own[1:] != own[:-1]) | (whole[1:] != whole[:-1])
        group = np.cumsum(new) - 1
        out = np.empty(len(at), np.int64)
        out[at - 1] = np.bincount(group)[group] if len(at) else 0
        return out

    def longest_of(self, documents: list[np.ndarray]) -> list[tuple[np.ndarray, np.ndarray]]:
        """(length, occurrences) for the len(document) + 2 positions after START, each token, and END of each document. START counts as a token of the context."""
        if not documents:
            return []
        sizes = np.array([len(d) + 2 for d in documents])
        text = np.concatenate([x for d in documents for x in (np.array([START]), d, np.array([END]))])
        lengths, counts = self.longest(text, np.arange(1, len(text) + 1) - np.repeat(np.cumsum(sizes) - sizes, sizes))
        cuts = np.cumsum(sizes)[:-1]
        return list(zip(np.split(lengths, cuts), np.split(counts, cuts), strict=True))

    def longest(self, text: np.ndarray, room: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(length, occurrences) of the longest match of the context after each token of ``text``, of at most ``room`` tokens. Best for about a million tokens."""
        total = len(text)
        own = rolled(text)
        found = np.searchsorted(self.vocabulary, text)
        found[found == len(self.vocabulary)] = 0
        ids = np.where(self.vocabulary[found] == text, found, -2) if len(self.vocabulary) else np.full(total, -2)
        end = np.arange(1, total + 1)  # position: index after its nearest token
        low, high = np.zeros(total, np.int64), np.full(total, len(self.order))
        depth = np.zeros(total, np.int64)
        live = np.flatnonzero(ids >= 0)
        low[live], high[live], depth[live] = self.starts[ids[live]], self.ends[ids[live]], 1
        live = live[(room[live] > 1) & (ids[np.maximum(live - 1, 0)] >= 0)]
        pair = ids[live].astype(np.int64) << 32 | ids[live - 1] + 1
        by = np.argsort(pair)  # needles in order are found faster
        live, pair = live[by], pair[by]
        left, right = np.searchsorted(self.pairs, pair, "left"), np.searchsorted(self.pairs, pair, "right")
        some = right > left
        live = live[some]
        low[live], high[live], depth[live] = left[some], right[some], 2
        while len(live):
            far = live[depth[live] >= _PLAIN]
            if len(far):
                low[far], high[far], depth[far] = self._whole(own, end[far], room[far], ids, low[far], high[far], depth[far])
                live = np.setdiff1d(live, far, assume_unique=True)
            live = live[depth[live] < room[live]]
            want = ids[end[live] - depth[live] - 1]
            live, want = live[want >= 0], want[want >= 0]
            lone = high[live] - low[live] == 1
            one, more = live[lone], live[~lone]
            at = self.order[low[one]] - depth[one] - 1
            one = one[(at >= 0) & (self.ids[np.maximum(at, 0)] == want[lone])]
            left = self._bound(low[more], high[more], depth[more], want[~lone], False)
            right = self._bound(left, high[more], depth[more], want[~lone], True)
            some = right > left
            more = more[some]
            low[more], high[more] = left[some], right[some]
            live = np.concatenate([one, more])
            depth[live] += 1
        return depth, high - low
