"""An n-gram trie of three levels in Elias-Fano form, searched for many n-grams at once.

Words of a context, its successors and its predecessors are rising sequences of numbers, kept as low
bits beside a unary code of the high ones; so are the pointers from each node to its children. A trigram's last word is
written as its place among the successors of the word before it, which is a small number. Probabilities and
backoffs are smoothed when the trie is made and quantised to 16 bits, as whole steps of a logarithm. All
levels lie in one block of mapped memory, which is only viewed and never unpacked.
"""

from __future__ import annotations

import mmap

import numpy as np

U64 = np.uint64
#: Quantised steps of a unit of -log10.
STEPS = 2048
_EACH, _TOPS = U64(0x0101010101010101), U64(0x8080808080808080)
_SELECT = np.full((256, 8), 8, np.uint8)
for _byte in range(256):
    for _k, _bit in enumerate([b for b in range(8) if _byte >> b & 1]):
        _SELECT[_byte, _k] = _bit


def quantised(p: np.ndarray) -> np.ndarray:
    """-log10 of probabilities in whole steps."""
    return np.clip(np.rint(-np.log10(p) * STEPS), 0, 65535).astype(np.uint16)


def probability(code: np.ndarray) -> np.ndarray:
    return 10.0 ** (code.astype(np.float64) / -STEPS)


class Rising:
    """A sequence that never falls, in Elias-Fano form: views of four arrays of 64-bit words."""

    def __init__(self, arrays: list[np.ndarray]):
        (self.n, self.width), self.low, self.high, self.ones = arrays[0].tolist(), *arrays[1:]
        self.mask = U64((1 << self.width) - 1)

    @staticmethod
    def arrays(values: np.ndarray) -> list[np.ndarray]:
        values = values.astype(U64)
        n = len(values)
        width = max(0, ((int(values[-1]) + 1) // n).bit_length() - 1) if n else 0
        low = np.zeros(n * width // 64 + 2, U64)
        if width:
            rest, at = values & U64((1 << width) - 1), np.arange(n) * width
            shift = (at & 63).astype(U64)
            np.bitwise_or.at(low, at >> 6, rest << shift)
            over = np.flatnonzero(shift + U64(width) > U64(64))
            np.bitwise_or.at(low, (at[over] >> 6) + 1, rest[over] >> (U64(64) - shift[over]))
        place = (values >> U64(width)).astype(np.int64) + np.arange(n)
        bits = np.zeros(((int(place[-1]) + 2 if n else 1) // 64 + 1) * 64, bool)
        bits[place] = True
        high = np.packbits(bits, bitorder="little").view(U64)
        return [np.array([n, width], U64), low, high, np.concatenate([np.zeros(1, U64), np.cumsum(np.bitwise_count(high), dtype=U64)])]

    @staticmethod
    def _select(words: np.ndarray, k: np.ndarray) -> np.ndarray:
        """Place of the k-th (from 0) set bit of each word, by its bytes side by side."""
        k = k.astype(U64)
        total = words - ((words >> U64(1)) & U64(0x5555555555555555))
        total = (total & U64(0x3333333333333333)) + ((total >> U64(2)) & U64(0x3333333333333333))
        total = ((total + (total >> U64(4))) & U64(0x0F0F0F0F0F0F0F0F)) * _EACH  # bits up to each byte's end
        byte = np.bitwise_count((((k * _EACH) | _TOPS) - total) & _TOPS).astype(U64) * U64(8)
        left = k - (((total << U64(8)) >> byte) & U64(255))
        return (byte + _SELECT[((words >> byte) & U64(255)).astype(np.int64), left.astype(np.int64)]).astype(np.int64)

    def _rest(self, i: np.ndarray) -> np.ndarray:
        at = i * self.width
        word, shift = at >> 6, (at & 63).astype(U64)
        # two shifts, as one by 64 says nothing
        return ((self.low[word] >> shift) | ((self.low[word + 1] << (U64(63) - shift)) << U64(1))) & self.mask

    def at(self, i: np.ndarray) -> np.ndarray:
        """The values at these places."""
        word = np.searchsorted(self.ones, i.astype(U64), side="right") - 1
        place = word * 64 + self._select(self.high[word], i - self.ones[word].astype(np.int64))
        return ((place - i).astype(U64) << U64(self.width)) | self._rest(i)

    def _before(self, h: np.ndarray) -> np.ndarray:
        """How many values have high bits below h: the place of the zero that ends those, less the zeros."""
        zeros = np.arange(len(self.ones), dtype=np.int64) * 64 - self.ones.astype(np.int64)
        k = np.maximum(h - 1, 0)
        word = np.searchsorted(zeros, k, side="right") - 1
        inside = word < len(self.high)
        word = np.minimum(word, len(self.high) - 1)
        place = word * 64 + self._select(~self.high[word], np.where(inside, k - zeros[word], 0))
        return np.where(h == 0, 0, np.where(inside, np.minimum(place - k, self.n), self.n))

    def find(self, value: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The first place of a value that isn't below each of these, and whether it is equal: successor search."""
        h = (value >> U64(self.width)).astype(np.int64)
        rest = value & self.mask
        i, end = self._before(h), self._before(h + 1)
        j = end.copy()
        while (open_ := np.flatnonzero(i < j)).size:
            mid = (i[open_] + j[open_]) >> 1
            less = self._rest(mid) < rest[open_]
            i[open_[less]] = mid[less] + 1
            j[open_[~less]] = mid[~less]
        equal = i < end
        there = np.flatnonzero(equal)
        equal[there] = self._rest(i[there]) == rest[there]
        return i, equal


def _relative(values: np.ndarray, start: np.ndarray) -> np.ndarray:
    """Rising values of ranges, one after another, made one rising sequence: each range begins above the last value before it."""
    sizes = np.diff(start)
    full = np.flatnonzero(sizes)
    last = values[start[1:][full] - 1].astype(np.int64) + 1
    base = np.zeros(len(sizes), np.int64)
    base[full] = np.cumsum(last) - last
    return values.astype(np.int64) + np.repeat(base, sizes)


class Trie:
    """Words v with their successors w, and contexts (v, u), u before v, with theirs."""

    RISING = ("words", "to_next", "next", "to_before", "before", "to_last", "last")
    CODES = ("next_code", "word_backoff", "last_code", "pair_backoff")

    def __init__(self, block: memoryview | mmap.mmap, sizes: list[int]):
        views, at = [], 0
        for n in sizes:
            views.append(np.frombuffer(block, U64, n, at))
            at += n * 8
        for k, name in enumerate(self.RISING):
            setattr(self, name, Rising(views[4 * k : 4 * k + 4]))
        for k, name in enumerate(self.CODES):
            setattr(self, name, views[4 * len(self.RISING) + k].view(np.uint16))

    @classmethod
    def build(cls, v: np.ndarray, u: np.ndarray, w: np.ndarray, count: np.ndarray, one: np.ndarray, hot_words: dict | None = None, hot_pairs: dict | None = None) -> Trie:
        """Of distinct trigrams (u, v, w) sorted by v, u and w, with their counts and the code of
        the unigram probability of w. hot_words has of words v whose trigrams are elsewhere as well (w in
        order, their counts); hot_pairs of such (v, u) the count and number of successors. Trigrams of no count
        stand for what is asked of those; nothing else of them is kept.

        Witten-Bell smoothing: a context that is seen c times, with t distinct successors, leaves t / (c + t) to
        the shorter context.
        """
        new = np.ones(len(v), bool)
        new[1:] = v[1:] != v[:-1]
        words, of = v[new], np.cumsum(new) - 1
        # successors of single words
        order = np.lexsort((w, of))
        first = np.ones(len(v), bool)
        first[1:] = (of[order][1:] != of[order][:-1]) | (w[order][1:] != w[order][:-1])
        head = np.flatnonzero(first)
        b_of, b_w, b_one = of[order][head], w[order][head], one[order][head]
        b_count = np.add.reduceat(count[order], head) if len(head) else count[:0]
        seen, kinds = np.bincount(of, count, len(words)), np.bincount(b_of, b_count > 0, len(words))
        for word, (successors, counts) in (hot_words or {}).items():
            k = np.flatnonzero(words == word)
            if len(k):
                own = np.flatnonzero(b_of == k[0])
                at = np.minimum(np.searchsorted(successors, b_w[own]), len(successors) - 1)
                b_count[own] = np.where(successors[at] == b_w[own], counts[at], 0)
                seen[k[0]], kinds[k[0]] = counts.sum(), len(counts)
        b_kept = b_count > 0
        rank = np.empty(len(v), np.int64)  # of each trigram's end among the ends that are kept
        rank[order] = (np.cumsum(b_kept) - 1)[np.cumsum(first) - 1] if len(v) else 0
        b_of, b_w, b_one, b_count = b_of[b_kept], b_w[b_kept], b_one[b_kept], b_count[b_kept]
        p_two = (b_count + kinds[b_of] * probability(b_one)) / (seen + kinds)[b_of]
        # contexts of two words
        pair = new.copy()
        pair[1:] |= u[1:] != u[:-1]
        p_of = np.cumsum(pair) - 1
        p_v, p_u = of[pair], u[pair]
        p_seen, p_kinds = np.bincount(p_of, count, len(p_v)), np.bincount(p_of, count > 0, len(p_v))
        for (word, before), (c, t) in (hot_pairs or {}).items():
            k = np.flatnonzero((words[p_v] == word) & (p_u == before))
            p_seen[k], p_kinds[k] = c, t
        there = count > 0
        count, rank, of, p_of = count[there], rank[there], of[there], p_of[there]
        p_three = (count + p_kinds[p_of] * probability(quantised(p_two))[rank]) / (p_seen + p_kinds)[p_of]
        # only what is seen gets a place
        kept, p_kept = seen > 0, p_seen > 0
        place, p_place = np.cumsum(kept) - 1, np.cumsum(p_kept) - 1
        words, seen, kinds, b_of, of = words[kept], seen[kept], kinds[kept], place[b_of], place[of]
        p_v, p_u, p_seen, p_kinds, p_of = place[p_v[p_kept]], p_u[p_kept], p_seen[p_kept], p_kinds[p_kept], p_place[p_of]
        start = lambda n: np.concatenate([np.zeros(1, np.int64), np.cumsum(n)])
        to_next, to_before, to_last = start(np.bincount(b_of, minlength=len(words))), start(np.bincount(p_v, minlength=len(words))), start(np.bincount(p_of, minlength=len(p_v)))
        sequences = [words, to_next, _relative(b_w, to_next), to_before, _relative(p_u, to_before), to_last, _relative(rank - to_next[of], to_last)]
        codes = [quantised(p_two), quantised(kinds / (seen + kinds)), quantised(p_three), quantised(p_kinds / (p_seen + p_kinds))]
        arrays = [a for s in sequences for a in Rising.arrays(s)] + [np.append(c, np.zeros(-len(c) % 4, np.uint16)).view(U64) for c in codes]
        block = mmap.mmap(-1, max(8, 8 * sum(map(len, arrays))))
        at = 0
        for a in arrays:
            block[at : at + 8 * len(a)] = a.tobytes()
            at += 8 * len(a)
        return cls(block, [len(a) for a in arrays])

    @staticmethod
    def _child(pointers: Rising, level: Rising, node: np.ndarray, of: np.ndarray, value: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """For values sought among the children of node[of]: (whether it is there, its place in the
        level, its place among the node's children)."""
        begin, end = pointers.at(node).astype(np.int64), pointers.at(node + 1).astype(np.int64)
        base = np.zeros(len(node), U64)
        later = np.flatnonzero(begin > 0)
        base[later] = level.at(begin[later] - 1) + U64(1)
        at, equal = level.find(base[of] + value.astype(U64))
        rank = at - begin[of]
        return equal & (rank >= 0) & (at < end[of]), at, rank

    def score(self, v: np.ndarray, u: np.ndarray, w: np.ndarray, one: np.ndarray) -> np.ndarray:
        """Codes of log10 p(w | u v): of the trigram if it is known, else of the longest known end of it and
        the backoffs of the contexts that are given up. Contexts are looked up once per run of equal ones."""
        out = one.astype(np.int64)
        if not len(v):
            return out
        head, of = _runs(v)
        at, equal = self.words.find(v[head].astype(U64))
        there = np.flatnonzero(equal)
        place = np.full(len(head), -1)
        place[there] = np.arange(len(there))
        node, of = at[there], place[of]
        known = np.flatnonzero(of >= 0)
        if not len(known):
            return out
        of, u, w = of[known], u[known], w[known]
        hit, end, rank = self._child(self.to_next, self.next, node, of, w)
        two = np.where(hit, self.next_code[np.where(hit, end, 0)].astype(np.int64), self.word_backoff[node[of]] + out[known])
        head, pair_of = _runs(of, u)
        seen, pair, _ = self._child(self.to_before, self.before, node, of[head], u[head])
        backoff = np.zeros(len(head), np.int64)
        backoff[seen] = self.pair_backoff[pair[seen]]
        three = two + backoff[pair_of]
        place = np.cumsum(seen) - 1
        both = np.flatnonzero(seen[pair_of] & hit)
        full, last, _ = self._child(self.to_last, self.last, pair[seen], place[pair_of[both]], rank[both])
        three[both[full]] = self.last_code[last[full]]
        out[known] = three
        return out


def _runs(*columns: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(where each run of equal rows begins, the run of each row)."""
    new = np.ones(len(columns[0]), bool)
    new[1:] = False
    for x in columns:
        new[1:] |= x[1:] != x[:-1]
    return np.flatnonzero(new), np.cumsum(new) - 1
