"""A run-length index: run-compressed Burrows-Wheeler transform with sampled run ends, and matching statistics."""

from __future__ import annotations

import numpy as np

#: Symbols of nine bits that a word holds, and the words that differ first in the last symbol, the one before, and so on.
PACK = 7
DIFFER = np.int64(1) << (9 * np.arange(PACK, dtype=np.int64))


def packed(text: np.ndarray) -> np.ndarray:
    """The ``PACK`` symbols that start at each place as one number; symbols count from 1, zeros follow the last one."""
    words, rest = np.zeros(len(text), np.int64), np.append(text + 1, np.zeros(PACK, np.int64))
    for k in range(PACK):
        words = words << 9 | rest[k : k + len(text)]
    return words


def suffix_order(words: np.ndarray) -> np.ndarray:
    """Suffix array by prefix doubling, from the first ``PACK`` symbols of each suffix on."""
    n, key, width = len(words), words, PACK
    while True:
        order = np.argsort(key)
        ordered = key[order]
        new = np.cumsum(np.concatenate([[0], (ordered[1:] != ordered[:-1]).astype(np.int64)]))
        if new[-1] == n - 1:
            return order
        rank = np.empty(n, np.int64)
        rank[order] = new
        key = rank * (n + 1)
        key[: max(n - width, 0)] += rank[width:] + 1
        width *= 2


class RunIndex:
    """Index over strings that are parted by a zero; bytes count from 1.

    Kept per run of the transform: its head, what its rows move by when they map, and the text places and
    rows of its first and last one. ``run_of`` tells a row's run. The packed text serves to compare two places.
    """

    def __init__(self, strings: list[bytes]):
        data = np.frombuffer(b"".join(strings), np.uint8).astype(np.int64) + 1
        text = np.insert(data, np.cumsum([len(s) for s in strings], dtype=np.int64), 0) if strings else np.zeros(1, np.int64)
        self.words = packed(text)
        order = suffix_order(self.words)
        bwt = text[order - 1]
        opens = np.concatenate([[True], bwt[1:] != bwt[:-1]])
        self.run_of = np.cumsum(opens, dtype=np.int64) - 1
        starts = np.flatnonzero(opens)
        self.heads = bwt[starts]
        ends = np.append(starts[1:], len(bwt))
        lengths = ends - starts
        self.first, self.last = order[starts], order[ends - 1]
        # where the first row of a run maps to: rows of smaller heads, then earlier runs of the same head
        by_head = np.argsort(self.heads, kind="stable")
        maps = np.empty(len(self.heads), np.int64)
        maps[by_head] = np.cumsum(lengths[by_head]) - lengths[by_head]
        self.shift, self.first_to, self.last_to = maps - starts, maps, maps + lengths - 1
        # a run before and one behind the others, of no head
        self.by_head = np.concatenate([by_head, [len(by_head)]])
        self.keys = self.heads[by_head] * len(self.heads) + by_head
        self.heads = np.append(self.heads, -1)

    def alike(self, a: np.ndarray, b: np.ndarray, most: np.ndarray) -> np.ndarray:
        """Length of the common prefix of the suffixes at ``a`` and ``b``, ``most`` at most."""
        result = most.copy()
        lanes = np.flatnonzero(most > 0)
        a, b, most = a[lanes], b[lanes], most[lanes]
        done = 0
        while len(lanes):
            other = self.words[a + done] ^ self.words[b + done]
            ends = other != 0
            result[lanes[ends]] = np.minimum(most[ends], done + PACK - np.searchsorted(DIFFER, other[ends], side="right"))
            done += PACK
            on = ~ends & (most > done)
            lanes, a, b, most = lanes[on], a[on], b[on], most[on]
        return result

    def matching_statistics(self, patterns: list[bytes], most: int | None = None) -> list[np.ndarray]:
        """For every place of every pattern the length of the longest match that starts there, ``most`` for longer ones.

        All patterns are streamed from their ends at once. A row that does not continue with the next byte
        jumps to the end of the run before or the start of the run after that does, whichever agrees longer; rows
        that agree by ``most`` stand together, so which of them is taken makes no difference.
        """
        sizes = np.array([len(p) for p in patterns], np.int64)
        if not len(sizes):
            return []
        # the longest patterns first, so that those still streamed are the first ones
        by_size = np.argsort(-sizes, kind="stable")
        width, runs = int(sizes.max()), len(self.heads) - 1
        most = width if most is None else most
        active = len(sizes) - np.searchsorted(np.sort(sizes), np.arange(width), side="right")
        # row t holds the bytes that are t + 1 from the end
        lanes, found = np.zeros((width, len(sizes)), np.int64), np.zeros((width, len(sizes)), np.int32)
        for k, j in enumerate(by_size):
            lanes[: sizes[j], k] = np.frombuffer(patterns[j], np.uint8)[::-1]
        lanes += 1
        row = np.zeros(len(sizes), np.int64)
        place = np.full(len(sizes), self.first[0], np.int64)
        length = np.zeros(len(sizes), np.int64)
        for t, n in enumerate(active):
            row, place, length, c = row[:n], place[:n], length[:n], lanes[t, :n]
            run = self.run_of[row]
            jump = np.flatnonzero(self.heads[run] != c)
            here, kept, c, run_here = place[jump], length[jump], c[jump], run[jump]
            row += self.shift[run]
            place -= 1
            np.minimum(length + 1, most, out=length)
            if len(jump):
                after = np.searchsorted(self.keys, c * runs + run_here)
                next_run, prev_run = self.by_head[after], self.by_head[after - 1]
                forth, back = np.full(len(jump), -1), np.full(len(jump), -1)
                for runs_there, ends, agree in ((next_run, self.first, forth), (prev_run, self.last, back)):
                    same = np.flatnonzero(self.heads[runs_there] == c)
                    agree[same] = self.alike(ends[runs_there[same]], here[same], kept[same])
                use_next, best = forth >= back, np.maximum(forth, back)
                ok = best >= 0
                there = np.where(ok, np.where(use_next, next_run, prev_run), 0)
                length[jump] = np.where(ok, np.minimum(best + 1, most), 0)
                place[jump] = np.where(ok, np.where(use_next, self.first[there], self.last[there]) - 1, self.first[0])
                row[jump] = np.where(ok, np.where(use_next, self.first_to[there], self.last_to[there]), 0)
            found[t, :n] = length
        result = [None] * len(sizes)
        for k, j in enumerate(by_size):
            result[j] = found[: sizes[j], k][::-1].astype(np.int64)
        return result
