"""Bidirectional FM-index over a delimited vocabulary, searched with one error by two schemes."""

from __future__ import annotations

import numpy as np

BLOCK = 32
#: Queries that are searched together, and intervals up to which the next symbols are read off instead of tried.
TOGETHER, READ_OFF = 8192, 64
#: The delimiter, and letters that the index lacks.
END, UNKNOWN = 0, 255


class Words:
    """Words as one array of symbols with offsets; symbol 0 stands for the delimiter."""

    def __init__(self, words: list[str], symbols: dict[str, int]):
        self.sizes = np.array([len(w) for w in words], np.int64)
        self.starts = np.concatenate([[0], np.cumsum(self.sizes)])[:-1]
        points = np.frombuffer("".join(words).encode("utf-32-le"), np.uint32)
        lookup = np.full(int(points.max(initial=0)) + 1, UNKNOWN, np.uint8)
        for c, s in symbols.items():
            if ord(c) < len(lookup):
                lookup[ord(c)] = s
        self.flat = lookup[points]

    def at(self, word: np.ndarray, place: np.ndarray, right: bool) -> np.ndarray:
        """Symbol at a place, read from the front (``right``) or from the end; past the last it is the delimiter."""
        size = self.sizes[word]
        inner = place < size
        where = self.starts[word] + np.where(right, place, size - 1 - place)
        return np.where(inner, self.flat[np.where(inner, where, 0)] if len(self.flat) else 0, END).astype(np.uint8)


def rotations(text: np.ndarray) -> np.ndarray:
    """Starts of the rotations of a text in order, by prefix doubling; all rotations differ."""
    n, step = len(text), 1
    rank = text.astype(np.int64)
    while True:
        key = rank * (n + 1) + np.roll(rank, -step)
        order = np.argsort(key, kind="stable")
        ordered = key[order]
        rank = np.empty(n, np.int64)
        rank[order] = np.concatenate([[0], np.cumsum(ordered[1:] != ordered[:-1])])
        if rank[order[-1]] == n - 1 or step >= n:
            return order
        step *= 2


class Ranks:
    """How often each symbol, and each smaller one, stands in a prefix of a transformed text."""

    def __init__(self, text: np.ndarray, sigma: int):
        order = rotations(text)
        self.last = text[order - 1]
        blocks = len(text) // BLOCK + 1
        padded = np.full(blocks * BLOCK, 255, np.uint8)
        padded[: len(text)] = self.last
        self.blocks = padded.reshape(blocks, BLOCK)
        cells = np.bincount(np.arange(len(text)) // BLOCK * sigma + self.last, minlength=blocks * sigma).reshape(blocks, sigma)
        self.before = np.zeros((blocks, sigma), np.int32)
        np.cumsum(cells[:-1], axis=0, out=self.before[1:])
        self.below = np.zeros((blocks, sigma), np.int32)
        np.cumsum(self.before[:, :-1], axis=1, out=self.below[:, 1:])
        self.first = np.concatenate([[0], np.cumsum(np.bincount(text, minlength=sigma))])[:sigma]

    def upto(self, symbol: np.ndarray, end: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Occurrences of ``symbol`` and of smaller symbols among the first ``end``."""
        block, rest = end // BLOCK, end % BLOCK
        part = self.blocks[block]
        inner = np.arange(BLOCK) < rest[:, None]
        same = ((part == symbol[:, None]) & inner).sum(1)
        less = ((part < symbol[:, None]) & inner).sum(1)
        return self.before[block, symbol] + same, self.below[block, symbol] + less


class Index:
    """Intervals of a pattern among the sorted rotations of the text and of the reversed text, kept together.

    The text is every word after a delimiter, in order and read as a circle. The words are distinct,
    so all rotations differ; and as the delimiter is the smallest symbol, the rotations that start with it are
    sorted as the words are: the first interval of a whole delimited word is the word's number.
    """

    def __init__(self, words: list[str]):
        self.symbols = {c: k + 1 for k, c in enumerate(sorted(set("".join(words))))}
        if len(self.symbols) >= UNKNOWN:
            raise ValueError(f"the index holds at most {UNKNOWN - 1} different letters")
        self.sigma = len(self.symbols) + 1
        self.words = Words(words, self.symbols)
        text = np.insert(self.words.flat, self.words.starts, END)
        self.ranks = {False: Ranks(text, self.sigma), True: Ranks(text[::-1], self.sigma)}

    def extended(self, state: np.ndarray, symbol: np.ndarray, right: bool) -> np.ndarray:
        """Intervals (start, start in the reversed text, size) after one more symbol on the right or on the left."""
        ranks = self.ranks[right]
        own, other = (1, 0) if right else (0, 1)
        start, size = state[:, own], state[:, 2]
        same0, less0 = ranks.upto(symbol, start)
        same1, less1 = ranks.upto(symbol, start + size)
        new = np.empty_like(state)
        new[:, own] = ranks.first[symbol] + same0
        new[:, other] = state[:, other] + less1 - less0
        new[:, 2] = same1 - same0
        return new

    def followed(self, state: np.ndarray, right: bool) -> tuple[np.ndarray, np.ndarray]:
        """(row, symbol) of every symbol but the delimiter that may come next; large intervals list all symbols."""
        ranks, own = self.ranks[right], 1 if right else 0
        small = np.flatnonzero(state[:, 2] <= READ_OFF)
        sizes = state[small, 2]
        rows = np.repeat(small, sizes)
        within = np.arange(len(rows)) - np.repeat(np.cumsum(sizes) - sizes, sizes)
        seen = np.unique(rows * 256 + ranks.last[state[rows, own] + within])
        large = np.flatnonzero(state[:, 2] > READ_OFF)
        rows = np.concatenate([seen // 256, np.repeat(large, self.sigma - 1)])
        symbols = np.concatenate([seen % 256, np.tile(np.arange(1, self.sigma), len(large))]).astype(np.uint8)
        keep = symbols != END
        return rows[keep], symbols[keep]

    def near(self, queries: list[str], exact: np.ndarray, right: bool) -> tuple[np.ndarray, np.ndarray]:
        """(query, word) for words that share the first (``right``) or last ``exact`` letters and differ by one edit elsewhere.

        Each is found once: a letter is left out at the end of its run, and put in where the next letter differs.
        """
        pairs = [(np.zeros(0, np.int64), np.zeros(0, np.int64))]
        for at in range(0, len(queries), TOGETHER):
            q, w = self._near(Words(queries[at : at + TOGETHER], self.symbols), exact[at : at + TOGETHER], right)
            pairs.append((q + at, w))
        return np.concatenate([p[0] for p in pairs]), np.concatenate([p[1] for p in pairs])

    def _near(self, asked: Words, exact: np.ndarray, right: bool) -> tuple[np.ndarray, np.ndarray]:
        live = np.arange(len(asked.sizes))
        state = np.zeros((len(live), 3), np.int64)
        state[:, 2] = len(self.words.sizes)  # the rotations that start with a delimiter come first, in both texts
        place = 0
        query, reached, states = [], [], []

        def branch(rows: np.ndarray, start: np.ndarray, intervals: np.ndarray) -> None:
            keep = intervals[:, 2] > 0
            query.append(rows[keep])
            reached.append(start[keep])
            states.append(intervals[keep])

        while len(live):
            here = np.full(len(live), place)
            symbol = asked.at(live, here, right)
            open_ = np.flatnonzero(exact[live] <= place)
            if len(open_):
                more = place < asked.sizes[live]
                next_ = asked.at(live, here + 1, right)
                left_out = open_[more[open_] & ((next_ != symbol) | (place + 1 == asked.sizes[live]))[open_]]
                branch(live[left_out], here[left_out] + 1, state[left_out])
                rows, put = self.followed(state[open_], right)
                rows = open_[rows]
                other = put != symbol[rows]
                rows, put = rows[other], put[other]
                grown = self.extended(state[rows], put, right)
                branch(live[rows], here[rows], grown)  # put in
                over = more[rows]
                branch(live[rows[over]], here[rows[over]] + 1, grown[over])  # in place of the letter
            on = np.flatnonzero((place < asked.sizes[live]) & (symbol != UNKNOWN))
            state = self.extended(state[on], symbol[on], right)
            live = live[on]
            keep = state[:, 2] > 0
            live, state = live[keep], state[keep]
            place += 1
        if not query:
            return np.zeros(0, np.int64), np.zeros(0, np.int64)
        rows, start, intervals = np.concatenate(query), np.concatenate(reached), np.concatenate(states)
        found_rows, found_words = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]
        while len(rows):
            done = start >= asked.sizes[rows]
            symbol = asked.at(rows, start, right)
            known = symbol != UNKNOWN
            rows, start, intervals, symbol, done = rows[known], start[known], intervals[known], symbol[known], done[known]
            intervals = self.extended(intervals, symbol, right)
            whole = done & (intervals[:, 2] > 0)
            found_rows.append(rows[whole])
            found_words.append(intervals[whole, 0])
            go_on = ~done & (intervals[:, 2] > 0)
            rows, start, intervals = rows[go_on], start[go_on] + 1, intervals[go_on]
        return np.concatenate(found_rows), np.concatenate(found_words)

    def same_start(self, queries: Words, rows: np.ndarray, words: np.ndarray, length: np.ndarray) -> np.ndarray:
        """Whether a word starts with the first ``length`` letters of the query."""
        same = np.ones(len(rows), bool)
        live = np.arange(len(rows))
        place = 0
        while len(live):
            live = live[length[rows[live]] > place]
            here = np.full(len(live), place)
            equal = queries.at(rows[live], here, True) == self.words.at(words[live], here, True)
            same[live[~equal]] = False
            live = live[equal]
            place += 1
        return same
