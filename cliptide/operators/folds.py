"""Clusterings that one task ends: vectors, one row per group and a block of scores are held, never the scores of all pairs."""

from __future__ import annotations

import numpy as np

from cliptide.functions import vectors as V

#: Scores computed at a time (16 MB).
BLOCK_SCORES = 1 << 21
#: Members of a group that are met one after the other as whole columns; those beyond are reduced per group.
SLOTS = 16
#: Groups with more members keep the bounds of their cosines with all others (up to so many bytes), so that a merge computes the smaller part only.
KEPT_MEMBERS, KEPT_BYTES = 32, 1 << 26


def _blocks(rows: np.ndarray, width: int) -> list[np.ndarray]:
    step = max(1, BLOCK_SCORES // max(1, width))
    return [rows[k : k + step] for k in range(0, len(rows), step)]


def _settled(live: np.ndarray, best: np.ndarray, top: np.ndarray) -> np.ndarray:
    """Groups that come first in a mutually nearest pair; the nearest pair if rounding leaves none."""
    first = live[(best[best[live]] == live) & (live < best[live])]
    if len(first):
        return first
    one = live[top[live].argmax()]
    one, two = sorted((int(one), int(best[one])))
    best[one] = two
    return np.array([one])


def linked(total: np.ndarray, n: np.ndarray, floor: float) -> np.ndarray:
    """Cluster of each row, by its first row: average linkage of sums of unit vectors, cut at mean cosine ``floor``.

    A round merges all mutually nearest clusters. A merge brings no cluster nearer to a third than both parts were, so only merged
    clusters look for their nearest again, and those whose nearest fell behind their second.
    """
    total, n = total.copy(), n.astype(float)
    root = np.arange(len(n))
    best, top, second = np.zeros(len(n), int), np.full(len(n), -np.inf), np.full(len(n), -np.inf)
    alive, held = np.ones(len(n), bool), np.arange(len(n))
    live = stale = held
    others = total.copy()
    while len(live):
        if len(live) < 0.75 * len(held):
            held, others = live, total[live]
        dead = np.flatnonzero(~alive[held])
        for part in _blocks(stale, len(held)):
            scores = np.round(total[part] @ others.T / np.outer(n[part], n[held]), V.SCORE_DIGITS)
            each = np.arange(len(part))
            scores[:, dead] = -np.inf
            scores[each, np.searchsorted(held, part)] = -np.inf
            at = scores.argmax(1)  # the first of equal ones
            best[part], top[part] = held[at], scores[each, at]
            scores[each, at] = -np.inf
            second[part] = scores.max(1)
        near = top[live] >= floor
        alive[live[~near]] = False  # near none: done
        live = live[near]
        if not len(live):
            break
        kept = _settled(live, best, top)
        gone = best[kept]
        total[kept] += total[gone]
        n[kept] += n[gone]
        root[gone] = kept
        alive[gone] = False
        alive[kept] = True
        others[np.searchsorted(held, kept)] = total[kept]
        live = np.flatnonzero(alive)
        merged = np.zeros(len(n), bool)
        merged[kept] = merged[gone] = True
        lost = live[merged[best[live]] & ~merged[live]]
        hub = root[best[lost]]
        now = np.round(np.einsum("ij,ij->i", total[lost], total[hub]) / (n[lost] * n[hub]), V.SCORE_DIGITS)
        stays = (now > second[lost]) | (now >= top[lost])  # others with its old score have larger first rows
        best[lost[stays]], top[lost[stays]] = hub[stays], now[stays]
        stale = np.concatenate([kept, lost[~stays], live[~alive[best[live]] & ~merged[best[live]] & ~merged[live]]])
    return _roots(root)


def _roots(root: np.ndarray) -> np.ndarray:
    while not np.array_equal(up := root[root], root):
        root = up
    return root


def _least(score: float) -> float:
    """The smallest number that is ``score`` or more once rounded."""
    low, high = score - 10.0**-V.SCORE_DIGITS, score + 10.0**-V.SCORE_DIGITS
    while low < (middle := (low + high) / 2) < high:
        low, high = (low, middle) if np.round(middle, V.SCORE_DIGITS) >= score else (middle, high)
    return high


class _Columns:
    """Vectors of the open groups, first members of all groups before their second ones, so that bounds per group are taken column by column."""

    def __init__(self, v: np.ndarray, open_: np.ndarray, of: np.ndarray):
        at = np.flatnonzero(open_[of])
        size = np.bincount(of[at], minlength=len(of))
        group = np.flatnonzero(size)
        self.groups = group[np.argsort(-size[group], kind="stable")]
        self.sizes = size[self.groups]
        place = np.empty(len(of), int)
        place[self.groups] = np.arange(len(group))
        self.place = place
        at = at[np.argsort(place[of[at]], kind="stable")]
        starts = np.concatenate([[0], np.cumsum(self.sizes)[:-1]])
        slot = np.arange(len(at)) - np.repeat(starts, self.sizes)
        self.rows = at[np.argsort(np.minimum(slot, SLOTS), kind="stable")]
        #: groups with more than j members stand first
        self.widths = [int((self.sizes > j).sum()) for j in range(SLOTS + 1)]
        self.v = v[self.rows]

    def bounds(self, high: np.ndarray, low: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Largest and smallest score per group (columns as ``groups``) of scores per vector (columns as ``rows``)."""
        out, g = [], len(self.groups)
        for scores, reduce in ((high, np.maximum), (low, np.minimum)):
            bound, from_ = scores[:, :g].copy() if self.widths[1] else scores[:, :g], g
            for width in self.widths[1:SLOTS]:
                if not width:
                    break
                reduce(bound[:, :width], scores[:, from_ : from_ + width], out=bound[:, :width])
                from_ += width
            if width := self.widths[SLOTS]:
                more = np.concatenate([[0], np.cumsum(self.sizes[:width] - SLOTS)[:-1]])
                reduce(bound[:, :width], reduce.reduceat(scores[:, from_:], more, axis=1), out=bound[:, :width])
            out.append(bound)
        return out[0], out[1]


class _Careful:
    def __init__(self, v: np.ndarray, threshold: float, floor: float):
        self.v, self.threshold, self.floor, self.least = v, threshold, floor, _least(floor)
        self.best, self.top = np.zeros(len(v), int), np.full(len(v), -np.inf)
        self.of = np.arange(len(v))
        self.members = {k: np.array([k]) for k in range(len(v))}
        self.kept: dict[int, tuple[np.ndarray, np.ndarray]] = {}

    def _spans(self, group: int, columns: _Columns) -> tuple[np.ndarray, np.ndarray]:
        """Largest and smallest cosine of each open vector with the members of a group, by vector."""
        if group in self.kept:
            high, low = self.kept[group]
            return high[columns.rows], low[columns.rows]
        high, low = np.full(len(columns.rows), -np.inf), np.full(len(columns.rows), np.inf)
        for part in _blocks(self.members[group], len(columns.rows)):
            scores = self.v[part] @ columns.v.T
            np.maximum(high, scores.max(0), out=high)
            np.minimum(low, scores.min(0), out=low)
        return high, low

    def _keep(self, group: int, columns: _Columns, high: np.ndarray, low: np.ndarray) -> None:
        """Bounds by vector; those of vectors that are done are never read again."""
        room = KEPT_BYTES // (16 * len(self.v))
        if not room:
            return
        self.kept.pop(group, None)
        while len(self.kept) >= room:
            self.kept.pop(next(iter(self.kept)))
        whole = np.zeros((2, len(self.v)))
        whole[0, columns.rows], whole[1, columns.rows] = high, low
        self.kept[group] = (whole[0], whole[1])

    def merge(self, one: int, two: int, columns: _Columns) -> None:
        if len(self.members[one]) + len(self.members[two]) > KEPT_MEMBERS:
            (h1, l1), (h2, l2) = self._spans(one, columns), self._spans(two, columns)
            self.kept.pop(two, None)
            self._keep(one, columns, np.maximum(h1, h2), np.minimum(l1, l2))
        self.members[one] = np.concatenate([self.members[one], self.members[two]])
        self.of[self.members.pop(two)] = one

    def _parts(self, stale: np.ndarray, columns: _Columns) -> list[list[int]]:
        """Groups whose scores are computed at a time; one with kept bounds counts as one vector."""
        step, parts, load = max(1, BLOCK_SCORES // max(1, len(columns.rows))), [], 0
        for group in stale.tolist():
            rows = 1 if group in self.kept else len(self.members[group])
            if not parts or load + rows > step:
                parts.append([])
                load = 0
            parts[-1].append(group)
            load += rows
        return parts

    def scores(self, part: list[int], columns: _Columns) -> np.ndarray:
        """Score of the first pair of every group of ``part`` and every open group that it fits, not yet rounded, else minus infinity."""
        if all(len(self.members[g]) == 1 for g in part):
            high = low = self.v[part] @ columns.v.T
        else:
            high, low = (np.empty((len(part), len(columns.rows))) for _ in range(2))
            small = [k for k, g in enumerate(part) if g not in self.kept and len(self.members[g]) <= KEPT_MEMBERS]
            small.sort(key=lambda k: -len(self.members[part[k]]))
            rows = [[self.members[part[k]][j] for k in small if j < len(self.members[part[k]])] for j in range(KEPT_MEMBERS)]
            met = self.v[np.array(sum(rows, []), int)] @ columns.v.T
            h, l, from_ = met[: len(small)].copy(), met[: len(small)], len(small)  # first members, then second ones
            for width in map(len, rows[1:]):
                np.maximum(h[:width], met[from_ : from_ + width], out=h[:width])
                np.minimum(l[:width], met[from_ : from_ + width], out=l[:width])
                from_ += width
            high[small], low[small] = h, l
            for k in sorted(set(range(len(part))) - set(small)):
                high[k], low[k] = self._spans(part[k], columns)
        scores, low = columns.bounds(high, low)
        scores[low < self.least] = -np.inf
        scores[np.arange(len(part)), columns.place[part]] = -np.inf
        return scores

    def first(self, own: int, tied: np.ndarray, score: float, columns: _Columns) -> int:
        """Of groups whose first score with a group is the same, the one with the first pair: smallest first end, then smallest other end."""
        taken = np.zeros(len(self.v), bool)
        taken[tied] = True
        mine, theirs = np.sort(self.members[own]), np.sort(columns.rows[taken[self.of[columns.rows]]])
        for low in np.sort(np.concatenate([mine, theirs])):
            others = theirs if self.of[low] == own else mine
            others = others[np.searchsorted(others, low) :]
            met = others[np.round(self.v[others] @ self.v[low], V.SCORE_DIGITS) >= score]
            if len(met):
                return int(self.of[met[0] if self.of[low] == own else low])
        return int(tied[0])

    def look(self, stale: np.ndarray, columns: _Columns, asked: np.ndarray, hub: np.ndarray) -> np.ndarray:
        """Finds the first partners of ``stale`` groups, and tells which of ``asked`` fit their ``hub``, one of them."""
        row, fit = np.full(len(self.v), -1), np.zeros(len(asked), bool)
        for part in self._parts(stale, columns):
            scores, each = self.scores(part, columns), np.arange(len(part))
            row[part] = each
            mine = row[hub] >= 0
            fit[mine] = scores[row[hub[mine]], columns.place[asked[mine]]] > -np.inf
            row[part] = -1
            at = scores.argmax(1)
            self.best[part], self.top[part] = columns.groups[at], np.round(scores[each, at], V.SCORE_DIGITS)
            scores[each, at] = -np.inf
            equal = np.round(scores.max(1), V.SCORE_DIGITS) == self.top[part]
            for k in np.flatnonzero(equal & (self.top[part] >= self.threshold)):
                own = part[k]
                tied = columns.groups[np.round(scores[k], V.SCORE_DIGITS) == self.top[own]]
                self.best[own] = self.first(own, np.append(tied, self.best[own]), self.top[own], columns)
        return fit

    def run(self) -> np.ndarray:
        best, top, alive = self.best, self.top, ~np.isnan(self.v).any(1)
        live = np.flatnonzero(alive)
        columns = _Columns(self.v, alive, self.of)
        self.look(live, columns, live[:0], live[:0])
        while True:
            near = top[live] >= self.threshold
            alive[live[~near]] = False  # a merge of others opens no pair: done
            live = live[near]
            if not len(live):
                return self.of
            kept = _settled(live, best, top)
            gone = best[kept]
            for one, two in zip(kept.tolist(), gone.tolist(), strict=True):
                self.merge(one, two, columns)
            alive[kept], alive[gone] = True, False
            into, merged = np.arange(len(self.v)), np.zeros(len(self.v), bool)
            into[gone] = kept
            merged[kept] = merged[gone] = True
            live = np.flatnonzero(alive)
            others = live[~merged[live]]
            lost, away = others[merged[best[others]]], others[~alive[best[others]] & ~merged[best[others]]]
            columns = _Columns(self.v, alive, self.of)
            stays = self.look(kept, columns, lost, into[best[lost]])
            best[lost[stays]] = into[best[lost[stays]]]
            self.look(np.concatenate([lost[~stays], away]), columns, lost[:0], lost[:0])


def careful(v: np.ndarray, threshold: float, floor: float) -> np.ndarray:
    """Group of each unit vector, by its first vector: pairs from ``threshold`` on, from the most similar one, join the groups of their ends if
    all cosines between them reach ``floor``.

    Groups that fit have the score of their first pair. Groups that do not fit never will, and a merged group has no earlier pair than its parts, so
    a round merges all groups that come first for each other. Only merged groups look for their first again, and those that do not fit what it became.
    """
    return _Careful(v, threshold, floor).run()
