"""One-to-one choices inside one group, on numpy arrays: nothing here makes all pairs of a group."""

from __future__ import annotations

import numpy as np

#: Up to so many different lengths of truths, each length has an index of its own.
FEW = 64
_NONE = 1 << 62


class _Length:
    """Truths of one length, by start: which are left, the next left on either side, the least rank left of a range."""

    def __init__(self, starts: np.ndarray, ends: np.ndarray, rank: np.ndarray):
        self.a, self.b, self.rank, self.length, n = starts, ends, rank, float(ends[0] - starts[0]), len(starts)
        self.run = np.searchsorted(ends, ends, "left").tolist()
        self.ahead, self.back = list(range(n + 1)), list(range(n + 1))  # back is shifted by one: 0 is none
        self.size = 1 << (n - 1).bit_length()
        tree = np.full(2 * self.size, _NONE)
        tree[self.size : self.size + n] = rank
        low = self.size
        while low > 1:
            tree[low // 2 : low] = np.minimum(tree[low : 2 * low : 2], tree[low + 1 : 2 * low : 2])
            low //= 2
        self.tree = tree.tolist()
        self.starts, self.ends = starts.tolist(), ends.tolist()

    def middle(self, s: np.ndarray, e: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Places (from, to) of the truths that lie in each interval or hold it: none can overlap it more."""
        short = self.length <= e - s
        low = np.where(short, np.searchsorted(self.a, s, "left"), np.searchsorted(self.b, e, "left"))
        high = np.where(short, np.searchsorted(self.b, e, "right"), np.searchsorted(self.a, s, "right"))
        return low, np.maximum(low, high)

    def best(self, s: np.ndarray, e: np.ndarray) -> np.ndarray:
        """The best IoU of each interval over all these truths, taken or not."""
        low, high = self.middle(s, e)
        n, length = len(self.a), e - s
        before, behind = np.maximum(low - 1, 0), np.minimum(high, n - 1)
        inter = np.maximum(np.where(low > 0, self.b[before] - s, 0.0), np.where(high < n, e - self.a[behind], 0.0))
        inter = np.where(high > low, np.minimum(length, self.length), inter)
        return np.where(inter > 0, inter / (length + self.length - inter), 0.0)

    def next(self, i: int) -> int:
        up = self.ahead
        while up[i] != i:
            up[i] = i = up[up[i]]
        return i

    def last(self, i: int) -> int:
        """The place of the last one left before i, or -1."""
        up = self.back
        while up[i] != i:
            up[i] = i = up[up[i]]
        return i - 1

    def least(self, low: int, high: int) -> int:
        tree, best = self.tree, _NONE
        low, high = low + self.size, high + self.size
        while low < high:
            if low & 1:
                best = tree[low] if tree[low] < best else best
                low += 1
            if high & 1:
                high -= 1
                best = tree[high] if tree[high] < best else best
            low >>= 1
            high >>= 1
        return best

    def take(self, i: int) -> None:
        self.ahead[i], self.back[i + 1] = i + 1, i
        tree, i = self.tree, i + self.size
        tree[i] = _NONE
        i >>= 1
        while i:
            tree[i] = min(tree[2 * i], tree[2 * i + 1])
            i >>= 1


def match_intervals(s: np.ndarray, e: np.ndarray, order: np.ndarray, g_s: np.ndarray, g_e: np.ndarray, rank: np.ndarray, threshold: float) -> tuple[np.ndarray, np.ndarray]:
    """(truth, tiou) of each interval: in the given order each takes the truth of the greatest IoU (then least rank) that is left, if that reaches the threshold; truth is -1 for none, tiou then the best over all truths.

    rank: a different number for each truth. Few different lengths of truths cost a logarithm for each interval and
    length; otherwise an interval is compared with the truths that can touch it, one interval at a time.
    """
    hit, tiou = np.full(len(s), -1), np.zeros(len(s))
    real, order = np.flatnonzero(g_e > g_s), order[(e > s)[order]]
    if not len(real) or not len(order):
        return hit, tiou
    lengths = (g_e - g_s)[real]
    kinds = np.unique(lengths)
    if len(kinds) <= FEW:
        groups = [real[lengths == k] for k in kinds]
        groups = [g[np.lexsort((rank[g], g_s[g]))] for g in groups]
        if all((np.diff(g_e[g]) >= 0).all() for g in groups):
            _by_length(s, e, order, [_Length(g_s[g], g_e[g], rank[g]) for g in groups], groups, threshold, hit, tiou)
            return hit, tiou
    _by_range(s, e, order, real, g_s, g_e, rank, threshold, hit, tiou)
    return hit, tiou


def _by_length(s, e, order, kinds: list[_Length], members: list[np.ndarray], threshold: float, hit: np.ndarray, tiou: np.ndarray, chunk: int = 20_000) -> None:
    where = [dict(zip(k.rank.tolist(), range(len(m)), strict=True)) for k, m in zip(kinds, members, strict=True)]
    for at in range(0, len(order), chunk):
        part = order[at : at + chunk]
        ps, pe = s[part], e[part]
        length = pe - ps
        tiou[part] = np.max([k.best(ps, pe) for k in kinds], axis=0)
        plans = []
        for c, k in enumerate(kinds):
            low, high = k.middle(ps, pe)
            inter = np.minimum(length, k.length)
            top = inter / (length + k.length - inter)
            plans.append((c, k, low.tolist(), high.tolist(), top.tolist()))
        for i, (p, a, b, own) in enumerate(zip(part.tolist(), ps.tolist(), pe.tolist(), length.tolist(), strict=True)):
            best, best_rank, best_kind, best_place = threshold, _NONE, -1, -1
            for c, k, low, high, top in plans:
                if top[i] < best:
                    continue
                lo, hi = low[i], high[i]
                least = k.least(lo, hi) if lo < hi else _NONE
                if least < _NONE:
                    if top[i] > best or least < best_rank:
                        best, best_rank, best_kind, best_place = top[i], least, c, -1
                    continue
                j = k.last(lo)
                if j >= 0 and (inter := k.ends[j] - a) > 0:
                    t = inter / (own + k.length - inter)
                    if t >= best:
                        j = k.next(k.run[j])
                        r = int(k.rank[j])
                        if t > best or r < best_rank:
                            best, best_rank, best_kind, best_place = t, r, c, j
                j = k.next(hi)
                if j < len(k.starts) and (inter := b - k.starts[j]) > 0:
                    t = inter / (own + k.length - inter)
                    if t >= best:
                        r = int(k.rank[j])
                        if t > best or r < best_rank:
                            best, best_rank, best_kind, best_place = t, r, c, j
            if best_kind >= 0:
                place = best_place if best_place >= 0 else where[best_kind][best_rank]
                kinds[best_kind].take(place)
                hit[p], tiou[p] = members[best_kind][place], best


def _by_range(s, e, order, real, g_s, g_e, rank, threshold: float, hit: np.ndarray, tiou: np.ndarray) -> None:
    octave = np.frexp((g_e - g_s)[real])[1]
    kinds = []
    for o in np.unique(octave):
        m = real[octave == o]
        m = m[np.argsort(g_s[m], kind="stable")]
        a, b = g_s[m], g_e[m]
        kinds.append((m, a, b, b - a, float((b - a).max()), rank[m], np.ones(len(m), dtype=bool)))
    for p in order.tolist():
        a, b, best, best_rank, choice = s[p], e[p], -1.0, _NONE, None
        for m, ga, gb, length, longest, r, left in kinds:
            lo, hi = np.searchsorted(ga, a - longest, "left"), np.searchsorted(ga, b, "left")
            if lo >= hi:
                continue
            inter = np.minimum(b, gb[lo:hi]) - np.maximum(a, ga[lo:hi])
            t = np.where(inter > 0, inter / ((b - a) + length[lo:hi] - inter), 0.0)
            tiou[p] = max(tiou[p], t.max())
            t = np.where(left[lo:hi] & (inter > 0), t, -1.0)
            top = t.max()
            if top >= threshold and top >= best and top > 0:
                ties = np.flatnonzero(t == top)
                j = ties[np.argmin(r[lo:hi][ties])]
                if top > best or r[lo + j] < best_rank:
                    best, best_rank, choice = top, r[lo + j], (m, left, lo + j)
        if choice:
            m, left, j = choice
            left[j] = False
            hit[p], tiou[p] = m[j], best


def nearest(qx: np.ndarray, qy: np.ndarray, px: np.ndarray, py: np.ndarray, k: int, tile: int = 64) -> tuple[np.ndarray, np.ndarray]:
    """Distances (ascending) and places of the k points nearest to each query; infinite and -1 where there are fewer.

    Both sets are cut into tiles of equal counts, and a tile of queries meets the tiles of points that can hold one of its
    nearest, the closest first: exact, and never all pairs. Coordinates are finite.
    """
    far, place = np.full((len(qx), k), np.inf), np.full((len(qx), k), -1)
    if not len(qx) or not len(px) or not k:
        return far, place
    tiles = _tiles(px, py, tile)
    boxes = np.array([(px[t].min(), px[t].max(), py[t].min(), py[t].max()) for t in tiles])
    for q in _tiles(qx, qy, tile):
        x, y = qx[q], qy[q]
        dx = np.maximum(0.0, np.maximum(boxes[:, 0] - x.max(), x.min() - boxes[:, 1]))
        dy = np.maximum(0.0, np.maximum(boxes[:, 2] - y.max(), y.min() - boxes[:, 3]))
        away = np.sqrt(dx * dx + dy * dy)
        order = np.argsort(away, kind="stable")
        n = min(len(order), max(4, -(-2 * k // tile)))
        while True:
            c = np.concatenate([tiles[i] for i in order[:n]])
            ddx, ddy = x[:, None] - px[c][None], y[:, None] - py[c][None]
            d = np.sqrt(ddx * ddx + ddy * ddy)
            m = min(k, len(c))
            near = np.argpartition(d, m - 1, axis=1)[:, :m]
            dn = np.take_along_axis(d, near, 1)
            reach = dn.max() if m == k else np.inf
            more = int(np.searchsorted(away[order], reach * (1 + 1e-9), "right"))
            if more <= n:
                break
            n = more
        by = np.argsort(dn, axis=1, kind="stable")
        far[q, :m], place[q, :m] = np.take_along_axis(dn, by, 1), c[np.take_along_axis(near, by, 1)]
    return far, place


def _tiles(x: np.ndarray, y: np.ndarray, size: int) -> list[np.ndarray]:
    """Places in tiles of up to `size`: strips by x, each cut by y."""
    strip = size * int(np.ceil(np.sqrt(-(-len(x) // size))))
    order = np.argsort(x, kind="stable")
    out = []
    for i in range(0, len(order), strip):
        s = order[i : i + strip]
        s = s[np.argsort(y[s], kind="stable")]
        out += [s[j : j + size] for j in range(0, len(s), size)]
    return out


def nearest_others(x: np.ndarray, y: np.ndarray, k: int) -> np.ndarray:
    """Mean distance of each point to its k nearest others (fewer if there aren't so many; NaN for a lone point). Equal points are searched once."""
    n = len(x)
    if n < 2:
        return np.full(n, np.nan)
    both, of, count = np.unique(np.column_stack([x, y]), axis=0, return_inverse=True, return_counts=True)
    k, of = min(k, n - 1), of.reshape(-1)
    far, place = nearest(both[:, 0], both[:, 1], both[:, 0], both[:, 1], min(k + 1, len(both)))
    near = np.where(place >= 0, count[place], 0)
    near[place == np.arange(len(both))[:, None]] -= 1  # not itself, but others like it
    used = np.diff(np.minimum(np.cumsum(near, axis=1), k), axis=1, prepend=0)
    return ((np.where(used > 0, far, 0.0) * used).sum(axis=1) / used.sum(axis=1))[of]


def box_pairs(p: np.ndarray, g: np.ndarray, least: float, chunk: int = 2_000_000) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(row of p, row of g, IoU) of pairs of boxes (rows x1, y1, x2, y2) whose IoU reaches `least`; boxes with a missing corner have none.

    Boxes are swept along x: only those near enough to reach `least` are compared, so many pairs at a time.
    """
    pi, gi = np.flatnonzero(np.isfinite(p).all(axis=1)), np.flatnonzero(np.isfinite(g).all(axis=1))
    empty = np.zeros(0, dtype=np.int64)
    if not len(pi) or not len(gi):
        return empty, empty, np.zeros(0)
    gi = gi[np.argsort(g[gi, 0], kind="stable")]
    a, b = p[pi], g[gi]
    if least > 0:  # boxes share at least `least` of either's width
        slack = (1 - least) * (1 + 1e-9) + 1e-9
        low = np.searchsorted(b[:, 0], a[:, 0] - slack * max(0.0, float((b[:, 2] - b[:, 0]).max())), "left")
        high = np.searchsorted(b[:, 0], a[:, 0] + slack * np.maximum(0.0, a[:, 2] - a[:, 0]), "right")
    else:
        low, high = np.zeros(len(a), dtype=np.int64), np.full(len(a), len(b))
    count = np.maximum(high - low, 0)
    upto = np.concatenate([[0], np.cumsum(count)])
    out, i = [], 0
    while i < len(a):
        j = max(i + 1, int(np.searchsorted(upto, upto[i] + chunk, "right")) - 1)
        left = np.repeat(np.arange(i, j), count[i:j])
        right = np.arange(len(left)) - np.repeat(upto[i:j] - upto[i], count[i:j]) + np.repeat(low[i:j], count[i:j])
        x, y = a[left], b[right]
        inter = np.maximum(0.0, np.minimum(x[:, 2], y[:, 2]) - np.maximum(x[:, 0], y[:, 0])) * np.maximum(0.0, np.minimum(x[:, 3], y[:, 3]) - np.maximum(x[:, 1], y[:, 1]))
        union = (x[:, 2] - x[:, 0]) * (x[:, 3] - x[:, 1]) + (y[:, 2] - y[:, 0]) * (y[:, 3] - y[:, 1]) - inter
        iou = np.divide(inter, union, out=np.zeros(len(inter)), where=union > 0)
        ok = iou >= least
        out.append((pi[left[ok]], gi[right[ok]], iou[ok]))
        i = j
    return tuple(np.concatenate(c) for c in zip(*out, strict=True))


def in_turn(left: np.ndarray, right: np.ndarray, iou: np.ndarray, left_rank: np.ndarray, right_rank: np.ndarray) -> np.ndarray:
    """Places of pairs in the order of choice: members of the left by their own best IoU (then rank), each with its best of the right (then rank) first."""
    if not len(iou):
        return np.zeros(0, dtype=np.int64)
    top = np.full(int(left.max()) + 1, -1.0)
    np.maximum.at(top, left, iou)
    return np.lexsort((right_rank[right], -iou, left_rank[left], -top[left]))


def match_pairs(left: np.ndarray, right: np.ndarray) -> np.ndarray:
    """Places of the chosen pairs: in their order each member of the left takes the first of the right that isn't taken."""
    taken, done, keep = set(), -1, []
    for i, (a, b) in enumerate(zip(left.tolist(), right.tolist(), strict=True)):
        if a != done and b not in taken:
            taken.add(b)
            done = a
            keep.append(i)
    return np.array(keep, dtype=np.int64)
