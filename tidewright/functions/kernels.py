"""Statistics of one series or small matrix in numpy; written from published formulas."""

from __future__ import annotations

import math

import numpy as np

#: MacKinnon's (1994) surface for the p-value of a unit-root test with a constant, small and large parts.
ADF_SMALL = (2.1659, 1.4412, 0.038269)
ADF_LARGE = (1.7339, 0.93202, -0.12745, -0.010368)
ADF_STAR, ADF_MIN, ADF_MAX = -1.61, -18.83, 2.74
#: Critical values of the level-stationarity test at 10, 5, 2.5 and 1 %.
KPSS = ((0.347, 0.10), (0.463, 0.05), (0.574, 0.025), (0.739, 0.01))


def normal_cdf(x: float) -> float:
    return 0.5 * (1 + math.erf(x / math.sqrt(2)))


def incomplete_beta(a: float, b: float, x: float) -> float:
    """Regularised, by its continued fraction."""
    if x <= 0 or x >= 1:
        return float(x >= 1)
    if x > (a + 1) / (a + b + 2):
        return 1 - incomplete_beta(b, a, 1 - x)
    front = math.exp(math.lgamma(a + b) - math.lgamma(a) - math.lgamma(b) + a * math.log(x) + b * math.log(1 - x)) / a
    tiny, f, c, d = 1e-300, 1.0, 1.0, 0.0
    for i in range(300):
        m = i // 2
        k = 1.0 if i == 0 else m * (b - m) * x / ((a + 2 * m - 1) * (a + 2 * m)) if i % 2 == 0 else -(a + m) * (a + b + m) * x / ((a + 2 * m) * (a + 2 * m + 1))
        d = 1 / (1 + k * d or tiny)
        c = 1 + k / c or tiny
        f *= c * d
        if abs(1 - c * d) < 1e-12:
            break
    return front * (f - 1)


def f_sf(x: float, d1: float, d2: float) -> float:
    return incomplete_beta(d2 / 2, d1 / 2, d2 / (d2 + d1 * x)) if x > 0 else 1.0


def t_two_sided(t: float, df: float) -> float:
    return incomplete_beta(df / 2, 0.5, df / (df + t * t))


def chi2_sf(x: float, k: int) -> float:
    """By the recurrence from one or two degrees of freedom."""
    if x <= 0:
        return 1.0
    out = math.erfc(math.sqrt(x / 2)) if k % 2 else math.exp(-x / 2)
    for d in range(1 if k % 2 else 2, k, 2):
        out += math.exp(d / 2 * math.log(x / 2) - x / 2 - math.lgamma(d / 2 + 1))
    return out


def ols(x: np.ndarray, y: np.ndarray) -> tuple[np.ndarray, np.ndarray, float]:
    beta = np.linalg.lstsq(x, y, rcond=None)[0]
    e = y - x @ beta
    return beta, e, float(e @ e)


def adf(x: np.ndarray) -> tuple[float, float]:
    """Statistic and p of the augmented Dickey-Fuller test with a constant, lags by Akaike's criterion."""
    x = np.asarray(x, float)
    n = len(x)
    most = min(int(np.ceil(12 * (n / 100) ** 0.25)), n // 2 - 3)
    d = np.diff(x)

    def fit(lags: int, skip: int) -> tuple[float, float]:
        y = d[skip:]
        cols = [np.ones(len(y)), x[skip:-1], *(d[skip - k : len(d) - k] for k in range(1, lags + 1))]
        m = np.column_stack(cols)
        beta, _, ssr = ols(m, y)
        se = math.sqrt(max(ssr / max(1, len(y) - m.shape[1]) * np.linalg.pinv(m.T @ m)[1, 1], 1e-300))
        return len(y) * math.log(max(ssr, 1e-300) / len(y)) + 2 * m.shape[1], float(beta[1] / se)

    best = min(range(max(most, 0) + 1), key=lambda k: fit(k, most)[0])
    stat = fit(best, best)[1]
    return stat, adf_p(stat)


def adf_p(stat: float) -> float:
    """Chance of a smaller statistic of the unit-root test with a constant."""
    if stat > ADF_MAX or stat < ADF_MIN:
        return float(stat > ADF_MAX)
    poly = ADF_SMALL if stat <= ADF_STAR else ADF_LARGE
    return normal_cdf(sum(c * stat**i for i, c in enumerate(poly)))


def kpss(x: np.ndarray) -> tuple[float, float]:
    """Statistic and interpolated p (0.01 to 0.1) of level stationarity; lags by the data (Hobijn, Franses and Ooms 1998)."""
    e = np.asarray(x, float) - np.mean(x)
    n = len(e)
    cover = int(n ** (2 / 9))
    s0, s1 = e @ e / n, 0.0
    for i in range(1, cover + 1):
        moment = 2 * (e[i:] @ e[:-i]) / n
        s0, s1 = s0 + moment, s1 + i * moment
    gamma = 1.1447 * ((s1 / s0) ** 2) ** (1 / 3) if s0 else 0.0
    lags = min(int(gamma * n ** (1 / 3)), n - 1)
    s = e @ e / n + 2 / n * sum((1 - k / (lags + 1)) * (e[k:] @ e[:-k]) for k in range(1, lags + 1))
    stat = float((np.cumsum(e) ** 2).sum() / (n * n * max(s, 1e-300)))
    return stat, float(np.interp(stat, [c for c, _ in KPSS], [p for _, p in KPSS]))


def fluctuation_scales(n: int) -> np.ndarray:
    """Lengths of segments of n values: 15 from 10 to a quarter of them, evenly in logarithms, each once."""
    return np.unique(np.logspace(1, math.log10(n // 4), 15).astype(int)) if n // 4 > 10 else np.array([10])


def hurst_dfa(x: np.ndarray) -> float:
    """Exponent of detrended fluctuation; 0.5 for under 40 values."""
    x = np.asarray(x, float)
    n = len(x)
    if n < 40:
        return 0.5
    walk = np.cumsum(x - x.mean())
    scales, found = fluctuation_scales(n), []
    for s in scales:
        parts = walk[: n // s * s].reshape(-1, s)
        t = np.arange(s) - (s - 1) / 2
        slope = parts @ t / (t @ t)
        rest = parts - parts.mean(axis=1, keepdims=True) - slope[:, None] * t
        found.append(np.sqrt((rest**2).mean(axis=1)).mean())
    ok = np.array(found) > 0
    return float(np.polyfit(np.log(scales[ok]), np.log(np.array(found)[ok]), 1)[0]) if ok.sum() > 1 else 0.5


def dominant_cycle(prices: np.ndarray) -> int:
    """Period of the strongest frequency of detrended prices, within 3 to 30; 10 for under 40."""
    x = np.asarray(prices, float)
    if len(x) < 40:
        return 10
    t = np.arange(len(x))
    size = np.abs(np.fft.rfft(x - np.polyval(np.polyfit(t, x, 1), t)))
    size[0] = 0
    return int(np.clip(1 / np.fft.rfftfreq(len(x))[max(1, int(size.argmax()))], 3, 30))


def variance_ratio(prices: np.ndarray, k: int) -> tuple[float, float, float]:
    """Ratio of k-step to one-step variance, robust z and two-sided p."""
    p = np.log(np.asarray(prices, float))
    r = np.diff(p)
    n = len(r)
    if n < k + 2:
        return 1.0, 0.0, 1.0
    e = r - r.mean()
    s1 = e @ e / (n - 1)
    m = k * (n - k + 1) * (1 - k / n)
    sk = ((p[k:] - p[:-k] - k * r.mean()) ** 2).sum() / m
    ratio = sk / max(s1, 1e-300)
    e2 = e * e
    theta = sum((2 * (k - j) / k) ** 2 * (e2[j:] @ e2[:-j]) / max((e @ e) ** 2, 1e-300) for j in range(1, k))
    z = (ratio - 1) / math.sqrt(max(theta, 1e-300))
    return float(ratio), float(z), 2 * (1 - normal_cdf(abs(z)))


def acf(x: np.ndarray, lags: int) -> np.ndarray:
    e = np.asarray(x, float) - np.mean(x)
    total = max(e @ e, 1e-300)
    return np.array([1.0, *(e[k:] @ e[:-k] / total for k in range(1, lags + 1))])


def arch_lm(r: np.ndarray, lags: int = 5) -> float:
    """p of the Lagrange-multiplier test of squared returns on their lags."""
    s = np.asarray(r, float) ** 2
    y = s[lags:]
    m = np.column_stack([np.ones(len(y)), *(s[lags - k : len(s) - k] for k in range(1, lags + 1))])
    _, _, ssr = ols(m, y)
    return chi2_sf(len(y) * (1 - ssr / max(((y - y.mean()) ** 2).sum(), 1e-300)), lags)


def pearson(x: np.ndarray, y: np.ndarray) -> float:
    a, b = x - x.mean(), y - y.mean()
    spread = math.sqrt(float(a @ a) * float(b @ b))
    return float(a @ b) / spread if spread > 0 else 0.0


def rank_test(x: np.ndarray, y: np.ndarray) -> tuple[float, float]:
    """Spearman's coefficient and its two-sided p by Student's t."""
    r = pearson(ranks(x[:, None])[:, 0], ranks(y[:, None])[:, 0])
    n = len(x)
    return r, 0.0 if abs(r) >= 1 else t_two_sided(abs(r) * math.sqrt((n - 2) / (1 - r * r)), n - 2)


def jump_share(r: np.ndarray, window: int = 20) -> tuple[float, int]:
    """Mean share of jumps in the variance of windows, and how many have over a quarter."""
    sums = lambda v: np.convolve(v, np.ones(window), "valid")
    rv, bv = sums(r * r)[1:], math.pi / 2 * sums(np.abs(r[1:] * r[:-1]))
    share = np.maximum(rv - bv, 0) / (rv + 1e-8)
    return float(share.mean()), int((share > 0.25).sum())


def permutation_entropy(x: np.ndarray) -> float:
    """Of order three, as a share of its maximum; 1 for under 30 values."""
    x = np.asarray(x, float)
    if len(x) < 30:
        return 1.0
    order = np.argsort(np.lib.stride_tricks.sliding_window_view(x, 3), axis=1, kind="stable")
    p = np.unique(order @ np.array([9, 3, 1]), return_counts=True)[1] / len(order)
    return float(-(p * np.log2(p)).sum() / math.log2(6))


class _Counter:
    """How many of the numbers 0 .. n-1 that were added lie below a place: a tree of counts, each of whose levels sums pairs of the one
    below, for whole arrays of additions and questions at a time."""

    def __init__(self, n: int):
        self.levels = [np.zeros(max(1, -(-n // (1 << i))) + 1, np.int64) for i in range(max(1, (max(1, n) - 1).bit_length()) + 1)]

    def add(self, places: np.ndarray, by: int = 1) -> None:
        for i, level in enumerate(self.levels):
            np.add.at(level, places >> i, by)

    def below(self, ends: np.ndarray) -> np.ndarray:
        out = np.zeros(len(ends), np.int64)
        for i, level in enumerate(self.levels):
            odd = (ends >> i) & 1 == 1
            out[odd] += level[(ends[odd] >> i) - 1]
        return out


def near_pairs(a: np.ndarray, b: np.ndarray, far: float, block: int = 2048) -> int:
    """Pairs (i, j), i = j included and both orders counted, with |a_i - a_j| < far and |b_i - b_j| < far: a sweep over sorted a, in
    blocks, with a tree of counts over the ranks of b for values in reach of the whole block, and the block's edges by comparison."""
    order = np.argsort(a, kind="stable")
    a, b = a[order], b[order]
    n = len(a)
    low, high = _reach(a, far)
    ranked = np.sort(b)
    place = np.argsort(np.argsort(b, kind="stable"), kind="stable")
    at = np.searchsorted(ranked, b)
    b_low, b_high = _reach(ranked, far)
    b_low, b_high = b_low[at], b_high[at]
    tree, first, last, total = _Counter(n), 0, 0, 0
    for lo in range(0, n, block):
        mine = slice(lo, min(lo + block, n))
        # All of the block reach the values from the last one's lowest to the first one's highest.
        inner = (int(low[mine].max()), int(high[mine].min()))
        edges = [(int(low[mine].min()), int(high[mine].max()))]
        if inner[0] < inner[1]:
            tree.add(place[last : inner[1]])
            tree.add(place[first : inner[0]], -1)
            first, last = inner[0], max(last, inner[1])
            total += int((tree.below(b_high[mine]) - tree.below(b_low[mine])).sum())
            edges = [(edges[0][0], inner[0]), (inner[1], edges[0][1])]
        for s, e in edges:
            for t in range(s, e, 8 * block):
                other = slice(t, min(t + 8 * block, e))
                j = np.arange(other.start, other.stop)
                inside = (j[None] >= low[mine, None]) & (j[None] < high[mine, None])
                total += int((inside & (np.abs(b[mine, None] - b[None, other]) < far)).sum())
    return total


def _reach(s: np.ndarray, far: float) -> tuple[np.ndarray, np.ndarray]:
    """Of each of sorted values the places from and up to which others are nearer than far, by the very comparison of differences."""
    low, high = np.searchsorted(s, s - far, "left"), np.searchsorted(s, s + far, "right")
    for step in (-1, 1):  # sums round: move ends until differences agree
        while True:
            i = low + (step == -1) * -1
            ok = (i >= 0) & (i < len(s)) & ((np.abs(s - s[np.clip(i, 0, len(s) - 1)]) < far) == (step == -1))
            if not ok.any():
                break
            low = np.where(ok, low + step, low)
        while True:
            i = high if step == 1 else high - 1
            ok = (i >= 0) & (i < len(s)) & ((np.abs(s[np.clip(i, 0, len(s) - 1)] - s) < far) == (step == 1))
            if not ok.any():
                break
            high = np.where(ok, high + step, high)
    return low, high


def bds(x: np.ndarray, dim: int = 2, width: float = 1.5, block: int = 2048) -> tuple[float, float]:
    """Independence test of pairs of neighbours (dim 2) by correlation sums at distance width * deviation over all pairs; statistic and
    two-sided p. Sums over one value come from sorting, those over two from a sweep with a tree of counts: n log n."""
    if dim != 2:
        raise ValueError("pairs of neighbours only")
    x = np.asarray(x, float)
    n, far = len(x), width * x.std(ddof=1)
    m = n - 1
    order = np.argsort(x, kind="stable")
    low, high = _reach(x[order], far)
    rows = np.empty(n)
    rows[order] = high - low - 1
    later = rows.sum() - 2 * rows[0]  # without the first value
    joint = near_pairs(x[:-1], x[1:], far, block)
    c1, cm = later / ((n - 1) * (n - 2)), (joint - m) / (m * (m - 1))
    c = rows.sum() / (n * (n - 1))
    k = (rows * (rows - 1)).sum() / (n * (n - 1) * (n - 2))
    var = 4 * (k**2 + 2 * k * c**2 + c**4 - 4 * k * c**2)
    stat = math.sqrt(m) * (cm - c1**2) / math.sqrt(max(var, 1e-300))
    return float(stat), 2 * (1 - normal_cdf(abs(stat)))


def ar1_residuals(x: np.ndarray) -> np.ndarray:
    """What a least-squares line of each value on the one before leaves."""
    x = np.asarray(x, float)
    before, now = x[:-1] - x[:-1].mean(), x[1:] - x[1:].mean()
    square = before @ before
    return now - before * (before @ now / square if square > 0 else 0.0)


def ranks(x: np.ndarray) -> np.ndarray:
    """Ranks of each column's values from 1, ties at their mean."""
    out = np.empty(x.shape)
    for i, c in enumerate(x.T):
        _, back, times = np.unique(c, return_inverse=True, return_counts=True)
        out[:, i] = (np.cumsum(times) - (times - 1) / 2)[back]
    return out


def spearman(x: np.ndarray) -> np.ndarray:
    with np.errstate(invalid="ignore", divide="ignore"):
        return np.corrcoef(ranks(x), rowvar=False).reshape(x.shape[1], x.shape[1])


def _digamma(v: np.ndarray) -> np.ndarray:
    v = np.asarray(v, float)
    low = np.zeros_like(v)
    for _ in range(10):
        small = v < 10
        low = low - np.where(small, 1 / v, 0.0)
        v = np.where(small, v + 1, v)
    return low + np.log(v) - 1 / (2 * v) - 1 / (12 * v**2) + 1 / (120 * v**4) - 1 / (252 * v**6) + 1 / (240 * v**8)


#: Just inside a distance, by more than sums round.
_WITHIN = 1 - 1e-10


def _neighbour(s: np.ndarray, k: int) -> np.ndarray:
    """Of each of sorted values the distance to its k-th nearest other."""
    n, best = len(s), np.full(len(s), np.inf)
    for left in range(k + 1):
        i = np.arange(left, n - (k - left))
        best[i] = np.minimum(best[i], np.maximum(s[i] - s[i - left], s[i + k - left] - s[i]))
    return best


def mutual_information(x: np.ndarray, y: np.ndarray, k: int = 3) -> float:
    """Of a continuous and a binary variable, by nearest neighbours within the class."""
    x, y = np.asarray(x, float), np.asarray(y)
    x = x / (x.std() or 1.0)
    parts, radius, sizes = [], np.zeros(len(x)), np.zeros(len(x))
    for label in np.unique(y):
        at = np.flatnonzero(y == label)
        if len(at) > k:
            at = at[np.argsort(x[at], kind="stable")]
            radius[at], sizes[at] = _WITHIN * _neighbour(x[at], k), len(at)
            parts.append(at)
    if not parts:
        return 0.0
    at = np.concatenate(parts)
    s = np.sort(x[at])
    m = np.searchsorted(s, x[at] + radius[at], "right") - np.searchsorted(s, x[at] - radius[at], "left")
    return max(0.0, float(_digamma(np.array(len(at))) + _digamma(np.array(k)) - _digamma(sizes[at]).mean() - _digamma(np.maximum(1, m)).mean()))


def kth_neighbour(x: np.ndarray, y: np.ndarray, k: int, leaf: int = 64) -> np.ndarray:
    """Of each point of the plane the greater of both distances to its k-th nearest other: a k-d tree of leaves of points, each of which
    looks into the leaves that its own k-th distances reach."""
    points, n = np.column_stack([x, y]), len(x)
    order, nodes, open_ = np.arange(n), [], [(0, n)]
    while open_:  # nodes: first place, end, lower and upper corner, places of both children
        lo, hi = open_.pop()
        own = points[order[lo:hi]]
        low, high = own.min(axis=0), own.max(axis=0)
        nodes.append([lo, hi, low, high])
        if hi - lo > leaf:
            middle, axis = (lo + hi) // 2, int((high - low).argmax())
            order[lo:hi] = order[lo:hi][np.argpartition(own[:, axis], middle - lo)]
            open_ += [(middle, hi), (lo, middle)]
    # Nodes stand in preorder, so a node's subtree is the run of those after it within its places.
    sizes = np.ones(len(nodes), np.int64)
    for i in range(len(nodes) - 1, -1, -1):
        if nodes[i][1] - nodes[i][0] > leaf:
            sizes[i] = 1 + sizes[i + 1] + sizes[i + 1 + sizes[i + 1]]
    out = np.empty(n)
    for lo, hi, low, high in (node for node in nodes if node[1] - node[0] <= leaf):
        mine = points[order[lo:hi]]
        far = np.abs(mine[:, None] - mine[None]).max(axis=2)
        best = np.partition(far, k, axis=1)[:, k] if hi - lo > k else np.full(hi - lo, np.inf)
        reach = best.max()
        if reach > 0:
            at, found = 0, []
            while at < len(nodes):
                a, b, corner, other = nodes[at]
                if (corner > high + reach).any() or (other < low - reach).any():
                    at += int(sizes[at])
                    continue
                if b - a <= leaf:
                    found.append(order[a:b])
                at += 1
            near = np.empty((hi - lo, 0))
            for part in np.array_split(np.concatenate(found), max(1, sum(map(len, found)) // 65536)):
                near = np.concatenate([near, np.abs(mine[:, None] - points[part][None]).max(axis=2)], axis=1)
                near = np.partition(near, k, axis=1)[:, : k + 1] if near.shape[1] > k else near
            best = near[:, k]
        out[order[lo:hi]] = best
    return out


def mutual_information_of_series(x: np.ndarray, y: np.ndarray, k: int = 3) -> float:
    """Of two continuous variables, by nearest neighbours in the greater of both distances."""
    x, y = (np.asarray(v, float) / (np.std(v) or 1.0) for v in (x, y))
    n = len(x)
    if n <= k:
        return 0.0
    radius = _WITHIN * kth_neighbour(x, y, k)
    within = lambda v: np.searchsorted(np.sort(v), v + radius, "right") - np.searchsorted(np.sort(v), v - radius, "left")
    return max(0.0, float(_digamma(np.array(n)) + _digamma(np.array(k)) - _digamma(within(x)).mean() - _digamma(within(y)).mean()))


def granger(x: np.ndarray, y: np.ndarray, lags: int = 2) -> tuple[float, int]:
    """Least p over 1..lags of whether x's past helps to foretell y, and the lag that gives it."""
    best, at = 1.0, 1
    for k in range(1, lags + 1):
        t = y[k:]
        own = np.column_stack([np.ones(len(t)), *(y[k - j : len(y) - j] for j in range(1, k + 1))])
        both = np.column_stack([own, *(x[k - j : len(x) - j] for j in range(1, k + 1))])
        left = len(t) - both.shape[1]
        if left <= 0:
            continue
        s0, s1 = ols(own, t)[2], ols(both, t)[2]
        p = f_sf((s0 - s1) / k / max(s1 / left, 1e-300), k, left)
        if p < best:
            best, at = p, k
    return best, at


def vif_kept(corr: np.ndarray, most: float = 4.0) -> list[int]:
    """Columns left when the one of largest variance inflation goes until none is over `most`."""
    kept = list(range(len(corr)))
    while len(kept) > 1:
        v = np.diag(np.linalg.pinv(corr[np.ix_(kept, kept)]))
        if v.max() <= most:
            break
        kept.pop(int(v.argmax()))
    return kept


def correlated_kept(corr: np.ndarray, most: float = 0.8) -> list[int]:
    """Columns that correlate with no earlier one by more than `most`."""
    return [j for j in range(len(corr)) if not (np.abs(corr[:j, j]) > most).any()]


def average_linkage(distance: np.ndarray, cut: float) -> list[int]:
    """Cluster of each item: the two nearest by mean distance join until none are within `cut`."""
    d = np.array(distance, float)
    np.fill_diagonal(d, np.inf)
    of, size = list(range(len(d))), np.ones(len(d))
    while len(d) > 1:
        i, j = np.unravel_index(d.argmin(), d.shape)
        if d[i, j] > cut or i == j:
            break
        joined = (d[i] * size[i] + d[j] * size[j]) / (size[i] + size[j])
        d[i], d[:, i] = joined, joined
        d[j], d[:, j] = np.inf, np.inf
        d[i, i] = d[i, j] = d[j, i] = np.inf
        size[i] += size[j]
        of = [int(i) if g == j else g for g in of]
    names = {g: n for n, g in enumerate(dict.fromkeys(of))}
    return [names[g] for g in of]


def ward_clusters(distance: np.ndarray, most: int) -> list[int]:
    """Cluster of each item: the two whose joining adds least variance join (Lance and Williams 1967) until at most `most` are left, and
    then those that would add no more than the last."""
    d2 = np.array(distance, float) ** 2
    n = len(d2)
    of, size, alive = np.arange(n), np.ones(n), np.ones(n, bool)
    np.fill_diagonal(d2, np.inf)
    last = -np.inf
    while alive.sum() > 1:
        i, j = sorted(np.unravel_index(d2.argmin(), d2.shape))
        if alive.sum() <= most and not d2[i, j] <= last * (1 + 1e-12):
            break
        last = max(last, d2[i, j])
        joined = ((size[i] + size) * d2[i] + (size[j] + size) * d2[j] - size * d2[i, j]) / (size[i] + size[j] + size)
        d2[i], d2[:, i] = joined, joined
        size[i] += size[j]
        alive[j] = False
        d2[~alive], d2[:, ~alive], d2[i, i] = np.inf, np.inf, np.inf
        of[of == j] = i
    names = {g: c for c, g in enumerate(dict.fromkeys(of.tolist()))}
    return [names[g] for g in of.tolist()]


def medoids(distance: np.ndarray, clusters: list[int]) -> list[int]:
    """Of each cluster the item of least distance to its others in sum, the first of several."""
    of = np.asarray(clusters)
    groups = [np.flatnonzero(of == c) for c in dict.fromkeys(clusters)]
    return [int(g[distance[np.ix_(g, g)].sum(axis=1).argmin()]) for g in groups]


def logistic(x: np.ndarray, y: np.ndarray, c: float = 0.03, balanced: bool = True, steps: int = 60) -> np.ndarray:
    """Coefficients and intercept of ridge logistic regression by Newton's method; the intercept isn't penalised."""
    n, k = x.shape
    w = np.where(y == 1, n / (2 * max(1, (y == 1).sum())), n / (2 * max(1, (y == 0).sum()))) if balanced else np.ones(n)
    m = np.column_stack([x, np.ones(n)])
    ridge = np.append(np.full(k, 1 / c), 0.0)
    b = np.zeros(k + 1)
    for _ in range(steps):
        p = 1 / (1 + np.exp(-np.clip(m @ b, -35, 35)))
        g = m.T @ (w * (p - y)) + ridge * b
        step = np.linalg.solve((m * (w * p * (1 - p))[:, None]).T @ m + np.diag(ridge + 1e-10), g)
        b -= step
        if np.abs(step).max() < 1e-10:
            break
    return b


def bounded_platt(score: np.ndarray, y: np.ndarray, a: tuple = (0.1, 2.5), b: tuple = (-1.5, 1.5), steps: int = 200) -> tuple[float, float]:
    """Slope and offset of a logistic map of scores within bounds: projected Newton steps with halving."""
    lo, hi = np.array([a[0], b[0]]), np.array([a[1], b[1]])
    m = np.column_stack([score, np.ones(len(score))])
    loss = lambda t: float(np.logaddexp(0, m @ t).sum() - y @ (m @ t))
    at = np.array([1.0, 0.0])
    for _ in range(steps):
        p = 1 / (1 + np.exp(-np.clip(m @ at, -35, 35)))
        g = m.T @ (p - y)
        free = ~(((at <= lo) & (g > 0)) | ((at >= hi) & (g < 0)))
        if not free.any():
            break
        h = (m * (p * (1 - p))[:, None]).T @ m + 1e-9 * np.eye(2)
        step = np.zeros(2)
        step[free] = np.linalg.solve(h[np.ix_(free, free)], g[free])
        rate = 1.0
        while rate > 1e-8 and loss(new := np.clip(at - rate * step, lo, hi)) > loss(at):
            rate /= 2
        if rate <= 1e-8 or np.abs(new - at).max() < 1e-10:
            break
        at = new
    return float(at[0]), float(at[1])


def difference_weights(d: float, size: int = 100, least: float = 1e-4) -> list[float]:
    """Binomial weights of a fractional difference, from the current value back, until they fall below `least`."""
    w = [1.0]
    while len(w) < size and abs(nxt := -w[-1] * (d - len(w) + 1) / len(w)) >= least:
        w.append(nxt)
    return w


def difference(x: np.ndarray, weights: list[float]) -> np.ndarray:
    """Weighted sums of the values before each, without its own."""
    x = np.asarray(x, float)
    k = len(weights)
    if len(x) <= k:
        return np.zeros(0)
    return np.lib.stride_tricks.sliding_window_view(x, k)[:-1] @ np.array(weights[::-1])


def optimal_difference(x: np.ndarray, step: float = 0.05, size: int = 100) -> tuple[float, float, float]:
    """Least order whose difference is stationary at 5 %, the p there, and its correlation with the level."""
    x = np.asarray(x, float)
    if len(x) < 50:
        return 1.0, 1.0, 0.0
    for i in range(int(round(1 / step)) + 1):
        d = i * step
        y = difference(x, difference_weights(d, min(size, len(x) // 2))) if d else x
        p = adf(y)[1]
        if p < 0.05:
            return d, p, float(np.corrcoef(x[len(x) - len(y) :], y)[0, 1]) if y.std() > 0 else 0.0
    return 1.0, p, 0.0


def two_gaussians(x: np.ndarray, steps: int = 100) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Weights, means and covariances of a two-part mixture, the part of larger first mean last."""
    n, k = x.shape
    order = np.argsort(x[:, 0], kind="stable")
    resp = np.zeros((n, 2))
    resp[order[: n // 2], 0] = resp[order[n // 2 :], 1] = 1
    for _ in range(steps):
        mass = resp.sum(axis=0) + 1e-10
        mean = resp.T @ x / mass[:, None]
        cov = np.stack([(resp[:, [j]] * (x - mean[j])).T @ (x - mean[j]) / mass[j] + 1e-6 * np.eye(k) for j in range(2)])
        new = responsibilities(x, mass / n, mean, cov)
        if np.abs(new - resp).max() < 1e-6:
            break
        resp = new
    turn = np.argsort(mean[:, 0])
    return (mass / n)[turn], mean[turn], cov[turn]


def responsibilities(x: np.ndarray, weight: np.ndarray, mean: np.ndarray, cov: np.ndarray) -> np.ndarray:
    logs = np.stack([math.log(weight[j]) - 0.5 * np.linalg.slogdet(cov[j])[1] - 0.5 * np.einsum("ni,ij,nj->n", x - mean[j], np.linalg.inv(cov[j]), x - mean[j]) for j in range(2)], axis=1)
    p = np.exp(logs - logs.max(axis=1, keepdims=True))
    return p / p.sum(axis=1, keepdims=True)


def prefix_products(m: np.ndarray) -> np.ndarray:
    """Products m[0], m[0] m[1], ... of a stack of small matrices, each scaled to a largest entry of 1, by doubling."""
    out = m / np.maximum(np.abs(m).max(axis=(1, 2), keepdims=True), 1e-300)
    step = 1
    while step < len(out):
        joined = out[:-step] @ out[step:]
        out[step:] = joined / np.maximum(np.abs(joined).max(axis=(1, 2), keepdims=True), 1e-300)
        step *= 2
    return out


class Chain:
    """A hidden chain of two states, each with a mean and a variance: `stay` holds both chances to stay."""

    def __init__(self, mean, var, stay):
        self.mean, self.var, self.stay = (np.asarray(v, float) for v in (mean, var, stay))
        self.moves = np.array([[self.stay[0], 1 - self.stay[0]], [1 - self.stay[1], self.stay[1]]])

    def lasting(self) -> np.ndarray:
        """The chain's stationary distribution."""
        leave = 1 - self.stay[::-1]
        return leave / leave.sum() if leave.sum() > 0 else np.array([0.5, 0.5])

    def density(self, x: np.ndarray) -> np.ndarray:
        """Of each value in each state, scaled alike in both so that a far value doesn't vanish."""
        logs = -0.5 * (np.log(self.var) + (x[:, None] - self.mean) ** 2 / self.var)
        return np.exp(logs - logs.max(axis=1, keepdims=True))

    def steps(self, x: np.ndarray) -> np.ndarray:
        """What each value does to the (row of) chances before it."""
        return self.moves[None] * self.density(x)[:, None, :]

    def map_of(self, x: np.ndarray) -> np.ndarray:
        """What all values together do."""
        return prefix_products(self.steps(x))[-1]

    def filtered(self, x: np.ndarray, before: np.ndarray) -> np.ndarray:
        p = before @ prefix_products(self.steps(x))
        return p / p.sum(axis=1, keepdims=True)

    def moments(self, x: np.ndarray, before: np.ndarray, after: np.ndarray) -> np.ndarray:
        """Expected counts of the states, sums and squares of the values in each, and counts of the four moves, given the chances
        before the block and what the values after it say of its last state."""
        f = self.density(x)
        ahead = before @ prefix_products(self.steps(x))
        ahead /= ahead.sum(axis=1, keepdims=True)
        back = np.empty_like(ahead)
        back[-1] = after
        if len(x) > 1:
            turned = np.swapaxes(self.steps(x)[:0:-1], 1, 2)
            back[-2::-1] = np.einsum("j,njk->nk", after, prefix_products(turned))
        back /= back.sum(axis=1, keepdims=True)
        state = ahead * back
        state /= state.sum(axis=1, keepdims=True)
        earlier = np.vstack([before, ahead[:-1]])
        moves = earlier[:, :, None] * self.moves[None] * (f * back)[:, None, :]
        moves /= moves.sum(axis=(1, 2), keepdims=True)
        return np.concatenate([state.sum(axis=0), state.T @ x, state.T @ (x * x), moves.sum(axis=0).ravel()])

    @staticmethod
    def start(mean: float, var: float) -> Chain:
        return Chain([mean, mean], [0.25 * var, 1.75 * var], [0.95, 0.9])

    @staticmethod
    def of_moments(s: np.ndarray, floor: float) -> Chain:
        """The likeliest chain for expected moments, the state of smaller variance first. A variance is at least `floor`, so that no
        state shrinks to one value."""
        n, total, square, moves = s[:2], s[2:4], s[4:6], s[6:].reshape(2, 2)
        mean = total / np.maximum(n, 1e-300)
        var = np.maximum(square / np.maximum(n, 1e-300) - mean**2, floor)
        stay = np.clip(np.diag(moves) / np.maximum(moves.sum(axis=1), 1e-300), 1e-6, 1 - 1e-6)
        order = np.argsort(var, kind="stable")
        return Chain(mean[order], var[order], stay[order])

    def change(self, other: Chain) -> float:
        """How far two chains are apart, in deviations, shares and chances."""
        sd = np.sqrt(self.var.max())
        return float(max(np.abs(self.mean - other.mean).max() / sd, np.abs(np.log(self.var / other.var)).max(), np.abs(self.stay - other.stay).max()))


def chain_messages(chain: Chain, maps: list[np.ndarray]) -> tuple[list[np.ndarray], list[np.ndarray]]:
    """Chances before each of a series' blocks, and what comes after each says, from the blocks' maps."""
    before, after = [chain.lasting()], [np.array([0.5, 0.5])]
    for m in maps[:-1]:
        p = before[-1] @ m
        before.append(p / p.sum())
    for m in maps[:0:-1]:
        p = m @ after[-1]
        after.append(p / p.sum())
    return before, after[::-1]


def fit_chain(x: np.ndarray, steps: int = 500, close: float = 1e-7) -> Chain | None:
    """The chain that expectation maximisation finds for a series; none for under 10 values or without variance."""
    if len(x) < 10 or not x.var() > 1e-16:
        return None
    chain = Chain.start(x.mean(), x.var())
    for _ in range(steps):
        (before,), (after,) = chain_messages(chain, [np.eye(2)])
        new = Chain.of_moments(chain.moments(x, before, after), 1e-4 * x.var())
        moved, chain = chain.change(new), new
        if moved < close:
            break
    return chain
