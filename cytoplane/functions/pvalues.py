"""Numeric kernels of statistical tests, in numpy and the standard library, and Arrow UDFs over them."""

from __future__ import annotations

import math
from functools import lru_cache

import numpy as np
import pandas as pd
from pyspark.sql import functions as F
from pyspark.sql import types as T


def beta_inc(a: float, b: float, x: float) -> float:
    """Regularised incomplete beta function by its continued fraction (Lentz)."""
    if x <= 0 or x >= 1:
        return float(x >= 1)
    if x > (a + 1) / (a + b + 2):
        return 1 - beta_inc(b, a, 1 - x)
    front = math.exp(math.lgamma(a + b) - math.lgamma(a) - math.lgamma(b) + a * math.log(x) + b * math.log1p(-x)) / a
    c, d = 1.0, 1 / (1 - (a + b) * x / (a + 1) or 1e-300)
    out = d
    for m in range(1, 400):
        for num in (m * (b - m) * x / ((a + 2 * m - 1) * (a + 2 * m)), -(a + m) * (a + b + m) * x / ((a + 2 * m) * (a + 2 * m + 1))):
            d = 1 / (1 + num * d or 1e-300)
            c = 1 + num / c or 1e-300
            out *= c * d
        if abs(c * d - 1) < 1e-14:
            break
    return front * out


def t_two_sided(t: float, df: float) -> float:
    if not (math.isfinite(t) and df > 0):
        return float("nan") if math.isnan(t) else 0.0
    return beta_inc(df / 2, 0.5, df / (df + t * t))


@lru_cache(maxsize=4096)
def exact_u(u: float, n1: int, n2: int) -> float:
    """Two-sided exact p of a Mann-Whitney U without ties."""
    ways = np.zeros(n1 * n2 + 1)
    ways[0] = 1
    for i in range(1, n1 + 1):  # Gaussian binomial coefficients
        up = np.zeros(n1 * n2 + 1)
        for k in range(len(ways)):
            up[k] = ways[k] - (ways[k - n2 - i] if k >= n2 + i else 0)
        for k in range(i, len(up)):
            up[k] += up[k - i]
        ways = up
    top = max(u, n1 * n2 - u)
    return min(1.0, 2 * ways[int(math.ceil(top)) :].sum() / ways.sum())


def u_test(u: float, n1: int, n2: int, ties: float) -> float:
    """Two-sided p of U: exact with 8 or fewer on a side and no ties, else normal with tie and continuity correction."""
    if n1 == 0 or n2 == 0:
        return float("nan")
    if min(n1, n2) <= 8 and ties == 0:
        return exact_u(u, n1, n2)
    n = n1 + n2
    s = math.sqrt(max(0.0, n1 * n2 / 12 * ((n + 1) - ties / (n * (n - 1)))))
    if s == 0:
        return 1.0
    return min(1.0, math.erfc((max(u, n1 * n2 - u) - n1 * n2 / 2 - 0.5) / s / math.sqrt(2)))


def ranks(x: np.ndarray) -> np.ndarray:
    """Average ranks from 1."""
    _, inverse, n = np.unique(x, return_inverse=True, return_counts=True)
    return (np.cumsum(n) - (n - 1) / 2)[inverse]


def mann_whitney(a: np.ndarray, b: np.ndarray) -> tuple[float, float]:
    """(U of a, p)."""
    both = np.concatenate([a, b])
    n = np.unique(both, return_counts=True)[1].astype(float)
    u = ranks(both)[: len(a)].sum() - len(a) * (len(a) + 1) / 2
    return float(u), u_test(u, len(a), len(b), float((n**3 - n).sum()))


def t_test(a: np.ndarray, b: np.ndarray, paired: bool = False) -> float:
    """Two-sided p: equal variances, or paired."""
    if paired:
        d = a - b
        if len(d) < 2:
            return float("nan")
        s = d.std(ddof=1)
        return 1.0 if s == 0 and d.mean() == 0 else t_two_sided(d.mean() / (s / math.sqrt(len(d))) if s else math.inf, len(d) - 1)
    df = len(a) + len(b) - 2
    if df < 1 or not len(a) or not len(b):
        return float("nan")
    v = (((a - a.mean()) ** 2).sum() + ((b - b.mean()) ** 2).sum()) / df
    if v == 0:
        return 1.0 if a.mean() == b.mean() else 0.0
    return t_two_sided((a.mean() - b.mean()) / math.sqrt(v * (1 / len(a) + 1 / len(b))), df)


def wilcoxon(a: np.ndarray, b: np.ndarray) -> float:
    """Two-sided signed-rank p: zero differences are left out; exact up to 50 without ties, else normal."""
    d = (a - b)[a != b]
    n = len(d)
    if n == 0:
        return 1.0
    r = ranks(np.abs(d))
    plus = r[d > 0].sum()
    t = np.unique(np.abs(d), return_counts=True)[1].astype(float)
    if n <= 50 and (t == 1).all() and n == len(a):
        ways = np.zeros(n * (n + 1) // 2 + 1)
        ways[0] = 1
        for k in range(1, n + 1):
            ways[k:] = ways[k:] + ways[: len(ways) - k].copy()
        return min(1.0, 2 * ways[: int(min(plus, n * (n + 1) / 2 - plus)) + 1].sum() / ways.sum())
    s = math.sqrt(n * (n + 1) * (2 * n + 1) / 24 - (t**3 - t).sum() / 48)
    return math.erfc(abs(plus - n * (n + 1) / 4) / s / math.sqrt(2)) if s else 1.0


def inversions(v: np.ndarray) -> int:
    """Pairs whose earlier entry is greater, by merging sorted runs of doubling width, all runs of a width at once."""
    v = np.unique(v, return_inverse=True)[1].astype(np.int64)
    n, kinds, at, total, width = len(v), int(v.max(initial=0)) + 1, np.arange(len(v)), 0, 1
    while width < n:
        pair, right = at // (2 * width), at // width % 2 == 1
        key = pair * kinds + v
        left = key[~right]
        total += int((np.searchsorted(left, (pair[right] + 1) * kinds) - np.searchsorted(left, key[right], "right")).sum())
        v = np.sort(key) - pair * kinds
        width *= 2
    return total


def kendall(x: np.ndarray, y: np.ndarray) -> tuple[float, float]:
    """(tau-b, two-sided normal p); discordant pairs are the inversions of y in the order of x, so no pair is made."""
    n = len(x)
    gx, gy = (np.unique(v, return_counts=True)[1].astype(float) for v in (x, y))
    gxy = np.unique(np.stack([x, y]), axis=1, return_counts=True)[1].astype(float)
    pairs = lambda g: (g * (g - 1)).sum() / 2
    tx, ty = n * (n - 1) / 2 - pairs(gx), n * (n - 1) / 2 - pairs(gy)
    if tx == 0 or ty == 0:
        return float("nan"), float("nan")
    s = n * (n - 1) / 2 - pairs(gx) - pairs(gy) + pairs(gxy) - 2 * inversions(y[np.lexsort((y, x))])
    v0 = n * (n - 1) * (2 * n + 5)
    vt, vu = ((g * (g - 1) * (2 * g + 5)).sum() for g in (gx, gy))
    v = (v0 - vt - vu) / 18 + (gx * (gx - 1)).sum() * (gy * (gy - 1)).sum() / (2 * n * (n - 1))
    if n > 2:
        v += (gx * (gx - 1) * (gx - 2)).sum() * (gy * (gy - 1) * (gy - 2)).sum() / (9 * n * (n - 1) * (n - 2))
    return s / math.sqrt(tx * ty), math.erfc(abs(s) / math.sqrt(2 * v)) if v > 0 else 1.0


def inversion_pairs(v: np.ndarray, numbers: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
    """(earlier, later) places of the inversions of v, all of them or those of the sorted ``numbers`` (from 0, in the order in
    which merging runs of doubling width meets them)."""
    v = np.unique(v, return_inverse=True)[1].astype(np.int64)
    n, kinds, at, done, width = len(v), int(v.max(initial=0)) + 1, np.arange(len(v)), 0, 1
    place, found = at.copy(), [(at[:0], at[:0])]
    while width < n:
        pair, right = at // (2 * width), at // width % 2 == 1
        key = pair * kinds + v
        left, lp, rp = key[~right], place[~right], place[right]
        first = np.searchsorted(left, key[right], "right")
        count = np.searchsorted(left, (pair[right] + 1) * kinds) - first
        upto = np.cumsum(count)
        total = int(upto[-1]) if len(upto) else 0
        if numbers is None:
            mine = np.arange(total)
        else:
            mine = numbers[np.searchsorted(numbers, done) : np.searchsorted(numbers, done + total)] - done
        e = np.searchsorted(upto, mine, "right")
        found.append((lp[first[e] + mine - (upto[e] - count[e])], rp[e]))
        order = np.argsort(key, kind="stable")
        v, place, done, width = key[order] - pair * kinds, place[order], done + total, width * 2
    return tuple(np.concatenate(c) for c in zip(*found))


#: Points up to which all pairs are looked at at once, and where the second of a pair comes later.
SMALL = 1024
LATER = np.tri(SMALL, k=-1, dtype=bool).T.copy()


def median_slope(x: np.ndarray, y: np.ndarray, held: int = 1 << 18, drawn: int = 4096, close: float = 1e-9) -> float:
    """The median slope over pairs with different x (nan without such pairs), in time n log n and memory of ``held`` pairs.

    Slopes under s are the inversions of y - s * x in the order of x; those between two bounds are the inversions between the
    orders of the points at the two. Bounds around the middle ranks are narrowed by slopes drawn from between them, until
    few enough are left to be looked at one by one. Many equal slopes are told by bounds ``close`` to them, in proportion
    to them and to the slope of the box around the points; else the result is exact. Values that aren't finite take no part.
    """
    fine = np.isfinite(x) & np.isfinite(y)
    x, y = np.asarray(x, float)[fine], np.asarray(y, float)[fine]
    order = np.lexsort((y, x))
    x, y = x[order], y[order]
    n, ties = len(x), np.unique(x, return_counts=True)[1].astype(np.int64)
    total = n * (n - 1) // 2 - int((ties * (ties - 1) // 2).sum())
    if not total:
        return float("nan")
    ranks, scale = ((total - 1) // 2, total // 2), float((y.max() - y.min()) / (x.max() - x.min()))
    if not scale:
        return 0.0
    if n <= SMALL:
        away, up, later = x - x[:, None], y - y[:, None], LATER[:n, :n]
        some = later if total == n * (n - 1) // 2 else later & (away > 0)
        slopes = np.partition(up[some] / away[some], ranks)
        return float((slopes[ranks[0]] + slopes[ranks[1]]) / 2)
    rng, rounds = np.random.default_rng(17), 0

    def under(s: float) -> int:
        r = y - s * x
        return inversions(r[np.lexsort((r, x))])

    def between(low: float, high: float, numbers: np.ndarray | None) -> np.ndarray:
        """Slopes of at least ``low`` and under ``high``, all or those of the numbers."""
        a = y - low * x if np.isfinite(low) else x
        b = y - high * x if np.isfinite(high) else -x
        order = np.lexsort((y, x, a)) if np.isfinite(low) else np.lexsort((b, a))
        i, j = inversion_pairs(b[order], numbers)
        i, j = order[i], order[j]
        return (y[j] - y[i]) / (x[j] - x[i])

    low, high, before, after = -np.inf, np.inf, 0, total  # slopes under each
    while after - before > held:
        inside, rounds = after - before, rounds + 1
        held = held * 2 if rounds > 24 else held  # bounds that rounding keeps from falling between slopes
        some = np.sort(between(low, high, np.sort(rng.integers(0, inside, drawn))))
        here, spare = (ranks[0] + 0.5 - before) / inside * len(some), 2 * len(some) ** 0.5
        a, b = (int(np.clip(here + d, 0, len(some) - 1)) for d in (-spare, spare))
        if some[a] == some[b]:  # ties fill the middle
            width = max(abs(some[a]), scale) * close
            new = (max(low, some[a] - width), min(high, some[a] + width))
        else:
            kinds = np.unique(some)
            i, j = np.searchsorted(kinds, [some[a], some[b]])
            new = (float((kinds[i - 1] + kinds[i]) / 2) if i else low, float((kinds[j] + kinds[j + 1]) / 2) if j + 1 < len(kinds) else high)
        counts = [before if new[0] == low else under(new[0]), after if new[1] == high else under(new[1])]
        if counts[0] <= ranks[0] and ranks[1] < counts[1]:
            if some[a] == some[b]:
                return float(some[a])
            if counts == [before, after]:
                held *= 2  # no bound lies between the slopes that are left
            low, high, before, after = *new, *counts
        elif ranks[0] < counts[0]:
            high, after = (new[0], counts[0]) if ranks[1] < counts[0] else (high, after)
            held = held if ranks[1] < counts[0] else held * 2  # the two middle ranks lie on both sides
        else:
            low, before = (new[1], counts[1]) if ranks[0] >= counts[1] else (low, before)
            held = held if ranks[0] >= counts[1] else held * 2
    rest = np.sort(between(low, high, None))
    at = np.clip(np.array(ranks) - before, 0, len(rest) - 1)
    return float((rest[at[0]] + rest[at[1]]) / 2)


def fisher(a: int, b: int, c: int, d: int) -> float:
    """Two-sided p of [[a, b], [c, d]]: tables no likelier than the one seen."""
    n, r, k = a + b + c + d, a + b, a + c
    lg = math.lgamma
    base = lg(r + 1) + lg(n - r + 1) + lg(k + 1) + lg(n - k + 1) - lg(n + 1)
    logs = np.array([base - lg(i + 1) - lg(r - i + 1) - lg(k - i + 1) - lg(n - r - k + i + 1) for i in range(max(0, r + k - n), min(r, k) + 1)])
    seen = logs[a - max(0, r + k - n)]
    return float(min(1.0, np.exp(logs[logs <= seen + 1e-7]).sum()))


def doublet_p(x1: int, x2: int, x12: int, n: int, rate: float = 0.05) -> float:
    """How likely x12 or more of the joint observations of two clones are doublets, given at least one."""
    c = (rate / (1 - rate)) ** 2
    lg = math.lgamma

    def term(x: int) -> float:
        top, rest = x1 + x12, n - x2 - x12
        pick = top - x
        if rest < pick:
            return -math.inf
        return x * math.log(c) + lg(top + 1) - lg(x + 1) - lg(pick + 1) + lg(rest + 1) - lg(pick + 1) - lg(rest - pick + 1)

    logs = np.array([term(x) for x in range(1, x12 + min(x1, x2) + 1)])
    if not len(logs) or not np.isfinite(logs).any():
        return float("nan")
    w = np.exp(logs - logs.max())
    return float(w[max(x12, 1) - 1 :].sum() / w.sum())


def dip(x: np.ndarray) -> float:
    """Hartigan's dip, by bisection over the greatest convex minorant and least concave majorant on a common mode."""
    x = np.sort(x)
    n = len(x)
    if n < 4 or x[0] == x[-1]:
        return 1 / (2 * n) if n else 0.0
    f = np.arange(1, n + 1) / n
    best = math.inf

    def hull(px: np.ndarray, py: np.ndarray, sign: int) -> np.ndarray:
        keep: list[int] = []
        for i in range(len(px)):
            while len(keep) > 1 and sign * ((py[i] - py[keep[-2]]) * (px[keep[-1]] - px[keep[-2]]) - (py[keep[-1]] - py[keep[-2]]) * (px[i] - px[keep[-2]])) <= 0:
                keep.pop()
            keep.append(i)
        return np.interp(px, px[keep], py[keep])

    for m in np.unique(np.linspace(1, n - 1, min(n - 1, 64)).astype(int)):
        left = np.abs(hull(x[:m], f[:m] - 1 / n, 1) - f[:m]).max()
        right = np.abs(hull(x[m:], f[m:], -1) - f[m:]).max()
        best = min(best, max(left, right) / 2)
    return float(max(best, 1 / (2 * n)))


@F.pandas_udf(T.DoubleType())
def erfc(x: pd.Series) -> pd.Series:
    return x.map(math.erfc, na_action="ignore")


@F.pandas_udf(T.DoubleType())
def u_test_udf(u: pd.Series, n1: pd.Series, n2: pd.Series, ties: pd.Series) -> pd.Series:
    return pd.Series([u_test(a, int(b), int(c), d) for a, b, c, d in zip(u, n1, n2, ties)])


@F.pandas_udf(T.DoubleType())
def fisher_udf(a: pd.Series, b: pd.Series, c: pd.Series, d: pd.Series) -> pd.Series:
    return pd.Series([fisher(*map(int, r)) for r in zip(a, b, c, d)])


@F.pandas_udf(T.DoubleType())
def doublet_udf(x1: pd.Series, x2: pd.Series, x12: pd.Series, n: pd.Series, rate: pd.Series) -> pd.Series:
    return pd.Series([doublet_p(int(a), int(b), int(c), int(d), r) for a, b, c, d, r in zip(x1, x2, x12, n, rate)])


@F.pandas_udf(T.DoubleType())
def t_two_sided_udf(t: pd.Series, df: pd.Series) -> pd.Series:
    return pd.Series([t_two_sided(a, b) for a, b in zip(t, df)])


def gamma_upper(a: float, x: float) -> float:
    """Regularised upper incomplete gamma function: a series below a + 1, else a continued fraction (Lentz)."""
    if x <= 0:
        return 1.0
    front = math.exp(a * math.log(x) - x - math.lgamma(a))
    if x < a + 1:
        term = total = 1 / a
        k = a
        while term > total * 1e-16:
            k += 1
            term *= x / k
            total += term
        return max(0.0, 1 - front * total)
    b = x + 1 - a
    c, d = 1e300, 1 / b
    out = d
    for i in range(1, 1000):
        n = i * (a - i)
        b += 2
        d = 1 / (n * d + b or 1e-300)
        c = b + n / c or 1e-300
        out *= c * d
        if abs(c * d - 1) < 1e-15:
            break
    return front * out


def kolmogorov(t: float) -> float:
    """The chance that the limit of sqrt(n) * D exceeds t."""
    if t < 0.2:
        return 1.0
    return min(1.0, max(0.0, 2 * sum((-1) ** (k - 1) * math.exp(-2 * k * k * t * t) for k in range(1, 101))))


@F.pandas_udf(T.DoubleType())
def chi_square_udf(statistic: pd.Series, df: pd.Series) -> pd.Series:
    return pd.Series([gamma_upper(k / 2, s / 2) if k > 0 else math.nan for s, k in zip(statistic, df)])


@F.pandas_udf(T.DoubleType())
def f_test_udf(f: pd.Series, df1: pd.Series, df2: pd.Series) -> pd.Series:
    return pd.Series([beta_inc(b / 2, a / 2, b / (b + a * x)) if x == x else math.nan for x, a, b in zip(f, df1, df2)])


@F.pandas_udf(T.DoubleType())
def ks_udf(d: pd.Series, n1: pd.Series, n2: pd.Series) -> pd.Series:
    return pd.Series([kolmogorov(x * math.sqrt(a * b / (a + b))) if x == x else math.nan for x, a, b in zip(d, n1, n2)])
