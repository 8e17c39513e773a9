"""Cross mapping in plain Python loops, to compare with."""

import hashlib
import math

P = 2147483647


def mixed(seed, series, E, tau, L, sample, j):
    key = f"{seed}:{series}:{E}:{tau}:{L}:{sample}"
    t = int(hashlib.md5(key.encode()).hexdigest()[:15], 16)
    a = (t % P + j) * 48271 % P
    b = (a * a + (t >> 31)) % P * 69621 % P
    return (b * b + t % P) % P * 65536 + b % 65536


def permuted(seed, series, E, tau, L, sample, j, n):
    """The j-th number of the draw's permutation of 0 .. n - 1."""
    t = int(hashlib.md5(f"{seed}:{series}:{E}:{tau}:{L}:{sample}".encode()).hexdigest()[:15], 16)
    a = max(8, math.ceil(math.sqrt(n)))
    b = max(8, -(-n // a))
    while True:
        l, r = divmod(j, b)
        for k in range(6):
            u = ((l if k % 2 else r) + (t % P * (k + 1) * 7919 + (t >> 31)) % P) % P * 48271 % P
            add = ((u * u + (t >> 31)) % P * 69621 % P) >> 8
            l, r = (l, (r + add) % b) if k % 2 else ((l + add) % a, r)
        j = l * b + r
        if j < n:
            return j


def library(spec, series, E, tau, L, sample, n):
    """{point number: times drawn}"""
    size = min(L, n)
    key = (spec.seed, series, E, tau, L, sample)
    if spec.replacement:
        drawn = [mixed(*key, j) % n for j in range(size)]
    else:
        drawn = [permuted(*key, j, n) for j in range(size)]
    counts = {}
    for pos in drawn:
        counts[pos] = 1 if spec.distinct_library else counts.get(pos, 0) + 1
    return counts


def points(x, E, tau, drop_missing=False):
    """[(i, lag vector)]"""
    out = [(i, [x[i - j * tau] for j in range(E)]) for i in range((E - 1) * tau, len(x))]
    return [p for p in out if None not in p[1]] if drop_missing else out


def distance(a, b):
    if None in a or None in b:
        return None
    total = 0.0
    for u, v in zip(a, b):
        total += (u - v) * (u - v)
    return math.sqrt(total)


def neighbours(spec, pts, lib, i, v, k):
    """[(q, d, m)] in order."""
    found = []
    for pos, m in lib.items():
        q, w = pts[pos]
        d = distance(v, w)
        if q != i and d is not None and not (spec.exclude_zero_distance and d < 1e-30):
            found.append((d, q, m))
    found.sort()
    kept, places = [], k
    for d, q, m in found:
        if places > 0:
            kept.append((q, d, m if spec.ties == "include" else min(m, places)))
            places -= m
        elif spec.ties == "include" and d == kept[-1][1]:
            kept.append((q, d, m))
    return kept


def weights(spec, kept, k):
    if not kept:
        return []
    near, last = kept[0][1], kept[-1][1]
    total, tied = sum(m for *_, m in kept), sum(m for _, d, m in kept if d == last)
    out = []
    for _, d, _ in kept:
        if d == 0:
            w = 1.0
        elif near != 0:
            w = max(math.exp(-d / near), spec.weight_floor)
        else:
            w = spec.weight_floor
        if spec.ties == "include" and total > k and d == last:
            w *= (tied + k - total) / tied
        out.append(w)
    return out


def cross_map(spec, series):
    """{(series, E, tau, L, sample): (n_pred, rho, mae)} for {name: (x, y)}."""
    result = {}
    for name, (x, y) in series.items():
        for E, tau in spec.pairs:
            pts = points(x, E, tau, spec.drop_missing)
            for L in spec.L if pts else ():
                for sample in range(spec.samples):
                    lib = library(spec, name, E, tau, L, sample, len(pts))
                    pairs = []
                    for i, v in pts:
                        kept = neighbours(spec, pts, lib, i, v, E + 1)
                        w = weights(spec, kept, E + 1)
                        if not kept or y[i] is None or any(y[q] is None for q, *_ in kept):
                            continue
                        top = sum(m * a * y[q] for (q, _, m), a in zip(kept, w))
                        pairs.append((y[i], top / sum(m * a for (_, _, m), a in zip(kept, w))))
                    result[name, E, tau, L, sample] = (len(pairs), pearson(pairs), mae(pairs))
    return result


def pearson(pairs):
    if not pairs:
        return 0.0
    n = len(pairs)
    ma, mb = sum(a for a, _ in pairs) / n, sum(b for _, b in pairs) / n
    sa = math.sqrt(sum((a - ma) ** 2 for a, _ in pairs) / n)
    sb = math.sqrt(sum((b - mb) ** 2 for _, b in pairs) / n)
    if sa <= abs(ma) * 1e-12 or sb <= abs(mb) * 1e-12:
        return 0.0
    return sum((a - ma) * (b - mb) for a, b in pairs) / n / (sa * sb)


def mae(pairs):
    return sum(abs(a - b) for a, b in pairs) / len(pairs) if pairs else None
