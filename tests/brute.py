"""A second statement of the mining semantics, by definition and enumeration, over small graphs."""

from itertools import combinations

import numpy as np


def pearson(x, y):
    x, y = np.asarray(x, float), np.asarray(y, float)
    dx, dy = x - x.mean(), y - y.mean()
    n = np.sqrt((dx**2).sum() * (dy**2).sum())
    return (dx * dy).sum() / n if n > 0 else float("nan")


def pairs(series, min_cor):
    """{(e1, e2): r} over {edge: series}; a hair is allowed at the bound, as sums may round apart."""
    out = {}
    for a, b in combinations(sorted(series), 2):
        r = pearson(series[a], series[b])
        if r >= min_cor - 1e-9:
            out[a, b] = r
    return out


def cliques(ps):
    vs = sorted({v for p in ps for v in p})
    full = [set(c) for n in range(1, len(vs) + 1) for c in combinations(vs, n) if all(p in ps for p in combinations(c, 2))]
    return {tuple(sorted(c)) for c in full if not any(c < d for d in full)} if vs else set()


def parts(edges, ends):
    left, out = set(edges), []
    while left:
        grown = {left.pop()}
        while True:
            near = {e for e in left if any(set(ends[e]) & set(ends[g]) for g in grown)}
            if not near:
                break
            grown |= near
            left -= near
        out.append(tuple(sorted(grown)))
    return out


def density(edges, ends, series, k, kind, weighted=False):
    n = len({v for e in edges for v in ends[e]})
    t_max = len(next(iter(series.values())))
    m = [sum(series[e][t] > 0 for e in edges) for t in range(t_max)]
    full = [t for t in range(t_max) if m[t] >= max(1, k)]
    if not full:
        return None
    if kind == "min":
        return min(2 * m[t] / n if len({v for e in edges if series[e][t] > 0 for v in ends[e]}) > 1 else 0 for t in full)
    support = sum(sum(series[e]) if weighted else sum(x > 0 for x in series[e]) for e in edges)
    return 2 * (support - sum(m[t] for t in range(t_max) if t not in full)) / (len(full) * n)


def lattice(edges, ends, series, k, kind, min_den):
    """Dense sets of the peel lattice, recursively, without levels."""
    found, seen = set(), set()

    def dense(s):
        d = density(s, ends, series, k, kind)
        return d is not None and d >= min_den

    def degrees(s):
        out = {}
        for e in s:
            for v in ends[e]:
                out[v] = out.get(v, 0) + 1
        return out

    todo = [frozenset(edges)]
    while todo:
        todo.sort(key=lambda s: len(degrees(s)))
        s = todo.pop()
        if s in seen:
            continue
        seen.add(s)
        deg = degrees(s)
        if len(deg) < 2 or density(s, ends, series, k, kind) is None:
            continue
        if dense(s):
            found.add(tuple(sorted(s)))
            continue
        if max(deg.values()) < min_den:
            continue
        low = [v for v in deg if deg[v] == min(deg.values())]
        drop = lambda vs: frozenset(e for e in s if not set(ends[e]) & set(vs))
        if deg[low[0]] == 1:
            rest = drop(low)
            if rest and rest not in seen and rest not in todo and not dense(rest):
                todo.append(rest)
                continue
        todo += [c for c in (drop([v]) for v in low) if c and c not in seen]
    return found


def choose(rows, max_cc_size, max_jac):
    """The greedy choice over (candidate, class, dense sets), one set after the other."""
    kept, parts = [], {}

    def fits(s, held):
        if any(s <= x for x in held) or (kept and max_jac <= 0):
            return False
        return not any(len(s & x) / len(s | x) >= max_jac for x, *_ in kept)

    for cand, kind, found in sorted(rows, key=lambda r: (-len(r[0]), sorted(r[0]))):
        s = frozenset(cand)
        if len(s) >= max_cc_size or not fits(s, [x for x, *_ in kept] + list(parts)):
            continue
        if kind == "direct":
            kept.append((s, found[0][1], kind))
        elif kind == "extracted":
            for e, d in found:
                parts.setdefault(frozenset(e), d)
    for part in sorted(parts, key=lambda p: (-len(p), sorted(p))):
        if fits(part, [x for x, *_ in kept]):
            kept.append((part, parts[part], "extracted"))
    return [(sorted(s), d, kind) for s, d, kind in kept]
