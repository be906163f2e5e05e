"""Small numpy reference implementations used only by the tests."""

import itertools

import numpy as np


def pairs_within(X, eps):
    n = len(X)
    D = np.sqrt(((X[:, None, :] - X[None, :, :]) ** 2).sum(-1))
    return {(i, j) for i in range(n) for j in range(i + 1, n) if D[i, j] <= eps}, D


def components(n, edges):
    parent = list(range(n))

    def find(x):
        while parent[x] != x:
            parent[x] = parent[parent[x]]
            x = parent[x]
        return x
    for a, b in edges:
        ra, rb = find(a), find(b)
        if ra != rb:
            parent[max(ra, rb)] = min(ra, rb)
    lab = [find(i) for i in range(n)]
    mins = {}
    for i, r in enumerate(lab):
        mins[r] = min(mins.get(r, i), i)
    return [mins[r] for r in lab]


def dbscan(X, eps, min_samples):
    """O(n^2) DBSCAN with our tie rules: label = least core id, border -> least cluster."""
    n = len(X)
    _, D = pairs_within(X, eps)
    nb = D <= eps
    core = nb.sum(1) >= min_samples
    edges = [(i, j) for i in range(n) for j in range(i + 1, n) if nb[i, j] and core[i] and core[j]]
    comp = components(n, edges)
    lab = np.full(n, -1)
    for i in range(n):
        if core[i]:
            lab[i] = comp[i]
    for i in range(n):
        if not core[i]:
            cands = [lab[j] for j in range(n) if nb[i, j] and core[j]]
            if cands:
                lab[i] = min(cands)
    return lab, core


def kruskal_deaths(X, thresh):
    pairs, D = pairs_within(X, thresh)
    edges = sorted((D[i, j], i, j) for i, j in pairs)
    parent = list(range(len(X)))

    def find(x):
        while parent[x] != x:
            parent[x] = parent[parent[x]]
            x = parent[x]
        return x
    deaths = []
    for d, i, j in edges:
        ri, rj = find(i), find(j)
        if ri != rj:
            parent[ri] = rj
            deaths.append(d)
    n_comp = len({find(i) for i in range(len(X))})
    return sorted(x for x in deaths if x > 0), n_comp


def silhouette(X, lab):
    _, D = pairs_within(X, 0)
    s = []
    labs = sorted(set(lab))
    for i in range(len(X)):
        own = lab == lab[i]
        if own.sum() <= 1:
            s.append(0.0)
            continue
        a = D[i, own].sum() / (own.sum() - 1)
        b = min(D[i, lab == c].mean() for c in labs if c != lab[i])
        s.append((b - a) / max(a, b))
    return float(np.mean(s))


def ward_greedy(X):
    """The first pair by (cost rounded to 9 places, lower id, higher id) joins, again and again; the
    joined cluster keeps the lower id. Returns (a, b, height, rows) per merge."""
    n, mean = np.ones(len(X)), np.array(X, dtype=float)
    alive = np.ones(len(X), dtype=bool)
    cost = np.full((len(X), len(X)), np.inf)
    upper = np.triu_indices(len(X), 1)

    def price(i, js):
        d = np.sqrt(((mean[js] - mean[i]) ** 2).sum(1))
        return np.round(np.sqrt(2 * n[i] * n[js] / (n[i] + n[js])) * d, 9)
    for i in range(len(X) - 1):
        cost[i, i + 1:] = price(i, np.arange(i + 1, len(X)))
    out = []
    for _ in range(len(X) - 1):
        k = int(np.argmin(cost[upper]))                    # row-major: the lower ids come first
        a, b = int(upper[0][k]), int(upper[1][k])
        h = float(cost[a, b])
        mean[a] = (n[a] * mean[a] + n[b] * mean[b]) / (n[a] + n[b])
        n[a] += n[b]
        alive[b] = False
        cost[b, :] = cost[:, b] = np.inf
        js = np.flatnonzero(alive)
        js = js[js != a]
        c = price(a, js)
        cost[np.minimum(a, js), np.maximum(a, js)] = c
        out.append((a, b, h, int(n[a])))
    return out

