"""Order-dependent kernels over one sheet or tile as numpy arrays: thinning, component trees, region merging."""

from __future__ import annotations

import numpy as np


def thin(mask: np.ndarray) -> np.ndarray:
    """One-pixel-wide skeleton after Guo and Hall: two alternating passes until nothing goes."""
    out = np.pad(mask.astype(bool), 1)
    while True:
        before = out.sum()
        for odd in (True, False):
            p = {k: out[1 + di : out.shape[0] - 1 + di, 1 + dj : out.shape[1] - 1 + dj] for k, (di, dj) in {2: (-1, 0), 3: (-1, 1), 4: (0, 1), 5: (1, 1), 6: (1, 0), 7: (1, -1), 8: (0, -1), 9: (-1, -1)}.items()}
            c = sum((~p[a] & (p[b] | p[d])).astype(int) for a, b, d in ((2, 3, 4), (4, 5, 6), (6, 7, 8), (8, 9, 2)))
            n1 = sum((p[a] | p[b]).astype(int) for a, b in ((9, 2), (3, 4), (5, 6), (7, 8)))
            n2 = sum((p[a] | p[b]).astype(int) for a, b in ((2, 3), (4, 5), (6, 7), (8, 9)))
            n = np.minimum(n1, n2)
            m = (p[6] | p[7] | ~p[9]) & p[8] if odd else (p[2] | p[3] | ~p[5]) & p[4]
            core = out[1:-1, 1:-1]
            core &= ~((c == 1) & (n >= 2) & (n <= 3) & ~m)
        if out.sum() == before:
            return out[1:-1, 1:-1]


class Sets:
    """Disjoint sets with path halving; the root is what `link` says."""

    def __init__(self, n: int):
        self.up = list(range(n))

    def find(self, x: int) -> int:
        up = self.up
        while up[x] != x:
            up[x] = up[up[x]]
            x = up[x]
        return x

    def link(self, root: int, other: int) -> None:
        self.up[other] = root


def component_tree(z: np.ndarray) -> np.ndarray:
    """Canonical parents (column-major ids from 1) in the tree of bright components of 4-connected cells; roots point to themselves.

    Cells join from the highest down. A component is named by its last cell in stable ascending order; cells of its level point to that."""
    ny, nx = z.shape
    flat = z.T.ravel()
    order = np.argsort(flat, kind="stable")
    parent = np.arange(len(flat))
    sets, done = Sets(len(flat)), np.zeros(len(flat), bool)
    for p in order[::-1].tolist():
        done[p] = True
        i, j = p % ny, p // ny
        for q in ((p - 1) if i else -1, (p + 1) if i + 1 < ny else -1, (p - ny) if j else -1, (p + ny) if j + 1 < nx else -1):
            if q >= 0 and done[q]:
                root = sets.find(q)
                if root != p:
                    parent[root] = p
                    sets.link(p, root)
    for p in order.tolist():
        q = parent[p]
        if flat[parent[q]] == flat[q]:
            parent[p] = parent[q]
    return parent + 1


def merge_regions(z: np.ndarray, k: float, least: int) -> np.ndarray:
    """Labels from 1 of graph-based regions: neighbours (8) merge along ascending differences while the difference is within both
    regions' own plus k over their size; regions below least cells then join a neighbour, least difference first."""
    ny, nx = z.shape
    ids = np.arange(ny * nx).reshape(ny, nx)
    v = z.astype(float)
    pairs = [(ids[:, :-1], ids[:, 1:], v[:, :-1], v[:, 1:]), (ids[:-1], ids[1:], v[:-1], v[1:]), (ids[:-1, :-1], ids[1:, 1:], v[:-1, :-1], v[1:, 1:]), (ids[:-1, 1:], ids[1:, :-1], v[:-1, 1:], v[1:, :-1])]
    a, b, w = (np.concatenate(x) for x in zip(*[(p.ravel(), q.ravel(), np.abs(x - y).ravel()) for p, q, x, y in pairs], strict=True))
    order = np.argsort(w, kind="stable")
    sets, size, inner = Sets(ny * nx), np.ones(ny * nx, int), np.zeros(ny * nx)
    for e in order.tolist():
        x, y = sets.find(int(a[e])), sets.find(int(b[e]))
        if x != y and w[e] <= min(inner[x] + k / size[x], inner[y] + k / size[y]):
            sets.link(x, y)
            size[x] += size[y]
            inner[x] = w[e]
    for e in order.tolist():
        x, y = sets.find(int(a[e])), sets.find(int(b[e]))
        if x != y and min(size[x], size[y]) < least:
            sets.link(x, y)
            size[x] += size[y]
    roots = np.array([sets.find(p) for p in range(ny * nx)])
    return (np.unique(roots, return_inverse=True)[1] + 1).reshape(ny, nx)


def prominence(z: np.ndarray) -> dict[int, float]:
    """Brute force over an array: for each leaf of the component tree (column-major id) its height over the highest saddle to
    higher ground; its height where there is none."""
    parent = component_tree(z) - 1
    flat = z.T.ravel()
    top = flat.astype(float).copy()
    for p in np.argsort(flat, kind="stable")[::-1].tolist():
        top[parent[p]] = max(top[parent[p]], top[p])
    for _ in range(2):
        for p in np.argsort(-flat, kind="stable").tolist():
            top[parent[p]] = max(top[parent[p]], top[p])
    leaves = set(range(len(flat))) - set(parent.tolist())
    out = {}
    for s in leaves:
        q, found = s, float(flat[s])
        while True:
            up = int(parent[q])
            if up == q:
                break
            q = up
            if top[q] > flat[s]:
                found = float(flat[s] - flat[q])
                break
        out[s + 1] = found
    return out


def connected(values: np.ndarray) -> np.ndarray:
    """Labels of 4-connected cells of equal value: the least column-major id (from 1) of each region; 0 where a value is NaN.

    Roots of neighbouring regions hook to the lesser one and paths are halved, all cells at once: few rounds, whatever the shapes."""
    ny, nx = values.shape
    ids = np.arange(ny * nx).reshape(nx, ny).T
    down, right = values[:-1] == values[1:], values[:, :-1] == values[:, 1:]
    a = np.concatenate([ids[:-1][down], ids[:, :-1][right]])
    b = np.concatenate([ids[1:][down], ids[:, 1:][right]])
    root = np.arange(ny * nx)
    while len(a):
        x, y = root[a], root[b]
        apart = x != y
        a, b, x, y = a[apart], b[apart], x[apart], y[apart]
        np.minimum.at(root, np.maximum(x, y), np.minimum(x, y))
        while True:
            up = root[root]
            if (up == root).all():
                break
            root = up
    return np.where(np.isnan(values), 0, (root + 1).reshape(nx, ny).T)


def reduced_tree(z: np.ndarray, parent: np.ndarray, least: float, sides: str) -> tuple[np.ndarray, np.ndarray]:
    """(id, parent) of what of a component tree matters beyond its sheet: the root, forks, summits of at least this prominence within the
    sheet, and cells on the given sides (letters of wnse), each with its nearest kept ancestor (0 for roots). ids column-major from 1."""
    ny, nx = z.shape
    height, up = z.T.ravel().astype(float), np.asarray(parent) - 1
    i, j = np.arange(ny * nx) % ny, np.arange(ny * nx) // ny
    edge = np.zeros(ny * nx, bool)
    for side, at in (("w", j == 0), ("n", i == 0), ("s", i == ny - 1), ("e", j == nx - 1)):
        if side in sides:
            edge |= at
    upwards = np.argsort(np.rint(height), kind="stable").tolist()
    top, held = height.copy(), edge.copy()
    for p in reversed(upwards):  # from the summits down: the highest ground, and whether an edge cell, is above
        q = up[p]
        if q != p:
            top[q] = max(top[q], top[p])
            held[q] |= held[p]
    best: dict[int, int] = {}
    for p in upwards:
        q = int(up[p])
        if q != p and top[p] > height[q] and (q not in best or top[p] > top[best[q]]):
            best[q] = p
    alive, forks = np.zeros(ny * nx, bool), np.zeros(ny * nx, int)
    for p in upwards:  # from the root up: a branch goes on if it is its fork's highest, prominent, or leads to an edge
        q = int(up[p])
        alive[p] = q == p or bool(alive[q] and (best.get(q) == p or held[p] or top[p] - height[q] >= least))
        if q != p and alive[p]:
            forks[q] += 1
    kept = alive & (edge | (forks != 1) | (up == np.arange(ny * nx)))
    near = np.full(ny * nx, -1)
    for p in upwards:
        q = int(up[p])
        if q != p:
            near[p] = q if kept[q] else near[q]
    ids = np.flatnonzero(kept)
    return ids + 1, near[ids] + 1
