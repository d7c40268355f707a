"""Connectivity and edge betweenness of one large connected graph, exact, in numpy; vertices are 0 .. n - 1, edges two arrays."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np

#: Vertices up to which what remains of a graph is inverted as a matrix.
DENSE = 1_200
#: Vectors held while an eigenvalue is sought, and those kept when they are too many.
HELD, KEPT = 20, 6
#: Pairs of a source and an edge that are followed at once.
AT_ONCE = 300_000


def _kernel_solver(a: np.ndarray, b: np.ndarray, w: np.ndarray, n: int) -> Callable[[np.ndarray], np.ndarray]:
    """Solutions of the Laplacian of a connected weighted graph, for right sides that sum to 0."""
    degree = np.bincount(a, w, n) + np.bincount(b, w, n)
    if n <= DENSE:
        matrix = np.diag(degree + 0.0)
        np.subtract.at(matrix, (a, b), w)
        np.subtract.at(matrix, (b, a), w)
        inverse = np.linalg.inv(matrix + degree.mean() / n)
        return lambda right: inverse @ (right - right.mean())

    def conjugate_gradients(right: np.ndarray) -> np.ndarray:
        x, r = np.zeros(n), right - right.mean()
        z = r / degree
        p, met, most = z, r @ z, 1e-13 * np.sqrt(r @ r)
        for _ in range(20 * n):
            if np.sqrt(r @ r) <= most:
                break
            q = degree * p - np.bincount(a, w * p[b], n) - np.bincount(b, w * p[a], n)
            step = met / (p @ q)
            x, r = x + step * p, r - step * q
            z = r / degree
            met, before = r @ z, met
            p = z + met / before * p
        return x

    return conjugate_gradients


def laplacian_solver(u: np.ndarray, v: np.ndarray, n: int) -> Callable[[np.ndarray], np.ndarray]:
    """Solutions of the Laplacian of a connected graph, for right sides that sum to 0.

    Vertices of up to three neighbours are eliminated, independent ones at once, which adds no edges: nothing remains
    of trees, chains and cycles, so that their length makes no rounds. What remains is inverted or solved by iteration.
    """
    a, b, w, steps, chance = u, v, np.ones(len(u)), [], np.random.default_rng(0)
    while len(a):
        degree = np.bincount(a, minlength=n) + np.bincount(b, minlength=n)
        low = (degree > 0) & (degree <= 3)
        if not low.any():
            break
        rank = np.where(low, chance.random(n), 2.0)
        low[np.where(rank[a] < rank[b], b, a)] = False
        at_a, at_b = low[a], low[b]
        mine, other, weight = np.r_[a[at_a], b[at_b]], np.r_[b[at_a], a[at_b]], np.r_[w[at_a], w[at_b]]
        order = np.argsort(mine, kind="stable")
        mine, other, weight = mine[order], other[order], weight[order]
        first = np.flatnonzero(np.r_[True, mine[1:] != mine[:-1]])
        count, total = np.diff(np.r_[first, len(mine)]), np.bincount(mine, weight, n)
        steps.append((mine, other, weight / total[mine], mine[first], total[mine[first]]))
        rest = ~(at_a | at_b)
        ends, weights = [(a[rest], b[rest])], [w[rest]]
        for p, q in ((0, 1), (0, 2), (1, 2)):
            x, y = first[count > q] + p, first[count > q] + q
            ends.append((other[x], other[y]))
            weights.append(weight[x] * weight[y] / total[mine[x]])
        one, two = (np.concatenate(side) for side in zip(*ends))
        key, at = np.unique(np.minimum(one, two) * n + np.maximum(one, two), return_inverse=True)
        a, b, w = key // n, key % n, np.bincount(at, np.concatenate(weights), len(key))
    left = np.unique(np.r_[a, b])
    kernel = _kernel_solver(np.searchsorted(left, a), np.searchsorted(left, b), w, len(left)) if len(left) else None

    def solve(right: np.ndarray) -> np.ndarray:
        right, found = right.copy(), np.zeros(n)
        for mine, other, share, _, _ in steps:
            np.add.at(right, other, share * right[mine])
        if kernel:
            found[left] = kernel(right[left])
        for mine, other, share, gone, total in reversed(steps):
            found[gone] = right[gone] / total
            np.add.at(found, mine, share * found[other])
        return found

    return solve


def algebraic_connectivity(u: np.ndarray, v: np.ndarray, n: int) -> float:
    """The second smallest eigenvalue of the normalised Laplacian of a connected graph, as one over the greatest of its inverse."""
    root = np.sqrt(np.bincount(u, minlength=n) + np.bincount(v, minlength=n))
    null, solve = root / np.sqrt(root @ root), laplacian_solver(u, v, n)
    held, images = np.zeros((HELD, n)), np.zeros((HELD, n))
    new, k, before = np.random.default_rng(1).random(n) - 0.5, 0, 0.0
    while True:
        for _ in range(2):
            new = new - (null @ new) * null
            new = new - held[:k].T @ (held[:k] @ new)
        held[k] = new / np.sqrt(new @ new)
        image = root * solve(root * held[k])
        images[k] = image - (null @ image) * null
        k += 1
        met = held[:k] @ images[:k].T
        values, turned = np.linalg.eigh((met + met.T) / 2)
        new = turned[:, -1] @ images[:k] - values[-1] * (turned[:, -1] @ held[:k])
        if k >= n - 1 or np.sqrt(new @ new) <= 1e-12 * values[-1]:
            return float(1 / values[-1])
        if k == HELD:
            if values[-1] <= before * (1 + 1e-14):  # no nearer for a whole turn: the solutions are no more exact than that
                return float(1 / values[-1])
            before = values[-1]
            held[:KEPT], images[:KEPT], k = turned[:, -KEPT:].T @ held, turned[:, -KEPT:].T @ images, KEPT


def _neighbours(u: np.ndarray, v: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Where the neighbours of each vertex begin, the neighbours, and the numbers of the edges to them."""
    ends = np.r_[u, v]
    order = np.argsort(ends, kind="stable")
    return np.r_[0, np.cumsum(np.bincount(ends, minlength=n))], np.r_[v, u][order], order % len(u)


def blocks(u: np.ndarray, v: np.ndarray, n: int) -> Iterator[tuple[list[int], list[int], list[int]]]:
    """(edges, vertices, weights) of the biconnected blocks of a connected graph.

    The weight of a vertex counts the vertices from which the block is entered there. Of a block that is one cycle the
    vertices come in its order, and edge k leads from vertex k to the next.
    """
    begin, to, number = (x.tolist() for x in _neighbours(u, v, n))
    seen, low, up, below, hung = [0] * n, [0] * n, [-1] * n, [1] * n, [1] * n
    at, path, edges, vertices, clock = begin[:n], [0], [], [], 1
    seen[0] = low[0] = 1
    while path:
        x = path[-1]
        if at[x] < begin[x + 1]:
            y, e = to[at[x]], number[at[x]]
            at[x] += 1
            if not seen[y]:
                clock += 1
                seen[y] = low[y] = clock
                up[y] = e
                edges.append(e)
                vertices.append(y)
                path.append(y)
            elif e != up[x] and seen[y] < seen[x]:
                edges.append(e)
                low[x] = min(low[x], seen[y])
            continue
        path.pop()
        if not path:
            return
        p = path[-1]
        below[p] += below[x]
        low[p] = min(low[p], low[x])
        if low[x] >= seen[p]:
            of_edges, of_vertices = [edges.pop()], [vertices.pop()]
            while of_edges[-1] != up[x]:
                of_edges.append(edges.pop())
            while of_vertices[-1] != x:
                of_vertices.append(vertices.pop())
            of_vertices.append(p)
            yield of_edges[::-1], of_vertices[::-1], [n - below[x], *(hung[z] for z in of_vertices[-2::-1])]
            hung[p] += below[x]


def cycle_loads(weights: np.ndarray) -> np.ndarray:
    """Shortest paths through each edge of a cycle, edge k leading from vertex k to the next, between vertices counted by weight."""
    size = len(weights)
    half = (size - 1) // 2
    sums = np.r_[0.0, np.cumsum(np.tile(weights.astype(float), 3))]
    k = np.arange(size, 2 * size)
    changes = weights * (sums[k + half + 1] - sums[k + 1] - sums[k] + sums[k - half])
    starts = np.arange(size - half + 1, size + 1)
    begun = weights[starts % size] @ (sums[starts + half + 1] - sums[size + 1]) if half else 0.0
    across = weights[: size // 2] @ weights[size // 2 :] / 2 if size % 2 == 0 else 0.0
    return begun + np.cumsum(changes) - changes[0] + across


def followed_loads(u: np.ndarray, v: np.ndarray, weights: np.ndarray, sources: np.ndarray, at_once: int) -> np.ndarray:
    """Half of the shortest paths from the sources through each edge, between vertices counted by weight; at_once sources are followed together."""
    n, m = len(weights), len(u)
    begin, to, number = _neighbours(u, v, n)
    loads, at_once = np.zeros(m), max(1, min(at_once, AT_ONCE // m))
    for first in range(0, len(sources), at_once):
        some = sources[first : first + at_once]
        reached = np.arange(len(some)) * n + some
        far, paths, mark = np.zeros(len(some) * n, bool), np.zeros(len(some) * n), np.zeros(len(some) * n, np.int64)
        far[reached], paths[reached], steps = True, 1.0, []
        while len(reached):
            x = reached % n
            many = begin[x + 1] - begin[x]
            at = np.repeat(begin[x] - np.cumsum(many) + many, many) + np.arange(many.sum())
            origin, target = np.repeat(reached, many), np.repeat(reached - x, many) + to[at]
            new = ~far[target]
            origin, target, at = origin[new], target[new], at[new]
            np.add.at(paths, target, paths[origin])
            far[target] = True
            steps.append((origin, target, number[at]))
            mark[target] = np.arange(len(target))
            reached = target[mark[target] == np.arange(len(target))]
        if not np.isfinite(paths).all():
            raise OverflowError("more shortest paths between two vertices than a double can count")
        share = np.tile(weights.astype(float), len(some))
        for origin, target, edge in reversed(steps):
            part = paths[origin] / paths[target] * share[target]
            np.add.at(share, origin, part)
            loads += np.bincount(edge, part * weights[some[origin // n]], m)
    return loads / 2


def edge_loads(u: np.ndarray, v: np.ndarray, n: int, most_edges: int, at_once: int) -> tuple[np.ndarray, list[tuple[np.ndarray, ...]]]:
    """Shortest paths through each edge, block by block; and (u, v, weights, vertices) of the blocks left, NaN at their edges.

    Bridges and cycles have a closed form, other blocks are followed from all their vertices, and those of more than
    most_edges edges left for followed_loads(), with vertices numbered as in their weights.
    """
    loads, left, at = np.full(len(u), np.nan), [], np.zeros(n, np.int64)
    for edges, vertices, weights in blocks(u, v, n):
        if len(edges) == 1:
            loads[edges[0]] = weights[0] * weights[1]
        elif len(edges) == len(vertices):
            loads[edges] = cycle_loads(np.array(weights))
        else:
            at[vertices] = np.arange(len(vertices))
            block = at[u[edges]], at[v[edges]], np.array(weights)
            if len(edges) > most_edges:
                left.append((*block, np.array(vertices)))
            else:
                loads[edges] = followed_loads(*block, np.arange(len(vertices)), at_once)
    return loads, left
