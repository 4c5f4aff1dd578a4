"""A robust-pruned directed neighbour graph over the vectors of one shard, in numpy; all steps work on blocks.

Inner products are turned into distances by one more coordinate, sqrt(M^2 - |x|^2), that is 0 for queries: the nearest
by distance is then the largest by inner product, whatever the norms.
"""

from __future__ import annotations

import numpy as np

DEGREE, BUILD_BEAM, SEARCH_BEAM, RELAX, BLOCK = 32, 64, 200, 1.2, 256


def lifted(x: np.ndarray, bound: float) -> np.ndarray:
    rest = np.sqrt(np.maximum(bound**2 - np.einsum("ij,ij->i", x, x, dtype=np.float64), 0))
    return np.concatenate([x, rest[:, None].astype(np.float32)], axis=1)


def beam_search(x: np.ndarray, graph: np.ndarray, start: int, queries: np.ndarray, beam: int) -> tuple[np.ndarray, np.ndarray]:
    """Greedy search for a block of queries at once: (ids, squared distances) of the best ``beam`` found, -1 for none."""
    b, n = len(queries), len(x)
    lane = np.arange(b)
    norms = np.einsum("ij,ij->i", x, x)
    seen = np.zeros((b, n + 1), bool)
    seen[:, n] = True
    seen[:, start] = True
    ids = np.full((b, beam), n)
    far = np.full((b, beam), np.inf, np.float32)
    done = np.ones((b, beam), bool)
    ids[:, 0], done[:, 0] = start, False
    far[:, 0] = norms[start] - 2 * (queries @ x[start])
    for _ in range(4 * beam):
        open_far = np.where(done, np.inf, far)
        at = open_far.argmin(axis=1)
        going = np.flatnonzero(np.isfinite(open_far[lane, at]))
        if not len(going):
            break
        done[going, at[going]] = True
        near = graph[ids[going, at[going]]]
        near = np.where(seen[going[:, None], near], n, near)
        seen[going[:, None], near] = True
        safe = np.minimum(near, n - 1)
        d = norms[safe] - 2 * np.matmul(x[safe], queries[going][:, :, None])[:, :, 0]
        d[near == n] = np.inf
        all_far = np.concatenate([far[going], d], axis=1)
        order = np.argpartition(all_far, beam - 1, axis=1)[:, :beam]
        far[going] = np.take_along_axis(all_far, order, 1)
        ids[going] = np.take_along_axis(np.concatenate([ids[going], near], axis=1), order, 1)
        done[going] = np.take_along_axis(np.concatenate([done[going], near == n], axis=1), order, 1)
    order = far.argsort(axis=1, kind="stable")
    far = np.take_along_axis(far, order, 1)
    ids = np.where(np.isfinite(far), np.take_along_axis(ids, order, 1), -1)
    return ids, far + np.einsum("ij,ij->i", queries, queries)[:, None]


def robust_prune(x: np.ndarray, points: np.ndarray, near: np.ndarray, degree: int = DEGREE, relax: float = RELAX) -> np.ndarray:
    """Diverse neighbours for a block of points from candidates (n for none): the closest is kept, and candidates that
    are ``relax`` times closer to it than to the point are dropped; and so on, up to ``degree``."""
    n, b = len(x), len(points)
    near = np.sort(near, axis=1)
    near[:, 1:][near[:, 1:] == near[:, :-1]] = n
    near[near == points[:, None]] = n
    gone = near == n
    vectors = x[np.minimum(near, n - 1)]
    own = ((vectors - x[points][:, None, :]) ** 2).sum(-1)
    own[gone] = np.inf
    out = np.full((b, degree), n)
    lane = np.arange(b)
    for k in range(degree):
        at = own.argmin(axis=1)
        alive = np.isfinite(own[lane, at])
        if not alive.any():
            break
        out[alive, k] = near[lane, at][alive]
        own[lane, at] = np.inf
        between = ((vectors - vectors[lane, at][:, None, :]) ** 2).sum(-1)
        own[(relax**2 * between <= own) & alive[:, None]] = np.inf
    return out


def build(x: np.ndarray, seed: int = 7) -> tuple[np.ndarray, int]:
    """(neighbours, entry point): a random graph improved by searching for every point and pruning what was met."""
    n = len(x)
    rng = np.random.default_rng(seed)
    degree = min(DEGREE, max(1, n - 1))
    start = int(((x - x.mean(axis=0)) ** 2).sum(-1).argmin())
    graph = rng.integers(0, n, (n, DEGREE))
    graph[graph == np.arange(n)[:, None]] = n
    graph[:, degree:] = n
    if n <= DEGREE + 1:
        full = np.broadcast_to(np.arange(n), (n, n)).copy()
        full[np.arange(n), np.arange(n)] = n
        return np.pad(full, ((0, 0), (0, max(0, DEGREE - n))), constant_values=n), start
    for relax in (1.0, RELAX):
        order = rng.permutation(n)
        for at in range(0, n, BLOCK):
            points = order[at : at + BLOCK]
            met, _ = beam_search(x, graph, start, x[points], BUILD_BEAM)
            graph[points] = robust_prune(x, points, np.concatenate([np.where(met < 0, n, met), graph[points]], axis=1), DEGREE, relax)
            to = graph[points].ravel()
            back = np.repeat(points, DEGREE)[to < n]
            to = to[to < n]
            by = np.argsort(to, kind="stable")
            to, back = to[by], back[by]
            heads, firsts, counts = np.unique(to, return_index=True, return_counts=True)
            width = int(counts.max())
            extra = np.full((len(heads), width), n)
            extra[np.repeat(np.arange(len(heads)), counts), np.arange(len(to)) - np.repeat(firsts, counts)] = back
            for i in range(0, len(heads), 2 * BLOCK):
                h = heads[i : i + 2 * BLOCK]
                both = np.sort(np.concatenate([graph[h], extra[i : i + 2 * BLOCK]], axis=1), axis=1)
                both[:, 1:][both[:, 1:] == both[:, :-1]] = n
                over = (both < n).sum(axis=1) > DEGREE
                both.sort(axis=1)
                graph[h[~over]] = both[~over, :DEGREE]
                if over.any():
                    graph[h[over]] = robust_prune(x, h[over], both[over], DEGREE, relax)
    return graph, start
