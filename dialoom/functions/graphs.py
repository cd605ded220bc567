"""Small numeric kernels, each for one bounded graph, run inside Spark tasks."""

from __future__ import annotations

import heapq

import numpy as np

from dialoom.params import RankParams


def pagerank(n: int, src: np.ndarray, dst: np.ndarray, w: np.ndarray, p: RankParams) -> np.ndarray:
    """Weighted undirected PageRank with uniform teleport and dangling mass."""
    rank = np.full(n, 1.0 / max(n, 1))
    tail, head, weight = np.r_[src, dst], np.r_[dst, src], np.r_[w, w]
    out = np.bincount(tail, weights=weight, minlength=n)
    dangling = out == 0
    share = weight / out[tail]
    dense = None
    if n <= 512:
        dense = np.zeros((n, n))
        np.add.at(dense, (head, tail), share)
    for _ in range(p.rounds if p.rounds is not None else p.max_rounds):
        flow = dense @ rank if dense is not None else np.bincount(
            head, weights=rank[tail] * share, minlength=n)
        new = p.damping * (flow + rank[dangling].sum() / n) + (1 - p.damping) / n
        settled = np.abs(new - rank).sum() < n * p.tolerance
        rank = new
        if settled and p.rounds is None:
            break
    return rank


def _shortest_paths(dist: np.ndarray, graph: np.ndarray, sources: np.ndarray):
    """Dijkstra from several sources of several graphs at once, on dense length matrices (inf: no edge).

    dist holds the matrices, graph says which one a source is of. Returns lengths, path counts and the
    order in which vertices were settled.
    """
    n, b = dist.shape[1], len(sources)
    rows = np.arange(b)
    length, paths = np.full((b, n), np.inf), np.zeros((b, n))
    length[rows, sources], paths[rows, sources] = 0.0, 1.0
    masked, order = length.copy(), np.full((b, n), -1)  # masked: the lengths of open vertices, else inf
    closed = np.zeros((b, n), bool)
    for step in range(n):
        near = masked.argmin(axis=1)
        live = np.isfinite(masked[rows, near])
        if not live.any():
            break
        order[live, step] = near[live]
        closed[rows[live], near[live]] = True
        masked[rows[live], near[live]] = np.inf
        reach = length[rows, near][:, None] + dist[graph, near]
        reach[~live] = np.inf
        reach[closed] = np.inf
        through = paths[rows, near][:, None]
        equal = (reach == length) & np.isfinite(reach)
        shorter = reach < length
        np.copyto(paths, paths + through, where=equal)
        np.copyto(paths, through, where=shorter)
        np.copyto(length, reach, where=shorter)
        np.copyto(masked, reach, where=shorter)
    return length, paths, order


def _carried_sparse(n: int, src: np.ndarray, dst: np.ndarray, length: np.ndarray, load: bool,
                    sources: np.ndarray) -> np.ndarray:
    """What the vertices carry for the given sources, on adjacency lists: memory follows the edges."""
    near: list[dict[int, float]] = [{} for _ in range(n)]
    for a, b, far in zip(src.tolist(), dst.tolist(), length.tolist()):
        near[a][b] = near[b][a] = far
    total = np.zeros(n)
    for source in sources.tolist():
        best, paths, before = {source: 0.0}, {source: 1.0}, {source: []}
        settled: set[int] = set()
        order, queue = [], [(0.0, source)]
        while queue:
            far, v = heapq.heappop(queue)
            if v in settled:
                continue
            settled.add(v)
            order.append(v)
            for u, step in near[v].items():
                if u in settled:
                    continue
                reach = far + step
                known = best.get(u)
                if known is None or reach < known:
                    best[u], paths[u], before[u] = reach, paths[v], [v]
                    heapq.heappush(queue, (reach, u))
                elif reach == known:
                    paths[u] += paths[v]
                    before[u].append(v)
        carried = dict.fromkeys(order, 0.0)
        for v in reversed(order[1:]):
            for u in before[v]:
                part = 1.0 / len(before[v]) if load else paths[u] / paths[v]
                carried[u] += (1.0 + carried[v]) * part
            total[v] += carried[v]
    return total


#: Up to so many vertices a graph is held as a matrix, which is faster; the results are the same.
MATRIX_NODES = 1024


def path_centrality(n: int, src: np.ndarray, dst: np.ndarray, length: np.ndarray,
                    load: bool, first: int = 0, count: int | None = None) -> np.ndarray:
    """Betweenness (share of shortest paths) or load (even split over predecessors).

    Paths from `count` sources, `first` onwards; the sum over all blocks of sources is the measure.
    """
    total = np.zeros(n)
    if n <= 2:
        return total
    last = n if count is None else min(n, first + count)
    if n > MATRIX_NODES:
        carried = _carried_sparse(n, src, dst, length, load, np.arange(first, last))
        return carried / ((n - 1) * (n - 2))
    dist = _lengths(n, src, dst, length)
    block = max(1, min(n, 4_000_000 // (n * n) + 1))
    for lo in range(first, last, block):
        sources = np.arange(lo, min(last, lo + block))
        total += _carried(dist[None], np.zeros(len(sources), np.int64), sources, load).sum(axis=0)
    return total / ((n - 1) * (n - 2))


def _lengths(n: int, src: np.ndarray, dst: np.ndarray, length: np.ndarray) -> np.ndarray:
    dist = np.full((n, n), np.inf)
    dist[src, dst], dist[dst, src] = length, length
    return dist


def _carried(dist: np.ndarray, graph: np.ndarray, sources: np.ndarray, load: bool) -> np.ndarray:
    """What the vertices carry for each of the sources, of the graphs in dist."""
    far, paths, order = _shortest_paths(dist, graph, sources)
    across = dist.transpose(0, 2, 1)
    rows = np.arange(len(sources))
    carried = np.zeros_like(far)
    for step in range(dist.shape[1] - 1, 0, -1):
        v = order[:, step]
        live = v >= 0
        if not live.any():
            continue
        before = (far + across[graph, v] == far[rows, v][:, None]) & np.isfinite(far) & live[:, None]
        amount = 1.0 + carried[rows, v]
        if load:
            share = before / np.maximum(before.sum(axis=1), 1)[:, None]
        else:
            share = before * paths / np.where(paths[rows, v] > 0, paths[rows, v], 1)[:, None]
        carried += share * amount[:, None]
    carried[rows, sources] = 0.0
    return carried


#: Sources of graphs of one size whose paths are followed at once.
TOGETHER = 512


def path_centralities(sizes: list[int], src: list[np.ndarray], dst: list[np.ndarray], length: list[np.ndarray],
                      load: bool) -> list[np.ndarray]:
    """path_centrality() of many graphs. Small ones of one size are followed together, with the same results."""
    out: list[np.ndarray] = [np.zeros(n) for n in sizes]
    alike: dict[int, list[int]] = {}
    for i, n in enumerate(sizes):
        if n > TOGETHER:
            out[i] = path_centrality(n, src[i], dst[i], length[i], load)
        elif n > 2 and len(src[i]):
            alike.setdefault(n, []).append(i)
    for n, found in alike.items():
        many = max(1, TOGETHER // n)
        for some in (found[lo:lo + many] for lo in range(0, len(found), many)):
            dist = np.stack([_lengths(n, src[i], dst[i], length[i]) for i in some])
            carried = _carried(dist, np.repeat(np.arange(len(some)), n), np.tile(np.arange(n), len(some)), load)
            for i, total in zip(some, carried.reshape(len(some), n, n).sum(axis=1)):
                out[i] = total / ((n - 1) * (n - 2))
    return out


#: So many pairs of places are held at once; their arrays stay in a core's cache.
PAIRS = 1 << 16


def word_difference(terms: list[str]) -> np.ndarray:
    """Words of one phrase missing from the other, the larger of both directions, for all pairs."""
    known: dict[str, int] = {}
    words = [[known.setdefault(w, len(known)) for w in term.split("_")] for term in terms]
    many = np.zeros((len(terms), len(known)), np.float32)
    np.add.at(many, (np.repeat(np.arange(len(words)), [len(w) for w in words]), [w for of in words for w in of]), 1)
    missing = many.sum(axis=1)[:, None] - many @ (many > 0).T
    return np.maximum(missing, missing.T).astype(np.int32)


def near_weights(rank: np.ndarray, start: np.ndarray, end: np.ndarray, terms: list[str], cutoff: int,
                 low: int = 0) -> tuple[np.ndarray, ...]:
    """(src, dst, w, many): mean log nearness of phrases over all their pairs of places, and the number of these.

    A phrase at rank r is terms[r - 1], src < dst. A place meets those that start after its end, by less
    than the cutoff, from `low` on.
    """
    listed = (rank >= 1) & (rank <= len(terms))
    order = np.argsort(start[listed], kind="stable")
    rank, start, end = (a[listed][order].astype(np.int32) for a in (rank, start, end))
    n = len(terms)
    first = np.maximum(np.searchsorted(start, end, "right"), np.searchsorted(start, low))
    count = np.maximum(np.searchsorted(start, end + cutoff, "left") - first, 0)
    differ = word_difference(terms).ravel() if count.any() else np.zeros(n * n, np.int32)
    weight = np.log(cutoff / np.arange(1, cutoff + differ.max(initial=0) + 1.0))
    total, many = np.zeros(n * n), np.zeros(n * n, np.int64)
    upto = np.cumsum(count)
    lo = 0
    while lo < len(start) and len(upto) and upto[-1] > (upto[lo - 1] if lo else 0):
        done = upto[lo - 1] if lo else 0
        hi = max(lo + 1, int(np.searchsorted(upto, done + PAIRS, "right")))
        held = count[lo:hi]
        right = np.arange(held.sum(), dtype=np.int32)
        right += np.repeat((first[lo:hi] - (upto[lo:hi] - held - done)).astype(np.int32), held)
        pair = np.repeat((rank[lo:hi] - 1) * n - 1, held) + rank[right]
        gap = start[right] - np.repeat(end[lo:hi] + 1, held)  # less by one, as weights are counted from 0
        total += np.bincount(pair, weight[gap + differ[pair]], n * n)
        many += np.bincount(pair, minlength=n * n)
        lo = hi
    total, many = total.reshape(n, n), many.reshape(n, n)
    src, dst = np.nonzero(np.triu(many + many.T, 1))
    many = (many + many.T)[src, dst]
    return src + 1, dst + 1, (total + total.T)[src, dst] / many, many
