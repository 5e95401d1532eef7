"""A hierarchical navigable small-world graph over the vectors of one shard, in numpy, searched in batches.

The vectors have unit length. Levels fall off geometrically from a seeded draw; each layer above the lowest
holds the nodes of its level and up. Layers are built from the top; nodes enter a layer in batches that
double, each linked to diverse near ones among what is there and its own batch.
"""

from __future__ import annotations

import numpy as np

M = 16
BUILD_BEAM = 48
#: Nodes linked, and queries searched, together.
BATCH = 512
#: A beam opens nodes one by one, each for about so many comparisons' time of a matrix product: a widened beam of a shard's size over this is all of it.
WHOLE = 128


class Graph:
    def __init__(self, vectors: np.ndarray, layers: list[tuple[np.ndarray, np.ndarray]]):
        #: layers, top first: (its nodes, for each of them the places in the layer of its neighbours, -1 for none).
        self.vectors, self.layers = vectors, layers

    @staticmethod
    def build(vectors: np.ndarray, seed: int = 1) -> Graph:
        n = len(vectors)
        level = np.minimum((-np.log(np.random.default_rng(seed).random(n)) / np.log(M)).astype(int), 8)
        level[0] = max(level.max(), 0) if n else 0
        graph = Graph(vectors, [])
        for top in range(int(level[0]) if n else -1, -1, -1):
            nodes = np.flatnonzero(level >= top)
            graph.layers.append((nodes, np.full((len(nodes), 2 * M), -1, np.int32)))
            graph._fill()
        return graph

    def _fill(self) -> None:
        """Link the nodes of the lowest layer so far, a batch at a time, to diverse ones of what is there and of their own batch.

        A shard is small enough that a batch's candidates are the exact nearest of one matrix product.
        """
        nodes, links = self.layers[-1]
        v, done = self.vectors[nodes], 0
        while done < len(nodes):
            size = min(max(done, 64), BATCH, len(nodes) - done)
            new = np.arange(done, done + size)
            near = v[new] @ v[: done + size].T
            near[np.arange(size), new] = -3
            ids, sims = nearest(near, BUILD_BEAM)
            chosen = diverse(v, ids, sims, M)
            links[new, :M] = chosen
            # the other direction: each node that got new neighbours keeps diverse ones of its old and new ones
            x, y = np.repeat(new, M), chosen.ravel()
            x, y = x[y >= 0], y[y >= 0]
            order = np.argsort(y, kind="stable")
            x, y = x[order], y[order]
            ends, first, count = np.unique(y, return_index=True, return_counts=True)
            wide = np.full((len(ends), int(count.max()) if len(ends) else 0), -1, np.int64)
            wide[np.repeat(np.arange(len(ends)), count), np.arange(len(y)) - np.repeat(first, count)] = x
            for i in range(0, len(ends), BATCH):
                rows = ends[i : i + BATCH]
                cand = np.concatenate([links[rows].astype(np.int64), wide[i : i + BATCH, : int(count[i : i + BATCH].max())]], 1)
                s = np.matmul(v[cand], v[rows][:, :, None])[:, :, 0]
                s[cand < 0] = -3
                s[:, 2 * M :][(cand[:, 2 * M :, None] == cand[:, None, : 2 * M]).any(2)] = -3
                top, s = nearest(s, 3 * M)
                links[rows] = diverse(v, np.take_along_axis(cand, np.maximum(top, 0), 1), s, 2 * M)
            done += size

    def enter(self, queries: np.ndarray, below: int) -> np.ndarray:
        """The place in layer `below` of the nearest node found by going down the layers above it."""
        entry = np.zeros((len(queries), 1), np.int64)
        for k in range(below):
            nodes, links = self.layers[k]
            best, _ = beam_search(self.vectors[nodes], links, queries, entry, min(4, len(nodes)))
            entry = np.searchsorted(self.layers[k + 1][0], nodes[best[:, :1]])
        return entry

    def search(self, queries: np.ndarray, beam: int) -> tuple[np.ndarray, np.ndarray]:
        """Nodes and similarities of a beam for each query, nearest first; -1 where it has fewer."""
        nodes, links = self.layers[-1]
        out = [beam_search(self.vectors, links, q, self.enter(q, len(self.layers) - 1), min(beam, len(nodes))) for q in (queries[i : i + BATCH] for i in range(0, len(queries), BATCH))]
        return np.concatenate([o[0] for o in out]), np.concatenate([o[1] for o in out])

    def dump(self) -> dict[str, bytes]:
        return {"sizes": np.array([len(n) for n, _ in self.layers], np.int32).tobytes(), "nodes": b"".join(n.astype(np.int32).tobytes() for n, _ in self.layers), "links": b"".join(k.tobytes() for _, k in self.layers)}

    @staticmethod
    def load(vectors: np.ndarray, sizes: bytes, nodes: bytes, links: bytes) -> Graph:
        sizes = np.frombuffer(sizes, np.int32)
        cuts = np.cumsum(sizes)[:-1]
        return Graph(vectors, list(zip(np.split(np.frombuffer(nodes, np.int32), cuts), np.split(np.frombuffer(links, np.int32).reshape(-1, 2 * M), cuts), strict=True)))


def nearest(sims: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """Places and values of each row's k largest, largest first; -1 and -3 where it has fewer."""
    k = min(k, sims.shape[1])
    ids = np.argpartition(-sims, k - 1, axis=1)[:, :k] if k < sims.shape[1] else np.broadcast_to(np.arange(k), sims.shape)
    best = np.take_along_axis(sims, ids, 1)
    order = np.argsort(-best, axis=1, kind="stable")
    ids, best = np.take_along_axis(ids, order, 1), np.take_along_axis(best, order, 1)
    return np.where(best > -2, ids, -1), best


def diverse(v: np.ndarray, ids: np.ndarray, sims: np.ndarray, most: int) -> np.ndarray:
    """For each row of candidates, nearest first, `most` of them (-1 for none): those nearer to the row's node than to any
    chosen before; then the nearest of the rest."""
    near = v[np.maximum(ids, 0)]
    among = np.matmul(near, near.transpose(0, 2, 1))
    there = sims > -2
    rows, k = ids.shape
    blocked = np.full((rows, k), -3.0, np.float32)
    rank = np.full((rows, k), 2 * k, np.int32)
    taken = np.zeros(rows, np.int32)
    for i in range(k):
        go = there[:, i] & (blocked[:, i] <= sims[:, i]) & (taken < most)
        rank[go, i] = i
        taken += go
        blocked[go] = np.maximum(blocked[go], among[go, i])
    rest = there & (rank == 2 * k)
    rank[rest] = (np.arange(k) + k)[np.nonzero(rest)[1]]
    order = np.argsort(rank, axis=1, kind="stable")[:, :most]
    out = np.where(np.take_along_axis(rank, order, 1) < 2 * k, np.take_along_axis(ids, order, 1), -1)
    return np.pad(out, ((0, 0), (0, most - out.shape[1])), constant_values=-1)


def beam_search(v: np.ndarray, links: np.ndarray, queries: np.ndarray, entry: np.ndarray, beam: int) -> tuple[np.ndarray, np.ndarray]:
    """Best-first search of all queries in step: each round opens every query's nearest node not opened yet."""
    b, rows = len(queries), np.arange(len(queries))
    seen = np.zeros((b, len(v) + 1), bool)  # the last column takes what isn't there
    seen[:, -1] = True
    ids = np.full((b, beam), -1, np.int64)
    sims = np.full((b, beam), -2.0, np.float32)
    opened = np.ones((b, beam), bool)
    ids[:, 0], sims[:, 0], opened[:, 0] = entry[:, 0], (v[entry[:, 0]] * queries).sum(1), False
    seen[rows, entry[:, 0]] = True
    live = rows
    while len(live):
        open_sims = np.where(opened[live], -3.0, sims[live])
        at = open_sims.argmax(1)
        go = open_sims[np.arange(len(live)), at] > -3
        live, at = live[go], at[go]
        if not len(live):
            break
        opened[live, at] = True
        next_ = links[ids[live, at]].astype(np.int64)
        fresh = ~seen[live[:, None], next_]
        seen[live[:, None], next_] = True
        s = np.where(fresh, np.einsum("bkd,bd->bk", v[next_], queries[live]), -2.0).astype(np.float32)
        all_s = np.concatenate([sims[live], s], 1)
        order = np.argsort(-all_s, axis=1, kind="stable")[:, :beam]
        sims[live] = np.take_along_axis(all_s, order, 1)
        ids[live] = np.take_along_axis(np.concatenate([ids[live], np.where(fresh, next_, -1)], 1), order, 1)
        opened[live] = np.take_along_axis(np.concatenate([opened[live], ~fresh], 1), order, 1)
    return ids, sims


def near(graph: Graph, queries: np.ndarray, least: float, beam: int = 16, recall: float = 0.99, audit: int = 64, same: bool = False, links: int = 256, whole: int = WHOLE) -> tuple[np.ndarray, int, int]:
    """A table of queries by nodes, True where a node of similarity `least` or more was found; the audit's true links, and those found.

    An audit compares evenly spaced queries with all nodes, more and more of them until they have `links` true links; a
    query's link with itself (`same`: the queries are the nodes) doesn't count. Where links are so few that all queries
    are compared, that is the exact table and no beam is needed. A query whose whole beam is that near gets
    a wider one; while the audited recall is under `recall`, all beams widen. The widest beam is the whole shard.
    """
    n = len(graph.vectors)
    found = np.zeros((len(queries), n), bool)
    order = np.concatenate([np.arange(len(queries))[k :: max(1, len(queries) // audit)] for k in range(max(1, len(queries) // audit))])
    done, seen = 0, 0
    while done < len(order) and (seen < links or done < audit):
        some = order[done : done + max(audit, min(done, BATCH))]
        found[some] = queries[some] @ graph.vectors.T >= least
        seen += int(found[some].sum()) - (int(found[some, some].sum()) if same else 0)
        done += len(some)
    sample = order[:done]
    truth = found[sample].copy()
    if same:
        truth[np.arange(done), sample] = False
    todo = np.setdiff1d(np.arange(len(queries)), sample)
    hit = np.zeros((done, n), bool)
    audited = np.arange(done)
    true, first = int(truth.sum()), beam
    while len(todo):
        if beam >= n or beam > first and whole * beam >= n:
            for i in range(0, len(todo), BATCH):
                found[todo[i : i + BATCH]] = queries[todo[i : i + BATCH]] @ graph.vectors.T >= least
            hit[audited] |= truth[audited]
            break
        ids, sims = graph.search(queries[np.concatenate([todo, sample[audited]])], beam)
        row, col = np.nonzero(sims[: len(todo)] >= least)
        found[todo[row], ids[row, col]] = True
        row, col = np.nonzero(sims[len(todo) :] >= least)
        hit[audited[row], ids[len(todo) + row, col]] = True
        passed = (hit & truth).sum() >= recall * true
        full = sims[:, -1] >= least
        if passed:
            todo, audited = todo[full[: len(todo)]], audited[full[len(todo) :]]
        beam *= 4
    return found, true, true if done == len(order) else int((hit & truth).sum())
