"""Sparse links in shards of some thousands: none is lost, whatever the graph finds."""

import numpy as np
import pytest

from lumigate.llm.hnsw import Graph, near


def unit(v):
    return (v / np.linalg.norm(v, axis=1, keepdims=True)).astype(np.float32)


@pytest.mark.parametrize("same", [False, True])
def test_few_links_are_not_accepted_unaudited(same):
    rnd = np.random.default_rng(11)
    v = unit(rnd.normal(size=(3000, 32)))
    q = v.copy() if same else unit(rnd.normal(size=(3000, 32)))
    # 30 copies that no evenly spaced query of 64 has
    at = np.setdiff1d(rnd.choice(3000, 60, False), np.linspace(0, 2999, 64).astype(int))[:30]
    q[at] = unit(v[(at + 7) % 3000] + rnd.normal(size=(30, 32)) * 0.02)
    graph = Graph.build(q if same else v)
    nodes, links = graph.layers[-1]
    links[:] = -1  # a graph that leads nowhere: only an audit shows that it finds nothing
    want = q @ graph.vectors.T >= 0.93
    assert want.sum() - 3000 * same >= 30
    got, true, hit = near(graph, q, 0.93, same=same)
    assert (got == want).all() and true == hit >= 30
