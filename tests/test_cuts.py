import numpy as np
import pytest

from linkloom.operators import cuts, graph


def made(n, more, seed):
    """A connected graph of n vertices with `more` edges beyond a tree."""
    rng = np.random.default_rng(seed)
    edges = {(int(rng.integers(0, k)), k) for k in range(1, n)}
    while len(edges) < n - 1 + more:
        i, j = sorted(rng.integers(0, n, 2).tolist())
        edges |= {(i, j)} if i < j else set()
    return sorted(edges)


def cycle(n, *more):
    return [*((k, k + 1) for k in range(n - 1)), (0, n - 1), *more]


GRAPHS = [[(0, 1)], [(k, k + 1) for k in range(30)], [(0, k) for k in range(1, 30)], *(cycle(n) for n in range(3, 9)), cycle(6, (0, 6), (6, 7), (2, 8)), cycle(7, (0, 7), (7, 8), (3, 9))]
GRAPHS += [[(i, j) for i in range(9) for j in range(i + 1, 9)], *(made(25, more, more) for more in range(9)), made(80, 200, 0)]


@pytest.mark.parametrize("dense", [1, cuts.DENSE])
def test_connectivity_by_elimination_is_that_of_the_matrix(monkeypatch, dense):
    monkeypatch.setattr(cuts, "DENSE", dense)
    for edges in GRAPHS:
        u, v = np.array(edges).T
        n = int(v.max()) + 1
        assert cuts.algebraic_connectivity(u, v, n) == pytest.approx(graph.algebraic_connectivity(edges, n), abs=1e-12)


@pytest.mark.parametrize("most_edges", [0, 100])
def test_loads_of_blocks_are_those_of_all_paths(most_edges):
    for edges in GRAPHS:
        u, v = np.array(edges).T
        n = int(v.max()) + 1
        loads, left = cuts.edge_loads(u, v, n, most_edges, 4)
        at = {e: k for k, e in enumerate(edges)}
        for x, y, weights, vertices in left:
            parts = sum(cuts.followed_loads(x, y, weights, np.arange(p, len(weights), 3), 4) for p in range(3))
            for i, j, load in zip(vertices[x].tolist(), vertices[y].tolist(), parts):
                loads[at[min(i, j), max(i, j)]] = load
        exact = graph.edge_betweenness(edges, n)
        assert loads / (n * (n - 1) / 2) == pytest.approx([exact[e] for e in edges])


def test_long_chains_take_no_rounds():
    n = 50_000
    u, v = np.arange(n - 1), np.arange(1, n)
    assert cuts.algebraic_connectivity(u, v, n) == pytest.approx(2 * np.sin(np.pi / (n - 1) / 2) ** 2, rel=1e-9)
    loads, left = cuts.edge_loads(u, v, n, 0, 4)
    assert not left and loads.argmax() == n // 2 - 1 and loads.max() == (n // 2) ** 2


def test_large_components_are_exact(spark):
    parts = {"c": [(k, k + 1) for k in range(23)], "r": made(25, 8, 1), "s": [(0, k) for k in range(1, 14)], "y": cycle(15, (3, 15)), "z": cycle(4)}
    rows = [(f"{name}{i:02}", f"{name}{j:02}") for name, edges in parts.items() for i, j in edges]
    found = graph.bottlenecks(spark.createDataFrame(rows, "a string, b string"), "a", "b", exact_edges=10, sources=3).collect()
    expected = []
    for name, edges in parts.items():
        n = max(j for _, j in edges) + 1
        (i, j), most = min(graph.edge_betweenness(edges, n).items(), key=lambda e: (-round(e[1], 12), e[0]))
        expected.append((round(graph.algebraic_connectivity(edges, n), 12), f"{name}00", f"{name}{i:02}", f"{name}{j:02}", most))
    expected.sort()
    assert [(r["set_id"], r["term1"], r["term2"]) for r in found] == [e[1:4] for e in expected]
    assert [r["connectivity"] for r in found] == pytest.approx([e[0] for e in expected], abs=1e-11)
    assert [r["betweenness"] for r in found] == pytest.approx([e[4] for e in expected])
