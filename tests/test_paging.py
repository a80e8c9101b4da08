import pytest

from loregraph.operators import filters


@pytest.mark.parametrize("offset", [0, 7, 28, 55, 60, 99])
def test_deep_pages_are_like_shallow_ones(make_nodes, monkeypatch, offset):
    nodes = make_nodes([{"id": f"n{i:03}", "weight": float(i * 7 % 5)} for i in range(60)])
    shallow, total = filters.node_page(nodes, "weight", 10, offset)
    monkeypatch.setattr(filters, "DEEP", 0)
    deep, _ = filters.node_page(nodes, "weight", 10, offset)
    assert deep.collect() == shallow.collect() and total.first().total == 60


def test_a_deep_page_sorts_only_its_ranges(make_nodes):
    nodes = filters.slim(make_nodes([{"id": f"n{i}", "weight": float(i)} for i in range(200)]))
    page = filters.deep_page(nodes, "weight", 5, 150)
    assert [r.id for r in page.collect()] == [f"n{i}" for i in range(49, 44, -1)]
    plan = page._jdf.queryExecution().optimizedPlan().toString()
    assert "part" in plan and "Filter" in plan
