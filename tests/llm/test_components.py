import random

import pytest

from gridwright.llm import components, shared
from gridwright.llm.components import connected_components
from gridwright.llm.shared import Scratch


def least_of(links):
    root = {}

    def find(x):
        while root.setdefault(x, x) != x:
            x = root[x]
        return x

    for a, b in links:
        a, b = find(a), find(b)
        root[max(a, b)] = min(a, b)
    return {x: find(x) for x in list(root)}


@pytest.mark.parametrize("limit", [1000, 3])
def test_components_equal_union_find(spark, monkeypatch, limit):
    monkeypatch.setattr(shared, "hot_limit", lambda total: limit)
    monkeypatch.setattr(components, "hot_limit", lambda total: limit)
    rng = random.Random(3)
    path = [(i, i + 1) for i in range(40)]
    stars = [(100, 100 + i) for i in range(1, 30)]
    loose = [(rng.randint(200, 300), rng.randint(200, 300)) for _ in range(60)]
    for n, links in enumerate(([], [(5, 5)], path, stars, [*stars, *loose, *path, *path, (7, 7)])):
        rows = connected_components(spark.createDataFrame(links, "_a long, _b long"), Scratch(spark), f"c{n}").collect()
        want = {a: b for a, b in least_of([x for x in links if x[0] != x[1]]).items() if a != b}
        assert {r._a: r._b for r in rows} == want and len(rows) == len(want)
