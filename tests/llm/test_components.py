import random

from textloom.llm.components import components


def test_components_match_union_find(spark):
    random.seed(3)
    links = [(random.randrange(200), random.randrange(200)) for _ in range(120)] + [(None, 3), (5, 5), (7, None)]
    links += [(500, i) for i in range(501, 560)] + [(i, i + 1) for i in range(600, 640)]
    parent = {}

    def find(x):
        parent.setdefault(x, x)
        while parent[x] != x:
            x = parent[x]
        return x

    for a, b in links:
        if a is not None and b is not None and a != b:
            x, y = sorted((find(a), find(b)))
            parent[y] = x
    got = {r.id: r.component for r in components(spark.createDataFrame(links, "a bigint, b bigint")).collect()}
    assert got == {x: find(x) for x in parent}


def test_no_links(spark):
    assert components(spark.createDataFrame([], "a bigint, b bigint")).count() == 0
