"""Components that are extended by further edges."""

import random

from orograph.llm import graph, near_dedup


def search(edges):
    up = {}

    def top(x):
        while up.setdefault(x, x) != x:
            x = up[x]
        return x

    for a, b in edges:
        a, b = sorted((top(a), top(b)))
        up[b] = a
    return {x: top(x) for x in up}


def test_extended_equals_components_of_all(spark):
    r = random.Random(5)
    old = [(r.randrange(60), r.randrange(60)) for _ in range(30)]
    old = [(a, b) for a, b in old if a != b]
    new = [(r.randrange(90), r.randrange(90)) for _ in range(25)]
    new = [(a, b) for a, b in new if a != b]
    frame = lambda e: spark.createDataFrame(e, "a long, b long")
    part = graph.components(frame(old))
    assert {x.id: x.component for x in graph.extended(part, frame(new)).collect()} == search(old + new)
    assert {x.id: x.component for x in graph.extended(part, frame([])).collect()} == search(old)


def test_links_are_searched_once(spark, monkeypatch):
    """A later search is over what is new, not over the links of a large group again."""
    sizes, inner = [], graph.components

    def counted(edges, a="a", b="b"):
        sizes.append(edges.count())
        return inner(edges, a, b)

    for module in (graph, near_dedup):
        monkeypatch.setattr(module, "components", counted)
    words = [f"w{i}" for i in range(60)]
    near = [" ".join([*words[:i], "x", *words[i + 1 :]]) for i in range(0, 40)]
    got = near_dedup.classes(spark.createDataFrame(list(enumerate(near)), "doc_id long, text string")).collect()
    assert {x.class_id for x in got} == {0}
    assert sizes[0] >= 39 and sum(sizes[1:]) <= 2, sizes
