import random

from umbra.llm.components import components


def test_components_equal_brute_force(spark):
    random.seed(4)
    edges = [(i, i + 1) for i in range(0, 60)] + [(100, 200), (200, 100), (300, 300), (7, 7)] + [(random.randrange(1000, 1200), random.randrange(1000, 1200)) for _ in range(120)]
    least = {n: n for e in edges for n in e}
    changed = True
    while changed:
        changed = False
        for a, b in edges:
            m = min(least[a], least[b])
            if least[a] != m or least[b] != m:
                least[a] = least[b] = m
                changed = True
    got = {r.node: r.component for r in components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert got == {n: c for n, c in least.items() if any(least[m] == c and m != n for m in least)}
