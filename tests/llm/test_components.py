"""Connected components against union-find, and how many rounds they take."""

import random

import pytest

from tideway.llm import components


def brute(pairs):
    root = {}

    def find(x):
        while root.setdefault(x, x) != x:
            x = root[x]
        return x

    for a, b in pairs:
        a, b = find(a), find(b)
        root[max(a, b)] = min(a, b)
    return {(x, find(x)) for x in root if find(x) != x}


RANDOM = random.Random(3)
GRAPHS = {
    "none": ([], 0),
    "stars": ([(1, k) for k in range(2, 9)] + [(20, k) for k in (30, 31)] + [(31, 20), (5, 5)], 0),
    "two pairs that share their greater end": ([(1, 3), (2, 3)], None),
    "chain": ([(k, k + 1) for k in range(40)], None),
    "hub in the middle": ([(50, k) for k in range(100)], None),
    "random": ([(RANDOM.randrange(300), RANDOM.randrange(300)) for _ in range(260)], None),
}


@pytest.mark.parametrize("name", GRAPHS)
def test_components_and_rounds(spark, monkeypatch, name):
    """Components equal union-find's; stars, which ``link_documents`` starts from each time it adds links, take no round."""
    pairs, rounds = GRAPHS[name]
    written = []
    write = components.materialize
    monkeypatch.setattr(components, "materialize", lambda df, *a: written.append(1) or write(df, *a))
    got = components.connected_components(spark.createDataFrame(pairs, "a long, b long")).collect()
    assert len(got) == len(set(got)) and {tuple(r) for r in got} == brute(pairs)
    if rounds is not None:
        assert len(written) - 1 == rounds
