"""Components against union-find, and how many written tables they take."""

import random

import numpy as np
import pytest

from locusflow.llm import components
from locusflow.llm.common import forget, noted


def plain(links):
    root = {x: x for link in links for x in link}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a, b in links:
        x, y = sorted((find(a), find(b)))
        root[y] = x
    return {(x, find(x)) for x in root if find(x) != x}


def cases():
    r = random.Random(3)
    chain = list(range(-30, 30))
    r.shuffle(chain)
    yield list(zip(chain, chain[1:])) + [(5, 5), (900, 900)]
    yield [(99, k) for k in range(40)] + [(-(1 << 63), 7)]
    yield [(r.randrange(300), r.randrange(300)) for _ in range(200)] * 2


@pytest.mark.parametrize("edges", [1 << 20, 3])
def test_components(spark, edges, monkeypatch):
    """Joined in one task, or in cuts of three edges and then in rounds."""
    monkeypatch.setattr(components, "EDGES", edges)
    for links in cases():
        assert set(zip(*(x.tolist() for x in components._stars(*np.array(links).T)))) == plain(links)
        out = components.components(spark.createDataFrame(links, "a bigint, b bigint").repartition(3))
        assert {tuple(x) for x in out.collect()} == plain(links)
        forget(out)
    assert components.components(spark.createDataFrame([], "a bigint, b bigint")).count() == 0


def test_few_tables_for_small_links(spark):
    """Links that one task holds are joined there: each round more is a plan and jobs that the driver's memory keeps."""
    chain = list(range(64))
    random.Random(1).shuffle(chain)
    with noted() as tables:
        out = components.components(spark.createDataFrame(list(zip(chain, chain[1:])), "a bigint, b bigint"))
    assert out.count() == 63 and len(tables) == 1
