"""Components by one task and by star contractions are the same."""

import numpy as np
import pytest

pytest.importorskip("nounspan.llm")

from nounspan.llm.components import Forest, components  # noqa: E402


@pytest.mark.parametrize("small", [0, 10_000])
@pytest.mark.parametrize("seed", [1, 2])
def test_both_ways_equal_a_plain_search(spark, small, seed):
    rng = np.random.default_rng(seed)
    names = [f"n{i:03}".encode() for i in range(300)]
    edges = [(names[a], names[b]) for a, b in rng.integers(0, 200, (150, 2))]
    # A hub, a long chain, an edge to itself, repeated edges.
    edges += [(names[200], names[i]) for i in range(201, 250)]
    edges += [(names[i], names[i + 1]) for i in range(260, 299)]
    edges += [(names[255], names[255]), *edges[:20]]
    forest = Forest()
    for a, b in edges:
        forest.join(a, b)
    wanted = {n: forest.top(n) for a, b in edges if a != b for n in (a, b)}
    df = spark.createDataFrame([(bytearray(a), bytearray(b)) for a, b in edges], "a binary, b binary").repartition(5)
    got = components(df, small).collect()
    assert len(got) == len(wanted)
    assert {bytes(r["node"]): bytes(r["component"]) for r in got} == wanted
    assert components(df.filter("false"), small).collect() == []
