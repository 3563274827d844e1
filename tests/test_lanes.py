"""Many longs of bits in a row: the same levels, and fewer rows written."""

import random

from fragweave.operators import graphs
from fragweave.scratch import Tables


def test_lanes(spark):
    rng = random.Random(3)
    rows = list({(rng.randrange(150), rng.randrange(120)) for _ in range(420)})
    ids = spark.range(0, 150, 1, 1).select("id")
    graph = graphs.Incidence(spark.createDataFrame(rows, "id long, segment long"))
    got, written = {}, {}
    for lanes in (1, 16):
        search = graphs.Search(graph, ids, Tables(spark, "lanes"), lanes)
        levels = [search.found, *[search.found for _ in range(2) if search.step()]]
        got[lanes] = [sorted(map(tuple, search.told(x).collect())) for x in levels]
        written[lanes] = levels[-1].count()
    assert got[1] == got[16] and len(got[1]) == 3 and got[1][-1]
    assert written[16] <= 150 < written[1]
