"""Prefixes of more terms than the dialect allows."""

import pytest

from quillon.retrieval import postings, search


def test_a_whole_prefix_takes_every_term(spark):
    n = search.MAX_PREFIX + 50
    rows = spark.createDataFrame([(i, f"pre{i:03d} other") for i in range(n)] + [(-1, "prx"), (-2, None), (-3, "first pre001 pre001 pre002")], "id int, body string")
    index = postings.Postings.build(rows, ("body",), ("id",))
    with pytest.raises(ValueError, match="too many"):
        index.matched("pre*")
    assert {r.id for r in index.matched("pre*", whole=True).collect()} == {*range(n), -3}
    assert {r.id for r in index.matched('"first pre*"', whole=True).collect()} == {-3}
    assert index.matched("nope*", whole=True).count() == 0
    capped, whole = (sorted((r.id, round(r._score, 9)) for r in index.matched("other pre00*", whole=w).collect()) for w in (False, True))
    assert len(capped) == 10 and capped == whole
