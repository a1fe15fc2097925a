"""Region texts."""

import pytest

from locusflow.sources import text


@pytest.mark.parametrize("given, want", [
    ("c1", ("c1", 1, None)), ("c1:", ("c1", 1, None)), ("c1:5", ("c1", 5, None)), ("c1:-9", ("c1", 1, 9)), ("c1:1,000-2,500", ("c1", 1000, 2500)), ("c1:1k-1.5M", ("c1", 1000, 1_500_000)), ("c1:1e3-2e3", ("c1", 1000, 2000)),
    ("{a:b}:5-9", ("a:b", 5, 9)), (".", (None, 1, None)), ("*", ("*", 1, None)), ("c1:2g", ("c1", 2_000_000_000, None)),
])
def test_region(given, want):
    assert text.parse_region(given) == want


@pytest.mark.parametrize("given", ["c1:9-5", "c1:x", "c1:1.5-3", "", ":5"])
def test_not_a_region(given):
    with pytest.raises(ValueError):
        text.parse_region(given)


def test_lists_and_merging():
    assert text.region_list("c1:1,000-2,000,c2:5,c3") == [("c1", 1000, 2000), ("c2", 5, None), ("c3", 1, None)]
    assert text.merged_regions("c1:5-9 c1:10-12 c2 c1:1-2", 100) == [("c1", 1, 2), ("c1", 5, 12), ("c2", 1, 100)]
