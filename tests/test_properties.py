"""Random inputs: what holds for all of them."""

from hypothesis import given, settings
from hypothesis import strategies as st

from loomspark.operators.packing import best_fit
from loomspark.sources.catalog import Source

name = st.text("abcxyz/-_.", min_size=1, max_size=12).filter(lambda s: s.strip() == s)


@given(name, st.lists(st.text("abc123", min_size=1, max_size=5), max_size=3), st.none() | st.integers(0, 10**6), st.sampled_from([None, "hf", "ms"]))
def test_source_strings_round_trip(n, subsets, count, hub):
    s = Source(n, tuple(subsets), count, hub)
    assert Source.parse(str(s)) == s


@settings(max_examples=200)
@given(st.lists(st.integers(1, 40), max_size=60), st.integers(10, 50))
def test_bins(lengths, volume):
    items = list(enumerate(lengths))
    bins = best_fit(items, volume)
    assert sorted(x for b in bins for x in b) == items
    assert all(sum(n for _, n in b) <= volume or len(b) == 1 for b in bins)
    # no two bins would fit into one
    totals = sorted(sum(n for _, n in b) for b in bins)
    assert len(totals) < 2 or totals[0] + totals[1] > volume
