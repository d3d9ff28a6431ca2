from hypothesis import given, settings
from hypothesis import strategies as st

from crawlquarry.llm.tokens import SegmentTreeBPE

#: Bytes 0..3 and a few merges that overlap.
MERGES = [(0, 1, 4), (1, 0, 5), (4, 4, 6), (2, 2, 7), (7, 2, 8), (0, 4, 9), (6, 5, 10), (4, 2, 11)]


def naive(ids):
    ranks = {(a, b): (r, m) for r, (a, b, m) in enumerate(MERGES)}
    while True:
        best = min(((ranks[p][0], i) for i, p in enumerate(zip(ids, ids[1:])) if p in ranks), default=None)
        if best is None:
            return ids
        i = best[1]
        ids = ids[:i] + [ranks[ids[i], ids[i + 1]][1]] + ids[i + 2 :]


@settings(max_examples=300, deadline=None)
@given(st.lists(st.integers(0, 3), max_size=60))
def test_merges_as_the_naive_rule(ids):
    assert SegmentTreeBPE(list(range(256)), MERGES).merge(bytes(ids)) == naive(list(ids))
