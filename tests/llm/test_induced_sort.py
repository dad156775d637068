import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from txsentinel.llm.induced_sort import DiskQueue, range_minima, suffix_array


def brute(values):
    order = sorted(range(len(values)), key=lambda i: values[i:])
    lcp = [0] * len(values)
    for k in range(1, len(order)):
        a, b = order[k - 1], order[k]
        while max(a, b) + lcp[k] < len(values) and values[a + lcp[k]] == values[b + lcp[k]]:
            lcp[k] += 1
    return order, lcp


@pytest.mark.parametrize("base, memory", [(10**6, 1 << 20), (2, 64)])  # in memory; all external
@settings(max_examples=150, deadline=None)
@given(values=st.lists(st.integers(0, 4), max_size=50), repeat=st.integers(1, 3), wide=st.booleans())
def test_suffixes_and_prefixes(base, memory, values, repeat, wide):
    values = values * repeat
    text = np.array(values, np.int64) * (1000 if wide else 1)
    order, lcp = suffix_array(text if wide else text.astype(np.uint8), base=base, memory=memory)
    assert (order.tolist(), lcp.tolist()) == tuple(brute(values))


def test_cap():
    order, lcp = suffix_array(np.zeros(1000, np.uint8), cap=40)
    assert order.tolist() == list(range(999, -1, -1)) and lcp.max() == 40


def test_queue_spills_and_keeps_order():
    queue, r = DiskQueue(memory=200), np.random.default_rng(0)
    want = {}
    for k in range(300):
        symbol, values = int(r.integers(5)), r.integers(0, 99, 3)
        queue.put(symbol, values, values + 1)
        want.setdefault(symbol, []).extend(values.tolist())
        if k % 37 == 0:
            got = queue.take(symbol)
            assert got[0].tolist() == want.pop(symbol)
    for symbol, values in want.items():
        positions, lcp = queue.take(symbol)
        assert positions.tolist() == values and (lcp - positions == 1).all()
    assert queue.take(0) is None
    queue.close()


def test_range_minima():
    r = np.random.default_rng(1)
    values = r.integers(0, 1000, 500)
    low = r.integers(0, 500, 300)
    high = np.minimum(low + r.integers(0, 200, 300), 499)
    assert range_minima(values, low, high).tolist() == [values[a:b + 1].min() for a, b in zip(low, high)]
