"""Packed arrays come back as they were."""

import numpy as np
import pytest

from heliogale.llm import lm
from heliogale.llm.packed import pack, pack_ascending, unpack, unpack_ascending


@pytest.mark.parametrize("values", [[], [0], [0, 0, 0], [1], [255, 256, 0], [2**64 - 1, 0, 1], list(range(1000))])
def test_round_trip(values):
    values = np.array(values, dtype=np.uint64)
    assert unpack(pack(values)).tolist() == values.tolist()
    keys = np.sort(values)
    assert unpack_ascending(pack_ascending(keys)).tolist() == keys.tolist()


def test_narrow():
    keys = np.sort(np.random.default_rng(1).integers(0, 2**64, 100_000, dtype=np.uint64))
    assert len(pack_ascending(keys)) < 6.25 * len(keys)
    assert len(pack(np.ones(1000, dtype=np.uint64))) < 50


@pytest.mark.parametrize("buckets", [1, 2, 7, 1000])
def test_buckets_are_ranges_of_keys(buckets):
    keys = np.sort(np.random.default_rng(2).integers(0, 2**64, 5000, dtype=np.uint64))
    keys[0] = 0
    bound = lm._bounds(keys, buckets)
    want = [int(k) * buckets >> 64 for k in keys]
    assert np.repeat(np.arange(buckets), np.diff(bound)).tolist() == want
