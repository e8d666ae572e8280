"""What a Python worker holds."""

import tracemalloc

import numpy as np

from corpusloom.llm import common, suffix_dedup


def _block(sizes, seed=1):
    b = suffix_dedup.Block.__new__(suffix_dedup.Block)
    b.sizes = np.array(sizes, np.int64)
    b.ends = np.cumsum(b.sizes)
    b.starts = b.ends - b.sizes
    b.text = np.random.default_rng(seed).integers(97, 100, int(b.sizes.sum())).astype(np.uint8)
    return b


def test_anchors_of_a_block_are_found_in_parts(monkeypatch):
    block = _block([2000] * 1000)
    tracemalloc.start()
    suffix_dedup.anchors(block, 100)
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert peak < 60e6
    block = _block([0, 5, 99, 100, 101, 700, 0, 350, 100, 1])
    whole = suffix_dedup.anchors(block, 100)
    monkeypatch.setattr(suffix_dedup, "ANCHOR_BYTES", 64)
    assert all(np.array_equal(x, y) for x, y in zip(whole, suffix_dedup.anchors(block, 100)))


def test_lean_empties_stores():
    store = common.worker_store()
    store["x"] = bytes(10)
    common.lean()
    assert not store
