from collections import Counter

import pytest

from kvstrata.llm.packing import pack_shard


@pytest.mark.parametrize("max_sources", [None, 8, 2])
def test_copies_in_a_small_source_keep_apart(max_sources):
    """40 copies of one text, the last 10 in a source that would fill one container: 100 containers are needed, so no two share one."""
    items = [(i, 10, "small" if i >= 30 else "big", 7) for i in range(40)] + [(100 + i, 50, "big", None) for i in range(192)]
    out = pack_shard(items, 100, max_sources)
    at = Counter(b for i, _, _, b in out if items[i][3] == 7)
    assert len(out) == len(items) and max(at.values()) == 1


def test_copies_beyond_the_containers_share(spark):
    """More copies than containers: each part of the cluster still keeps its copies apart, and no container is forced."""
    items = [(i, 10, "a" if i % 2 else "b", 7) for i in range(100)]
    assert max(b for *_, b in pack_shard(items, 100, 8)) == 9
