import hashlib

import pytest

from adlift.llm.common import smallest


@pytest.mark.parametrize("k", [0, 1, 10, 499, 2000])
@pytest.mark.parametrize("uneven", [False, True])
def test_smallest_equals_a_sort(spark, k, uneven):
    keys = [b"\xff" * 8 + bytes([i % 200, i // 200]) if uneven else hashlib.md5(str(i).encode()).digest() for i in range(1000)]
    df = spark.createDataFrame([(bytearray(x), i) for i, x in enumerate(keys)], "key binary, i int").repartition(7)
    got = [bytes(r.key) for r in smallest(df, "key", k).collect()]
    assert got == sorted(keys)[:k]
