"""Content-defined chunks against the definition, byte by byte."""

import random

import pytest

from lodestrata.operators import cdc


def by_definition(data, least, average, largest):
    small, large = cdc.masks(least, average, largest)
    t = [int(x) for x in cdc.table()]
    ends, start = [], 0
    while start < len(data):
        n = min(len(data) - start, largest)
        cut, h = n, 0
        for i in range(least, n):
            h = ((h << 1) + t[data[start + i]]) & cdc.WORD
            if h & (small if i < average else large) == 0:
                page = (i + 1) // 4096 * 4096
                cut = page if page >= least else i + 1
                break
        start += cut
        ends.append(start)
    return ends


@pytest.mark.parametrize("sizes", [(4096, 8192, 16384), (4096, 4096, 8192), (8192, 8192, 8192), (4096, 16384, 65536)])
def test_cuts(sizes, monkeypatch):
    monkeypatch.setattr(cdc, "BLOCK", 10_000)
    rng = random.Random(3)
    for n in (0, 1, 4095, 4096, 4097, 4159, 4160, 20_000, 150_000):
        for data in (rng.randbytes(n), bytes(n), (b"the same line again and again\n" * (n // 30 + 1))[:n]):
            assert cdc.cuts(data, *sizes) == by_definition(data, *sizes)


def test_masks():
    assert [bin(cdc.mask(n)).count("1") for n in (0, 1, 22, 64, 70)] == [0, 1, 22, 64, 64]
    assert cdc.levels(128 << 10, 512 << 10, 1 << 20) == (3, 3)
    assert cdc.levels(128 << 10, 512 << 10, 768 << 10) == (3, 4)
    assert cdc.levels(128 << 10, 512 << 10, 4 << 20) == (3, 1)
    assert cdc.levels(64 << 10, 512 << 10, 600 << 10) == (3, 6)
    with pytest.raises(ValueError):
        cdc.check_sizes(4096, 5000, 8192)


def test_quality_on_random_bytes():
    sizes = (8 << 10, 32 << 10, 64 << 10)
    data = random.Random(5).randbytes(8 << 20)
    ends = cdc.cuts(data, *sizes)
    got = [b - a for a, b in zip([0, *ends], ends)]
    assert 0.8 <= sum(got) / len(got) / sizes[1] <= 1.2
    assert sum(x == sizes[2] for x in got) / len(got) <= 0.05


def test_content_defined(spark):
    rng = random.Random(7)
    data = rng.randbytes(90_000)
    shifted = rng.randbytes(5000) + data
    rows = [(1, 0, 0, data), (1, 1, 200_000, bytes(9000)), (2, 0, 0, shifted), (3, 0, 0, b""), (4, 0, 0, None)]
    sizes = (4096, 8192, 16384)
    c = cdc.content_defined(spark.createDataFrame(rows, "image long, segment int, start long, data binary"), sizes)
    got = c.orderBy("image", "segment", "ordinal").collect()
    assert b"".join(bytes(r.data) for r in got if r.image == 1 and r.segment == 0) == data
    zero = [r for r in got if r.segment == 1]
    assert zero[0].start == 200_000 and sum(r.size for r in zero) == 9000 and all(r.is_zero for r in zero)
    assert {r.image for r in got} == {1, 2}
    for r in cdc.quality(c, "image", sizes).collect():
        assert r.chunks == sum(x.image == r.image for x in got) and r.p25 <= r.p50 <= r.p75 <= r.p95
    k = cdc.kept_percent(c.withColumn("g", c.image * 0), c.where("image = 1").withColumn("g", c.image * 0), "g").first()
    assert k.kept == len({r.key for r in got if r.image == 1 and not r.is_zero}) and k.kept <= k.keys
