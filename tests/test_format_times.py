"""Numbers with one decimal are rounded as C's printf rounds them (and with it DuckDB's), at halves too."""

import pytest
from lodestrata.functions import scalars as sc
from pyspark.sql import functions as F

KINDS = [(sc.format_ns, ("us", "ms", "s"), "ns"), (sc.format_count, ("k", "M", "G"), "")]


@pytest.mark.parametrize("f, units, small", KINDS)
def test_halves(spark, f, units, small):
    ns = [0, 49, 50, 999, 202450, 607650, 264950000, 10**18 + 50 * 10**6, 999950, 999949999]
    ns += [odd * 10**k // 20 for k in (3, 6, 9) for odd in (*range(21, 400, 2), *range(10001, 20000, 302))]

    def plain(n):
        for size, u in zip((10**9, 10**6, 10**3), reversed(units)):
            if n >= size:
                return f"{n / size:.1f}{u}"
        return f"{n}{small}"

    got = spark.createDataFrame([(n,) for n in ns], "n long").select("n", f(F.col("n")).alias("s")).collect()
    assert [(r["n"], r["s"]) for r in got] == [(n, plain(n)) for n in ns]
    assert spark.createDataFrame([(None,)], "n long").select(f(F.col("n"))).first()[0] is None
