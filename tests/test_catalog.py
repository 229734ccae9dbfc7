"""Every query of the catalogue over the smallest tables, against its SQL."""

import glob
import os

import duckdb
import pytest

from lapidary.plans import reports, selections, streams  # noqa: F401
from lapidary.plans.catalog import ORACLE, QUERIES


@pytest.fixture(scope="module")
def con(data):
    c = duckdb.connect()
    for p in glob.glob(f"{data}/*.parquet"):
        c.execute(f"create view {os.path.basename(p)[:-8]} as select * from '{p}'")
    return c


def plain(rows):
    return sorted(repr(tuple(round(x, 6) if isinstance(x, float) else x for x in r)) for r in rows)


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query(spark, data, con, name):
    df = QUERIES[name](spark, data)
    columns = sorted(df.columns)
    rows = [tuple(r) for r in df.select(*columns).collect()]
    if name in ORACLE:
        o = con.execute(ORACLE[name])
        names = [c[0] for c in o.description]
        assert sorted(names) == columns
        at = [names.index(c) for c in columns]
        assert plain(rows) == plain(tuple(r[i] for i in at) for r in o.fetchall())


def test_large_latin_squares(spark, tmp_path):
    def square(n):
        return "[[" + ",".join(" ".join(str((r + c) % n + 1) for c in range(n)) for r in range(n)) + "]]"

    rows = [(str(n), square(n)) for n in (2, 6, 7, 8, 12, 20)] + [("7", square(7)), ("uneven", "[[1 2 3,2 3 1]]"), ("range", "[[1 9,2 1]]"), ("null", None)]
    spark.createDataFrame(rows, "id string, answer string").write.parquet(str(tmp_path / "puzzles.parquet"))
    got = {r.id: r for r in QUERIES["complete_latin"](spark, str(tmp_path)).collect()}
    assert set(got) == {"2", "6", "7", "8", "12", "20"}
    for n in (2, 6, 7, 8):
        g = [x.split() for x in got[str(n)].solution.split(",")]
        assert got[str(n)].solved and g[0] == [str(c) for c in range(1, n + 1)]
        assert all(sorted(x) == sorted(g[0]) for x in [*g, *map(list, zip(*g))])
    assert not got["20"].solved and got["20"].solution == ""
