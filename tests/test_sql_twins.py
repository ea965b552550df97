"""Rows on which a query and its SQL would part."""

import datetime
from decimal import ROUND_HALF_UP, Decimal

import duckdb

import __spark_entry__

COLUMNS = "l_orderkey BIGINT, l_partkey BIGINT, l_suppkey BIGINT, l_linenumber INTEGER, l_quantity DOUBLE, l_extendedprice DOUBLE, l_discount DOUBLE, l_tax DOUBLE, l_returnflag VARCHAR, l_linestatus VARCHAR, l_shipdate TIMESTAMP"


def both(spark, folder, name, rows):
    con = duckdb.connect()
    con.execute(f"CREATE TABLE lineitem ({COLUMNS})")
    con.executemany("INSERT INTO lineitem VALUES (?, ?, ?, ?, ?, ?, ?, ?, ?, ?, ?)", [(*r, "O", datetime.datetime(1996, 1, 1)) for r in rows])
    con.execute(f"COPY lineitem TO '{folder}/lineitem.parquet' (FORMAT parquet)")
    out = __spark_entry__.queries()[name](spark, str(folder))
    cols = ", ".join(f'"{c}"' for c in out.columns)
    return sorted(tuple(r) for r in out.collect()), sorted(con.execute(f"SELECT {cols} FROM ({__spark_entry__.oracle_sql()[name]})").fetchall())


def halves():
    """Prices whose answer is a hundredth higher if a half cent is made by scaling in binary."""
    for i in range(100_000, 9_000_000, 100):
        x = (i / 100) * (1 + 0.05 / 50)
        if Decimal(repr(x)).quantize(Decimal("0.01"), ROUND_HALF_UP) != Decimal(round(x * 100)) / 100:
            yield i / 100


def test_half_cents_of_answers(spark, tmp_path):
    rows = [(i, 1, 1, 1, 1.0, p, 0.05, 0.0, "N") for i, p in enumerate(halves())]
    assert rows
    for name in ("score_answers", "score_summary"):
        (folder := tmp_path / name).mkdir()
        got, want = both(spark, folder, name, rows)
        assert got == want


def test_units_of_lists_of_more_than_ten_items(spark, tmp_path):
    line = lambda order, n, flag, tax=0.02: (order, 1, 1, n, 1.0, 100.0, 0.0, tax, flag)
    rows = [line(1, 1, "A")] + [line(1, n, "R") for n in range(2, 16)]  # an eleventh item cuts the unit
    rows += [line(2, 1, "A")] + [line(2, n, "R") for n in range(2, 12)] + [line(2, 12, "N")]  # ten items, then none
    rows += [line(3, 1, "A")] + [line(3, n, "R", 0.0 if n == 5 else 0.02) for n in range(2, 16)]  # one isn't indexed
    got, want = both(spark, tmp_path, "source_units", rows)
    assert got == want and len(got) == 11 + 11 + 4
