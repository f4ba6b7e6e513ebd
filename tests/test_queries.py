"""Every query against its SQL twin."""

import pytest

import __spark_entry__ as contract

QUERIES, ORACLES = contract.queries(), contract.oracle_sql()
TYPES = {"BIGINT": "bigint", "INTEGER": "int", "VARCHAR": "string", "BOOLEAN": "boolean", "DOUBLE": "double"}


def rows_by_name(rows, columns):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    picked = [tuple(row[i] for i in order) for row in rows]
    return sorted(picked, key=lambda r: [(v is None, str(v)) for v in r])


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_query_matches_sql(spark, duck, sf, name):
    frame = QUERIES[name](spark, sf)
    cursor = duck.execute(ORACLES[name])
    described = {d[0]: TYPES.get(str(d[1]), str(d[1])) for d in cursor.description}
    assert dict(frame.dtypes) == described
    expected = rows_by_name(cursor.fetchall(), list(described))
    actual = rows_by_name([tuple(r) for r in frame.collect()], frame.columns)
    assert len(actual) == len(expected)
    assert actual == expected


def test_entry_has_rows(spark):
    frame = contract.entry(spark)
    assert frame.columns == ["page_id", "word", "pos_ord", "pos", "def_ord", "definition"]
    assert frame.count() > 0
