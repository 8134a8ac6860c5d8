"""Each corpus query that has SQL, against it over the smallest tables: SQL that doesn't parse fails here."""

import duckdb
import pytest

from recordlift.llm import queries

DATA = "/root/testdata/sf0.001"


def shown(row):
    return tuple(round(v, 9) if isinstance(v, float) else v for v in row)


@pytest.mark.parametrize("name", sorted(queries.SQL))
def test_query_is_its_sql(spark, name):
    got = queries.QUERIES[name](spark, DATA)
    with duckdb.connect() as db:
        for t in ("documents", "benchmark", "labels", "pages"):
            db.execute(f"CREATE VIEW {t} AS SELECT * FROM '{DATA}/{t}.parquet'")
        want = db.execute(queries.SQL[name])
        order = [c[0] for c in want.description]
        assert sorted(order) == sorted(got.columns)
        assert sorted(map(str, (shown(r) for r in got.select(order).collect()))) == sorted(map(str, map(shown, want.fetchall())))
