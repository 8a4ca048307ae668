"""Every registered query against its SQL in DuckDB on the smallest tables."""

import duckdb
import pytest

from tessera.plans import registry

SF = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def rows(frame):
    frame = frame[sorted(frame.columns)]
    plain = frame.astype(object).where(frame.notna(), None).itertuples(index=False, name=None)
    return list(frame.columns), sorted(str(tuple(float(x) if isinstance(x, (int, float)) and not isinstance(x, bool) else x for x in r)) for r in plain)


@pytest.mark.parametrize("name", sorted(registry.ORACLES))
def test_same_rows(spark, name):
    db = duckdb.connect()
    for t in TABLES:
        db.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    assert rows(registry.QUERIES[name](spark, SF).toPandas()) == rows(db.execute(registry.ORACLES[name]).df())
