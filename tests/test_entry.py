"""The driver's contract holds, with or without the corpus operators."""

import __spark_entry__


def test_names():
    names = set(__spark_entry__.queries())
    assert set(__spark_entry__.oracle_sql()) <= names
    assert "duplicate_groups" in names


def test_entry(spark):
    assert __spark_entry__.entry(spark).count() > 0
