"""The driver contract under a session the package did not configure."""

import __spark_entry__ as contract


def test_contract(spark, sf_dir):
    df = contract.entry(spark)
    assert df.columns == ["model", "mse", "mae", "turnover_seq", "mse_rank"]
    assert {r["model"] for r in df.collect()} == {"lag1", "mean5", "mean20", "equal"}
    assert set(contract.oracle_sql()) <= set(contract.queries())
    assert len(contract.oracle_sql()) > 85


def test_every_operator_has_a_query():
    """One key at least per operator of the inventory."""
    groups = {"a": 11, "b": 13, "c": 16, "d": 7, "e": 7, "f": 13, "g": 23, "h": 5}
    ids = {k[:3] for k in contract.queries()}
    wanted = {f"{g}{n:02d}" for g, last in groups.items() for n in range(1, last + 1)} | {"f00"}
    assert wanted <= ids
