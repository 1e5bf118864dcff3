"""Texts of exported values."""

import duckdb

from failscope.sources import files as io


def test_values_are_written_as_the_sql_writes_them(spark):
    values = [0.0, 1.0, -1.5, 0.123456, 0.001, 0.000123, 0.0001, -0.00035, 0.000099, 0.00001, 0.000001, -0.000012, 0.0000001, 12.0, 9999999.25, 1e7, 12345678.25, -123456789.5, 2e15, 1e16, 2.5e17, 1e100, None, float("nan"), float("inf")]
    df = spark.createDataFrame([("m", f"f{i:02d}", "psi", v) for i, v in enumerate(values)], "module string, feature string, metric string, value double")
    got = [r["Value"] for r in io.export_summary(df).collect()]
    wanted = [duckdb.execute("select cast(round(cast(? as double), 6) as varchar)", [v]).fetchone()[0] for v in values]
    assert got == wanted, list(zip(values, got, wanted))
