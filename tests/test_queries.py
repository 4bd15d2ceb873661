"""Every query of the reference's own operators against its SQL in DuckDB."""

import os

import duckdb
import numpy as np
import pytest

from gridloom import programs

TABLES = "region nation customer supplier part orders lineitem events".split()


def rows(names, values):
    order = sorted(range(len(names)), key=lambda k: names[k])
    plain = lambda v: None if v is None or v != v else round(float(v), 6) if isinstance(v, float) or type(v).__name__ == "Decimal" else v
    return [names[k] for k in order], sorted(str([plain(r[k]) for k in order]) for r in values)


@pytest.mark.parametrize("name", sorted(programs.QUERIES))
def test_matches_sql(spark, sf_dir, name):
    if name not in programs.ORACLE_SQL:
        pytest.skip("no SQL")
    db = duckdb.connect()
    for t in TABLES + ["embeddings"]:
        db.sql(f"CREATE VIEW {t} AS SELECT * FROM '{os.path.join(sf_dir, t)}.parquet'")
    got, want = programs.QUERIES[name](spark, sf_dir), db.sql(programs.ORACLE_SQL[name])
    assert rows(got.columns, got.collect()) == rows(want.columns, want.fetchall())


@pytest.mark.parametrize("name", ["a14_prefix_scan", "a21_tuple_reduction", "j04_outer", "o7_running"])
def test_matches_sql_beyond_32_bits(spark, sf_dir, tmp_path, name):
    """Sums and products of a larger table: each value fits 32 bits, what is made of them doesn't."""
    db = duckdb.connect()
    for t, c in (("lineitem", "l_quantity"), ("events", "value")):
        db.sql(f"COPY (SELECT * REPLACE ({c} * 20000 AS {c}) FROM '{os.path.join(sf_dir, t)}.parquet') TO '{tmp_path}/{t}.parquet'")
        db.sql(f"CREATE VIEW {t} AS SELECT * FROM '{tmp_path}/{t}.parquet'")
    got, want = programs.QUERIES[name](spark, str(tmp_path)), db.sql(programs.ORACLE_SQL[name])
    want = rows(want.columns, want.fetchall())
    assert rows(got.columns, got.collect()) == want
    assert max(max(map(int, r.strip("[]").split(","))) for r in want[1]) > 1 << 31


def test_inverse_transform_on_halves(spark, tmp_path):
    """Values that lie on a half of the last digit, and single-precision ones next to one."""
    rng = np.random.default_rng(2)
    halves = [[float(rng.integers(-5000, 5000)) / 10000 + 0.00005 for _ in range(64)] for _ in range(60)]
    halves += [[float(rng.integers(-16, 16) * 2 + 1) / 32 for _ in range(64)] for _ in range(20)]
    spark.createDataFrame(list(enumerate(halves)), "vec_id long, embedding array<float>").write.parquet(f"{tmp_path}/embeddings.parquet")
    db = duckdb.connect()
    db.sql(f"CREATE VIEW embeddings AS SELECT * FROM '{tmp_path}/embeddings.parquet/*.parquet'")
    got, want = programs.QUERIES["w18_fft_inverse"](spark, str(tmp_path)), db.sql(programs.ORACLE_SQL["w18_fft_inverse"])
    assert rows(got.columns, got.collect()) == rows(want.columns, want.fetchall())
