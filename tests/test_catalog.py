import duckdb
import pytest

import __spark_entry__ as entry

SF = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def test_every_oracle_has_its_query():
    assert set(entry.oracle_sql()) <= set(entry.queries())


def test_flagship(spark):
    assert entry.entry(spark).count() > 0


@pytest.mark.parametrize("name", ["a01_ensemble_stats", "a07_a08_link_summary", "p17_p20_surface_water", "g01_a11_clusters", "j01_nearest_grid_point", "w11_a09_j11_trunk_samples", "a15_binned_statistics", "a16_log_bins", "a16_u03_pooled_clipped_bins", "i10_f15_moderated_candidates", "p30_regions"])
def test_against_oracle(spark, name):
    db = duckdb.connect()
    for t in TABLES:
        db.sql(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    got = entry.queries()[name](spark, SF)
    want = db.sql(entry.oracle_sql()[name])
    order = sorted(want.columns)
    plain = lambda v: f"{v:.6g}" if isinstance(v, float) else str(v)
    rows = sorted(tuple(plain(r[c]) for c in order) for r in got.collect())
    assert sorted(got.columns) == order
    assert rows == sorted(tuple(plain(dict(zip(want.columns, r, strict=True))[c]) for c in order) for r in want.fetchall())
