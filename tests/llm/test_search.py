import numpy as np
import pytest

from braidflow.llm import search

SCHEMA = "vec_id long, embedding array<float>, score string, rank string"


def vectors(n=400, dim=8):
    rng = np.random.default_rng(2)
    rows = [(i, rng.normal(size=dim).astype(np.float32).tolist(), "x", "x") for i in range(n)]
    rows[11] = (11, rows[10][1], "x", "x")  # equal vectors tie
    rows[12] = (12, rows[10][1], "x", "x")
    rows += [(1001, None, "x", "x"), (1002, [1.0] * (dim - 1) + [None], "x", "x"), (1100, [float("nan")] * dim, "x", "x"), (1003, [float("inf")] * dim, "x", "x"), (1200, [1.0, 2.0], "x", "x"), (None, [1.0] * dim, "x", "x"), (5, rows[5][1], "x", "x"), (1300, [0.0] * dim, "x", "x"), (1400, [], "x", "x")]
    return rows


def used(rows, dim, zero):
    out = {}
    for i, v, *_ in rows:
        if i is not None and v is not None and len(v) == dim and all(x is not None and np.isfinite(x) for x in v) and (zero or any(v)):
            out[i] = np.array(v, float)
    return out


def test_exact_top_k(spark, monkeypatch):
    monkeypatch.setattr(search, "BLOCK", 50)
    rows = vectors()
    known = {i: np.floor(1024 * v).astype(int) for i, v in used(rows, 8, True).items()}
    got = search.exact_top_k(spark.createDataFrame(rows, SCHEMA).repartition(3), every=50).collect()
    want = []
    for q in (i for i in known if i % 50 == 0):
        best = sorted((-int(known[q] @ v), i) for i, v in known.items() if i != q)[:10]
        want += [(q, k + 1, i, -s) for k, (s, i) in enumerate(best)]
    assert sorted(map(tuple, got)) == sorted(want)


def test_many_blocks_give_the_same(spark, monkeypatch):
    rows = vectors()
    df = spark.createDataFrame(rows, SCHEMA)
    for f in (search.exact_top_k, search.nearest_neighbours):
        one = sorted(map(tuple, f(df, every=20).collect()))
        with monkeypatch.context() as m:
            m.setattr(search, "QUERY_ROWS", 3)
            m.setattr(search, "FILE_ROWS", 30)
            m.setattr(search, "MOST_PARTITIONS", 5)
            assert sorted(map(tuple, f(df, every=20).collect())) == one


def test_neighbours_are_exact_when_all_cells_are_visited(spark, monkeypatch):
    monkeypatch.setattr(search, "BLOCK", 64)
    rows = vectors()
    known = used(rows, 8, False)
    got = search.nearest_neighbours(spark.createDataFrame(rows, SCHEMA).repartition(3), visit=1.0, centroids=6).collect()
    for r in got:
        a, b = known[r["query_id"]], known[r["vec_id"]]
        assert r["score"] == pytest.approx(a @ b / np.linalg.norm(a) / np.linalg.norm(b), abs=1e-12)
    for q in (i for i in known if i % 50 == 0):
        best = sorted((-round(float(known[q] @ v / np.linalg.norm(known[q]) / np.linalg.norm(v)), 12), i) for i, v in known.items() if i != q)[:5]
        assert [r["vec_id"] for r in sorted((r for r in got if r["query_id"] == q), key=lambda r: r["rank"])] == [i for _, i in best]


def test_recall_of_a_part_of_the_cells(spark):
    rng = np.random.default_rng(3)
    centres = rng.normal(size=(10, 16))
    x = (centres[rng.integers(0, 10, 4000)] + rng.normal(size=(4000, 16))).astype(np.float32)
    df = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "vec_id long, embedding array<float>")
    got = search.nearest_neighbours(df).collect()
    u = search.unit(x.astype(float))
    hit = 0
    for q in range(0, 4000, 50):
        s = u @ u[q]
        s[q] = -2
        hit += len(set(np.argsort(-s)[:5].tolist()) & {r["vec_id"] for r in got if r["query_id"] == q})
    assert hit / (80 * 5) >= 0.9


def test_empty_and_few(spark):
    for f in (search.exact_top_k, search.nearest_neighbours):
        assert f(spark.createDataFrame([], SCHEMA)).collect() == []
        assert f(spark.createDataFrame([(0, [1.0, 2.0], "x", "x")], SCHEMA)).collect() == []
        assert len(f(spark.createDataFrame([(0, [1.0, 2.0], "x", "x"), (1, [2.0, 1.0], "x", "x")], SCHEMA)).collect()) == 1


def test_many_copies_of_one_vector(spark):
    """A third of the rows in one cell: all of them can be found, ties go to the smaller ids."""
    rng = np.random.default_rng(5)
    x = rng.normal(size=(900, 8)).astype(np.float32)
    x[300:600] = x[300]
    got = search.nearest_neighbours(spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "vec_id long, embedding array<float>")).collect()
    for q in (350, 400, 550):
        assert [r["vec_id"] for r in sorted((r for r in got if r["query_id"] == q), key=lambda r: r["rank"])] == [300, 301, 302, 303, 304]


def test_multi_sequence_stops_where_enough_is_held():
    """The last sum is that of the cell with which, by ascending sum, the wanted number of entries is reached."""
    rng = np.random.default_rng(1)
    a, b, counts = rng.random(7), rng.random(9), rng.integers(0, 4, 63).tolist()
    order = sorted((a[i] + b[j], counts[i * 9 + j]) for i in range(7) for j in range(9))
    for want in range(1, sum(counts) + 1):
        held = np.cumsum([c for _, c in order])
        assert search.multi_sequence(a, b, counts, want) == order[int(np.searchsorted(held, want))][0]
