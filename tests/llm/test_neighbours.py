import numpy as np

from strandlake.llm import neighbours


def _exact(ids, x, queries, count):
    out = {}
    for q in queries:
        s = x @ x[q]
        order = np.lexsort((ids, -s))
        out[ids[q]] = [(int(ids[k]), float(s[k])) for k in order if ids[k] != ids[q]][:count]
    return out


def _run(spark, rows, count=20, every=20):
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>, dim string")
    graphs, shards = neighbours.index(df)
    found = {}
    for r in neighbours.nearest(df.where(f"vec_id % {every} = 0"), graphs, shards, count).orderBy("query_id", "rank").collect():
        found.setdefault(r.query_id, []).append((r.rank, r.vec_id, r.score))
    return found


def test_recall_over_several_shards(spark, monkeypatch):
    monkeypatch.setattr(neighbours, "MOST_NUMBERS", 700 * 32)
    assert neighbours.shards_of(1700, 32, 4) == 3
    draw = np.random.default_rng(3)
    x = draw.normal(size=(2000, 32)).astype(np.float32) * draw.uniform(0.5, 2, (2000, 1)).astype(np.float32)
    x[100:400] = x[7]  # one vector many times
    ids = draw.permutation(5000)[:2000]
    found = _run(spark, [(int(i), v.tolist(), "x") for i, v in zip(ids, x, strict=True)])
    want = _exact(ids, x.astype(np.float64), np.flatnonzero(ids % 20 == 0), 20)
    assert set(found) == set(want)
    hits = 0
    for q, rows in found.items():
        assert [r for r, _, _ in rows] == list(range(1, 21))
        assert rows == sorted(rows, key=lambda r: (-r[2], r[1]))
        exact = dict(want[q])
        hits += sum(v in exact and abs(exact[v] - s) < 1e-12 for _, v, s in rows)
    assert hits / (20 * len(want)) > 0.9


def test_small_odd_and_empty_tables(spark):
    rows = [(0, [1.0, 0.0], ""), (0, [1.0, 0.0], ""), (20, [0.5, 0.5], ""), (1, [1.0, 0.0], ""), (2, None, ""), (3, [0.0, 0.0], ""), (4, [1.0, None], ""), (5, [float("nan"), 1.0], ""), (6, [float("inf"), 1.0], ""), (7, [1.0, 2.0, 3.0], ""), (40, [2.0], ""), (8, [], "")]
    found = _run(spark, rows)
    assert found == {0: [(1, 1, 1.0), (2, 20, 0.5)], 20: [(1, 0, 0.5), (2, 1, 0.5)]}
    assert _run(spark, []) == {}


def test_double_precision(spark):
    base = [[1e300 * (1 + k * 1e-12), 2e280, -3.0] for k in range(30)]
    df = spark.createDataFrame([(k, v) for k, v in enumerate(base)], "vec_id long, embedding array<double>")
    graphs, shards = neighbours.index(df)
    query = spark.createDataFrame([(100, [1.0, 0.0, 0.0]), (101, [0.0, 1e-300, 1.0])], "vec_id long, embedding array<double>")
    got = neighbours.nearest(query, graphs, shards, 5).orderBy("query_id", "rank").collect()
    assert [(r.vec_id, r.score) for r in got if r.query_id == 100] == [(29 - k, base[29 - k][0]) for k in range(5)]
    assert [r.vec_id for r in got if r.query_id == 101] == list(range(5))


def test_shards_follow_cores_and_size():
    assert [neighbours.shards_of(n, 64, 6) for n in (0, 4096, 4097, 10_256, 51_282, 10**6, 75 * 10**6)] == [1, 1, 2, 3, 6, 8, 573]


def test_small_graphs_reach_all(spark):
    x = np.random.default_rng(1).normal(size=(60, 8)).astype(np.float32)
    found = _run(spark, [(k, v.tolist(), "") for k, v in enumerate(x)], 100)
    assert all(len(rows) == 59 for rows in found.values()) and len(found) == 3
