"""Every registered query of the engine: rows, names, and DuckDB's rows where SQL says the same."""

import math

import duckdb
import pytest

import __spark_entry__
from tessella.plans import registry

DATA = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="module")
def con():
    con = duckdb.connect()
    for t in TABLES:
        con.sql(f"CREATE VIEW {t} AS SELECT * FROM '{DATA}/{t}.parquet'")
    return con


#: Whose input at this scale may give nothing.
MAY_BE_EMPTY = {"island_links"}


def ordered(rows):
    """Rows in an order that the last digits of floats don't decide."""
    plain = lambda v: v is None or not isinstance(v, (int, float)) or isinstance(v, bool)
    return sorted((tuple(r) for r in rows), key=lambda r: ([str(v) for v in r if plain(v)], [round(float(v), 1) + 0.0 for v in r if not plain(v)]))


def same(a, b):
    if isinstance(a, float) or isinstance(b, float):
        return a is not None and b is not None and (a == pytest.approx(b, rel=1e-9, abs=2e-4) or (math.isnan(a) and math.isnan(b)))
    return a == b


@pytest.mark.parametrize("name", sorted(registry.oracle_sql()))
def test_same_rows_as_sql(spark, con, name):
    want = con.sql(registry.oracle_sql()[name])
    got = registry.queries()[name](spark, DATA)
    columns = sorted(want.columns)
    assert sorted(got.columns) == columns
    one, two = ordered(got.select(columns).collect()), ordered(want.select(*columns).fetchall())
    assert len(one) == len(two)
    assert [(a, b) for a, b in zip(one, two) if not all(map(same, a, b))] == []


@pytest.mark.parametrize("name", sorted(set(registry.queries()) - set(registry.oracle_sql())))
def test_runs(spark, name):
    out = registry.queries()[name](spark, DATA)
    rows = out.collect()
    assert out.columns and (rows or name in MAY_BE_EMPTY)
    assert sorted(map(str, rows)) == sorted(map(str, registry.queries()[name](spark, DATA).collect()))


def test_entry(spark):
    assert __spark_entry__.entry(spark).count() > 0


def test_sql_belongs_to_queries():
    assert set(__spark_entry__.oracle_sql()) <= set(__spark_entry__.queries())


def shifted(con, folder, more, **shift):
    """A folder with tables whose keys are shifted, and SQL's views of it."""
    for t, keys in shift.items():
        con.sql(f"COPY (SELECT * REPLACE ({', '.join(f'{k} + {n} AS {k}' for k, n in keys.items())}) FROM '/root/testdata/{more}/{t}.parquet') TO '{folder}/{t}.parquet' (FORMAT parquet)")
    for t in TABLES:
        con.sql(f"CREATE OR REPLACE VIEW {t} AS SELECT * FROM '{folder if t in shift else DATA}/{t}.parquet'")
    return str(folder)


def equal_to_sql(spark, con, name, folder):
    want = con.sql(registry.oracle_sql()[name])
    columns = sorted(want.columns)
    got = registry.queries()[name](spark, folder).select(columns)
    assert set(map(tuple, got.collect())) == set(want.select(*columns).fetchall())


def test_suppliers_and_parts_are_different_rooms(spark, tmp_path):
    con = duckdb.connect()
    folder = shifted(con, tmp_path, "sf0.001", lineitem={"l_suppkey": 995}, supplier={"s_suppkey": 995})
    equal_to_sql(spark, con, "adjacency_metric", folder)


def test_tiles_of_a_plan_of_a_million_parts(spark, tmp_path):
    con = duckdb.connect()
    folder = shifted(con, tmp_path, "sf0.001", part={"p_partkey": 1_000_000})
    equal_to_sql(spark, con, "tile_merge", folder)


def test_norms_of_turned_rooms_that_end_in_halves(spark, tmp_path):
    con = duckdb.connect()
    # sums end in half a thousandth, which SQL's own rounding takes up or down with the order of its sum
    for name, user, more, norm in (("a", 469, 5, 10872.656), ("b", 973, 0, 9140.795), ("c", 577, 3, 9024.32)):
        folder = tmp_path / name
        folder.mkdir()
        con.sql(f"COPY (SELECT * REPLACE (event_id + {more * 100_000} AS event_id, user_id + {more * 1500} AS user_id) FROM '/root/testdata/sf0.1/events.parquet' WHERE user_id = {user}) TO '{folder}/events.parquet' (FORMAT parquet)")
        assert [r["norm"] for r in registry.queries()["oriented_cloud"](spark, str(folder)).collect()] == [norm]


def test_points_as_far_from_a_quantile_as_counts(spark, tmp_path):
    con = duckdb.connect()
    # points 0.15 from a quantile but for its last bit, which says whether the room is upside down
    copies = " UNION ALL ".join(f"SELECT * REPLACE (event_id + {i} * 100000 AS event_id, user_id + {i} * 1500 AS user_id) FROM '/root/testdata/sf0.1/events.parquet' WHERE user_id + {i} * 1500 IN (81168, 54638, 84101, 80695, 16749, 60182, 53213, 75002)" for i in range(60))
    con.sql(f"COPY ({copies}) TO '{tmp_path}/events.parquet' (FORMAT parquet)")
    con.sql(f"CREATE VIEW events AS SELECT * FROM '{tmp_path}/events.parquet'")
    want = {r[0]: r[2] for r in con.sql(registry.oracle_sql()["oriented_cloud"]).fetchall()}
    assert len(want) == 8 and {r["user_id"]: r["flipped"] for r in registry.queries()["oriented_cloud"](spark, str(tmp_path)).collect()} == want


def test_points_that_equal_a_quantile_of_their_room(spark, tmp_path):
    con = duckdb.connect()
    # rooms of 4,000 points, of which several are equally far out but for the last bit, where SQL's quantile between them is one or the other
    con.sql(f"COPY (SELECT e.* REPLACE (event_id + i * 100000 AS event_id) FROM '/root/testdata/sf0.1/events.parquet' e, range(60) r(i) WHERE user_id IN (411, 1176)) TO '{tmp_path}/events.parquet' (FORMAT parquet)")
    con.sql(f"CREATE VIEW events AS SELECT * FROM '{tmp_path}/events.parquet'")
    equal_to_sql(spark, con, "clip_reasons", str(tmp_path))


def test_quantiles_are_equal_to_those_of_sql_bit_by_bit(spark):
    from tessella.operators.quantiles import quantiles

    con = duckdb.connect()
    rows = [(i, math.sqrt(1 + i * 31 % 97 + j)) for i in range(300) for j in range(5 + i % 40)]
    con.sql("CREATE TABLE t (k INT, v DOUBLE)")
    con.executemany("INSERT INTO t VALUES (?, ?)", rows)
    got = quantiles(spark.createDataFrame(rows, "k int, v double"), ["k"], "v", {"a": 0.1, "b": 0.98}).select("k", "a", "b")
    assert set(map(tuple, got.collect())) == set(con.sql("SELECT k, quantile_cont(v, 0.1), quantile_cont(v, 0.98) FROM t GROUP BY 1").fetchall())


def test_nearest_vectors_in_blocks_with_gaps_and_copies(spark, tmp_path, monkeypatch):
    from tessella.operators import graph

    for name, value in (("BLOCK", 16), ("QUERIES", 3), ("PAIRS", 40)):
        monkeypatch.setattr(graph, name, value)
    for name, gone in (("whole", "false"), ("gaps", "(vec_id * 7 + k) % 19 = 0 OR vec_id % 90 = 0")):
        folder = tmp_path / name
        folder.mkdir()
        con = duckdb.connect()
        # every third vector is a copy of the first of its label
        con.sql(f"COPY (SELECT vec_id, label, list_transform(CASE WHEN vec_id % 3 = 0 THEN f ELSE embedding END, lambda v, k: CASE WHEN {gone} THEN NULL ELSE v END) AS embedding FROM (SELECT *, first(embedding) OVER (PARTITION BY label ORDER BY vec_id) AS f FROM '/root/testdata/sf0.1/embeddings.parquet' WHERE vec_id < 400)) TO '{folder}/embeddings.parquet' (FORMAT parquet)")
        con.sql(f"CREATE VIEW embeddings AS SELECT * FROM '{folder}/embeddings.parquet'")
        equal_to_sql(spark, con, "nearest_neighbour", str(folder))


def test_points_of_a_footprint_are_turned_after_they_are_brought_together(spark):
    plan = registry.queries()["footprints"](spark, DATA)._jdf.queryExecution().optimizedPlan().toString()
    assert "explode" not in plan and plan.count("Aggregate") == 2  # none of ninety angles per point before a shuffle


def test_layers_of_many_heights_are_those_of_histograms(spark):
    import numpy as np

    from tessella.operators import spatial

    def alone(height):
        low, high = np.percentile(height, [1, 99])
        if high - low < spatial.EXTENT:
            return 0.0
        count, reach = np.histogram(height, spatial.BINS, (low, high))[0], max(1, round(spatial.THICK * spatial.BINS / (high - low)))
        at = np.arange(spatial.BINS)
        layer = np.array([count[max(0, k - reach) : k + reach + 1].sum() for k in at])
        other = layer[np.abs(at - layer.argmax()) > 4 * reach]
        return float(layer.max() + (other.max() if len(other) else 0)) / max(1, int(count.sum()))

    r = np.random.default_rng(5)
    many = np.concatenate([r.integers(0, 7, (40, 80)) / 100 + r.choice([0, 2.5, 1.1], (40, 80)), r.normal(size=(40, 80)) / 3])
    assert spatial.layer_scores(many).tolist() == [alone(h) for h in many]


def test_components_of_edges_that_lie_together_or_apart(spark, monkeypatch):
    from tessella.operators import graph

    chains = [(1000 * c + i, 1000 * c + (i + 1) % 40) for c in range(20) for i in range(39)]
    want = {(n, n // 1000 * 1000) for edge in chains for n in edge}
    edges = spark.createDataFrame(chains, "a long, b long")
    assert set(map(tuple, graph.components(edges.repartition(7), "a", "b").collect())) == want
    # no rounds where a task has all edges of a component
    monkeypatch.setattr(graph, "linked_components", None)
    assert set(map(tuple, graph.components(edges.coalesce(1), "a", "b").collect())) == want


def test_doors_are_aggregated_with_their_pairs(spark):
    plan = registry.queries()["door_adjacency"](spark, DATA)._jdf.queryExecution().optimizedPlan().toString()
    assert "Join" not in plan


def test_hot_groups_are_not_shuffled_for_their_quantiles(spark):
    old = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        for name in ("histogram_bins", "histogram_layers"):
            plan = registry.queries()[name](spark, DATA)._jdf.queryExecution().executedPlan().toString()
            assert "SortMergeJoin" not in plan and "BroadcastHashJoin" in plan
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", old)
