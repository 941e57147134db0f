"""What a task holds when lines are added up by order, by the plans of small inputs."""

import re

from tessera.sources import tables


def _lines(spark, path):
    rows = [(i % 500 if i % 97 else None, i % 7, float(i % 13), float(i), 0.25, 0.5, "RN"[i % 2], "OF"[i % 2]) for i in range(3000)]
    spark.createDataFrame(rows, "l_orderkey long, l_partkey long, l_quantity double, l_extendedprice double, l_discount double, "
                          "l_tax double, l_returnflag string, l_linestatus string").write.parquet(f"{path}/lineitem.parquet")
    spark.createDataFrame([(i, i) for i in range(6)], "p_partkey long, p_size int").write.parquet(f"{path}/part.parquet")
    return [r for r in rows if r[1] < 6]


def test_lines_are_dealt_out_by_order_before_they_are_added_up(spark, tmp_path, monkeypatch):
    kept = _lines(spark, tmp_path)
    few = tables.order_lines(spark, str(tmp_path))
    monkeypatch.setattr(tables, "TASK_LINES", 100)
    many = tables.order_lines(spark, str(tmp_path))
    assert many.rdd.getNumPartitions() == 30
    for df in (few, many):
        plan = df._jdf.queryExecution().optimizedPlan().toString()
        assert re.search(r"^Aggregate \[l_orderkey.*\n\+- Repartition\w* \[l_orderkey", plan)
    want = {}
    for key, _, quantity, *_ in kept:
        n, q = want.get(key, (0, 0.0))
        want[key] = n + 1, q + quantity
    for df in (few, many):
        assert {r["l_orderkey"]: (r["line_count"], float(r["qty_sum"])) for r in df.collect()} == want


def test_orders_meet_customers_in_as_many_tasks(spark, tmp_path, monkeypatch):
    _lines(spark, tmp_path)
    spark.createDataFrame([(i if i % 89 else None, i % 40 if i % 31 else None, float(i), "1-URGENT", "O") for i in range(520)],
                          "o_orderkey long, o_custkey long, o_totalprice double, o_orderpriority string, o_orderstatus string"
                          ).write.parquet(f"{tmp_path}/orders.parquet")
    spark.createDataFrame([(i // 2 * 2, i % 2, 100.0 * i, "AUTO") for i in range(40)],
                          "c_custkey long, c_nationkey int, c_acctbal double, c_mktsegment string").write.parquet(f"{tmp_path}/customer.parquet")
    spark.createDataFrame([(0, 0), (1, 0)], "n_nationkey int, n_regionkey int").write.parquet(f"{tmp_path}/nation.parquet")
    spark.createDataFrame([(0, "ASIA")], "r_regionkey int, r_name string").write.parquet(f"{tmp_path}/region.parquet")
    few = sorted(map(str, tables.order_profile(spark, str(tmp_path)).collect()))
    monkeypatch.setattr(tables, "TASK_LINES", 100)
    many = tables.order_profile(spark, str(tmp_path))
    assert re.search(r"RepartitionByExpression \[o_custkey#\d+L\], 30", many._jdf.queryExecution().optimizedPlan().toString())
    assert sorted(map(str, many.collect())) == few and len(few) > 400
