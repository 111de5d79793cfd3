"""The shared step of the searches: segments are dealt by id as the parts of their texts."""

from datetime import datetime

from staffscope.checks import base
from staffscope.checks.inputs import load


def _tables(spark, folder):
    day = datetime(2000, 1, 1)
    rows = {
        "region": ("r_regionkey long, r_name string", [(0, "ASIA")]),
        "nation": ("n_nationkey long, n_name string, n_regionkey long", [(0, "CHINA", 0), (0, "CHINA", 0), (1, "INDIA", 0)]),
        "supplier": ("s_suppkey long, s_name string, s_nationkey long, s_acctbal double", [(1, "Supplier#1", 0, 5.0), (2, None, 1, -5.0), (3, "lost", None, 0.0)]),
        "part": ("p_partkey long, p_name string, p_brand string, p_type string", [(1, "large ring", "Brand#1", "LARGE"), (2, None, "Brand#2", None)]),
        "orders": ("o_orderkey long, o_custkey long, o_orderdate timestamp", [(1, 7, day), (1, 8, day), (2, None, day), (None, 9, day)]),
        "lineitem": ("l_orderkey long, l_partkey long, l_suppkey long, l_linenumber int, l_quantity double, l_discount double, l_tax double, "
                     "l_returnflag string, l_linestatus string, l_shipdate timestamp",
                     [(1, 1, 1, 1, 50.0, 0.05, 0.04, "R", "O", day), (1, 1, 1, 1, 50.0, 0.05, 0.04, "R", "O", day), (2, 2, 2, 1, 2.0, 0.06, None, "A", "F", None),
                      (1, 1, 2, 2, None, 0.07, 0.0, "N", "O", day), (1, 1, 3, 3, 1.0, 0.0, 0.0, "N", "O", day), (None, 1, 1, 4, 1.0, 0.0, 0.0, "N", "O", day)])}
    for name, (schema, values) in rows.items():
        spark.createDataFrame(values, schema).write.parquet(f"{folder}/{name}.parquet")
    return str(folder)


def test_segments_are_dealt_before_their_texts_are_made(spark, tmp_path):
    sf = _tables(spark, tmp_path)
    dealt = base.segments(spark, sf)
    plan = dealt._jdf.queryExecution().optimizedPlan().toString().splitlines()
    at = next(number for number, line in enumerate(plan) if "RepartitionByExpression" in line)
    made = "Group>"  # what departments begin with
    assert any(made in line for line in plan[:at]) and not any(made in line for line in plan[at + 1:])
    every = lambda df: sorted(map(repr, df.collect()))
    assert every(dealt) == every(load(spark, sf, "fx_segment"))
    assert dealt.count() == 11
    stored = base.tables(spark, sf)["segment"]
    assert every(stored) == every(dealt)
