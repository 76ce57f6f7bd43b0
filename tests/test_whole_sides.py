"""Comparisons and components over all rows of their tables, against brute force."""

import math
from collections import Counter

from graphloom import queries

SF = "/root/testdata/sf0.001"


def table(spark, name):
    return spark.read.parquet(f"{SF}/{name}.parquet").collect()


def test_all_orders_are_compared(spark):
    orders = table(spark, "orders")
    actual = Counter((r["o_custkey"], r["o_orderstatus"]) for r in orders)
    expected = Counter((r["o_custkey"], "U" if r["o_orderpriority"] == "1-URGENT" else r["o_orderstatus"]) for r in orders)
    got = queries.edge_bag_counts(spark, SF).first()
    assert (got["n_both"], got["n_actual"], got["n_expected"]) == ((actual & expected).total(), len(orders), len(orders))
    assert 0 < got["n_both"] < len(orders)


def test_all_documents_are_compared(spark):
    labels, documents = ({r["doc_id"] for r in table(spark, name)} for name in ("labels", "documents"))
    got = queries.node_set_counts(spark, SF).first()
    assert (got["n_both"], got["n_actual"], got["n_expected"]) == (len(labels & documents), len(labels), len(documents))


def test_all_suppliers_are_linked_twice(spark):
    low = {}

    def root(x):
        while low.setdefault(x, x) != x:
            x = low[x]
        return x

    for r in table(spark, "supplier"):
        for other in (f"n{r['s_nationkey']}", f"b{math.floor(r['s_acctbal'] / 2000)}"):
            a, b = sorted((root(f"s{r['s_suppkey']:09}"), root(other)))
            low[b] = a
    assert {r["node"]: r["component"] for r in queries.resolve_components(spark, SF).collect()} == {x: root(x) for x in low}
