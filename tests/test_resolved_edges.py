"""Edges remapped through resolution, against brute force over all line items."""

from collections import Counter

from graphloom import queries

SF = "/root/testdata/sf0.001"


def test_every_line_item_is_remapped(spark):
    cid = {int(r["id"][1:]): r["cid"] for r in queries.resolve_clusters(spark, SF).collect()}
    line = spark.read.parquet(f"{SF}/lineitem.parquet").select("l_orderkey", "l_linenumber", "l_partkey").collect()
    got = queries.resolve_remapped_edges(spark, SF).collect()
    assert len({r["id"] for r in got}) == len(got) == len(line) == 6000
    want = Counter((f"l{o}-{n}", cid[p], cid[p]) for o, n, p in line)
    assert Counter((r["id"].rsplit("-", 1)[0], r["source"], r["target"]) for r in got) == want
