"""Faults of single cells, views and texts that earlier ended an extraction or changed the session."""

import json
import math

import pytest
from pyspark.sql import functions as F

import graphloom as g
from graphloom.functions import cast_value, normalized
from graphloom.operators.context import ExtractionContext
from graphloom.operators.records import SqlExtractor, columns_quoted


def casts(spark, values, to):
    rows = spark.createDataFrame([(i, json.dumps(v)) for i, v in enumerate(values)], "i int, v string")
    return [json.loads(r["c"]) for r in rows.select("i", cast_value(F.col("v"), to).alias("c")).orderBy("i").collect()]


def test_casts_of_numbers_beyond_64_bits(spark):
    values = [2**63, -(2**63), 2**63 - 1, 10**20, "123456789012345678901", 1.5e25, -7.9, 2**94 + 2**60, "9,000"]
    whole = [int(float(str(v).replace(",", ""))) for v in values]
    assert casts(spark, values, "int") == whole
    assert casts(spark, values, "number") == [-7.9 if v == -7.9 else w for v, w in zip(values, whole, strict=True)]
    assert casts(spark, [1e300, "9" * 400, [10**25, "x", 2]], "int") == [1e300, "9" * 400, [10**25 if int(float(10**25)) == 10**25 else int(float(10**25)), "x", 2]]
    assert all(math.isfinite(x) for x in casts(spark, [10**30, 3], "float"))


def test_an_extraction_goes_on_over_one_bad_cell(spark):
    table = [{"k": "a", "n": "12"}, {"k": "b", "n": "9" * 30}, {"k": "c", "n": "x"}]
    spec = g.GraphSpec((g.NodeType("t", attributes=(g.AttrSchema("n"),)),))
    graph = g.extract({"rows": table}, spec, {"t": ("table_map", {"records_source": "rows", "id_from": "k", "attributes": ["n"], "casts": {"n": "int"}})}, spark=spark)
    assert {n.id: n.attributes["n"] for n in graph.collect_nodes()} == {"t:a": 12, "t:b": "9" * 30, "t:c": "x"}


def test_tables_are_deleted_when_released(spark):
    from graphloom import storage

    before = list(storage._made)
    with storage.released(spark):
        table = storage.stored(spark.range(5), "five")
        assert table.count() == 5 and len(storage._made) == len(before) + 1
        path = storage._made[-1]
    assert storage._made == before
    with pytest.raises(Exception, match="PATH_NOT_FOUND|does not exist"):
        spark.read.parquet(path).count()


def test_the_sessions_own_view_stays(spark):
    spark.range(3).createOrReplaceTempView("t")
    spark.range(5).selectExpr("id AS k").createOrReplaceTempView("other")
    context = ExtractionContext(spark, g.SourceBundle([g.Source("s", [{"k": "1", "a b": "x"}, {"k": "2", "a b": "it's"}], "table")]), g.GraphSpec())
    before = spark.conf.get("spark.sql.ansi.doubleQuotedIdentifiers")
    records = context.sources.table(spark, "s")
    run = lambda sql, *p: [tuple(r) for r in SqlExtractor("s", sql, p).query(spark, records).collect()]
    assert run('SELECT "a b" FROM t WHERE k = ? AND "a b" <> \'"no"\';', "2") == [("it's",)]
    assert run("WITH u AS (SELECT k FROM t) SELECT u.k FROM u JOIN other ON other.k = u.k ORDER BY 1 DESC") == [("2",), ("1",)]
    assert spark.table("t").count() == 3 and spark.conf.get("spark.sql.ansi.doubleQuotedIdentifiers") == before
    assert not [v.name for v in spark.catalog.listTables() if v.name.startswith("_records_")]
    for name in ("t", "other"):
        spark.catalog.dropTempView(name)
    with pytest.raises(ValueError, match="query"):
        run("DROP TABLE x")


def test_names_are_quoted_and_texts_are_not():
    assert columns_quoted("""SELECT "a""b", 'x "y" ''z''' FROM t""") == """SELECT `a"b`, 'x "y" ''z''' FROM t"""


def test_case_is_folded_in_columns_as_in_calls(spark):
    pairs = [("Straße", "STRASSE"), ("ΛΟΓΟΣ", "λογος"), ("a  b", " A B "), ("ﬁn", "FIN"), ("İ", "i̇"), ("x", "y"), ("", " ")]
    rule = g.NormalizedMatch()
    rows = spark.createDataFrame([(json.dumps(a, ensure_ascii=False), json.dumps(b, ensure_ascii=False)) for a, b in pairs], "a string, b string")
    got = [r[0] for r in rows.select(rule.column(F.col("a"), F.col("b"))).collect()]
    assert got == [rule(a, b).score for a, b in pairs] and got[:4] == [1.0] * 4
    assert [r[0] for r in spark.createDataFrame([(None,), ("\x1c a\tB \x0b",)], "s string").select(normalized(F.col("s"))).collect()] == [None, "a b"]


def test_bindings_of_one_table_see_the_same_row_numbers(spark):
    shuffled = spark.range(200).withColumn("k", F.col("id").cast("string")).repartition(7).orderBy(F.rand())
    spec = g.GraphSpec((g.NodeType("a"), g.NodeType("b")))
    bindings = {e: ("table_map", {"records_source": "s", "id_template": e + ":{k}", "attributes": ["k"]}) for e in ("a", "b")}
    graph = g.extract(g.SourceBundle([g.Source("s", shuffled, "table")]), spec, bindings, spark=spark)
    rows = {r["element_id"]: r["evidence"]["grounding"][0]["row"] for r in graph.evidence.where("attribute is null").collect()}
    assert len(rows) == 400 and all(rows[f"a:{k}"] == rows[f"b:{k}"] for k in range(200))


def test_ordinals_that_would_run_into_the_next_source(spark):
    texts = lambda n: g.SourceBundle([g.Source("s", spark.createDataFrame([(n, "a", "text")], "ordinal long, source_id string, text string"))]).texts(spark)
    assert texts((1 << 40) - 1).first()["ordinal"] == (1 << 40) - 1 and texts(None).first()["ordinal"] is None
    for n in (-1, 1 << 40):
        with pytest.raises(Exception, match="has an ordinal"):
            texts(n).collect()
