"""JSON files read by ranges, against the whole document on the driver."""

import json
import random

import pytest

import graphloom as g
from graphloom.operators.context import ExtractionContext
from graphloom.operators.records import JsonQuery, select_path
from graphloom.sources.json_ranges import JsonFile, steps, walked


@pytest.fixture
def small_ranges(spark):
    """Splits of 240 bytes, each read by a task of its own."""
    settings = {"spark.sql.files.maxPartitionBytes": "240", "spark.sql.files.openCostInBytes": "0", "spark.sql.files.minPartitionNum": "1"}
    for k, v in settings.items():
        spark.conf.set(k, v)
    yield
    for k in settings:
        spark.conf.unset(k)


def value(draw, deep=0):
    words = ["a", "é,x", 'q"uote', "back\\slash", "\\", '\\"', "[", "]}", "{,", ":", "a,b", "long " * 40, ""]
    kind = draw.choice(["text", "number", "word", "list", "object"][: 5 if deep < 3 else 3])
    if kind == "text":
        return draw.choice(words)
    if kind == "number":
        return draw.choice([1, -2.5, 1e22, 0, True, False, None])
    if kind == "word":
        return draw.choice(words[:5])
    if kind == "list":
        return [value(draw, deep + 1) for _ in range(draw.randint(0, 4))]
    return {draw.choice(["k", "a,b", "n:m", 'w"', "items", "data"]): value(draw, deep + 1) for _ in range(draw.randint(0, 4))}


def document(seed):
    draw = random.Random(seed)
    items = [value(draw, draw.choice([0, 2])) for _ in range(40)]
    noise = lambda: {f"x{k}": value(draw) for k in range(draw.randint(0, 6))}
    return {**noise(), "data": {**noise(), "list,s": [[1, {"items": [0]}]], "items": items, **noise()}, **noise(), "items": 5}, items


def selected(spark, path, select):
    rows = JsonFile(spark, str(path)).rows(select)
    return None if rows is None else [json.loads(r["item"]) for r in rows.orderBy("_i", "_j").collect()]


@pytest.mark.parametrize("seed", range(3))
def test_items_below_keys(spark, tmp_path, small_ranges, seed):
    whole, items = document(seed)
    path = tmp_path / "d.json"
    path.write_text(json.dumps(whole, ensure_ascii=bool(seed % 2), indent=seed % 3 or None))
    for select in ("data.items", "data.items[*]", "data.items[7]", "data.items[-1]", "data.items[*].k"):
        got = [x for x in selected(spark, path, select) if x is not None]
        assert got == [x for x in walked(whole, steps(select)) if x is not None], select


@pytest.mark.parametrize("text", ["[]", " [ ] ", "[1]", '[{"a":1},{"a":[1,2]} , {"b,c":"x,y"}]', "[[1,2],[],[3]]", '["a,b","c\\\\","\\"",""]', '[null,{"a":null}]'])
def test_root_arrays(spark, tmp_path, text):
    path = tmp_path / "d.json"
    path.write_text(text)
    want = json.loads(text)
    assert selected(spark, path, None) == [x for x in want if x is not None] and selected(spark, path, "[*]") == [x for x in want if x is not None]
    assert selected(spark, path, "[*].a[*]") == walked(want, steps("[*].a[*]"))


def test_no_array_there(spark, tmp_path):
    path = tmp_path / "d.json"
    path.write_text('{"a": {"b": 1}, "c": [[1]]}')
    assert selected(spark, path, None) is None and selected(spark, path, "a.b[*]") is None and selected(spark, path, "a") is None and selected(spark, path, "c.d[*]") is None
    source = g.ingest(spark, str(path))
    assert source.content == {"a": {"b": 1}, "c": [[1]]} and source.content["c"] == [[1]] and len(source.content) == 2 and select_path(source.content, "a") == [{"b": 1}]


def test_a_key_that_a_range_cuts(spark, tmp_path, small_ranges):
    key = "the, key, has, many, commas"
    for shift in range(0, 120, 29):
        whole = {"pad": "p," * shift, key: {"in": [{"v": k} for k in range(30)]}, "z": [1]}
        path = tmp_path / f"d{shift}.json"
        path.write_text(json.dumps(whole))
        from graphloom.sources.json_ranges import array_items

        got = array_items(spark, str(path), [key, "in"])
        assert sorted((r["_i"], json.loads(r["text"])["v"]) for r in got.collect()) == [(k, k) for k in range(30)]


def test_strategy_over_a_file_and_over_the_value(spark, tmp_path, small_ranges):
    whole = {"meta": {"n": 3}, "rows": [{"id": f"r{k}", "n": k, "more": {"t": ["x", k]}} if k % 4 else k for k in range(60)]}
    path = tmp_path / "d.json"
    path.write_text(json.dumps(whole))

    def nodes(content, **more):
        context = ExtractionContext(spark, g.SourceBundle([g.Source("d", content, "json")]), g.GraphSpec())
        out = JsonQuery("d", type="row", id_from="id", attributes=["n", "more"], where={"n": {"$gt": 10}}, **more)(context)
        return sorted((r["id"], tuple(sorted(r["attributes"].items())), [x["expression"] for x in r["evidence"]["grounding"]]) for r in out.node_rows.collect())

    for select in ("rows", "rows[*]"):
        got = nodes(JsonFile(spark, str(path)), select=select)
        assert got == nodes(whole, select=select) and len(got) == 37
