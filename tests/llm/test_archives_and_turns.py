"""WARC round trips and preference pairs."""

import base64
import hashlib
import io

import pytest

from graphloom.llm import preferences, queries, warc


def archived(spark, tmp_path, pages, schema="page_id long, url string, html string"):
    folder = f"file://{tmp_path}/warc"
    files = warc.write(spark.createDataFrame(pages, schema).repartition(3), folder)
    return files, [tuple(r) for r in warc.read(files, folder).collect()]


def expected(pages):
    """One response for each payload: of the smallest id, nulls last; it does not matter which of repeated rows."""
    by = {}
    for page, _, html in pages:
        by.setdefault(html or "", []).append(page)
    out = []
    for html, own in by.items():
        payload = html.encode()
        about = (len(payload), base64.b32encode(hashlib.sha1(payload).digest()).decode())
        first, *rest = sorted(own, key=lambda p: (p is None, p or 0))
        out += [(first, *about, "response", None)] + [(p, *about, "revisit", first) for p in rest]
    return out


ODD_PAGES = [
    (5, "http://a/ b\r\nX: y", "<p>same</p>"),
    (3, None, "<p>same</p>"),
    (9, "http://é/", None),
    (8, "", ""),
    (-7, "u", "\r\n\r\nHTTP/1.1 \x00é\U0001f600"),
    (2**63 - 1, "u", "x" * 300_000),
    (-(2**63), "u", "WARC/1.1\r\n\r\n"),
    (None, "u", "alone"),
    (None, "u", "<p>same</p>"),
    (3, "again", "<p>same</p>"),
    (None, "u", "no id"),
    (None, "v", "no id"),
    (4, "u", "whole row"),
    (4, "u", "whole row"),
]


def test_round_trip_of_odd_pages(spark, tmp_path):
    _, got = archived(spark, tmp_path, ODD_PAGES)
    assert sorted(got, key=repr) == sorted(expected(ODD_PAGES), key=repr)


def test_dictionary_is_embedded_and_used(spark, tmp_path):
    import zstandard

    pages = [(i, f"http://h/{i}", "<html><head><title>" + hashlib.sha256(str(i).encode()).hexdigest() + "</title></head><body>the same words in all pages</body>" * 3) for i in range(3000)]
    files, got = archived(spark, tmp_path, pages)
    assert sorted(got) == sorted(expected(pages)) and sum(r["records"] for r in files.collect()) == 3000
    for r in files.collect():
        data = open(r["path"], "rb").read()
        assert int.from_bytes(data[:4], "little") == warc.SKIPPABLE
        n = int.from_bytes(data[4:8], "little")
        known = zstandard.ZstdCompressionDict(zstandard.ZstdDecompressor().decompress(data[8 : 8 + n]))
        one = zstandard.ZstdDecompressor(dict_data=known).decompressobj()
        assert one.decompress(data[8 + n :]).startswith(b"WARC/1.1\r\nWARC-Type: warcinfo") and one.unused_data  # a frame for each record
        assert zstandard.get_frame_parameters(one.unused_data).dict_id == known.dict_id()


def test_broken_archives_are_refused(spark, tmp_path):
    files, _ = archived(spark, tmp_path, ODD_PAGES)
    data = open(files.first()["path"], "rb").read()
    with pytest.raises(ValueError):
        list(warc.records(io.BytesIO(data[:-5])))


def test_no_pages(spark, tmp_path):
    assert archived(spark, tmp_path, [])[1] == []


def test_clashing_columns(spark, tmp_path):
    rows = [(1, "u", "a", "x", 3), (2, "u", "a", "x", 3)]
    assert len(archived(spark, tmp_path, rows, "page_id long, url string, html string, sha string, low int")[1]) == 2


def test_record_ids():
    for page in (0, 1, -1, 2**63 - 1, -(2**63), 123456789, None):
        assert warc.page_of(warc.record_id(page, 5)) == page
    assert len({warc.record_id(p, r) for p in (None, 0, 7) for r in (0, 1, 1 << 33, (1 << 33) + 1, 123 << 33)}) == 15


def test_ids_of_records_are_unique(spark, tmp_path):
    files, _ = archived(spark, tmp_path, ODD_PAGES)
    found, referred = [], set()
    for r in files.collect():
        with open(r["path"], "rb") as file:
            for headers, _ in warc.records(file):
                found.append(headers["WARC-Record-ID"])
                referred |= {headers["WARC-Refers-To"]} if "WARC-Refers-To" in headers else set()
    assert len(found) == len(set(found)) == len(ODD_PAGES) + files.count() and referred <= set(found)


def test_a_dictionary_of_few_records_is_their_bytes(spark, tmp_path):
    files, got = archived(spark, tmp_path, ODD_PAGES[:2])
    assert len(got) == 2 and all(open(r["path"], "rb").read(4) == warc.SKIPPABLE.to_bytes(4, "little") for r in files.collect())


def test_training_takes_records_from_everywhere(spark, tmp_path, monkeypatch):
    """Records from all of a task's input teach, not the ones that come first."""
    monkeypatch.setattr(warc, "TRAIN_BYTES", 100_000)
    pages = [(i, "u", hashlib.sha256(str(i).encode()).hexdigest() * 20) for i in range(2000)]
    files, got = archived(spark, tmp_path, pages)
    assert sorted(got, key=repr) == sorted(expected(pages), key=repr) and files.count() == 4


# preferences ------------------------------------------------------------------


def pairs(spark, rows):
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").repartition(3)
    from pyspark.sql import functions as F

    return preferences.segments(df, F.expr("shiftright(conv_id, 1)"), F.pmod(F.col("conv_id"), F.lit(2)) == 0)


def test_shared_prompt_is_rendered_once(spark):
    turns = [("system", "s"), ("user", "hi <|im_end|>"), ("assistant", "same"), ("user", "more")]
    rows = [(c, i, r, t) for c in (0, 1) for i, (r, t) in enumerate(turns)] + [(0, 4, "assistant", "good"), (1, 4, "assistant", "bad"), (1, 5, "user", "why")]
    made = pairs(spark, rows)
    one = preferences.paired(made).collect()
    assert len(one) == 1
    one = one[0]
    head = "".join(f"<|im_start|>{r}\n{t.replace('<|im_end|>', '<|im_end |>')}<|im_end|>\n" for r, t in turns)
    assert one["prompt"] == head
    assert [one["chosen"][s["start"] : s["stop"]] for s in one["chosen_mask"]] == ["good<|im_end|>"]
    assert [one["rejected"][s["start"] : s["stop"]] for s in one["rejected_mask"]] == ["bad<|im_end|>"]
    assert {r["n_prompt"] for r in made.collect()} == {4}
    assert all(r["mask_start"] == r["mask_stop"] == 0 for r in made.collect() if r["part"] == "prompt")


def test_odd_turns(spark):
    rows = [(0, 0, "user", "a"), (0, 0, "user", "b"), (1, 0, "user", "b"), (1, 0, "user", "a"), (0, 1, None, None), (1, 1, None, ""), (0, None, "assistant", "x")]  # ties, nulls
    rows += [(2, 0, "user", "only chosen"), (5, 3, "user", "only rejected"), (None, 0, "user", "no pair"), (6, 0, "u", "t"), (7, 0, "u", "t"), (8, 0, "u", "t"), (8, 0, "u", "t"), (9, 0, "u", "t")]
    got = sorted(((r["pair_id"], r["part"], r["turn"], r["n_prompt"]) for r in pairs(spark, rows).collect()), key=repr)
    want = [(0, "prompt", 0, 3)] * 2 + [(0, "prompt", 1, 3), (0, "chosen", None, 3), (1, "chosen", 0, 0), (2, "rejected", 3, 0), (None, "rejected", 0, 0), (3, "prompt", 0, 1)] + [(4, "chosen", 0, 0)] * 2 + [(4, "rejected", 0, 0)]
    assert got == sorted(want, key=repr)
    assert pairs(spark, []).collect() == []


def test_turn_numbers_may_be_large_and_bags_are_compared_row_by_row(spark):
    last = 2**31 - 1
    rows = [(0, last, "user", "a"), (1, last, "user", "a"), (0, 2**40, "user", "b"), (1, 2**40, "user", "b"), (0, None, "assistant", "x"), (1, None, "assistant", "y")]
    rows += [(c, 0, "user", t) for c, ts in ((2, "aabd"), (3, "abbd")) for t in ts]  # as many rows, the same smallest and largest
    made = pairs(spark, rows)
    assert sorted((r["pair_id"], r["part"], r["turn"]) for r in made.where("pair_id = 0").collect() if r["turn"]) == [(0, "prompt", last), (0, "prompt", 2**40)]
    assert {r["part"] for r in made.where("pair_id = 1").collect()} == {"chosen", "rejected"}
    got = {(r["pair_id"], r["block"]): r for r in preferences.paired(made).collect()}
    assert set(got) == {(0, last // 1000), (0, 2**40 // 1000), (0, None), (1, 0)} and "x<|im_end|>" in got[0, None]["chosen"] and "y<|im_end|>" in got[0, None]["rejected"]


def test_long_and_clashing_conversations(spark):
    from pyspark.sql import functions as F

    rows = [(c, i, "assistant", f"{c} {i} " + "word " * (20_000 if i == 2000 else 1), "clash", 7) for c in (0, 1) for i in range(2500)]
    df = spark.createDataFrame(rows, "conv_id long, turn int, role string, text string, part string, pair_id int").repartition(3)
    got = {r["block"]: r for r in preferences.paired(preferences.segments(df, F.expr("shiftright(conv_id, 1)"), F.col("conv_id") == 0)).collect()}
    assert set(got) == {0, 1, 2} and [len(got[k]["chosen_mask"]) for k in range(3)] == [1000, 1000, 500]
    assert all(r["chosen"][s["start"] : s["stop"]].endswith("<|im_end|>") for r in got.values() for s in r["chosen_mask"])


def test_all_conversations_are_paired(spark, sf):
    rows = [tuple(r) for r in spark.read.parquet(f"{sf}/conversations.parquet").select("conv_id", "turn", "role", "text").collect()]
    by = {}
    for c, t, r, x in rows:
        by.setdefault(c, {})[t] = (r, x)
    show = lambda side, turns: "".join(f"<|im_start|>{side[t][0]}\n{side[t][1]}<|im_end|>\n" for t in sorted(turns))
    want = {}
    for k in {c >> 1 for c in by}:
        a, b = by.get(2 * k, {}), by.get(2 * k + 1, {})
        first = min((t for t in a.keys() | b.keys() if a.get(t) != b.get(t)), default=10**9)
        want[k] = (show(a, [t for t in a if t < first]), show(a, [t for t in a if t >= first]), show(b, [t for t in b if t >= first]))
    assert {r["pair_id"]: (r["prompt"], r["chosen"], r["rejected"]) for r in queries.op2_preference_formatting(spark, sf).collect()} == want
