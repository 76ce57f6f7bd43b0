"""Personal data against the plain patterns."""

import hashlib
import re

import numpy as np
import pytest

from graphloom.llm import pii, queries
from pyspark.sql import functions as F

PATTERNS = {
    "email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+",
    "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)",
    "card": r"[0-9]([\x20-]?[0-9])+",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}


def luhn(digits):
    return sum(sum(divmod(int(d) * (1 + i % 2), 10)) for i, d in enumerate(reversed(digits))) % 10 == 0


def valid(kind, m):
    digits = re.sub("[^0-9]", "", m)
    return {"email": True, "ip": kind != "ip" or all(int(p) <= 255 for p in m.split(".")), "card": 14 <= len(digits) <= 19 and luhn(digits), "phone": 10 <= len(digits) <= 15}[kind]


def plain(text):
    found = [(m.start(), k, m.end()) for k, (kind, p) in enumerate(PATTERNS.items()) for m in re.finditer(p, text or "") if valid(kind, m[0])]
    return sorted(found)


def check(got, given):
    got = {r["doc_id"]: r for r in got}
    for i, text in given.items():
        spans = plain(text)
        said = [f"{pii.KINDS[k]}:{a}:{b}" for a, k, b in spans]
        assert got[i]["base_sha256"] == hashlib.sha256(",".join(said).encode()).hexdigest(), (text, spans)
        assert [got[i][f"n_{k}"] for k in pii.KINDS[:4]] == [sum(k == s[1] for s in spans) for k in range(4)]
        assert set(said) <= set(got[i]["spans"].split(","))  # base spans stay
    assert len(got) == len(given)


def test_all_documents(spark, sf):
    texts = {r["doc_id"]: r["text"] for r in spark.read.parquet(f"{sf}/documents.parquet").collect()}
    check([r.asDict() for r in queries.op9_pii(spark, sf).collect()], texts)


def contract(spark, tmp_path, given):
    spark.createDataFrame(list(given.items()), "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    return [r.asDict() for r in queries.op9_pii(spark, str(tmp_path)).collect()]


def test_hard_texts(spark, tmp_path, odd):
    hard = [
        "a@b.c@d.e x@y a@b.c_d@e.f %x@y.z a.b@c..d a@-.b é@é.fr ü.a@b-c.de.",
        "1.2.3.4.5.6.7.8 999.1.1.1 1.2..3.4.5.6 00000255.1.1.1 256.1.1.1 1.2.3 12.34.56.78.",
        "4111 1111 1111 1111, 4111-1111-1111-1111 4111  1111 1111 1111 41111111111111112 4111 1111 1111 1111 1 1",
        "+1 (555) 555-2028 +12 34 +1-234.567.8901- +1234567890123456 ++1 234 567 8901+1 234 567 8901",
        "\U0001f600 é a@b.cd \U0001f600+1 2345 678 901",
        "4" * 5000,
        "a" * 20000 + "@",
        "1 " * 5000,
        "1." * 5000,
        "+1" * 3000,
        "a@b" + ".c" * 5000,
    ]
    given = dict(enumerate([*hard, *(r["text"] for r in odd.collect())]))
    check(contract(spark, tmp_path, given), given)


@pytest.mark.parametrize("seed", range(2))
def test_random_texts(spark, tmp_path, seed):
    rng = np.random.default_rng(seed)
    given = {i: "".join(rng.choice(list("a@.+-1234 (é%\n"), 60)) for i in range(1200)} | {i: "".join(rng.choice(list("4 1-."), 40)) for i in range(1200, 2000)}
    check(contract(spark, tmp_path, given), given)


def redacted_spans(spark, texts):
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(3)
    got = {r["id"]: r for r in pii.personal_data(docs).collect()}
    return [[(pii.KINDS[s["kind"]], t[s["start"] : s["stop"]]) for s in got[i]["spans"] if s not in got[i]["base"]] for i, t in enumerate(texts)]


#: A proposal of each kind that is redacted, and one that is refused.
PROPOSALS = [
    ("email", "please contact anna.b[at]example.org today", "anna.b[at]example.org", "the rate a@b stays"),
    ("ip", "ping 10[.]0[.]12[.]7 again", "10[.]0[.]12[.]7", "see release 10.2.300.1 of it"),
    ("ip", "login from 2001:0db8:85a3:0000:0000:8a2e:0370:7334 failed", "2001:0db8:85a3:0000:0000:8a2e:0370:7334", "mac 00:1b:63:84:45:e6 here"),
    ("card", "visa 4111 1111 1111 1112 was charged", "4111 1111 1111 1112", "isbn 97800000000000048 there"),
    ("phone", "call (555) 123-4567 at noon", "(555) 123-4567", "order 555-123-4567 was sent"),
    ("secret", "so password=b7db7aa4a5fcc78305 it was", "password=b7db7aa4a5fcc78305", "the password: required here"),
    ("secret", "api_key = x81kd02mzqp7 in it", "api_key = x81kd02mzqp7", "commit 356a192b7913b04c54574d18c28d46e6395428ab of"),
]


def test_proposals_are_selected_and_refused(spark):
    texts = [t for _, yes, _, no in PROPOSALS for t in (yes, no)]
    got = redacted_spans(spark, texts)
    assert got[::2] == [[(kind, span)] for kind, _, span, _ in PROPOSALS] and got[1::2] == [[]] * len(PROPOSALS)
    assert redacted_spans(spark, [texts[0]]) == got[:1]  # alike in a table of one row


def test_long_secrets_are_whole(spark):
    """Maximal runs: nothing of a secret of any length stays behind."""
    hexes = "0123456789abcdef" * 30
    texts = [f"so password={hexes[:300]} it", f"the key {hexes[:160]} is", f"use sk-{hexes[:300]} now", f"mail {'a' * 300}.b[at]{'c' * 100}.org today"]
    assert redacted_spans(spark, texts) == [[("secret", f"password={hexes[:300]}")], [("secret", hexes[:160])], [("secret", f"sk-{hexes[:300]}")], [("email", f"{'a' * 300}.b[at]{'c' * 100}.org")]]


def test_failed_checks_need_a_cue(spark):
    """A number that fails Luhn is a card only where a word says so, in any of the languages."""
    bad = ["4111111111111112", "5500 0000 0000 0005", "6011000990139425", "378282246310006"]
    plainly = [f"{before} {n} {after}" for n in bad for before, after in [("the", "was"), ("le dossier", "est"), ("en la", "dos"), ("nach", "und"), ("then", ".")]]
    assert redacted_spans(spark, plainly) == [[]] * len(plainly)
    cued = ["pay by card 4111111111111112 now", "carte 4111 1111 1111 1112 et", "tarjeta 5500 0000 0000 0005 de", "kreditkarte 4111111111111112 und"]
    assert [[k for k, _ in found] for found in redacted_spans(spark, cued)] == [["card"]] * 4


def test_held_out_examples(spark):
    """Each kind has a threshold that holds on examples the trees have not seen."""
    model = pii.fit(spark)
    assert all(p >= pii.PRECISION for p in model.precision) and all(r >= 0.9 for r in model.recall) and all(np.isfinite(model.least))


def test_examples_are_the_same_everywhere(spark):
    rows = lambda: sorted(map(tuple, pii.examples(spark).collect()))
    assert rows() == rows() and len(rows()) == pii.EXAMPLES and {(r[1], r[2]) for r in rows()} == {(k, p) for k in range(5) for p in (True, False)}


def test_overlaps(spark):
    texts = ["visa 4111 1111 1111 1112 4111 1111 1111 1112", "password=x1y2@mail.example.com", "call 555-123-4567 555-123-4567"] + [" ".join(["password=b7db7aa4a5fc a@b.cd"] * 700)]
    got = redacted_spans(spark, texts)
    assert got[1] == [] and all(found[0][1] in t for t, found in zip(texts, got, strict=True) if found) and len(got[3]) == 700 and got[0] and got[2]
    docs = spark.createDataFrame([(0, texts[3])], "doc_id long, text string")
    one = pii.personal_data(docs).first()
    assert len(one["base"]) == 700 and len(one["spans"]) == 1400
    assert all(a["stop"] <= b["start"] for a, b in zip(one["spans"], one["spans"][1:], strict=False))
    assert pii.redacted(docs, pii.personal_data(docs)).first()["text"] == " ".join(["[secret] [email]"] * 700)


def test_repeated_rows_and_clashing_columns(spark):
    rows = [(1, "a@b.cd", "s", 5), (1, "a@b.cd", "s", 5), (None, "+1 234 567 8901", None, None), (None, None, "x", 1)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, spans string, id int").withColumns({"base": F.lit(1), "found": F.lit("f")})
    got = sorted(((r["id"], len(r["base"]), len(r["spans"])) for r in pii.personal_data(docs).collect()), key=repr)
    assert got == sorted([(1, 1, 1), (1, 1, 1), (None, 1, 1), (None, 0, 0)], key=repr)
    one = docs.where("spans = 's'").limit(1)
    made = pii.redacted(one.withColumn("_id", F.lit(2)), pii.personal_data(one))
    assert made.first()["text"] == "[email]" and made.columns == [*docs.columns, "_id"] and made.first()["spans"] == "s"


def test_nothing(spark, none):
    assert pii.personal_data(none).collect() == []


def test_redaction(spark):
    docs = spark.createDataFrame([(1, "é a@b.cd, 1.2.3.4!", "x"), (2, None, "y"), (3, "clean", "z")], "doc_id long, text string, n string")
    got = {r["doc_id"]: r["text"] for r in pii.redacted(docs, pii.personal_data(docs)).collect()}
    assert got == {1: "é [email], [ip]!", 2: None, 3: "clean"}
