"""Quotes of every match in a text, against brute force."""

import re

import graphloom as g
from graphloom import queries

LONG = " ".join(f"word{i} to p{i % 7}.name@host{i % 5}.org, then" for i in range(60))
TEXTS = {
    1: "First ann@x.org, then bob@y.org and ann@x.org again; write to someone.else@long-host.example.com!",
    2: LONG,
    3: "none here",
    4: None,
    5: "é \U0001f600 q@r.st q@r.st q@r.st",
}


def matches():
    for i, text in TEXTS.items():
        for m, found in enumerate(re.finditer(queries.EMAIL, text or "")):
            a, b = found.span()
            yield i, m, found[0], text[max(0, a - 24) : a], text[b : b + 24], a


def written(spark, tmp_path):
    spark.createDataFrame(list(TEXTS.items()), "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    return str(tmp_path)


def test_context_of_every_match(spark, tmp_path):
    got = sorted(map(tuple, queries.quote_context(spark, written(spark, tmp_path)).collect()))
    assert got == sorted(x[:5] for x in matches()) and len(got) == 67


def test_every_match_is_reanchored(spark, tmp_path):
    want = []
    for i, m, exact, prefix, suffix, start in matches():
        text = "Moved. " + TEXTS[i].replace(exact, exact[:12] + "?")
        found = g.reanchor(g.TextQuoteSelector(exact, prefix, suffix), text, start)
        want.append((str(i), m, exact, found and found.start, found and found.end))
    got = sorted(map(tuple, queries.reanchor_emails(spark, written(spark, tmp_path)).collect()), key=lambda r: r[:2])
    assert got == sorted(want, key=lambda r: r[:2]) and len(got) == 67
