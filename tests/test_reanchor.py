"""The longest common block in linear time, against ``difflib``."""

import difflib
import random
import time

import pytest

import graphloom as g
from graphloom.operators.trace import longest_block


@pytest.mark.parametrize("letters", ["ab", "abcé ", "abcdefghijklmnopqrstuvwxyz "])
def test_blocks_are_those_of_difflib(letters):
    draw = random.Random(len(letters))
    word = lambda n: "".join(draw.choice(letters) for _ in range(n))
    for n in range(600):
        text, quote = word(draw.randint(0, 60)), word(draw.randint(1, 250 if n % 10 == 0 else 25))
        block = difflib.SequenceMatcher(None, text, quote).find_longest_match()
        assert longest_block(text, quote)[1] == block.size and (not block.size or longest_block(text, quote) == (block.a, block.size)), (text, quote)


def test_a_long_text_takes_seconds():
    draw = random.Random(3)
    text = "".join(draw.choices("abcdefgh ", k=3_000_000)) + "the lost quotation stands here" + "".join(draw.choices("abcdefgh ", k=2_000_000))
    began = time.perf_counter()
    found = g.reanchor(g.TextQuoteSelector("the lost quotation stands THERE"), text)
    assert text[found.start : found.end] == "the lost quotation stands " and time.perf_counter() - began < 30


def test_occurrences_do_not_overlap():
    assert g.reanchor(g.TextQuoteSelector("aa", suffix="b"), "aaab") == g.TextPositionSelector(0, 2)
