"""Block matching against the standard library's matcher, and how it grows."""

import random
import time
import unicodedata
from difflib import SequenceMatcher

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from cuewright.functions.matching import differences, edit_distance, longest_by_automaton, longest_by_sets, matched, ratio
from cuewright.functions.unicode import comparison_form, similarity


def theirs(a, b):
    return SequenceMatcher(None, a, b, autojunk=False)


@settings(max_examples=400, deadline=None)
@given(st.text("ab ", max_size=40), st.text("ab ", max_size=40))
def test_longest_blocks(a, b):
    want = tuple(theirs(a, b).find_longest_match(0, len(a), 0, len(b)))
    assert longest_by_sets(a, b) == longest_by_automaton(a, b) == want


@settings(max_examples=400, deadline=None)
@given(st.lists(st.integers(0, 3), max_size=60), st.lists(st.integers(0, 3), max_size=60), st.sampled_from([0, 30, 1 << 24]))
def test_matched_lengths(a, b, bits):
    assert matched(a, b, bits) == sum(m.size for m in theirs(a, b).get_matching_blocks())


@pytest.mark.parametrize("seed", range(6))
def test_ratio_of_edited_prose(seed):
    rng = random.Random(seed)
    a = " ".join("".join(rng.choice("etaoins") for _ in range(rng.randrange(1, 7))) for _ in range(120))
    b = "".join(c for c in a if rng.random() > 0.05 * seed) + a[: 40 * seed]
    assert ratio(a, b) == pytest.approx(theirs(a, b).ratio(), abs=1e-12)
    assert ratio(a.split(), b.split()) == pytest.approx(theirs(a.split(), b.split()).ratio(), abs=1e-12)


@settings(max_examples=300, deadline=None)
@given(st.text(max_size=30))
def test_comparison_form_by_code_point(text):
    plain = "".join(c for c in unicodedata.normalize("NFKD", text) if unicodedata.category(c) != "Mn").casefold()
    assert comparison_form(text) == " ".join("".join(c if c.isalnum() else " " for c in plain).split())


def test_similarity_of_empty_and_equal_texts():
    assert similarity("", "") == similarity("—", "...") == 1.0
    assert similarity("", "a") == 0.0
    assert similarity("Café, NOIR", "cafe noir") == 1.0


def test_long_texts_take_linear_time():
    rng = random.Random(1)
    words = ["".join(rng.choice("abcdefgh") for _ in range(6)) for _ in range(30_000)]
    a = " ".join(words)
    b = " ".join(w for i, w in enumerate(words) if i % 10_000)
    began = time.perf_counter()
    assert ratio(a, b) > 0.99
    assert time.perf_counter() - began < 30


@settings(max_examples=400, deadline=None)
@given(st.lists(st.integers(0, 4), max_size=90), st.lists(st.integers(0, 4), max_size=90))
def test_edit_distance(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        new = [i]
        for j, y in enumerate(b, 1):
            new.append(min(new[-1] + 1, row[j] + 1, row[j - 1] + (x != y)))
        row = new
    assert edit_distance(a, b) == row[-1]


@settings(max_examples=300, deadline=None)
@given(st.lists(st.integers(0, 3), max_size=50), st.lists(st.integers(0, 3), max_size=50))
def test_differences(a, b):
    assert differences(a, b) == [op for op in theirs(a, b).get_opcodes() if op[0] != "equal"]
