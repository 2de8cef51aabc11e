"""Names behind titles: chains, initials, particles, capitals of any script."""

import re
import time

import pytest

from uttermark.llm import pii


@pytest.mark.parametrize(
    "text,want",
    [
        ("Prof. Dr. Hans Meier und", [("name:", "Hans Meier")]),
        ("Frau Prof. Dr. Müller kam", [("name:f", "Müller")]),
        ("Mr. J. Smith left", [("name:m", "J. Smith")]),
        ("Mr. J.R. Van der Berg left", [("name:m", "J.R. Van Der Berg")]),
        ("Mr. Łukasz Żak, Mr. Škoda", [("name:m", "Łukasz Żak"), ("name:m", "Škoda")]),
        ("Mr. Γιώργος Σεφέρης.", [("name:m", "Γιώργος Σεφέρης")]),
        ("Mr Smith and Dr Jones met", [("name:m", "Smith"), ("name:", "Jones")]),
        ("Mr. Van der Berg", [("name:m", "Van Der Berg")]),
        ("Herr von Weizsäcker", [("name:m", "Von Weizsäcker")]),
        ("Mr. Smith Mrs. Jones", [("name:m", "Smith"), ("name:f", "Jones")]),
        ("Dr. O'Brien's hat", [("name:", "O'Brien")]),
        ("ms Word, MS Word, the Dr is in. Mrs nobody", []),
    ],
)
def test_whole_names_are_found(text, want):
    assert [(k, v) for _, _, k, v in pii.mentions(text)] == want


def test_no_word_of_a_name_stays(spark):
    rows = [
        (1, "Prof. Dr. Hans Meier und Hans Meier"),
        (2, "Mr. Van der Berg and Van der Berg"),
        (3, "Mr. J. Smith, Mr. John Smith"),
        (4, "Mr. Łukasz Żak met Łukasz Żak"),
    ]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string")
    got = {r.doc_id: r.text for r in pii.with_surrogates(docs, "key").collect()}
    name = re.fullmatch(r"Prof\. Dr\. (\S+ \S+) und \1", got[1])
    assert name and not {"Hans", "Meier"} & set(name.group(1).split())
    assert re.fullmatch(r"Mr\. Van der (?!Berg)(\S+) and Van der \1", got[2])
    parts = re.fullmatch(r"Mr\. (\w)\. (?!Smith)(\S+), Mr\. (\w+) \2", got[3])
    assert parts and parts.group(3).startswith(parts.group(1))
    assert re.fullmatch(r"Mr\. (\S+ \S+) met \1", got[4]) and not re.search("Łukasz|Żak", got[4])


def test_many_names_in_a_long_text_take_time_by_their_number():
    letters = "abcdefghijklmnopqrstuvwxyz"
    name = lambda i: "Q" + "".join(letters[i // 26**k % 26] for k in range(4))
    text = " ".join(f"Mr. {name(i)} {name(i + 50_000)} spoke." for i in range(20_000))
    start = time.time()
    assert len(pii.linked(text)) == 20_000
    assert time.time() - start < 30


def brute(text):
    """(start, end) of titled names by a plain walk over words, for ASCII names of words."""
    words = [(m.start(), m.group()) for m in re.finditer(r"\S+", text)]
    out, i = [], 0
    while i < len(words):
        j = i
        while j < len(words) and words[j][1].strip(".").lower() in pii.TITLES and words[j][1].endswith("."):
            j += 1
        k = j
        while j > i and k < len(words) and k < j + 3 and re.fullmatch("[A-Z][a-z]+", words[k][1]):
            k += 1
        if k > j:
            out.append((words[i][0], words[k - 1][0] + len(words[k - 1][1])))
        i = max(k, i + 1)
    return out


def test_equals_a_walk_over_words():
    import random

    rng = random.Random(2)
    for _ in range(300):
        text = " ".join(rng.choices(["Mr.", "Dr.", "Prof.", "John", "Smith", "Ann", "the", "x", "met"], k=30))
        assert [(a, b) for a, b, _, _ in pii.mentions(text)] == brute(text)
