"""Personal data in any script, and persons of a document."""

import re

import pytest

from uttermark.llm import pii

KEY = b"key"
SCRIPTS = [
    "νίκος@αθήνα.ελ", "联系我@小明.公司", "محمد@موقع.شبكة", "たろう@さくら.jp", "홍길동@서울.한국",
    "ßµ@x.de", "josé.şahin@ığdır.com", "１２３-４５-６７８９", "١٢٣-٤٥-٦٧٨٩", "+٤٩ ٣٠ ١٢٣٤٥٦٧",
    "४१११ ११११ ११११ ११११", "___@_.com",
]


@pytest.mark.parametrize("raw", SCRIPTS)
def test_entities_of_any_script_change_wholly(raw):
    (start, stop, kind, value), = pii.mentions(raw)
    assert (start, stop) == (0, len(raw))
    made = pii.surrogate(KEY, kind, value, 3)
    shown = pii.render(raw, kind, made)
    assert made != value and shown != raw
    assert [(k, v) for *_, k, v in pii.mentions(shown)] == [(kind, made)]
    local = raw.split("@")[0]
    if len(local) > 3 and any(map(str.isalnum, local)):
        same = sum(a == b for a, b in zip(local, shown) if a.isalnum())
        assert same < len(local) / 2


def test_alphabets_are_classes():
    for c in "αΩ小あア한مß㐀º१𝐀ⅷ":
        letters = pii.alphabet(c)
        assert c in letters and len(letters) > 1
        assert all(pii.alphabet(x) == letters for x in letters[:300])
        assert all(re.match(r"\w", x) for x in letters)


def test_full_and_unchangeable_forms_end(spark):
    rows = [(1, "联系我@小明.公司 νίκος@αθήνα.ελ ___@_.com ١٢٣-٤٥-٦٧٨٩ and 123-45-6789")]
    # All strings of a form are entities: whatever is drawn in it is taken.
    rows += [(10 + i, f"{a}@{b}.com") for i, (a, b) in enumerate((a, b) for a in "0123456789" for b in "0123456789")]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string")
    got = {r.doc_id: r for r in pii.with_surrogates(docs, "key").collect()}
    before = dict(rows)
    assert all(set(got[d].text.split()) & set(before[d].split()) <= {"and"} for d in before)
    assert got[1].n_entities == 5 and len({got[d].text for d in got}) == len(rows)
    *_, arabic, _, latin = got[1].text.split()
    assert pii._digits(arabic) == pii._digits(latin)


def test_mentions_of_a_person_are_linked(spark):
    rows = [
        (1, "Dr. Maria Lopez came. Maria Lopez sat; Lopez's hat, MARIA LOPEZ, Ms. Lopez and Maria left. Lopezia too."),
        (2, "Mr. John Smith and Mr. Smith and Dr. John Smith met Mrs. Anna Smith, not Smith."),
        (3, "Dr. John Smith again, and lopez or Maria Lopez elsewhere."),
        (4, "Prof. Ann Mary Stone. Ann Stone wrote."),
    ]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string")
    got = {r.doc_id: r.text for r in pii.with_surrogates(docs, "key").collect()}
    given, family = re.match(r"Dr\. (\S+) (\S+) came", got[1]).groups()
    assert given in pii.GIVEN["latin", "f"] and "Lopez" not in (given, family)
    assert got[1] == (
        f"Dr. {given} {family} came. {given} {family} sat; {family}'s hat, {given.upper()} {family.upper()}, "
        f"Ms. {family} and {given} left. Lopezia too."
    )
    john, smith = re.match(r"Mr\. (\S+) (\S+) and", got[2]).groups()
    assert john in pii.GIVEN["latin", "m"]
    assert got[2].startswith(f"Mr. {john} {smith} and Mr. {smith} and Dr. {john} {smith} met Mrs. ")
    # Two persons are called Smith, so the bare name is neither's, but not in clear.
    assert re.search(r", not (?!Smith)[\w\-]+\.$", got[2])
    assert got[3] == f"Dr. {john} {smith} again, and lopez or Maria Lopez elsewhere."
    ann, _, stone = re.match(r"Prof\. (\S+) (\S+) (\S+)\. ", got[4]).groups()
    assert got[4].endswith(f". {ann} {stone} wrote.")
