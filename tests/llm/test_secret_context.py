"""What stands around a candidate, in the whole text."""

import pytest

from uttermark.llm import secrets

KEY = "wJalrXUtnFEMIK7MDENGbPxRfiCYEXAMPLEKEY12"
TEXTS = [
    f"AWS_SECRET_ACCESS_KEY={KEY}",
    f'stripe_secret_key = "{KEY}"',
    f"export DATABASE_PASSWORD_OF_PRODUCTION='{KEY}' # rotate",
    f'{{"github_access_token":"{KEY}"}}',
    f'GITHUB_ACCESS_TOKEN="{KEY}" x',
    f"config:\n  production_api_key: {KEY}\n",
]


def rows_of(spark, texts):
    docs = spark.createDataFrame([(i, t, "a/b") for i, t in enumerate(texts)], "doc_id int, text string, path string")
    return docs, secrets.findings(docs)


def test_long_names_are_seen_in_front(spark):
    docs, found = rows_of(spark, TEXTS)
    got = secrets.featured(found, docs).withColumn("label", secrets.label_by_rule())
    keys = [r for r in got.collect() if r.candidate == KEY]
    assert len(keys) == len(TEXTS)
    assert all(r.word_for and r.assigned and r.label == 1 for r in keys)
    assert all(r.quoted == (TEXTS[r.doc_id].split(KEY)[0][-1] in "\"'") for r in keys)


def test_around_is_cut_from_the_whole_text(spark):
    run = "é ".join(f"candidate{i:08d}" for i in range(30))
    texts = [*TEXTS, run, "x" * 500 + " " + run + " end of it", f"{KEY} is our access token", None, ""]
    _, found = rows_of(spark, texts)
    got = found.collect()
    assert {r.doc_id for r in got} == set(range(len(texts) - 2))
    for r in got:
        text, stop = texts[r.doc_id], r.start + len(r.candidate)
        assert text[r.start : stop] == r.candidate
        assert r.before == text[max(0, r.start - secrets.AROUND) : r.start]
        assert r.after == text[stop : stop + secrets.AROUND]


def test_words_behind_speak_too(spark):
    docs, found = rows_of(spark, [f"{KEY} is our token", f"{KEY} (commit)"])
    got = {r.doc_id: r for r in secrets.featured(found, docs).collect()}
    assert (got[0].behind_for, got[0].behind_against) == (1, 0)
    assert (got[1].behind_for, got[1].behind_against) == (0, 1)


@pytest.mark.parametrize(
    "text,want",
    [
        ("LONG_NAME_OF_A_KEY=abc", ["LONG_NAME_OF_A_KEY", "abc"]),
        ('LONG_NAME_OF_A_KEY="abc"', ["LONG_NAME_OF_A_KEY", "abc"]),
        ('password = "hunter2secret"', ["hunter2secret"]),
        ("password=Tr0ub4dor&3xx!correct-horse", ["Tr0ub4dor&3xx!correct-horse"]),
        ("db_password: hunter2, note: nothing", ["hunter2"]),
        ('{"api_key": "a", "x":"b"}', ["a", "b"]),
        (f"https://x.y/?page=1&token={KEY}&x", ["1", KEY + "&x"]),
        ("a == b; a => b and a: b 'quoted' \"text\"", []),
        ("x=1 y=2", ["1", "2"]),
        (f'a = "{KEY}==", b', [KEY + "=="]),
        (f"a: {KEY}=\n", [KEY + "="]),
        (f"LONG_NAME_OF_A_KEY={KEY}==", ["LONG_NAME_OF_A_KEY", KEY + "=="]),
    ],
)
def test_equals_signs_are_padding_or_assignments(spark, text, want):
    _, found = rows_of(spark, [text])
    assert [r.candidate for r in found.orderBy("start").collect()] == want


def test_many_short_values_keep_their_surroundings(spark):
    text = " ".join(f"k{i}={i}" for i in range(3000)) + " password='x'" + " é" * 50_000
    docs, found = rows_of(spark, [text])
    got = secrets.featured(found, docs).collect()
    assert len(got) == 3001
    for r in got:
        stop = r.start + len(r.candidate)
        assert text[r.start : stop] == r.candidate
        assert (r.before, r.after) == (text[max(0, r.start - 64) : r.start], text[stop : stop + 64])
    assert next(r for r in got if r.candidate == "x").word_for == 1
