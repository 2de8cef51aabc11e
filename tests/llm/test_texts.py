"""Language, main text, personal data and secrets."""

import math
import random
import re

import pytest
from pyspark.sql import functions as F

from uttermark.llm import pii, secrets
from uttermark.llm.htmltext import Page, importance, main_text
from uttermark.llm.langid import held_out, identify, learn

SF = "/root/testdata/sf0.01"


# ------------------------------------------------------------- language


def test_held_out_accuracy_of_languages(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    known = learn(docs, ~held_out())
    assert known[0][0] == "en" and len(known) == 4
    rows = identify(docs.filter(held_out()).drop("source"), known).collect()
    assert sum(r.lang == r.lang_pred for r in rows) / len(rows) > 0.97
    assert all(0 <= r.score <= 1 for r in rows)
    assert sum(r.rejected for r in rows) / len(rows) < 0.02


def test_odd_texts_and_tables_without_languages(spark):
    texts = [None, "", "12 %% 3", "the and of " * 20000, "la casa de los niños", "la casa de los niños"]
    docs = spark.createDataFrame(
        [(i, t, "en" if i == 3 else "es" if i > 3 else None, 1) for i, t in enumerate(texts)],
        "doc_id bigint, text string, lang string, score int",
    )
    known = learn(docs, F.lit(True))
    got = {r.doc_id: r for r in identify(docs, known).collect()}
    assert [got[i].lang_pred for i in range(6)] == ["und"] * 3 + ["en", "es", "es"]
    assert got[0].rejected and got[0].score == 0 and got[4][4:] == got[5][4:]
    assert learn(docs.limit(0), F.lit(True)) == []
    assert {r.lang_pred for r in identify(docs, []).collect()} == {"und"}
    assert identify(docs.limit(0), known).count() == 0


# ------------------------------------------------------------ main text


def test_blocks_of_broken_pages():
    html = (
        "<!doctype html><head><title>t</title></head><body><header><h1>Site</h1></header>"
        "<div class='cookie-banner'>ok?</div><article><header><h1>T &amp; x</h1></header>"
        "<p><b>a<br><p>c\n\t d&nbsp;e<ul><li>q<li>r</ul><div id=comments><p>no</div>"
        "<aside>z</aside><script>if (a</b) {}</script><form>f</form></article>"
        "<footer>&copy;</footer><p hidden>h</p><p>out &am"
    )
    assert Page(html).text() == "T & x\na\nc d e\nq\nr\nout &am"
    assert [Page(h).text() for h in ("", "<", "<p", "x", "<script>x", "</p>y")] == ["", "<", "", "x", "", "y"]


def test_repeated_branches_of_a_host_go_and_articles_stay(spark):
    rng = random.Random(1)
    words = lambda k: " ".join(rng.choices(["ab", "cd", "ef", "gh", "ij"], k=k))
    rows = []
    for i in range(20):
        own = words(30)
        rows.append(
            (i, f"https://Soup.example/{i}", f"<div class=top><div>Same top</div></div><div class=b><p>{own}</p></div><div class=low>Low {i % 2}</div>", own)
        )
    rows += [(100 + i, "https://twins.example/", "<article><p>twin</p></article>", "twin") for i in range(8)]
    rows += [(200, None, "<p>lone</p>", "lone"), (201, "", None, ""), (201, "", None, ""), (None, "x", "", "")]
    pages = spark.createDataFrame(rows, "page_id bigint, url string, html string, removed string")
    got = main_text(pages).collect()
    want = {r[0]: r[3] for r in rows}
    assert {r.page_id: r.text for r in got} == want and len(got) == len(rows)
    assert all(r.n_chars == len(r.text) for r in got)
    assert main_text(pages.limit(0)).count() == 0


def test_importance_is_normalized_entropy(spark):
    rows = [("h", 1, 0, t, 1, 1) for t in (1, 1, 2, 3)] + [("h", 2, 0, 9, 1, 1)] * 4
    nodes = spark.createDataFrame(
        rows, "host string, node bigint, kind int, shown bigint, size bigint, first bigint"
    )
    got = {r.node: r.own for r in importance(nodes).collect()}
    assert math.isclose(got[1], 1 - (math.log(2) / 3) / math.log(4)) and math.isclose(got[2], 0, abs_tol=1e-12)


# -------------------------------------------------------- personal data

KEY = b"key"


@pytest.mark.parametrize(
    "kind,value",
    [("ip", "10.1.2.3"), ("ip", "8.8.8.8"), ("number", "4111111111111111"), ("email", "a.b9@x-y.example.org"),
     ("phone", "+14875557209"), ("key", "ab" * 20), ("iban", "DE89370400440532013000"), ("ssn", "123456789")],
)
def test_surrogates_keep_type_and_format(kind, value):
    made = pii.surrogate(KEY, kind, value, 0)
    assert made != value and made == pii.surrogate(KEY, kind, value, 0)
    assert made != pii.surrogate(b"other", kind, value, 0)
    raw = value if kind != "ssn" else "123-45-6789"
    found = pii.mentions(f"see {pii.render(raw, kind, made)} now")
    assert [(k, v) for _, _, k, v in found] == [(kind, made)]
    if kind == "ip":
        assert pii._reach(made) == pii._reach(value)
    if kind == "number":
        assert pii._luhn(made[:-1]) == int(made[-1])


def test_permutation_is_one_to_one():
    for size in (1, 2, 10, 97, 1000):
        assert sorted(pii.permute(KEY, "t", i, size) for i in range(size)) == list(range(size))


def test_names_keep_gender_script_and_case():
    found = pii.mentions("Mrs. Anna Schmidt met HERR KLAUS WEBER and г-н Иван Петров; the Sran stays.")
    assert [k for _, _, k, _ in found] == ["name:f", "name:m", "name:m"]
    made = [pii.surrogate(KEY, k, v, 0) for _, _, k, v in found]
    assert made[0].split()[0] in pii.GIVEN["latin", "f"] and made[1].split()[0] in pii.GIVEN["latin", "m"]
    assert made[2].split()[0] in pii.GIVEN["cyrillic", "m"]
    assert pii.render("HERR KLAUS WEBER", "name:m", made[1]) == "HERR " + made[1].upper()


def test_documents_get_consistent_distinct_surrogates(spark):
    people = [f"Mr. {g} {f}" for g in "Ivo Kai Leo Max Ned".split() for f in "Uhl Voss Wood Xu Yorke Zorn".split()]
    rows = [(i, f"{p} wrote from p{i}@mail.example.com (10.0.0.{i})", "k") for i, p in enumerate(people)]
    rows += [(90, people[0] + " again, P0@MAIL.EXAMPLE.COM and 4.0. +1 (843) 555-7672 170.106.47.218", "k")] * 2
    rows += [(91, None, "k"), (92, "", "k"), (None, "clean text 2.0", "k"), (93, "10.0.0.1 " * 3000, "k")]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string, n_entities string")
    got = pii.with_surrogates(docs, "key").collect()
    assert len(got) == len(rows)
    text = {r.doc_id: r.text for r in got}
    assert text[91] is None and text[92] == "" and text[None] == "clean text 2.0"
    names = [re.match(r"Mr\. (.*) wrote", text[i]).group(1) for i in range(len(people))]
    assert len(set(names)) == len(people) and not set(names) & {p[4:] for p in people}
    mails = [re.search(r"\S+@\S+", text[i]).group() for i in range(len(people))]
    assert len(set(mails)) == len(people)
    assert text[90].startswith(f"Mr. {names[0]} again, {mails[0].upper()} and 4.0. +1 (")
    assert text[93] == (re.search(r"\((\S+)\)", text[1]).group(1) + " ") * 3000
    assert pii.with_surrogates(docs.limit(0), "key").count() == 0


# -------------------------------------------------------------- secrets


def keys(seed, n):
    rng = random.Random(seed)
    return ["".join(rng.choices("0123456789abcdef", k=40)) for _ in range(n)]


def test_forest_tells_held_out_secrets_from_words_and_digests(spark):
    words = "information international responsibility configuration understanding administrator".split()
    rng, rows, labels = random.Random(3), [], []
    for i, key in enumerate(keys(1, 120)):
        word = "".join(rng.sample(words, 2))
        text = f'some text {word} here é token = "{key}" then commit {keys(i + 50, 1)[0]} and 1234567890123456.'
        rows.append((i, text, "src/app/main.py" if i % 2 else None))
        for wanted, label in ((key, 1), (word, 0), ("1234567890123456", 0)):
            labels.append((i, text.index(wanted), label))
        labels.append((i, text.index("commit ") + 7, 0))
    rows += [(500, None, None), (501, "", "x"), (502, "plain", "x")]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string, path string")
    marks = spark.createDataFrame(labels, "doc_id bigint, start bigint, label int")
    got = secrets.scan(docs, marks.filter("doc_id % 2 = 0")).collect()
    want = {(d, s): v for d, s, v in labels}
    assert len(got) == len(labels)
    held = [r for r in got if r.doc_id % 2]
    assert sum(r.is_secret == bool(want[r.doc_id, r.start]) for r in held) / len(held) > 0.97
    assert all(dict((d, t) for d, t, _ in rows)[r.doc_id][r.start :][: r.length] == r.candidate for r in got)


def test_scan_without_both_labels_repeats_and_empty_tables(spark):
    rows = [(1, 'api_key: "' + keys(9, 1)[0] + '"', 5)] * 2
    docs = spark.createDataFrame(rows, "doc_id bigint, text string, score int").withColumn("path", F.lit("a/b"))
    got = secrets.scan(docs).collect()
    assert [(r.doc_id, r.start, r.score, r.is_secret) for r in got] == [(1, 10, 1.0, True)]
    assert secrets.scan(docs.limit(0)).count() == 0
    plan = secrets.findings(docs)._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "Arrow" not in plan
