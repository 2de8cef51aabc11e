import math
import random

import brute
import numpy as np
from uttermark.llm.embeddings import codes, table_count, unit, vector_links

SCHEMA = "vec_id bigint, embedding array<float>, label int"


def test_equals_brute_force_with_parts_and_odd_vectors(spark):
    rng = np.random.default_rng(5)
    rows = []
    for c in range(4):
        center = rng.standard_normal(16)
        for i in range(40):
            noise = rng.standard_normal(16) * rng.choice([0.05, 0.2, 0.3])
            rows.append((100 * c + i, [float(np.float32(x)) for x in center + noise], c % 2))
    rows += [(900, rows[0][1], 0), (901, rows[0][1], 0), (902, rows[0][1], 1), (903, None, 0),
             (904, [], 0), (905, [0.0] * 16, 0), (906, [math.nan] + [1.0] * 15, 0),
             (907, [None] + [1.0] * 15, 0), (908, rows[0][1], None), (909, [math.inf] * 16, 0),
             (910, rows[0][1][:8], 0), (911, [-x for x in rows[0][1]], 0)]
    random.Random(1).shuffle(rows)
    got = vector_links(spark.createDataFrame(rows, SCHEMA), part=16).collect()
    want = brute.cosine_links(rows, 0.93)
    assert {r.vec_id: (r.n_links, r.component_id) for r in got} == want
    assert all(r.kept == (r.vec_id == r.component_id) for r in got)


def test_null_ids_repeats_extra_columns_and_empty_tables(spark):
    rows = [(1, [1.0, 0.0], 1, "a"), (1, [1.0, 0.0], 1, "a"), (None, [1.0, 0.0], 1, "b")]
    vectors = spark.createDataFrame(rows, SCHEMA + ", n_links string")
    got = sorted(map(tuple, vector_links(vectors).collect()), key=repr)
    assert got == sorted([(1, 1, 1, True), (1, 1, 1, True), (None, 0, None, True)], key=repr)
    assert vector_links(vectors.limit(0)).count() == 0


def test_signs_do_not_depend_on_the_batch_and_tables_suffice():
    v = unit(np.random.default_rng(2).standard_normal((300, 64)))
    whole = codes(v, 57, 12)
    assert all((codes(v[i : i + 1], 57, 12) == whole[i]).all() for i in range(0, 300, 37))
    agree = 1 - math.acos(0.93) / math.pi
    assert (1 - agree**12) ** table_count(0.93) <= 1e-6


def planted(rng, centers, others, length):
    """Vectors of five labels: centers with partners at cosines from 0.93 to 0.97, and others
    in all directions; with the pairs that link, by brute force."""
    rows = []

    def add(v, label):
        rows.append((len(rows), [float(x) for x in v], label))

    for c in range(centers):
        center = unit(rng.standard_normal((1, length)))[0]
        add(center, c % 5)
        for cosine in (0.931, 0.94, 0.95, 0.97)[: 1 + c % 4]:
            away = rng.standard_normal(length)
            away = unit((away - (away @ center) * center)[None])[0]
            add(rng.uniform(0.5, 2) * (cosine * center + math.sqrt(1 - cosine**2) * away), c % 5)
    for i in range(others):
        add(rng.standard_normal(length), i % 5)
    links, labels = set(), np.array([r[2] for r in rows])
    for label in range(5):
        at = np.flatnonzero(labels == label)
        units = unit(np.array([rows[i][1] for i in at]))
        for x in range(0, len(at), 512):
            found = np.argwhere(units[x : x + 512] @ units.T >= 0.93)
            links |= {(at[x + a], at[b]) for a, b in found if x + a < b}
    return rows, links


def test_recall_on_twenty_thousand_vectors(spark):
    rows, links = planted(np.random.default_rng(12), 1500, 16_000, 24)
    assert len(rows) > 19_500 and len(links) > 3_500
    got = {r.vec_id: r for r in vector_links(spark.createDataFrame(rows, SCHEMA.replace("float", "double"))).collect()}
    n = np.zeros(len(rows), int)
    for a, b in links:
        n[a] += 1
        n[b] += 1
    found = np.array([got[i].n_links for i in range(len(rows))])
    assert (found <= n).all()  # none below the threshold
    recall = found.sum() / n.sum()
    print("recall", recall)
    assert recall > 0.9999
    assert all(got[a].component_id == got[b].component_id for a, b in links) or recall < 1


def test_groups_pass_through_batches_of_any_size(spark):
    rng = np.random.default_rng(3)
    base = rng.standard_normal((6, 8))
    rows = [(i, [float(x) for x in base[i % 6] + rng.normal(0, 0.05, 8)], 0) for i in range(300)]
    rows += [(1000 + i, [float(x) for x in rng.standard_normal(5)], 1) for i in range(40)]
    want = brute.cosine_links(rows, 0.93)
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "7")
    try:
        got = vector_links(spark.createDataFrame(rows, SCHEMA.replace("float", "double")), part=32).collect()
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
    assert {r.vec_id: (r.n_links, r.component_id) for r in got} == want
