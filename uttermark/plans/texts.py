"""Queries over texts: normalising, error rates, repetition, hashes, excerpts."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import grading, text
from ..operators import rollup
from .bindings import RECORDS, records, table, turn_pairs, with_sql
from .registry import query
from .runs import rounded

# The SQL twin of the normaliser: same deletions, then folding, then lower case.
NORMALIZE = (
    "lower(translate(regexp_replace({0}, "
    "'[、。！？（）…「」,. :;\\[\\]{{}}()''\"\\t-\\r\\x1c-\\x20\\x{{85}}\\x{{a0}}\\x{{1680}}"
    "\\x{{2000}}-\\x{{200a}}\\x{{2028}}\\x{{2029}}\\x{{202f}}\\x{{205f}}\\x{{3000}}]+', '', 'g'), '"
    + text.FULL_WIDTH + "', '" + text.HALF_WIDTH.replace("'", "''").replace("{", "{{").replace("}", "}}")
    + "'))"
)


def _norm(expr: str) -> str:
    return NORMALIZE.format(expr)


def _edits(hyp: str, ref: str) -> str:
    """Edit distance in letters. The second engine counts bytes, so each accented letter of
    the given texts becomes a capital, of which normalised texts have none."""
    one = "translate({}, 'áâäàçéèêëíîïñóôöùúûüß', 'ABCDEFGHIJKLMNOPQRSTU')"
    return f"levenshtein({one.format(hyp)}, {one.format(ref)})"


WIDE = "concat(text, '　ＡＢ１，！ Ｚ?!')"


@query("normalized_texts", f"""
SELECT doc_id, sha256({_norm(WIDE)}) AS digest, length({_norm(WIDE)}) AS n FROM documents""")
def normalized_texts(spark, root):
    docs = table(spark, root, "documents")
    clean = text.normalize_text(F.concat(F.col("text"), F.lit("　ＡＢ１，！ Ｚ?!")))
    return docs.select("doc_id", clean.alias("t")).select(
        "doc_id", F.sha2("t", 256).alias("digest"), F.length("t").cast("bigint").alias("n")
    )


def _odd_name():
    n = F.col("doc_id").cast("string")
    kind = F.col("doc_id") % 4
    return (
        F.when(kind == 0, F.concat(F.lit("dir.x/Doc "), n, F.lit(" (1).mp3")))
        .when(kind == 1, F.concat(F.lit("doc_"), n, F.lit("_(1).txt")))
        .when(kind == 2, F.concat(F.lit("---Doc---"), n, F.lit("---")))
        .otherwise(F.concat(F.lit(".Été "), n, F.lit(".tar.GZ")))
    )


ODD_NAME = """CASE doc_id % 4 WHEN 0 THEN concat('dir.x/Doc ', doc_id, ' (1).mp3')
    WHEN 1 THEN concat('doc_', doc_id, '_(1).txt') WHEN 2 THEN concat('---Doc---', doc_id, '---')
    ELSE concat('.Été ', doc_id, '.tar.GZ') END"""
STEM_SQL = (
    "regexp_replace(regexp_replace(lower(regexp_replace(regexp_extract({0}, '([^/]*)$', 1), "
    "'(.)\\.[^.]*$', '\\1')), '[^a-z0-9]+', '_', 'g'), '^_+|_+$', '', 'g')"
)


@query("canonical_stems", f"""
SELECT doc_id, {ODD_NAME} AS name, {STEM_SQL.format(ODD_NAME)} AS stem FROM documents""")
def canonical_stems(spark, root):
    return table(spark, root, "documents").select(
        "doc_id", _odd_name().alias("name"), text.canonical_stem(_odd_name()).alias("stem")
    )


def scored_pairs(spark, root):
    pairs = turn_pairs(spark, root).select(
        "conv_id", "turn",
        text.normalize_text(F.col("hyp")).alias("hyp"),
        text.normalize_text(F.col("ref")).alias("ref"),
        text.repetition_factor(F.col("hyp")).alias("rf"),
    )
    return pairs.withColumn("cer", text.char_error_rate(F.col("hyp"), F.col("ref")))


SCORED = f"""
, norm AS (SELECT conv_id, turn, {_norm('hyp')} AS hyp, {_norm('ref')} AS ref FROM pairs),
scored AS (SELECT *, CASE WHEN length(ref) > 0 THEN {_edits('hyp', 'ref')} / length(ref)
    WHEN length(hyp) > 0 THEN 1.0 ELSE 0.0 END AS cer FROM norm)"""


@query("char_error_rates", with_sql("pairs", body=SCORED + """
SELECT conv_id, turn, length(hyp) AS hyp_chars, length(ref) AS ref_chars, round(cer, 9) AS cer
FROM scored"""))
def char_error_rates(spark, root):
    return scored_pairs(spark, root).select(
        "conv_id", "turn",
        F.length("hyp").cast("bigint").alias("hyp_chars"),
        F.length("ref").cast("bigint").alias("ref_chars"),
        F.round("cer", 9).alias("cer"),
    )


@query("mean_char_error_rate", with_sql("pairs", body=SCORED + """
SELECT count(*) AS scored, round(avg(cer), 6) AS cer_unrounded,
    round(avg(round(cer * 10000) / 10000), 4) AS cer_from_text
FROM scored WHERE NOT (hyp = '' AND ref <> '')"""))
def mean_char_error_rate(spark, root):
    usable = scored_pairs(spark, root).filter(~((F.col("hyp") == "") & (F.col("ref") != "")))
    return usable.agg(
        F.count(F.lit(1)).alias("scored"),
        F.round(F.avg("cer"), 6).alias("cer_unrounded"),
        F.round(F.avg(F.round(F.col("cer") * 10000) / 10000), 4).alias("cer_from_text"),
    )


@query("repetition_factors", """
WITH chars AS (SELECT doc_id, unnest(string_split(text, '')) AS c,
        generate_subscripts(string_split(text, ''), 1) AS i FROM documents),
islands AS (SELECT doc_id, c, i - row_number() OVER (PARTITION BY doc_id, c ORDER BY i) AS g FROM chars),
runs AS (SELECT doc_id, count(*) AS n FROM islands GROUP BY doc_id, c, g)
SELECT d.doc_id, CAST(count(n) AS INTEGER) AS rf FROM documents d
LEFT JOIN runs r ON r.doc_id = d.doc_id AND r.n >= 5 GROUP BY d.doc_id""")
def repetition_factors(spark, root):
    return table(spark, root, "documents").select(
        "doc_id", text.repetition_factor(F.col("text")).alias("rf")
    )


@query("char_ngrams", """
SELECT conv_id, turn, greatest(length(text) - 2, 0) AS n_grams,
    len(list_distinct([substr(text, i, 3) FOR i IN range(1, length(text) - 1)])) AS n_distinct,
    coalesce(substr(text, greatest(length(text) - 2, 1), 3), '') AS last_gram
FROM conversations""")
def char_ngrams(spark, root):
    grams = table(spark, root, "conversations").select(
        "conv_id", "turn", text.char_ngrams(F.col("text")).alias("g")
    )
    return grams.select(
        "conv_id", "turn",
        F.size("g").cast("bigint").alias("n_grams"),
        F.size(F.array_distinct("g")).cast("bigint").alias("n_distinct"),
        F.element_at("g", -1).alias("last_gram"),
    )


@query("row_grades", with_sql("pairs", body=SCORED + """
, graded AS (SELECT conv_id, turn, hyp, ref, cer, (turn % 10) / 20.0::DOUBLE AS rtf,
    CASE WHEN conv_id % 9 = 0 THEN 'failed' ELSE 'success' END AS status,
    CASE WHEN conv_id % 3 = 0 THEN 'silence_x.wav' ELSE 'call.mp3' END AS file,
    conv_id % 4 <> 1 AS has_ref, conv_id % 5 / 4.0::DOUBLE AS hrs,
    (conv_id % 2)::INTEGER AS rf, CASE WHEN conv_id % 7 = 0 THEN 0.0 ELSE cer / 20 END AS c FROM scored),
used AS (SELECT *, CASE WHEN file LIKE '%silence%' THEN hrs ELSE 0.0 END AS h FROM graded)
SELECT conv_id, turn, CASE WHEN status <> 'success' THEN 'ERROR'
    WHEN NOT has_ref THEN CASE WHEN rtf < 0.2 AND rf = 0 THEN 'A' WHEN rtf < 0.5 THEN 'B' ELSE 'F' END
    WHEN hyp = '' AND ref <> '' THEN 'F (Fail)'
    WHEN h = 0 AND c < 0.01 AND rtf < 0.1 THEN 'S (Excellent)'
    WHEN h < 0.5 AND c < 0.03 AND rtf < 0.2 THEN 'A (Good)'
    WHEN h < 2.0 AND c < 0.10 AND rtf < 0.5 THEN 'B (Fair)' ELSE 'F (Fail)' END AS grade
FROM used"""))
def row_grades(spark, root):
    conv = F.col("conv_id")
    rows = scored_pairs(spark, root).withColumns(
        {
            "rtf": (F.col("turn") % 10) / 20,
            "status": F.when(conv % 9 == 0, "failed").otherwise("success"),
            "file": F.when(conv % 3 == 0, "silence_x.wav").otherwise("call.mp3"),
            "ref_or_none": F.when(conv % 4 != 1, F.col("ref")),
            "hrs": (conv % 5) / 4,
            "rf": (conv % 2).cast("int"),
            "c": F.when(conv % 7 == 0, F.lit(0.0)).otherwise(F.col("cer") / 20),
        }
    )
    grade = grading.row_grade(
        F.col("status"), F.col("file"), F.col("hyp"), F.col("ref_or_none"), F.col("c"),
        F.col("hrs"), F.col("rtf"), F.col("rf"),
    )
    return rows.select("conv_id", "turn", grade.alias("grade"))


@query("scored_results", with_sql("pairs", body=SCORED + f"""
, results AS (SELECT concat(CASE WHEN conv_id % 3 = 0 THEN 'silence_' ELSE 'call_' END, conv_id, '_', turn) AS file,
    concat('r', conv_id % 5) AS run_id, CASE WHEN conv_id % 9 = 0 THEN 'failed' ELSE 'success' END AS status,
    CASE WHEN turn % 7 = 6 THEN '' ELSE hyp END AS transcript, (turn * 1000)::DOUBLE AS duration,
    (turn % 10) / 20.0::DOUBLE AS rtf, CASE WHEN conv_id % 4 <> 1 THEN ref END AS ref FROM pairs),
h AS (SELECT run_id, CASE WHEN sum(duration) > 0 THEN sum(length(transcript)) / (sum(duration) / 60) ELSE 0.0 END AS hrs
    FROM results WHERE file LIKE 'silence%' GROUP BY run_id),
chars AS (SELECT file, unnest(string_split(transcript, '')) AS c,
    generate_subscripts(string_split(transcript, ''), 1) AS i FROM results),
islands AS (SELECT file, c, i - row_number() OVER (PARTITION BY file, c ORDER BY i) AS g FROM chars),
reps AS (SELECT file, count(*) AS rf FROM (SELECT file FROM islands GROUP BY file, c, g HAVING count(*) >= 5) GROUP BY file),
n AS (SELECT *, {_norm('transcript')} AS nh, {_norm('ref')} AS nr FROM results LEFT JOIN h USING (run_id)
    LEFT JOIN reps USING (file)),
v AS (SELECT *, CASE WHEN status <> 'success' OR ref IS NULL OR (nh = '' AND nr <> '') THEN NULL
    WHEN length(nr) > 0 THEN {_edits('nh', 'nr')} / length(nr) WHEN length(nh) > 0 THEN 1.0 ELSE 0.0 END AS cer,
    CASE WHEN file LIKE 'silence%' THEN coalesce(hrs, 0) ELSE 0.0 END AS g FROM n)
SELECT file, status, round(cer, 9) AS cer_value,
    CASE WHEN cer IS NOT NULL THEN 'scored' WHEN status = 'success' AND ref IS NOT NULL THEN 'N/A (Empty)' ELSE 'N/A' END AS cer_kind, coalesce(rf, 0)::INTEGER AS rf,
    CASE WHEN status <> 'success' THEN 'ERROR'
    WHEN ref IS NULL THEN CASE WHEN rtf < 0.2 AND coalesce(rf, 0) = 0 THEN 'A' WHEN rtf < 0.5 THEN 'B' ELSE 'F' END
    WHEN nh = '' AND nr <> '' THEN 'F (Fail)' WHEN g = 0 AND cer < 0.01 AND rtf < 0.1 THEN 'S (Excellent)'
    WHEN g < 0.5 AND cer < 0.03 AND rtf < 0.2 THEN 'A (Good)'
    WHEN g < 2.0 AND cer < 0.10 AND rtf < 0.5 THEN 'B (Fair)' ELSE 'F (Fail)' END AS grade
FROM v"""))
def scored_results(spark, root):
    from ..operators.scoring import score_results

    conv, turn = F.col("conv_id"), F.col("turn")
    name = F.concat(
        F.when(conv % 3 == 0, "silence_").otherwise("call_"), conv.cast("string"), F.lit("_"),
        turn.cast("string"),
    )
    rows = turn_pairs(spark, root).withColumn("file", name)
    results = rows.select(
        F.lit("e").alias("engine"), F.concat(F.lit("r"), (conv % 5).cast("string")).alias("run_id"),
        "file", F.when(conv % 9 == 0, "failed").otherwise("success").alias("status"),
        F.when(turn % 7 == 6, "").otherwise(F.col("hyp")).alias("transcript"),
        (turn * 1000).cast("double").alias("duration"),
        ((turn % 10) / 20).alias("inference_rtf"),
    )
    references = rows.filter(conv % 4 != 1).select("file", F.col("ref").alias("ref_text"))
    scored = score_results(results, references)
    kind = F.when(F.col("cer").endswith("%"), "scored").otherwise(F.col("cer"))
    return scored.select(
        "file", "status", F.round("cer_value", 9).alias("cer_value"), kind.alias("cer_kind"),
        "rf", "grade",
    )


@query("quality_tiers", with_sql(*RECORDS, body="""
SELECT engine, CASE WHEN cer_bp IS NULL THEN 'unknown' WHEN cer_bp <= 2000 THEN 'good'
    WHEN cer_bp <= 5000 THEN 'fair' ELSE 'poor' END AS tier, count(*) AS n
FROM records GROUP BY ALL"""))
def quality_tiers(spark, root):
    tier = grading.quality_tier(text.parse_percent(F.col("cer")))
    return rollup.histogram(
        records(spark, root).select("engine", tier.alias("tier")), ["engine"], "tier"
    )


@query("real_time_factors", with_sql(*RECORDS, body="""
SELECT seq, CASE WHEN duration > 0 THEN CAST(printf('%.3f', wait_after_commit / duration) AS DOUBLE) ELSE 0.0 END AS rtf
FROM records"""))
def real_time_factors(spark, root):
    return records(spark, root).select(
        "seq", grading.ratio(F.col("wait_after_commit"), F.col("duration")).alias("rtf")
    )


@query("silence_rates", with_sql(*RECORDS, body="""
, q AS (SELECT engine, run_id, CASE WHEN lower(file) LIKE '%silence%' OR lower(file) LIKE '%noise%'
    THEN 1 END AS quiet, length(transcript) AS chars, duration FROM records)
SELECT engine, run_id, round(CASE WHEN coalesce(sum(quiet * duration), 0) > 0
    THEN sum(quiet * chars) / (sum(quiet * duration) / 60) ELSE 0.0 END, 6) AS hrs
FROM q GROUP BY engine, run_id"""))
def silence_rates(spark, root):
    return rounded(rollup.silence_rate(records(spark, root), ["engine", "run_id"]))


@query("text_hashes", """
SELECT doc_id, substr(sha256(text), 1, 12) AS hash, length(text) AS n_chars FROM documents""")
def text_hashes(spark, root):
    return table(spark, root, "documents").select(
        "doc_id", text.transcript_hash(F.col("text")).alias("hash"),
        F.length("text").cast("bigint").alias("n_chars"),
    )


@query("excerpts", r"""
SELECT doc_id, array_to_string(list_slice(list_filter(list_transform(
    regexp_split_to_array(text, '\r\n|\r|\n'), lambda x: trim(x)), lambda x: x <> ''), 1, 3), ' ') AS excerpt
FROM documents""")
def excerpts(spark, root):
    return table(spark, root, "documents").select(
        "doc_id", text.excerpt(F.col("text")).alias("excerpt")
    )


@query("parsed_percents", with_sql(*RECORDS, body="""
SELECT seq, cer_bp / 100 AS cer_pct, cer_bp / 100 / 100 AS cer FROM records"""))
def parsed_percents(spark, root):
    return records(spark, root).select(
        "seq",
        text.parse_percent(F.col("cer")).alias("cer_pct"),
        text.parse_cer(F.col("cer")).alias("cer"),
    )


@query("timed_reference_rates", f"""
WITH flat AS (SELECT conv_id, turn, text AS t FROM conversations),
lines AS (SELECT conv_id, turn, t, list_filter(list_transform(string_split(t, chr(10)), lambda x: trim(x)), lambda x: x <> '') AS l
    FROM flat),
rebuilt AS (SELECT conv_id, turn, len(l) AS n_lines, array_to_string(l, ' ') AS ref, array_to_string(list_reverse(l), ' ') AS hyp FROM lines)
SELECT conv_id, turn, n_lines::INTEGER AS n_lines, round(CASE WHEN length({_norm("ref")}) > 0
    THEN {_edits(_norm("hyp"), _norm("ref"))} / length({_norm("ref")}) ELSE 0.0 END, 9) AS cer
FROM rebuilt""")
def timed_reference_rates(spark, root):
    """CER against the text rebuilt from a timed reference, whose lines come in any
    order and are put back by their start. One row holds one reference file."""
    lines = F.filter(
        F.transform(F.split("text", "\n"), lambda x: F.trim(x)), lambda x: x != ""
    )
    timed = F.array_join(
        F.reverse(
            F.transform(
                lines,
                lambda x, i: F.concat(
                    F.lit("["), (i * 2.5).cast("string"), F.lit(" - "),
                    (i * 2.5 + 2).cast("string"), F.lit("] SPEAKER 1: "), x,
                ),
            )
        ),
        "\n",
    )
    rows = table(spark, root, "conversations").select("conv_id", "turn", timed.alias("timed"))
    parsed = rows.select(
        "conv_id", "turn", text.parse_timed_lines(F.col("timed")).alias("lines")
    )
    return parsed.select(
        "conv_id", "turn", F.size("lines").alias("n_lines"),
        text.normalize_text(F.array_join(F.col("lines.text"), " ")).alias("hyp"),
        text.normalize_text(text.timed_text(F.col("lines"))).alias("ref"),
    ).select(
        "conv_id", "turn", "n_lines",
        F.round(text.char_error_rate(F.col("hyp"), F.col("ref")), 9).alias("cer"),
    )
