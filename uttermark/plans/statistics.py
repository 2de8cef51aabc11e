"""Queries for distributions, intervals, comparison of engines and triage."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions.grading import winner
from ..operators import compare, rollup, triage
from ..operators.bootstrap import (
    FEW, POISSON_STEPS, PRIME, REPLICAS, TURN, bootstrap_mean, bootstrap_superiority,
)
from ..operators.superiority import superiority
from .bindings import (
    FILES, JUDGED, LEFT_ENGINE, RECORDS, RIGHT_ENGINE, big_records, judged, records, with_sql,
)
from .registry import query
from .runs import rounded

GRAINS = """
SELECT engine, file, run_id,
    CASE grouping(engine, file, run_id) WHEN 3 THEN 'engine' WHEN 1 THEN 'file' ELSE 'run' END AS grain,
    count(*) AS records, round(avg(cer_bp) / 100, 6) AS cer_mean, min(cer_bp) / 100 AS cer_min,
    max(cer_bp) / 100 AS cer_max, round(avg(inference_rtf), 9) AS rtf_mean,
    round(count(*) FILTER (has_hallucination) / count(*), 6) AS hallucination_rate,
    round(count(*) FILTER (severity = 'high') / count(*), 6) AS high_severity_rate
FROM {0} GROUP BY GROUPING SETS ((engine), (engine, file), (engine, run_id))"""


def _rounded_grains(facts):
    grains_of = rollup.grains(facts).withColumn("rtf_mean", F.round("rtf_mean", 9))
    return rounded(grains_of, skip=("rtf_mean",))


@query("grains", with_sql(*JUDGED, body=GRAINS.format("judged")))
def grains(spark, root):
    return _rounded_grains(judged(spark, root))


@query("grains_of_order_lines", with_sql("big", body=GRAINS.format("big")))
def grains_of_order_lines(spark, root):
    return _rounded_grains(big_records(spark, root))


@query("distinct_members", with_sql(*RECORDS, body="""
SELECT engine, count(DISTINCT file) AS files, count(DISTINCT file) FILTER (has_timestamp) AS timestamped_files,
    count(DISTINCT run_id) AS runs FROM records GROUP BY engine"""))
def distinct_members(spark, root):
    return rollup.distinct_members(records(spark, root))


@query("distinct_values", with_sql(*RECORDS, body="""
SELECT engine, file, count(DISTINCT coalesce(cer_bp, -1)) AS distinct_cer_values,
    count(DISTINCT transcript_hash) AS distinct_transcript_hashes FROM records GROUP BY engine, file"""))
def distinct_values(spark, root):
    return rollup.distinct_values(records(spark, root))


@query("file_grain", with_sql(*FILES, body="""
SELECT engine, file, runs, round(cer_mean, 6) AS cer_mean, round(cer_std, 6) AS cer_std, cer_min, cer_max,
    round(rtf_mean, 6) AS rtf_mean, round(rtf_std, 6) AS rtf_std,
    round(hallucination_rate, 6) AS hallucination_rate, round(high_severity_rate, 6) AS high_severity_rate,
    tier_changes, has_timestamp FROM files"""))
def file_grain(spark, root):
    return rounded(rollup.file_grain(judged(spark, root)))


# ------------------------------------------------------------- bootstrap twin

def _pow5(x: str) -> str:
    square = f"({x} * {x} % {PRIME})"
    return f"({square} * {square} % {PRIME} * {x} % {PRIME})"


def row_draws_sql(source: str, keys: str, seed: int) -> str:
    """Views ending in ``draws`` (keys, rep, value, weight) over ``source`` (keys, value, row):
    one weight for every row in every replicate."""
    first = f"((rep + 1) * 1000003 + {seed} * 7919) % {PRIME}"
    weight = " + ".join(f"(d2 >= {int(s * PRIME)})::BIGINT" for s in POISSON_STEPS)
    return f"""
, reps AS (SELECT unnest(range(0, {REPLICAS})) AS rep),
draw0 AS (SELECT {keys}, rep, value, row, ({first} * 48271 + row % {PRIME} * 69621 + 11) % {PRIME} AS d0
    FROM {source}, reps),
draw1 AS (SELECT *, ({_pow5('d0')} + row % {PRIME} * 16807 + 101) % {PRIME} AS d1 FROM draw0),
draw2 AS (SELECT *, {_pow5('d1')} AS d2 FROM draw1),
draws AS (SELECT * FROM (SELECT {keys}, rep, value, {weight} AS weight FROM draw2) WHERE weight > 0)"""


def draws_sql(source: str, keys: str, seed: int) -> str:
    """As ``row_draws_sql``, with one weight for all rows of a value where these are many."""
    first = f"((rep + 1) * 1000003 + {seed} * 7919) % {PRIME}"
    few = " + ".join(f"(d2 >= {int(s * PRIME)})::BIGINT" for s in POISSON_STEPS)
    normal = f"sqrt(ln((d1 + 1) / ({PRIME} + 1.0::DOUBLE)) * -2.0::DOUBLE) * cos(d2 / {PRIME}::DOUBLE * {TURN}::DOUBLE)"
    many = f"greatest(floor(n + sqrt(n::DOUBLE) * {normal} + 0.5::DOUBLE), 0)::BIGINT"
    return f"""
, reps AS (SELECT unnest(range(0, {REPLICAS})) AS rep),
same AS (SELECT {keys}, value, count(*) AS n, min(row) AS row FROM {source} GROUP BY {keys}, value),
atoms AS (SELECT {keys}, value, row, CASE WHEN n > {FEW} THEN n ELSE 1 END AS n,
    unnest(range(0, CASE WHEN n > {FEW} THEN 1 ELSE n END)) AS part FROM same),
draw0 AS (SELECT {keys}, rep, value, row, n,
    (({first} * 48271 + row % {PRIME} * 69621 + 11) % {PRIME} + part * 40692) % {PRIME} AS d0 FROM atoms, reps),
draw1 AS (SELECT *, ({_pow5('d0')} + row % {PRIME} * 16807 + 101) % {PRIME} AS d1 FROM draw0),
draw2 AS (SELECT *, {_pow5('d1')} AS d2 FROM draw1),
draws AS (SELECT * FROM (SELECT {keys}, rep, value, CASE WHEN n > 1 THEN {many} ELSE {few} END AS weight FROM draw2)
    WHERE weight > 0)"""


def mean_ci_sql(keys: str) -> str:
    return f"""
, means AS (SELECT {keys}, rep, sum(value * weight) / sum(weight) AS m FROM draws GROUP BY {keys}, rep),
ci AS (SELECT {keys}, quantile_cont(m, 0.025) AS ci_low, quantile_cont(m, 0.975) AS ci_high
    FROM means GROUP BY {keys})"""


METRICS_LONG = """
, long AS (
    SELECT engine, 'cer_all' AS metric, cer_bp::DOUBLE AS value, seq AS row FROM records WHERE cer_bp IS NOT NULL
    UNION ALL SELECT engine, 'cer_gt', cer_bp::DOUBLE, seq FROM records WHERE cer_bp IS NOT NULL AND has_timestamp
    UNION ALL SELECT engine, 'rtf', inference_rtf * 100, seq FROM records WHERE inference_rtf IS NOT NULL)"""


@query("metric_summary", with_sql(*RECORDS, body=METRICS_LONG
       + row_draws_sql("long", "engine, metric", 101) + mean_ci_sql("engine, metric") + """
SELECT engine, metric, count(*) AS count, round(avg(value) / 100, 6) AS mean,
    round(quantile_cont(value, 0.5) / 100, 6) AS median, round(stddev_pop(value) / 100, 6) AS std,
    round(min(value) / 100, 6) AS min, round(max(value) / 100, 6) AS max,
    round(quantile_cont(value, 0.95) / 100, 6) AS p95,
    round(any_value(ci_low) / 100, 6) AS ci_low, round(any_value(ci_high) / 100, 6) AS ci_high
FROM long JOIN ci USING (engine, metric) GROUP BY engine, metric"""))
def metric_summary(spark, root):
    long = rollup.metrics_long(
        records(spark, root), ["engine", "seq"],
        {
            "cer_all": F.col("cer_bp"),
            "cer_gt": F.when(F.col("has_timestamp"), F.col("cer_bp")),
            "rtf": F.col("inference_rtf") * 100,
        },
    )
    summary = rollup.metric_summary(long, ["engine", "metric"], "value", "seq", seed=101, method="rows")
    scaled = ["mean", "median", "std", "min", "max", "p95", "ci_low", "ci_high"]
    return rounded(summary.withColumns({c: F.col(c) / 100 for c in scaled}))


@query("quantiles_of_order_lines", """
SELECT l_returnflag AS engine, l_linestatus AS status, round(quantile_cont(l_extendedprice, 0.5), 6) AS median,
    round(quantile_cont(l_extendedprice, 0.95), 6) AS p95, round(quantile_cont(l_extendedprice, 0.15), 6) AS p15
FROM lineitem GROUP BY ALL""")
def quantiles_of_order_lines(spark, root):
    from ..operators.quantiles import exact_quantiles
    from .bindings import table

    rows = table(spark, root, "lineitem").select(
        F.col("l_returnflag").alias("engine"), F.col("l_linestatus").alias("status"), "l_extendedprice"
    )
    return rounded(exact_quantiles(
        rows, ["engine", "status"], "l_extendedprice", {"median": 0.5, "p95": 0.95, "p15": 0.15}
    ))


RUN_MEANS = """
, runs AS (SELECT engine, avg(cer_bp) / 100 AS value, avg(inference_rtf) AS rtf,
    min(seq) AS row FROM records WHERE engine IN ('click', 'view') GROUP BY engine, run_id),
scored AS (SELECT * FROM runs WHERE value IS NOT NULL), timed AS (SELECT * FROM runs WHERE rtf IS NOT NULL)"""


@query("bootstrap_run_means", with_sql(*RECORDS, body=RUN_MEANS
       + draws_sql("scored", "engine", 7) + mean_ci_sql("engine") + """
SELECT engine, round(ci_low, 6) AS ci_low, round(ci_high, 6) AS ci_high FROM ci"""))
def bootstrap_run_means(spark, root):
    return rounded(bootstrap_mean(_run_means(spark, root), ["engine"], "value", "row", seed=7))


@query("bootstrap_order_lines", with_sql("big", body="""
, src AS (SELECT engine, cer_bp::DOUBLE AS value, seq AS row FROM big)"""
       + row_draws_sql("src", "engine", 11) + mean_ci_sql("engine") + """
SELECT engine, round(ci_low, 6) AS ci_low, round(ci_high, 6) AS ci_high FROM ci"""))
def bootstrap_order_lines(spark, root):
    return rounded(
        bootstrap_mean(big_records(spark, root), ["engine"], "cer_bp", "seq", seed=11, method="rows")
    )


def _run_means(spark, root):
    return (
        records(spark, root)
        .filter(F.col("engine").isin(LEFT_ENGINE, RIGHT_ENGINE))
        .groupBy("engine", "run_id")
        .agg(
            (F.avg("cer_bp") / 100).alias("value"),
            F.avg("inference_rtf").alias("rtf"),
            F.min("seq").alias("row"),
        )
    )


@query("wilson_intervals", with_sql(*JUDGED, body="""
, s AS (SELECT engine, count(*)::DOUBLE AS n, count(*) FILTER (has_hallucination)::DOUBLE AS k FROM judged GROUP BY engine),
w AS (SELECT *, k / n AS p, 1 + 1.96::DOUBLE * 1.96 / n AS scale FROM s),
v AS (SELECT *, (p + 1.96::DOUBLE * 1.96 / (2 * n)) / scale AS center,
    1.96::DOUBLE * sqrt((p * (1 - p) + 1.96::DOUBLE * 1.96 / (4 * n)) / n) / scale AS margin FROM w)
SELECT engine, n::BIGINT AS n, k::BIGINT AS k, round(p, 6) AS rate,
    round(greatest(0.0, center - margin), 6) AS low, round(least(1.0, center + margin), 6) AS high FROM v"""))
def wilson_intervals(spark, root):
    counts = judged(spark, root).groupBy("engine").agg(
        F.count(F.lit(1)).alias("n"), rollup.count_if(F.col("has_hallucination")).alias("k")
    )
    k, n = F.col("k"), F.col("n")
    return counts.select(
        "engine", "n", "k", F.round(k / n, 6).alias("rate"),
        F.round(rollup.wilson_low(k, n), 6).alias("low"),
        F.round(rollup.wilson_high(k, n), 6).alias("high"),
    )


PAIRS = """count(*)::DOUBLE AS total_pairs, count(*) FILTER (l.{v} < r.{v}) / count(*) AS p_left,
    count(*) FILTER (l.{v} > r.{v}) / count(*) AS p_right, count(*) FILTER (l.{v} = r.{v}) / count(*) AS p_tie"""


def _sides():
    return {
        "left": (F.col("engine") == LEFT_ENGINE).cast("bigint"),
        "right": (F.col("engine") == RIGHT_ENGINE).cast("bigint"),
    }


@query("superiority_by_run", with_sql(*RECORDS, body=RUN_MEANS + f"""
SELECT 'cer' AS metric, {PAIRS.format(v='value')} FROM scored l, scored r WHERE l.engine = 'click' AND r.engine = 'view'
UNION ALL SELECT 'rtf', {PAIRS.format(v='rtf')} FROM timed l, timed r WHERE l.engine = 'click' AND r.engine = 'view'"""))
def superiority_by_run(spark, root):
    long = rollup.metrics_long(
        _run_means(spark, root), ["engine"], {"cer": F.col("value"), "rtf": F.col("rtf")}
    )
    return superiority(long, ["metric"], "value", **_sides())


@query("superiority_by_file", with_sql(*RECORDS, body=f"""
SELECT file, p.*, CASE WHEN p_right > p_left THEN 'view' WHEN p_right < p_left THEN 'click' ELSE 'tie' END AS winner
FROM (SELECT l.file, {PAIRS.format(v='cer_bp')} FROM records l JOIN records r USING (file)
    WHERE l.engine = 'click' AND r.engine = 'view' AND l.cer_bp IS NOT NULL AND r.cer_bp IS NOT NULL GROUP BY l.file) p""".replace("SELECT file, p.*", "SELECT p.*")))
def superiority_by_file(spark, root):
    both = records(spark, root).filter(F.col("engine").isin(LEFT_ENGINE, RIGHT_ENGINE))
    pairs = superiority(both, ["file"], "cer_bp", **_sides())
    scored = pairs.filter("total_pairs > 0").withColumn(
        "winner", winner(F.col("p_left"), F.col("p_right"), LEFT_ENGINE, RIGHT_ENGINE)
    )
    return scored.orderBy(F.desc("p_right"), "file")


@query("superiority_of_order_lines", with_sql("big", body="""
, counts AS (SELECT cer_bp AS v, count(*) FILTER (engine = 'A') AS l, count(*) FILTER (engine = 'R') AS r
    FROM big GROUP BY cer_bp),
cum AS (SELECT *, coalesce(sum(l) OVER (ORDER BY v ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS below FROM counts)
SELECT (sum(l) * sum(r))::DOUBLE AS total_pairs, sum(r * below)::DOUBLE / (sum(l) * sum(r))::DOUBLE AS p_left,
    (sum(l) * sum(r) - sum(r * below) - sum(r * l))::DOUBLE / (sum(l) * sum(r))::DOUBLE AS p_right,
    sum(r * l)::DOUBLE / (sum(l) * sum(r))::DOUBLE AS p_tie FROM cum"""))
def superiority_of_order_lines(spark, root):
    both = big_records(spark, root).filter(F.col("engine").isin("A", "R"))
    return superiority(
        both, [], "cer_bp",
        left=(F.col("engine") == "A").cast("bigint"), right=(F.col("engine") == "R").cast("bigint"),
    )


def _superiority_ci_sql(keys: str) -> str:
    group = f"{keys}, rep" if keys else "rep"
    final = f"{keys}, " if keys else ""
    return f"""
, w AS (SELECT {group}, value, sum(CASE WHEN engine = 'click' THEN weight ELSE 0 END) AS l,
    sum(CASE WHEN engine = 'view' THEN weight ELSE 0 END) AS r FROM draws GROUP BY {group}, value),
c AS (SELECT *, coalesce(sum(l) OVER (PARTITION BY {group} ORDER BY value
    ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS below FROM w),
p AS (SELECT {group}, (sum(l) * sum(r) - sum(r * below) - sum(r * l))::DOUBLE / (sum(l) * sum(r))::DOUBLE AS pr
    FROM c GROUP BY {group} HAVING sum(l) * sum(r) > 0)
SELECT {final}round(quantile_cont(pr, 0.025), 11) AS ci_low, round(quantile_cont(pr, 0.975), 11) AS ci_high
FROM p {'GROUP BY ' + keys if keys else ''}"""


@query("bootstrap_superiority_by_run", with_sql(*RECORDS, body=RUN_MEANS
       + draws_sql("scored", "engine", 701) + _superiority_ci_sql("")))
def bootstrap_superiority_by_run(spark, root):
    return rounded(
        bootstrap_superiority(
            _run_means(spark, root), [], "value", "row", side="engine",
            left=LEFT_ENGINE, right=RIGHT_ENGINE, seed=701,
        ),
        11,
    )


@query("bootstrap_rtf_superiority_by_run", with_sql(*RECORDS, body=RUN_MEANS
       + ", src AS (SELECT engine, rtf AS value, row FROM timed)"
       + draws_sql("src", "engine", 702) + _superiority_ci_sql("")))
def bootstrap_rtf_superiority_by_run(spark, root):
    return rounded(
        bootstrap_superiority(
            _run_means(spark, root), [], "rtf", "row", side="engine",
            left=LEFT_ENGINE, right=RIGHT_ENGINE, seed=702,
        ),
        11,
    )


@query("bootstrap_superiority_by_file", with_sql(*RECORDS, body="""
, src AS (SELECT file, engine, cer_bp::DOUBLE AS value, seq AS row FROM records
    WHERE engine IN ('click', 'view') AND cer_bp IS NOT NULL)"""
       + row_draws_sql("src", "file, engine", 900) + _superiority_ci_sql("file")))
def bootstrap_superiority_by_file(spark, root):
    return rounded(
        bootstrap_superiority(
            records(spark, root), ["file"], "cer_bp", "seq", side="engine",
            left=LEFT_ENGINE, right=RIGHT_ENGINE, seed=900, method="rows",
        ),
        11,
    )


@query("side_by_side", with_sql(*FILES, body="""
SELECT file, round(max(cer_mean) FILTER (engine = 'click'), 6) AS left_cer_mean,
    round(max(rtf_mean) FILTER (engine = 'click'), 6) AS left_rtf_mean,
    round(max(hallucination_rate) FILTER (engine = 'click'), 6) AS left_hallucination_rate,
    round(max(cer_mean) FILTER (engine = 'view'), 6) AS right_cer_mean,
    round(max(rtf_mean) FILTER (engine = 'view'), 6) AS right_rtf_mean,
    round(max(hallucination_rate) FILTER (engine = 'view'), 6) AS right_hallucination_rate
FROM files WHERE engine IN ('click', 'view') GROUP BY file"""))
def side_by_side(spark, root):
    files = rollup.file_grain(judged(spark, root))
    return rounded(compare.side_by_side(files, LEFT_ENGINE, RIGHT_ENGINE))


# -------------------------------------------------------------------- labels


@query("label_histogram", with_sql(*JUDGED, body="""
SELECT engine, file, severity, count(*) AS n FROM judged GROUP BY ALL"""))
def label_histogram(spark, root):
    return rollup.histogram(judged(spark, root), ["engine", "file"], "severity")


@query("representative_hash", with_sql(*RECORDS, body="""
, counts AS (SELECT engine, file, transcript_hash, count(*) AS n, min(seq) AS first FROM records GROUP BY ALL)
SELECT engine, file, arg_max(transcript_hash, (n, -first)) AS transcript_hash, max(n) AS n
FROM counts GROUP BY engine, file"""))
def representative_hash(spark, root):
    return rollup.mode_by_first_seen(records(spark, root), ["engine", "file"], "transcript_hash", "seq")


@query("main_error", with_sql(*JUDGED, body="""
, counts AS (SELECT engine, primary_error, count(*) AS n, min(seq) AS first FROM judged GROUP BY ALL)
SELECT engine, arg_max(primary_error, (n, -first)) AS primary_error, max(n) AS n FROM counts GROUP BY engine"""))
def main_error(spark, root):
    return rollup.mode_by_first_seen(judged(spark, root), ["engine"], "primary_error", "seq")


@query("error_mix", with_sql(*JUDGED, body="""
, counts AS (SELECT engine, file, primary_error, count(*) AS n FROM judged GROUP BY ALL)
SELECT engine, file, string_agg(concat(primary_error, ':', n), ', ' ORDER BY n DESC, primary_error) AS mix
FROM counts GROUP BY engine, file"""))
def error_mix(spark, root):
    return rollup.mix_text(judged(spark, root), ["engine", "file"], "primary_error")


@query("cross_run_label_means", with_sql(*JUDGED, body="""
SELECT engine, severity, round(count(*) / any_value(n_runs), 6) AS mean_count
FROM judged JOIN (SELECT engine, count(DISTINCT run_id) AS n_runs FROM judged GROUP BY engine) USING (engine)
GROUP BY engine, severity"""))
def cross_run_label_means(spark, root):
    return rounded(rollup.cross_run_label_means(judged(spark, root), "severity"))


@query("first_row_values", with_sql(*RECORDS, body="""
SELECT engine, file, arg_min(run_id, seq) AS run_id, arg_min(duration, seq) AS duration FROM records
GROUP BY engine, file"""))
def first_row_values(spark, root):
    return rollup.first_row_values(
        records(spark, root), ["engine", "file"], ["run_id", "duration"], "seq"
    )


@query("representatives", with_sql(*RECORDS, body="""
SELECT engine, file, arg_max(run_id, (cer_bp, run_date, run_version, seq)) FILTER (cer_bp IS NOT NULL) AS worst_run,
    arg_min(run_id, (cer_bp, run_date, run_version, seq)) FILTER (cer_bp IS NOT NULL) AS best_run,
    arg_max(run_id, (run_date, run_version, seq)) AS latest_run,
    arg_max(transcript_hash, (run_date, run_version, seq)) AS latest_hash
FROM records GROUP BY engine, file"""))
def representatives(spark, root):
    return rollup.representatives(records(spark, root))


# -------------------------------------------------------------------- triage

CASES = """
, tails AS (SELECT engine, quantile_cont(cer_mean, 0.85) AS tc, quantile_cont(cer_std, 0.85) AS ts,
    quantile_cont(high_severity_rate, 0.85) AS th, quantile_cont(rtf_mean, 0.85) AS tr FROM files GROUP BY engine),
hits AS (SELECT f.*, list_filter([
        CASE WHEN cer_mean >= 80 THEN 'CER>=80%' END, CASE WHEN rtf_mean >= 2.0 THEN 'RTF>=2.0' END,
        CASE WHEN high_severity_rate > 0 THEN 'Có severity=high' END,
        CASE WHEN cer_std >= 10 THEN 'CER std>=10' END,
        CASE WHEN tier_changes THEN 'Đổi hạng chất lượng giữa các run' END,
        CASE WHEN cer_mean >= tc THEN 'Top tail CER' END,
        CASE WHEN cer_std >= ts AND cer_std > 0 THEN 'Top tail bất ổn' END,
        CASE WHEN high_severity_rate >= th AND high_severity_rate > 0 THEN 'Top tail severity high' END,
        CASE WHEN rtf_mean >= tr THEN 'Top tail RTF' END], lambda x: x IS NOT NULL) AS t
    FROM files f JOIN tails USING (engine) WHERE NOT (NOT has_timestamp AND coalesce(cer_mean, 0) = 0)),
cases AS (SELECT engine, file, array_to_string(t, ', ') AS triggers, len(t) AS n_triggers,
    cer_mean, cer_std, rtf_mean, high_severity_rate FROM hits WHERE len(t) > 0)"""
CASE_COLUMNS = """engine, file, triggers, n_triggers, round(cer_mean, 6) AS cer_mean, round(cer_std, 6) AS cer_std,
    round(rtf_mean, 6) AS rtf_mean, round(high_severity_rate, 6) AS high_severity_rate"""
WORST = "n_triggers DESC, cer_mean DESC, cer_std DESC, high_severity_rate DESC, engine, file"


def cases(spark, root):
    return triage.poor_cases(rollup.file_grain(judged(spark, root)))


def case_columns(df):
    return rounded(
        df.select(
            "engine", "file", F.array_join("triggers", ", ").alias("triggers"), "n_triggers",
            "cer_mean", "cer_std", "rtf_mean", "high_severity_rate",
        )
    )


@query("tail_thresholds", with_sql(*FILES, body=CASES + """
SELECT engine, round(tc, 6) AS cer_tail, round(ts, 6) AS std_tail, round(th, 6) AS high_tail,
    round(tr, 6) AS rtf_tail FROM tails"""))
def tail_thresholds(spark, root):
    return rounded(triage.tail_thresholds(rollup.file_grain(judged(spark, root))))


@query("poor_cases", with_sql(*FILES, body=CASES + f"SELECT {CASE_COLUMNS} FROM cases"))
def poor_cases(spark, root):
    return case_columns(cases(spark, root))


@query("worst_cases", with_sql(*FILES, body=CASES + f"""
SELECT {CASE_COLUMNS} FROM (SELECT * FROM cases ORDER BY {WORST} LIMIT 12)"""))
def worst_cases(spark, root):
    return case_columns(cases(spark, root).orderBy(*triage.worst_first()).limit(12))


@query("worst_cases_per_engine", with_sql(*FILES, body=CASES + f"""
SELECT {CASE_COLUMNS}, place FROM (SELECT *, CAST(row_number() OVER (PARTITION BY engine ORDER BY {WORST}) AS INTEGER)
    AS place FROM cases) WHERE place <= 4"""))
def worst_cases_per_engine(spark, root):
    return rounded(triage.top_per_engine(cases(spark, root), 4).select(
        "engine", "file", F.array_join("triggers", ", ").alias("triggers"), "n_triggers",
        "cer_mean", "cer_std", "rtf_mean", "high_severity_rate", "place",
    ))


@query("least_stable_files", with_sql(*FILES, body="""
SELECT engine, file, round(cer_std, 6) AS cer_std FROM (
    SELECT * FROM files ORDER BY cer_std DESC NULLS LAST, engine DESC, file DESC LIMIT 8)"""))
def least_stable_files(spark, root):
    files = rollup.file_grain(judged(spark, root))
    top = files.orderBy(F.desc_nulls_last("cer_std"), F.desc("engine"), F.desc("file")).limit(8)
    return rounded(top.select("engine", "file", "cer_std"))


@query("high_severity_files", with_sql(*FILES, body="""
SELECT engine, file, round(high_severity_rate, 6) AS high_severity_rate, artifact FROM (
    SELECT *, lower(file) LIKE '%silence%' OR lower(file) LIKE '%noise%' AS artifact,
        row_number() OVER (PARTITION BY lower(file) LIKE '%silence%' OR lower(file) LIKE '%noise%'
            ORDER BY high_severity_rate DESC, engine DESC, file DESC) AS place
    FROM files) WHERE artifact OR (high_severity_rate > 0 AND place <= 10)"""))
def high_severity_files(spark, root):
    from ..functions.grading import is_silence

    files = rollup.file_grain(judged(spark, root)).withColumn("artifact", is_silence(F.col("file")))
    main = files.filter(~F.col("artifact") & (F.col("high_severity_rate") > 0)).orderBy(
        F.desc("high_severity_rate"), F.desc("engine"), F.desc("file")
    ).limit(10)
    columns = ["engine", "file", "high_severity_rate", "artifact"]
    return rounded(main.select(*columns).unionByName(files.filter("artifact").select(*columns)))
