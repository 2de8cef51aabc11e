"""Report documents of several tables, as ordered lines."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import compare, rollup, summary
from ..sources import sinks
from .bindings import FILES, JUDGED, LEFT_ENGINE, RIGHT_ENGINE, judged, records, with_sql
from .registry import query

PERCENT = "printf('%.1f%%', {0})"
CI = "printf('%.1f%%', 100 * {0}) || ' … ' || printf('%.1f%%', 100 * {1})"
WILSON = "({0} / n + z * z / (2 * n) {1} z * sqrt(({0} / n * (1 - {0} / n) + z * z / (4 * n)) / n)) / (1 + z * z / n)"


def _interval(k: str) -> str:
    return CI.format(
        f"greatest(0.0, {WILSON.format(k, '-')})", f"least(1.0, {WILSON.format(k, '+')})"
    )


def _head(section: int, title: str, *columns: str) -> str:
    lines = [f"## {title}", "", "| " + " | ".join(columns) + " |", "|" + " --- |" * len(columns)]
    return " UNION ALL ".join(f"SELECT {section} AS section, '{line}' AS row" for line in lines)


ENGINES = ("Engine", "Records", "Runs", "Files", "Hallucination", "95 % CI", "High severity", "95 % CI of it")
SPREAD = ("Engine", "Runs", "Mean of run CERs", "Std of run CERs")
LABELS = ("Engine", "Severities", "Errors")
PAIRS = ("File", "Left RTF", "Right RTF", "Right - left")
CASES = ("Engine", "File", "Mean CER", "Std CER", "High severity")


@query("metrics_document", with_sql(*JUDGED, body=f"""
, c AS (SELECT engine, count(*)::DOUBLE AS n, count(DISTINCT run_id) AS runs, count(DISTINCT file) AS files,
    count(*) FILTER (has_hallucination)::DOUBLE AS k, count(*) FILTER (severity = 'high')::DOUBLE AS h, 1.96::DOUBLE AS z
    FROM judged GROUP BY engine),
r AS (SELECT engine, run_id, avg(cer_bp) / 100 AS m FROM judged GROUP BY engine, run_id),
s AS (SELECT engine, count(*) AS runs, avg(m) AS mean, stddev_pop(m) AS std FROM r GROUP BY engine),
l AS (SELECT engine, 'a' AS kind, severity AS label, count(*) AS n FROM judged GROUP BY ALL
    UNION ALL SELECT engine, 'b', primary_error, count(*) FROM judged GROUP BY ALL),
x AS (SELECT engine, kind, string_agg(label || ':' || n, ', ' ORDER BY n DESC, label) AS mix FROM l GROUP BY engine, kind)
{_head(1, "Engines", *ENGINES)}
UNION ALL SELECT 1, concat('| ', engine, ' | ', n::BIGINT, ' | ', runs, ' | ', files, ' | ', {PERCENT.format('100 * k / n')}, ' | ',
    {_interval('k')}, ' | ', {PERCENT.format('100 * h / n')}, ' | ', {_interval('h')}, ' |') FROM c
UNION ALL {_head(2, "Stability", *SPREAD)}
UNION ALL SELECT 2, concat('| ', engine, ' | ', runs, ' | ', {PERCENT.format('mean')}, ' | ', {PERCENT.format('std')}, ' |') FROM s
UNION ALL {_head(3, "Verdicts", *LABELS)}
UNION ALL SELECT 3, concat('| ', engine, ' | ', a.mix, ' | ', b.mix, ' |') FROM x a JOIN x b USING (engine)
    WHERE a.kind = 'a' AND b.kind = 'b'"""))
def metrics_document(spark, root):
    """Engines with intervals, their stability and the mix of their verdicts."""
    facts = judged(spark, root)
    rates = summary.engine_rates(facts)
    mixes = rollup.mix_text(facts, ["engine"], "severity").withColumnRenamed("mix", "severities").join(
        rollup.mix_text(facts, ["engine"], "primary_error").withColumnRenamed("mix", "errors"), "engine"
    )
    percent = lambda c: sinks.percent_cell(F.col(c) * 100)
    interval = lambda c: sinks.interval_text(F.col(f"{c}_low"), F.col(f"{c}_high"))
    values = ("engine", "records", "runs", "files", percent("hallucination_rate"), interval("hallucination_rate"),
              percent("high_severity_rate"), interval("high_severity_rate"))
    spread = ("engine", "runs", sinks.percent_cell(F.col("cer_mean")), sinks.percent_cell(F.col("cer_std")))
    return sinks.document(
        [
            sinks.Section("Engines", rates, sinks.cells(ENGINES, values), [F.col("engine")]),
            sinks.Section("Stability", rollup.run_stability(facts), sinks.cells(SPREAD, spread), [F.col("engine")]),
            sinks.Section("Verdicts", mixes, sinks.cells(LABELS, ("engine", "severities", "errors")), [F.col("engine")]),
        ]
    ).select("section", "row")


@query("comparison_document", with_sql(*FILES, body=f"""
, l AS (SELECT file, arg_max(status, seq) AS st, arg_max({{'v': coalesce(inference_rtf, 0)}}, seq).v AS v FROM judged WHERE engine = 'click' GROUP BY file),
r AS (SELECT file, arg_max(status, seq) AS st, arg_max({{'v': coalesce(inference_rtf, 0)}}, seq).v AS v FROM judged WHERE engine = 'view' GROUP BY file)
{_head(1, "Files of both engines", *PAIRS)}
UNION ALL SELECT 1, concat('| ', file, ' | ', CASE WHEN l.st = 'success' THEN printf('%.2f', l.v) ELSE 'N/A' END, ' | ',
    CASE WHEN r.st = 'success' THEN printf('%.2f', r.v) ELSE 'N/A' END, ' | ',
    CASE WHEN l.st = 'success' AND r.st = 'success' THEN printf('%+.3f', r.v - l.v) ELSE '-' END, ' |') FROM l FULL JOIN r USING (file)
UNION ALL {_head(2, "All cases", *CASES)}
UNION ALL SELECT 2, concat('| ', engine, ' | `', file, '` | ', coalesce(printf('%.1f%%', cer_mean), 'N/A'), ' | ',
    coalesce(printf('%.1f%%', cer_std), 'N/A'), ' | ', printf('%.1f%%', 100 * high_severity_rate), ' |') FROM files"""))
def comparison_document(spark, root):
    """All files of both engines side by side, then every case, the worst first."""
    facts = judged(spark, root)
    rows = records(spark, root)
    both = compare.compare_runs(
        rows.filter(F.col("engine") == LEFT_ENGINE), rows.filter(F.col("engine") == RIGHT_ENGINE)
    )
    left, right = F.col("left_rtf"), F.col("right_rtf")
    pairs = ("file", sinks.number_text(left, 2), sinks.number_text(right, 2), sinks.signed_text(right - left))
    cases = (
        "engine", F.concat(F.lit("`"), F.col("file"), F.lit("`")), sinks.percent_cell(F.col("cer_mean")),
        sinks.percent_cell(F.col("cer_std")), sinks.percent_cell(F.col("high_severity_rate") * 100),
    )
    worst = [-F.col("cer_mean"), F.col("engine"), F.col("file")]
    return sinks.document(
        [
            sinks.Section("Files of both engines", both, sinks.cells(PAIRS, pairs), [F.col("file")]),
            sinks.Section("All cases", rollup.file_grain(facts), sinks.cells(CASES, cases), worst),
        ]
    ).select("section", "row")
