"""Explicit schemas of the files the engine reads."""

from __future__ import annotations

RESULTS_DDL = """
    file string, status string, transcript string, duration double, connect_time double,
    stream_time double, wait_after_commit double, total_time double, total_rtf double,
    inference_rtf double, keepalive_count bigint, chunks_sent bigint, bytes_sent bigint,
    delay_ms bigint, engine string, profile string, rf int, cer string,
    error_type string, error_message string
"""

VERDICT_COLUMNS = (
    "filename", "has_hallucination", "primary_error", "severity", "confidence",
    "review_status", "existing_cer", "existing_rf", "existing_inference_rtf", "reasoning",
    "evidence_hyp_text", "evidence_gt_context",
)
VERDICT_DDL = ", ".join(
    f"{c} " + {"existing_rf": "int", "existing_inference_rtf": "double"}.get(c, "string")
    for c in VERDICT_COLUMNS
)

SUMMARY_DDL = """
    run_dir string, model_used string, total_files bigint, evaluated_files bigint,
    with_gt_timestamped bigint, without_gt_timestamped bigint, hallucination_rate double,
    manual_review_rate double, error_distribution map<string,bigint>,
    severity_distribution map<string,bigint>,
    existing_metrics struct<avg_cer:string, avg_inference_rtf:double, hrs:double>
"""

AUDIO_QUALITY_DDL = """
    file string, avg_rms double, max_rms double, avg_flatness double, avg_centroid double,
    avg_rolloff double, reasons array<string>
"""
