"""Grades, tiers, ratios, trigger lists and labels as Column expressions."""

from __future__ import annotations

from pyspark.sql import Column, functions as F

from .text import round_exact

# Grade labels, tier cut-offs (percent), media suffixes, silence words.
GRADE_S, GRADE_A, GRADE_B, GRADE_F = "S (Excellent)", "A (Good)", "B (Fair)", "F (Fail)"
TIER_GOOD, TIER_FAIR = 20, 50
MEDIA_SUFFIXES = (".mp3", ".wav", ".flac", ".m4a")
SILENCE_WORDS = ("silence", "white_noise", "noise")

# Audio-quality reasons.
REASON_QUIET = "âm thanh bị nhỏ (low volume)"
REASON_NOISY = "âm thanh bị rè (noisy/distorted)"
REASON_NARROW = "bandwidth hẹp (low bandwidth)"

# The nine triage triggers.
TRIGGER_CER = "CER>=80%"
TRIGGER_RTF = "RTF>=2.0"
TRIGGER_HIGH = "Có severity=high"
TRIGGER_STD = "CER std>=10"
TRIGGER_TIER = "Đổi hạng chất lượng giữa các run"
TRIGGER_TAIL_CER = "Top tail CER"
TRIGGER_TAIL_STD = "Top tail bất ổn"
TRIGGER_TAIL_HIGH = "Top tail severity high"
TRIGGER_TAIL_RTF = "Top tail RTF"


def is_success(status: Column) -> Column:
    return F.coalesce(status == "success", F.lit(False))


def is_silence(file: Column) -> Column:
    name = F.lower(F.coalesce(file, F.lit("")))
    hit = F.lit(False)
    for word in SILENCE_WORDS:
        hit = hit | name.contains(word)
    return hit


def is_media(path: Column) -> Column:
    return F.lower(F.regexp_extract(path, r"[^/.][^/]*(\.[^./]+)$", 1)).isin(*MEDIA_SUFFIXES)


def ratio(seconds: Column, duration: Column) -> Column:
    """Real-time factor at three decimals; 0 for an empty recording."""
    return F.when(duration > 0, round_exact(seconds / duration, 3)).otherwise(F.lit(0.0))


def quality_grade(hrs: Column, cer: Column, rtf: Column) -> Column:
    return (
        F.when((hrs == 0) & (cer < 0.01) & (rtf < 0.1), GRADE_S)
        .when((hrs < 0.5) & (cer < 0.03) & (rtf < 0.2), GRADE_A)
        .when((hrs < 2.0) & (cer < 0.10) & (rtf < 0.5), GRADE_B)
        .otherwise(GRADE_F)
    )


def unreferenced_grade(rtf: Column, rf: Column) -> Column:
    return (
        F.when((rtf < 0.2) & (rf == 0), F.lit("A")).when(rtf < 0.5, F.lit("B")).otherwise(F.lit("F"))
    )


def row_grade(
    status: Column, file: Column, hyp: Column, ref: Column, cer: Column, hrs: Column,
    rtf: Column, rf: Column,
) -> Column:
    """Grade of one result row. ``ref`` NULL means that no reference exists."""
    row_hrs = F.when(F.lower(file).contains("silence"), hrs).otherwise(F.lit(0.0))
    return (
        F.when(~is_success(F.coalesce(status, F.lit("success"))), "ERROR")
        .when(ref.isNull(), unreferenced_grade(rtf, rf))
        .when((hyp == "") & (ref != ""), GRADE_F)
        .otherwise(quality_grade(row_hrs, cer, rtf))
    )


def quality_tier(cer_pct: Column) -> Column:
    return (
        F.when(cer_pct.isNull(), "unknown")
        .when(cer_pct <= TIER_GOOD, "good")
        .when(cer_pct <= TIER_FAIR, "fair")
        .otherwise("poor")
    )


def tier_rank(cer_pct: Column) -> Column:
    """The tier as a number, which aggregates without a sort."""
    return (
        F.when(cer_pct.isNull(), 0)
        .when(cer_pct <= TIER_GOOD, 1)
        .when(cer_pct <= TIER_FAIR, 2)
        .otherwise(3)
    )


def audio_reasons(rms: Column, flatness: Column, zcr: Column, rolloff: Column) -> Column:
    return F.array_compact(
        F.array(
            F.when(rms < 0.01, F.lit(REASON_QUIET)),
            F.when((flatness > 0.1) | (zcr > 0.15), F.lit(REASON_NOISY)),
            F.when(rolloff < 4000, F.lit(REASON_NARROW)),
        )
    )


def winner(p_left: Column, p_right: Column, left: str, right: str, tie: str = "tie") -> Column:
    return F.when(p_right > p_left, right).when(p_right < p_left, left).otherwise(tie)


def evidence_or(text: Column, default: str = "(no short excerpt in the verdict)") -> Column:
    return F.coalesce(F.nullif(text, F.lit("")), F.lit(default))


def variation_note(std: Column) -> Column:
    return F.when(std == 0, F.lit("constant over runs")).otherwise(F.lit("varies between runs"))
