"""Text functions: every one takes and returns a Column and stays in the JVM."""

from __future__ import annotations

from pyspark.sql import Column, functions as F

# The punctuation the normaliser deletes, and the white space that
# Python's str.split() knows.
PUNCTUATION = "、。！？（）…「」,. :;[]{}()'\""
WHITESPACE = (
    "\t\n\x0b\x0c\r\x1c\x1d\x1e\x1f \x85\xa0\u1680\u2000\u2001\u2002\u2003\u2004\u2005"
    "\u2006\u2007\u2008\u2009\u200a\u2028\u2029\u202f\u205f\u3000"
)

# Full-width forms U+FF01..U+FF5E lie at a constant distance from ASCII 0x21..0x7E;
# those among the punctuation are deleted, the rest is folded.
FULL_WIDTH = "".join(c for c in map(chr, range(0xFF01, 0xFF5F)) if c not in PUNCTUATION)
HALF_WIDTH = "".join(chr(ord(c) - 0xFEE0) for c in FULL_WIDTH)

NUMBER = r"^\s*[+-]?(\d+\.?\d*|\.\d+)([eE][+-]?\d+)?\s*$"
RUN_ID = r"^(\d{2})-(\d{2})-(\d{4})_v(\d+)$"


def normalize_text(text: Column) -> Column:
    """Drop punctuation and white space, fold full-width forms, lower-case.

    ASCII ``!`` and ``?`` stay; a full-width comma survives as ``,`` because
    folding comes after deletion. NULL becomes ``''``.
    """
    # One pass: translate deletes the characters that have no counterpart.
    deleted = PUNCTUATION + WHITESPACE
    return F.lower(
        F.translate(F.coalesce(text, F.lit("")), FULL_WIDTH + deleted, HALF_WIDTH)
    )


def file_stem(name: Column) -> Column:
    """Last path component without its last suffix (a leading dot is no suffix)."""
    base = F.regexp_extract(F.regexp_replace(F.coalesce(name, F.lit("")), r"(/\.?)+$", ""), "([^/]*)$", 1)
    return F.regexp_replace(base, r"(?<=.)\.[^.]*$", "")


def canonical_stem(name: Column) -> Column:
    """Matching key of a file name: lower-case ``[a-z0-9]`` words joined by ``_``."""
    words = F.regexp_replace(F.lower(file_stem(name)), "[^a-z0-9]+", "_")
    return F.regexp_replace(words, "^_+|_+$", "")


#: Texts up to this length take the plain matrix; in longer ones one edit in so many code
#: points, but no more than this, is followed along the diagonals, which is where that costs
#: what the matrix does; then these widths of a band are tried.
PLAIN_LENGTH, PER_EDIT, EDITS, BANDS = 256, 48, 512, (2048, 16384)


def _equal_run(a: Column, b: Column, i: Column, j: Column, most: Column) -> Column:
    """Code points that are equal from ``i`` in ``a`` and ``j`` in ``b`` on, at most ``most``;
    both are binary, four bytes each. Halves are compared as wholes, and where the first
    sixteen differ, as on most diagonals, only those are looked at."""

    def longer(n: Column, more: Column) -> Column:
        piece = lambda x, at: F.substring(x, (at + n) * 4 + 1, more * 4)
        return F.when((n + more <= most) & (piece(a, i) == piece(b, j)), n + more).otherwise(n)

    def halves(top: int) -> Column:
        return F.aggregate(F.array(*[F.lit(1 << x) for x in range(top, -1, -1)]), F.lit(0), longer)

    same = F.substring(a, i * 4 + 1, F.lit(64)) == F.substring(b, j * 4 + 1, F.lit(64))
    return F.when(same, halves(27)).otherwise(halves(3))


def _edits_by_diagonals(a: Column, b: Column) -> Column:
    """Distance of two UTF-32 binaries if it is small beside their length, else NULL.

    The front holds for each diagonal how far down it e edits lead at most. It grows by one
    edit to all sides and then slides along equal text, so the cost is that of the length
    plus the square of the distance.
    """
    n, m = (F.octet_length(x) / 4 for x in (a, b))
    n, m = n.cast("int"), m.cast("int")
    edits = F.least(F.lit(EDITS), (F.greatest(n, m) / PER_EDIT).cast("int"))

    def slid(row: Column, k: Column) -> Column:
        return row + _equal_run(a, b, row, row + k, F.least(n - row, m - row - k))

    def grown(state: Column, e: Column) -> Column:
        before = state["front"]

        def furthest(k: Column) -> Column:
            near = [F.get(before, k + e - 2), F.get(before, k + e - 1) + 1, F.get(before, k + e) + 1]
            row = F.least(F.greatest(*near), n, m - k)
            return F.when(row >= F.greatest(F.lit(0), -k), slid(row, k))

        front = F.transform(F.sequence(-e, e), furthest)
        return F.when(state["found"].isNull(), at_end(front, e)).otherwise(state)

    def at_end(front: Column, e: Column) -> Column:
        checked = lambda f: F.struct(
            f.alias("front"), F.when(F.get(f, m - n + e) >= n, e).alias("found")
        )
        return F.transform(F.array(front), checked)[0]

    start = at_end(F.array(slid(F.lit(0), F.lit(0))), F.lit(0))
    reached = F.aggregate(F.sequence(F.lit(1), edits), start, grown, lambda s: s["found"])
    return F.when(F.abs(n - m) <= edits, reached)


def edit_distance(a: Column, b: Column) -> Column:
    """Levenshtein distance in code points, NULL if a side is. Exact.

    Long texts do not fill a matrix of length x length: see ``_edits_by_diagonals``; beyond
    its reach bands along the diagonal come first where they are narrow beside the text.
    """

    def distance(t: Column) -> Column:
        a, b = t["a"], t["b"]
        longest = F.greatest(F.length(a), F.length(b))
        bands = [
            F.when(longest > 8 * k, F.nullif(F.levenshtein(a, b, k), F.lit(-1))) for k in BANDS
        ]
        near = F.transform(
            F.array(F.struct(F.encode(a, "UTF-32").alias("a"), F.encode(b, "UTF-32").alias("b"))),
            lambda x: _edits_by_diagonals(x["a"], x["b"]),
        )[0]
        return F.coalesce(near, *bands, F.levenshtein(a, b))

    # One-element transforms evaluate what they are given once per row.
    long = F.greatest(F.length(a), F.length(b)) > PLAIN_LENGTH
    found = F.transform(F.array(F.struct(a.alias("a"), b.alias("b"))), distance)[0]
    return F.when(a.isNull() | b.isNull(), None).when(long, found).otherwise(F.levenshtein(a, b))


def char_error_rate(hyp: Column, ref: Column) -> Column:
    """Edit distance over reference length; an empty reference scores 0 or 1.

    Both sides should already be normalised. The distance counts code points.
    """
    return (
        F.when(F.length(ref) > 0, edit_distance(hyp, ref) / F.length(ref))
        .when(F.length(hyp) > 0, F.lit(1.0))
        .otherwise(F.lit(0.0))
    )


def repetition_factor(text: Column, n: int = 3) -> Column:
    """How often three or more equal character n-grams follow one another.

    Equal neighbouring n-grams mean one repeated character, so the count is that
    of maximal same-character stretches of at least ``n + 2`` characters.
    """
    stretch = F.lit(r"(?s)(.)\1{%d,}" % (n + 1))
    return F.coalesce(F.regexp_count(text, stretch), F.lit(0))


def char_ngrams(text: Column, n: int = 3) -> Column:
    """Array of all character n-grams, in order; empty when the text is shorter."""
    chars = F.filter(F.split(text, ""), lambda c: c != "")

    def grams(cs: Column) -> Column:
        starts = F.when(
            F.size(cs) >= n, F.sequence(F.lit(1), F.size(cs) - (n - 1))
        ).otherwise(F.array().cast("array<int>"))
        return F.transform(starts, lambda i: F.array_join(F.slice(cs, i, F.lit(n)), ""))

    # The outer one-element transform evaluates the split once per row, not per n-gram.
    return F.flatten(F.transform(F.array(chars), grams))


def to_number(text: Column) -> Column:
    """DOUBLE of a plain decimal text, NULL for anything else."""
    return F.when(text.rlike(NUMBER), F.trim(text).try_cast("double"))


def parse_percent(text: Column) -> Column:
    """``'65.49%'`` or ``'65.49'`` -> 65.49; anything else -> NULL."""
    return to_number(F.regexp_replace(F.trim(text), "%$", ""))


def parse_cer(text: Column) -> Column:
    """``'65.49%'`` -> 0.6549; ``'N/A'`` and other text -> NULL."""
    return to_number(F.replace(text, F.lit("%"), F.lit(""))) / 100


def percent_text_basis_points(text: Column) -> Column:
    """CER text that ends in ``%`` as whole hundredths of a percent, else NULL.

    The source stores two decimals, so the integer is lossless and its sums do
    not depend on the order in which partitions arrive.
    """
    return F.when(
        text.endswith("%"), F.round(to_number(F.rtrim(text, F.lit("%"))) * 100)
    ).cast("bigint")


def round_exact(value: Column, digits: int) -> Column:
    """The DOUBLE nearest to the decimal that is nearest to the exact binary value, exact
    ties to even. ``round`` and ``bround`` decide on the shortest decimal text instead.

    ``low`` is what the product loses to rounding, by Dekker's split of both factors into
    halves; it tells on which side of the tie a product lies that looks like one.
    """
    scale = float(10**digits)
    value = value.cast("double")
    product = value * scale
    half = value * 134217729.0
    top = half - (half - value)
    rest = value - top
    scale_top = scale * 134217729.0 - (scale * 134217729.0 - scale)
    scale_rest = scale - scale_top
    low = ((top * scale_top - product) + top * scale_rest + rest * scale_top) + rest * scale_rest
    floor = F.floor(product)
    over = product - floor
    up = (over > 0.5) | (
        (over == 0.5) & ((low > 0) | ((low == 0) & (F.pmod(floor, F.lit(2)) == 1)))
    )
    rounded = (floor + F.when(up, 1).otherwise(0)) / scale
    # From 2^50 on the spacing of doubles leaves nothing to round.
    return F.when(F.abs(product) < 2.0**50, rounded).otherwise(value)


def fixed_text(value: Column, digits: int, sign: bool = False) -> Column:
    """Text with a fixed number of decimals, rounded like ``round_exact``."""
    form = f"%{'+' if sign else ''}.{digits}f"
    rounded = round_exact(value, digits)
    # A negative value that rounds to zero keeps its sign.
    return F.when((rounded == 0) & (value < 0), "-" + f"%.{digits}f" % 0).otherwise(
        F.format_string(form, rounded)
    )


def percent_text(fraction: Column) -> Column:
    """Fraction -> two-decimal percent text, the stored form of a CER."""
    return F.concat(fixed_text(fraction * 100, 2), F.lit("%"))


def transcript_hash(text: Column) -> Column:
    return F.substring(F.sha2(F.coalesce(text, F.lit("")), 256), 1, 12)


def run_key(run_id: Column) -> Column:
    """Sortable struct (year, month, day, version); all zero for other names."""

    def part(group: int) -> Column:
        return F.coalesce(F.regexp_extract(run_id, RUN_ID, group).try_cast("int"), F.lit(0))

    return F.struct(
        part(3).alias("year"),
        part(2).alias("month"),
        part(1).alias("day"),
        part(4).alias("version"),
    )


def run_id_of(day: Column, version: Column) -> Column:
    return F.concat(F.date_format(day, "dd-MM-yyyy"), F.lit("_v"), version.cast("string"))


def clock_text(ts: Column) -> Column:
    return F.date_format(ts, "HH:mm:ss.SSS")


def timed_aliases(stem: Column) -> Column:
    """Names a timed reference may carry, best first."""
    return F.array(
        stem,
        F.replace(stem, F.lit(" (1)"), F.lit("_(1)")),
        F.replace(stem, F.lit("_(1)"), F.lit(" (1)")),
    )


def segment_aliases(stem: Column) -> Column:
    """Names a speaker-segment file may carry, best first."""
    return F.array(
        stem,
        F.replace(stem, F.lit(" (1)"), F.lit("")),
        F.replace(stem, F.lit("_(1)"), F.lit("")),
    )


def excerpt(text: Column, lines: int = 3) -> Column:
    """First non-blank lines, trimmed and joined by a space."""
    trimmed = F.transform(F.split(text, r"\r\n|\r|\n"), lambda x: F.trim(x))
    return F.array_join(F.slice(F.filter(trimmed, lambda x: x != ""), 1, lines), " ")


def escape_cell(text: Column) -> Column:
    """Make a text safe inside a Markdown table cell."""
    return F.replace(F.replace(text, F.lit("|"), F.lit("\\|")), F.lit("\n"), F.lit(" "))


def verdict_cell(has_hallucination: Column, cer_text: Column) -> Column:
    return F.concat(
        F.when(has_hallucination, F.lit("H")).otherwise(F.lit("OK")),
        F.lit(" ("),
        F.coalesce(cer_text, F.lit("")),
        F.lit(")"),
    )


def log_line(clock: Column, conn: Column, message: Column) -> Column:
    return F.concat(F.lit("["), clock, F.lit("]["), conn, F.lit("] "), message)


def parse_log_line(line: Column) -> Column:
    """``[clock][conn] event  key=value  key=value`` -> struct(clock, conn, event, fields)."""
    head = r"^\[([^\]]*)\]\[([^\]]*)\] (\S*)\s*(.*)$"
    rest = F.regexp_extract(line, head, 4)
    return F.struct(
        F.regexp_extract(line, head, 1).alias("clock"),
        F.regexp_extract(line, head, 2).alias("conn"),
        F.regexp_extract(line, head, 3).alias("event"),
        F.when(rest != "", F.str_to_map(rest, F.lit(r"\s+"), F.lit("="))).alias("fields"),
    )


def parse_timed_lines(text: Column) -> Column:
    """``[start - end] SPEAKER n: text`` lines -> array of structs."""
    line = r"^\s*\[\s*([\d.:]+)\s*-\s*([\d.:]+)\s*\]\s*([^:]*):\s*(.*)$"
    rows = F.filter(F.split(text, r"\r\n|\r|\n"), lambda x: x.rlike(line))
    return F.transform(
        rows,
        lambda x: F.struct(
            F.regexp_extract(x, line, 1).alias("start"),
            F.regexp_extract(x, line, 2).alias("end"),
            F.trim(F.regexp_extract(x, line, 3)).alias("speaker"),
            F.trim(F.regexp_extract(x, line, 4)).alias("text"),
        ),
    )


def timed_text(lines: Column) -> Column:
    """Plain text of parsed timed lines, in the order of their start."""
    keyed = F.transform(
        lines, lambda x: F.struct(to_number(x["start"]).alias("start"), x["text"].alias("text"))
    )
    return F.array_join(F.array_sort(keyed)["text"], " ")
