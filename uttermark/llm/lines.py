"""Fuzzy line deduplication by MinHash, with DataFrame functions alone.

Lines are compared lower-case and trimmed, as sets of five characters at every position of
the whole line. Equal lines are one node from the start. Which lines may be alike is told
by MinHash signatures of fewer shingles: eight characters from the start of each word, and
from each further position of a run without white space, so that links, JSON and scripts
without spaces are covered as well. One pair of hashes for each shingle gives all values, by
rotation of one against the other. Lines that meet in a band bucket are verified exactly on
their whole sets against the bucket's most connected line, then across the components this
leaves apart in a bucket. Sketches of the whole sets tell first which of these pairs cannot
be linked; where very many lines of a bucket are apart, rare shingles bring them together
(see ``minhash.prefix_pairs``). Of all
lines of a component, the first by document id and line number stays.

Defined cases: a null text stays null; blank lines stay where they are and match nothing;
a line of fewer than five characters is one shingle. A document that loses all its lines
keeps an empty text. Rows that repeat both id and text keep the same lines, as one document does.
A null id comes after all others. Lines of any length are read whole. An empty table gives
none. Extra columns stay
with ``dedup_lines``. Lines and shingles are told apart by 64-bit hashes.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from .common import broadcast_if_small, components, discard, table, written
from .minhash import prefix_pairs
from .registry import query

NUM, DEN = 4, 5
BANDS, ROWS = 12, 4
EVERY = 5
#: Where the shingles of signatures begin: at words, and further inside long runs.
#: A match takes a word's start or one further sign, and the white space behind it.
SIGNED = r"(?s)(?=(\S.{0,7}+))(?:(?<!\S)\S{1,8}+|\S)\s*+"
#: 64-bit words of a line's sketch.
WORDS = 32
#: So many shingles of a line share a row, as each row renews all words of its sketch.
CHUNK = 8
#: In buckets with at most so many lines outside the largest component, the sketches of these
#: meet all others of the bucket; in the rest pairs come by prefixes.
SMALL = 1024


def _lines(docs: DataFrame):
    """(k1, k2, doc_id, pos, line, h) of all lines that are not blank."""
    # An outer explode: of a plain one, Spark would split every text twice.
    return (
        docs.select(
            "doc_id",
            F.xxhash64(F.lit(1), "doc_id", "text").alias("k1"),
            F.xxhash64(F.lit(2), "text", "doc_id").alias("k2"),
            F.posexplode_outer(F.split(F.lower("text"), "\n")).alias("pos", "line"),
        )
        .withColumn("line", F.trim("line"))
        .filter("line rlike '\\\\S'")
        .withColumn("h", F.xxhash64("line"))
    )


def _shingles(line, every: int):
    """Hashes of ``every`` characters at every position; a shorter line is one itself. In
    four bytes a character, each position is found without a walk through the line."""

    def hashes(signs):
        last = F.greatest(F.length(signs) - 4 * every + 1, F.lit(1))
        starts = F.sequence(F.lit(1), last, F.lit(4))
        return F.transform(starts, lambda i: F.xxhash64(F.substr(signs, i, F.lit(4 * every))))

    # Inside a lambda function the line is encoded once, not for each position.
    return F.transform(F.array(F.encode(line, "UTF-32")), hashes)[0]


def _signatures(lines: DataFrame) -> DataFrame:
    """(h, m, bands) of each distinct line and its number of rows. Lines are brought together first, in the one
    exchange, and minima are taken where they arrive. Two hashes of a shingle, one rotated
    against the other, give as many 64-bit values as asked, and each value two halves."""
    values = BANDS * ROWS
    distinct = lines.groupBy("h").agg(
        F.any_value("line").alias("line"), F.count(F.lit(1)).alias("m")
    )
    each = distinct.select(
        "h", "m", F.explode_outer(F.regexp_extract_all("line", F.lit(SIGNED), F.lit(1))).alias("s")
    ).select("h", "m", F.xxhash64("s").alias("x"), F.xxhash64(F.lit(7), "s").alias("y"))

    def turned(i: int):
        if i == 0:
            return F.col("x").bitwiseXOR(F.col("y"))
        around = F.shiftleft("y", i).bitwiseOR(F.shiftrightunsigned("y", 64 - i))
        return F.col("x").bitwiseXOR(around)

    hashes = each.select("h", "m", *[turned(i).alias(f"x{i}") for i in range((values + 1) // 2)])
    low = F.lit(0xFFFFFFFF)
    halves = [
        half
        for i in range((values + 1) // 2)
        for half in (F.shiftright(f"x{i}", 32), F.col(f"x{i}").bitwiseAND(low))
    ]
    minima = hashes.groupBy("h").agg(
        F.max("m").alias("m"), *[F.min(v).alias(f"m{i}") for i, v in enumerate(halves[:values])]
    )
    return minima.select(
        "h",
        "m",
        F.array(
            *[
                F.xxhash64(F.lit(b), *[f"m{b * ROWS + r}" for r in range(ROWS)])
                for b in range(BANDS)
            ]
        ).alias("bands"),
    )


def _sketches(texts: DataFrame, every: int) -> DataFrame:
    """(node, sketch, size) of lines (node, line), with the size of the line's set. Each
    shingle sets one bit of the sketch, so no more bits of two sketches differ than
    shingles of the two lines."""
    sets = texts.select("node", F.array_distinct(_shingles(F.col("line"), every)).alias("set"))
    # An outer explode: of a plain one, Spark would work out every set twice.
    starts = F.sequence(F.lit(0), F.greatest(F.size("set") - 1, F.lit(0)), F.lit(CHUNK))
    chunks = sets.select("node", "set", F.size("set").alias("n"), F.explode_outer(starts).alias("at"))
    # A last chunk that is not full repeats its first shingle.
    each = chunks.select(
        "node",
        "n",
        *[F.coalesce(F.get("set", F.col("at") + j), F.get("set", "at")).alias(f"x{j}") for j in range(CHUNK)],
    )
    bits = each.select(
        "node",
        "n",
        *[F.expr(f"shiftrightunsigned(x{j}, 6) & {WORDS - 1}").alias(f"w{j}") for j in range(CHUNK)],
        *[F.expr(f"shiftleft(1L, cast(x{j} & 63 AS int))").alias(f"b{j}") for j in range(CHUNK)],
    )
    words = [
        F.bit_or(F.expr(" | ".join(f"if(w{j} = {i}, b{j}, 0L)" for j in range(CHUNK)))) for i in range(WORDS)
    ]
    return bits.groupBy("node").agg(F.array(*words).alias("sketch"), F.max("n").cast("bigint").alias("size"))


def _with_both(pairs: DataFrame, values: DataFrame, name: str, size: str | None = None) -> DataFrame:
    """``pairs`` (a, b) with this value of both as sa and sb, and this size as na and nb."""
    for end in "ab":
        more = [F.col(size).alias(f"n{end}")] if size else []
        pairs = pairs.join(values.select(F.col("node").alias(end), F.col(name).alias(f"s{end}"), *more), end)
    return pairs


def line_components(
    docs: DataFrame, num: int = NUM, den: int = DEN, every: int = EVERY
) -> DataFrame:
    """(node, component) for every line hash that occurs more than once or is linked to
    that of another line."""
    lines = _lines(docs)
    signatures = written(_signatures(lines), "signatures")
    entries = signatures.select(F.explode("bands").alias("bucket"), F.col("h").alias("node"))
    buckets = written(
        entries.groupBy("bucket").agg(F.count(F.lit(1)).alias("m")).filter("m > 1"), "buckets"
    )
    copies = written(signatures.filter("m > 1").select(F.col("h").alias("node")), "copies")
    everyone = written(entries.join(broadcast_if_small(buckets), "bucket"), "everyone")
    discard(signatures, buckets)
    # A line that meets many others is the closest thing to what they are copies of: the
    # bucket's line of most meetings is the one that the others are compared with.
    together = written(
        everyone.groupBy("node").agg(F.sum("m").alias("meetings")), "together"
    )
    pivots = (
        everyone.join(together, "node")
        .groupBy("bucket")
        .agg(F.max(F.struct("meetings", "node")).alias("top"))
        .select("bucket", F.col("top.node").alias("pivot"))
    )
    members = written(
        everyone.drop("m").join(written(pivots, "pivots"), "bucket").filter("node <> pivot"),
        "members",
    )
    discard(everyone)
    texts = written(
        lines.join(broadcast_if_small(together.select("node")), F.col("h") == F.col("node"))
        .groupBy("node")
        .agg(F.any_value("line").alias("line")),
        "texts",
    )
    sketches = written(_sketches(texts, every), "sketches")

    def alike(x: str, y: str, nx: str, ny: str):
        """Whether lines of these sketches and sizes can be linked."""
        apart = sum(F.bit_count(F.col(x)[i].bitwiseXOR(F.col(y)[i])) for i in range(WORDS))
        return (den * F.least(nx, ny) >= num * F.greatest(nx, ny)) & (
            (num + den) * apart <= (den - num) * (F.col(nx) + F.col(ny))
        )

    def confirmed(likely: DataFrame) -> DataFrame:
        """The links among pairs (a, b) with the sum of their sizes. Lines travel as texts,
        which take an eighth of their shingles."""
        sa, sb = (_shingles(F.col(line), every) for line in ("sa", "sb"))
        # Written before they are compared: a filter would work out the shingles of a line twice.
        counted = written(
            _with_both(likely, texts, "line").select(
                "a", "b", "sizes", F.size(F.array_intersect(sa, sb)).alias("shared")
            ),
            "counted",
        )
        return counted.filter((num + den) * F.col("shared") >= num * F.col("sizes")).select("a", "b")

    met = members.select(F.col("pivot").alias("a"), F.col("node").alias("b")).distinct()
    likely = _with_both(met, sketches, "sketch", "size").filter(alike("sa", "sb", "na", "nb"))
    first = confirmed(written(likely.select("a", "b", F.expr("na + nb AS sizes")), "likely"))
    known = components(first)
    # All members have met one line of their bucket. Only buckets with members in
    # several components are left.
    placed = written(
        members.select("bucket", "node")
        .join(known, "node", "left")
        .select("bucket", "node", F.coalesce("component", "node").alias("component")),
        "placed",
    )
    apart = written(
        placed.groupBy("bucket", "component")
        .agg(F.count(F.lit(1)).alias("m"))
        .groupBy("bucket")
        .agg(F.max(F.struct("m", "component")).alias("top"), F.sum("m").alias("all"))
        .filter("top.m < all")
        .select("bucket", F.col("top.component").alias("main"), F.expr("all - top.m AS others")),
        "apart",
    )
    rest = written(placed.join(apart, "bucket"), "rest")
    discard(members)
    few = rest.filter(F.col("others") <= SMALL).join(sketches, "node")
    within = few.filter("component <> main").select(
        "bucket", "main", F.col("node").alias("a"), F.col("component").alias("ca"),
        F.col("sketch").alias("sa"), F.col("size").alias("na"),
    ).join(
        few.select(
            F.col("bucket").alias("same"), F.col("node").alias("b"), F.col("component").alias("cb"),
            F.col("sketch").alias("sb"), F.col("size").alias("nb"),
        ),
        (F.col("bucket") == F.col("same"))
        & (F.col("ca") != F.col("cb"))
        & ((F.col("cb") == F.col("main")) | (F.col("a") < F.col("b")))
        & alike("sa", "sb", "na", "nb"),
    )
    many = written(
        rest.filter(F.col("others") > SMALL).select("node", "component").distinct(), "many"
    )
    sets = texts.join(broadcast_if_small(many), "node").select(
        "node", "component", F.array_distinct(_shingles(F.col("line"), every)).alias("set")
    )
    across = prefix_pairs(
        written(
            sets.select(
                "node", "component", F.size("set").cast("bigint").alias("n"),
                F.explode_outer("set").alias("shingle"),
            ),
            "entries",
        ),
        num,
        den,
        sketches,
        alike("sketch", "sa", "size", "la"),
    )
    across = _with_both(across, sketches, "size").withColumn("sizes", F.expr("sa + sb"))
    pairs = within.select("a", "b", F.expr("na + nb AS sizes")).unionByName(across.drop("sa", "sb"))
    pairs = pairs.select(
        F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b"), "sizes"
    ).distinct()
    linked = components(first.unionByName(confirmed(written(pairs, "across"))))
    return copies.join(linked, "node", "full").select(
        "node", F.coalesce("component", "node").alias("component")
    )


def dedup_lines(
    docs: DataFrame,
    num: int = NUM,
    den: int = DEN,
    counts: tuple = ("n_lines", "n_removed"),
    every: int = EVERY,
) -> DataFrame:
    """``docs`` (doc_id, text and any other columns) with a text that holds only the lines
    that stay, and with the numbers of all and of removed lines (columns named like these
    ``counts`` are replaced). ``every`` is the length of a shingle."""
    rows = docs.drop(*counts)
    reached = written(line_components(rows.select("doc_id", "text"), num, den, every), "reached")
    # All other lines stay in any case.
    places = written(
        _lines(rows.select("doc_id", "text"))
        .select("doc_id", "k1", "k2", "pos", "h")
        .join(broadcast_if_small(reached), F.col("h") == F.col("node"))
        .select("doc_id", "k1", "k2", "pos", "component"),
        "places",
    )
    order = F.struct(F.col("doc_id").isNull().alias("last"), "doc_id", "k1", "k2", "pos")
    firsts = written(
        places.groupBy("component")
        .agg(F.min(order).alias("first"), F.count(F.lit(1)).alias("m"))
        .filter("m > 1")
        .select("component", F.struct("first.k1", "first.k2", "first.pos").alias("first")),
        "firsts",
    )
    gone = written(
        places.join(broadcast_if_small(firsts), "component")
        .filter(F.struct("k1", "k2", "pos") != F.col("first"))
        .groupBy("k1", "k2")
        .agg(F.collect_set("pos").alias("gone")),
        "gone",
    )
    keyed = rows.withColumns(
        {
            "_k1": F.xxhash64(F.lit(1), "doc_id", "text"),
            "_k2": F.xxhash64(F.lit(2), "text", "doc_id"),
        }
    )
    removed = gone.select(F.col("k1").alias("_k1"), F.col("k2").alias("_k2"), F.col("gone").alias("_gone"))
    joined = keyed.join(broadcast_if_small(removed, size=64 + 4 * F.size("_gone")), ["_k1", "_k2"], "left").withColumn(
        "_lines", F.split("text", "\n")
    )
    stay = F.array_except(F.sequence(F.lit(0), F.size("_lines") - 1), F.col("_gone"))
    text = F.when(F.col("_gone").isNull(), F.col("text")).otherwise(
        F.array_join(F.transform(stay, lambda i: F.col("_lines")[i]), "\n")
    )
    return joined.select(
        *[text.alias(c) if c == "text" else F.col(c) for c in rows.columns],
        F.greatest(F.size("_lines"), F.lit(0)).cast("bigint").alias(counts[0]),
        F.coalesce(F.size("_gone"), F.lit(0)).cast("bigint").alias(counts[1]),
    )


SQL = r"""
WITH RECURSIVE r AS (
  SELECT doc_id, unnest(string_split(text, chr(10))) AS raw,
    generate_subscripts(string_split(text, chr(10)), 1) AS pos FROM documents),
l AS (SELECT *, CASE WHEN regexp_matches(raw, '\S') THEN trim(lower(raw), ' ') END AS line FROM r),
d AS (SELECT line, row_number() OVER (ORDER BY line) AS node FROM (
  SELECT DISTINCT line FROM l WHERE line IS NOT NULL)),
v AS (SELECT DISTINCT node, hash(substring(line, i, 5)) AS g FROM (
  SELECT node, line, unnest(range(1, greatest(length(line) - 3, 2))) AS i FROM d)),
s AS (SELECT node, list(g) AS s, count(*) AS n FROM v GROUP BY node),
x AS (SELECT node, n, g FROM v JOIN s USING (node)),
f AS (SELECT g, count(*) AS df FROM x GROUP BY g HAVING count(*) > 1),
-- Lines that are alike share a rare shingle; all others of the two are compared after.
y AS (SELECT node, n, g, row_number() OVER (PARTITION BY node ORDER BY coalesce(df, 1), g) AS k FROM x LEFT JOIN f USING (g)),
u AS (SELECT y.* FROM y JOIN f USING (g) WHERE k <= n - (4 * n + 4) // 5 + 1),
z AS (SELECT DISTINCT a.node AS a, b.node AS b FROM u a JOIN u b ON a.g = b.g AND a.k <= a.n - (8 * a.n + 8) // 9 + 1
  AND (a.n < b.n OR a.n = b.n AND a.node < b.node) AND 5 * a.n >= 4 * b.n),
p AS (SELECT z.a, z.b FROM z JOIN s sa ON sa.node = z.a JOIN s sb ON sb.node = z.b
  WHERE 9 * len(list_intersect(sa.s, sb.s)) >= 4 * (len(sa.s) + len(sb.s))),
e AS (SELECT a, b FROM p UNION ALL SELECT b, a FROM p),
t(node, reached) AS (
  SELECT node, node FROM d UNION SELECT t.node, e.b FROM t JOIN e ON t.reached = e.a),
k AS (SELECT node, min(reached) AS component FROM t GROUP BY node),
o AS (SELECT l.*, line IS NULL OR row_number() OVER (PARTITION BY component ORDER BY doc_id, pos) = 1 AS stays
  FROM l LEFT JOIN d USING (line) LEFT JOIN k USING (node))
SELECT doc_id, coalesce(string_agg(raw, chr(10) ORDER BY pos) FILTER (stays), '') AS text,
  count(*) AS n_lines, count(*) FILTER (NOT stays) AS n_removed
FROM o GROUP BY doc_id
"""


@query("op4_line_dedup", SQL)
def op4(spark, sf_dir):
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return dedup_lines(docs)
