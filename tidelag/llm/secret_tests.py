"""Secrets: fixed patterns, and strings that a battery of randomness tests cannot tell from noise.

Base spans come from three patterns. Of every run of 16 or more characters that encodings of
bytes use, the smallest alphabet that holds it is inferred, and in that alphabet three tests
are made: chi-squared for uniform characters, runs above and below the middle, and correlation
of neighbours. Each gives a standard score, so for random strings the sum of their squares has a
known distribution, whatever the alphabet and the length; for words it is large.

A string of score s or less is called random. s is at most MOST, which 19 of 20 random strings
keep to, so that few are lost. How many words keep to it too is estimated for each alphabet and
class of lengths: scores between FAR and twice FAR, where random strings hardly ever come, are
words, and words are no denser near 0 than there. s is the highest score at which the share of
false discoveries among all stays below ``rate``. Runs of letters alone are strings like any
other; where the tests have little power, as in short words, a class accepts little or nothing.

SQL functions only; texts are read once. Per row, spans in code points, end exclusive. Null
and empty texts have no spans; repeated rows are counted each; strings of equal score share their
verdict. Empty tables give empty results. Extra columns are ignored. A very long text is one row;
its matches are arrays of that row."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..staging import stage

# The patterns of the base spans.
ASSIGN = (
    "([Pp][Aa][Ss][Ss][Ww][Oo][Rr][Dd]|[Pp][Aa][Ss][Ss][Ww][Dd]|[Ss][Ee][Cc][Rr][Ee][Tt]|[Tt][Oo][Kk][Ee][Nn]|[Aa][Pp][Ii]_?[Kk][Ee][Yy])"
    "[\"']?\\x20*[:=]\\x20*[\"']?([A-Za-z0-9+/_.=-]+)"
)
ACCESS = "AKIA[A-Z0-9]{16,}"
HEX = "[0-9a-f]{24,}"
ASSIGN_LEAST = 6

TOKEN = "[A-Za-z0-9+/_=-]{16,}"
DIGITS, LOWER, UPPER = "0123456789", "abcdefghijklmnopqrstuvwxyz", "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
#: Encodings by what holds the whole run, smallest alphabet first.
ALPHABETS = (
    ("[0-9]+", DIGITS), ("[0-9a-f]+", DIGITS + "abcdef"), ("[0-9A-F]+", DIGITS + "ABCDEF"), ("[a-z]+", LOWER), ("[A-Z]+", UPPER),
    ("[A-Z2-7]+", UPPER + "234567"), ("[a-z0-9]+", DIGITS + LOWER), ("[A-Z0-9]+", DIGITS + UPPER), ("[A-Za-z]+", UPPER + LOWER),
    ("[A-Za-z0-9]+", UPPER + LOWER + DIGITS), ("[A-Za-z0-9+/]+", UPPER + LOWER + DIGITS + "+/"),
)
WEB_ALPHABET = UPPER + LOWER + DIGITS + "-_"
#: Classes of lengths begin here.
LENGTHS = (16, 20, 24, 32, 48, 64)
STEPS, TOP = 10, 200
#: 95 % of random strings score less than MOST, all but one in a thousand less than FAR.
MOST, FAR = 7.4, 16.0
RATE = 0.05
BLOCK = 256


def _running(values: str) -> str:
    """0, then the sums of the first 1, 2, ... numbers. Blocks keep long arrays from being
    copied once per element."""
    sums = "aggregate({0}, array(0), (a, v) -> concat(a, array(element_at(a, -1) + v)))"
    blocks = f"transform(sequence(0, greatest(0, size({values}) - 1) div {BLOCK}), b -> slice({values}, b * {BLOCK} + 1, {BLOCK}))"
    inner = f"transform({blocks}, x -> {sums.format('x')})"
    offsets = sums.format(f"transform({inner}, x -> element_at(x, -1))")
    return (
        f"concat(array(0), flatten(zip_with({inner}, slice({offsets}, 1, size({inner})), "
        "(x, o) -> transform(slice(x, 2, size(x) - 1), v -> v + o))))"
    )


def _matches(rows: DataFrame, name: str, pattern: str) -> DataFrame:
    """Column ``name``: array of (start, text) of all matches. Between matches lie the pieces
    that a split leaves, so the starts are running sums of both lengths."""
    p = F.lit(pattern)
    rows = rows.withColumns({"_hits": F.regexp_extract_all("_text", p, F.lit(0))})
    rows = rows.withColumn("_gaps", F.when(F.size("_hits") > 0, F.split("_text", pattern, -1)))
    steps = "zip_with(transform(_hits, h -> char_length(h)), transform(slice(_gaps, 2, size(_hits)), g -> char_length(g)), (h, g) -> h + g)"
    rows = rows.withColumn("_steps", F.when(F.size("_hits") > 0, F.expr(steps)))
    starts = f"transform({_running('_steps')}, s -> s + char_length(_gaps[0]))"
    pairs = f"zip_with(slice({starts}, 1, size(_hits)), _hits, (s, h) -> struct(s AS start, h AS text))"
    empty = F.expr("CAST(array() AS ARRAY<STRUCT<start: INT, text: STRING>>)")
    return rows.withColumn(name, F.when(F.size("_hits") > 0, F.expr(pairs)).otherwise(empty)).drop("_hits", "_gaps", "_steps")


def _base_spans(rows: DataFrame) -> DataFrame:
    for name, pattern in (("_assign", ASSIGN), ("_access", ACCESS), ("_hex", HEX)):
        rows = _matches(rows, name, pattern)
    value = "regexp_extract(m.text, r'" + ASSIGN.replace("'", "\\x27") + "', 2)"
    long = F.expr(f"filter(_assign, m -> char_length({value}) >= {ASSIGN_LEAST})")
    rows = rows.withColumn("_assign", long)
    span = "transform({0}, m -> struct(m.start AS start, {1} AS rank, '{2}' AS kind, m.start + char_length(m.text) AS end))"
    kinds = (("_assign", 0, "assign"), ("_access", 1, "access"), ("_hex", 2, "hex"))
    return rows.withColumn("base", F.expr(f"array_sort(concat({', '.join(span.format(*k) for k in kinds)}))"))


def _scored(rows: DataFrame) -> DataFrame:
    """tokens: array of (start, end, class, score)."""
    rows = _matches(rows, "_tokens", TOKEN)
    body = "regexp_replace(m.text, '=+$', '')"
    alphabet = "CASE " + " ".join(f"WHEN {body} RLIKE '^{p}$' THEN '{a}'" for p, a in ALPHABETS) + f" ELSE '{WEB_ALPHABET}' END"
    rows = rows.withColumn("_tokens", F.expr(f"transform(_tokens, m -> struct(m.start, m.text, {body} AS body, {alphabet} AS alphabet))"))
    codes = "transform(filter(split(m.body, ''), c -> c <> ''), c -> instr(m.alphabet, c) - 1)"
    rows = rows.withColumn("_tokens", F.expr(f"transform(_tokens, m -> struct(m.*, char_length(m.alphabet) AS a, {codes} AS v))".replace("m.*", "m.start, m.text, m.body")))
    rows = rows.withColumn("_tokens", F.expr("filter(_tokens, m -> size(m.v) >= 2)"))
    squares = "aggregate(array_distinct(m.v), 0D, (s, k) -> s + power(size(filter(m.v, x -> x = k)), 2))"
    pairs = "zip_with(slice(m.v, 1, size(m.v) - 1), slice(m.v, 2, size(m.v) - 1), (x, y) -> {0})"
    changes = f"aggregate({pairs.format('IF((2 * x < m.a) <> (2 * y < m.a), 1, 0)')}, 0, (s, c) -> s + c)"
    products = f"aggregate({pairs.format('(x - (m.a - 1) / 2D) * (y - (m.a - 1) / 2D)')}, 0D, (s, c) -> s + c)"
    low = "size(filter(m.v, x -> 2 * x < m.a))"
    rows = rows.withColumn("_tokens", F.expr(
        f"transform(_tokens, m -> struct(m.start, m.text, m.a AS a, CAST(size(m.v) AS DOUBLE) AS n, "
        f"{squares} AS squares, {changes} AS changes, {products} AS products, CAST({low} AS DOUBLE) AS low))"
    ))
    uniform = "(power((m.a / m.n * m.squares - m.n) / (m.a - 1), 1D / 3) - (1 - 2D / (9 * (m.a - 1)))) / sqrt(2D / (9 * (m.a - 1)))"
    expected, spread = "(2 * m.low * (m.n - m.low) / m.n + 1)", "(2 * m.low * (m.n - m.low) * (2 * m.low * (m.n - m.low) - m.n) / (m.n * m.n * (m.n - 1)))"
    turns = f"IF({spread} > 0, (m.changes + 1 - {expected}) / sqrt({spread}), {TOP}D)"
    serial = "m.products * 12 / ((m.a * m.a - 1) * sqrt(m.n - 1))"
    score = f"power(greatest(0D, {uniform}), 2) + power({turns}, 2) + power({serial}, 2)"
    length = "CASE " + " ".join(f"WHEN m.n >= {n} THEN {n}" for n in reversed(LENGTHS)) + " ELSE 0 END"
    return rows.withColumn("tokens", F.expr(
        f"transform(_tokens, m -> struct(m.start AS start, m.start + char_length(m.text) AS end, 100 * m.a + ({length}) AS class, "
        f"CAST(floor(least({TOP}D, {score}) * {STEPS}) AS INT) AS score))"
    ))


def thresholds(found: DataFrame, rate: float) -> DataFrame:
    """class, most: the largest score accepted. Sums over at most 2,001 scores a class, and as many
    classes as alphabets and lengths."""
    counts = found.select(F.explode("tokens").alias("t")).groupBy("t.class", "t.score").agg(F.count("*").alias("n"))
    far = f"score >= {FAR * STEPS} AND score < {2 * FAR * STEPS}"
    sums = counts.selectExpr(
        "class", "score", "sum(n) OVER (PARTITION BY class ORDER BY score) AS c", f"sum(IF({far}, n, 0)) OVER (PARTITION BY class) AS words"
    )
    accepted = sums.where(f"score < {MOST * STEPS} AND words * (score + 1) / {FAR * STEPS} <= {rate} * c")
    return accepted.groupBy("class").agg(F.max("score").alias("most"))


def find_secrets(docs: DataFrame, rate: float = RATE) -> DataFrame:
    """doc_id, base, found of every row: arrays of (start, rank, kind, end) by start, then
    kind. ``found`` has the base spans and, as kind random, those of the tests that no base
    span holds. Eager: spans and scores of all rows are written when this is called."""
    rows = docs.select("doc_id", F.coalesce("text", F.lit("")).alias("_text"))
    found = stage(_scored(_base_spans(rows)).select("doc_id", "base", "tokens"))
    # one number per alphabet and class of lengths, of which there are few whatever the input
    most = {r["class"]: r["most"] for r in thresholds(found, rate).collect()}
    accept = " OR ".join(f"(t.class = {c} AND t.score <= {m})" for c, m in sorted(most.items())) or "false"
    held = "exists(base, b -> b.start <= t.start AND t.end <= b.end)"
    random = f"filter(tokens, t -> ({accept}) AND NOT {held})"
    spans = f"array_sort(concat(base, transform({random}, t -> struct(t.start AS start, 3 AS rank, 'random' AS kind, t.end AS end))))"
    return found.select("doc_id", "base", F.expr(spans).alias("found"))


def as_text(spans: str) -> str:
    return f"array_join(transform({spans}, s -> concat_ws(':', s.kind, s.start, s.end)), ',')"
