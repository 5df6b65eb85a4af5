"""Quality rules as a short-circuit cascade, in DataFrame functions only.

A rule rejects a document by a predicate over its text. ``plan_cascade`` runs each rule over a bounded sample, takes its cost (seconds, warm, without what all
rules share) and selectivity (share rejected), and orders the rules by rejections per cost; ``verdict`` evaluates them in that order and stops at the first
rejection. The order decides how much work is done, never which documents stay. The sample is the first rows of up to ``SAMPLE_FILES`` files, evenly spaced; they are
read as a limit is, a few splits at a time until there are enough, and only the rules' verdicts leave the tasks.

Null and blank texts have no words and fail the base rule, as do texts of any length under ten words. Repeated rows get equal rows. The
columns of the input stay, whatever their names; a metric replaces an input column of the same name. An empty table gives an empty one, with the rules in order of name.
"""

from __future__ import annotations

import time
from dataclasses import dataclass
from urllib.parse import unquote

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import words_of

#: Rows that selectivities are estimated on, from so many files at most; and rows that costs are.
SAMPLE_ROWS, SAMPLE_FILES = 1_000, 8
COST_ROWS = 200

#: Limits of the rules.
LEAST_WORDS = 10
MOST_REPEATED_PERCENT = 20
REPEAT_WINDOW = 5
SYMBOLS = "#*$%&|<>"
MOST_SYMBOLS_PERCENT = 30
MOST_CAPITALS_PERCENT = 40
MOST_DUPLICATE_LINES_PERCENT = 50
LONGEST_MEAN_WORD = 20
NOT_SEPARATOR = r"[^\x20\x09-\x0D]"


def n_words(words: Column) -> Column:
    return F.size(words).cast("long")


def word_chars(text: Column) -> Column:
    return F.length(F.translate(text, " \t\n\x0b\x0c\r", "")).cast("long")


def n_symbols(text: Column) -> Column:
    return (F.length(text) - F.length(F.translate(text, SYMBOLS, ""))).cast("long")


def lines_with_words(text: Column) -> Column:
    return F.filter(F.split(text, "\n"), lambda x: F.rlike(x, F.lit(NOT_SEPARATOR)))


def n_dup_lines(text: Column) -> Column:
    """Lines with a word that equal an earlier line."""
    lines = lines_with_words(text)
    return (F.size(lines) - F.size(F.array_distinct(lines))).cast("long")


def _with_repeats(df: DataFrame, window: int = REPEAT_WINDOW) -> DataFrame:
    """Add the places of repeated windows to a table with ``_words``. Each array is a column of its own before a lambda reads it, so that none is
    computed once per element; a text's windows are sorted only if any two are equal."""
    later = [F.slice("_words", j + 1, F.greatest(F.size("_words") - window + 1, F.lit(0))) for j in range(window)]
    zipped = df.withColumn("_runs", F.arrays_zip(*[x.alias(f"w{j}") for j, x in enumerate(later)]))
    hashed = zipped.withColumn("_hashes", F.transform("_runs", lambda x: F.xxhash64(x))).drop("_runs")
    ranked = hashed.withColumn(
        "_ranked",
        F.when(
            F.size(F.array_distinct("_hashes")) < F.size("_hashes"),
            F.sort_array(F.transform("_hashes", lambda h, i: F.struct(h.alias("h"), i.alias("i")))),
        ).otherwise(F.array().cast("array<struct<h:bigint,i:int>>")),
    )
    place = F.transform(
        "_ranked",
        lambda x, i: F.when(
            ((i > 0) & F.equal_null(x["h"], F.get(F.col("_ranked"), i - 1)["h"])) | F.equal_null(x["h"], F.get(F.col("_ranked"), i + 1)["h"]), x["i"]
        ),
    )
    return ranked.withColumn("_places", F.sort_array(F.filter(place, lambda i: i.isNotNull()))).drop("_hashes", "_ranked")


def n_repeat_words(places: str = "_places", window: int = REPEAT_WINDOW) -> Column:
    """Words covered by windows that begin at these places."""
    later = F.sequence(F.lit(1), F.size(places) - 1)
    covered = F.aggregate(later, F.lit(window), lambda n, i: n + F.least(F.lit(window), F.get(F.col(places), i) - F.get(F.col(places), i - 1)))
    return F.when(F.size(places) > 1, covered).otherwise(0).cast("long")


@dataclass(frozen=True)
class Rule:
    """A predicate over ``_text``, ``_words`` and ``_places`` that holds for documents to reject."""

    name: str
    rejects: Column


def rules() -> list[Rule]:
    """The rules in order of name; the base rule is one of them."""
    words, text = F.col("_words"), F.col("_text")
    n = n_words(words)
    capitals = F.size(F.filter(words, lambda w: (w != F.lower(w)) & (w == F.upper(w))))
    return [
        Rule("capitals", capitals * 100 > n * MOST_CAPITALS_PERCENT),
        Rule("duplicate_lines", n_dup_lines(text) * 100 > F.size(lines_with_words(text)) * MOST_DUPLICATE_LINES_PERCENT),
        Rule("few_words", n < LEAST_WORDS),
        Rule("long_words", word_chars(text) > n * LONGEST_MEAN_WORD),
        Rule("repeats", n_repeat_words() * 100 > n * MOST_REPEATED_PERCENT),
        Rule("symbols", n_symbols(text) * 100 > n * MOST_SYMBOLS_PERCENT),
    ]


BASE = ("few_words", "repeats")


def _split(df: DataFrame, text: str) -> DataFrame:
    """The row as one column, so that its names can't clash with these, its text and its words."""
    return df.select(F.struct("*").alias("_row"), F.coalesce(F.col(text), F.lit("")).alias("_text")).withColumn("_words", words_of("_text"))


def _spread(df: DataFrame, files: int = SAMPLE_FILES) -> list[DataFrame]:
    """Tables whose first rows are the sample: one for each of some files, if it is files that the table is read from."""
    every = sorted({unquote(f.rsplit("/", 1)[-1]) for f in df.inputFiles()})
    if len(every) < 2:
        return [df]
    try:
        at = df.select("*", F.col("_metadata.file_name").alias("_file"))
    except AnalysisException:  # not a table of files alone
        return [df]
    chosen = [every[i * len(every) // files] for i in range(files)] if len(every) > files else every
    return [at.where(F.col("_file") == f).drop("_file") for f in chosen]  # other files aren't opened


def plan_cascade(df: DataFrame, text: str = "text", sample_rows: int = SAMPLE_ROWS) -> list[str]:
    """Names of the rules, most rejections per cost first; ties go by name."""
    own = df.select(F.col(text).alias("text"))
    every, parts = rules(), _spread(own)

    def run(part: DataFrame, rows: int, *columns: Column) -> list:
        # The limit ends the plan, so Spark reads one split after another until it has the rows, and computes no more than these.
        return _with_repeats(_split(part, "text")).select(*[c.alias(f"c{i}") for i, c in enumerate(columns)]).limit(rows).collect()

    def seconds(column: Column) -> float:
        took = []
        for _ in range(3):
            began = time.perf_counter()
            run(own, min(COST_ROWS, sample_rows), column)
            took.append(time.perf_counter() - began)
        return min(took[1:])  # the first run compiles

    rejected = [r for part in parts for r in run(part, -(-sample_rows // len(parts)), *[x.rejects for x in every])]
    shared = seconds(n_words(F.col("_words"))) if rejected else 0.0
    gain = {}
    for i, rule in enumerate(every):
        share = sum(r[i] for r in rejected) / len(rejected) if rejected else 0.0
        gain[rule.name] = share / max(seconds(rule.rejects) - shared, 1e-4) if share else 0.0
    return sorted(gain, key=lambda name: (-gain[name], name))


def verdict(order: list[str]) -> Column:
    """True for documents that no rule rejects; later rules are evaluated only for documents that earlier ones let pass."""
    by_name = {r.name: r.rejects for r in rules()}
    out = F.when(by_name[order[0]], False)
    for name in order[1:]:
        out = out.when(by_name[name], False)
    return out.otherwise(True)


def assess(df: DataFrame, text: str = "text", order: list[str] | None = None) -> DataFrame:
    """Add ``n_words``, ``word_chars``, ``n_symbols``, ``n_dup_lines``, ``n_repeat_words`` (long), ``base_failed`` and ``kept`` (boolean)."""
    metrics = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept"]
    order = order or plan_cascade(df, text)
    by_name = {r.name: r.rejects for r in rules()}
    base = by_name[BASE[0]] | by_name[BASE[1]]
    counted = _with_repeats(_split(df, text))
    row = F.struct(
        n_words(F.col("_words")).alias("n_words"),
        word_chars(F.col("_text")).alias("word_chars"),
        n_symbols(F.col("_text")).alias("n_symbols"),
        n_dup_lines(F.col("_text")).alias("n_dup_lines"),
        n_repeat_words().alias("n_repeat_words"),
        base.alias("base_failed"),
        (~base & verdict([r for r in order if r not in BASE])).alias("kept"),
    )
    # A generator ends the pushing down of later filters, which would compute the arrays again inside of lambdas.
    others = [c for c in df.columns if c not in metrics]
    return counted.select("_row", F.inline(F.array(row))).select(*[F.col(f"_row.`{c}`") for c in others], *metrics)


def keep_good(df: DataFrame, text: str = "text", order: list[str] | None = None) -> DataFrame:
    """The documents that no rule rejects, with their columns as they are."""
    order = order or plan_cascade(df, text)
    pass_ = lambda t, columns, names: t.select(*columns, F.inline(F.array(F.struct(verdict(names).alias("_kept"))))).where("_kept").drop("_kept")
    at = order.index("repeats") if "repeats" in order else len(order)
    good = _split(df, text)
    if at:
        good = pass_(good, ["_row", "_text", "_words"], order[:at])
    # The repeats rule needs arrays of its own, which are built only for documents that the rules before it let pass.
    good = pass_(_with_repeats(good), ["_row"], order[at:]) if at < len(order) else good
    return good.select("_row.*")


#: The same for DuckDB, over ``documents``.
ORACLE_SQL = f"""
WITH w AS (
  SELECT doc_id, coalesce(text, '') AS t,
         list_filter(regexp_split_to_array(coalesce(text, ''), '[\x20\x09-\x0D]+'), lambda x: x <> '') AS ws,
         list_filter(string_split(coalesce(text, ''), chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')) AS ls,
         row_number() OVER () AS r
  FROM documents
), g AS (
  SELECT r, i, list_slice(ws, i, i + {REPEAT_WINDOW - 1}) AS g
  FROM (SELECT r, ws, unnest(range(1, len(ws) - {REPEAT_WINDOW - 2})) AS i FROM w WHERE len(ws) >= {REPEAT_WINDOW})
), a AS (
  SELECT r, i FROM (SELECT r, i, count(*) OVER (PARTITION BY r, g) AS n FROM g) WHERE n > 1
), c AS (
  SELECT r, sum(least({REPEAT_WINDOW}, nxt - i))::BIGINT AS n_repeat_words
  FROM (SELECT r, i, coalesce(lead(i) OVER (PARTITION BY r ORDER BY i), i + {REPEAT_WINDOW}) AS nxt FROM a) GROUP BY r
), m AS (
  SELECT doc_id, ws, ls, len(ws)::BIGINT AS n_words,
         list_sum(list_transform(ws, lambda x: length(x)))::BIGINT AS wc,
         (length(t) - length(translate(t, '{SYMBOLS}', '')))::BIGINT AS n_symbols,
         (len(ls) - len(list_distinct(ls)))::BIGINT AS n_dup_lines,
         coalesce(n_repeat_words, 0)::BIGINT AS n_repeat_words
  FROM w LEFT JOIN c USING (r)
), b AS (
  SELECT *, coalesce(wc, 0)::BIGINT AS word_chars,
         n_words < {LEAST_WORDS} OR 100 * n_repeat_words > {MOST_REPEATED_PERCENT} * n_words AS base_failed
  FROM m
)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed,
       NOT base_failed
       AND NOT 100 * len(list_filter(ws, lambda x: x = upper(x) AND x <> lower(x))) > {MOST_CAPITALS_PERCENT} * n_words
       AND NOT 100 * n_dup_lines > {MOST_DUPLICATE_LINES_PERCENT} * len(ls)
       AND NOT word_chars > {LONGEST_MEAN_WORD} * n_words
       AND NOT 100 * n_symbols > {MOST_SYMBOLS_PERCENT} * n_words AS kept
FROM b
"""
