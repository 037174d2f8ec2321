"""Line-first cleaning: rules judge each line, failing lines are removed, and a document that loses too much is rejected.

Everything is DataFrame expressions on one row, so there is no shuffle, and rows that are equal or share an id are judged
one by one. Arrays that several expressions need get a column of their own, as a lambda would compute them per element.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from milepost.llm.common import table

#: Words in a window of the repetition count.
WINDOW = 5
#: Fewest words of a document, and the largest percentage of its words in repeated windows.
MIN_WORDS, MAX_REPEAT_PCT = 10, 20
#: A line fails with a larger percentage of its characters among these.
MAX_NOISE_PCT = 15
#: A line with as many cells is navigation or a table.
MIN_CELLS = 4
#: Boilerplate phrases count in lines of at most so many characters.
BOILERPLATE_CHARS = 200
#: A document stays if its remaining lines have at least this percentage of the characters of all lines.
MIN_REMAINING_PCT = 50

SPACE = r"[\x20\x09-\x0D]+"
NOT_SPACE = r"[^\x20\x09-\x0D]"
SYMBOL = "[#*$%&|<>]"
NOISE = "[!#*$%&|<>=_~^{}@+/]"
END = r"[.!?:;)\"'…»”][\x20\x09-\x0D]*$"
CELL = " [|>] "
BOILERPLATE = (
    "all rights reserved|copyright|licensed under|privacy policy|terms of (use|service)|cookie|sign (in|up)|log ?in|"
    "subscribe|click here|read more|share this|skip to|back to top|powered by"
)


def pieces(text: Column, pattern: str) -> Column:
    """Number of matches of a one-character pattern."""
    return F.size(F.split(text, pattern, -1)) - 1


def line_passes(line: Column) -> Column:
    """Whether a line with a word ends like a sentence and is neither noise, navigation nor boilerplate."""
    short = F.length(line) <= BOILERPLATE_CHARS
    return (
        line.rlike(END)
        & (100 * pieces(line, NOISE) <= MAX_NOISE_PCT * F.length(line))
        & (pieces(line, CELL) < MIN_CELLS - 1)
        & ~(short & F.lower(line).rlike(BOILERPLATE))
    )


def _neighbours(array: Column) -> Column:
    """Each element with its successor (null at the end) as fields a and b."""
    return F.arrays_zip(array.alias("a"), F.slice(array, F.lit(2), F.greatest(F.size(array), F.lit(0))).alias("b"))


def with_repeats(df: DataFrame) -> DataFrame:
    """Adds n_repeat_words: words in windows that occur at least twice in the document, each word counted once."""
    last = F.col("n_words") - WINDOW
    # Element by element: slice() in a lambda would copy the whole array for each position.
    windows = F.when(
        last >= 1,
        F.transform(F.sequence(F.lit(0), last), lambda i: F.xxhash64(*[F.get("words", i.cast("int") + k) for k in range(WINDOW)])),
    )
    df = df.withColumn("windows", windows)
    repeated = F.size(F.array_distinct("windows")) < F.size("windows")
    df = df.withColumn(
        "sorted",
        F.when(repeated, F.array_sort(F.transform("windows", lambda h, i: F.struct(h.alias("h"), i.alias("i"))))),
    ).drop("windows")
    df = df.withColumn("same", F.filter(_neighbours(F.col("sorted")), lambda z: z["a"]["h"] == z["b"]["h"])).drop("sorted")
    starts = F.concat(F.transform("same", lambda z: z["a"]["i"]), F.transform("same", lambda z: z["b"]["i"]))
    df = df.withColumn("starts", F.array_sort(F.array_distinct(starts))).drop("same")
    covered = F.aggregate(
        _neighbours(F.col("starts")),
        F.lit(0).cast("long"),
        lambda n, z: n + F.least(F.lit(WINDOW), F.coalesce(z["b"] - z["a"], F.lit(WINDOW))).cast("long"),
    )
    return df.withColumn("n_repeat_words", F.coalesce(covered, F.lit(0).cast("long"))).drop("starts")


def quality(docs: DataFrame) -> DataFrame:
    """One row per document: counts, the cleaned text, and whether the document is kept.

    A null or empty text has no words and is rejected. Columns other than doc_id and text are not read.
    """
    df = docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text"))
    df = df.withColumn("words", F.array_remove(F.split("text", SPACE), ""))
    df = df.withColumn("n_words", F.size("words").cast("long"))
    df = with_repeats(df)
    df = df.withColumn("joined", F.array_join("words", "")).drop("words")
    df = df.withColumn("lines", F.filter(F.split("text", "\n"), lambda x: x.rlike(NOT_SPACE)))
    df = df.withColumn("good", F.filter("lines", line_passes))
    df = df.withColumn("clean_text", F.array_join("good", "\n"))
    n_lines, n_good = F.size("lines").cast("long"), F.size("good").cast("long")
    df = df.select(
        "doc_id",
        "n_words",
        F.length("joined").cast("long").alias("word_chars"),
        pieces(F.col("joined"), SYMBOL).cast("long").alias("n_symbols"),
        (n_lines - F.size(F.array_distinct("lines"))).alias("n_dup_lines"),
        "n_repeat_words",
        ((F.col("n_words") < MIN_WORDS) | (100 * F.col("n_repeat_words") > MAX_REPEAT_PCT * F.col("n_words"))).alias(
            "base_failed"
        ),
        (n_lines - n_good).alias("n_bad_lines"),
        (F.length(F.array_join("lines", "")) * MIN_REMAINING_PCT <= 100 * F.length(F.array_join("good", ""))).alias("enough"),
        "clean_text",
    )
    return df.withColumn("kept", ~F.col("base_failed") & F.col("enough"))


def op8_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality(table(spark, sf_dir, "documents")).drop("clean_text", "enough")


SQL = rf"""
WITH d AS (
  SELECT row_number() OVER () AS r, doc_id, coalesce(text, '') AS text,
         regexp_extract_all(coalesce(text, ''), '{NOT_SPACE}+') AS words
  FROM documents),
w AS (
  SELECT r, i, row(words[i], words[i+1], words[i+2], words[i+3], words[i+4]) AS g
  FROM (SELECT r, words, unnest(range(1, len(words) - {WINDOW} + 2)) AS i FROM d)),
hits AS (SELECT r, i FROM (SELECT r, i, count(*) OVER (PARTITION BY r, g) AS n FROM w) WHERE n > 1),
rep AS (SELECT r, count(DISTINCT i + k) AS n FROM hits, (SELECT unnest(range(0, {WINDOW})) AS k) GROUP BY r),
l AS (
  SELECT r, k, line, regexp_matches(line, '{END.replace("'", "''")}')
     AND 100 * len(regexp_extract_all(line, '{NOISE}')) <= {MAX_NOISE_PCT} * length(line)
     AND len(regexp_extract_all(line, '{CELL}')) < {MIN_CELLS - 1}
     AND NOT (length(line) <= {BOILERPLATE_CHARS} AND regexp_matches(lower(line), '{BOILERPLATE}')) AS good
  FROM (SELECT r, unnest(string_split(text, chr(10))) AS line, generate_subscripts(string_split(text, chr(10)), 1) AS k FROM d)
  WHERE regexp_matches(line, '{NOT_SPACE}')),
ls AS (
  SELECT r, count(*) AS n, count(DISTINCT line) AS nd, sum(length(line)) AS chars, count(*) FILTER (NOT good) AS bad,
         coalesce(sum(length(line)) FILTER (good), 0) AS left_chars
  FROM l GROUP BY r),
a AS (
  SELECT doc_id, len(words)::BIGINT AS n_words, coalesce(length(array_to_string(words, '')), 0)::BIGINT AS word_chars,
         len(regexp_extract_all(text, '{SYMBOL}'))::BIGINT AS n_symbols, coalesce(ls.n - ls.nd, 0)::BIGINT AS n_dup_lines,
         coalesce(rep.n, 0)::BIGINT AS n_repeat_words, coalesce(bad, 0)::BIGINT AS n_bad_lines,
         coalesce(chars, 0) * {MIN_REMAINING_PCT} <= 100 * coalesce(left_chars, 0) AS enough
  FROM d LEFT JOIN rep USING (r) LEFT JOIN ls USING (r))
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words,
       n_words < {MIN_WORDS} OR 100 * n_repeat_words > {MAX_REPEAT_PCT} * n_words AS base_failed, n_bad_lines,
       NOT (n_words < {MIN_WORDS} OR 100 * n_repeat_words > {MAX_REPEAT_PCT} * n_words) AND enough AS kept
FROM a
"""
