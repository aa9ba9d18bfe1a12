"""Quality rules: a threshold table compiled into one projection of built-in functions.

Words are ``[^\\x20\\x09-\\x0D]+``. Defined results: null or empty text has no words, all counts 0, and fails the
length rule; repeated rows are judged each by itself; other columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from foldloom.llm.common import keyed

#: Function words of the four languages of the corpus.
STOP_WORDS = ("the of and to in is it on that was for with as be by at are this an or "
              "le la les de des et un une du en que qui dans pour par est "
              "der die das und ein eine von mit zu den nicht sich auf ist "
              "el los las que una por con para del se es").split()  # fmt: skip

#: measure, least, most. A document is kept if all hold (null: no bound). Wide on purpose: they are to find junk.
RULES: tuple[tuple[str, float | None, float | None], ...] = (
    ("mean_word_chars", 1.5, 25.0),
    ("symbols_per_word", None, 1.5),
    ("dup_line_share", None, 0.6),
    ("stop_word_share", 0.002, None),
)


def compile_rules(rules: tuple[tuple[str, float | None, float | None], ...]) -> Column:
    """One boolean expression over the measures."""
    verdict = F.lit(True)
    for name, least, most in rules:
        if least is not None:
            verdict = verdict & (F.col(name) >= F.lit(least))
        if most is not None:
            verdict = verdict & (F.col(name) <= F.lit(most))
    return verdict


def repeated_words(found: Column) -> Column:
    """Words in runs of three that the sorted windows show twice or more: ``found`` holds the ascending window starts."""
    step = lambda acc, p: F.struct((acc["n"] + p + 3 - F.greatest(p, acc["stop"])).alias("n"), (p + 3).alias("stop"))
    return F.aggregate(found, F.struct(F.lit(0).alias("n"), F.lit(0).alias("stop")), step)["n"].cast("long")


def measure(df: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """All measures and ratios of every document."""
    words = F.filter(F.split("text", "[ \\x09-\\x0D]+"), lambda w: w != "")
    text = F.coalesce(F.col("text"), F.lit(""))
    lines = F.filter(F.split(F.col("text"), "\n"), lambda x: x.rlike("[^ \\x09-\\x0D]"))
    base = keyed(df, id_col, text_col).withColumn("text", text).select(
        "doc_id", words.alias("words"), lines.alias("lines"),
        F.length(F.regexp_replace("text", "[^#*$%&|<>]+", "")).cast("long").alias("n_symbols"),
    )
    word = lambda i: F.get("words", i)
    # A window is its words and its place; sorting brings equal windows together, as words hold no blank.
    window = lambda i: F.concat(word(i), F.lit(" "), word(i + 1), F.lit(" "), word(i + 2), F.lit(" "), F.lpad(i.cast("string"), 10, "0"))
    n = F.size("words")
    counted = base.select(
        "*", n.cast("long").alias("n_words"),
        F.sort_array(F.when(n >= 3, F.transform(F.sequence(F.lit(0), n - 3), window)).otherwise(F.array().cast("array<string>"))).alias("windows"),
    )
    same = lambda x, i: F.coalesce(F.startswith(F.get("windows", i), F.left(x, F.length(x) - 10)), F.lit(False))
    twice = F.filter("windows", lambda x, i: same(x, i - 1) | same(x, i + 1))
    starts = F.sort_array(F.transform(twice, lambda x: F.right(x, F.lit(10)).cast("int")))
    stops = F.array(*map(F.lit, STOP_WORDS))
    full = counted.select(
        "doc_id", "n_words", F.length(F.array_join("words", "")).cast("long").alias("word_chars"), "n_symbols",
        (F.size("lines") - F.size(F.array_distinct("lines"))).cast("long").alias("n_dup_lines"),
        repeated_words(starts).alias("n_repeat_words"), F.size("lines").cast("long").alias("n_lines"),
        F.size(F.filter("words", lambda w: F.array_contains(stops, F.lower(w)))).cast("long").alias("n_stop_words"),
    )
    share = lambda a, b: F.col(a) / F.greatest(F.col(b), F.lit(1))
    return full.select(
        "*", share("word_chars", "n_words").alias("mean_word_chars"), share("n_symbols", "n_words").alias("symbols_per_word"),
        share("n_dup_lines", "n_lines").alias("dup_line_share"), share("n_stop_words", "n_words").alias("stop_word_share"),
    )


def judge(df: DataFrame, rules: tuple = RULES, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The measures, ``base_failed`` (fewer than 50 words, or over half of them in repeated windows) and ``kept``."""
    failed = (F.col("n_words") < 50) | (100 * F.col("n_repeat_words") > 50 * F.col("n_words"))
    return measure(df, id_col, text_col).withColumn("base_failed", failed).withColumn("kept", ~F.col("base_failed") & compile_rules(rules))


ORACLE = r"""
WITH w AS (SELECT doc_id, coalesce(text, '') AS t, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS ws FROM documents),
g AS (SELECT doc_id, i, ws[i] || ' ' || ws[i+1] || ' ' || ws[i+2] AS g FROM w, unnest(range(1, len(ws) - 1)) AS u(i)),
d AS (SELECT doc_id, i FROM (SELECT *, count(*) OVER (PARTITION BY doc_id, g) AS c FROM g) WHERE c > 1),
r AS (SELECT doc_id, count(DISTINCT p) AS n FROM (SELECT doc_id, unnest([i, i+1, i+2]) AS p FROM d) GROUP BY doc_id),
l AS (SELECT doc_id, list_filter(string_split(t, chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')) AS ls FROM w),
m AS (SELECT w.doc_id, len(ws)::BIGINT AS n_words, length(array_to_string(ws, ''))::BIGINT AS word_chars,
  length(regexp_replace(t, '[^#*$%&|<>]+', '', 'g'))::BIGINT AS n_symbols,
  (len(ls) - len(list_distinct(ls)))::BIGINT AS n_dup_lines, coalesce(r.n, 0)::BIGINT AS n_repeat_words, len(ls) AS n_lines,
  len(list_filter(ws, lambda x: list_contains([{stops}], lower(x)))) AS n_stop
  FROM w JOIN l USING (doc_id) LEFT JOIN r USING (doc_id)),
f AS (SELECT *, (n_words < 50 OR 100 * n_repeat_words > 50 * n_words) AS base_failed FROM m)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed,
  NOT base_failed AND word_chars / greatest(n_words, 1) >= 1.5 AND word_chars / greatest(n_words, 1) <= 25
  AND n_symbols / greatest(n_words, 1) <= 1.5 AND n_dup_lines / greatest(n_lines, 1) <= 0.6 AND n_stop / greatest(n_words, 1) >= 0.002 AS kept
FROM f""".replace("{stops}", ", ".join(f"'{w}'" for w in STOP_WORDS))
