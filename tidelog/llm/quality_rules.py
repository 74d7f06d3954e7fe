"""Quality rules: a threshold table compiled into one projection of Spark expressions.

Each rule bounds one ratio of two measures. Ratios are compared as integers
(``100 * part`` against ``percent * whole``), so every engine reaches the same verdict.

Defined results: a null text counts as empty; empty texts have zero in every measure and are
rejected by the length rule; a ratio equal to its bound passes; long texts are measured whole; repeated rows are judged
each on its own; a null id is carried along; an empty table gives no rows; other columns of the
input pass through ``keep_good`` untouched and never collide with the measures, which live
in one struct until they are selected.
"""

from __future__ import annotations

from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidelog.llm.common import WORD_CHAR, let, words_of

#: Frequent function words of English, German, French and Spanish.
STOP_WORDS = (
    "a an and are as at be but by for from had has have he her his i in is it its not of on or she that the their they this to was were which with you "
    "aber als auch auf aus bei das dass dem den der des die ein eine einem einen einer er es für hat ich im ist mit nach nicht oder sich sie sind und von war wie wir zu zum zur "
    "au aux avec ce ces dans de des du elle en est et il ils je la le les leur mais ne nous on ou par pas pour qui que sa se ses son sont sur un une vous "
    "al con como del el ella ellos era esta este fue la las lo los más muy no para pero por que se ser sin sobre su sus también tan una uno y ya"
).split()

SYMBOLS = "#*$%&|<>"
WINDOW = 3


@dataclass(frozen=True)
class Rule:
    """``least`` or ``most`` percent of ``whole`` that ``part`` may make up."""

    name: str
    part: str
    whole: str
    least: int | None = None
    most: int | None = None


#: Rules every text has to meet before the table below is consulted.
BASE_RULES = (
    Rule("length", "n_words", "one", least=50 * 100),
    Rule("repetition", "n_repeat_words", "n_words", most=50),
)

RULES = (
    Rule("mean_word_length", "word_chars", "n_words", least=200, most=1500),
    Rule("symbols", "n_symbols", "n_words", most=10),
    Rule("stop_words", "n_stop_words", "n_words", least=4),
    Rule("capitals", "n_shouted_words", "n_words", most=30),
    Rule("duplicate_lines", "n_dup_lines", "n_lines", most=50),
    Rule("ellipsis_lines", "n_ellipsis_lines", "n_lines", most=50),
)


def _repeat_words(words: Column) -> Column:
    """Words that lie in a window of three words found at least twice in the text.

    Windows are sorted with their positions, so equal ones are neighbours: no pair of windows
    is compared, and a text made of one repeated word costs no more than any other.
    """
    grams = F.slice(
        F.transform(words, lambda w, i: F.struct(F.concat(w, F.lit(" "), F.get(words, i + 1), F.lit(" "), F.get(words, i + 2)).alias("g"), i.alias("i"))),
        F.lit(1),
        F.greatest(F.size(words) - (WINDOW - 1), F.lit(0)),
    )

    def covered(s: Column) -> Column:
        same = lambda j, k: F.coalesce(F.get(s, j)["g"] == F.get(s, k)["g"], F.lit(False))
        found = F.filter(F.transform(s, lambda x, j: F.when(same(j, j - 1) | same(j, j + 1), x["i"])), lambda i: i.isNotNull())
        return F.size(F.array_distinct(F.flatten(F.transform(found, lambda i: F.array(i, i + 1, i + 2)))))

    return let(F.sort_array(grams), covered).cast("long")


def measures(text: Column) -> Column:
    """One struct with every count that the rules refer to, all over the whole text."""
    text = F.coalesce(text, F.lit(""))
    lines = F.filter(F.split(text, "\n", -1), lambda x: x.rlike(WORD_CHAR))

    def body(words: Column) -> Column:
        return let(
            lines,
            lambda rows: F.struct(
                F.size(words).cast("long").alias("n_words"),
                F.length(F.translate(text, " \t\n\x0b\x0c\r", "")).cast("long").alias("word_chars"),
                (F.length(text) - F.length(F.translate(text, SYMBOLS, ""))).cast("long").alias("n_symbols"),
                (F.size(rows) - F.size(F.array_distinct(rows))).cast("long").alias("n_dup_lines"),
                _repeat_words(words).alias("n_repeat_words"),
                F.size(F.filter(words, lambda w: F.lower(w).isin(STOP_WORDS))).cast("long").alias("n_stop_words"),
                F.size(F.filter(words, lambda w: (F.lower(w) != w) & (F.length(w) > 1) & ~w.rlike(r"\p{Ll}"))).cast("long").alias("n_shouted_words"),
                F.size(rows).cast("long").alias("n_lines"),
                F.size(F.filter(rows, lambda r: r.endswith("...") | r.endswith("…"))).cast("long").alias("n_ellipsis_lines"),
                F.lit(1).cast("long").alias("one"),
            ),
        )

    return let(words_of(text), body)


def compile_rules(m: Column, rules: tuple[Rule, ...]) -> Column:
    """The conjunction of all bounds as a single boolean expression over the measures ``m``."""
    parts = [100 * m[r.part] >= r.least * m[r.whole] for r in rules if r.least is not None]
    parts += [100 * m[r.part] <= r.most * m[r.whole] for r in rules if r.most is not None]
    return reduce(lambda a, b: a & b, parts, F.lit(True))


def score_rules(docs: DataFrame, text: str = "text", base: tuple[Rule, ...] = BASE_RULES, rules: tuple[Rule, ...] = RULES) -> DataFrame:
    """All columns of ``docs`` in a struct ``row``, with ``measures``, ``base_failed`` and ``kept``."""
    m = F.col("measures")
    out = docs.select(F.struct("*").alias("row"), measures(F.col(text)).alias("measures"))
    return out.withColumn("base_failed", ~compile_rules(m, base)).withColumn("kept", compile_rules(m, base) & compile_rules(m, rules))


def keep_good(docs: DataFrame, text: str = "text", **kw) -> DataFrame:
    """The rows of ``docs``, unchanged, that meet every rule."""
    return score_rules(docs, text, **kw).where("kept").select("row.*")


def oracle(rules: tuple[Rule, ...] = RULES) -> str:
    """DuckDB SQL for the rows of query op7."""
    bound = lambda r: " AND ".join([f"100 * {r.part} >= {r.least} * {r.whole}"] * (r.least is not None) + [f"100 * {r.part} <= {r.most} * {r.whole}"] * (r.most is not None))
    stops = ", ".join(f"'{w}'" for w in sorted(set(STOP_WORDS)))
    return f"""
WITH t AS (SELECT row_number() OVER () AS rid, doc_id, coalesce(text, '') AS text FROM documents),
s AS (SELECT rid, doc_id, text, regexp_extract_all(text, '[^\\x20\\x09-\\x0D]+') AS words,
  list_filter(string_split(text, chr(10)), lambda x: regexp_matches(x, '[^\\x20\\x09-\\x0D]')) AS rows FROM t),
w AS (SELECT rid, i, g, count(*) OVER (PARTITION BY rid, g) AS n FROM (
  SELECT rid, i, w || ' ' || lead(w, 1) OVER o || ' ' || lead(w, 2) OVER o AS g
  FROM (SELECT rid, unnest(words) AS w, generate_subscripts(words, 1) AS i FROM s) WINDOW o AS (PARTITION BY rid ORDER BY i)) WHERE g IS NOT NULL),
r AS (SELECT rid, count(DISTINCT i + k) AS n FROM w, (VALUES (0), (1), (2)) v(k) WHERE n > 1 GROUP BY rid),
m AS (SELECT doc_id, CAST(len(words) AS BIGINT) AS n_words,
  CAST(length(regexp_replace(text, '[\\x20\\x09-\\x0D]', '', 'g')) AS BIGINT) AS word_chars,
  CAST(length(regexp_replace(text, '[^#*$%&|<>]', '', 'g')) AS BIGINT) AS n_symbols,
  CAST(len(rows) - len(list_distinct(rows)) AS BIGINT) AS n_dup_lines, CAST(coalesce(r.n, 0) AS BIGINT) AS n_repeat_words,
  len(list_filter(words, lambda x: lower(x) IN ({stops}))) AS n_stop_words,
  len(list_filter(words, lambda x: lower(x) <> x AND length(x) > 1 AND NOT regexp_matches(x, '\\p{{Ll}}'))) AS n_shouted_words,
  len(rows) AS n_lines, len(list_filter(rows, lambda x: x LIKE '%...' OR x LIKE '%…')) AS n_ellipsis_lines
  FROM s LEFT JOIN r USING (rid)),
b AS (SELECT *, n_words < 50 OR 100 * n_repeat_words > 50 * n_words AS base_failed FROM m)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed,
  NOT base_failed AND {" AND ".join(bound(r) for r in rules)} AS kept FROM b"""
