"""Quality rules as a ledger of bits, native expressions only.

Every rule is evaluated once per document; the ledger keeps the measurements and one bit
for each rule that failed. A policy is a named, versioned set of rules, so applying
another policy, or asking what a rule costs, reads the ledger and never the texts.

All of it is one expression over the text column, bound step by step so that words,
lines and windows are computed once. Nothing is shuffled except the ablation's count per
bit pattern (at most 2^rules rows).

Windows of three words are compared by 64-bit hashes.

Cases: a null text counts as an empty one, which has no words and fails `too_few_words`.
Repeated rows are measured each for itself. Other columns of the input pass through
`keep_good` untouched, whatever their names.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame, functions as F

from emberlog.llm.common import SPACES, words

SYMBOLS = "#*$%&|<>"
CAPITALS = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"

#: name -> the rule's failure as SQL over the measurements; a rule's bit is its place.
RULES: dict[str, str] = {
    "too_few_words": "n_words < 50",
    "repeated_windows": "100 * n_repeat_words > 50 * n_words",
    "many_symbols": "100 * n_symbols > 25 * n_words",
    "mostly_capitals": "100 * n_capitals > 50 * word_chars",
    "repeated_lines": "100 * n_dup_lines > 60 * n_lines",
    "short_words": "word_chars < 2 * n_words",
    "long_words": "word_chars > 12 * n_words",
}
BITS = {name: 1 << place for place, name in enumerate(RULES)}

#: Versioned policies: a document is kept if none of the policy's rules failed.
POLICIES: dict[str, tuple[str, ...]] = {
    "base-1": ("too_few_words", "repeated_windows"),
    "full-1": tuple(RULES),
}

MEASURES = (
    "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "n_capitals", "n_lines",
)


def mask(policy: str | Sequence[str]) -> int:
    names = POLICIES[policy] if isinstance(policy, str) else policy
    return sum(BITS[name] for name in names)


def _let(value: Column, then: Callable[[Column], Column]) -> Column:
    """then(value), with value computed once."""
    return F.transform(F.array(value), then)[0]


def _repeat_words(tokens: Column) -> Column:
    """Words that lie in a 3-word window which occurs twice or more."""

    def covered(windows: Column) -> Column:
        placed = F.sort_array(F.transform(windows, lambda h, i: F.struct(h.alias("h"), i.alias("i"))))
        return _let(
            placed,
            lambda s: F.size(
                F.array_distinct(
                    F.flatten(
                        F.filter(
                            F.transform(
                                s,
                                lambda x, k: F.when(
                                    ((k > 0) & (s[F.greatest(k - 1, F.lit(0))]["h"] == x["h"]))
                                    | (F.get(s, k + 1)["h"].eqNullSafe(x["h"])),
                                    F.array(x["i"], x["i"] + 1, x["i"] + 2),
                                ),
                            ),
                            lambda a: a.isNotNull(),
                        )
                    )
                )
            ),
        )

    windows = F.transform(
        F.slice(tokens, F.lit(1), F.greatest(F.size(tokens) - 2, F.lit(0))),
        lambda w, i: F.xxhash64(w, F.get(tokens, i + 1), F.get(tokens, i + 2)),
    )
    return _let(
        windows,
        lambda w: F.when(F.size(F.array_distinct(w)) == F.size(w), F.lit(0)).otherwise(covered(w)),
    )


def _without(text: Column, characters: str) -> Column:
    return F.length(F.translate(text, characters, ""))


def _failed(rule: str, m: Column) -> Column:
    """A rule of RULES over a struct of the measurements; its text is also an expression of columns."""
    return eval(rule, {"__builtins__": {}}, {name: m[name] for name in MEASURES})  # noqa: S307


def ledger(text: Column) -> Column:
    """Struct of the measurements and `rule_bits` of one text."""

    def measured(t: Column, tokens: Column, lines: Column) -> Column:
        n = F.length(t)
        return F.struct(
            F.size(tokens).cast("long").alias("n_words"),
            _without(t, SPACES).cast("long").alias("word_chars"),
            (n - _without(t, SYMBOLS)).cast("long").alias("n_symbols"),
            (F.size(lines) - F.size(F.array_distinct(lines))).cast("long").alias("n_dup_lines"),
            _repeat_words(tokens).cast("long").alias("n_repeat_words"),
            (n - _without(t, CAPITALS)).cast("long").alias("n_capitals"),
            F.size(lines).cast("long").alias("n_lines"),
        )

    def judged(m: Column) -> Column:
        bits = sum(
            (F.when(_failed(rule, m), F.lit(BITS[name])).otherwise(F.lit(0)) for name, rule in RULES.items()),
            F.lit(0),
        )
        return F.struct(*(m[k].alias(k) for k in MEASURES), bits.cast("long").alias("rule_bits"))

    def lines(t: Column) -> Column:
        return F.filter(F.split(t, "\n"), lambda x: F.trim(x, F.lit(SPACES)) != "")

    return _let(
        F.coalesce(text, F.lit("")),
        lambda t: _let(words(t), lambda w: _let(lines(t), lambda ls: _let(measured(t, w, ls), judged))),
    )


def build_ledger(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, measurements, rule_bits) for every row of `docs`."""
    return docs.select(F.col(id_col).alias("doc_id"), ledger(F.col(text_col)).alias("m")).select(
        "doc_id", "m.*"
    )


def apply_policy(table: DataFrame, policy: str | Sequence[str] = "full-1") -> DataFrame:
    """The ledger with `base_failed` and `kept`."""
    return table.withColumn("base_failed", F.col("rule_bits").bitwiseAND(mask("base-1")) != 0).withColumn(
        "kept", F.col("rule_bits").bitwiseAND(mask("base-1") | mask(policy)) == 0
    )


def keep_good(docs: DataFrame, policy: str = "full-1", text_col: str = "text") -> DataFrame:
    """The rows of `docs` that the policy keeps, with all their columns."""
    return docs.where(ledger(F.col(text_col))["rule_bits"].bitwiseAND(mask(policy)) == 0)


def ablation(table: DataFrame, policy: str | Sequence[str] = "full-1") -> DataFrame:
    """For each rule of the policy: documents that fail it, that fail it alone, and
    that the policy without it would keep. One pass over the ledger."""
    whole = mask(policy)
    names = POLICIES[policy] if isinstance(policy, str) else policy
    counts = table.groupBy(F.col("rule_bits").bitwiseAND(whole).alias("bits")).agg(F.count("*").alias("n"))
    rules = F.array(*(F.struct(F.lit(n).alias("rule"), F.lit(BITS[n]).alias("bit")) for n in names))
    each = counts.select("bits", "n", F.explode(rules).alias("r")).select("bits", "n", "r.rule", "r.bit")
    total = lambda test: F.coalesce(F.sum(F.when(test, F.col("n"))), F.lit(0))
    return each.groupBy("rule", "bit").agg(
        total(F.col("bits").bitwiseAND(F.col("bit")) != 0).alias("n_failed"),
        total(F.col("bits") == F.col("bit")).alias("n_failed_alone"),
        total(F.col("bits").bitwiseAND(F.bitwise_not("bit")) == 0).alias("n_kept_without"),
    )


def oracle(table: str = "documents") -> str:
    """DuckDB SQL for apply_policy(build_ledger(documents))."""
    space = r"[\x20\x09-\x0D]"
    blank = rf"'^{space}*$'"
    base, full = mask("base-1"), mask("base-1") | mask("full-1")
    bits = " + ".join(f"CASE WHEN {test} THEN {BITS[name]} ELSE 0 END" for name, test in RULES.items())
    return f"""
WITH t AS (SELECT doc_id, coalesce(text, '') AS x FROM {table}),
w AS (
  SELECT doc_id, x,
    CASE WHEN regexp_matches(x, {blank}) THEN CAST([] AS VARCHAR[])
         ELSE regexp_extract_all(x, '[^\\x20\\x09-\\x0D]+') END AS words,
    list_filter(string_split(x, chr(10)), lambda l: NOT regexp_matches(l, {blank})) AS lines
  FROM t
),
p AS (
  SELECT doc_id, i, words[i] AS a, words[i + 1] AS b, words[i + 2] AS c
  FROM (SELECT doc_id, words, unnest(range(1, len(words) - 1)) AS i FROM w WHERE len(words) >= 3)
),
d AS (
  SELECT doc_id, i FROM (SELECT doc_id, i, count(*) OVER (PARTITION BY doc_id, a, b, c) AS n FROM p) WHERE n > 1
),
r AS (
  SELECT doc_id, count(DISTINCT k) AS n_repeat_words
  FROM (SELECT doc_id, unnest([i, i + 1, i + 2]) AS k FROM d) GROUP BY doc_id
),
m AS (
  SELECT w.doc_id, CAST(len(words) AS BIGINT) AS n_words,
    CAST(length(regexp_replace(x, '{space}', '', 'g')) AS BIGINT) AS word_chars,
    CAST(length(x) - length(regexp_replace(x, '[#*$%&|<>]', '', 'g')) AS BIGINT) AS n_symbols,
    CAST(len(lines) - len(list_distinct(lines)) AS BIGINT) AS n_dup_lines,
    CAST(coalesce(n_repeat_words, 0) AS BIGINT) AS n_repeat_words,
    CAST(length(x) - length(regexp_replace(x, '[A-Z]', '', 'g')) AS BIGINT) AS n_capitals,
    CAST(len(lines) AS BIGINT) AS n_lines
  FROM w LEFT JOIN r ON r.doc_id = w.doc_id
),
b AS (SELECT *, CAST({bits} AS BIGINT) AS rule_bits FROM m)
SELECT *, (rule_bits & {base}) <> 0 AS base_failed, (rule_bits & {full}) = 0 AS kept FROM b
"""
