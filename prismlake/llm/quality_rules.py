"""Quality rules as a bitmask ledger: every rule is evaluated once per document, the ledger
stores the measurements and one failure bit per rule, and versioned policies or
ablations are bit operations on the ledger.

Everything here is DataFrame expressions inside one map stage: no shuffle, no Python.

Defined results for odd input: a null or empty text has no words, so all counts
are 0 and only the word-count rule fails.  Repeated rows and ties are judged row
by row.  Extra columns stay; a column whose name the ledger uses is replaced.
An empty table gives an empty ledger.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Word pattern of all rules.
WORD = r"[^\x20\x09-\x0D]+"
SPACE = "\x20\x09\x0a\x0b\x0c\x0d"
SYMBOLS = "#*$%&|<>"


@dataclass(frozen=True)
class Rule:
    """A named test over the measurements; true means the document fails it."""

    bit: int
    name: str
    fails: str


#: The rules' bits never change meaning; a new rule takes the next bit.
RULES = (
    Rule(0, "few_words", "n_words < 50"),
    Rule(1, "repeated_windows", "100 * n_repeat_words > 50 * n_words"),
    Rule(2, "symbols", "5 * n_symbols > n_words"),
    Rule(3, "duplicate_lines", "n_lines >= 5 AND 10 * n_dup_lines > 3 * n_lines"),
    Rule(4, "short_words", "n_words > 0 AND word_chars < 2 * n_words"),
    Rule(5, "long_words", "n_words > 0 AND word_chars > 20 * n_words"),
    Rule(6, "exclamations", "2 * n_exclaims > n_words"),
)

#: Policies by version: the rules whose failure rejects a document.
POLICIES = {
    "base": ("few_words", "repeated_windows"),
    "v1": ("few_words", "repeated_windows", "symbols", "duplicate_lines", "short_words", "long_words", "exclamations"),
}

MEASURES = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "n_lines", "n_exclaims")


def policy_mask(policy: str | tuple[str, ...]) -> int:
    """Bits of the rules that a policy (a version or rule names) enforces."""
    names = POLICIES[policy] if isinstance(policy, str) else policy
    bits = {r.name: r.bit for r in RULES}
    return sum(1 << bits[n] for n in names)


def _occurrences(text: Column, chars: str) -> Column:
    """How many of the one-byte ``chars`` a text has; plain byte searches, so absent characters cost little."""
    total = F.lit(0)
    for c in chars:
        total = total + F.length(text) - F.length(F.replace(text, F.lit(c), F.lit("")))
    return total.cast("long")


def words_of(text: Column) -> Column:
    """The words of a text in order."""
    for c in SPACE[1:]:
        text = F.replace(text, F.lit(c), F.lit(" "))
    return F.array_remove(F.split(text, " ", -1), "")


def _repeat_words(words: Column) -> Column:
    """Number of words inside 3-word windows that occur twice or more.

    Windows get a 64-bit hash; if all differ, no window repeats.  Else hashes are
    sorted with their places, and neighbours with equal hashes are compared word by word.
    """
    n = F.size(words)
    hashed = F.slice(F.transform(words, lambda w, i: F.xxhash64(w, F.get(words, i + 1), F.get(words, i + 2))), F.lit(1), n - 2)

    def like(p: Column, q: Column) -> Column:
        each = [F.get(words, p["i"] + k) == F.get(words, q["i"] + k) for k in range(3)]
        return F.coalesce((p["h"] == q["h"]) & each[0] & each[1] & each[2], F.lit(False))

    def hits(s: Column) -> Column:
        return F.array_compact(F.transform(s, lambda p, k: F.when(like(p, F.get(s, k + 1)) | like(p, F.get(s, k - 1)), p["i"])))

    def covered(h: Column) -> Column:
        placed = F.sort_array(F.transform(h, lambda x, i: F.struct(x.alias("h"), i.alias("i"))))
        found = F.get(F.transform(F.array(placed), hits), F.lit(0))
        return F.size(F.array_distinct(F.flatten(F.transform(found, lambda i: F.array(i, i + 1, i + 2)))))

    counted = F.transform(F.array(hashed), lambda h: F.when(F.size(F.array_distinct(h)) == F.size(h), F.lit(0)).otherwise(covered(h)))
    return F.when(n < 4, F.lit(0)).otherwise(F.get(counted, F.lit(0))).cast("long")


def measure(df: DataFrame, text: str = "text") -> DataFrame:
    """Adds the measurements of every rule as long columns."""
    t = F.coalesce(F.col(text), F.lit(""))
    lines = F.filter(F.split(t, "\n", -1), lambda x: F.length(F.btrim(x, F.lit(SPACE))) > 0)
    out = df.withColumns({"__words": words_of(t), "__lines": lines})
    return out.withColumns(
        {
            "n_words": F.size("__words").cast("long"),
            "word_chars": F.length(F.array_join("__words", "")).cast("long"),
            "n_symbols": _occurrences(t, SYMBOLS),
            "n_dup_lines": (F.size("__lines") - F.size(F.array_distinct("__lines"))).cast("long"),
            "n_repeat_words": _repeat_words(F.col("__words")),
            "n_lines": F.size("__lines").cast("long"),
            "n_exclaims": _occurrences(t, "!"),
        }
    ).drop("__words", "__lines")


def ledger(df: DataFrame, text: str = "text") -> DataFrame:
    """``measure`` plus ``fail_bits``: the bit of every rule the document fails."""
    bits = F.lit(0).cast("long")
    for r in RULES:
        bits = bits.bitwiseOR(F.when(F.expr(r.fails), F.lit(1 << r.bit).cast("long")).otherwise(F.lit(0).cast("long")))
    return measure(df, text).withColumn("fail_bits", bits)


def apply_policy(led: DataFrame, policy: str | tuple[str, ...] = "v1", column: str = "kept") -> DataFrame:
    """Marks the documents that fail no rule of the policy, from the stored bits alone."""
    return led.withColumn(column, F.col("fail_bits").bitwiseAND(F.lit(policy_mask(policy)).cast("long")) == 0)


def ablation(led: DataFrame, policy: str | tuple[str, ...] = "v1") -> DataFrame:
    """One row per rule of the policy: documents failing it, failing it alone, and kept without it.

    Distinct bit patterns are counted first, so the shuffle carries at most
    2**len(RULES) rows per task whatever the number of documents.
    """
    mask = policy_mask(policy)
    counts = led.groupBy(F.col("fail_bits").bitwiseAND(F.lit(mask).cast("long")).alias("m")).agg(F.count("*").alias("n"))
    rules = [r for r in RULES if mask >> r.bit & 1]
    each = counts.withColumn("r", F.explode(F.array(*[F.struct(F.lit(r.name).alias("rule"), F.lit(1 << r.bit).cast("long").alias("b")) for r in rules])))
    failed, others = F.col("m").bitwiseAND(F.col("r.b")) != 0, F.col("m").bitwiseAND(F.bitwise_not(F.col("r.b")))
    total = lambda c: F.coalesce(F.sum(F.when(c, F.col("n"))), F.lit(0)).cast("long")
    return each.groupBy(F.col("r.rule").alias("rule")).agg(
        total(failed).alias("n_failed"), total(failed & (others == 0)).alias("n_failed_alone"), total(others == 0).alias("n_kept_without")
    )


def op10_quality_rules(spark, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    led = apply_policy(apply_policy(ledger(docs), "base", "base_ok"), "v1", "kept")
    return led.select(
        "doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words",
        (~F.col("base_ok")).alias("base_failed"), "kept", "fail_bits",
    )


OP10_SQL = r"""
WITH d AS (SELECT doc_id, coalesce(text, '') AS t FROM documents),
w AS (SELECT doc_id, t, regexp_extract_all(t, '[^\x20\x09-\x0D]+') AS words,
             list_filter(string_split(t, chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')) AS lines FROM d),
g AS (SELECT doc_id, i, words[i] || ' ' || words[i + 1] || ' ' || words[i + 2] AS g
      FROM (SELECT doc_id, words, unnest(range(1, len(words) - 1)) AS i FROM w WHERE len(words) > 2)),
r AS (SELECT doc_id, i FROM (SELECT doc_id, i, count(*) OVER (PARTITION BY doc_id, g) AS c FROM g) WHERE c > 1),
rep AS (SELECT doc_id, count(DISTINCT i + k) AS n_repeat_words FROM r, (SELECT unnest([0, 1, 2]) AS k) GROUP BY doc_id),
m AS (SELECT w.doc_id, len(words)::BIGINT AS n_words,
        length(regexp_replace(t, '[\x20\x09-\x0D]', '', 'g'))::BIGINT AS word_chars,
        length(regexp_replace(t, '[^#*$%&|<>]', '', 'g'))::BIGINT AS n_symbols,
        (len(lines) - len(list_distinct(lines)))::BIGINT AS n_dup_lines,
        coalesce(n_repeat_words, 0)::BIGINT AS n_repeat_words, len(lines)::BIGINT AS n_lines,
        length(regexp_replace(t, '[^!]', '', 'g'))::BIGINT AS n_exclaims
      FROM w LEFT JOIN rep ON w.doc_id = rep.doc_id),
f AS (SELECT *, (CASE WHEN n_words < 50 THEN 1 ELSE 0 END
        + CASE WHEN 100 * n_repeat_words > 50 * n_words THEN 2 ELSE 0 END
        + CASE WHEN 5 * n_symbols > n_words THEN 4 ELSE 0 END
        + CASE WHEN n_lines >= 5 AND 10 * n_dup_lines > 3 * n_lines THEN 8 ELSE 0 END
        + CASE WHEN n_words > 0 AND word_chars < 2 * n_words THEN 16 ELSE 0 END
        + CASE WHEN n_words > 0 AND word_chars > 20 * n_words THEN 32 ELSE 0 END
        + CASE WHEN 2 * n_exclaims > n_words THEN 64 ELSE 0 END)::BIGINT AS fail_bits FROM m)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words,
       (fail_bits & 3) <> 0 AS base_failed, fail_bits = 0 AS kept, fail_bits FROM f
"""
