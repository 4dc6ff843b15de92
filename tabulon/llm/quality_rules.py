"""Rule bitmask ledger: every rule is evaluated once, its failures are bits of one integer,
and versioned policies or ablations are bit operations on that integer.

Plain column expressions only. Defined cases: a null text counts as empty; an empty text has
no words and fails `few_words`; repeated rows stay as they are; extra columns are dropped
except the id; an empty table gives an empty ledger.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

SPACE = r"[\x20\x09-\x0D]+"


@dataclass(frozen=True)
class Rule:
    name: str
    #: SQL over the measurement columns, true where the text fails; integers only, so that every engine agrees
    fails: str


RULES = (
    Rule("few_words", "n_words < 50"),
    Rule("repeated_words", "100 * n_repeat_words > 50 * n_words"),
    Rule("symbols", "10 * n_symbols > n_words"),
    Rule("repeated_lines", "100 * n_dup_lines > 75 * n_lines"),
    Rule("capitals", "100 * n_upper > 40 * word_chars"),
    Rule("short_words", "word_chars < 2 * n_words"),
    Rule("long_words", "word_chars > 15 * n_words"),
    Rule("exclamations", "10 * n_exclaim > n_words"),
)
BIT = {rule.name: 1 << i for i, rule in enumerate(RULES)}
#: (policy, version) -> the rules that decide
POLICIES = {
    ("base", 1): ("few_words", "repeated_words"),
    ("clean", 1): tuple(BIT),
}


def mask_of(policy: str, version: int) -> int:
    return sum(BIT[name] for name in POLICIES[policy, version])


def _let(value: Column, body) -> Column:
    """body(value) with value evaluated once: inside the lambda it is a variable, not a repeated expression."""
    return F.element_at(F.transform(F.array(value), body), 1)


def _size(array: Column) -> Column:
    return F.size(array).cast("long")


def repeated_words(words: Column) -> Column:
    """How many words lie in a 3-word window that occurs twice or more.

    Windows are compared by a 64-bit hash of the three words. Sorting (hash, place) puts equal
    windows side by side; the places that have an equal neighbour, sorted again, cover
    min(3, gap to the next place) words each. n log n in the words of one text.
    """

    def keys(w: Column) -> Column:
        at = F.when(F.size(w) >= 3, F.sequence(F.lit(0), F.size(w) - 3)).otherwise(F.array().cast("array<int>"))
        return F.transform(at, lambda i: F.xxhash64(F.get(w, i), F.get(w, i + 1), F.get(w, i + 2)))

    def places(k: Column) -> Column:
        pairs = F.array_sort(F.transform(k, lambda x, i: F.struct(x.alias("k"), i.alias("i"))))
        return _let(
            pairs,
            lambda s: F.sort_array(
                F.filter(
                    F.transform(
                        s,
                        lambda e, j: F.when(
                            (F.get(s, j + 1)["k"] == e["k"]) | ((j > 0) & (F.get(s, F.greatest(j - 1, F.lit(0)))["k"] == e["k"])),
                            e["i"],
                        ).otherwise(F.lit(-1)),
                    ),
                    lambda p: p >= 0,
                )
            ),
        )

    def covered(p: Column) -> Column:
        gaps = F.transform(p, lambda x, j: F.least(F.coalesce(F.get(p, j + 1) - x, F.lit(3)), F.lit(3)).cast("long"))
        return F.aggregate(gaps, F.lit(0).cast("long"), lambda total, g: total + g)

    def count(k: Column) -> Column:
        return F.when(F.size(F.array_distinct(k)) == F.size(k), F.lit(0).cast("long")).otherwise(_let(places(k), covered))

    return _let(words, lambda w: _let(keys(w), count))


def ledger(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", keep: tuple[str, ...] = ()) -> DataFrame:
    """id, the measurements and fail_bits; columns named in `keep` come along in one struct, `kept_columns`, so no name can clash."""
    text = F.coalesce(F.col(text_col), F.lit(""))
    only = lambda kept: F.length(F.regexp_replace(F.col("_text"), kept, "")).cast("long")
    lines = F.filter(F.split(F.col("_text"), "\n"), lambda x: x.rlike(r"[^\x20\x09-\x0D]"))
    along = [F.struct(*keep).alias("kept_columns")] if keep else []
    named = ["kept_columns"] if keep else []
    # a row number is no function of its row, so a filter on the bits stays above: below, it would evaluate every rule again
    once = F.monotonically_increasing_id().alias("_row")
    measured = docs.select(F.col(id_col).alias("doc_id"), text.alias("_text"), *along).select(
        "doc_id",
        *named,
        once,
        only(SPACE).alias("word_chars"),
        only(r"[^#*$%&|<>]+").alias("n_symbols"),
        only(r"[^\p{Lu}]+").alias("n_upper"),
        only("[^!]+").alias("n_exclaim"),
        _let(lines, lambda x: F.struct(_size(x).alias("n"), (_size(x) - _size(F.array_distinct(x))).alias("dup"))).alias("_lines"),
        _let(
            F.filter(F.split(F.col("_text"), SPACE), lambda w: w != ""),
            lambda w: F.struct(_size(w).alias("n"), repeated_words(w).alias("rep")),
        ).alias("_words"),
    )
    named = measured.select(
        "doc_id",
        *named,
        F.col("_words.n").alias("n_words"),
        "word_chars",
        "n_symbols",
        F.col("_lines.dup").alias("n_dup_lines"),
        F.col("_words.rep").alias("n_repeat_words"),
        F.col("_lines.n").alias("n_lines"),
        "n_upper",
        "n_exclaim",
    )
    bits = " + ".join(f"CASE WHEN {rule.fails} THEN {BIT[rule.name]} ELSE 0 END" for rule in RULES)
    return named.withColumn("fail_bits", F.expr(f"CAST({bits} AS BIGINT)"))


def passes(policy: str, version: int) -> Column:
    return F.col("fail_bits").bitwiseAND(F.lit(mask_of(policy, version)).cast("long")) == 0


def accepted(docs: DataFrame, policy: str = "clean", version: int = 1, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The rows of `docs`, with all their columns, that a policy keeps."""
    return ledger(docs, id_col, text_col, keep=tuple(docs.columns)).filter(passes(policy, version)).select("kept_columns.*")


def ablation(book: DataFrame, policy: str, version: int) -> DataFrame:
    """For each rule of a policy: texts that fail it, texts that only it rejects, texts kept without it.

    The ledger is first counted by bit pattern (at most 2^rules rows), so the rules' counts never touch the texts again.
    """
    mask = mask_of(policy, version)
    patterns = book.groupBy(F.col("fail_bits").bitwiseAND(F.lit(mask).cast("long")).alias("bits")).agg(F.count(F.lit(1)).alias("n"))
    rules = F.explode(F.array(*(F.struct(F.lit(n).alias("rule"), F.lit(BIT[n]).cast("long").alias("bit")) for n in POLICIES[policy, version])))
    rest = F.col("bits").bitwiseAND(F.bitwise_not("bit"))
    sum_if = lambda cond: F.sum(F.when(cond, F.col("n")).otherwise(0))
    return (
        patterns.select("bits", "n", rules.alias("r"))
        .select("bits", "n", "r.rule", "r.bit")
        .groupBy("rule")
        .agg(
            sum_if(F.col("bits").bitwiseAND(F.col("bit")) != 0).alias("n_failing"),
            sum_if(F.col("bits") == F.col("bit")).alias("n_only"),
            sum_if(rest == 0).alias("n_kept_without"),
        )
    )


def op7(spark, sf_dir: str) -> DataFrame:
    from tabulon.llm.common import table

    book = ledger(table(spark, sf_dir, "documents"))
    return book.select(
        "doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words",
        (~passes("base", 1)).alias("base_failed"),
        passes("clean", 1).alias("kept"),
        "fail_bits", "n_lines", "n_upper", "n_exclaim",
    )


def _sql() -> str:
    bits = " + ".join(f"CASE WHEN {rule.fails} THEN {BIT[rule.name]} ELSE 0 END" for rule in RULES)
    space = r"[ \t\n\v\f\r]"
    return rf"""
WITH t AS (SELECT row_number() OVER () AS rid, doc_id, coalesce(text, '') AS text FROM documents),
w AS (SELECT rid, regexp_extract_all(text, '[^ \t\n\v\f\r]+') AS words FROM t),
tri AS (SELECT rid, i, words[i] AS a, words[i + 1] AS b, words[i + 2] AS c
        FROM (SELECT rid, words, unnest(range(1, len(words) - 1)) AS i FROM w)),
dup AS (SELECT rid, i FROM tri QUALIFY count(*) OVER (PARTITION BY rid, a, b, c) > 1),
cover AS (SELECT rid, count(DISTINCT i + o) AS n FROM dup, (VALUES (0), (1), (2)) v(o) GROUP BY rid),
ln AS (SELECT rid, list_filter(string_split(text, chr(10)), lambda x: regexp_matches(x, '[^ \t\n\v\f\r]')) AS lines FROM t),
m AS (SELECT t.rid, doc_id, CAST(len(words) AS BIGINT) AS n_words,
        CAST(length(regexp_replace(text, '{space}+', '', 'g')) AS BIGINT) AS word_chars,
        CAST(length(regexp_replace(text, '[^#*$%&|<>]+', '', 'g')) AS BIGINT) AS n_symbols,
        CAST(len(lines) - len(list_distinct(lines)) AS BIGINT) AS n_dup_lines,
        CAST(coalesce(cover.n, 0) AS BIGINT) AS n_repeat_words,
        CAST(len(lines) AS BIGINT) AS n_lines,
        CAST(length(regexp_replace(text, '[^\p{{Lu}}]+', '', 'g')) AS BIGINT) AS n_upper,
        CAST(length(regexp_replace(text, '[^!]+', '', 'g')) AS BIGINT) AS n_exclaim
      FROM t JOIN w USING (rid) JOIN ln USING (rid) LEFT JOIN cover USING (rid)),
b AS (SELECT *, CAST({bits} AS BIGINT) AS fail_bits FROM m)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words,
       (n_words < 50 OR 100 * n_repeat_words > 50 * n_words) AS base_failed,
       (fail_bits & {mask_of("clean", 1)}) = 0 AS kept, fail_bits, n_lines, n_upper, n_exclaim
FROM b"""


OP7_SQL = _sql()
