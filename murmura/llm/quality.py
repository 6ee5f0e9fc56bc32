"""Quality rules as a ledger of bits.

Every rule is evaluated once per document; the ledger keeps the measurements
and one bit per failed rule.  A policy is a versioned mask: it rejects a
document when ``failed & mask`` is not 0, so policies are changed, compared
and ablated on the ledger alone, without reading a text again.

Words are runs of characters outside ``[\\x20\\x09-\\x0D]``.  NULL and empty
texts have no words and fail ``few_words``.  Repeated rows are judged one by
one.  Other columns of the input are carried along; the ledger's own columns
replace columns of the same name.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

WHITE = " \t\n\x0b\x0c\r"
_SPLIT = "[\\x20\\x09-\\x0D]+"

# A window of three words is found by (36 bits of its hash, position) in one
# long; equal hash bits are then compared as words.
_PLACE_BITS = 28
_PLACE = (1 << _PLACE_BITS) - 1

#: Rules in the order of their bits; conditions over the measurements.
RULES = {
    "few_words": "n_words < 50",
    "repeated_words": "100 * n_repeat_words > 50 * n_words",
    "repeated_lines": "n_lines >= 4 AND 2 * n_dup_lines > n_lines",
    "symbols": "10 * n_symbols > 3 * n_words",
    "short_words": "word_chars < 2 * n_words",
    "long_words": "word_chars > 25 * n_words",
}
BIT = {name: 1 << place for place, name in enumerate(RULES)}
BASE = BIT["few_words"] | BIT["repeated_words"]
#: Masks by version.  1: the base rules; 2: every rule.
POLICIES = {1: BASE, 2: sum(BIT.values())}
POLICY = 2

MEASUREMENTS = ("n_words", "word_chars", "n_symbols", "n_lines", "n_dup_lines", "n_repeat_words")


def _equal_neighbour(array: str, same: str) -> str:
    """Condition in a filter over a sorted ``array``: element ``x`` at ``i`` has an equal neighbour."""
    before, after = (same.format(f"{array}[i {step} 1]") for step in "-+")
    return f"(i > 0 AND {before}) OR (i < size({array}) - 1 AND {after})"


def measured(docs: DataFrame) -> DataFrame:
    """``docs`` with ``MEASUREMENTS``; each is taken in one pass over the row's own text."""
    rest = [c for c in docs.columns if c not in MEASUREMENTS and not c.startswith("_q_")]
    words = F.array_remove(F.split(F.coalesce("text", F.lit("")), _SPLIT), "")
    lines = F.filter(
        F.split(F.coalesce("text", F.lit("")), "\n"), lambda x: F.btrim(x, F.lit(WHITE)) != ""
    )
    step = docs.select(*rest, words.alias("_q_words"), lines.alias("_q_lines"))
    step = step.select(
        *rest,
        "_q_words",
        F.size("_q_words").cast("long").alias("n_words"),
        F.length(F.array_join("_q_words", "")).cast("long").alias("word_chars"),
        (
            F.length(F.coalesce("text", F.lit("")))
            - F.length(F.regexp_replace(F.coalesce("text", F.lit("")), "[#*$%&|<>]", ""))
        ).cast("long").alias("n_symbols"),
        F.size("_q_lines").cast("long").alias("n_lines"),
        (F.size("_q_lines") - F.size(F.array_distinct("_q_lines"))).cast("long").alias("n_dup_lines"),
        F.expr(
            f"""CASE WHEN size(_q_words) < 3 THEN CAST(array() AS array<bigint>)
            ELSE sort_array(transform(sequence(0, size(_q_words) - 3), i ->
                (xxhash64(_q_words[i], _q_words[i + 1], _q_words[i + 2]) & ~{_PLACE}L) | i)) END"""
        ).alias("_q_codes"),
    )
    alike = _equal_neighbour(
        "_q_codes", f"shiftright({{}}, {_PLACE_BITS}) = shiftright(x, {_PLACE_BITS})"
    )
    kept = [*rest, *[m for m in MEASUREMENTS if m != "n_repeat_words"]]
    step = step.select(*kept, "_q_words", F.expr(f"filter(_q_codes, (x, i) -> {alike})").alias("_q_codes"))
    step = step.select(
        *kept,
        F.expr(
            f"""sort_array(transform(transform(_q_codes, x -> CAST(x & {_PLACE}L AS int)), p ->
            struct(concat_ws(' ', _q_words[p], _q_words[p + 1], _q_words[p + 2]) AS w, p AS p)))"""
        ).alias("_q_windows"),
    )
    equal = _equal_neighbour("_q_windows", "{}.w = x.w")
    repeated = F.expr(
        f"""CAST(size(array_distinct(flatten(transform(
        filter(_q_windows, (x, i) -> {equal}), x -> array(x.p, x.p + 1, x.p + 2))))) AS bigint)"""
    ).alias("n_repeat_words")
    # A filter on a measurement must not be pushed below this point: it would
    # repeat all the steps above in its condition.  Generated columns hold it up.
    own = F.struct(*[m for m in MEASUREMENTS if m != "n_repeat_words"], repeated)
    return step.select(*rest, F.explode(F.array(own)).alias("_q_own")).select(
        *rest, *[F.col("_q_own")[m].alias(m) for m in MEASUREMENTS]
    )


def ledger(docs: DataFrame) -> DataFrame:
    """``docs`` with the measurements and ``failed``, the bits of the rules each document fails."""
    bits: Column = F.lit(0).cast("long")
    for name, rule in RULES.items():
        bits = bits.bitwiseOR(F.when(F.expr(rule), F.lit(BIT[name])).otherwise(F.lit(0)).cast("long"))
    return measured(docs.drop("failed")).withColumn("failed", bits)


def decided(ledger: DataFrame, policy: int = POLICY) -> DataFrame:
    """``ledger`` with ``base_failed`` and ``kept`` under the policy of that version.

    Base rules reject under every policy.
    """
    mask = POLICIES[policy] | BASE
    return ledger.withColumns(
        {
            "base_failed": F.col("failed").bitwiseAND(F.lit(BASE)) != 0,
            "kept": F.col("failed").bitwiseAND(F.lit(mask)) == 0,
        }
    )


def ablation(ledger: DataFrame, policy: int = POLICY) -> DataFrame:
    """Per rule of the policy: documents failing it, failing it alone, and kept without it.

    Documents are first counted by their bits, at most ``2 ** len(RULES)``
    patterns, so what is left per rule does not grow with the corpus.
    """
    mask = POLICIES[policy] | BASE
    patterns = ledger.groupBy(F.col("failed").bitwiseAND(F.lit(mask)).alias("bits")).agg(
        F.count("*").alias("n")
    )
    names = [name for name in RULES if BIT[name] & mask]
    rules = F.explode(F.array(*[F.struct(F.lit(x).alias("rule"), F.lit(BIT[x]).cast("long").alias("bit")) for x in names]))
    rows = patterns.select("bits", "n", rules.alias("r")).select("bits", "n", "r.*")
    count = lambda condition: F.sum(F.when(condition, F.col("n")).otherwise(0))
    return rows.groupBy("rule").agg(
        count(F.col("bits").bitwiseAND(F.col("bit")) != 0).alias("n_failed"),
        count(F.col("bits") == F.col("bit")).alias("n_failed_alone"),
        count(F.col("bits").bitwiseAND(F.bitwise_not("bit")) == 0).alias("n_kept_without"),
    )
