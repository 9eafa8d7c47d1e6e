"""Quality rules as a ledger of failure bits.

Every rule is evaluated once for each document; its outcome is one bit of ``fail_bits`` and its measurement a column.
Policies are versioned masks over those bits, so a new policy, or the effect of leaving a rule out, needs no second
look at any text: ``kept`` is ``fail_bits & mask = 0`` and ablations are sums over the few distinct bit patterns.

Everything stays in one projection over the scan: no shuffle, no Python on the executors, nothing to collect.
Nulls count as empty texts; an empty text has no words and fails ``few_words``. Repeated rows stay, one ledger row each.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from freshet.llm.common import WS, let, pack, words

SYMBOLS = "#*$%&|<>"
WINDOW = 5


@dataclass(frozen=True)
class Rule:
    """A rule fails where ``fails`` holds over the measurements (a struct)."""

    name: str
    fails: Callable[[Column], Column]


MEASURES = ("n_words", "word_chars", "n_symbols", "n_exclaim", "n_lines", "n_dup_lines", "n_repeat_words")


#: The order fixes the bits; append, never reorder.
RULES = (
    Rule("few_words", lambda m: m["n_words"] < 10),
    Rule("repeated_words", lambda m: 100 * m["n_repeat_words"] > 20 * m["n_words"]),
    Rule("symbols", lambda m: 100 * m["n_symbols"] > 20 * m["word_chars"]),
    Rule("duplicate_lines", lambda m: 100 * m["n_dup_lines"] > 50 * m["n_lines"]),
    Rule("long_words", lambda m: m["word_chars"] > 40 * m["n_words"]),
    Rule("exclamation", lambda m: m["n_exclaim"] > m["n_words"]),
)
BIT = {r.name: 1 << k for k, r in enumerate(RULES)}
BASE = ("few_words", "repeated_words")
#: Versioned policies: the rules that reject a document.
POLICIES = {
    1: BASE,
    2: (*BASE, "symbols", "duplicate_lines"),
    3: tuple(r.name for r in RULES),
}
CURRENT = 3


def mask(policy: int) -> int:
    return sum(BIT[name] for name in POLICIES[policy])


def _repeated(w: Column, hashed: Column, n: Column) -> Column:
    """Words inside windows that occur twice or more. Equal window hashes only send a text to the exact count."""
    starts = F.sequence(F.lit(1), n - (WINDOW - 1))
    hashes = F.transform(starts, lambda i: F.xxhash64(F.slice(hashed, i, WINDOW)))
    keyed = F.transform(starts, lambda i: F.struct(F.array_join(F.slice(w, i, WINDOW), " ").alias("k"), i.alias("i")))

    def covered(s: Column) -> Column:
        twice = F.filter(
            s,
            lambda x, j: F.coalesce(x["k"] == F.get(s, j - 1)["k"], F.lit(False)) | F.coalesce(x["k"] == F.get(s, j + 1)["k"], F.lit(False)),
        )
        at = F.sort_array(F.transform(twice, lambda x: x["i"]))
        zero = F.struct(F.lit(0).alias("n"), F.lit(1 - WINDOW).alias("last"))
        return F.aggregate(
            at,
            zero,
            lambda a, p: F.struct((a["n"] + F.least(F.lit(WINDOW), p - a["last"])).alias("n"), p.alias("last")),
            lambda a: a["n"],
        )

    none = let(hashes, lambda h: F.size(F.array_distinct(h)) == F.size(h))
    return F.when(n < WINDOW, 0).when(none, 0).otherwise(let(F.sort_array(keyed), covered))


def measurements(text: Column) -> Column:
    """struct of all measurements and fail_bits, as one expression: words and lines are bound once inside it, so it costs
    the same wherever the optimiser moves it (a filter pushed below a projection would otherwise split words anew in every
    step of a lambda)."""

    def of(t: Column) -> Column:
        lines = F.filter(F.split(t, "\n"), lambda x: x.rlike(WS.replace("[", "[^")))
        return let(words(t), lambda w: let(lines, lambda ls: let(base(t, w, ls), with_bits)))

    def base(t: Column, w: Column, ls: Column) -> Column:
        repeated = let(F.transform(w, lambda x: F.xxhash64(x)), lambda h: _repeated(w, h, F.size(w)))
        values = {
            "n_words": F.size(w),
            "word_chars": F.length(F.array_join(w, "")),
            "n_symbols": F.length(F.regexp_replace(t, f"[^{SYMBOLS}]++", "")),
            "n_exclaim": F.length(F.regexp_replace(t, "[^!]++", "")),
            "n_lines": F.size(ls),
            "n_dup_lines": F.size(ls) - F.size(F.array_distinct(ls)),
            "n_repeat_words": repeated,
        }
        return F.struct(*[c.cast("long").alias(k) for k, c in values.items()])

    def with_bits(m: Column) -> Column:
        bits = F.lit(0).cast("long")
        for rule in RULES:
            bits = bits.bitwiseOR(F.when(rule.fails(m), F.lit(BIT[rule.name])).otherwise(F.lit(0)).cast("long"))
        return F.struct(*[m[k].alias(k) for k in MEASURES], bits.alias("fail_bits"))

    return let(F.coalesce(text, F.lit("")), of)


def ledger(docs: DataFrame, text: str = "text") -> DataFrame:
    """``__row`` (the document), the measurements and ``fail_bits``."""
    return pack(docs, __m=measurements(docs[f"`{text}`"])).select("__row", "__m.*")


def verdict(led: DataFrame, policy: int = CURRENT) -> DataFrame:
    """``kept`` under a policy; a document that fails a base rule is never kept."""
    base = F.col("fail_bits").bitwiseAND(F.lit(sum(BIT[b] for b in BASE)).cast("long")) != 0
    ours = F.col("fail_bits").bitwiseAND(F.lit(mask(policy)).cast("long")) != 0
    return led.withColumns({"base_failed": base, "kept": ~base & ~ours, "policy": F.lit(policy)})


def ablation(led: DataFrame, policy: int = CURRENT) -> DataFrame:
    """For each rule of a policy: documents that fail it, that only it rejects, and that are kept without it.

    The ledger shrinks to its distinct bit patterns (at most two to the number of rules) before the rules are looked at.
    """
    patterns = led.groupBy(F.col("fail_bits").bitwiseAND(F.lit(mask(policy)).cast("long")).alias("bits")).agg(F.count("*").alias("n"))
    rules = F.explode(F.array(*[F.struct(F.lit(n).alias("rule"), F.lit(BIT[n]).cast("long").alias("bit")) for n in POLICIES[policy]]))
    each = patterns.select("bits", "n", rules.alias("r")).select("bits", "n", "r.*")
    hit = F.col("bits").bitwiseAND(F.col("bit")) != 0
    n = F.col("n")
    return each.groupBy("rule", "bit").agg(
        F.sum(F.when(hit, n).otherwise(0)).alias("n_failed"),
        F.sum(F.when(F.col("bits") == F.col("bit"), n).otherwise(0)).alias("n_only_this"),
        F.sum(F.when(F.col("bits").bitwiseAND(F.bitwise_not(F.col("bit"))) == 0, n).otherwise(0)).alias("n_kept_without"),
    )


def keep(docs: DataFrame, text: str = "text", policy: int = CURRENT) -> DataFrame:
    """The documents that the policy keeps, with their own columns only."""
    rejects = F.lit(mask(policy) | sum(BIT[b] for b in BASE)).cast("long")
    return ledger(docs, text).filter(F.col("fail_bits").bitwiseAND(rejects) == 0).select("__row.*")


def report(docs: DataFrame, key: str = "doc_id", text: str = "text", policy: int = CURRENT) -> DataFrame:
    """One row for each document: its key, measurements, bits and verdict."""
    cols = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept", "fail_bits", "policy", "n_lines", "n_exclaim"]
    return verdict(ledger(docs, text), policy).select(F.col(f"__row.`{key}`").alias(key), *cols)
