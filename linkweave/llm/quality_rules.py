"""Quality rules as a bitmask ledger, in DataFrame functions only.

Every rule is evaluated once. A ledger row keeps the measurements and one long whose bit k is
set where rule k fails. A policy is a version and the rules it enforces, that is a mask; it is
applied to the ledger with a bitwise AND, and an ablation (what would stay if a rule were left
out) with one aggregation over the masks. Neither reads a text again.

Repeats inside a text are found without a shuffle: each window's words are hashed to 64 bits,
and only a text whose window hashes are not all distinct is looked at further, by sorting
(hash, position) and adding up the covered words in order. Windows count as equal when their
64-bit hashes are: one text of a million words has such a pair by chance once in 10^7 texts.

Defined cases: a null or empty text has no words and fails ``few_words``; repeated rows are
alike; rules that divide by a count of zero pass; other columns are kept.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

WINDOW = 8


@dataclass(frozen=True)
class Rule:
    bit: int
    name: str
    fails: str


#: Bits are never given anew; a rule that changes takes the next one.
RULES = (
    Rule(0, "few_words", "n_words < 20"),
    Rule(1, "repeated_words", "100 * n_repeat_words > 30 * n_words"),
    Rule(2, "symbols", "10 * n_symbols > 3 * n_words"),
    Rule(3, "repeated_lines", "10 * n_dup_lines > 3 * n_lines"),
    Rule(4, "short_words", "word_chars < 2 * n_words"),
    Rule(5, "long_words", "word_chars > 25 * n_words"),
    Rule(6, "many_words", "n_words > 1000000"),
    Rule(7, "repeated_line_chars", "5 * dup_line_chars > line_chars"),
)


@dataclass(frozen=True)
class Policy:
    version: str
    rules: tuple[str, ...]

    @property
    def mask(self) -> int:
        known = {r.name: 1 << r.bit for r in RULES}
        return sum(known[name] for name in self.rules)


POLICIES = {
    "base": Policy("base", ("few_words", "repeated_words")),
    "v1": Policy("v1", ("few_words", "repeated_words", "symbols", "repeated_lines", "short_words", "long_words")),
    # a short text with one line twice fails v1; what counts here is the share of its characters, as published rules have it
    "v2": Policy("v2", ("few_words", "repeated_words", "symbols", "repeated_line_chars", "short_words", "long_words")),
}


def _let(value: Column, body) -> Column:
    """``body`` of ``value``, which is computed once however often the body names it."""
    return F.transform(F.array(value), body)[0]


def _repeat_words(hashes: Column) -> Column:
    """Words under windows whose hash occurs twice or more; ``hashes`` by window position."""

    def covered(ordered: Column) -> Column:
        size = F.size(ordered)
        same = lambda x, i: ((i > 0) & (x["h"] == F.try_element_at(ordered, F.when(i > 0, i).otherwise(1))["h"])) | ((i < size - 1) & (x["h"] == F.try_element_at(ordered, F.least(i + 2, size))["h"]))
        positions = F.sort_array(F.transform(F.filter(ordered, same), lambda x: x["p"]))
        start = F.struct(F.lit(0).alias("n"), F.lit(0).alias("end"))
        return F.aggregate(positions, start, lambda s, p: F.struct((s["n"] + p + WINDOW - F.greatest(s["end"], p)).alias("n"), (p + WINDOW).alias("end")), lambda s: s["n"])

    repeats = _let(F.array_sort(F.transform(hashes, lambda h, i: F.struct(h.alias("h"), i.alias("p")))), covered)
    return F.when(F.size(F.array_distinct(hashes)) == F.size(hashes), F.lit(0)).otherwise(repeats)


def _window_hashes(words: Column) -> Column:
    """A 64-bit hash of each ``WINDOW`` consecutive words."""
    each = F.transform(words, lambda w: F.xxhash64(w))
    last = F.size(words) - WINDOW
    return F.when(last < 0, F.array().cast("array<bigint>")).otherwise(_let(each, lambda a: F.transform(F.sequence(F.lit(1), F.greatest(last, F.lit(0)) + 1), lambda i: F.xxhash64(F.slice(a, i, WINDOW)))))


_BLANK = r"[\x20\x09-\x0D]"


def measurements(text: Column) -> Column:
    """All measurements of a text as one struct, from one split into words and one into lines."""
    whole = F.coalesce(text, F.lit(""))
    words = F.array_remove(F.split(whole, _BLANK + "+"), "")

    def of_words(w: Column) -> Column:
        return F.struct(
            F.size(w).cast("bigint").alias("n_words"),
            F.aggregate(w, F.lit(0).cast("bigint"), lambda n, x: n + F.length(x)).alias("word_chars"),
            _let(_window_hashes(w), _repeat_words).cast("bigint").alias("n_repeat_words"),
        )

    def of_lines(lines: Column) -> Column:
        chars = lambda a: F.aggregate(a, F.lit(0).cast("bigint"), lambda n, x: n + F.length(x))
        return F.struct(
            F.size(lines).cast("bigint").alias("n_lines"),
            (F.size(lines) - F.size(F.array_distinct(lines))).cast("bigint").alias("n_dup_lines"),
            chars(lines).alias("line_chars"),
            (chars(lines) - chars(F.array_distinct(lines))).alias("dup_line_chars"),
        )

    lines = F.filter(F.split(whole, "\n"), lambda x: x.rlike(r"[^\x20\x09-\x0D]"))
    symbols = (F.length(whole) - F.length(F.regexp_replace(whole, r"[#*$%&|<>]+", ""))).cast("bigint")
    return F.struct(_let(words, of_words).alias("w"), _let(lines, of_lines).alias("l"), symbols.alias("s"))


def ledger(docs: DataFrame, *, text: str = "text", into: str = "quality_ledger") -> DataFrame:
    """``docs`` with a struct ``into``: the measurements and ``failed``, the bits of the rules that fail."""
    m = F.col("__m")
    named = {"n_words": m["w"]["n_words"], "word_chars": m["w"]["word_chars"], "n_symbols": m["s"], "n_lines": m["l"]["n_lines"], "n_dup_lines": m["l"]["n_dup_lines"], "line_chars": m["l"]["line_chars"], "dup_line_chars": m["l"]["dup_line_chars"], "n_repeat_words": m["w"]["n_repeat_words"]}
    measured = docs.withColumn("__m", F.explode(F.array(measurements(F.col(text))))).withColumn("__m", F.struct(*[v.alias(k) for k, v in named.items()]))
    bits = " + ".join(f"(case when {_qualified(r.fails, named)} then {1 << r.bit}L else 0L end)" for r in RULES)
    return measured.withColumn(into, F.struct(*[m[k].alias(k) for k in named], F.expr(bits).alias("failed"))).drop("__m")


def _qualified(condition: str, names: dict[str, Column]) -> str:
    return " ".join(f"__m.{token}" if token in names else token for token in condition.split())


def applies(ledger_column: Column, policy: Policy) -> Column:
    """Whether a row passes every rule of the policy."""
    return ledger_column["failed"].bitwiseAND(F.lit(policy.mask).cast("bigint")) == 0


def ablations(rows: DataFrame, policy: Policy, *, ledger_column: str = "quality_ledger") -> DataFrame:
    """One row per rule of the policy: rows that fail it, and rows that fail nothing else and would come back without it.

    One pass over the ledger; the rules' counts are partial sums of bits, so no row is repeated per rule.
    """
    failed = F.col(ledger_column)["failed"].bitwiseAND(F.lit(policy.mask).cast("bigint"))
    bits = {r.name: 1 << r.bit for r in RULES if r.name in policy.rules}
    sums = rows.agg(*[F.count_if(failed.bitwiseAND(F.lit(b).cast("bigint")) != 0).alias(f"f{b}") for b in bits.values()], *[F.count_if(failed == b).alias(f"o{b}") for b in bits.values()], F.bit_or(failed).alias("any_failed"))
    each = F.array(*[F.struct(F.lit(name).alias("rule"), F.col(f"f{b}").alias("n_failed"), F.col(f"o{b}").alias("n_only"), (F.coalesce("any_failed", F.lit(0)).bitwiseAND(F.lit(b).cast("bigint")) != 0).alias("ever_failed")) for name, b in bits.items()])
    return sums.select(F.explode(each).alias("r")).select(F.lit(policy.version).alias("policy"), "r.*")


def rule_report(docs: DataFrame, *, doc_id: str = "doc_id", text: str = "text", policy: Policy = POLICIES["v2"]) -> DataFrame:
    """One row per document: measurements, the base verdict and the policy's."""
    q = F.col("__ledger")
    return ledger(docs, text=text, into="__ledger").select(
        F.col(doc_id).alias("doc_id"),
        *[q[k].alias(k) for k in ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")],
        (~applies(q, POLICIES["base"])).alias("base_failed"),
        (applies(q, POLICIES["base"]) & applies(q, policy)).alias("kept"),
        q["failed"].alias("failed_bits"),
    )
