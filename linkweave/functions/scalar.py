"""Scalar expressions over addresses, hex words, handles and labels."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

_ADDRESS = "^0x[0-9a-fA-F]{40}$"


def is_address(c: Column) -> Column:
    """Whether the trimmed text is 0x and 40 hex digits; null is not. ``0X`` is refused."""
    return F.coalesce(F.trim(c).rlike(_ADDRESS), F.lit(False))


def normalize_address(c: Column, *, strict: bool = True) -> Column:
    """The trimmed lower-case address; anything else raises, or is null if not ``strict``."""
    bad = F.raise_error(F.concat(F.lit("not an address: "), F.coalesce(c, F.lit("null")))) if strict else F.lit(None)
    return F.when(is_address(c), F.lower(F.trim(c))).otherwise(bad.cast("string"))


def hex_to_long(c: Column) -> Column:
    """An integer from 0x and up to 15 hex digits, else null."""
    return F.when(c.rlike("^0x[0-9a-fA-F]{1,15}$"), F.conv(F.substr(c, F.lit(3)), 16, 10).cast("bigint"))


def long_to_hex(c: Column) -> Column:
    return F.concat(F.lit("0x"), F.lower(F.hex(c)))


def topic_address(topic: Column) -> Column:
    """The address in the last 40 digits of a 32-byte topic."""
    return F.concat(F.lit("0x"), F.lower(F.right(topic, F.lit(40))))


def abi_address(data: Column, word: int) -> Column:
    """The address in word ``word`` (from 0) of ABI-encoded data; null if it is not there."""
    part = F.substr(data, F.lit(3 + 64 * word), F.lit(64))
    return F.when(F.length(part) == 64, topic_address(part))


def clean_handle(c: Column) -> Column:
    """Trimmed, without leading at-signs, lower case."""
    return F.lower(F.regexp_replace(F.trim(c), "^@+", ""))


def blank_to_null(c: Column) -> Column:
    return F.nullif(F.trim(c), F.lit(""))


def short_label(c: Column) -> Column:
    """``0xabcd…wxyz`` for what begins with 0x and has 12 characters, else the first 24."""
    return F.when(c.startswith("0x") & (F.length(c) >= 12), F.concat(F.substr(c, F.lit(1), F.lit(6)), F.lit("…"), F.right(c, F.lit(4)))).otherwise(F.substr(c, F.lit(1), F.lit(24)))


def strength_label(c: Column) -> Column:
    return F.when(c == 3, "strong").when(c == 2, "medium").when(c == 1, "weak")


def share_of_union(common: Column, size_a: Column, size_b: Column) -> Column:
    """Jaccard index from sizes; zero for two empty sets."""
    union = size_a + size_b - common
    return F.when(union > 0, common / union).otherwise(F.lit(0.0))


def min_overlap(common: Column, size_a: Column, size_b: Column) -> Column:
    return common / F.greatest(F.lit(1), F.least(size_a, size_b))


def logistic(x: Column) -> Column:
    return 1.0 / (1.0 + F.exp(-x))


def burst_label(span: Column, short: int) -> Column:
    return F.when(span.isNull(), "unknown").when(span == 0, "same_block").when(span <= short, "short_burst").otherwise("long_span")


def dot_escape(c: Column) -> Column:
    """Text inside a quoted DOT string."""
    return F.replace(F.replace(F.replace(c, F.lit("\\"), F.lit("\\\\")), F.lit('"'), F.lit('\\"')), F.lit("\n"), F.lit("\\n"))


def html_escape(c: Column) -> Column:
    for mark, name in (("&", "&amp;"), ("<", "&lt;"), (">", "&gt;"), ('"', "&quot;")):
        c = F.replace(c, F.lit(mark), F.lit(name))
    return c


def comma_list(c: Column) -> Column:
    """Trimmed, non-blank, lower-case members of a comma list; null gives none."""
    return F.filter(F.transform(F.split(F.coalesce(c, F.lit("")), ","), lambda x: F.lower(F.trim(x))), lambda x: x != "")


def shared_keys_of(evidence_json: Column) -> Column:
    """The keys in a cluster's stored evidence; none where it is missing or no such JSON."""
    return F.coalesce(F.from_json(evidence_json, "struct<shared_evidence_keys:array<string>>")["shared_evidence_keys"], F.array().cast("array<string>"))


def row_hash(*columns: Column) -> Column:
    """SHA-256 of the columns as JSON with their names in the order given and nulls kept."""
    return F.sha2(F.to_json(F.struct(*columns), {"ignoreNullFields": "false"}), 256)


def report_metric(markdown: Column, label: str) -> Column:
    """The number of a report's line ``- label...: **number**``, null if there is none."""
    number = F.regexp_extract(markdown, rf"(?m)^- {label}[^\n]*?: \*\*([0-9.]+)\*\*", 1)
    return F.nullif(number, F.lit("")).cast("double")
