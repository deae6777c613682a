r"""Fill-in-middle documents by escaped marker injection, in DataFrame functions only.

A text is cut into units, by default words of ASCII letters and every other code point alone.
A delimiter is escaped where the text has it, ``regexp_replace`` then appends it after every
unit, so the units are counted by counting it, and ``substring_index`` takes the first or last
k of them. What is taken loses its delimiters, is unescaped and assembled between markers. An
escaped delimiter counts as the one unit it stands for. No array of units is ever built: a text
needs about twice its length, whatever the number of units, and nothing is shuffled.

Two cut points, the form (``psm``: prefix, suffix, middle; ``spm``: suffix, prefix, middle;
``plain``: the text as it is) and so the output follow from the SHA-256 of the id with a seed,
so a lost task gives the same rows again.

Defined cases: a null or empty text is plain with an empty output; a text that holds a marker
is plain, so markers in an output are always the operator's own and :func:`restored` gives the
text back; a null id counts as an id without digits; repeated rows give equal outputs; an empty
table gives no rows; other columns are kept, and a column named like ``into`` is replaced.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from linkweave.llm.columns import unused_name

#: The delimiter and the escape character; a text may hold both.
DELIMITER, ESCAPE = "\x01", "\x02"
_DELIMITER, _ESCAPE = ESCAPE + "1", ESCAPE + "0"
UNITS = r"[A-Za-z]+|[^A-Za-z]"


@dataclass(frozen=True)
class Markers:
    prefix: str = "<P>"
    suffix: str = "<S>"
    middle: str = "<M>"

    def __post_init__(self) -> None:
        """No marker may begin inside another one or inside itself, else an output could be read in two ways."""
        every = (self.prefix, self.suffix, self.middle)
        if any(a[k:].startswith(b[: len(a) - k]) for i, a in enumerate(every) for j, b in enumerate(every) for k in range(len(a)) if (k, i) != (0, j)):
            raise ValueError("markers overlap")

    def within(self, text: Column) -> Column:
        return text.contains(self.prefix) | text.contains(self.suffix) | text.contains(self.middle)


def mark_units(text: Column, units: str = UNITS) -> Column:
    """``text`` escaped, with the delimiter after each unit."""
    escaped = F.replace(F.replace(text, F.lit(ESCAPE), F.lit(_ESCAPE)), F.lit(DELIMITER), F.lit(_DELIMITER))
    return F.regexp_replace(escaped, f"{ESCAPE}[01]|{units}", f"$0{DELIMITER}")


def count_units(marked: Column) -> Column:
    """Delimiters of a marked text; in UTF-8 the delimiter is one byte, as in no other code point."""
    return (F.octet_length(marked) - F.octet_length(F.replace(marked, F.lit(DELIMITER), F.lit("")))).cast("bigint")


def first_units(marked: Column, k: Column) -> Column:
    """The first ``k`` units, still marked but for the last one's delimiter."""
    return F.call_function("substring_index", marked, F.lit(DELIMITER), k.cast("int"))


def last_units(marked: Column, k: Column) -> Column:
    return F.call_function("substring_index", marked, F.lit(DELIMITER), (-k).cast("int"))


def plain_text(marked: Column) -> Column:
    """A marked part without its delimiters, unescaped."""
    bare = F.replace(marked, F.lit(DELIMITER), F.lit(""))
    return F.replace(F.replace(bare, F.lit(_DELIMITER), F.lit(DELIMITER)), F.lit(_ESCAPE), F.lit(ESCAPE))


def draws(doc_id: Column, seed: int) -> list[Column]:
    """Four unsigned 32-bit numbers from the SHA-256 of the seed and the id."""
    digest = F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(doc_id.cast("string"), F.lit(""))), 256)
    return [F.conv(F.substring(digest, 8 * i + 1, 8), 16, 10).cast("bigint") for i in range(4)]


def fill_in_middle(docs: DataFrame, *, doc_id: str = "doc_id", text: str = "text", into: str = "fim", seed: int = 1, markers: Markers = Markers(), units: str = UNITS, percent: int = 90, spm_percent: int = 20) -> DataFrame:
    """``docs`` with ``into``: n, form, prefix, middle and suffix (null if plain), and output.

    ``percent`` of the texts are transformed, ``spm_percent`` of those with the suffix first.
    ``units`` is a pattern whose matches, from left to right, cover every text.
    """
    body = F.coalesce(F.col(text), F.lit(""))
    h1, h2, h3, h4 = draws(F.col(doc_id), seed)
    m = unused_name(docs, into)
    steps = docs.withColumn(m, F.struct(body.alias("text"), mark_units(body, units).alias("marked"), h1.alias("h1"), h2.alias("h2"), h3.alias("h3"), h4.alias("h4")))
    steps = steps.withColumn(m, F.struct(f"{m}.*", count_units(F.col(f"{m}.marked")).alias("n")))
    at1, at2 = (F.col(f"{m}.{h}") % (F.col(f"{m}.n") + 1) for h in ("h1", "h2"))
    plain = (F.col(f"{m}.text") == "") | markers.within(F.col(f"{m}.text")) | (F.col(f"{m}.h3") % 100 >= percent)
    form = F.when(plain, "plain").when(F.col(f"{m}.h4") % 100 < spm_percent, "spm").otherwise("psm")
    steps = steps.withColumn(m, F.struct(f"{m}.*", F.least(at1, at2).alias("a"), F.greatest(at1, at2).alias("b"), form.alias("form")))
    marked, n, a, b = (F.col(f"{m}.{c}") for c in ("marked", "n", "a", "b"))
    cut = F.col(f"{m}.form") != "plain"
    part = lambda column: F.when(cut, plain_text(column))
    # a marked text ends in a delimiter, so one more piece, an empty one, is counted from the right
    parts = [part(first_units(marked, a)).alias("prefix"), part(last_units(first_units(marked, b), b - a)).alias("middle"), part(last_units(marked, n - b + 1)).alias("suffix")]
    steps = steps.withColumn(m, F.struct(F.col(f"{m}.text").alias("text"), F.col(f"{m}.n").alias("n"), F.col(f"{m}.form").alias("form"), *parts))
    p, s, mid = (F.col(f"{m}.{c}") for c in ("prefix", "suffix", "middle"))
    output = (
        F.when(F.col(f"{m}.form") == "psm", F.concat(F.lit(markers.prefix), p, F.lit(markers.suffix), s, F.lit(markers.middle), mid))
        .when(F.col(f"{m}.form") == "spm", F.concat(F.lit(markers.suffix), s, F.lit(markers.prefix), p, F.lit(markers.middle), mid))
        .otherwise(F.col(f"{m}.text"))
    )
    return steps.withColumn(into, F.struct(*[F.col(f"{m}.{c}").alias(c) for c in ("n", "form", "prefix", "middle", "suffix")], output.alias("output"))).drop(m)


def restored(output: Column, form: Column, markers: Markers = Markers()) -> Column:
    """The text, from an output and its form alone."""
    before = lambda c, marker: F.substring_index(c, marker, 1)
    after = lambda c, marker: F.substring_index(c, marker, -1)
    head, middle = before(output, markers.middle), after(output, markers.middle)
    psm = F.concat(after(before(head, markers.suffix), markers.prefix), middle, after(head, markers.suffix))
    spm = F.concat(after(head, markers.prefix), middle, after(before(head, markers.prefix), markers.suffix))
    return F.when(form == "psm", psm).when(form == "spm", spm).otherwise(output)


def fim_report(docs: DataFrame, *, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """Per document: its units, form, lengths of prefix and middle, and digests of output and restored text."""
    made = fill_in_middle(docs.select(F.col(doc_id).alias("doc_id"), F.col(text).alias("text")), into="f")
    f = F.col("f")
    return made.select(
        "doc_id",
        f["n"].alias("n"),
        f["form"].alias("form"),
        F.length(f["prefix"]).cast("bigint").alias("prefix_chars"),
        F.length(f["middle"]).cast("bigint").alias("middle_chars"),
        F.sha2(f["output"], 256).alias("output_sha256"),
        F.sha2(restored(f["output"], f["form"]), 256).alias("restored_sha256"),
    )
