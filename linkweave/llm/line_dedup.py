"""Substring deduplication by line or paragraph hashing.

A text is cut into units: ``line`` (what stands between line breaks), ``paragraph`` (between blank
lines) or ``sentence``, where lines also end at sentence ends and, in a sentence of more than
``STRETCH`` words, at words chosen by what surrounds them, so that a unit is found again wherever
its line begins. Units are normalised (lower case, one blank between words) and each is hashed
together with as many of the next words as it takes to make ``min_words``, and if it ends a line,
with as many of the words before it: these are runs. The 95-bit digests of runs are grouped over
the whole corpus, with partial minima before the shuffle, so a run that a third of the rows hold
is combined on the map side. The occurrence of a run with the least (rank, position) stays; of
every other one, the units that lie in it whole are removed, and the original code-point offsets
of what was removed are kept. Each removed unit is left at an earlier place.

With ``min_words=1`` every repeated unit goes. By default short units go only as part of a repeated
run of ``RUN`` words: a notice of ten words that many clean documents share is no copied passage.
Any two equal passages of ``STRETCH + RUN`` words share a run: what chooses the ends of units looks
at ``STRETCH`` words at most, so both have the same units from their first ``STRETCH`` words on. A
character of a script without blanks counts as a word.

Defined cases: null texts stay null and have no units; empty and blank texts stay as they are;
between two units that stay, the widest of the gaps that lay between them stays; a document all
of whose units are removed keeps what lay before its first and after its last one; rows that
repeat id and text are one document and are treated alike; null ids rank before all others; all
columns of the documents are kept. Memory follows the longest text.
"""

from __future__ import annotations

import re
from collections import deque
from collections.abc import Iterable, Iterator
from itertools import islice

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from linkweave.llm.arrow_text import give_back
from linkweave.llm.columns import unused_name
from linkweave.runtime import checkpoint

#: Words of a run, and the most words of a sentence that stays whole.
RUN, STRETCH = 30, 20
#: Characters of scripts written without blanks (Thai, Lao, Burmese, Khmer, kana, Han), as a class in a pattern.
UNSPACED = "฀-໿က-႟ក-៿぀-ヿ㐀-䶿一-鿿豈-﫿"
WORD = re.compile(f"[{UNSPACED}]|[^\\s{UNSPACED}]+")
ANY_UNSPACED = re.compile(f"[{UNSPACED}]")
#: What a word at the end of a sentence ends with.
ENDS = frozenset(".!?。！？")

def chosen_ends(words: list[str], stretch: int = STRETCH) -> list[int]:
    """Where units end in a long sentence: of each ``stretch`` words in a row the greatest by (length, word, place) ends one."""
    keys, best, ends = [(len(w), w) for w in words], -1, []
    for start in range(len(words) - stretch + 1):
        new = start + stretch - 1
        if best < start:
            best = max(range(start, new + 1), key=lambda i: (keys[i], i))
        elif keys[new] >= keys[best]:
            best = new
        if not ends or ends[-1] != best + 1:
            ends.append(best + 1)
    return ends


def text_units(text: str, unit: str = "sentence", stretch: int = STRETCH) -> Iterator[tuple[list[str], bool]]:
    """The lower-cased words of each unit, one after the other, and whether it ends a line."""
    held: list[str] = []
    # the same words, found faster
    words_of = str.split if not ANY_UNSPACED.search(text) else WORD.findall
    for line in text.lower().split("\n"):
        words = words_of(line)
        if unit == "paragraph":
            if held and not words:
                yield held, True
                held = []
            held += words
        elif unit == "line" and words:
            yield words, True
        elif words:
            start = 0
            for stop in [*(i for i, w in enumerate(words, 1) if w[-1] in ENDS), len(words)]:
                ends = [start + end for end in chosen_ends(words[start:stop], stretch)] if stop - start > stretch else []
                for end in [*ends, stop]:
                    if end > start:
                        yield words[start:end], end == len(words)
                    start = end
    if held:
        yield held, True


def unit_runs(units: Iterable[tuple[list[str], bool]], min_words: int = RUN) -> Iterator[tuple[int, int, int]]:
    """First word, number of words and 128-bit digest of each run of a text; no two begin at the same word."""
    words: list[str] = []
    waiting: deque[tuple[int, int]] = deque()
    starts, base, total, digest = set(), 0, 0, xxhash.xxh3_128_intdigest
    for unit, closes in units:
        size = max(min_words, len(unit))
        waiting.append((total, total + size))
        starts.add(total)
        total += len(unit)
        words += unit
        while waiting and waiting[0][1] <= total:
            start, stop = waiting.popleft()
            yield start, stop - start, digest(" ".join(words[start - base : stop - base]))
        if closes and total >= size and total - size not in starts:
            yield total - size, size, digest(" ".join(words[total - size - base :]))
        if len(words) > 2000:
            needed = min(total - min_words, waiting[0][0] if waiting else total)
            del words[: max(0, needed - base)]
            base = max(base, needed)


def units_inside(units: list[tuple[list[str], bool]], starts: set[int], min_words: int = RUN) -> set[int]:
    """The numbers of the units that lie whole in a run beginning at one of ``starts``."""
    spans, inside, at, reach = deque(sorted((a, a + n) for a, n, _ in unit_runs(units, min_words) if a in starts)), set(), 0, 0
    for i, (unit, _) in enumerate(units):
        while spans and spans[0][0] <= at:
            reach = max(reach, spans.popleft()[1])
        at += len(unit)
        if at <= reach:
            inside.add(i)
    return inside


def cut_units(text: str, units: list[tuple[list[str], bool]], gone: set[int]) -> tuple[str, list[tuple[int, int]]]:
    """``text`` without the units whose numbers are in ``gone``, and the spans of what was cut, adjacent units in one."""
    found, kept, spans, wide, before = WORD.finditer(text), [], [], "", 0
    for i, (unit, _) in enumerate(units):
        words = list(islice(found, len(unit)))
        start, stop = words[0].start(), words[-1].end()
        if not i:
            kept.append(text[:start])
        gap = text[before:start] if i else ""
        if gap.count("\n") > wide.count("\n") or not wide:
            wide = gap
        if i in gone:
            spans.append((spans.pop()[0] if i - 1 in gone else start, stop))
        else:
            kept += [wide if len(kept) > 1 else "", text[start:stop]]
            wide = ""
        before = stop
    return "".join([*kept, text[before:]]), spans


#: Rows of an Arrow batch that are Python objects at a time.
SLICE = 512
_RUN = pa.struct([("position", pa.int32()), ("digest", pa.int64()), ("more", pa.int32())])
_RUN_SQL = "array<struct<position:int,digest:bigint,more:int>>"


def _runs_of(unit: str, min_words: int):
    """The runs of each text, as rows of :data:`_RUN`."""

    @F.arrow_udf(_RUN_SQL)
    def runs(columns: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for column in columns:
            yield pa.concat_arrays([some_runs(column[at : at + SLICE]) for at in range(0, max(1, len(column)), SLICE)])
        give_back()

    def some_runs(column: pa.Array) -> pa.Array:
        ends, position, digest, more = [0], [], [], []
        for value in column:
            for start, _, d in unit_runs(text_units(value.as_py() or "", unit), min_words):
                position.append(start)
                digest.append(d & 0xFFFFFFFFFFFFFFFF)
                more.append(d >> 64 & 0x7FFFFFFF)
            ends.append(len(position))
        fields = [pa.array(position, pa.int32()), pa.array(np.array(digest, np.uint64).view(np.int64)), pa.array(more, pa.int32())]
        return pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.StructArray.from_arrays(fields, fields=list(_RUN)))

    return runs


def find_repeats(docs: DataFrame, *, doc_id: str = "doc_id", text: str = "text", rank: str | None = None, unit: str = "sentence", min_words: int = RUN) -> DataFrame:
    """(id, text_hash, positions): for each document with repeats, the first words of its runs that stand earlier too."""
    own = docs.select(F.col(doc_id).alias("id"), *([F.col(rank).alias("rank")] if rank else []), F.xxhash64(text).alias("text_hash"), F.explode(_runs_of(unit, min_words)(F.col(text))).alias("r"))
    runs = own.select(*(["rank"] if rank else []), "id", "text_hash", "r.*")
    place: Column = F.struct(*(["rank"] if rank else []), "id", "text_hash", "position")
    first = runs.groupBy("digest", "more").agg(F.min(place).alias("first"), F.count("*").alias("n")).where("n > 1").select(F.col("digest").alias("d"), F.col("more").alias("m"), "first")
    # written, so that both sides of the next join are plain shuffles, whose hot digests Spark splits
    first = checkpoint(first)
    gone = runs.join(first, (F.col("digest") == F.col("d")) & (F.col("more") == F.col("m"))).where(~place.eqNullSafe(F.col("first")))
    return gone.groupBy("id", "text_hash").agg(F.array_sort(F.collect_set("position")).alias("positions"))


_REMOVED = "array<struct<start:bigint,stop:bigint>>"


def _cut_of(unit: str, min_words: int):
    """What is left of each text, how many units went, and their spans."""
    kind = pa.struct([("text", pa.string()), ("n", pa.int64()), ("spans", pa.list_(pa.struct([("start", pa.int64()), ("stop", pa.int64())])))])

    @F.arrow_udf(f"struct<text:string,n:bigint,spans:{_REMOVED}>")
    def cut(columns: Iterator[tuple[pa.Array, ...]]) -> Iterator[pa.Array]:
        for values, positions in columns:
            yield pa.concat_arrays([some_cuts(values[at : at + SLICE], positions[at : at + SLICE]) for at in range(0, max(1, len(values)), SLICE)])
        give_back()

    def some_cuts(values: pa.Array, positions: pa.Array) -> pa.Array:
        out = []
        for value, found in zip(values, positions, strict=True):
            whole, starts = value.as_py(), set(found.as_py() or [])
            if not whole or not starts:
                out.append({"text": whole, "n": 0, "spans": []})
                continue
            units = list(text_units(whole, unit))
            gone = units_inside(units, starts, min_words)
            rest, spans = cut_units(whole, units, gone)
            out.append({"text": rest, "n": len(gone), "spans": [{"start": a, "stop": b} for a, b in spans]})
        return pa.array(out, kind)

    return cut


def remove_repeats(docs: DataFrame, *, doc_id: str = "doc_id", text: str = "text", rank: str | None = None, unit: str = "sentence", min_words: int = RUN, into: str | None = None) -> DataFrame:
    """``docs`` with repeated runs cut out of the text; ``into`` names a column for (n, spans), what was cut."""
    found = find_repeats(docs, doc_id=doc_id, text=text, rank=rank, unit=unit, min_words=min_words)
    own, digest, places, cut = (unused_name(docs, c) for c in ("id", "hash", "positions", "cut"))
    found = found.select(F.col("id").alias(own), F.col("text_hash").alias(digest), F.col("positions").alias(places))
    joined = docs.join(found, docs[doc_id].eqNullSafe(F.col(own)) & (F.xxhash64(docs[text]) == F.col(digest)), "left")
    cleaned = joined.withColumn(cut, _cut_of(unit, min_words)(F.col(text), F.col(places))).withColumn(text, F.col(cut)["text"])
    if into:
        cleaned = cleaned.withColumn(into, F.struct(F.col(cut)["n"].alias("n"), F.col(cut)["spans"].alias("spans")))
    return cleaned.drop(own, digest, places, cut)


def dedup_report(docs: DataFrame, *, doc_id: str = "doc_id", text: str = "text", unit: str = "sentence", min_words: int = RUN) -> DataFrame:
    """One row per document: how many units were removed, their spans, and the text that is left."""
    own = docs.select(F.col(doc_id).alias("doc_id"), F.col(text).alias("text"))
    cleaned = remove_repeats(own, unit=unit, min_words=min_words, into="__removed")
    spans = F.array_join(F.transform("__removed.spans", lambda x: F.concat(x["start"].cast("string"), F.lit("-"), x["stop"].cast("string"))), ",")
    return cleaned.select("doc_id", F.col("__removed.n").alias("n_removed"), spans.alias("removed_spans"), "text")
