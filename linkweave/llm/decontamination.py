"""Benchmark decontamination: scan token windows against a broadcast set of test n-grams.

Every benchmark item is normalised (A-Z lower-cased, words are runs of digits, a-z and
non-ASCII characters) and cut into windows of ``window`` consecutive words; a shorter item
that has any word is one window. The windows' 64-bit hashes are broadcast in blocks of a
fixed byte bound, documents are scanned whole with NumPy, and each hash match is verified
word by word before it counts.

Defined cases: null or wordless texts have no words and no hits; a null item text has no
windows; a null item id still hits but is not counted or listed as an item; repeated items
and repeated documents behave as one item and as separate rows; an empty benchmark leaves
every document clean; columns of the documents are kept and never read but for the text.
A text of over 4 MB is scanned in overlapping slices, so it takes memory for its bytes and not
for all its words at once.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from linkweave.llm.arrow_text import LOWER, LOWER_BYTES, blocks
from linkweave.llm.columns import unused_name
from linkweave.runtime import checkpoint

#: Bytes of benchmark text that one broadcast block holds on average at most; an index of it takes
#: some eight times as much memory in a worker.
BLOCK_BYTES = 1 << 24

#: A longer text is scanned in slices of about this many bytes.
_SLICE = 1 << 22

_WORD = np.zeros(256, dtype=bool)
_WORD[48:58] = _WORD[97:123] = True
_WORD[128:] = True
_BASE, _STEP = np.uint64(0x9E3779B97F4A7C15 | 1), np.uint64(0xD6E8FEB86659FD93)
_INVERSE = np.uint64(pow(int(_BASE), -1, 1 << 64))
_NOTHING = (np.zeros(0, np.int64),) * 3 + (np.zeros(0, np.uint64),)

HIT_TYPE = "struct<n_words:bigint,covered:array<struct<first:bigint,stop:bigint>>,items:array<string>,spans:array<struct<start:bigint,stop:bigint>>>"


class _Powers:
    """Powers of the hash base and of its inverse, grown on demand."""

    def __init__(self) -> None:
        self.up = self.down = np.ones(1, dtype=np.uint64)

    def upto(self, n: int) -> tuple[np.ndarray, np.ndarray]:
        if n > len(self.up):
            size = 1 << (n - 1).bit_length()
            steps = np.full(size, _BASE, dtype=np.uint64), np.full(size, _INVERSE, dtype=np.uint64)
            for one in steps:
                one[0] = 1
            self.up, self.down = (np.multiply.accumulate(one) for one in steps)
        return self.up, self.down


_POWERS = _Powers()


def _words(low: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """First byte, end byte, document and 64-bit hash of every word."""
    inside = _WORD[low]
    opens, closes = inside.copy(), inside.copy()
    opens[1:] &= ~inside[:-1]
    closes[:-1] &= ~inside[1:]
    edges = offsets[1:-1]
    edges = edges[(edges > 0) & (edges < len(low))]
    opens[edges] = inside[edges]
    closes[edges - 1] = inside[edges - 1]
    first, stop = np.flatnonzero(opens), np.flatnonzero(closes) + 1
    up, down = _POWERS.upto(len(low) + 1)
    total = np.zeros(len(low) + 1, dtype=np.uint64)
    np.cumsum((low.astype(np.uint64) + np.uint64(1)) * up[: len(low)], out=total[1:])
    hashes = (total[stop] - total[first]) * down[first]
    hashes ^= hashes >> np.uint64(29)
    hashes *= _STEP
    return first, stop, np.searchsorted(offsets, first, side="right") - 1, hashes


def _windows(hashes: np.ndarray, size: int) -> np.ndarray:
    out, factor = hashes[: len(hashes) - size + 1].copy(), 1
    for j in range(1, size):
        factor = factor * int(_STEP) % (1 << 64)
        out += hashes[j : len(hashes) - size + 1 + j] * np.uint64(factor)
    out ^= out >> np.uint64(31)
    return out * _BASE


def _slices(low: np.ndarray) -> Iterator[tuple[int, int]]:
    """Cuts of one text at about ``_SLICE`` bytes each, never inside a word."""
    start = 0
    while start < len(low):
        stop = min(len(low), start + _SLICE)
        while stop < len(low) and _WORD[low[stop]]:
            gap = np.flatnonzero(~_WORD[low[stop : stop + 4096]])
            stop = min(len(low), stop + (int(gap[0]) if len(gap) else 4096))
        yield start, stop
        start = stop


def _merged(runs: list[tuple[int, int, int, int]]) -> list[tuple[int, int, int, int]]:
    """Runs (first word, end word, start, end) with those that meet joined."""
    out: list[tuple[int, int, int, int]] = []
    for run in sorted(runs):
        if out and run[0] <= out[-1][1]:
            if run[1] > out[-1][1]:
                out[-1] = (out[-1][0], run[1], out[-1][2], run[3])
        else:
            out.append(run)
    return out


class _Windows:
    """Distinct windows of one size, sorted by hash: where their words stand, and whose they are."""

    def __init__(self, hashes: np.ndarray, at: np.ndarray, stop: np.ndarray, items: np.ndarray, words: bytes) -> None:
        order = np.argsort(hashes, kind="stable")
        hashes, at, stop, items = hashes[order], at[order], stop[order], items[order]
        head = np.flatnonzero(np.concatenate(([True], hashes[1:] != hashes[:-1])))
        count = np.diff(np.append(head, len(hashes)))
        lone = head[count == 1]
        rows_at, rows_hash, owners, owned = [at[lone]], [hashes[lone]], [items[lone]], [np.ones(len(lone), np.int64)]
        for first, n in zip(head[count > 1].tolist(), count[count > 1].tolist(), strict=True):
            same: dict[bytes, tuple[int, set[int]]] = {}
            for j in range(first, first + n):
                same.setdefault(words[at[j] : stop[j]], (int(at[j]), set()))[1].add(int(items[j]))
            for where, own in same.values():
                rows_at.append(np.array([where], at.dtype))
                rows_hash.append(hashes[first : first + 1])
                owners.append(np.array(sorted(own), items.dtype))
                owned.append(np.array([len(own)]))
        self.hashes, self.at, owned = np.concatenate(rows_hash), np.concatenate(rows_at), np.concatenate(owned)
        self.owners, begin = np.concatenate(owners), np.concatenate(([0], np.cumsum(owned)))
        order = np.argsort(self.hashes, kind="stable")
        self.hashes, self.at = self.hashes[order], self.at[order]
        self.first_owner, self.end_owner = begin[:-1][order].astype(np.uint32), begin[1:][order].astype(np.uint32)
        self.bits = np.uint64(64 - min(25, max(20, len(self.hashes).bit_length() + 3)))
        self.mask = np.zeros(1 << (64 - int(self.bits)), dtype=bool)
        self.mask[self.hashes >> self.bits] = True


class NgramIndex:
    """Windows of some benchmark items, by size and hash, with the words to verify them.

    Flat arrays: about 35 bytes a window besides the items' words, one blank between two words
    and a line feed after an item's last one.
    """

    def __init__(self, items: list[tuple[object, str | None]], window: int) -> None:
        self.ids: list[str | None] = []
        found: dict[int, list[tuple[np.ndarray, ...]]] = {}
        words, length = [], 0
        for item_id, text in items:
            low = np.frombuffer((text or "").encode().translate(LOWER_BYTES), dtype=np.uint8)
            first, stop, _, hashes = _words(low, np.array([0, len(low)])) if len(low) else _NOTHING
            size = min(window, len(first))
            if not size:
                continue
            raw = low.tobytes()
            words.append(b" ".join(raw[a:b] for a, b in zip(first.tolist(), stop.tolist(), strict=True)) + b"\n")
            ends = length + np.cumsum(stop - first + 1) - 1
            n = len(first) - size + 1
            found.setdefault(size, []).append((_windows(hashes, size), (ends - (stop - first))[:n].astype(np.uint32), ends[size - 1 :].astype(np.uint32), np.full(n, len(self.ids), np.uint32)))
            self.ids.append(None if item_id is None else str(item_id))
            length += len(words[-1])
        self.words = b"".join(words)
        self.by_size = {size: _Windows(*(np.concatenate(column) for column in zip(*rows, strict=True)), self.words) for size, rows in found.items()}
        self.longest = max(self.by_size, default=1)

    def scan(self, column: pa.Array, before: pa.Array | None = None) -> pa.Array:
        """Hits of this index, together with those that an earlier one found."""
        rows, known = [], [None] * len(column) if before is None else before.to_pylist()
        for start, end, data, offsets in blocks(column):
            count = end - start
            n_words, runs, items = [0] * count, {}, {}
            if len(data) > _SLICE and count == 1:
                self._scan_long(LOWER[data], n_words, runs, items)
            elif len(data):
                low = LOWER[data]
                first, _, doc, hits = self._hits(low, offsets)
                n_words, begin = np.bincount(doc, minlength=count).tolist(), np.searchsorted(doc, np.arange(count))
                for i, size, start_byte, stop_byte, names in hits:
                    d = int(doc[i])
                    runs.setdefault(d, []).append((int(i - begin[d]), int(i - begin[d]) + size, start_byte - int(offsets[d]), stop_byte - int(offsets[d])))
                    items.setdefault(d, set()).update(names)
            for d, had in enumerate(known[start:end]):
                rows.append(_result(n_words[d], runs.get(d, ()), items.get(d, set()), data[offsets[d] : offsets[d + 1]], had))
        return pa.array(rows, type=_ARROW_TYPE)

    def _scan_long(self, low: np.ndarray, n_words: list[int], runs: dict, items: dict) -> None:
        """One long text in slices, each of which takes up the last words of the one before."""
        base = since = 0
        for _, stop in _slices(low):
            first, _, _, hits = self._hits(low[since:stop], np.array([0, stop - since]))
            for i, size, start_byte, stop_byte, names in hits:
                runs.setdefault(0, []).append((base + i, base + i + size, since + start_byte, since + stop_byte))
                items.setdefault(0, set()).update(names)
            if len(runs.get(0, ())) > 1 << 16:
                runs[0] = _merged(runs[0])
            again = min(self.longest - 1, len(first))
            n_words[0] = base + len(first)
            base, since = n_words[0] - again, since + int(first[-again]) if again else stop

    def _hits(self, low: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, list[tuple]]:
        """Words of a block, and (word, size, first byte, end byte, item ids) of every verified window."""
        first, stop, doc, hashes = _words(low, offsets)
        raw, out = None, []
        for size, known in self.by_size.items():
            if len(first) < size:
                continue
            windows = _windows(hashes, size)
            likely = np.flatnonzero(known.mask[windows >> known.bits])
            likely = likely[doc[likely] == doc[likely + size - 1]]
            place = np.searchsorted(known.hashes, windows[likely])
            own = place < len(known.hashes)
            own[own] = known.hashes[place[own]] == windows[likely[own]]
            for i, j in zip(likely[own].tolist(), place[own].tolist(), strict=True):
                raw = raw or low.tobytes()
                words = b" ".join(raw[a:b] for a, b in zip(first[i : i + size].tolist(), stop[i : i + size].tolist(), strict=True))
                h = known.hashes[j]
                while j < len(known.hashes) and known.hashes[j] == h:
                    at = int(known.at[j])
                    if self.words.startswith(words, at) and self.words[at + len(words)] in b" \n":
                        out.append((i, size, int(first[i]), int(stop[i + size - 1]), [self.ids[n] for n in known.owners[known.first_owner[j] : known.end_owner[j]]]))
                        break
                    j += 1
        return first, stop, doc, out


def _result(n_words: int, runs: list[tuple[int, int, int, int]], names: set, data: np.ndarray, had: dict | None) -> dict:
    """One row of the result; byte places become code points in one sweep of the text."""
    found, at, points = [], 0, 0
    for first, stop, start_byte, stop_byte in _merged(runs):
        points += int(np.count_nonzero((data[at:start_byte] & 0xC0) != 0x80))
        end = points + int(np.count_nonzero((data[start_byte:stop_byte] & 0xC0) != 0x80))
        found.append((first, stop, points, end))
        at, points = stop_byte, end
    if had:
        found = _merged(found + [(run["first"], run["stop"], span["start"], span["stop"]) for run, span in zip(had["covered"], had["spans"], strict=True)])
        names = names | set(had["items"])
    return {"n_words": n_words, "covered": [{"first": r[0], "stop": r[1]} for r in found], "items": sorted(names - {None}), "spans": [{"start": r[2], "stop": r[3]} for r in found]}


_PAIR = lambda a, b: pa.list_(pa.struct([(a, pa.int64()), (b, pa.int64())]))
_ARROW_TYPE = pa.struct([("n_words", pa.int64()), ("covered", _PAIR("first", "stop")), ("items", pa.list_(pa.string())), ("spans", _PAIR("start", "stop"))])


def _scanner(index: object, text: str, before: str | None) -> Column:
    if before is None:

        @F.arrow_udf(HIT_TYPE)
        def first(columns: Iterator[pa.Array]) -> Iterator[pa.Array]:
            for column in columns:
                yield index.value.scan(column)

        return first(F.col(text))

    @F.arrow_udf(HIT_TYPE)
    def later(columns: Iterator[tuple[pa.Array, pa.Array]]) -> Iterator[pa.Array]:
        for column, known in columns:
            yield index.value.scan(column, known)

    return later(F.col(text), F.col(before))


def find_contamination(docs: DataFrame, benchmark: DataFrame, *, text: str = "text", item_id: str = "item_id", item_text: str = "text", window: int = 10, into: str = "contamination", block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """``docs`` with a column ``into``: n_words, covered word runs, item ids and text spans (code points).

    The benchmark's size is measured first. Up to ``block_bytes`` it is one broadcast and one
    scan; a larger one is dealt into blocks of that size by a hash of its rows and the documents
    are scanned block by block, with a checkpoint between, so neither the driver nor an
    executor ever holds more than one block. An item is never split.
    """
    spark = docs.sparkSession
    items = benchmark.select(F.col(item_id).cast("string").alias("i"), F.col(item_text).alias("t"))
    size = items.agg(F.coalesce(F.sum(F.octet_length("t") + F.lit(64)), F.lit(0)).alias("n")).first()["n"]
    parts = max(1, -(-size // block_bytes))
    for part in range(parts):
        rows = items.where(F.pmod(F.xxhash64("i", "t"), F.lit(parts)) == part).collect() if parts > 1 else items.collect()
        index = spark.sparkContext.broadcast(NgramIndex([(r["i"], r["t"]) for r in rows], window))
        docs = docs.withColumn(into, _scanner(index, text, None)) if part == 0 else checkpoint(docs).withColumn(into, _scanner(index, text, into))
    return docs


def hit_words(contamination: Column) -> Column:
    return F.aggregate(contamination["covered"], F.lit(0).cast("bigint"), lambda n, run: n + run["stop"] - run["first"])


def decontaminate(docs: DataFrame, benchmark: DataFrame, *, text: str = "text", remove: str = "documents", **options: object) -> DataFrame:
    """Drop contaminated ``documents``, or cut the hit ``spans`` out of their texts (a blank is left)."""
    into = unused_name(docs, "found")
    found = find_contamination(docs, benchmark, text=text, into=into, **options)
    if remove == "documents":
        return found.where(F.size(F.col(into)["items"]) + F.size(F.col(into)["covered"]) == 0).drop(into)
    if remove != "spans":
        raise ValueError(f"remove is 'documents' or 'spans', not {remove!r}")
    spans = F.col(into)["spans"]
    rest = F.aggregate(
        spans,
        F.struct(F.lit("").alias("out"), F.lit(0).cast("bigint").alias("at")),
        lambda s, x: F.struct(F.concat(s["out"], F.substr(F.col(text), (s["at"] + 1).cast("int"), (x["start"] - s["at"]).cast("int")), F.lit(" ")).alias("out"), x["stop"].alias("at")),
        lambda s: F.concat(s["out"], F.substr(F.col(text), (s["at"] + 1).cast("int"))),
    )
    return found.withColumn(text, F.when(F.size(spans) > 0, rest).otherwise(F.col(text))).drop(into)


def contamination_report(docs: DataFrame, benchmark: DataFrame, *, doc_id: str = "doc_id", **options: object) -> DataFrame:
    """One row per document: how many words, which are hit, by which items."""
    found = find_contamination(docs, benchmark, into="__found", **options)
    c = F.col("__found")
    return found.select(
        F.col(doc_id).alias("doc_id"),
        c["n_words"].alias("n_words"),
        hit_words(c).alias("n_hit"),
        F.size(c["items"]).cast("bigint").alias("n_items"),
        F.sha2(F.array_join(c["items"], ","), 256).alias("items_sha256"),
        (F.size(c["covered"]) > 0).alias("contaminated"),
    )
