"""SentencePiece BPE encoding and decoding with a prefix table.

BPE over a merge list has one encoding for every prefix of a word, and that encoding is the
encoding of a shorter prefix plus one last token. So the encoder keeps, for each prefix, only
its last token: an Aho-Corasick automaton lists the pieces that end at a character, and the
right one is the piece that is *compatible* with the last token of the prefix before it, which
holds when the two, merged from characters, stay those two. Token ids are then recovered from
the end backwards. Compatibility tests are memoised per pair of tokens.

No piece holds a blank mark after another character, nor a line feed, so a text is cut before
each run of blank marks and around line feeds, and the parts are encoded on their own and
remembered in a bounded two-generation memo. Both facts are checked on loading; a vocabulary
without them is encoded in larger parts.

Defined cases: null and empty texts give no ids; characters without a piece become their UTF-8
bytes; repeated rows are encoded alike; texts of any length take memory in proportion to
their longest run without blanks.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from itertools import chain

import ahocorasick
import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from linkweave.llm.arrow_text import give_back

MARK = "\u2581"
#: Parts and pair tests that one Python worker remembers at most, and the longest part kept.
MEMO, PAIRS, LONGEST = 120_000, 500_000, 64
_UNKNOWN = 1 << 20
#: Rows of an Arrow batch that are Python objects at a time.
SLICE = 512


class Vocabulary:
    """Pieces, scores and kinds of a model: what the encoder needs, ready to be broadcast."""

    def __init__(self, model_file: str) -> None:
        import sentencepiece

        model = sentencepiece.SentencePieceProcessor(model_file=model_file)
        n = model.get_piece_size()
        self.pieces = [model.id_to_piece(i) for i in range(n)]
        self.scores = [model.get_score(i) for i in range(n)]
        self.bytes = {int(self.pieces[i][3:5], 16): i for i in range(n) if model.is_byte(i)}
        self.control = {i for i in range(n) if model.is_control(i)}
        self.unknown = model.unk_id()
        special = self.control | set(self.bytes.values()) | {self.unknown}
        self.normal = [i for i in range(n) if i not in special]
        #: Names the vocabulary, so that a worker never takes one for another.
        self.digest = hashlib.sha256(repr((self.pieces, self.scores, sorted(special))).encode()).hexdigest()


class Codec:
    def __init__(self, vocabulary: Vocabulary) -> None:
        self.v = vocabulary
        self.ids = {vocabulary.pieces[i]: i for i in vocabulary.normal}
        self.lengths = {i: len(vocabulary.pieces[i]) for i in vocabulary.normal}
        self.automaton = ahocorasick.Automaton()
        for piece, i in self.ids.items():
            self.automaton.add_word(piece, (i, len(piece)))
        self.automaton.make_automaton()
        self.forget()
        self.byte_ids = set(vocabulary.bytes.values())
        self.digits = [str(i) for i in range(len(vocabulary.pieces))]
        # what an id stands for wherever it is; the ids that are left out depend on their neighbours or vanish
        self.plain = [p.replace(MARK, " ") for p in vocabulary.pieces]
        for byte, i in vocabulary.bytes.items():
            self.plain[i] = chr(byte)
        self.by_context = {i for byte, i in vocabulary.bytes.items() if byte > 127} | vocabulary.control | {vocabulary.unknown}
        self.within = {p[k : k + 2] for p in self.ids for k in range(len(p) - 1)}
        self.cuts_blanks = not any(MARK in p.lstrip(MARK) for p in self.ids)
        self.cuts_lines = not any("\n" in p for p in self.ids)
        self.newline = self._entry("\n") if self.cuts_lines else None

    def forget(self) -> None:
        """Empty the memo, so that a worker which goes on to other work doesn't hold it."""
        self.pairs: dict[int, bool] = {}
        self.marked: list[dict] = [{}, {}]
        self.bare: list[dict] = [{}, {}]

    def merged(self, text: str) -> list[str]:
        """Merge characters, the best score first and from the left: what the table must reproduce."""
        parts, ids, scores = list(text), self.ids, self.v.scores
        while True:
            best = None
            for k in range(len(parts) - 1):
                i = ids.get(parts[k] + parts[k + 1])
                if i is not None and (best is None or scores[i] > best[0]):
                    best = scores[i], k
            if best is None:
                return parts
            k = best[1]
            parts[k : k + 2] = [parts[k] + parts[k + 1]]

    def _string(self, token: int) -> str:
        return chr(token - _UNKNOWN) if token >= _UNKNOWN else self.v.pieces[token]

    def compatible(self, a: int, b: int) -> bool:
        key = a << 21 | b
        known = self.pairs.get(key)
        if known is None:
            if len(self.pairs) >= PAIRS:
                self.pairs.clear()
            left, right = self._string(a), self._string(b)
            known = self.pairs[key] = self.merged(left + right) == [left, right]
        return known

    def encode_part(self, part: str) -> list[int]:
        last, pairs = [0] * (len(part) + 1), self.pairs
        done = 0  # prefixes up to here have their last token
        for at, (token, size) in self.automaton.iter(part):
            end = at + 1
            if end <= done:
                continue
            while done + 1 < end:  # a character that ends no piece
                done += 1
                last[done] = _UNKNOWN + ord(part[done - 1])
            start = end - size
            if start:
                before = last[start]
                known = pairs.get(before << 21 | token)
                if not (self.compatible(before, token) if known is None else known):
                    continue
            last[end] = token
            done = end
        while done < len(part):
            done += 1
            last[done] = _UNKNOWN + ord(part[done - 1])
        out, at = [], len(part)
        while at:
            token = last[at]
            if token >= _UNKNOWN:
                out += [self.v.bytes.get(byte, self.v.unknown) for byte in reversed(chr(token - _UNKNOWN).encode())]
                at -= 1
            else:
                out.append(token)
                at -= self.lengths[token]
        return out[::-1]

    def _entry(self, part: str) -> tuple[int, ...]:
        return tuple(self.encode_part(part))

    def _miss(self, memo: list[dict], key: str, part: str) -> tuple[int, ...]:
        entry = memo[1].get(key)
        if entry is None:
            entry = self._without_tail(memo, key, part) or self._entry(part)
        if len(key) <= LONGEST:
            if len(memo[0]) >= MEMO:
                memo[1] = memo[0]
                memo[0] = {}
            memo[0][key] = entry
        return entry

    def _without_tail(self, memo: list[dict], key: str, part: str) -> tuple[int, ...] | None:
        """A part that ends in punctuation, from the entries of both halves where no piece spans the cut."""
        if not key or key[-1].isalnum():
            return None
        at = len(key) - 1
        while at and not key[at - 1].isalnum():
            at -= 1
        if not at or key[at - 1 : at + 1] in self.within:
            return None
        head = memo[0].get(key[:at]) or self._miss(memo, key[:at], part[: at - len(key)])
        tail = self.bare[0].get(key[at:]) or self._miss(self.bare, key[at:], key[at:])
        return head + tail

    def parts(self, text: str) -> list[tuple[int, ...]]:
        """The ids of the parts of ``text``, one part after the other."""
        if not text:
            return []
        if not self.cuts_blanks:
            return [self._entry(MARK + text.replace(" ", MARK))]
        out: list = []
        miss, marked, bare = self._miss, self.marked, self.bare
        for number, line in enumerate(text.split("\n") if self.cuts_lines else [text]):
            if number:
                out.append(self.newline)
            if MARK in line or "  " in line or line[:1] == " " or line[-1:] == " ":
                line = ("" if number else MARK) + line.replace(" ", MARK)
                at = 0
                while at < len(line):
                    end = at
                    while end < len(line) and line[end] == MARK:
                        end += 1
                    end = line.find(MARK, end)
                    end = len(line) if end < 0 else end
                    part = line[at:end]
                    out.append(marked[0].get(part[1:]) or miss(marked, part[1:], part) if part[0] == MARK else bare[0].get(part) or miss(bare, part, part))
                    at = end
                continue
            words = line.split(" ")
            if number:
                if words[0]:
                    out.append(bare[0].get(words[0]) or miss(bare, words[0], words[0]))
                words = words[1:]
            elif words == [""]:  # the text begins with a line feed: the added blank stands alone
                out.append(miss(marked, "", MARK))
                continue
            known = marked[0]
            for word in words:
                entry = known.get(word)
                if entry is None:
                    entry = miss(marked, word, MARK + word)
                    known = marked[0]
                out.append(entry)
        return out

    def encode(self, text: str | None) -> list[int]:
        return list(chain.from_iterable(self.parts(text or "")))

    def decode(self, ids: list[int]) -> str:
        """Pieces joined, bytes put together, blank marks as blanks, less the blank that encoding adds.

        Bytes that are no UTF-8 become U+FFFD one by one; control ids vanish; the unknown id
        is the library's mark.
        """
        if ids and self.by_context.isdisjoint(ids):
            text = "".join([self.plain[i] for i in ids])
            return text[1:] if self.v.pieces[ids[0]].startswith(MARK) else text
        out, held, begun = [], bytearray(), False
        for i in [*ids, -1]:
            if i in self.byte_ids:
                held.append(int(self.v.pieces[i][3:5], 16))
                begun = True
                continue
            if held:
                out.append(_bytes_to_text(bytes(held)))
                held.clear()
            if i < 0 or i in self.v.control:
                continue
            piece = " \u2047 " if i == self.v.unknown else self.v.pieces[i]
            if not begun and i != self.v.unknown and piece.startswith(MARK):
                piece = piece[1:]
            begun = True
            out.append(piece.replace(MARK, " "))
        return "".join(out)


def _bytes_to_text(raw: bytes) -> str:
    out, at = [], 0
    while at < len(raw):
        for size in (1, 2, 3, 4):
            try:
                out.append(raw[at : at + size].decode())
                at += size
                break
            except UnicodeDecodeError:
                continue
        else:
            out.append("\ufffd")
            at += 1
    return "".join(out)


_CODECS: dict[str, Codec] = {}


def _codec(shared: object) -> Codec:
    """One codec per Python worker and vocabulary; its memo serves every batch of a task."""
    key = shared.value.digest
    if key not in _CODECS:
        _CODECS.clear()
        _CODECS[key] = Codec(shared.value)
    return _CODECS[key]


def broadcast_vocabulary(spark: SparkSession, model_file: str) -> object:
    """The vocabulary, read on the driver; its size is that of the model file, fixed by the vocabulary."""
    return spark.sparkContext.broadcast(Vocabulary(model_file))


def encode(docs: DataFrame, model_file: str, *, text: str = "text", into: str = "encoded", with_ids: bool = True) -> DataFrame:
    """``docs`` with ``into``: n_tokens, ids (if asked for), and SHA-256 of the ids and of their decoding."""
    shared = broadcast_vocabulary(docs.sparkSession, model_file)
    fields = [("n_tokens", pa.int64()), ("ids_sha256", pa.string()), ("decoded_sha256", pa.string())] + [("ids", pa.list_(pa.int32()))] * with_ids
    kind = "struct<n_tokens:bigint,ids_sha256:string,decoded_sha256:string" + ",ids:array<int>" * with_ids + ">"

    @F.arrow_udf(kind)
    def run(columns: Iterator[pa.Array]) -> Iterator[pa.Array]:
        codec = _codec(shared)
        for column in columns:
            yield pa.concat_arrays([some(codec, column[at : at + SLICE]) for at in range(0, max(1, len(column)), SLICE)])
        codec.forget()
        give_back()

    def some(codec: Codec, column: pa.Array) -> pa.Array:
        counts, first, second, flat, sha = [], [], [], [np.zeros(0, np.int32)], hashlib.sha256
        for value in column:
            ids = codec.encode(value.as_py())
            counts.append(len(ids))
            first.append(sha(",".join(map(codec.digits.__getitem__, ids)).encode()).hexdigest())
            second.append(sha(codec.decode(ids).encode()).hexdigest())
            if with_ids:
                flat.append(np.array(ids, dtype=np.int32))
        arrays = [pa.array(counts, pa.int64()), pa.array(first, pa.string()), pa.array(second, pa.string())]
        if with_ids:
            arrays.append(pa.ListArray.from_arrays(pa.array(np.cumsum([0, *counts]), pa.int32()), pa.array(np.concatenate(flat))))
        return pa.StructArray.from_arrays(arrays, fields=[pa.field(n, t) for n, t in fields])

    return docs.withColumn(into, run(F.col(text)))


def decode(rows: DataFrame, model_file: str, *, ids: str = "ids", into: str = "decoded") -> DataFrame:
    """``rows`` with the text of a column of ids; null ids give null."""
    shared = broadcast_vocabulary(rows.sparkSession, model_file)

    @F.arrow_udf("string")
    def run(columns: Iterator[pa.Array]) -> Iterator[pa.Array]:
        codec = _codec(shared)
        for column in columns:
            yield pa.array([None if v is None else codec.decode([i for i in v if i is not None]) for v in column.to_pylist()], pa.string())

    return rows.withColumn(into, run(F.col(ids)))


def encoding_digests(docs: DataFrame, model_file: str, *, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    e = F.col("__encoded")
    return encode(docs, model_file, text=text, into="__encoded", with_ids=False).select(F.col(doc_id).alias("doc_id"), e["n_tokens"].alias("n_tokens"), e["ids_sha256"].alias("ids_sha256"), e["decoded_sha256"].alias("decoded_sha256"))
