r"""Token counts of whole texts by a public byte-level BPE tokenizer, huge texts chunk by chunk.

Short texts are encoded as they are, in batches. A huge one is encoded in overlapping chunks
with offsets; neighbours are spliced at a boundary that both have and that is proven to be a
boundary of the whole text's encoding, and each chunk's tokens count from splice to splice. So
a task holds one chunk's encoding, not one of the whole text, and the count is the library's.

**Why a splice is exact.** The tokenizer first takes out added tokens, then cuts what is between
them into pretokens, always from left to right; no token crosses a pretoken, and a pretoken's
tokens depend on it alone. The cutting looks ahead, never back, and at most to the first
character after a run of blanks, to the end of a contraction or of an added token. So if the
first character from p on that is no blank stands ``look_ahead`` characters or more before the
end of a chunk, nothing cut before p could have seen that end (*stable*). Let chunk A be right
from its own splice on, and p a pretoken boundary of A and of its successor B that is stable in
A. Then p is a boundary of the whole text, and as B goes on from p as the whole text does, B is
right from p on. The first chunk begins with the text, so all are right.

Where the overlap has no such p (a run of letters or blanks longer than it), the overlap is
doubled, chunk A is encoded again up to the new end, and so on to the end of the text; memory
follows the longest run without a stable boundary. A tokenizer whose file does not allow that
proof (a normalizer, other pretokenizers, added tokens that reach beyond themselves) encodes
every text whole.

Defined cases: a null or empty text has no bytes and no tokens; strings of added tokens inside
a text are that token, as the library's default is; repeated rows are alike; an empty table
gives no rows; other columns are kept, and one named like ``into`` is replaced.
"""

from __future__ import annotations

import hashlib
import json
import os
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from linkweave.llm.arrow_text import blocks

#: Code points of a chunk, and of the overlap that is tried first.
CHUNK, OVERLAP = 1 << 17, 1 << 10
LIMIT = 1024
#: Characters that a contraction takes, the farthest that the pretokenizer's pattern looks at one.
CONTRACTION = 3


@dataclass(frozen=True)
class Model:
    """A tokenizer file's text, read on the driver: its size is that of the vocabulary."""

    text: str
    digest: str
    look_ahead: int | None

    @classmethod
    def read(cls, path: str) -> Model:
        with open(path, encoding="utf-8") as file:
            text = file.read()
        return cls(text, hashlib.sha256(text.encode()).hexdigest(), look_ahead(json.loads(text)))


def look_ahead(config: dict) -> int | None:
    """How far before a chunk's end its cutting may depend on that end, or None where nothing is proven."""
    pre, model = config.get("pre_tokenizer") or {}, config.get("model") or {}
    added = config.get("added_tokens") or []
    plain = pre.get("type") == "ByteLevel" and pre.get("use_regex", True) and not pre.get("add_prefix_space")
    alone = not any(t.get(k) for t in added for k in ("lstrip", "rstrip", "single_word", "normalized"))
    if not (plain and alone and config.get("normalizer") is None and model.get("type") == "BPE" and not model.get("dropout")):
        return None
    return max([CONTRACTION, *(len(t["content"]) for t in added)])


class Counter:
    """Counts with one tokenizer, in one Python worker."""

    def __init__(self, model: Model, chunk: int = CHUNK, overlap: int = OVERLAP) -> None:
        # one task is one core; the library's own threads would take others'
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_str(model.text)
        self.tokenizer.no_truncation()
        self.tokenizer.no_padding()
        self.look_ahead, self.chunk, self.overlap = model.look_ahead, chunk, overlap

    def batch(self, texts: list[str]) -> list[int]:
        short = [len(t) <= self.chunk + self.overlap or self.look_ahead is None for t in texts]
        counts = iter([len(e) for e in self.tokenizer.encode_batch_fast([t for t, s in zip(texts, short, strict=True) if s], add_special_tokens=False)])
        return [next(counts) if s else self.long(t) for t, s in zip(texts, short, strict=True)]

    def boundaries(self, text: str, begin: int, end: int) -> tuple[np.ndarray, np.ndarray, int]:
        """(pretoken starts in the text's code points, tokens before each, tokens) of one chunk."""
        encoded = self.tokenizer.encode(text[begin:end], add_special_tokens=False)
        words = np.array(encoded.word_ids, dtype=np.int64)
        first = np.flatnonzero(np.diff(words, prepend=-1))
        offsets = encoded.offsets
        return np.array([offsets[i][0] for i in first.tolist()], dtype=np.int64) + begin, first, len(words)

    def last_stable(self, text: str, begin: int, end: int) -> int:
        """The greatest p whose first character that is no blank is ``look_ahead`` or more before ``end``; -1 if none.

        Blanks of Python's ``isspace`` include all of the pattern's.
        """
        at = end - self.look_ahead
        while at >= begin and text[at].isspace():
            at -= 1
        return at if at >= begin else -1

    def long(self, text: str) -> int:
        size, tokens, splice = len(text), 0, 0
        begin, end, overlap = 0, self.chunk + self.overlap, self.overlap
        here = self.boundaries(text, begin, end)
        while end < size:
            ahead = max(begin, end - overlap)
            reach = min(size, ahead + self.chunk + overlap)
            there = self.boundaries(text, ahead, reach)
            stable = self.last_stable(text, ahead, end)
            common = np.intersect1d(here[0][(here[0] > splice) & (here[0] <= stable)], there[0][there[0] > ahead], assume_unique=True)
            if len(common):
                p = int(common[-1])
                tokens += self.between(here, splice, p)
                splice, begin, end, here, overlap = p, ahead, reach, there, self.overlap
            else:
                # the splice is proven, so the wider chunk may begin there
                overlap = 2 * overlap
                begin, end = splice, min(size, end + overlap)
                here = self.boundaries(text, begin, end)
        return tokens + self.between(here, splice, None)

    @staticmethod
    def between(chunk: tuple[np.ndarray, np.ndarray, int], start: int, stop: int | None) -> int:
        starts, before, total = chunk
        upto = total if stop is None else int(before[np.searchsorted(starts, stop)])
        return upto - int(before[np.searchsorted(starts, start)])


_COUNTERS: dict[str, Counter] = {}


def _counter(model: Model) -> Counter:
    if model.digest not in _COUNTERS:
        _COUNTERS.clear()
        _COUNTERS[model.digest] = Counter(model)
    return _COUNTERS[model.digest]


def count_tokens(docs: DataFrame, tokenizer_file: str, *, text: str = "text", into: str = "tokens") -> DataFrame:
    """``docs`` with the number of tokens of each text; the file is read on the driver alone."""
    shared = docs.sparkSession.sparkContext.broadcast(Model.read(tokenizer_file))

    @F.arrow_udf("bigint")
    def run(columns: Iterator[pa.Array]) -> Iterator[pa.Array]:
        counter = _counter(shared.value)
        for column in columns:
            counts: list[int] = []
            for _, _, data, offsets in blocks(column):
                view = memoryview(data)
                ends = offsets.tolist()
                counts += counter.batch([str(view[a:b], "utf-8") for a, b in zip(ends, ends[1:], strict=False)])
            yield pa.array(counts, pa.int64())

    return docs.withColumn(into, run(F.col(text)))


def token_report(docs: DataFrame, tokenizer_file: str, *, doc_id: str = "doc_id", text: str = "text", limit: int = LIMIT) -> DataFrame:
    """Per document: bytes, tokens, and whether the tokens exceed ``limit``."""
    rows = docs.select(F.col(doc_id).alias("doc_id"), F.col(text).alias("text"))
    counted = count_tokens(rows, tokenizer_file, into="n_tokens")
    return counted.select("doc_id", F.coalesce(F.octet_length("text"), F.lit(0)).cast("bigint").alias("n_bytes"), "n_tokens", (F.col("n_tokens") > limit).alias("over_limit"))
