"""Packing: concatenate all token lists and cut; two-pass prefix sums over partition totals give the global offsets."""

from __future__ import annotations

import struct
import zlib
from collections.abc import Callable, Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from veilspark.llm.shared import map_batches, saved

PIECES = "doc_id bigint, start bigint, length bigint, ids_crc32 bigint, doc_tokens bigint, sequence_id bigint, offset bigint"


def _byte_signs() -> dict[int, int]:
    """Characters of a byte-level model: printable Latin-1 bytes stand for themselves, the others follow from 256 on."""
    hidden = [b for b in range(256) if not (33 <= b <= 126 or 161 <= b <= 172 or b >= 174)]
    return {b: 256 + i for i, b in enumerate(hidden)}


_BYTE_SIGNS = _byte_signs()


@lru_cache(maxsize=1)
def _tokenizer(file: str):
    """Read once for all tasks of a worker."""
    from tokenizers import Tokenizer

    return Tokenizer.from_file(file)


class _Made(dict):
    """Values are made when they are first asked for."""

    def __init__(self, make: Callable[[str], bytes]):
        super().__init__()
        self.make = make

    def __missing__(self, key: str) -> bytes:
        found = self[key] = self.make(key)
        return found


def _is_latin(text: str) -> bool:
    """Only characters below U+0100: no two of them compose, and each has its lower case by itself."""
    if text.isascii():
        return True
    try:
        text.encode("latin-1")
    except UnicodeEncodeError:
        return False
    return True


class WordIds:
    """Token ids of whole texts as little-endian unsigned 32-bit bytes, for a tokenizer of this kind: lower case, white space
    dropped, and a merge model over runs of letters, single digits and runs of other signs, with marked word ends.

    Nothing is joined across white space, so a text's ids are those of its blank- and newline-separated words one after
    another, and a plain word's ids are those of its runs.  Words with apostrophes (contractions are runs of their own),
    special tokens, unprintable or further letters are left to the tokenizer as they are.  What is remembered has a bound."""

    def __init__(self, file: str, most: int = 500_000):
        import regex

        self.tokenizer, self.most = _tokenizer(file), most
        self.tokenize = self.tokenizer.model.tokenize
        self.known, self.parts = _Made(self._word), _Made(self._run)
        self.runs = regex.compile(r"\p{L}+|\p{N}|[^\p{L}\p{N}]+").findall
        self.packed = [struct.pack("<I", i) for i in range(self.tokenizer.get_vocab_size())]

    def _run(self, run: str) -> bytes:
        # The model reads UTF-8 bytes, each as one character.
        shown = run if run.isascii() else run.encode().decode("latin-1").translate(_BYTE_SIGNS)
        packed = self.packed
        return b"".join([packed[t.id] for t in self.tokenize(shown)])

    def _word(self, word: str) -> bytes:
        if _is_latin(word):
            # Most words are letters with at most one other sign behind them: one or two runs.
            lower, parts = word.lower(), self.parts
            if lower.isalpha():
                return parts[lower]
            if lower.isprintable() and "'" not in lower:
                if lower[:-1].isalpha():
                    return parts[lower[:-1]] + parts[lower[-1]]
                if "<|" not in lower:
                    return b"".join([parts[r] for r in self.runs(lower)])
        ids = self.tokenizer.encode(word, add_special_tokens=False).ids
        return struct.pack(f"<{len(ids)}I", *ids)

    def __call__(self, text: str) -> bytes:
        known = self.known
        if len(known) > self.most or len(self.parts) > self.most:
            known.clear()
            self.parts.clear()
        # Fewer words differ in lower case; special tokens are found before case is dropped.
        if "<|" not in text and _is_latin(text):
            text = text.lower()
        return b"".join(map(known.__getitem__, text.replace("\n", " ").split(" ")))


def tokenized(documents: DataFrame, file: str, end: int | None = 1, id: str = "doc_id", text: str = "text") -> DataFrame:
    """doc_id, part, before, n, ids: the token ids of every whole text, then ``end``; ``part`` is the task that made the row,
    ``before`` the number of ids earlier in that part.  Null text is empty."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[dict]:
        import os

        from pyspark import TaskContext

        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        words, part, before = WordIds(file), TaskContext.get().partitionId(), 0
        tail = b"" if end is None else np.asarray([end], "<u4").tobytes()
        for b in batches:
            for lo in range(0, b.num_rows, 256):
                cut = b.slice(lo, 256)
                ids = [words(t or "") + tail for t in cut.column(1).to_pylist()]
                n = np.asarray([len(x) // 4 for x in ids], np.int64)
                starts = before + np.cumsum(n) - n
                before += int(n.sum())
                yield {"doc_id": cut.column(0), "part": np.full(len(n), part), "before": starts, "n": n, "ids": ids}

    return map_batches(
        documents.select(F.col(id).cast("bigint"), F.col(text).cast("string")),
        "doc_id bigint, part bigint, before bigint, n bigint, ids binary", run)


def pack(documents: DataFrame, file: str, size: int = 2048, end: int | None = 1, id: str = "doc_id", text: str = "text", with_ids: bool = False) -> DataFrame:
    """Pieces of documents in sequences of ``size`` ids: doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset
    (and ``ids``, binary, on request).

    Pass one tokenizes each partition and notes running sums inside it; the table is written, so that both passes see the
    same rows in the same parts.  The partition totals, one number a partition, are summed up on the driver.  Pass two
    adds them and cuts at multiples of ``size``; a document over a boundary leaves one record on either side.  No text
    and no id is shuffled, and a document of any length or a hot source costs nothing extra.  All sequences but the last
    are full.  Repeated rows and rows of a null doc_id are packed like others; a null or empty text is its end id alone
    (without ``end``, it has no piece); an empty table has no pieces."""
    table = saved(tokenized(documents, file, end, id, text))
    totals = table.groupBy("part").agg(F.max(F.col("before") + F.col("n"))).orderBy("part").collect()  # one row a partition
    base = {}
    at = 0
    for part, total in totals:
        base[part], at = at, at + total
    sums = documents.sparkSession.sparkContext.broadcast(base)  # two numbers a partition

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[dict]:
        for b in batches:
            for lo in range(0, b.num_rows, 256):
                cut = b.slice(lo, 256).to_pydict()
                out: dict = {k: [] for k in ("doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset", "ids")}
                for doc, part, before, n, ids in zip(*(cut[k] for k in ("doc_id", "part", "before", "n", "ids"))):
                    first, start = sums.value[part] + before, 0
                    while start < n:
                        sequence, offset = divmod(first + start, size)
                        length = min(size - offset, n - start)
                        piece = ids[4 * start : 4 * (start + length)]
                        for k, v in zip(out, (doc, start, length, zlib.crc32(piece), n, sequence, offset, piece)):
                            out[k].append(v)
                        start += length
                yield out

    return map_batches(table, PIECES + (", ids binary" if with_ids else ""), run)
