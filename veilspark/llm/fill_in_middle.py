"""Fill-in-the-middle: documents cut in prefix, middle and suffix, written in another order by a secondary sort.

Every document is emitted as chunks of code points keyed by document and output position.  One shuffle deals the chunks
by document and sorts them by position, so that a task streams each output chunk by chunk into a running digest and
never joins a text again.  Restoring reads the marks back from that stream, gives every chunk its place in the original
and sorts a second time inside the same partitions."""

from __future__ import annotations

import hashlib
import re
import zlib
from collections.abc import Iterable, Iterator
from itertools import groupby
from operator import itemgetter

from pyspark import RDD, TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Fixed by the format: what stands before prefix, suffix and middle.
MARKS = {"prefix": "<P>", "suffix": "<S>", "middle": "<M>"}
ORDERS = {"psm": ("prefix", "suffix", "middle"), "spm": ("suffix", "prefix", "middle")}

_MARK = re.compile("|".join(MARKS.values()))
_PLACES = {MARKS["prefix"]: 0, MARKS["middle"]: 1, MARKS["suffix"]: 2}
#: What a mark can begin with at the end of a chunk.
_BEGUN = re.compile("(?:" + "|".join({re.escape(m[:k]) for m in MARKS.values() for k in range(1, len(m))}) + r")\Z")
_HEAD = -1


def cut_points(doc_id: str, text: str, seed: int = 1, plain: int = 10, spm: int = 20) -> tuple[str, int, int]:
    """(form, end of prefix, end of middle) of a document, from the SHA-256 of ``seed:doc_id``.

    ``plain`` and ``spm`` are percentages; empty texts and texts that hold a mark stay plain, so that marks in an output
    are always those put there."""
    digest = hashlib.sha256(f"{seed}:{doc_id}".encode()).hexdigest()
    h1, h2, h3, h4 = (int(digest[i : i + 8], 16) for i in range(0, 32, 8))
    first, second = sorted((h1 % (len(text) + 1), h2 % (len(text) + 1)))
    if not text or h3 % 100 >= 100 - plain or _MARK.search(text):
        return "plain", first, second
    return ("spm" if h4 % 100 < spm else "psm"), first, second


class Sections:
    """Tells the sections of an output that comes in chunks: a mark may be split between two of them."""

    def __init__(self, marked: bool):
        self.place, self.number, self.rest, self.marked = 0, 0, "", marked

    def _piece(self, text: str) -> Iterator[tuple[tuple[int, int], str]]:
        if text:
            yield (self.place, self.number), text
            self.number += 1

    def feed(self, chunk: str) -> Iterator[tuple[tuple[int, int], str]]:
        """(place in the original, text) of what is certain after this chunk."""
        if not self.marked:
            yield from self._piece(chunk)
            return
        text, lo = self.rest + chunk, 0
        for mark in _MARK.finditer(text):
            yield from self._piece(text[lo : mark.start()])
            self.place, lo = _PLACES[mark[0]], mark.end()
        begun = _BEGUN.search(text, lo)
        end = begun.start() if begun else len(text)
        yield from self._piece(text[lo:end])
        self.rest = text[end:]

    def end(self) -> Iterator[tuple[tuple[int, int], str]]:
        yield from self._piece(self.rest)


def restore(output: str, form: str) -> str:
    """The text that an output of this form was made from."""
    sections = Sections(form != "plain")
    return "".join(t for _, t in sorted([*sections.feed(output), *sections.end()]))


def _deal(key: tuple[bytes, object]) -> int:
    return zlib.crc32(key[0])


def output_pieces(documents: DataFrame, id: str = "doc_id", text: str = "text", seed: int = 1, plain: int = 10, spm: int = 20,
                  chunk: int = 32_768, part_chars: int = 16 << 20) -> RDD:
    """((document, output position), chunk) in order of that key; position -1 holds (id, n, form, prefix, middle).

    The texts are measured first, so that a partition sorts about ``part_chars`` code points, however many there are.

    A document is named by a 128-bit hash of its id and text and the partition it was read from.  So rows with equal ids
    or none at all stay apart, and equal rows have equal pieces at every position, of which readers count one; a hot
    group of equal rows is spread over as many keys as partitions hold it."""

    def pieces(rows: Iterable) -> Iterator[tuple[tuple[bytes, int], object]]:
        part = TaskContext.get().partitionId().to_bytes(4, "big")
        for own, content in rows:
            content, name = content or "", "" if own is None else str(own)
            form, first, second = cut_points(name, content, seed, plain, spm)
            hashed = hashlib.blake2b(f"{own is None:d}{name}:{content}".encode(), digest_size=16)
            row = hashed.digest() + part
            told = form != "plain"
            yield (row, _HEAD), (own, len(content), form, first if told else None, second - first if told else None)
            spans = {"prefix": (0, first), "middle": (first, second), "suffix": (second, len(content))}
            at = 0
            for lo, hi, mark in [(*spans[s], MARKS[s]) for s in ORDERS[form]] if told else [(0, len(content), "")]:
                if mark:
                    yield (row, at), mark
                    at += 1
                for start in range(lo, hi, chunk):
                    yield (row, at), content[start : min(start + chunk, hi)]
                    at += 1

    total = documents.agg(F.sum(F.char_length(F.col(text).cast("string")))).first()[0] or 0
    parts = max(documents.sparkSession.sparkContext.defaultParallelism, -(-total // part_chars))
    rows = documents.select(F.col(id), F.col(text).cast("string")).rdd
    return rows.mapPartitions(pieces).repartitionAndSortWithinPartitions(parts, _deal)


def _written(with_text: bool):
    """Outputs streamed into digests; their chunks go on keyed by their place in the original."""

    def run(items: Iterable) -> Iterator[tuple[tuple[bytes, tuple[int, int]], object]]:
        for row, group in groupby(items, key=lambda kv: kv[0][0]):
            copies, last, digest, kept = 0, _HEAD, hashlib.sha256(), []
            for (_, at), value in group:
                if at == _HEAD:
                    head, copies = value, copies + 1
                    sections = Sections(head[2] != "plain")
                elif at != last:
                    last = at
                    digest.update(value.encode())
                    if with_text:
                        kept.append(value)
                    for place, found in sections.feed(value):
                        yield (row, place), found
            for place, found in sections.end():
                yield (row, place), found
            yield (row, (_HEAD, 0)), (copies, *head, digest.hexdigest(), "".join(kept))

    return run


def _read(with_text: bool):
    """Restored texts streamed into digests; one result row for every copy."""

    def run(items: Iterable) -> Iterator[tuple]:
        for _, group in groupby(items, key=lambda kv: kv[0][0]):
            (_, (copies, *head, output)), digest, kept = next(group), hashlib.sha256(), []
            for value in map(itemgetter(1), group):
                digest.update(value.encode())
                if with_text:
                    kept.append(value)
            done = (*head, digest.hexdigest(), *((output, "".join(kept)) if with_text else ()))
            for _ in range(copies):
                yield done

    return run


def fill_in_middle(documents: DataFrame, id: str = "doc_id", text: str = "text", seed: int = 1, plain: int = 10, spm: int = 20,
                   chunk: int = 32_768, with_text: bool = False) -> DataFrame:
    """id, n, form, prefix_chars, middle_chars, output_sha256, restored_sha256 and, with ``with_text``, output and restored.

    One row per input row.  The digests are taken from streamed chunks, so no task holds a whole output; ``with_text``
    joins one at a time.  The second sort keeps the first one's partitioner and needs no shuffle.  Both sorts spill.

    A null text is empty, an empty text is plain with the digest of nothing; a null id is hashed as an empty one; equal
    rows give equal results, once each; an empty table gives none.  Other columns are not read, whatever their names."""
    assembled = output_pieces(documents, id, text, seed, plain, spm, chunk)
    placed = assembled.mapPartitions(_written(with_text), preservesPartitioning=True)
    found = placed.repartitionAndSortWithinPartitions(assembled.getNumPartitions(), _deal).mapPartitions(_read(with_text))
    fields = [T.StructField(id, documents.schema[id].dataType)]
    fields += T.StructType.fromDDL("n bigint, form string, prefix_chars bigint, middle_chars bigint, output_sha256 string, restored_sha256 string").fields
    fields += T.StructType.fromDDL("output string, restored string").fields if with_text else []
    return documents.sparkSession.createDataFrame(found, T.StructType(fields), verifySchema=False)
