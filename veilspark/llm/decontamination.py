"""Benchmark decontamination: Wu-Manber search of many word windows at once."""

from __future__ import annotations

import hashlib
from collections.abc import Iterable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from veilspark.llm.shared import add_columns, saved

#: Bytes that end a word become blanks, A-Z become a-z.
_TABLE = bytes(
    c + 32 if 0x41 <= c <= 0x5A else c if c >= 0x80 or 0x30 <= c <= 0x39 or 0x61 <= c <= 0x7A else 0x20 for c in range(256))


def words_of(text: str | None) -> list[bytes]:
    """Maximal runs of digits, letters and non-ASCII characters, A-Z lower-cased, as UTF-8."""
    return (text or "").encode("utf-8", "surrogatepass").translate(_TABLE).split()


def pattern_table(items: Iterable[tuple[str, str]], window: int) -> tuple[dict[bytes, int], list[tuple]]:
    """Windows of benchmark items, searchable together: word numbers, and (m, block, shift, bucket) per window length m.

    The shift table over blocks of two words says how far a window's end is at least away when this block has just been
    read; unknown blocks allow m - 1 words at once.  Where the shift is 0, the block's bucket holds the windows that end
    with it, and the words themselves are compared."""
    numbers: dict[bytes, int] = {}
    found: dict[int, dict[tuple, set]] = {}
    for item, text in items:
        ids = [numbers.setdefault(w, len(numbers) + 1) for w in words_of(text)]
        m = min(window, len(ids))
        for i in range(len(ids) - m + 1 if m else 0):
            found.setdefault(m, {}).setdefault(tuple(ids[i : i + m]), set()).add(item)
    base, tables = len(numbers) + 1, []
    for m, windows in sorted(found.items()):
        block = min(2, m)
        shift: dict[int, int] = {}
        bucket: dict[int, dict[tuple, set]] = {}
        for w, owners in windows.items():
            for end in range(block - 1, m):
                key = w[end] if block == 1 else w[end - 1] * base + w[end]
                shift[key] = min(shift.get(key, m), m - 1 - end)
            bucket.setdefault(w[-1] if block == 1 else w[-2] * base + w[-1], {})[w] = owners
        tables.append((m, block, shift, bucket))
    return numbers, tables


def search(table: tuple[dict[bytes, int], list[tuple]], words: list[bytes], mask: bytearray, items: set) -> None:
    """Mark in ``mask`` the words inside occurrences of windows and add their items."""
    numbers, tables = table
    ids = list(map(numbers.get, words, [0] * len(words)))
    base, n = len(numbers) + 1, len(ids)
    for m, block, shift, bucket in tables:
        at, far, get = m - 1, m - block + 1, shift.get
        while at < n:
            key = ids[at] if block == 1 else ids[at - 1] * base + ids[at]
            step = get(key, far)
            if step:
                at += step
                continue
            owners = bucket[key].get(tuple(ids[at - m + 1 : at + 1]))
            if owners:
                mask[at - m + 1 : at + 1] = b"\x01" * m
                items |= owners
            at += 1


def _blocks(benchmark: DataFrame, most_bytes: int) -> Iterator[list[tuple[int, str]]]:
    """The items in blocks of a bounded size, streamed to the driver one partition at a time."""
    block, size = [], 0
    for item, text in benchmark.toLocalIterator():
        block.append((item, text))
        size += len(text) + 16
        if size >= most_bytes:
            yield block
            block, size = [], 0
    if block:
        yield block


def mark_hits(
    documents: DataFrame, benchmark: DataFrame, window: int = 10, text: str = "text", item: str = "item_id", item_text: str = "text",
    most_bytes: int = 16_000_000,
) -> DataFrame:
    """``documents`` with n_words, n_hit (words inside any occurrence of a window), n_items, items_sha256 and contaminated.

    An item's windows are all runs of ``window`` words; a shorter item that has words is one window.  The benchmark is a
    query set and is cut into blocks of at most ``most_bytes`` characters of text (and one item more); each block is
    broadcast, so its size has a bound, and the documents pass all blocks, with a written table between two of them.
    Rows are neither shuffled nor dropped.  Null or empty texts have no words; items that are null, or have a null id,
    match nothing; an empty benchmark leaves all documents clean; input columns named like a result are replaced."""
    results = "n_words bigint, n_hit bigint, n_items bigint, items_sha256 string, contaminated boolean"
    state = ", _mask binary, _items array<string>"
    spark = documents.sparkSession
    items = benchmark.select(F.col(item).cast("string"), F.col(item_text).cast("string")).dropna()
    blocks = _blocks(items, most_bytes)
    block, following = next(blocks, []), next(blocks, None)
    out = documents.drop("_mask", "_items")
    while True:
        more = following is not None
        out = _scan(out, spark.sparkContext.broadcast(pattern_table(block, window)), text, results + state * more)
        if not more:
            return out.drop("_mask", "_items")
        out, block, following = saved(out), following, next(blocks, None)


def _scan(df: DataFrame, table, text: str, added: str) -> DataFrame:
    """One pass; with the state columns of an earlier pass it goes on from them."""
    if "_mask" in df.columns:  # the state moves to names that the pass does not write
        df = df.withColumnsRenamed({"_mask": "_mask_before", "_items": "_items_before"})
    at = df.columns.index(text)
    kept = [df.columns.index(c) for c in ("_mask_before", "_items_before") if c in df.columns]
    gone = [i for i, c in enumerate(df.columns) if c in ("n_words", "n_hit", "n_items", "items_sha256", "contaminated")]
    at, kept = at - sum(g < at for g in gone), [k - sum(g < k for g in gone) for k in kept]

    def fn(b: pa.RecordBatch) -> dict:
        masks, lists = [], []
        old = list(zip(*(b.column(k).to_pylist() for k in kept))) if kept else [(None, None)] * b.num_rows
        for t, (m, i) in zip(b.column(at).to_pylist(), old):
            words = words_of(t)
            mask, found = bytearray(m or len(words)), set(i or ())
            search(table.value, words, mask, found)
            masks.append(bytes(mask))
            lists.append(sorted(found))
        hit = [m.count(1) for m in masks]
        return {
            "n_words": [len(m) for m in masks], "n_hit": hit, "n_items": [len(x) for x in lists],
            "items_sha256": [hashlib.sha256(",".join(x).encode()).hexdigest() for x in lists],
            "contaminated": [h > 0 for h in hit], "_mask": masks, "_items": lists}

    return add_columns(df, added, fn).drop("_mask_before", "_items_before")
