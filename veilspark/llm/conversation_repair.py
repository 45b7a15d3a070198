"""Structure repair of conversations: the cheapest edits that make the roles take turns, by bidirectional Dijkstra.

Rows are judged where they lie; the lattice of a conversation sees one code of a byte per row.  Edits go back to their rows
by a secondary sort, which streams the repaired conversation into a digest; no conversation's texts are gathered."""

from __future__ import annotations

import hashlib
from array import array
from collections.abc import Iterator
from heapq import heappop, heappush

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from veilspark.llm.shared import add_columns, map_batches, saved

#: Roles that turns can be given, by their initial.
ROLES = {"u": "user", "a": "assistant"}
COSTS = {"K": 0, "R": 2, "D": 3, "I": 2}
TRUNCATED = 1
#: States of the accepted roles ``(s?(ua)+)?``: nothing yet, a system turn, a user turn, an assistant turn.
NEXT = ({"s": 1, "u": 2}, {"u": 2}, {"a": 3}, {"u": 2})
LAST = (0, 3)
#: The only role of ``ROLES`` that each state takes.
GIVEN = tuple(next(r for r in ROLES if r in moves) for moves in NEXT)
_STATES, _FAR = len(NEXT), 1 << 60

#: Row codes: the initial that Keep emits (s, u, a, or - for one that no state takes); capitals and + mark truncated rows,
#: x a row that has to go.
GO = "x"


def _edits(code: str | None, state: int) -> Iterator[tuple[str, int, int, bool]]:
    """(letter, cost, state after, whether a row is used) of the edits before a row of this code (None: at the end), in the
    order of their letters; at most one edit has a given letter, so a path is told by its letters."""
    given = NEXT[state][GIVEN[state]]
    if code is not None:
        yield "D", COSTS["D"], state, True
    yield "I", COSTS["I"], given, False
    if code is not None and code != GO:
        extra, kept = (TRUNCATED, code.lower()) if code in "SUA+" else (0, code)
        if kept in NEXT[state]:
            yield "K", COSTS["K"] + extra, NEXT[state][kept], True
        yield "R", COSTS["R"] + extra, given, True


def _entered() -> dict[str, list[list[tuple[int, int, bool]]]]:
    """For every code and state the edits that lead to it: (cost, state before, whether a row is used)."""
    found: dict = {}
    for code in [*"sua-SUA+" + GO, None]:
        back = found[code] = [[] for _ in range(_STATES)]
        for state in range(_STATES):
            for _, cost, after, used in _edits(code, state):
                back[after].append((cost, state, used))
    return found


_INTO = _entered()
_OUT = {code: [list(_edits(code, s)) for s in range(_STATES)] for code in _INTO}


def cheapest_edits(codes: str) -> tuple[int, str]:
    """(cost, letters) of the cheapest edits of rows with these codes; of equal ones, the letters that come first in ASCII.

    A node of the lattice is (rows used, state).  One heap grows from the start and one from the accepted ends until their
    least costs together exceed the best crossing found.  By then every cheapest path has a node that the reverse side has
    finished and the forward side has reached.  Nodes on cheapest ways to such crossings are marked; a walk from the start
    takes the least letter among them, and from a crossing on the least letter that keeps the remaining cost.  Letters tell
    a path, so this is the least of all concatenated audits.  Memory is a few numbers for a row."""
    n = len(codes)
    size, end = (n + 1) * _STATES, n * _STATES
    ahead, behind = array("q", [_FAR]) * size, array("q", [_FAR]) * size
    done_ahead, done_behind = bytearray(size), bytearray(size)
    ahead[0] = 0
    forward, reverse = [(0, 0, 0)], []
    for s in LAST:
        behind[end + s] = 0
        heappush(reverse, (0, -n, s))
    best, crossings = _FAR, set()

    def meet(node: int) -> None:
        nonlocal best
        total = ahead[node] + behind[node]
        if total < best:
            best = total
            crossings.clear()
        if total == best:
            crossings.add(node)

    def into(i: int, s: int) -> Iterator[tuple[int, int, int, int]]:
        """(cost, node, rows used there, state there) of the edits that lead to a node."""
        for used in (0, 1):
            at = i - used
            if at >= 0:
                for step, before, uses in _INTO[codes[at] if at < n else None][s]:
                    if uses == used:
                        yield step, at * _STATES + before, at, before

    meet(0)
    while forward and reverse and forward[0][0] + reverse[0][0] <= best:
        # Equal costs go by position: Keep can be free and leads on, so a node's cost and ways are final when it is taken.
        if forward[0][0] <= reverse[0][0]:
            cost, i, s = heappop(forward)
            node = i * _STATES + s
            if done_ahead[node]:
                continue
            done_ahead[node] = 1
            for _, step, after, used in _OUT[codes[i] if i < n else None][s]:
                to = (i + used) * _STATES + after
                if cost + step < ahead[to]:
                    ahead[to] = cost + step
                    heappush(forward, (cost + step, i + used, after))
                    meet(to)
        else:
            cost, i, s = heappop(reverse)
            node = s - i * _STATES
            if done_behind[node]:
                continue
            done_behind[node] = 1
            for step, to, at, before in into(-i, s):
                if cost + step < behind[to]:
                    behind[to] = cost + step
                    heappush(reverse, (cost + step, -at, before))
                    meet(to)

    crossings = {c for c in crossings if done_behind[c] or not behind[c] and c >= end}
    good, stack = set(crossings), list(crossings)
    while stack:
        node = stack.pop()
        for step, source, _, _ in into(*divmod(node, _STATES)):
            if done_ahead[source] and ahead[source] + step == ahead[node] and source not in good:
                good.add(source)
                stack.append(source)
    letters, i, s, past = [], 0, 0, False
    while True:
        node = i * _STATES + s
        past = past or node in crossings
        if past and i == n and not behind[node]:
            return best, "".join(letters)
        for letter, step, after, used in _OUT[codes[i] if i < n else None][s]:
            to = (i + used) * _STATES + after
            if behind[to] + step == behind[node] if past else to in good and ahead[node] + step == ahead[to]:
                break
        else:
            raise AssertionError(f"no way on from row {i} of {codes}")
        letters.append(letter)
        i, s = i + used, after


def edited_roles(codes: str, letters: str) -> Iterator[tuple[int, str, str | None]]:
    """(rows used before, letter, role given or None) of every edit but Delete."""
    i, s = 0, 0
    for letter in letters:
        _, _, after, used = next(e for e in _OUT[codes[i] if i < len(codes) else None][s] if e[0] == letter)
        if letter != "D":
            yield i, letter, None if letter == "K" else ROLES[GIVEN[s]]
        i, s = i + used, after


def damage_turns(turns: DataFrame, conv: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text") -> DataFrame:
    """Rows with known faults: of twenty classes by CRC-32 of ``conv:turn``, 0 is dropped, 1 loses its text, 2 its sentence
    ends, 3 is repeated, 4 becomes a user's.  Null roles and texts, and null ids in the hashed name, are one space."""

    def shown(c: str) -> Column:
        return F.coalesce(F.col(c).cast("string"), F.lit(" "))

    kind = F.crc32(F.concat(shown(conv), F.lit(":"), shown(turn))) % 20
    changed = turns.select(
        F.col(conv).alias(conv), F.col(turn).alias(turn), F.when(kind == 4, "user").otherwise(shown(role)).alias(role),
        F.when(kind == 1, "").when(kind == 2, F.translate(shown(text), ".!?", "")).otherwise(shown(text)).alias(text),
        F.explode(F.when(kind == 0, F.array_repeat(F.lit(1), 0)).otherwise(F.array_repeat(F.lit(1), F.when(kind == 3, 2).otherwise(1)))))
    return changed.select(conv, turn, role, text)


def numbered_turns(turns: DataFrame, conv: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text") -> DataFrame:
    """(conv, pos, turn, role, text, initial, illegal, new_turn): rows in order of turn (nulls first, ties by role and text)."""
    order = Window.partitionBy("conv").orderBy(F.col("turn").asc_nulls_first(), "role", "text")
    rows = turns.select(F.col(conv).alias("conv"), F.col(turn).cast("bigint").alias("turn"),
                        *(F.coalesce(F.col(c).cast("string"), F.lit(" ")).alias(a) for c, a in ((role, "role"), (text, "text"))))
    rows = rows.withColumn("initial", F.substring("role", 1, 1))
    pair = F.concat(F.lag("initial").over(order), "initial")
    return rows.select(
        "conv", (F.row_number().over(order) - 1).cast("bigint").alias("pos"), "turn", "role", "text", "initial",
        F.coalesce(~pair.isin("su", "ua", "au"), F.lit(False)).alias("illegal"),
        (F.col("turn").isNotNull() & ~F.col("turn").eqNullSafe(F.lag("turn").over(order))).alias("new_turn"))


def judged_conversations(numbered: DataFrame) -> DataFrame:
    """(conv, gaps, blank, duplicate, truncated, illegal, codes, cost, audit) of every conversation of ``numbered_turns``.

    A repeated text is found by the first row of its 256-bit digest, so a conversation that says one thing over and over is
    no hot key.  The codes of a conversation come together, a byte for a row."""
    inked = F.rtrim(F.col("text"), F.lit(" \t\n\x0b\x0c\r"))
    rows = numbered.select(
        "conv", "pos", "turn", "initial", "illegal", "new_turn", (inked == "").alias("blank"),
        (~F.substring(inked, -1, 1).isin(".", "!", "?")).alias("cut"),
        F.sha2(F.concat(F.char_length("role").cast("string"), F.lit(":"), "role", "text"), 256).alias("said"))
    firsts = rows.where(~F.col("blank")).groupBy("conv", "said").agg(F.min("pos").alias("pos2"))
    firsts = firsts.select(F.col("conv").alias("conv2"), "pos2")
    rows = rows.drop("said").join(firsts, F.col("conv").eqNullSafe(F.col("conv2")) & (F.col("pos") == F.col("pos2")), "left")
    again = ~F.col("blank") & F.col("pos2").isNull()
    cut = ~F.col("blank") & ~again & F.col("cut")
    plain = F.when(F.col("initial").isin("s", "u", "a"), F.col("initial")).otherwise("-")
    code = F.when(F.col("blank") | again, GO).when(cut, F.translate(plain, "sua-", "SUA+")).otherwise(plain)

    def count(c: Column) -> Column:
        return F.count_if(c)

    per = rows.groupBy("conv").agg(
        F.coalesce(F.max("turn") - F.min("turn") + 1 - count(F.col("new_turn")), F.lit(0)).alias("gaps"),
        count(F.col("blank")).alias("blank"), count(again).alias("duplicate"), count(cut).alias("truncated"),
        count(F.col("illegal")).alias("illegal"), F.sort_array(F.collect_list(F.struct("pos", code.alias("code")))).alias("codes"))
    per = per.withColumn("codes", F.array_join("codes.code", ""))

    def solve(b: pa.RecordBatch) -> dict:
        cost, audit = zip(*map(cheapest_edits, b.column("codes").to_pylist()))
        return {"cost": cost, "audit": audit}

    return add_columns(per, "cost bigint, audit string", solve)


def repaired_turns(numbered: DataFrame, judged: DataFrame) -> DataFrame:
    """(conv, number, role, text) of the repaired conversations, those of one conversation in order and in one partition.

    Edits and rows are dealt by conversation and sorted by position, an edit before the row it uses, and merged as they
    stream past; a row without an edit was deleted."""
    kind = numbered.schema["conv"].dataType
    schema = T.StructType([T.StructField("conv", kind), *T.StructType.fromDDL("pos bigint, number bigint, letter string, role string, text string").fields])

    def edits(batches: Iterator[pa.RecordBatch]) -> Iterator[dict]:
        made: dict[str, list] = {f: [] for f in schema.names}
        for b in batches:
            for conv, codes, audit in zip(*(b.column(c).to_pylist() for c in ("conv", "codes", "audit"))):
                for number, (pos, letter, role) in enumerate(edited_roles(codes, audit)):
                    for f, v in zip(made, (conv, pos, number, letter, role, None)):
                        made[f].append(v)
                    if len(made["pos"]) >= 10_000:
                        yield made
                        made = {f: [] for f in schema.names}
        yield made

    given = map_batches(judged.select("conv", "codes", "audit"), schema, edits)
    rows = numbered.select("conv", "pos", F.lit(None).cast("bigint").alias("number"), F.lit(None).cast("string").alias("letter"), "role", "text")
    together = given.union(rows).repartition("conv").sortWithinPartitions("conv", "pos", F.col("number").asc_nulls_last())

    def merge(batches: Iterator[pa.RecordBatch]) -> Iterator[dict]:
        waiting = None
        for b in batches:
            for lo in range(0, b.num_rows, 1024):
                made: dict[str, list] = {f: [] for f in ("conv", "number", "role", "text")}
                for conv, pos, number, letter, role, text in zip(*(c.to_pylist() for c in b.slice(lo, 1024).columns)):
                    if letter in ("K", "R"):
                        waiting = (conv, pos, number, role)
                        continue
                    if letter is None:
                        if waiting is None or waiting[:2] != (conv, pos):
                            continue
                        number, role, waiting = waiting[2], waiting[3] or role, None
                    for f, v in zip(made, (conv, number, role, text or "")):
                        made[f].append(v)
                yield made

    out = T.StructType([schema.fields[0], *T.StructType.fromDDL("number bigint, role string, text string").fields])
    return map_batches(together, out, merge)


def turn_digests(repaired: DataFrame) -> DataFrame:
    """(conv, sha256) of the lines ``role:text`` of every conversation, fed one by one."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[dict]:
        last, digest = None, None
        for b in batches:
            done: dict[str, list] = {"conv": [], "sha256": []}
            for conv, number, role, text in zip(*(c.to_pylist() for c in b.columns)):
                if digest is None or number == 0 or conv != last:
                    if digest is not None:
                        done["conv"].append(last)
                        done["sha256"].append(digest.hexdigest())
                    last, digest = conv, hashlib.sha256(f"{role}:{text}".encode())
                else:
                    digest.update(f"\n{role}:{text}".encode())
            yield done
        if digest is not None:
            yield {"conv": [last], "sha256": [digest.hexdigest()]}

    return map_batches(repaired, T.StructType([repaired.schema["conv"], T.StructField("sha256", T.StringType())]), run)


def repair_conversations(turns: DataFrame, ids: DataFrame | None = None, conv: str = "conv_id", turn: str = "turn", role: str = "role",
                         text: str = "text") -> tuple[DataFrame, DataFrame]:
    """(per conversation: its id, gaps, blank, duplicate, truncated, illegal, cost, audit, repaired_sha256; repaired turns).

    ``ids`` (a column named as ``conv``) adds conversations that have no rows left: zeros, an empty audit, the digest of
    nothing.  Each row's first fault counts: blank, duplicate, truncated.  Null roles and texts are one space, null turns come first, a null id is a conversation of its own;
    rows of one turn are in order of role and text; repeated rows are duplicates; an empty table gives no rows.  Other
    columns are not read.  Numbered rows and judgements are written once, so both results come from the same rows."""
    numbered = saved(numbered_turns(turns, conv, turn, role, text))
    judged = saved(judged_conversations(numbered))
    repaired = repaired_turns(numbered, judged)
    nothing = hashlib.sha256().hexdigest()
    digests = turn_digests(repaired).select(F.col("conv").alias("conv2"), "sha256")
    found = judged.join(digests, F.col("conv").eqNullSafe(F.col("conv2")), "left")
    every = (ids.select(F.col(conv).alias("conv3")) if ids is not None else judged.select(F.col("conv").alias("conv3"))).distinct()
    found = every.join(found, F.col("conv3").eqNullSafe(F.col("conv")), "left")
    numbers = ("gaps", "blank", "duplicate", "truncated", "illegal", "cost")
    report = found.select(
        F.col("conv3").alias(conv), *(F.coalesce(F.col(c), F.lit(0)).cast("bigint").alias(c) for c in numbers),
        F.coalesce("audit", F.lit("")).alias("audit"), F.coalesce("sha256", F.lit(nothing)).alias("repaired_sha256"))
    return report, repaired.select(F.col("conv").alias(conv), "number", "role", "text")
