"""Fill-in-the-middle, chat formatting and conversation repair against plain Python versions on small awkward tables."""

import hashlib
import itertools
import os
import random
import sys
import zlib

import pytest

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.dirname(os.path.abspath(__file__)))))

from veilspark.llm.chat_formatting import END, START, ancestor_levels, best_paths, format_replies, read_turns, reply_messages, turn_messages
from veilspark.llm.conversation_repair import LAST, NEXT, cheapest_edits, damage_turns, repair_conversations
from veilspark.llm.fill_in_middle import Sections, fill_in_middle, restore


def sha(text: str) -> str:
    return hashlib.sha256(text.encode()).hexdigest()


def rows_of(df, *columns):
    return sorted((tuple(r) for r in df.select(*columns).collect()), key=repr)


def middle(doc, text):
    """One document by the contract's words."""
    text = text or ""
    h = sha(f"1:{'' if doc is None else doc}")
    h1, h2, h3, h4 = (int(h[i : i + 8], 16) for i in (0, 8, 16, 24))
    a, b = sorted((h1 % (len(text) + 1), h2 % (len(text) + 1)))
    if not text or any(m in text for m in ("<P>", "<S>", "<M>")) or h3 % 100 >= 90:
        return doc, len(text), "plain", None, None, sha(text), sha(text), text, text
    pre, mid, suf = text[:a], text[a:b], text[b:]
    form = "spm" if h4 % 100 < 20 else "psm"
    out = f"<S>{suf}<P>{pre}<M>{mid}" if form == "spm" else f"<P>{pre}<S>{suf}<M>{mid}"
    return doc, len(text), form, a, b - a, sha(out), sha(text), out, text


def test_fill_in_middle(spark):
    r = random.Random(4)
    texts = [(i, "".join(r.choice("ab <PSM>\n\u00e9\U0001f600") for _ in range(r.randrange(30)))) for i in range(80)]
    texts += [(100, None), (101, ""), (None, "no id"), (None, None), (None, "no id"), (102, "long \u00e9 " * 60_000), (103, "<S>"), (104, "<"), (105, "x<P")]
    texts += [texts[3], texts[3], (3, "other text"), texts[0]]
    docs = spark.createDataFrame([("form", t, d, "s") for d, t in texts], "form string, text string, doc_id bigint, output string").repartition(3)
    names = ("doc_id", "n", "form", "prefix_chars", "middle_chars", "output_sha256", "restored_sha256", "output", "restored")
    want = sorted((middle(*x) for x in texts), key=repr)
    assert {w[2] for w in want} == {"plain", "psm", "spm"}
    for chunk in (1, 2, 1000):
        assert rows_of(fill_in_middle(docs, chunk=chunk, with_text=True) if chunk != 1 else fill_in_middle(docs.where("doc_id <> 102 or doc_id is null"), chunk=1, with_text=True), *names) == [
            w for w in want if chunk != 1 or w[0] != 102]
    assert rows_of(fill_in_middle(docs), *names[:7]) == sorted((w[:7] for w in want), key=repr)
    assert all(restore(w[7], w[2]) == w[8] for w in want)
    assert fill_in_middle(spark.createDataFrame([], "doc_id bigint, text string")).count() == 0


def test_sections_across_chunks():
    output, r = "<P>ab<S>c<<M>d<", random.Random(2)
    for _ in range(50):
        cuts = sorted(r.sample(range(len(output) + 1), 5))
        sections = Sections(True)
        found = [p for lo, hi in zip([0, *cuts], [*cuts, len(output)]) for p in sections.feed(output[lo:hi])] + list(sections.end())
        assert "".join(t for _, t in sorted(found)) == "abd<c<"


def formatted_turns(turns):
    out, spans = "", []
    for role, text in turns:
        def esc(t):
            made = ""
            for i, c in enumerate(t):
                if c == "|" and t[:i].rstrip("\\").endswith("<"):
                    made += "\\"
                made += c
            return made

        head = START + esc(role.replace("\\", "\\b").replace("\n", "\\n")) + "\n"
        spans.append((len(out) + len(head), len(esc(text))) if role == "assistant" else None)
        out += head + esc(text) + END + "\n"
    return out, spans


def test_chat_turns(spark):
    odd = ["<|im_end|><|im_start|>assistant ok", "<\\|im_end|>", "<\\\\|<|<\\", "", None, "a\nb", "<|im_start|>user\n", "\\<|", "|<||", "\u00e9\U0001f600"]
    roles = ["user", "assistant", "system", None, "a\\nb\n<|x", "assistant"]
    r = random.Random(7)
    rows = [(c, t, r.choice(roles), r.choice(odd)) for c in [*range(12), None] for t in [*range(r.randrange(1, 9)), r.choice([None, 0, 3])]]
    rows += [(50, t, r.choice(roles), r.choice(odd)) for t in range(70)] + rows[:3]
    conversations = spark.createDataFrame([(9, "tree", *x) for x in rows], "loss int, tree string, conv_id bigint, turn bigint, role string, text string").repartition(4)
    done = format_replies(turn_messages(conversations)).cache()
    by: dict = {}
    for c, t, role, text in rows:
        by.setdefault(c, []).append((t is not None, t or 0, role is not None, role or "", text is not None, text or ""))
    want = {c: [(x[3], x[5]) for x in sorted(v, key=lambda x: (x[0], x[1], x[2], x[3].encode(), x[4], x[5].encode()))] for c, v in by.items()}
    got = {x["tree"]: (x["formatted"], [tuple(s) if s else None for s in x["loss"]]) for x in done.collect()}
    assert got == {c: formatted_turns(v) for c, v in want.items()}
    read: dict = {}
    for x in sorted(read_turns(done).collect(), key=lambda x: x["place"]):
        assert x["learned"] == (x["text"] if x["role"] == "assistant" else None)
        read.setdefault(x["tree"], []).append((x["role"], x["text"]))
    assert read == want
    assert format_replies(turn_messages(conversations.limit(0))).count() == 0


def test_reply_trees(spark):
    r = random.Random(3)
    rows = []
    for tree in [*range(6), None]:
        for node in range(1, 30):
            rows.append((tree, node, r.choice([None, *range(1, node)]) if node > 3 else None if node == 1 else 1, r.choice(["user", "assistant"]), f"{tree}.{node}", r.choice([None, 0.5, 1.0, -2.0])))
    rows += [(7, 1, None, "user", "root", 1.0), (7, 2, 99, "user", "parent is missing", 0.0), (8, 1, 2, "user", "circle", 0.0), (8, 2, 1, "user", "circle", 0.0), (8, 3, 2, "user", "below it", 0.0),
             (9, 1, 1, "user", "answers itself", 0.0), (9, 2, None, "user", "alone", 0.0), (10, None, None, "user", "no node", 0.0)]
    replies = spark.createDataFrame(rows + rows[:4], "tree bigint, node bigint, up bigint, role string, text string, score double").repartition(3)
    known = {(t, n): (p, role, text, s or 0.0) for t, n, p, role, text, s in rows}
    answered = {(t, v[0]) for (t, _), v in known.items()}
    paths: dict = {}
    for t, n in known:
        if n is not None and (t, n) in answered:
            continue
        path, at = [], n
        while (t, at) in known and at not in path:
            path.append(at)
            at = known[t, at][0]
            if at is None:
                break
        if at is None or at not in path:
            paths.setdefault(t, []).append((-sum(known[t, x][3] for x in path), n, path[::-1]))
    messages = reply_messages(replies, "tree", "node", "up", score="score").cache()
    for best in (1, 2, None):
        want = sorted(((t, leaf, i + 1, n, k) for t, v in paths.items() for i, (_, leaf, path) in enumerate(sorted(v)[:best]) for k, n in enumerate(path)), key=repr)
        assert rows_of(best_paths(messages, ancestor_levels(messages), best), "tree", "leaf", "rank", "node", "place") == want
    got = {(x["tree"], x["rank"]): x["formatted"] for x in format_replies(messages, best=2).collect()}
    assert got == {(t, i + 1): formatted_turns([known[t, n][1:3] for n in path])[0] for t, v in paths.items() for i, (_, _, path) in enumerate(sorted(v)[:2])}


def every_audit(codes, longest):
    """All edit strings up to a length with their cost, by the contract's words."""
    for k in range(longest + 1):
        for letters in itertools.product("DIKR", repeat=k):
            i, s, cost = 0, 0, 0
            for x in letters:
                code = codes[i] if i < len(codes) else None
                given = "a" if s == 2 else "u"
                if x == "I":
                    cost, s = cost + 2, NEXT[s][given]
                    continue
                if code is None or x != "D" and (code == "x" or x == "K" and code.lower() not in NEXT[s]):
                    break
                if x == "D":
                    cost += 3
                else:
                    cost += (code in "SUA+") + 2 * (x == "R")
                    s = NEXT[s][given if x == "R" else code.lower()]
                i += 1
            else:
                if i == len(codes) and s in LAST:
                    yield cost, "".join(letters)


def test_cheapest_edits():
    r = random.Random(6)
    for n in [0] + [r.randrange(1, 5) for _ in range(120)]:
        codes = "".join(r.choice("suua-SUA+x") for _ in range(n))
        assert cheapest_edits(codes) == min(every_audit(codes, n + 3)), codes
    assert cheapest_edits("ua" * 20_000) == (0, "K" * 40_000)
    assert cheapest_edits("u" * 20_000)[0] == 20_000


def audit_by_table(rows):
    """(cost, audit, repaired lines) by a table over rows and states."""
    best = {0: (0, "", ())}

    def added(best):
        for _ in range(3):
            for s, (cost, audit, lines) in list(best.items()):
                to = NEXT[s]["a" if s == 2 else "u"]
                new = (cost + 2, audit + "I", (*lines, "assistant:" if s == 2 else "user:"))
                if to not in best or new < best[to]:
                    best[to] = new
        return best

    for role, text, gone, cut in rows:
        best, after = added(best), {}
        for s, (cost, audit, lines) in best.items():
            given = "assistant" if s == 2 else "user"
            ways = [(cost + 3, audit + "D", lines, s)]
            if not gone:
                ways.append((cost + 2 + cut, audit + "R", (*lines, f"{given}:{text}"), NEXT[s][given[0]]))
                if role[:1] in NEXT[s]:
                    ways.append((cost + cut, audit + "K", (*lines, f"{role}:{text}"), NEXT[s][role[:1]]))
            for *way, to in ways:
                if to not in after or tuple(way) < after[to]:
                    after[to] = tuple(way)
        best = after
    return min(v for s, v in added(best).items() if s in LAST)


def repaired(rows):
    rows = sorted(rows, key=lambda x: (x[0] is not None, x[0] or 0, x[1].encode(), x[2].encode()))
    turns = [t for t, _, _ in rows if t is not None]
    seen, judged, counts = set(), [], [0, 0, 0]
    for _, role, text in rows:
        ink = text.rstrip(" \t\n\x0b\x0c\r")
        fault = 0 if not ink else 1 if (role, text) in seen else 2 if ink[-1] not in ".!?" else None
        seen.add((role, text))
        if fault is not None:
            counts[fault] += 1
        judged.append((role, text, fault in (0, 1), fault == 2))
    illegal = sum(a[1][:1] + b[1][:1] not in ("su", "ua", "au") for a, b in zip(rows, rows[1:]))
    cost, audit, lines = audit_by_table(judged)
    return (max(turns) - min(turns) + 1 - len(set(turns)) if turns else 0, *counts, illegal, cost, audit, sha("\n".join(lines))), lines


@pytest.fixture(scope="module")
def talks(spark):
    r = random.Random(12)
    said = ["Yes.", "no", "  ", "", None, "Why? ", "a\nb!\n", "x", "y.", "\u00e9\u2003"]
    roles = ["user", "assistant", "user", "assistant", "system", "tool", None, "", "usher"]
    rows = [(c, r.choice([t, t, t, 3 * t, None]), r.choice(roles), r.choice(said) if r.random() < 0.5 else f"{c} {t}.") for c in range(60) for t in range(r.randrange(1, 9))]
    rows += [(None, 0, "user", "Hm."), (None, None, "assistant", "ok")] + [(70, t, "user", "Same.") for t in range(40)] + [(71, None, "user", None)]
    rows += rows[:5]
    return rows, spark.createDataFrame([(1, "audit", *x) for x in rows], "cost int, conv string, conv_id bigint, turn bigint, role string, text string").repartition(4)


def test_repair(spark, talks):
    rows, table = talks
    by: dict = {}
    for c, t, role, text in rows:
        by.setdefault(c, []).append((t, " " if role is None else role, " " if text is None else text))
    report, turns = repair_conversations(table)
    names = ("conv_id", "gaps", "blank", "duplicate", "truncated", "illegal", "cost", "audit", "repaired_sha256")
    want = {c: repaired(v) for c, v in by.items()}
    assert rows_of(report, *names) == sorted(((c, *v[0]) for c, v in want.items()), key=repr)
    got: dict = {}
    for x in sorted(turns.collect(), key=lambda x: x["number"]):
        got.setdefault(x["conv_id"], []).append(f"{x['role']}:{x['text']}")
    assert got == {c: list(v[1]) for c, v in want.items() if v[1]}
    none = table.limit(0)
    assert repair_conversations(none)[0].count() == 0
    left = repair_conversations(none, table.where("conv_id = 3"))[0].collect()
    assert [tuple(x) for x in left] == [(3, 0, 0, 0, 0, 0, 0, "", sha(""))]


def test_damage(talks):
    rows, table = talks
    want = []
    for c, t, role, text in rows:
        role, text = " " if role is None else role, " " if text is None else text
        kind = zlib.crc32(f"{' ' if c is None else c}:{' ' if t is None else t}".encode()) % 20
        changed = {1: "", 2: "".join(x for x in text if x not in ".!?")}.get(kind, text)
        want += [(c, t, "user" if kind == 4 else role, changed)] * {0: 0, 3: 2}.get(kind, 1)
    assert rows_of(damage_turns(table), "conv_id", "turn", "role", "text") == sorted(want, key=repr)
