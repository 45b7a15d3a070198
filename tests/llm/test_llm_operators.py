"""Operators of the llm subpackage against plain Python versions on small tables with awkward rows."""

import hashlib
import os
import random
import sys
import zlib
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.dirname(os.path.abspath(__file__)))))

from veilspark.llm import ngram_join
from veilspark.llm.decontamination import mark_hits, words_of
from veilspark.llm.language_id import identify_language, learn_dictionaries
from veilspark.llm.line_dedup import CuckooFilter, LineIndex, dedup_lines
from veilspark.llm.lm_scoring import _broadcast_scores, _joined_scores, count_corpus, score_texts
from veilspark.llm.ngram_join import jaccard_components, one_of_each, trie_links
from veilspark.llm.packing import WordIds, pack
from veilspark.llm.queries import tokenizer_file
from veilspark.llm.shared import components
from veilspark.llm.suffix_dedup import remove_repeats
from veilspark.llm.url_filter import judge_urls
from veilspark.llm.vector_dedup import near_duplicate_vectors
from veilspark.llm.warc_archive import read_archive, write_archive

WORDS = "alpha beta gamma delta eps zeta eta theta iota kappa lamda my ny xi pi rho sigma tau phi chi psi omega".split()
#: Names that results have too.
EXTRA = {"n_words": 7, "score": "x", "host": "h", "n_lines": 1, "_drop": 2, "component_id": -5, "verified": "no"}


def texts(seed: int = 3) -> list[tuple[int, str | None]]:
    r = random.Random(seed)
    passage = " ".join(r.choice(WORDS) for _ in range(30))
    base = [r.choice(WORDS) + str(r.randrange(40)) for _ in range(60)]
    out: list[tuple[int, str | None]] = [(1, None), (2, ""), (3, " \n\t "), (4, "alpha"), (5, "ALPHA"), (6, "É!"), (7, "a\n" * 3)]
    for i in range(8, 40):
        own = list(base)
        for _ in range(r.randrange(5)):
            own[r.randrange(len(own))] = f"new{i}x{r.randrange(9)}"
        out.append((i, " ".join(own) + "\n" + passage.upper() + " \n" + "tail %d" % r.randrange(3)))
    out += [(i, " ".join(f"w{r.randrange(400)}" for _ in range(50)) + "\n" + passage) for i in range(40, 55)]
    out.append((60, "long " * 30_000 + passage))
    out += [out[10], out[10], out[0]]
    return out


@pytest.fixture(scope="module")
def docs(spark):
    df = spark.createDataFrame(texts(), "doc_id bigint, text string").repartition(3)
    return df.withColumns({k: F.lit(v) for k, v in EXTRA.items()})


def empty(spark, schema):
    return spark.createDataFrame([], schema)


def by_id(df, *columns):
    return sorted(tuple(r) for r in df.select(*columns).collect())


def test_jaccard_components(spark, docs):
    rows = texts()
    sets = []
    for _, t in rows:
        w = (t or "").encode().lower().split()
        sets.append(frozenset(tuple(w[i : i + 5]) for i in range(len(w) - 4)) if len(w) >= 5 else frozenset([tuple(w)] if w else []))
    root = list(range(len(rows)))

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for i in range(len(rows)):
        for j in range(i):
            if sets[i] and sets[j] and 100 * len(sets[i] & sets[j]) >= 75 * len(sets[i] | sets[j]):
                root[find(i)] = find(j)
    least: dict = {}
    for i, (d, _) in enumerate(rows):
        if sets[i]:
            least[find(i)] = min(least.get(find(i), d), d)
    want = sorted((d, len(sets[i]), least[find(i)] if sets[i] else d) for i, (d, _) in enumerate(rows))
    assert by_id(jaccard_components(docs), "doc_id", "n_shingles", "component_id") == want
    assert jaccard_components(empty(spark, "doc_id bigint, text string")).count() == 0
    odd = spark.createDataFrame([(None, "a b c d e f"), (None, None), (4, "a b c d e f")], "doc_id bigint, text string")
    assert sorted(map(str, by_id(jaccard_components(odd).na.fill(-1), "doc_id", "component_id"))) == ["(-1, -1)", "(-1, 4)", "(4, 4)"]


def test_rows_without_an_id_link_others(spark):
    base = [f"w{i}" for i in range(70)]
    near, far = base[:65] + ["x1", "x2", "x3", "x4", "x5"], ["y1", "y2", "y3", "y4", "y5"] + base[5:65] + ["x1", "x2", "x3", "x4", "x5"]
    df = spark.createDataFrame([(1, " ".join(base)), (None, " ".join(near)), (None, " ".join(near)), (2, " ".join(far))], "doc_id bigint, text string")
    assert sorted(by_id(jaccard_components(df).na.fill(-1), "doc_id", "component_id")) == [(-1, 1), (-1, 1), (1, 1), (2, 1)]
    assert by_id(one_of_each(df), "doc_id") == [(1,)]


def test_pairs_of_template_texts_are_not_all_written(spark, monkeypatch):
    """Texts of the same sentences that hardly link: the last round's pairs, in the square of them, stay inside the tasks."""
    r = random.Random(5)
    sentences = [" ".join(f"s{k}w{j}" for j in range(8)) for k in range(40)]
    rows = [(i, " ".join(sentences[k] for k in sorted(r.sample(range(40), 24)))) for i in range(400)]
    written, save = [], ngram_join.saved

    def counted(df, *by):
        out = save(df, *by)
        if out.columns == ["a", "b"]:
            written.append(out.count())
        return out

    monkeypatch.setattr(ngram_join, "saved", counted)
    got = {x.doc_id: x.component_id for x in jaccard_components(spark.createDataFrame(rows, "doc_id bigint, text string")).collect()}
    words = {i: t.split() for i, t in rows}
    sets = {i: {tuple(w[k : k + 5]) for k in range(len(w) - 4)} for i, w in words.items()}
    group = {i: i for i in sets}
    for x in sets:
        for y in range(x):
            if 100 * len(sets[x] & sets[y]) >= 75 * len(sets[x] | sets[y]) and group[x] != group[y]:
                low, high = sorted((group[x], group[y]))
                group = {i: low if g == high else g for i, g in group.items()}
    assert got == group
    assert max(written[1:]) <= 8 * len(rows)


def test_blocks_of_buckets_meet_like_all_their_rows(spark, monkeypatch):
    """Buckets 0 to 3 share a main component and their classes, 4 to 23 only the main component, 24 to 29 nothing."""
    r = np.random.default_rng(4)
    monkeypatch.setattr(ngram_join, "_BLOCK", 7)
    mixed, sets = [], {}
    for h in range(30):
        kind, size = (0 if h < 4 else 1 if h < 24 else 2), int(r.integers(3, 40))
        base = np.random.default_rng((h, 0, h)[kind] + 50).integers(0, 1 << 48, 900)
        for k in range(size):
            inside = k < 9 if kind < 2 else None
            c = k + (1000 if kind < 2 and inside else 2000 if kind == 0 else 3000 + h * 100)
            if c not in sets:
                sets[c] = np.unique(np.concatenate([base[: r.integers(500, 900)], r.integers(0, 1 << 48, r.integers(1, 200))]))
            n = len(sets[c])
            mixed.append((h, c, n, int(r.integers(0, n // 4)), 7 if inside else 50 + (c * 7919) % 12, 7 if kind < 2 else 50))
    bins = {c: ngram_join._bits(keys) for c, keys in sets.items()}
    want = set()
    for h, c, n, i, part, main in mixed:
        for h2, c2, n2, i2, part2, _ in mixed:
            need = ngram_join._least_overlap(n + n2, 75)
            if h == h2 and part != main and part != part2 and n - i >= need and n2 - i2 >= need:
                if ngram_join._may_overlap(bins[c], bins[c2], n, n2, need):
                    want.add((min(c, c2), max(c, c2)))
    found = ngram_join._near_in_buckets(
        spark.createDataFrame(mixed, "h long, c long, n int, i int, component long, main long"),
        spark.createDataFrame(list(bins.items()), "cls long, bins binary"), 75)
    got = list(map(tuple, found.collect()))
    part = {c: p for _, c, _, _, p, _ in mixed}
    assert len(want) > 20 and want <= set(got) and len(got) == len(set(got))
    assert all(a < b and part[a] != part[b] and ngram_join._may_overlap(
        bins[a], bins[b], n := len(sets[a]), m := len(sets[b]), ngram_join._least_overlap(n + m, 75)) for a, b in got)


def test_one_of_each(spark):
    r = random.Random(2)
    base = [f"w{i}" for i in range(80)]
    other = " ".join(f"z{i}" for i in range(50))
    copy = lambda i: " ".join(base[:i] + ["new"] + base[i + 1 :])
    rows = [(1, " ".join(base)), (2, copy(40)), (2, other), (None, copy(41)), (None, "quite another text of its own here"), (3, None), (3, None),
            (4, " "), (4, None), (None, None), (5, other.upper()), (1, "  ".join(base)), (9, "one more text that is like none")]
    r.shuffle(rows)
    df = spark.createDataFrame([(*x, 7, "c", 0) for x in rows], "doc_id bigint, text string, _cls int, g string, n int").withColumnsRenamed({"_cls": "cls"}).repartition(4)
    got = by_id(one_of_each(df).na.fill(-1, ["doc_id"]).na.fill("", ["text"]), "doc_id", "text")
    got = sorted((d, " ".join(t.split()) if t and d == 1 else t or "") for d, t in got)
    assert got == sorted([(1, " ".join(base)), (2, other), (-1, "quite another text of its own here"), (3, ""), (4, " "), (4, ""), (-1, ""),
                          (9, "one more text that is like none")])
    assert one_of_each(df).columns == df.columns and one_of_each(df.limit(0)).count() == 0


def test_trie_walk():
    r = random.Random(5)
    for _ in range(300):
        query = np.asarray(sorted(r.sample(range(40), r.randrange(1, 30))))
        members = [(i, np.asarray(sorted(r.sample(range(40), r.randrange(1, 30))))) for i in range(12)]
        members += [(20 + i, np.asarray(sorted(set(query.tolist()) ^ set(r.sample(range(40), i))))) for i in range(4)]
        members = [m for m in members if len(m[1])]
        want = {i for i, m in members if 100 * len(set(m) & set(query)) >= 75 * len(set(m) | set(query))}
        assert set(trie_links(query, members, 75)) == want


def test_components(spark):
    r = random.Random(8)
    edges = [(r.randrange(300), r.randrange(300)) for _ in range(200)] + [(1000 + i, 1001 + i) for i in range(60)] + [(5, 5)]
    root = {x: x for e in edges for x in e}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a, b in edges:
        a, b = find(a), find(b)
        root[max(a, b)] = min(a, b)
    touched = {x for a, b in edges if a != b for x in (a, b)}
    got = dict(by_id(components(spark.createDataFrame(edges, "a bigint, b bigint")), "id", "component"))
    assert got == {x: find(x) for x in touched}
    assert components(empty(spark, "a bigint, b bigint")).count() == 0


def test_url_filter(spark):
    rules = spark.createDataFrame([("net", "/", "block"), ("b.net", "/en/", "allow"), ("b.net", "/en/x", "block"), ("c.org", "", "block"), (None, "/", "block")],
                                  "host string, path string, verdict string")
    urls = {
        "http://A.B.net/en/x?q": ("a.b.net", "/en/x", "b.net/en/x", "block"), "x://b.NET/en/y#z/": ("b.net", "/en/y", "b.net/en/", "allow"),
        "http://net": ("net", "", None, "allow"), "http://inet/": ("inet", "/", None, "allow"), "http://net/?": ("net", "/", "net/", "block"),
        "no scheme net/": ("", "", None, "allow"), "": ("", "", None, "allow"), "://d.c.org?http://net/": ("d.c.org", "", "c.org", "block"),
        "http://" + "a." * 3000 + "net/" + "p" * 5000: ("a." * 3000 + "net", "/" + "p" * 5000, "net/", "block"),
    }
    rows = [(i, u) for i, u in enumerate([*urls, "http://net/?"])] + [(99, None)]
    pages = spark.createDataFrame(rows, "page_id bigint, url string").withColumns({"host": F.lit(1), "rule": F.lit("r"), "short": F.lit(2)})
    got = {(r.page_id, r.url): (r.host, r.path, r.rule, r.verdict) for r in judge_urls(pages, rules).collect()}
    assert got == {(i, u): urls.get(u, ("", "", None, "allow")) for i, u in rows}
    assert judge_urls(pages, empty(spark, rules.schema)).where("verdict = 'allow' and rule is null").count() == len(rows)
    assert judge_urls(pages.limit(0), rules).count() == 0


def test_decontamination(spark, docs):
    passage = next(t for d, t in texts() if d == 40).split("\n")[1]
    items = [(1, passage), (2, "alpha"), (3, None), (4, ""), (5, " ".join(passage.split()[3:16])), (10, "never seen words at all here to be found anywhere today"), (None, "beta")]
    benchmark = spark.createDataFrame(items, "item_id bigint, text string")

    def brute(t):
        words, mask, own = words_of(t), None, set()
        mask = [False] * len(words)
        for item, x in items:
            w = words_of(x)
            m = min(10, len(w))
            windows = {tuple(w[i : i + m]) for i in range(len(w) - m + 1)} if m and item is not None else set()
            for i in range(len(words) - m + 1):
                if tuple(words[i : i + m]) in windows:
                    mask[i : i + m] = [True] * m
                    own.add(str(item))
        return len(words), sum(mask), len(own), hashlib.sha256(",".join(sorted(own)).encode()).hexdigest(), any(mask)

    want = sorted((d, *brute(t)) for d, t in texts())
    names = ("doc_id", "n_words", "n_hit", "n_items", "items_sha256", "contaminated")
    assert by_id(mark_hits(docs, benchmark), *names) == want
    assert by_id(mark_hits(docs, benchmark, most_bytes=30), *names) == want  # in several blocks
    assert mark_hits(docs, benchmark.limit(0)).where("contaminated").count() == 0
    assert mark_hits(docs.limit(0), benchmark).count() == 0


def test_packing(spark, docs):
    from tokenizers import Tokenizer

    file = tokenizer_file()
    t, size = Tokenizer.from_file(file), 64
    words = WordIds(file, most=20)
    r = random.Random(2)
    signs = [*"aAbÉßµ² .,'\t\n\x1c\x85\xa0\u0301Σİ日3|<>", "'s", "<|endoftext|>"]
    for _ in range(3000):
        x = "".join(r.choice(signs) for _ in range(r.randrange(14)))
        assert np.frombuffer(words(x), "<u4").tolist() == t.encode(x, add_special_tokens=False).ids
    # Equal words in upper and lower case are one; a special token is found as it is written only; one file is read once.
    words = WordIds(file)
    assert words("Word WORD word. \u00c9t\u00c9") + words("\u00e9t\u00e9 word") and set(words.known) == {"word", "word.", "\u00e9t\u00e9"}
    for x in ("<|ENDOFTEXT|> Word", "<|endoftext|> Word", "It'S WE'LL", "\u212a K k", "\u0130I\u03a3 \u00c5 A\u030a", "A\u00adB 4\u00b2 x\u00b2 \u00aa\u00ba"):
        assert np.frombuffer(words(x), "<u4").tolist() == t.encode(x, add_special_tokens=False).ids
    assert WordIds(file).tokenizer is words.tokenizer
    pieces = pack(docs, file, size, with_ids=True).orderBy("sequence_id", "offset").collect()
    assert [p.sequence_id * size + p.offset for p in pieces] == np.cumsum([0, *(p.length for p in pieces)])[:-1].tolist()
    assert all(p.offset + p.length <= size and p.ids_crc32 == zlib.crc32(p.ids) and len(p.ids) == 4 * p.length for p in pieces)
    whole: list = []
    for p in pieces:
        if p.start == 0:
            whole.append((p.doc_id, bytes(p.ids), p.doc_tokens))
        else:
            whole[-1] = (whole[-1][0], whole[-1][1] + bytes(p.ids), p.doc_tokens)
    want = [(d, np.asarray([*t.encode(x or "", add_special_tokens=False).ids, 1], "<u4").tobytes()) for d, x in texts()]
    assert sorted((d, b) for d, b, _ in whole) == sorted(want) and all(len(b) == 4 * n for _, b, n in whole)
    assert pack(docs.limit(0), file).count() == 0


def test_vectors(spark):
    r = np.random.default_rng(4)
    base = r.standard_normal((40, 16))
    rows = [(i, [float(x) for x in base[i % 40] + (i // 40) * 0.05 * r.standard_normal(16)]) for i in range(200)]
    rows += [(300 + i, rows[3][1]) for i in range(60)] + [(400, [2 * x for x in rows[3][1]])]
    bad = [(500, None), (501, []), (502, [0.0] * 16), (503, [1.0, None] * 8), (504, [float("nan")] * 16), (505, [float("inf")] * 16)]
    short = [(600, [1.0, 0.0]), (601, [1.0, 0.01])]
    ids = [i for i, _ in rows]
    x = np.asarray([v for _, v in rows])
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    link = x @ x.T >= 0.95
    np.fill_diagonal(link, False)
    comp = list(range(len(ids)))
    for _ in range(len(ids)):
        comp = [min([comp[i], *(comp[j] for j in np.flatnonzero(link[i]))]) for i in range(len(ids))]
    df = spark.createDataFrame(rows + bad + short, "vec_id bigint, embedding array<double>").withColumn("rep", F.lit(1))
    for block in (1024, 16):
        got = {r.vec_id: (r.n_links, r.component_id, r.kept) for r in near_duplicate_vectors(df, recall=0.9999, block=block).collect()}
        assert all(got[i] == (0, i, True) for i, _ in bad)
        assert got[600] == (1, 600, True) and got[601] == (1, 600, False)
        assert {i: got[i] for i in ids} == {
            i: (int(link[k].sum()), ids[comp[k]], ids[comp[k]] == i) for k, i in enumerate(ids)}
    assert near_duplicate_vectors(df.limit(0)).count() == 0


def brute_lines(rows):
    key = lambda x: x.strip(" \t\n\x0b\x0c\r").translate({c: c + 32 for c in range(65, 91)})
    held: dict = {}
    for d, t in rows:
        for x in (t or "").split("\n"):
            if len(key(x)) >= 40:
                held.setdefault(key(x), set()).add(d)
    out = []
    for d, t in rows:
        lines = (t or "").split("\n")
        kept = [x for x in lines if len(held.get(key(x), ())) < 5 or d == max(held[key(x)])]
        out.append((d, "\n".join(kept), len(lines), len(lines) - len(kept)))
    return sorted(out)


def test_line_dedup(spark, docs):
    names = ("doc_id", "text", "n_lines", "n_dropped")
    assert by_id(dedup_lines(docs), *names) == brute_lines(texts())
    first, second = docs.where("doc_id < 30 or doc_id = 60"), docs.where("doc_id >= 30 and doc_id <> 60")
    index = LineIndex(spark).insert(first)
    before = by_id(index.dedup(first), *names)
    index.insert(second).insert(second)
    assert by_id(index.dedup(docs), *names) == brute_lines(texts())
    index.delete(second.select("doc_id"))
    assert by_id(index.dedup(first), *names) == before == brute_lines([r for r in texts() if r[0] < 30 or r[0] == 60])
    assert dedup_lines(docs.limit(0)).count() == 0
    odd = spark.createDataFrame([(None, "x" * 50)] * 6, "doc_id bigint, text string")
    assert dedup_lines(odd).where("n_dropped > 0").count() == 0


def test_cuckoo_filter():
    r = random.Random(1)
    keys = [r.randbytes(16) for _ in range(3000)]
    f = CuckooFilter(1000)
    for k in keys:
        f.add(k)
    f = CuckooFilter(0, f.to_bytes())
    assert all(k in f for k in keys)
    for k in keys[:2000]:
        f.remove(k)
    assert all(k in f for k in keys[2000:]) and sum(k in f for k in keys[:2000]) < 40


def test_warc_round_trip(spark, folder):
    big, bom = "é" * 600, "\ufeff<p>" + "x" * 2000
    rows = [(1, "http://a/", big), (2, "http://b/ \r\nX: y", big), (3, None, big), (4, "u", None), (5, "u", ""), (6, "u", "s"), (7, "u", "s"),
            (8, "u", bom), (8, "u", bom), (None, "u", bom)]
    pages = spark.createDataFrame(rows, "page_id bigint, url string, html string").withColumns({"n": F.lit(1), "sha256": F.lit("x"), "first": F.lit(2)})
    write_archive(pages, folder + "/a")
    got = read_archive(spark, folder + "/a").collect()
    assert all(r.verified for r in got) and len(got) == len(rows)
    assert Counter((r.page_id, r.record_type, r.refers_to) for r in got) == Counter(
        [(1, "revisit", 3), (2, "revisit", 3), (3, "response", None), (4, "response", None), (5, "response", None), (6, "response", None),
         (7, "response", None), (8, "response", None), (8, "response", None), (None, "revisit", 8)])
    for r in got:
        payload = (dict((i, h) for i, _, h in rows)[r.page_id] or "").encode()
        assert bytes(r.payload) == payload and r.payload_bytes == len(payload) and r.payload_digest == hashlib.sha1(payload).hexdigest()
        head, block = bytes(r.record).split(b"\r\n\r\n", 1)
        assert head.startswith(b"WARC/1.1\r\n") and block == (b"" if r.record_type == "revisit" else payload) + b"\r\n\r\n"
        assert f"Content-Length: {len(block) - 4}".encode() in head
    assert spark.read.parquet(folder + "/a/payloads").count() == len({h or "" for _, _, h in rows})
    write_archive(pages.limit(0), folder + "/b")
    assert read_archive(spark, folder + "/b").count() == 0


def test_language_model(spark, docs):
    model = count_corpus(docs.where("doc_id % 3 > 0"))
    tokens = lambda t: [*(t or "").encode().lower().split(), b" end"]
    train = [tokens(t) for d, t in texts() if d % 3]
    c = Counter(x for t in train for x in t)
    pairs = Counter(p for t in train for p in zip(t, t[1:]))
    n, v = sum(c.values()), len(c)
    assert (model.tokens, model.types) == (n, v)

    def held(k):
        q = 0
        while k and 1.5**q <= k * (1 + 1e-9):
            q += 1
        return int(np.ceil(1.5 ** (q - 1) - 1e-9)) if q else 0

    above = total = 0.0
    for d, t, n_tokens, n_known, base, score in by_id(score_texts(docs, model).na.fill(""), "doc_id", "text", "n_tokens", "n_known", "base_score", "score"):
        x = tokens(t)
        single = [(c[w] + 0.1) / (n + 0.1 * (v + 1)) for w in x]
        p = [s if i == 0 or not c[x[i - 1]] else 0.5 * held(pairs[x[i - 1], w]) / c[x[i - 1]] + 0.5 * s for i, (w, s) in enumerate(zip(x, single))]
        assert (n_tokens, n_known) == (len(x), sum(c[w] > 0 for w in x))
        assert base == pytest.approx(np.log10(single).sum(), rel=1e-9)
        exact = np.log10(p).sum()
        assert exact - 1e-6 <= score < 0  # the filter can only find too much
        above, total = above + score - exact, total + min(len(x), 500)
    assert above < 0.1 * total
    small = docs.where("doc_id between 38 and 46 or doc_id < 8")
    joined = _joined_scores(small, model, "text").na.fill("").withColumnRenamed("score", "s2")
    one = by_id(joined, "doc_id", "n_tokens", "n_known", "base_score", "s2")
    two = by_id(_broadcast_scores(small.drop("score"), model, "text"), "doc_id", "n_tokens", "n_known", "base_score", "score")
    assert len(one) == len(two)
    assert all(a[:3] == b[:3] and a[3] == pytest.approx(b[3]) and a[4] <= b[4] + 1e-9 for a, b in zip(one, two))
    none = count_corpus(docs.limit(0))
    assert {r.base_score for r in score_texts(docs, none).collect()} == {0.0}
    assert score_texts(docs.limit(0), model).count() == 0


def test_language_model_scores_alike_at_every_size(spark):
    """Sharded filters answer like the broadcast ones, false positives included."""
    r = random.Random(11)
    rows = [(i, None if i == 5 else " ".join(f"w{int(r.paretovariate(0.6)) % 700}" for _ in range(300))) for i in range(120)]
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    model = count_corpus(df.where("doc_id % 2 = 0"))
    names = ("doc_id", "text", "n_tokens", "n_known", "base_score", "score")
    sent = by_id(_broadcast_scores(df, model, "text").na.fill(""), *names)
    for block_tokens in (1_000, 500_000):
        asked = by_id(_joined_scores(df, model, "text", block_tokens).na.fill(""), *names)
        assert [x[:4] for x in asked] == [x[:4] for x in sent]
        assert [x[4:] for x in asked] == [pytest.approx(x[4:], rel=1e-12) for x in sent]
    assert score_texts(df, model, most_bytes=0).columns == score_texts(df, model).columns


def test_suffix_dedup(spark, docs):
    rows = texts()
    data = [(d, (t or "").encode()) for d, t in rows]
    first: dict = {}
    for d, b in data:
        for i in range(len(b) - 49):
            first[b[i : i + 50]] = min(d, first.get(b[i : i + 50], d))
    want = []
    for d, b in data:
        gone = bytearray(len(b))
        for i in range(len(b) - 49):
            if first[b[i : i + 50]] < d:
                gone[i : i + 50] = b"\x01" * 50
        runs = len(bytes(gone).replace(b"\x00", b" ").split())
        want.append((d, len(b), sum(gone), runs, bytes(x for x, g in zip(b, gone) if not g)))
    got = [(*r[:4], bytes(r[4])) for r in by_id(remove_repeats(docs), "doc_id", "n_bytes", "n_removed", "n_spans", "kept")]
    assert got == sorted(want)
    assert remove_repeats(docs.limit(0)).count() == 0


def test_suffix_dedup_with_a_null_text_beside_a_repeat(spark):
    t = " ".join(WORDS)
    df = spark.createDataFrame([(1, t), (1, None), (2, t), (2, None)], "doc_id long, text string")
    assert remove_repeats(df).count() == 4


def test_language_id(spark):
    r = random.Random(6)
    own = {"aa": "the and ing tion with for her".split(), "bb": "der und keit sch ung mit ein".split(), "cc": "que de la ment aux oire pour".split()}
    made = lambda k, n: " ".join(r.choice(own[k]) + r.choice(own[k]) for _ in range(n))
    train = [(i, made(k, 40), k) for i, k in enumerate(["aa", "bb", "cc"] * 40)] + [(900, None, "aa"), (901, "x", None)]
    learned = learn_dictionaries(spark.createDataFrame(train, "doc_id bigint, text string, lang string"))
    assert set(learned) == {"aa", "bb", "cc"}
    test = [(i, made(k, 30).upper() + " !! 12", k) for i, k in enumerate(["aa", "bb", "cc"] * 20)] + [(70, made("bb", 20_000), "bb")]
    odd = [(80, None), (81, ""), (82, "123 ++"), (83, "日本")]
    df = spark.createDataFrame([(i, t) for i, t, _ in test] + odd, "doc_id bigint, text string").withColumn("score", F.lit("s"))
    got = {r.doc_id: (r.lang_pred, r.score, r.rejected) for r in identify_language(df, learned).collect()}
    assert sum(got[i][0] == k and not got[i][2] for i, _, k in test) >= 59
    assert all(0 <= s <= 1 for _, s, _ in got.values())
    assert all(got[i] == ("und", 0.0, True) for i in (80, 81, 82)) and got[83][0] in learned
    assert {r.lang_pred for r in identify_language(df, {}).collect()} == {"und"}
    assert learn_dictionaries(spark.createDataFrame([], "doc_id bigint, text string, lang string")) == {}
    assert identify_language(df.limit(0), learned).count() == 0


def test_every_label_is_learned_from_all_of_its_texts(spark):
    r = random.Random(4)
    own = {f"l{i:03}": ["".join(r.choice("abcdefghijklmnopqrstuvwxyz") for _ in range(8)) for _ in range(12)] for i in range(230)}
    rows = [(i * 4 + j, " ".join(r.choice(w) for _ in range(30)), k) for i, (k, w) in enumerate(own.items()) for j in range(2)]
    learned = learn_dictionaries(spark.createDataFrame(rows, "doc_id long, text string, lang string"), most_rows=100)
    assert learned.keys() == own.keys()
    header = "same header " * 100
    paged = spark.createDataFrame([(i, header + "eigener Rumpf " * 400, "de") for i in range(50)], "doc_id long, text string, lang string")
    assert learn_dictionaries(paged)["de"].count(b"rumpf") > 1000


def test_language_margin_does_not_shrink_with_length(spark):
    r = random.Random(8)
    make = lambda: ["".join(r.choice("abcdefghijklmnopqrstuvwxyz") for _ in range(7)) for _ in range(1500)]
    a, b = make(), make()
    draw = lambda words, n: " ".join(r.choice(words) for _ in range(n))
    learned = {"a": draw(a, 8_000).encode(), "b": draw(b, 8_000).encode()}
    df = spark.createDataFrame([(1, draw(a, 8_000)), (2, draw(a, 400_000))], "doc_id long, text string")
    short, long = by_id(identify_language(df, learned), "doc_id", "lang_pred", "score", "rejected")
    assert short[1] == long[1] == "a" and not long[3] and long[2] > short[2] / 2


def test_pipeline(spark, folder):
    import corpus_pipeline as cp

    r = random.Random(9)
    rows = [(i, t, "aa", "s", len(t or ""), 1) for i, (_, t) in enumerate(texts()[:50])]
    spark.createDataFrame(rows, "doc_id bigint, text string, lang string, source string, n_chars bigint, n_words int").write.parquet(folder + "/documents.parquet")
    spark.createDataFrame([(1, " ".join(r.choice(WORDS) for _ in range(12))), (2, "w1 w2")], "item_id bigint, text string").write.parquet(folder + "/benchmark.parquet")
    docs = spark.read.parquet(folder + "/documents.parquet")
    columns, ids = docs.columns, {x[0] for x in rows}
    for name, stage in cp.STAGES[:-1]:
        docs = stage(spark, docs, folder).cache()
        kept = {x.doc_id for x in docs.collect()}
        assert docs.columns == columns and kept <= ids, name
        ids = kept
    pieces = cp.run(spark, folder)
    assert {x.doc_id for x in pieces.collect()} == ids
