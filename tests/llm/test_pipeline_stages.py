"""Every stage of the pipeline against plain Python on one small table with planted copies, lines and passages."""

import os
import random
import re
import sys

import pytest

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.dirname(os.path.abspath(__file__)))))

import corpus_pipeline as cp
from veilspark.llm.language_id import learn_dictionaries, plain
from veilspark.llm.queries import learning_rows, tokenizer_file

STEMS = {"en": "the and ing tion with for her ough".split(), "de": "der und keit sch ung mit ein lich".split(), "fr": "que de la ment aux oire pour eau".split()}
COLUMNS = ["doc_id", "text", "lang", "source", "n_chars", "score", "_class0", "n_dropped"]


def words(r, lang, n):
    return [r.choice(STEMS[lang]) + r.choice(STEMS[lang]) + r.choice(STEMS[lang]) for _ in range(n)]


def rows_of_documents():
    r = random.Random(21)
    shared = " ".join(words(r, "en", 9)) + " is a line that many documents share"
    passage = " ".join(words(r, "de", 14))
    out, base = [], None
    for i in range(90):
        lang = ("en", "de", "fr")[i % 3]
        own = words(r, lang, 60)
        if i % 9 == 4:
            own = list(base)
            own[r.randrange(60)] = "changed"
        elif i % 9 == 1:
            base = own
        text = " ".join(own[:30]) + "\n" + " ".join(own[30:])
        if i % 4 == 0:
            text = shared.upper() + " \n" + text
        if i % 13 == 6:
            text += " " + passage
        out.append((i, text, lang))
    again = out[10][1]
    out += [(10, again, "de"), (10, " ".join(words(r, "en", 40)), "en"), (None, again, "de"), (None, " ".join(words(r, "fr", 50)), "fr"), (None, out[7][1], None),
            (200, None, "en"), (201, "", "en"), (202, "12 34", "de"), (203, again.upper(), "de")]
    r.shuffle(out)
    return [(d, t, k, "src", len(t or ""), "s", d, "x") for d, t, k in out], passage


@pytest.fixture(scope="module")
def corpus(spark, tmp_path_factory):
    folder = str(tmp_path_factory.mktemp("corpus"))
    rows, passage = rows_of_documents()
    spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long, score string, _class0 long, n_dropped string").repartition(
        3).write.parquet(f"{folder}/documents.parquet")
    spark.createDataFrame([(1, passage), (2, "never found anywhere"), (3, None)], "item_id long, text string").write.parquet(f"{folder}/benchmark.parquet")
    return folder


def ordered(rows):
    return sorted(rows, key=repr)


def by_language(spark, rows, docs):
    import zstandard

    learned = learn_dictionaries(learning_rows(docs, 4, 2))
    models = []
    for k, data in learned.items():
        d = zstandard.ZstdCompressionDict(data, dict_type=zstandard.DICT_TYPE_RAWCONTENT)
        models.append((k, zstandard.ZstdCompressor(level=3, dict_data=d, write_content_size=False, write_dict_id=False)))
    kept = []
    for row in rows:
        if row[1] and re.search(r"[^\W\d_]", row[1]):
            sizes = sorted(len(c.compress(plain(row[1]))) for _, c in models)
            if (sizes[1] - sizes[0]) / sizes[1] > 0.002:
                kept.append(row)
    return kept


def by_lines(rows):
    key = lambda x: x.strip(" \t\n\x0b\x0c\r").translate({c: c + 32 for c in range(65, 91)})
    holders: dict = {}
    for d, t, *_ in rows:
        for x in (t or "").split("\n"):
            if d is not None and len(key(x)) >= 40:
                holders.setdefault(key(x), set()).add(d)
    out = []
    for d, t, lang, source, n, *rest in rows:
        lines = (t or "").split("\n")
        kept = [x for x in lines if d is None or len(holders.get(key(x), ())) < 5 or d == max(holders[key(x)])]
        text = "\n".join(kept)
        out.append((d, text, lang, source, len(text) if len(kept) < len(lines) else n, *rest))
    return out


def shingles(text):
    w = (text or "").lower().split()
    return frozenset(tuple(w[i : i + 5]) for i in range(len(w) - 4)) if len(w) >= 5 else frozenset([tuple(w)] if w else [])


def by_groups(rows):
    sets = [shingles(row[1]) for row in rows]
    root = list(range(len(rows)))

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for i in range(len(rows)):
        for j in range(i):
            if sets[i] and sets[j] and 100 * len(sets[i] & sets[j]) >= 75 * len(sets[i] | sets[j]):
                root[find(i)] = find(j)
    groups: dict = {}
    for i, row in enumerate(rows):
        groups.setdefault(find(i), []).append(row)
    return [min(g, key=lambda row: (row[0] is None, row[0] or 0)) for g in groups.values()]


def without_passage(rows, passage):
    find = lambda t: re.findall("[^\x00-\x2f\x3a-\x60\x7b-\x7f]+", t.lower())
    p = find(passage)
    windows = {tuple(p[i : i + 10]) for i in range(len(p) - 9)} | {tuple(find("never found anywhere"))}
    found = lambda w: any(tuple(w[i : i + n]) in windows for n in (3, 10) for i in range(len(w) - n + 1))
    return [row for row in rows if not found(find(row[1] or ""))]


def test_every_stage(spark, corpus):
    docs = spark.read.parquet(f"{corpus}/documents.parquet")
    rows, passage = rows_of_documents()
    for name, stage in cp.STAGES[:-1]:
        out = stage(spark, docs, corpus)
        assert out.columns == COLUMNS
        got = [tuple(x) for x in out.collect()]
        if name == "language_id":
            want = by_language(spark, rows, docs)
            assert {d for d, *_ in rows} - {d for d, *_ in want} <= {200, 201, 202}
        elif name == "line_dedup":
            want = by_lines(rows)
            assert sum(len(a[1]) for a in want) < sum(len(a[1]) for a in rows)
        elif name == "ngram_join":
            want = by_groups(rows)
            texts = [t for d, t, *_ in want if d == 10]
            assert len(texts) == 2 and len(want) < len(rows) and None in {row[0] for row in want}
        else:
            want = without_passage(rows, passage)
            assert 0 < len(want) < len(rows)
        if name == "ngram_join":  # of rows with the same id and shingles any one may stay
            got, want = ([(d, shingles(t)) for d, t, *_ in x] for x in (got, want))
            assert ordered((d, sorted(s)) for d, s in got) == ordered((d, sorted(s)) for d, s in want)
            rows = [tuple(x) for x in out.collect()]
        else:
            assert ordered(got) == ordered(want)
            rows = want
        docs = out.cache()
    pieces = cp.STAGES[-1][1](spark, docs, corpus).collect()
    from tokenizers import Tokenizer

    tokenizer = Tokenizer.from_file(tokenizer_file())
    sizes = sorted(((row[0], len(tokenizer.encode(row[1], add_special_tokens=False).ids) + 1) for row in rows), key=repr)
    assert sorted({(p.doc_id, p.doc_tokens) for p in pieces}, key=repr) == sorted(set(sizes), key=repr)
    assert sum(p.length for p in pieces) == sum(n for _, n in sizes)


def test_stages_on_an_empty_table(spark, corpus):
    docs = spark.read.parquet(f"{corpus}/documents.parquet").limit(0)
    for _, stage in cp.STAGES[:-1]:
        out = stage(spark, docs, corpus)
        assert out.columns == COLUMNS and out.count() == 0
    assert cp.STAGES[-1][1](spark, docs, corpus).count() == 0
