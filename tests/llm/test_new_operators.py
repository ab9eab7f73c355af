"""Line dedup, spelling variants and collocations against plain versions, on awkward rows and on empty tables."""

import hashlib
import re
import zlib
from collections import Counter, defaultdict

import pytest
from pyspark.sql import functions as F

from terrapane.llm import collocations, linededup, quality, spelling
from terrapane.llm.common import join_where_held, materialize, without_held

UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
LOWER = str.maketrans(UPPER, UPPER.lower())
SCHEMA = "doc_id long, text string, lang string, h1 int, h2 int, row int, id int, word int, n int, last int, batch int, kept int, size int, f int, part int, words int, bit int, maybe int"
EXTRA = tuple(range(15))


def frame(spark, rows, parts=3):
    return spark.createDataFrame([(*r, *EXTRA) for r in rows], SCHEMA).repartition(parts)


# --- lines -------------------------------------------------------------------------------------------------------------


def plain_lines(rows, least_docs=5):
    def key(line):
        return line.strip(" \t\n\x0b\x0c\r").translate(LOWER)

    texts = [(i, (t or "").split("\n")) for i, t, _ in rows]
    held = defaultdict(list)
    for i, lines in texts:
        for k in {key(x) for x in lines}:
            if len(k) >= linededup.LEAST_CHARS:
                held[k].append(i)
    last = {k: max((i for i in ids if i is not None), default=None) for k, ids in held.items() if len(ids) >= least_docs}
    out = []
    for i, lines in texts:
        kept = [x for x in lines if key(x) not in last or last[key(x)] == i]
        out.append((i, len(lines), len(lines) - len(kept), hashlib.sha256("\n".join(kept).encode()).hexdigest()))
    return sorted(out, key=str)


def line_rows():
    shared, accents = "This passage of forty code points or more is in many documents", "ÉCOLE " * 8 + "ß"
    rows = [(i, f"own line {i}\n{shared if i % 2 else '  ' + shared.upper() + chr(9)}\nend", "en") for i in range(7)]
    rows += [(7 + i, f"{accents}\n{accents}\n{'x' * 39}\n", None) for i in range(6)]
    rows += [(20, None, "en"), (21, "", None), (22, "\n\n", "en"), (3, rows[3][1], "en"), (None, shared, "en"), (None, shared + "\n" + "y" * 50_000, None)]
    rows += [(30 + i, "\n".join([*(f"line {j} that four documents hold, forty long" for j in range(300)), shared]), "de") for i in range(4)]
    return rows


@pytest.mark.parametrize("batches,fanout", [(1, 2), (4, 3), (5, 2)])
def test_lines_equal_a_plain_version(spark, batches, fanout):
    rows = line_rows()
    got = linededup.line_digest(linededup.with_kept_lines(frame(spark, rows), batches, fanout)).collect()
    assert sorted((tuple(r) for r in got), key=str) == plain_lines(rows)


def test_lines_keep_columns_and_empty_tables(spark):
    rows = line_rows()
    docs = frame(spark, rows)
    out = linededup.drop_repeated_lines(docs)
    assert out.columns == docs.columns and out.count() == len(rows)
    assert out.where("doc_id = 20").first().text is None
    assert linededup.drop_repeated_lines(docs.limit(0)).collect() == []
    assert linededup.with_kept_lines(docs.limit(0)).count() == 0


def test_runs_are_levelled_and_each_key_is_first_seen_once(spark):
    runs = linededup.LineRuns(spark, fanout=2)
    total = Counter()
    for b in range(5):
        rows = [(k, k, 10 * b + k % 3) for k in range(b, b + 6) for _ in range(1 + k % 2)]
        total.update(k for k, _, _ in rows)
        runs.add(spark.createDataFrame(rows, "h1 long, h2 long, doc_id long"))
    assert [level and level[2] for level in runs.levels] == [1, None, 1]  # five batches: 4 + 1
    first = [r.h1 for t in runs._tables() for r in t.where("NOT repeat").collect()]
    assert sorted(first) == sorted(total)
    plan = runs._tables()[0].join(runs._tables()[1].hint("merge"), ["h1", "h2"])._jdf.queryExecution().executedPlan().toString()
    assert "Exchange" not in plan
    assert {r.h1 for r in runs.common(3).collect()} == {k for k, n in total.items() if n >= 3}
    runs.close()


@pytest.mark.parametrize("most", [0, 1_000])
def test_rows_that_are_surely_not_held_are_not_joined(spark, most):
    rows = spark.range(5_000).select(F.col("id").alias("key"), F.lit("text").alias("text"))
    held = materialize(spark.range(0, 500, 5).select(F.col("id").alias("key"), (F.col("id") * 2).alias("more")), "held")
    got = {r.key: r.more for r in join_where_held(rows, held, "key", most).collect()}
    assert got == {i: 2 * i if i < 500 and i % 5 == 0 else None for i in range(5_000)}
    assert {r.key for r in without_held(rows, held.select("key"), "key", most).collect()} == {i for i, m in got.items() if m is None}
    none = materialize(held.where("key < 0"), "none")
    assert without_held(rows, none, "key", most).count() == 5_000


# --- spelling ----------------------------------------------------------------------------------------------------------


def plain_counts(rows, damage=spelling.DAMAGE):
    n = Counter()
    for i, text, _ in rows:
        for run in re.findall("[A-Za-zÀ-ÿ]+", text or ""):
            run = run.translate(LOWER)
            h = zlib.crc32(f"{'' if i is None else i}:{run}".encode())
            word = run if h % damage else run[: h % len(run)] + run[h % len(run) + 1 :]
            n[word] += len(word) >= 5
    return {w: c for w, c in n.items() if c >= 3}


def one_edit(a, b):
    if len(a) > len(b):
        a, b = b, a
    if len(a) == len(b):
        return sum(x != y for x, y in zip(a, b, strict=True)) == 1
    return len(b) == len(a) + 1 and any(b[:i] + b[i + 1 :] == a for i in range(len(b)))


def plain_variants(n):
    near = {w: [o for o in n if o != w and abs(len(o) - len(w)) < 2 and one_edit(w, o)] for w in n}
    form = {}
    for w, others in near.items():
        best = min(others, key=lambda o: (-n[o], o), default=None)
        form[w] = best if best and n[best] >= 2 * n[w] else None
    out = []
    for w in n:
        root = w
        while form[root]:
            root = form[root]
        out.append((w, form[w], root, n[w], len(near[w]), form[w] and n[form[w]]))
    return sorted(out)


def words_of(spark, n):
    return spark.createDataFrame(list(n.items()), "word string, n long")


@pytest.mark.parametrize("block", [2, 1_000])
def test_spellings_equal_a_plain_version(spark, sf, block):
    rows = [(r.doc_id, r.text, None) for r in spark.read.parquet(f"{sf}/documents.parquet").where("doc_id < 60").collect()]
    n = plain_counts(rows)
    docs = frame(spark, rows)
    assert {r.word: r.n for r in spelling.word_counts(docs).collect()} == n
    assert sorted((tuple(r) for r in spelling.variants(words_of(spark, n), block).collect()), key=lambda r: r[0]) == plain_variants(n)


def test_every_single_edit_is_found(spark):
    n = Counter()
    for word in ("abcde", "éèàüß", "aaaaa", "abababa", "abcdefgh"):
        n[word] = 40
        for i in range(len(word) + 1):
            n[word[:i] + "z" + word[i:]] += 3
            n[word[:i] + "z" + word[i + 1 :]] += 3
            n[word[:i] + word[i + 1 :]] += 3
    assert sorted((tuple(r) for r in spelling.variants(words_of(spark, n)).collect()), key=lambda r: r[0]) == plain_variants(n)


def test_chains_of_forms_end_at_the_last(spark):
    n = {"a" * i + "bbbbb": 4 * 3**i for i in range(9)}
    got = {r.word: r.root for r in spelling.variants(words_of(spark, n)).collect()}
    assert set(got.values()) == {"a" * 8 + "bbbbb"}


def test_spellings_of_awkward_rows(spark):
    rows = [(None, "ŒUVRE Œuvre façade FAÇADE façade fabade fabade fabade"), (1, None), (1, ""), (2, "hello-hello hello x" * 3), (2, "Ünder ÷×÷×÷ ÷×÷×÷ ÷×÷×÷ ünder"), (3, "word" * 30_000)]
    rows = [(*r, None) for r in rows]
    got = sorted((tuple(r) for r in spelling.group_spellings(frame(spark, rows)).collect()), key=lambda r: r[0])
    assert got == plain_variants(plain_counts(rows)) and got
    assert spelling.group_spellings(frame(spark, rows).limit(0)).collect() == []


# --- collocations ------------------------------------------------------------------------------------------------------


def plain_phrases(rows, least, top=2_000):
    f, n = defaultdict(Counter), Counter()
    for _, text, lang in rows:
        lang = "und" if lang is None else lang
        for piece in re.split("[.,;:!?\x0a-\x0d]", (text or "").translate(LOWER)):
            words = re.findall("[^\x20\x09]+", piece)
            n[lang] += len(words)
            for i in range(len(words)):
                for k in range(1, 6):
                    if i + k <= len(words):
                        f[lang][tuple(words[i : i + k])] += 1
    out = []
    for lang, counts in f.items():
        found = []
        for p, a in counts.items():
            if len(p) < 2 or a < least:
                continue
            score, _, left, right = min((1000 * a * n[lang] // (counts[p[:k]] * counts[p[k:]]), k, counts[p[:k]], counts[p[k:]]) for k in range(1, len(p)))
            found.append((p, a, left, right, n[lang], score))
        inside = {(q[i : i + k], a) for q, a, *_ in found for k in range(2, len(q)) for i in range(len(q) - k + 1)}
        found = sorted((r for r in found if (r[0], r[1]) not in inside), key=lambda r: (-r[5], -r[1], " ".join(r[0]).encode()))
        out += [(lang, i + 1, " ".join(p), *rest) for i, (p, *rest) in enumerate(found[:top])]
    return sorted(out)


def test_collocations_equal_a_plain_version(spark, sf):
    rows = [(r.doc_id, r.text, r.lang) for r in spark.read.parquet(f"{sf}/documents.parquet").collect()]
    got = collocations.collocations(frame(spark, rows), least=20)
    assert sorted(tuple(r) for r in got.collect()) == plain_phrases(rows, 20)


@pytest.mark.parametrize("stretch,window_range", [(7, 5), (50, 40), (1_000, 10_000)])
def test_ranges_and_stretches_do_not_change_counts(spark, stretch, window_range):
    text = "the cat sat, the cat sat on the mat; THE\tcat  sat on a mat. on on on on on on on"
    rows = [(1, text, "en"), (1, text, "en"), (2, "on the mat the cat sat on the", None), (None, None, "en"), (3, "", None), (4, "a\x00b a\x00 b é É é É x y", "en"), (5, text.replace(" ", "  "), "und")]
    counts = collocations.phrase_counts(frame(spark, rows), 2, window_range, stretch)
    got = {(r.lang, tuple(r.words)): r.f for r in counts.collect()}
    f, n = defaultdict(int), Counter()
    for _, t, lang in rows:
        lang = lang or "und"
        for piece in re.split("[.,;:!?\x0a-\x0d]", (t or "").translate(LOWER)):
            words = re.findall("[^\x20\x09]+", piece)
            n[lang] += len(words)
            for i in range(len(words)):
                for k in range(1, min(5, len(words) - i) + 1):
                    f[lang, tuple(words[i : i + k])] += 1
    assert got == {k: v for k, v in f.items() if v >= 2} | {(lang, ()): c for lang, c in n.items()}
    spark.conf.set("spark.sql.shuffle.partitions", "3")
    try:
        got = sorted(tuple(r) for r in collocations.collocations(frame(spark, rows), 2).collect())
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", "8")
    assert got == plain_phrases(rows, 2)


def test_streams_know_their_open_parts_across_ranges(spark):
    phrases = {("a",) * k: 100 - k for k in range(6)} | {("a", "b", str(i)): 5 for i in range(40)} | {("a", "b"): 60, ("b",): 9, (): 500}
    counts = materialize(spark.createDataFrame([("x", list(p), c) for p, c in phrases.items()], "lang string, words array<string>, f long"), "counts")
    got = {tuple(r.words): r.parts for r in collocations.stream_parts(counts).collect()}
    assert got == {p: [phrases[p[:i]] for i in range(len(p))] for p in phrases}


def test_scores_are_exact_beyond_64_bits(spark):
    rows = [(3 * 10**12 + 7, 9 * 10**14 + 1, 3 * 10**12 + 11, 5 * 10**12 + 3), (100, 10**13, 100, 100), (2, 7, 3, 5)]
    df = spark.createDataFrame(rows, "a long, n long, l long, r long")
    got = [r[0] for r in df.select(collocations.exact_score(F.col("a"), F.col("n"), F.col("l"), F.col("r"))).collect()]
    assert got == [1000 * a * n // (x * y) for a, n, x, y in rows]


def test_no_texts_no_phrases(spark):
    assert collocations.collocations(frame(spark, [(1, "a b", "en")]).limit(0)).collect() == []
    assert collocations.collocations(frame(spark, [(1, None, None), (2, "", "en")])).collect() == []


# --- quality fences ------------------------------------------------------------------------------------------------------


def test_fences_move_smoothly_with_a_group(spark):
    """Groups of 1 to 400 equal documents: fences change by less than a hundredth of the gap for a document more, and reach the group's own."""
    high = {}
    for n in (1, 50, 99, 100, 101, 400):
        rows = [("en", "small", "symbols", 10, n)] + [("en", "large", "symbols", b, 1_000) for b in (0, 40, 90)]
        sketch = spark.createDataFrame(rows, "lang string, source string, metric string, bin long, n long")
        high[n] = {r.source: r.high_symbols for r in quality.thresholds(sketch).collect()}["small"]
    own, lang = 10 + 20, 90 + 3 * 50 + 20
    assert all(abs(h - (n * own + quality.PRIOR * lang) / (n + quality.PRIOR)) < 5 for n, h in high.items())
    assert abs(high[99] - high[100]) < 0.01 * (lang - own) > abs(high[100] - high[101])
