"""Operators that compare texts: against brute force."""

import collections
import functools
import hashlib
import math
import random
import re
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from streamloom.llm import cdc, components, knn, neardup, ppm, substrings

DATA = "/root/testdata/sf0.001"
WORD = re.compile(r"[^\x20\x09-\x0D]+")
LOWER = {c: c + 32 for c in range(65, 91)}
ODD = [(1, "a b c d e f g", 0), (2, "A b\tc d e f g", 0), (3, None, 0), (4, "", 0), (5, "  \n", 0), (6, "one", 0), (7, "one", 0), (7, "one", 0), (None, "a b c d e f g", 0), (9, "word " * 20000, 1)]


def tokens(text):
    return WORD.findall((text or "").translate(LOWER))


@pytest.fixture(scope="module")
def odd(spark):
    return spark.createDataFrame(ODD, "doc_id long, text string, n int")


@pytest.fixture(scope="module")
def docs(spark):
    return spark.read.parquet(f"{DATA}/documents.parquet")


def groups(rows, width, percent):
    sets = {}
    for i, t in rows:
        w = tokens(t)
        sets[i] = {tuple(w[k : k + width]) for k in range(len(w) - width + 1)} if len(w) >= width else ({tuple(w)} if w else set())
    up = {i: i for i in sets}

    def top(x):
        while up[x] != x:
            x = up[x]
        return x

    ids = sorted(sets)
    for a in ids:
        for b in ids:
            if a < b and sets[a] and sets[b]:
                both = len(sets[a] & sets[b])
                if 100 * both >= percent * (len(sets[a]) + len(sets[b]) - both):
                    x, y = top(a), top(b)
                    up[max(x, y)] = min(x, y)
    return {i: (len(sets[i]), top(i)) for i in ids}


@pytest.mark.parametrize(("width", "percent"), [(3, 85), (5, 80)])
def test_near_duplicates_are_brute_force(spark, docs, width, percent):
    rows = [(r.doc_id, r.text) for r in docs.collect()]
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in neardup.near_duplicates(docs, width, percent).collect()}
    assert got == groups(rows, width, percent)


def test_near_duplicates_in_a_large_family(spark):
    rng = random.Random(2)
    base = [f"w{i}" for i in range(150)]
    rows = [(0, " ".join(base))]
    for i in range(1, 220):
        copy = list(base)
        for _ in range(rng.randrange(12)):
            copy[rng.randrange(len(copy))] = f"x{rng.randrange(40)}"
        rows.append((i, " ".join(copy)))
    df = spark.createDataFrame(rows, "doc_id long, text string")
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in neardup.near_duplicates(df, 3, 85).collect()}
    assert got == groups(rows, 3, 85)


def blocks_removed(m):
    """A text of 400 words, and copies that each lack six blocks of twelve."""
    rng = random.Random(m)
    base = [f"w{i}" for i in range(400)]
    rows = [(0, " ".join(base))]
    for i in range(1, m):
        gone = {k + j for k in (rng.randrange(388) for _ in range(6)) for j in range(12)}
        rows.append((i, " ".join(w for k, w in enumerate(base) if k not in gone)))
    return rows


def test_near_duplicates_verify_few_pairs_of_a_loose_family(spark, monkeypatch):
    seen, check = [], neardup.verified
    monkeypatch.setattr(neardup, "verified", lambda pairs, *more: (seen.append(pairs.count()), check(pairs, *more))[1])
    for m in (100, 300):
        seen.clear()
        rows = blocks_removed(m)
        got = {r.doc_id: (r.n_shingles, r.component_id) for r in neardup.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string"), 3, 85).collect()}
        assert got == groups(rows, 3, 85)
        assert sum(seen) < 24 * m  # of m * (m - 1) / 2


def test_near_duplicates_verify_few_pairs_just_below_the_threshold(spark, monkeypatch):
    rng, seen, check = random.Random(5), [], neardup.verified
    monkeypatch.setattr(neardup, "verified", lambda pairs, *more: (seen.append(pairs.count()), check(pairs, *more))[1])
    base, rows = [f"w{i}" for i in range(400)], []
    for i in range(150):  # most pairs are alike by 0.81 to 0.83
        copy = list(base)
        for j in range(7):
            copy[57 * j + rng.randrange(54)] = f"x{i}y{j}"
        rows.append((i, " ".join(copy)))
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in neardup.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string"), 3, 85).collect()}
    assert got == groups(rows, 3, 85)
    assert sum(seen) < 24 * len(rows)  # of 75 for each


def test_sketches_of_linked_sets_are_alike(spark):
    rng = np.random.Generator(np.random.PCG64(3))
    for n, percent in ((40, 85), (400, 85), (400, 80), (3000, 85), (neardup.LARGE, 85), (neardup.LARGE + 1, 85), (20_000, 85), (20_000, 99)):
        more = min(n * 100 // percent, n + n // 20)  # the other set is larger
        both = -(-percent * (n + more) // (100 + percent))
        level = neardup.levels(more, percent)[0]
        assert level in neardup.levels(n, percent)
        limit = spark.range(1).select(neardup.alike(F.lit(n + more), F.lit(level), percent)).first()[0]
        for _ in range(20):
            x = rng.integers(0, 1 << 63, n + more - both, dtype=np.uint64)
            differ = neardup.sketch(x[:n], level) ^ neardup.sketch(x[n - both :], level)
            assert np.unpackbits(differ.view(np.uint8)).sum() <= limit


def test_bands_miss_few():
    for percent in (50, 80, 85, 95, 100):
        for rows in (neardup.ROWS, neardup.long_rows(percent)):
            assert (1 - (percent / 100) ** rows) ** neardup.bands_for(rows, percent) <= neardup.MISS


def test_one_of_each_by_row(spark):
    words = lambda a, n=40: " ".join(f"w{a}x{i}" for i in range(n))
    rows = [(3, words(1)), (8, words(1)), (8, words(2)), (7, words(3)), (7, words(3)), (None, words(4)), (None, words(4)), (None, words(1)), (9, words(4)), (5, None), (5, None), (6, ""), (None, None), (4, "short one"), (2, "Short ONE")]
    df = spark.createDataFrame([(*r, i, 0.5) for i, r in enumerate(rows)], "doc_id long, text string, row int, kept double").repartition(4)
    got = neardup.one_of_each(df, 5, 80)
    assert got.columns == df.columns
    key = lambda r: (str(r[0]), str(r[1]))
    assert sorted(((r.doc_id, r.text) for r in got.collect()), key=key) == sorted([(3, words(1)), (8, words(2)), (7, words(3)), (9, words(4)), (5, None), (5, None), (6, ""), (None, None), (2, "Short ONE")], key=key)
    assert neardup.one_of_each(df.limit(0)).count() == 0


def test_near_duplicates_odd(spark, odd):
    got = sorted((str(r.doc_id), r.n_shingles, r.component_id, r.kept) for r in neardup.near_duplicates(odd, 3, 85).collect())
    assert got == sorted([("1", 5, 1, True), ("2", 5, 1, False), ("3", 0, 3, True), ("4", 0, 4, True), ("5", 0, 5, True), ("6", 1, 6, True), ("7", 1, 6, False), ("7", 1, 6, False), ("None", 5, None, True), ("9", 1, 9, True)])
    assert neardup.near_duplicates(odd.limit(0), 3, 85).count() == 0
    # two texts under one doc_id: each has its own links
    rows = [(1, "a b c d e f g h"), (1, "p q r s t u v w"), (2, "p q r s t u v w"), (3, "a b c d e f g h")]
    got = neardup.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string"), 3, 85).collect()
    assert sorted((r.doc_id, r.component_id) for r in got) == [(1, 1), (1, 1), (2, 1), (3, 1)]


def test_components(spark):
    edges = [(i, i + 1) for i in range(40)] + [(100, 200), (200, 100), (300, 300), (500, 7)]
    got = {r.id: r.component for r in components.components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert got == {**{i: 0 for i in range(41)}, 500: 0, 100: 100, 200: 100}


def symbols(text):
    return [32, *" ".join(tokens(text)).encode(), ppm.END]


def brute_ppm(rows, held):
    """Textbook PPM-D: a dictionary of contexts, escapes and exclusion by sets."""
    trie = collections.defaultdict(collections.Counter)
    for i, t in rows.items():
        s = symbols(t)
        for k in range(1, len(s) if not held[i] else 0):
            for j in range(min(k, ppm.ORDER) + 1):
                trie[tuple(s[k - j : k])][s[k]] += 1

    @functools.cache
    def log(context, symbol):
        gone, out = set(), 0.0
        for j in range(len(context) + 1):
            seen = trie.get(context[j:])
            if seen is None:
                continue
            total, distinct = sum(x for s, x in seen.items() if s not in gone), sum(s not in gone for s in seen)
            if symbol in seen:
                return out + math.log10((seen[symbol] - 0.5) / total)
            out += math.log10(0.5 * distinct / total) if distinct else 0.0
            gone = set(seen)
        return out - math.log10(max(1, ppm.SYMBOLS - len(trie.get((), ()))))

    def score(text):
        s = symbols(text)
        return sum(log(tuple(s[max(0, k - ppm.ORDER) : k]), s[k]) for k in range(1, len(s)))

    return score


def check_ppm(got, rows):
    held = {i: zlib.crc32(str("" if i is None else i).encode()) % 5 == 1 for i in rows}
    lists = {i: [*tokens(t), ""] for i, t in rows.items()}
    c = collections.Counter(w for i in rows if not held[i] for w in lists[i])
    n, v = sum(c.values()), len(c)
    score = brute_ppm(rows, held)
    assert len(got) == len(rows)
    for r in got:
        w = lists[r.doc_id]
        assert (r.held_out, r.n_tokens, r.n_known, r.train_tokens) == (held[r.doc_id], len(w), sum(c[x] > 0 for x in w), n)
        assert r.base_score == pytest.approx(sum(math.log10((c[x] + 0.5) / (n + 0.5 * (v + 1))) for x in w), rel=1e-9)
        assert r.score == pytest.approx(score(rows[r.doc_id]), rel=1e-9)


def test_ppm_is_brute_force(spark, docs, monkeypatch):
    monkeypatch.setattr(ppm, "CHUNK_BYTES", 100_000)
    monkeypatch.setattr(ppm, "GRAMS", 9_000)
    monkeypatch.setattr(ppm, "HELD_SYMBOLS", 1_000)
    check_ppm(ppm.score_documents(docs).collect(), {r.doc_id: r.text for r in docs.collect()})


def test_ppm_pieces():
    rng = np.random.default_rng(3)
    texts = [bytes(rng.integers(97, 101, n).astype(np.uint8)) for n in (0, 1, 2, 7, 300)]
    data, offs = np.frombuffer(b"".join(texts), np.uint8), np.append(0, np.cumsum([len(t) for t in texts]))
    text, at = ppm.running(data, *ppm.words(data, offs))
    whole = [x.tolist() for x in next(ppm.grams(text, at))]
    size, ppm.PIECE = ppm.PIECE, 3
    try:
        parts = list(ppm.grams(text, at))
    finally:
        ppm.PIECE = size
    assert [np.concatenate(x).tolist() for x in zip(*parts)] == whole


def test_ppm_beats_the_word_model_on_held_out_texts(spark):
    """The base gives every unknown word the mass of one, which favours it where most words are new; from some 25 MB on the trie is ahead."""
    got = ppm.score_documents(spark.read.parquet("/root/testdata/sf0.1/documents.parquet")).where("held_out")
    r = got.agg(F.sum("score").alias("a"), F.sum("base_score").alias("b")).first()
    assert r.a > r.b


def test_ppm_odd(spark):
    rows = {1: "a b c a b", 2: "A b\tc", 3: None, 4: "", 5: "  \n", 6: "one", 7: "caf\u00e9 caf\u00e9", 8: "zzz unseen", 9: "word " * 20000, None: "a b c"}
    df = spark.createDataFrame([(i, t, 0, 1.5) for i, t in rows.items()], "doc_id long, text string, key int, score double")
    check_ppm(ppm.score_documents(df).collect(), rows)
    twice = ppm.score_documents(df.union(df)).collect()
    assert len(twice) == 2 * len(rows) and len({(r.doc_id, r.score) for r in twice}) == len(rows)
    assert ppm.score_documents(df.limit(0)).count() == 0
    alone = spark.createDataFrame([(i, "abc") for i in range(200) if zlib.crc32(str(i).encode()) % 5 == 1], "doc_id long, text string")
    assert {round(r.score, 9) for r in ppm.score_documents(alone).collect()} == {round(-4 * math.log10(ppm.SYMBOLS), 9)}


def brute_removal(rows):
    seen, out = set(), {}
    for i, t in sorted(rows):
        b = (t or "").encode()
        edge = np.zeros(len(b) + 1, int)
        for p in range(len(b) - 99):
            w = b[p : p + 100]
            if w in seen:
                edge[p] += 1
                edge[p + 100] -= 1
            else:
                seen.add(w)
        mark = np.cumsum(edge)[:-1] > 0
        starts = int((np.diff(np.concatenate([[0], mark.astype(int)])) == 1).sum())
        out[i] = (len(b), int(mark.sum()), starts, hashlib.sha256(bytes(np.frombuffer(b, np.uint8)[~mark])).hexdigest())
    return out


@pytest.mark.parametrize("most", [6_000, 3])
def test_substrings_are_brute_force(spark, docs, monkeypatch, most):
    monkeypatch.setattr(substrings, "MOST", most)
    monkeypatch.setattr(substrings, "CHUNK_BYTES", 100_000)
    rows = [(r.doc_id, r.text) for r in docs.collect()]
    got = {r.doc_id: (r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256) for r in substrings.remove_repeats(docs.repartition(4)).collect()}
    assert got == brute_removal(rows)


def test_substrings_inside_one_text(spark):
    rows = [(1, "ab" * 300), (2, "x" * 99), (3, "x" * 100), (4, "é" * 80 + "q" * 120 + "é" * 80), (5, None), (6, ""), (7, "q" * 130)]
    df = spark.createDataFrame([(*r, 1) for r in rows], "doc_id long, text string, n_bytes int")
    got = {r.doc_id: (r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256) for r in substrings.remove_repeats(df).collect()}
    assert got == brute_removal(rows)
    assert substrings.remove_repeats(df.limit(0)).count() == 0


@pytest.mark.parametrize("most", [6_000, 3])
def test_substrings_in_rows_that_repeat_a_doc_id(spark, monkeypatch, most):
    monkeypatch.setattr(substrings, "MOST", most)
    monkeypatch.setattr(substrings, "CHUNK_BYTES", 1_000)
    rng = random.Random(12)
    prose = lambda n: "".join(rng.choice("abcdefghij ") for _ in range(n))
    one, two, three, four, shared = (prose(n) for n in (300, 250, 400, 260, 150))
    rows = [(1, one), (1, one), (1, two + shared), (1, shared + three), (2, one), (2, four), (2, two + prose(130)), (3, shared + shared), (3, shared + shared), (3, prose(120))]
    rows += [(None, four), (None, prose(500) + shared), (None, prose(110)), (None, four), (4, one[:120]), (4, "x" * 240), (4, "x" * 240), (5, "y" + shared)]

    def left(i, text):
        b = text.encode()
        before = [t.encode() for j, t in rows if least(j) < least(i)]
        mark = np.zeros(len(b), bool)
        for p in range(len(b) - 99):
            w = b[p : p + 100]
            if b.find(w) < p or any(w in t for t in before):
                mark[p : p + 100] = True
        return (i, len(b), int(mark.sum()), bytes(np.frombuffer(b, np.uint8)[~mark]))

    rows.append((-(2**63), prose(120)))
    least = lambda i: -(2**63) if i is None else i
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(4)
    got = [(r.doc_id, r.n_bytes, r.n_removed, bytes(r.kept)) for r in substrings.remove_repeats(df, texts=True).collect()]
    key = lambda r: (str(r[0]), r[1:])
    assert sorted(got, key=key) == sorted((left(*r) for r in rows), key=key)


def test_a_text_over_sixteen_megabytes(spark):
    rng = np.random.default_rng(5)
    part = bytes(rng.integers(97, 123, 1 << 20).astype(np.uint8)).decode()
    rows = [(2, "".join(part[i * 1000 :] + part[: i * 1000] for i in range(17))), (1, part[5000:5300])]
    got = {r.doc_id: (r.n_bytes, r.n_removed, r.n_spans) for r in substrings.remove_repeats(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    # all but the first turn of the part, in which document 1 stands; the turn's own seam is new
    assert got[1] == (300, 0, 0) and got[2][0] == 17 << 20 and got[2][1] >= 16 << 20


def test_long_text_in_pieces(monkeypatch):
    data = np.random.default_rng(1).integers(97, 100, 5000).astype(np.uint8)
    whole = substrings.stretches(data, np.array([0, 5000]))
    assert whole[2].sum() == 4901 and (np.diff(whole[1]) == whole[2][:-1]).all()


def brute_chunks(rows):
    seen, out = set(), {}
    for i, t in sorted(rows):
        b = np.frombuffer((t or "").encode(), np.uint8)
        spans, a = [], 0
        for e in cdc.chunk_ends(b, np.array([0, len(b)]))[0].tolist():
            k = b[a:e].tobytes()
            if k in seen:
                if spans and spans[-1][1] == a:
                    spans[-1][1] = e
                else:
                    spans.append([a, e])
            seen.add(k)
            a = e
        out[i] = ",".join(f"{a}:{e}" for a, e in spans if e - a >= cdc.RUN)
    return out


def test_chunks_are_brute_force(spark, docs):
    rows = [(r.doc_id, r.text) for r in docs.collect()]
    got = cdc.deduplicate(docs).collect()
    assert {r.doc_id: r.spans for r in got} == brute_chunks(rows)
    kept = {r.doc_id: r.kept for r in cdc.cleaned(docs).collect()}
    assert all(len(kept[r.doc_id]) == r.n_bytes - r.n_removed for r in got)


def test_short_copies_and_single_chunks_are_repeats(spark):
    rng = random.Random(6)
    prose = lambda n: "".join(rng.choice("abcdefghij ") for _ in range(n))
    short, tiny, long = prose(60), "Hi.", prose(400)
    a = int(cdc.chunk_ends(np.frombuffer(long.encode(), np.uint8), np.array([0, 400]))[0][0])
    rows = [(1, short), (2, tiny), (3, long), (4, short), (5, tiny), (6, long[:a] + prose(300)), (7, short)]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    got = {r.doc_id: (r.has_repeat, r.n_removed, r.spans) for r in cdc.deduplicate(df).collect()}
    none = (False, 0, "")
    assert a < 96 and got == {1: none, 2: none, 3: none, 4: (True, 60, "0:60"), 5: (True, 3, "0:3"), 6: (True, a, f"0:{a}"), 7: (True, 60, "0:60")}
    kept = {r.doc_id: r.kept for r in cdc.cleaned(df).collect()}
    assert kept[4] == kept[5] == kept[7] == b"" and kept[6] == rows[5][1][a:].encode()


def test_chunks_survive_an_insertion():
    rng = random.Random(4)
    text = "".join(rng.choice("abcdefgh ") for _ in range(6000)).encode()

    def cut(b):
        ends = cdc.chunk_ends(np.frombuffer(b, np.uint8), np.array([0, len(b)]))[0].tolist()
        return {b[s:e] for s, e in zip([0, *ends], ends)}

    a, b = cut(text), cut(text[:3000] + b"inserted" + text[3000:])
    assert len(a - b) < 6


def test_chunks_in_rows_that_repeat_a_doc_id(spark):
    rng = random.Random(8)
    prose = lambda n: "".join(rng.choice("abcdefghij ") for _ in range(n))
    one, two, shared = prose(300), prose(250), prose(200)
    rows = [(1, one), (1, one), (1, two + shared), (2, one), (2, shared + two), (None, shared), (None, shared), (None, prose(90)), (3, None), (4, ""), (5, two * 3), (-(2**63), two)]
    seen, want = [], []
    for i, t in sorted(rows, key=lambda r: -(2**63) if r[0] is None else r[0]):
        b = np.frombuffer((t or "").encode(), np.uint8)
        cuts = [0, *cdc.chunk_ends(b, np.array([0, len(b)]))[0].tolist()]
        own, spans, key = set(), [], -(2**63) if i is None else i
        for a, e in zip(cuts, cuts[1:]):
            k = b[a:e].tobytes()
            if k in own or any(k == c and j < key for j, c in seen):
                spans = [*spans[:-1], (spans[-1][0], e)] if spans and spans[-1][1] == a else [*spans, (a, e)]
            own.add(k)
        seen += [(key, k) for k in own]
        want.append((str(i), len(b), sum(e - a for a, e in spans), ",".join(f"{a}:{e}" for a, e in spans)))
    df = spark.createDataFrame([(*r, 1) for r in rows], "doc_id long, text string, n_bytes int").repartition(3)
    assert sorted((str(r.doc_id), r.n_bytes, r.n_removed, r.spans) for r in cdc.deduplicate(df).collect()) == sorted(want)
    assert cdc.deduplicate(df.limit(0)).count() == 0


def brute_top(rows, k=10, every=100):
    rows = [(i, [math.floor(1024 * x) for x in v]) for i, v in rows if i is not None and v is not None and all(x is not None and math.isfinite(x) for x in v)]
    out = []
    for i, q in rows:
        if i % every == 0:
            best = sorted((-sum(a * b for a, b in zip(q, v)), j) for j, v in rows if j != i and len(v) == len(q))[:k]
            out += [(i, n + 1, j, -s) for n, (s, j) in enumerate(best)]
    return sorted(out)


def test_knn_is_brute_force(spark, monkeypatch):
    monkeypatch.setattr(knn, "GROUP", 3)
    monkeypatch.setattr(knn, "PART", 50)
    rng = random.Random(9)
    rows = [(i, [rng.gauss(0, 1) for _ in range(6)]) for i in range(0, 900)]
    rows += [(1000, None), (1100, [1.0, None] * 3), (1200, [float("nan")] * 6), (1300, [0.0] * 6), (None, [1.0] * 6), (1400, [2.0] * 4), (1401, [1.0] * 4), (1500, [])]
    df = spark.createDataFrame([(*r, 1) for r in rows], "vec_id long, embedding array<double>, score int")
    got = sorted((r.query_id, r["rank"], r.vec_id, r.score) for r in knn.top_k(df, pivots=20).collect())
    assert got == brute_top(rows)
    assert knn.top_k(df.limit(0)).count() == 0


def test_knn_with_few_pivots_and_ties(spark):
    rows = [(i, [1.0, 0.0] if i % 3 else [0.5, 0.5]) for i in range(300)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>")
    assert sorted((r.query_id, r["rank"], r.vec_id, r.score) for r in knn.top_k(df, pivots=2).collect()) == brute_top(rows)


def test_pipeline(spark):
    import corpus_pipeline as p
    from streamloom.llm import decontaminate, toxicity

    d = "/root/testdata/sf0.001"
    docs = spark.read.parquet(f"{d}/documents.parquet")
    clean = p.stage_toxicity(spark, docs, d)
    good = {r.doc_id for r in toxicity.score_documents(docs, spark.read.parquet(f"{d}/labels.parquet")).where("predicted = 0").collect()}
    rows = [(r.doc_id, r.text) for r in clean.collect()]
    assert {i for i, _ in rows} == good and clean.columns == docs.columns
    once = p.stage_minhash(spark, clean, d)
    assert sorted(r.doc_id for r in once.collect()) == sorted(i for i, (_, c) in groups(rows, 5, 80).items() if i == c) and once.columns == docs.columns
    marked = decontaminate.mark_documents(once, spark.read.parquet(f"{d}/benchmark.parquet")).where("NOT contaminated").count()
    assert p.stage_decontaminate(spark, once, d).count() == marked
    out = p.run(spark, d)
    assert out.count() == marked and "ids_sha256" in out.columns
    assert out.where(F.size("ids") != F.col("n_tokens")).count() == 0


def test_pipeline_odd(spark, tmp_path):
    import corpus_pipeline as p

    words = lambda a, n=40: " ".join(f"w{a}x{i}" for i in range(n))
    rows = [(3, words(1)), (8, words(1)), (8, words(2)), (7, words(3)), (7, words(3)), (None, words(4)), (None, words(5)), (5, None), (6, ""), (9, words(6, 20000)), (10, "x " + words(7, 15) + " y"), (11, "mail a.b@c.de")]
    schema = "doc_id long, text string, lang string, source string, n_chars long, n_items int, contaminated string, score double"
    docs = spark.createDataFrame([(i, t, None, "s", -1, 7, "mine", None) for i, t in rows], schema)
    labels = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    for name, docs_ in (("full", docs), ("empty", docs.limit(0))):
        d = str(tmp_path / name)
        docs_.write.parquet(f"{d}/documents.parquet")
        labels.write.parquet(f"{d}/labels.parquet")
        spark.createDataFrame([(1, words(7, 15)), (None, words(1)), (2, None)], "item_id long, text string").write.parquet(f"{d}/benchmark.parquet")
    # without labels the score is 0.5 for all, which rejects all: the classifier's stage is passed by here
    d, at = str(tmp_path / "full"), docs
    for name, stage in p.STAGES[1:4]:
        at = stage(spark, at, d)
        assert at.columns == docs.columns
    key = lambda r: (str(r[0]), str(r[1]))
    got = sorted(((r.doc_id, r.text) for r in at.collect()), key=key)
    assert got == sorted([(3, words(1)), (8, words(2)), (7, words(3)), (None, words(4)), (None, words(5)), (5, None), (6, ""), (9, words(6, 20000)), (11, "mail <email>")], key=key)
    assert {(r.n_items, r.contaminated, r.score) for r in at.collect()} == {(7, "mine", None)}
    assert p.STAGES[4][1](spark, at, d).count() == 9
    assert p.run(spark, str(tmp_path / "empty")).count() == 0
