"""Spelling variants, packing and vector codes against brute force, on hard rows and on the given tables."""

import hashlib
import math
import random
import re
import zlib
from collections import Counter, defaultdict
from fractions import Fraction

import numpy as np
import pytest
from pyspark.sql import functions as F

from tripline.llm import packing, spelling, vector_codes

DATA = "/root/testdata/sf0.001"


# Spelling variants


def brute_variants(rows, one_in=97, least_length=5, least_count=3):
    """rows of (doc_id, text)."""
    n = Counter()
    for i, t in rows:
        for run in re.findall("[A-Za-zÀ-ÿ]+", t or ""):
            low = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in run)
            h = zlib.crc32(f"{'' if i is None else i}:{low}".encode())
            if h % one_in == 0:
                low = low[: h % len(low)] + low[h % len(low) + 1 :]
            n[low] += 1
    words = {w: c for w, c in n.items() if len(w) >= least_length and c >= least_count}
    near, same = defaultdict(set), defaultdict(set)
    for w in words:
        for k in range(len(w)):
            same[w[:k], w[k + 1 :]].add(w)
            if (shorter := w[:k] + w[k + 1 :]) in words:
                near[w].add(shorter)
                near[shorter].add(w)
    for group in same.values():
        for w in group:
            near[w] |= group - {w}
    form = {}
    for w in words:
        if near[w]:
            best = min(near[w], key=lambda v: (-words[v], v))
            if words[best] >= 2 * words[w]:
                form[w] = best
    out = {}
    for w in words:
        root = w
        while root in form:
            root = form[root]
        out[w] = (form.get(w), root, words[w], len(near[w]), words[form[w]] if w in form else None)
    return out


def got_variants(df, **parameters):
    rows = spelling.spelling_variants(df, **parameters).collect()
    out = {r.word: (r.form, r.root, r.n, r.n_near, r.form_n) for r in rows}
    assert len(out) == len(rows)
    return out


def test_variants_of_given_documents(spark):
    rows = [tuple(r) for r in spark.read.parquet(f"{DATA}/documents.parquet").select("doc_id", "text").collect()]
    found = {r.word: (r.form, r.root, r.n, r.n_near, r.form_n) for r in spelling.op11_spelling_variants(spark, DATA).collect()}
    assert found == brute_variants(rows) and sum(x[0] is not None for x in found.values()) > 100


@pytest.mark.parametrize("most", [2, 7, 2048])
def test_variants_of_hard_words(spark, monkeypatch, most):
    """Groups are halved down to single positions; chains of forms, ties, repeats, long runs and clashing columns."""
    monkeypatch.setattr(spelling, "BLOCK", 5)
    draw = random.Random(most)
    stems = ["anabanana", "anabananas", "aaaaa", "aaaaaa", "aaaaaaa", "bébé×÷ÿ", "Straße", "x" * 700, "x" * 699 + "y", "x" * 701]
    words = list(stems)
    for _ in range(250):
        w = list(draw.choice(words[-60:]))
        at = draw.randrange(len(w))
        kind = draw.randrange(3)
        w[at : at + (kind > 0)] = [draw.choice("abxyéZ")] if kind < 2 else []
        words.append("".join(w))
    rows = [(None, "aaaaa AAAAA aaaaa"), (1, None), (2, ""), (3, "abcd abcd abcd"), (4, "12 ,,"), (4, "Hello, hello HELLO hellp hellp hellp")]
    rows += [(draw.randrange(40), " ".join(draw.choices(words, k=40))) for _ in range(120)]
    rows += rows[-3:]
    df = spark.createDataFrame([(d, t, 9, "s", 8) for d, t in rows], "doc_id long, text string, n int, word string, s int")
    found = got_variants(df, one_in=7, most=most)
    assert found == brute_variants(rows, one_in=7) and len(found) > 100
    assert any(r != f for f, r, *_ in found.values() if f)  # chains


def test_long_texts_are_cut_between_runs():
    text = " ".join(random.Random(1).choices(["alpha", "béta", "G", "x" * 500], k=3000))
    assert sum((Counter(spelling.RUN.findall(x)) for x in spelling.slices(text, 1000)), Counter()) == Counter(spelling.RUN.findall(text))
    assert list(spelling.slices("a" * 5000, 1000)) == ["a" * 5000] and list(spelling.slices("", 10)) == [""]


def test_no_variants_without_words(spark):
    df = spark.createDataFrame([(1, None), (2, "a b c 1 2 3")], "doc_id long, text string")
    assert spelling.spelling_variants(df).count() == spelling.spelling_variants(df.limit(0)).count() == 0


# Packing


@pytest.fixture(scope="module")
def tokenizer():
    import public_tokenizers
    from tokenizers import Tokenizer

    path = public_tokenizers.path("word_bpe_49k.json")
    return path, Tokenizer.from_file(path)


def test_units_encode_as_whole_texts(tokenizer):
    path, library = tokenizer
    draw = random.Random(2)
    texts = [
        "don't 'tis ''s 5's a'b,'s \"'re\" don'T'LL've 'S", "İx ΑΣ, ée ≠ ≠", "<|endoftext|>x <|ENDOFTEXT|> a<|startoftext|>", "\x1c\x85\t a\rb c d", None, "", "'", "x '", "'s", "5'd",
        "\n\nA  b", "漢字 カナ 가", "Àßÿŉſ", "12a3 a_b (c)d'", "a" * 300 + "'" + "b", "".join(map(chr, range(32, 384))), " ".join(map(chr, range(32, 384))),
    ]
    texts += ["".join(draw.choices("aA'éß́ ,.<|5\n-sS", k=draw.randrange(40))) for _ in range(3000)]
    expected = [x.ids for x in library.encode_batch([t or "" for t in texts], add_special_tokens=False)]
    encoder = packing.UnitEncoder(path)
    assert [x.tolist() for x in encoder.encode(texts)] == expected
    assert [x.tolist() for x in encoder.encode(texts, 10)] == expected  # cut at blanks
    small = packing.UnitEncoder(path, keep=50)
    assert [x.tolist() for x in small.encode(texts, 10)] == expected


def checked(rows, docs, library, capacity, end_id=0):
    """Pieces are the documents', sequences are full from 0 on without gaps; returns their number and the least possible."""
    expected, total = Counter(), 0
    for i, t in docs:
        ids = np.array([*library.encode(t or "", add_special_tokens=False).ids, end_id], "<u4")
        total += len(ids)
        for p, a in enumerate(range(0, len(ids), capacity)):
            part = ids[a : a + capacity]
            expected[i, p, a, len(part), zlib.crc32(part)] += 1
    assert Counter((r.doc_id, r.piece, r.start, r.length, r.ids_crc32) for r in rows) == expected
    by = defaultdict(list)
    for r in rows:
        by[r.sequence_id].append((r.offset, r.length))
    for held in by.values():
        held.sort()
        assert all(o == sum(x for _, x in held[:i]) for i, (o, _) in enumerate(held)) and sum(x for _, x in held) <= capacity
    return len(by), -(-total // capacity)


def test_packs_given_documents(spark, tokenizer):
    docs = [tuple(r) for r in spark.read.parquet(f"{DATA}/documents.parquet").select("doc_id", "text").collect()]
    used, least = checked(packing.op12_best_fit(spark, DATA).collect(), docs, tokenizer[1], 2048)
    assert used <= least + 1


@pytest.mark.parametrize("parameters", [{}, {"open_bins": 3}, {"open_bins": 64, "task_pieces": 64}])
def test_packs_hard_rows(spark, tokenizer, parameters):
    draw = random.Random(6)
    docs = [(None, "no id"), (1, None), (1, ""), (2, "w " * 63), (3, "w " * 64), (4, "w " * 127), (5, "w " * 1000), (5, "w " * 1000), (6, "<|endoftext|>")]
    docs += [(10 + i, "w " * draw.randrange(90)) for i in range(900)]
    df = spark.createDataFrame([(d, t, 7, 8, 9) for d, t in docs], "doc_id long, text string, length int, start int, sequence_id int")
    rows = packing.pack(df, tokenizer[0], capacity=64, **parameters).collect()
    used, least = checked(rows, docs, tokenizer[1], 64)
    assert used <= (1.2 if parameters.get("open_bins") == 3 else 1.02) * least + 1
    assert packing.pack(df.limit(0), tokenizer[0]).count() == 0


def test_open_bins_choose_the_best_fit():
    bins, closed = packing.OpenBins(10, 2), []
    for i, x in enumerate([6, 7, 3, 4, 9, 8, 5]):
        closed += bins.add((i,), x)
    # 3 fills 7, 4 fills 6; then 9 and 8 are open, and the fuller one closes for 5
    assert closed == [[(1,), (2,)], [(0,), (3,)], [(4,)]] and [(room, rows) for room, rows in bins.left()] == [(2, [(5,)]), (5, [(6,)])]


# Vector codes


def brute_codes(rows, parts, entries, rounds):
    """rows of (vec_id, vector, label) of one number of components, in the order of vec_id."""
    width = -(-len(rows[0][1]) // parts)
    whole = [[math.floor(Fraction(x) * 256) for x in v] + [0] * (width * parts - len(v)) for _, v, _ in rows]
    cut = [[v[p * width : (p + 1) * width] for v in whole] for p in range(parts)]
    books = [[list(x) for x in of[:entries]] for of in cut]
    away = lambda a, b: sum((x - y) ** 2 for x, y in zip(a, b, strict=True))
    best = lambda x, book: min((away(x, e), i) for i, e in enumerate(book))
    for _ in range(rounds):
        for p in range(parts):
            held = defaultdict(list)
            for x in cut[p]:
                held[best(x, books[p])[1]].append(x)
            for i, xs in held.items():
                books[p][i] = [sum(c) // len(xs) for c in zip(*xs, strict=True)]
    out = []
    for r in range(len(rows)):
        found = [best(cut[p][r], books[p]) for p in range(parts)]
        out.append(("".join(f"{i:02x}" for _, i in found), sum(d for d, _ in found)))
    return out, hashlib.sha256(",".join(str(c) for b in books for e in b for c in e).encode()).hexdigest()


@pytest.mark.parametrize(("components", "parts", "scale"), [(8, 4, 1.0), (10, 4, 1.0), (12, 4, 3.0), (7, 7, 0.01), (8, 2, 3e37), (5, 1, 1e300)])
def test_codes_equal_brute_force(spark, components, parts, scale):
    draw = random.Random(components)
    made = lambda: [draw.choice((draw.gauss(0, 1), float(draw.randrange(-2, 3)))) * scale for _ in range(components)]
    rows = [(i, made(), draw.choice(("a", "a", "b", None))) for i in range(120)]
    rows += [(200, rows[3][1], "a"), (200, rows[3][1], "a")]
    odd = [(1, None, "a"), (2, [None] * components, "a"), (3, [math.nan] * components, None), (4, [math.inf] * components, "b")]
    df = spark.createDataFrame(draw.sample([(*r, 5) for r in rows + odd], len(rows) + 4), "vec_id long, embedding array<double>, label string, code int")
    coded, _ = vector_codes.vector_codes(df, parts=parts, entries=16, rounds=2)
    found = sorted(vector_codes.label_sums(coded).collect(), key=lambda r: (r.vec_id, r.code))
    want, sha = brute_codes(rows, parts, 16, 2)
    assert {r.codebooks_sha256 for r in found} == {sha}
    errors = [e if e < 2**63 else None for _, e in want]
    assert [(r.code, r.error) for r in found] == list(zip((c for c, _ in want), errors, strict=True))
    for label in ("a", "b", None):
        its = [e for (_, _, x), e in zip(rows, errors, strict=True) if x == label]
        total = None if None in its or sum(its) >= 2**63 else sum(its)
        assert {r.label_error for r in found if r.label == label} == {total}


def test_vectors_of_several_lengths(spark):
    rows = [(1, [1.0, 2.0], 1), (2, [1.5, 2.0], 1), (None, [3.0, 4.0], 1), (3, [], 2), (4, [7.0], 2)]
    coded, books = vector_codes.vector_codes(spark.createDataFrame(rows, "vec_id long, embedding array<float>, label int"), parts=2, entries=2, rounds=1)
    found = {r.vec_id: r for r in coded.collect()}
    assert set(found) == {None, 1, 2, 3, 4} and set(books) == {0, 1, 2}
    assert (found[1].code, found[2].code, found[None].code) == ("0001", "0001", "0100") and (found[3].code, found[3].error) == ("0000", 0)
    assert books[2][0].tolist() == [[256], [576]] and books[1].tolist() == [[[1792]], [[0]]]
    empty = spark.createDataFrame([], "vec_id long, embedding array<float>, label int")
    assert vector_codes.label_sums(vector_codes.vector_codes(empty)[0]).count() == 0


def test_elimination_is_exact_with_ties():
    draw = np.random.default_rng(1)
    for width in (1, 2, 3, 4, 7, 16):
        x, book = draw.integers(-3, 4, (200, width)), draw.integers(-3, 4, (30, width))
        code, error = vector_codes.nearest(x, book)
        away = ((x[:, None] - book) ** 2).sum(2)
        assert (code == away.argmin(1)).all() and (error == away.min(1)).all()
    signs = (np.diff(vector_codes.walsh(16), axis=1) != 0).sum(1)
    assert signs.tolist() == list(range(16))


def test_rare_labels_are_joined_by_shuffle(spark):
    coded = spark.range(6000).select(F.col("id").alias("vec_id"), F.when(F.col("id") < 3000, 0).otherwise(F.col("id")).alias("label"), F.lit(2).cast("long").alias("error"))
    sums = {r.label: r.label_error for r in vector_codes.label_sums(coded).select("label", "label_error").distinct().collect()}
    assert sums == {0: 6000} | {i: 2 for i in range(3000, 6000)}
