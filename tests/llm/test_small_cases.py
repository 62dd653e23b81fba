"""Each operator on a small table with nulls, empty and repeated rows, ties and clashing columns, against brute force."""

import hashlib
import random
import re
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from tripline.llm import components, decontamination, line_dedup, mixing, near_dedup, quality, search, suffix_dedup, tokens, toxicity, warc

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, label int, slot long, score double, n long"


def documents(spark, rows):
    """rows of (doc_id, text, source); the other columns clash with names that operators use."""
    return spark.createDataFrame([(d, t, "en", s, None, 1, 2, 3.0, 4) for d, t, s in rows], SCHEMA)


def babble(seed, n, words=("ab", "cde", "fg", "hijk", "l", "mno", "pq", "Rst", "é", "uvw7", "x-y", "z")):
    r = random.Random(seed)
    return " ".join("".join(r.choice(words) for _ in range(r.randint(1, 3))) for _ in range(n))


ODD = [(None, "no id", "a"), (90, None, "a"), (91, "", None), (92, " \n\t", "b"), (93, "one", "b"), (94, "one two", "b"), (95, "é漢😀 <|endoftext|>", "c")]


def test_warc(spark):
    page = "<p>" + "x" * 300 + "</p>"
    rows = [(3, "u/3", page), (1, "u/1", page), (2, "u\n2", page), (4, None, None), (5, "", ""), (6, "u", "short"), (7, "u", "short"), (None, "u", page), (1, "u/1", page), (8, "u", "é漢" * 40_000)]
    pages = spark.createDataFrame([(*r, "extra") for r in rows], "page_id long, url string, html string, digest string")
    found = warc.read_warc(warc.write_warc(pages, segment_bytes=10_000)).collect()
    assert len(found) == len(rows) and all(r.valid for r in found)
    for r in found:
        body = next((h or "").encode() for i, _, h in rows if i == r.page_id)
        assert r.payload_bytes == len(body) and r.payload_digest == hashlib.sha256(body).hexdigest()
        first = len(body) < 100 or r.page_id in (1, 8)
        assert (r.record_type, r.refers_to) == (("response", None) if first else ("revisit", 1))
        assert first == (r.payload is not None) and (not first or bytes(r.payload) == body)
    assert warc.read_warc(warc.write_warc(pages.limit(0))).count() == 0


def test_warc_reports_broken_records():
    body = warc.chunked(b"abc" * 5000)
    assert warc.dechunked(body) == b"abc" * 5000
    with pytest.raises(ValueError):
        warc.dechunked(body[:-300])
    assert warc.checked(None, 3, warc.HTTP_HEAD + body) is None
    assert warc.dechunked(b"3;x=y\r\nabc\r\n0\r\nTrailer: 1\r\n\r\n") == b"abc"


def brute_repeats(rows, length=50):
    first = {}
    for d, b in rows:
        for i in range(len(b) - length + 1):
            first[b[i : i + length]] = min(first.get(b[i : i + length], 1 << 62), d)
    out = []
    for d, b in rows:
        gone = bytearray(len(b))
        for i in range(len(b) - length + 1):
            if first[b[i : i + length]] < d:
                gone[i : i + length] = b"\1" * length
        kept = bytes(c for c, g in zip(b, gone, strict=True) if not g)
        out.append((d, len(b), sum(gone), len(re.findall(b"\1+", bytes(gone))), hashlib.sha256(kept).hexdigest()))
    return sorted(out)


def test_suffix_dedup(spark):
    shared = babble(1, 40)
    texts = [babble(i, 60) + (shared if i % 3 == 0 else shared[i : i + 60]) + babble(i + 50, 20) for i in range(12)]
    texts += [texts[2], "a" * 500, "a" * 49, "a" * 51 + "b", "ab" * 100, shared, shared[10:59], shared[10:60] + "\n" + shared[:50]]
    rows = [(100 - i, t, "s") for i, t in enumerate(texts)] + [(100, texts[0], "s")] + ODD[1:]
    docs = documents(spark, rows)
    found = suffix_dedup.remove_repeats(docs.repartition(3), shard_bytes=700, keep_bytes=True)
    got = sorted((r.doc_id, r.n_bytes, r.n_removed, len(r.spans), r.kept_sha256) for r in found.collect())
    assert got == brute_repeats([(d, (t or "").encode()) for d, t, _ in rows])
    assert suffix_dedup.remove_repeats(docs.limit(0)).count() == 0
    last = suffix_dedup.remove_repeats(documents(spark, [(None, shared, "s"), (5, shared, "s")])).collect()
    assert {(r.doc_id, r.n_removed) for r in last} == {(None, len(shared.encode())), (5, 0)}


def test_suffix_array_and_prefixes():
    r = random.Random(5)
    for _ in range(20):
        data = np.frombuffer(bytes(r.choice(b"ab") for _ in range(r.randint(1, 300))) * r.randint(1, 3), np.uint8)
        order, several = suffix_dedup.suffix_array(data, 50)
        raw = data.tobytes()
        keys = [raw[i : i + 64].ljust(64, b"\0") for i in order]
        assert keys == sorted(keys)
        starts = np.array(sorted({0, *(r.randrange(len(raw)) for _ in range(4))}))
        got = suffix_dedup.common_prefixes(data, order, starts, 50)
        padded = raw + bytes(50)
        for a, b in zip(order, order[1:], strict=False):
            same = next((k for k in range(50) if padded[a + k] != padded[b + k]), 50)
            assert got[b] == same
        some = suffix_dedup.common_prefixes(data, order, starts, 50, several)
        assert ((some == 50) == (got == 50)).all() and ((some == got) | (some == 0)).all()


def test_components_of_few_edges_take_few_tasks(spark):
    names = {"spark.sql.shuffle.partitions": "64", "spark.sql.adaptive.coalescePartitions.enabled": "false"}
    before = {k: spark.conf.get(k) for k in names}
    try:
        for k, v in names.items():
            spark.conf.set(k, v)
        found = components.components(spark.createDataFrame([(1, 2), (2, 3), (5, 4), (9, 4)], "a long, b long"))
        assert found.rdd.getNumPartitions() < 40
        assert {tuple(r) for r in found.collect()} == {(1, 1), (2, 1), (3, 1), (4, 4), (5, 4), (9, 4)}
    finally:
        for k, v in before.items():
            spark.conf.set(k, v)


def test_string_ranks_need_no_prefixes(monkeypatch):
    monkeypatch.setattr(suffix_dedup, "common_prefixes", None)  # ranks end at the strings' length
    r = random.Random(6)
    for length in (20, 23, 37, 50):
        raw = b"".join(bytes(r.choice(b"ab\0") for _ in range(r.randint(1, 90))) * r.randint(1, 4) for _ in range(9))
        found = suffix_dedup.string_classes(np.frombuffer(raw, np.uint8), length)
        strings = [raw[i : i + length] for i in range(len(raw) - length + 1)]
        place = {x: i for i, x in enumerate(sorted(set(strings)))}
        _, dense = np.unique(found[: len(strings)], return_inverse=True)
        assert dense.tolist() == [place[x] for x in strings]


def test_search(spark):
    r = np.random.default_rng(3)
    vectors = [(i, [float(x) for x in v], "x") for i, v in enumerate(r.normal(size=(120, 8)).astype(np.float32))]
    vectors += [(200, vectors[7][1], "x"), (201, vectors[7][1], "x"), (250, None, "x"), (251, [1.0, None] + [0.0] * 6, "x"), (252, [float("inf")] * 8, "x"), (300, [1.0, 2.0], "x"), (350, [2.0, 1.0], "x"), (None, [1.0] * 8, "x")]
    rows = spark.createDataFrame(vectors, "vec_id long, embedding array<float>, score string")
    found = search.top_k(rows.repartition(3), "vec_id % 50 = 0", block=2)
    good = {i: np.floor(256 * np.array(v, np.float64)) for i, v, _ in vectors if i is not None and v and None not in v and np.isfinite(v).all()}
    expected = set()
    for q, x in good.items():
        if q % 50 == 0:
            scored = sorted((-int(x @ y), i) for i, y in good.items() if i != q and len(y) == len(x))[:5]
            expected |= {(q, k + 1, i, -s) for k, (s, i) in enumerate(scored)}
    assert {tuple(x) for x in found.collect()} == expected
    assert search.top_k(rows.limit(0), "vec_id % 50 = 0").count() == 0


def test_search_with_large_scores():
    q = np.array([[2.0**40, 1.0]])
    assert search.scores(q, np.array([[2.0**20, 1.0]]))[0, 0] == 2**60 + 1
    with pytest.raises(OverflowError):
        search.scores(q, np.array([[2.0**40, 1.0]]))


def test_tokens(spark):
    import public_tokenizers
    from tokenizers import Tokenizer

    path = public_tokenizers.path("byte_bpe_50k.json")
    rows = [(i, babble(i, 30), "s") for i in (5, 3, 8, 1)] + [(3, "again", "s")] + ODD
    files = tokens.write_tokens(documents(spark, rows), path, file_ids=100)
    assert files.count() > 2
    tokenizer = Tokenizer.from_file(path)
    tokenizer.encode_special_tokens = True
    found = sorted(tokens.read_tokens(files).collect(), key=lambda r: r.start)
    assert [r.doc_id for r in found] == sorted((d for d, _, _ in rows), key=lambda d: (d is not None, d or 0))
    at, left = 0, {}
    for d, t, _ in rows:
        ids = np.array([*tokenizer.encode(t or "", add_special_tokens=False).ids, 0], "<u4")
        left.setdefault(d, []).append((len(ids), zlib.crc32(ids.tobytes())))
    for r in found:
        assert r.start == at
        left[r.doc_id].remove((r.n_tokens, r.ids_crc32))
        at += r.n_tokens
    assert tokens.read_tokens(tokens.write_tokens(documents(spark, rows).limit(0), path)).count() == 0


def test_words_of_any_width():
    for n in (0, 1, 1023, 1024, 1025, 4000):
        r = np.random.default_rng(n)
        ids = r.integers(0, 2**63, n, dtype=np.uint64) >> r.integers(0, 63, n).astype(np.uint64)
        ids[::97] = np.uint64(2**64 - 1)  # escapes
        words, offsets = tokens.pack(ids)
        assert (tokens.unpack(words, offsets, n) == ids).all()
    words, _ = tokens.pack(np.zeros(6000, np.uint64))
    assert len(words) < 6000 / 50


def test_encoder_equals_the_tokenizer():
    import public_tokenizers

    encoder = tokens.Encoder(public_tokenizers.path("byte_bpe_50k.json"), keep=200)
    r, marks = random.Random(1), "ab'st ré\n\t  .,!12ÉñΣжé'll 've   漢字😀\x1c\x85\x00"
    texts = ["".join(r.choice(marks) for _ in range(r.randint(0, 40))) for _ in range(400)]
    expected = [x.ids for x in encoder.tokenizer.encode_batch(texts, add_special_tokens=False)]
    assert [x.tolist() for x in encoder.encode(texts)] == expected
    long = " ".join(texts) * 30
    assert encoder.encode([long], 500)[0].tolist() == encoder.tokenizer.encode(long, add_special_tokens=False).ids


def test_encoder_keeps_what_is_used_often():
    import public_tokenizers

    encoder, learned = tokens.Encoder(public_tokenizers.path("byte_bpe_50k.json"), keep=200), []
    learn = encoder.learn
    encoder.learn = lambda texts: (learned.extend(texts), learn(texts))
    r = random.Random(4)
    for k in range(40):
        texts = [" often used words " * 3, " ".join(f"{''.join(r.choice('etaoin') for _ in range(7))}" for _ in range(30))]
        expected = [x.ids for x in encoder.tokenizer.encode_batch(texts, add_special_tokens=False)]
        assert [x.tolist() for x in encoder.encode(texts)] == expected, k
        assert len(encoder.place) <= 200 and len(encoder.place) == len(encoder.size) == len(encoder.uses)
    assert len(learned) > 400 and learned.count(" often") == 1  # seldom ones go, this one stays


def test_lines(spark):
    base = "the quick brown fox jumps over the lazy dog near the river bank number today while the quick brown cat sleeps on the warm windowsill of the old house"
    rows = [(1, f"well {base}\nshort line", "s"), (2, f"WELL,  {base}!", "s"), (3, babble(3, 30), "s"), (4, f"{babble(3, 30)}\n{babble(3, 30)}", "s")] + ODD
    found = {r.doc_id: (r.n_lines, r.n_judged, r.removed) for r in line_dedup.removed_lines(documents(spark, rows)).collect()}
    assert found[1] == (2, 1, []) and found[2] == (1, 1, [0]) and found[3] == (1, 1, []) and found[4] == (2, 2, [0, 1])
    assert 90 not in found and found[91] == (1, 0, [])
    clean = {r.doc_id: r.text for r in line_dedup.dedup_lines(documents(spark, rows)).collect()}
    assert clean[4] == "" and clean[2] == "" and clean[90] is None and clean[1] == rows[0][1]
    assert line_dedup.removed_lines(documents(spark, rows).limit(0)).count() == 0


def labelled(spark, n, text, column):
    rows = [(1000 + i, text(i, i % 4 == 0), "s") for i in range(n)]
    labels = [(1000 + i, int((i % 4 == 0) == (column == "toxic"))) for i in range(n)]
    return documents(spark, rows + ODD), spark.createDataFrame([*labels, (None, 1), (1007, None)], f"doc_id long, {column} int")


def test_quality(spark):
    def text(i, bad):
        return "\n".join(babble(i * 9 + j, 12).upper().replace(" ", "!! ") if bad else babble(i * 9 + j, 12) for j in range(4))

    docs, labels = labelled(spark, 160, text, "quality")
    scores = {r.doc_id: r.score for r in quality.quality(docs, labels, F.col("doc_id") < 1100).collect()}
    assert len(scores) == 160 + len(ODD) and all(0 <= s <= 1 for s in scores.values())
    assert all((scores[i] >= 0.7) == (i % 4 != 0) for i in range(1100, 1160))
    none = quality.quality(docs, labels.limit(0), F.lit(True))
    assert {r.score for r in none.collect()} == {0.0} and quality.quality(docs.limit(0), labels, F.lit(True)).count() == 0


def test_forward_backward():
    field = quality.Field(np.zeros(2), np.ones(2))
    r = np.random.default_rng(0)
    field.w, field.b, field.first, field.pair = r.normal(size=2), 0.3, r.normal(size=2), r.normal(size=(2, 2))
    x, owner = r.normal(size=(7, 2)), np.array([0, 0, 0, 1, 2, 2, 2])
    e = field.emissions(x)
    good, _, _ = field.marginals(e, owner)
    for d in range(3):
        at = np.flatnonzero(owner == d)
        weight = {}
        for labels in np.ndindex(*[2] * len(at)):
            s = field.first[labels[0]] + sum(e[i] for i, y in zip(at, labels, strict=True) if y) + sum(field.pair[a, b] for a, b in zip(labels, labels[1:], strict=False))
            weight[labels] = np.exp(s)
        for k, i in enumerate(at):
            assert good[i] == pytest.approx(sum(w for y, w in weight.items() if y[k]) / sum(weight.values()))


def test_toxicity(spark):
    def text(i, bad):
        return babble(i, 60) + (" you grubbish " + babble(i + 500, 5) + " grubbish" if bad else "")

    docs, labels = labelled(spark, 200, text, "toxic")
    scores = {r.doc_id: r.score for r in toxicity.toxicity(docs, labels, F.col("doc_id") < 1140).collect()}
    assert len(scores) == 200 + len(ODD) and all(0 <= s <= 1 for s in scores.values())
    assert all((scores[i] >= 0.7) == (i % 4 == 0) for i in range(1140, 1200))
    assert {r.score for r in toxicity.toxicity(docs, labels.limit(0), F.lit(True)).collect()} == {0.0}


WORD = re.compile(rb"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def test_decontamination(spark):
    passages = [babble(900 + i, 25) for i in range(3)]
    items = [(10, passages[0]), (9, passages[1]), (100, "Rare-Short phrase"), (11, ""), (12, None), (None, passages[2]), (13, passages[0])]
    rows = [(1, babble(1, 30) + " " + passages[0] + " " + babble(2, 5), "s"), (2, passages[1].upper(), "s"), (3, "a rare short, PHRASE é rare", "s"), (4, passages[2], "s"), (5, babble(5, 50), "s"), (1, passages[1], "s")] + ODD
    items = spark.createDataFrame(items, "item_id long, text string")
    found = decontamination.decontaminate(documents(spark, rows), items, shard_bytes=200, block_bytes=150).collect()

    def words(t):
        return WORD.findall((t or "").encode().translate(bytes(c + 32 if 65 <= c <= 90 else c for c in range(256))))

    windows = {}
    for i, t in items.collect():
        w = words(t)
        for k in range(max(len(w) - 10, 0) + 1 if w else 0):
            windows.setdefault(tuple(w[k : k + 10]), set()).add(i)
    expected = []
    for d, t, _ in rows:
        w, hit, seen = words(t), set(), set()
        for p, ids in windows.items():
            for k in range(len(w) - len(p) + 1):
                if tuple(w[k : k + len(p)]) == p:
                    hit |= set(range(k, k + len(p)))
                    seen |= ids - {None}
        expected.append((str(d), len(w), len(hit), sorted(map(str, seen))))
    assert sorted((str(r.doc_id), r.n_words, r.n_hit, list(map(str, r["items"]))) for r in found) == sorted(expected)
    for r in found:
        cut = "".join(c for i, c in enumerate(r.text or "") if not any(s["start"] <= i < s["end"] for s in r.spans))
        assert cut == (r.clean_text or "")
    assert all(r.n_hit == 0 for r in decontamination.decontaminate(documents(spark, rows), items.limit(0)).collect())


def test_fm_index():
    r = random.Random(2)
    text = np.array([r.randint(0, 4) for _ in range(500)] + [0])
    index = decontamination.FmIndex(text)
    for n in (1, 2, 5):
        phrases = np.array([[r.randint(1, 4) for _ in range(n)] for _ in range(60)])
        which, lo, hi = index.search(phrases)
        got = {int(w): sorted(index.locate(np.arange(a, b)).tolist()) for w, a, b in zip(which, lo, hi, strict=True)}
        for i, p in enumerate(phrases):
            places = [k for k in range(len(text) - n + 1) if (text[k : k + n] == p).all()]
            assert got.get(i, []) == places


def test_near_duplicates(spark):
    base = babble(1, 120).split()
    rows = []
    for i in range(30):
        r, words = random.Random(i), list(base)
        for _ in range(i % 6):
            words[r.randrange(len(words))] = f"edit{i}"
        rows.append((1000 - i, " ".join(words), "s"))
    rows += [(200 + i, babble(50 + i, 80), "s") for i in range(10)] + [(300, babble(50, 80).upper(), "s"), (55, rows[3][1], "s"), (400, "one two", "s")] + ODD[1:]
    got = {r.doc_id: (r.n_shingles, r.component_id, r.kept) for r in near_dedup.near_duplicates(documents(spark, rows), 3, "0.85").collect()}
    sets = {}
    for d, t, _ in rows:
        w = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), t or ""))
        sets[d] = {tuple(w[i : i + 3]) for i in range(len(w) - 2)} or ({tuple(w)} if w else set())
    label = {d: d for d in sets}
    for _ in sets:
        for a in sets:
            for b in sets:
                if sets[a] and 100 * len(sets[a] & sets[b]) >= 85 * len(sets[a] | sets[b]):
                    label[a] = label[b] = min(label[a], label[b])
    assert got == {d: (len(sets[d]), label[d], label[d] == d) for d in sets}
    assert near_dedup.near_duplicates(documents(spark, rows).limit(0)).count() == 0


def test_components(spark):
    r = random.Random(4)
    edges = [(r.randrange(200), r.randrange(200)) for _ in range(150)] + [(i, i + 1) for i in range(300, 340)]
    label = {x: x for e in edges for x in e}
    for _ in range(400):
        for a, b in edges:
            label[a] = label[b] = min(label[a], label[b])
    found = components.components(spark.createDataFrame(edges, "a long, b long"))
    got = {x.id: x.label for x in found.collect()}
    assert got == {k: v for k, v in label.items() if k in got} and all(label[k] == k for k in label if k not in got)


def test_mixing(spark):
    rows = [(i, f"t{i}", f"s{i % 3}" if i % 7 else None) for i in range(200)] + [(3, "t3", "s0"), (None, "x", "s1")]
    docs = documents(spark, rows)
    found = mixing.mix(docs, {"s0": 5, "s1": 2, None: 3}, block_docs=2)
    out = found.collect()
    assert len(out) == len(rows) and all(r.release <= r.slot < r.deadline for r in out)
    blocks = {}
    for r in out:
        assert blocks.setdefault(r.slot, (r.source, r.block)) == (r.source, r.block)
    assert found.columns == [c for c in docs.columns if c != "slot"] + list(mixing.RESULT)
    assert mixing.mix(docs.limit(0), {}).count() == 0
    with pytest.raises(ValueError):
        mixing.mix(docs, {"s0": 0})


def test_schedule_keeps_within_a_block():
    for seed in range(30):
        r = random.Random(seed)
        weights = {f"s{i}": r.randint(1, 30) for i in range(r.randint(1, 12))}
        plan = sorted(mixing.schedule(weights), key=lambda x: x[2])
        total, done = sum(weights.values()), dict.fromkeys(weights, 0)
        assert [x[2] for x in plan] == list(range(total))
        for s, i, slot in plan:
            assert i == done[s]
            done[s] += 1
            assert all(abs(done[x] - weights[x] * (slot + 1) / total) < 1 for x in weights)
