"""Texts that deceive weak hashes, very long and hot texts, ids at the edges, broken archives, and every stage of the pipeline on odd tables."""

import gzip
import hashlib
import random
import zlib
from fractions import Fraction

import numpy as np
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from tripline.llm import decontamination, line_dedup, mixing, near_dedup, search, suffix_dedup, tokens, toxicity, warc

WORDS = [a + b + c for a in ("ka", "lo", "mi", "tu", "re") for b in ("n", "s", "rt", "ll") for c in ("o", "ae", "im", "us")]


def prose(seed, n):
    r = random.Random(seed)
    return " ".join(r.choice(WORDS) for _ in range(n))


def documents(spark, rows):
    return spark.createDataFrame(rows, "doc_id long, text string")


def thue_morse(n):
    """Two words of n letters that every polynomial hash modulo 2**64 takes for one, if n is 1,024 or more."""
    bits = [i.bit_count() & 1 for i in range(n)]
    return "".join("ab"[b] for b in bits), "".join("ba"[b] for b in bits)


@pytest.mark.parametrize("n", [1024, 2048, 4096])
def test_words_that_deceive_polynomial_hashes(spark, n):
    import public_tokenizers
    from tokenizers import Tokenizer

    one, other = thue_morse(n)
    rows = [(1, f"x {one} y z"), (2, f"x {other} y z")]
    found = near_dedup.near_duplicates(documents(spark, rows), 3, "0.85").collect()
    assert {(r.doc_id, r.component_id) for r in found} == {(1, 1), (2, 2)}
    items = spark.createDataFrame([(7, one)], "item_id long, text string")
    hits = {r.doc_id: r.n_hit for r in decontamination.decontaminate(documents(spark, rows), items).collect()}
    assert hits == {1: 1, 2: 0}
    path = public_tokenizers.path("byte_bpe_50k.json")
    tokenizer, encoder = Tokenizer.from_file(path), tokens.Encoder(path, added=True)
    assert [x.tolist() for x in encoder.encode([t for _, t in rows])] == [tokenizer.encode(t, add_special_tokens=False).ids for _, t in rows]


def test_texts_of_one_doc_id_are_one_document(spark):
    a, b = prose(1, 60), prose(2, 60)
    found = near_dedup.near_duplicates(documents(spark, [(0, b), (1, b), (1, a), (5, a), (6, prose(3, 60))]), 3, "0.85").collect()
    assert sorted((r.doc_id, r.component_id) for r in found) == [(0, 0), (1, 0), (1, 0), (5, 0), (6, 6)]


def test_parities_never_rule_out_a_link():
    r = np.random.default_rng(1)
    for n, gone in ((20, 2), (300, 40), (3000, 500)):
        x = r.integers(0, 2**64, n, dtype=np.uint64)
        y = np.concatenate([x[gone:], r.integers(0, 2**64, gone, dtype=np.uint64)])
        apart = int(np.bitwise_count(near_dedup.parities(x) ^ near_dedup.parities(y)).sum())
        assert apart <= 2 * gone


def test_repeats_of_long_and_hot_texts(spark):
    hot = "this very line stands in each of the documents, whatever else they say"
    shared = prose(9, 3000)
    long = prose(8, 150_000) + shared + prose(7, 150_000)  # above two shards
    rows = [(2**63 - 1, shared), (-(2**63), prose(5, 30)), (None, shared[:200]), (3, long), (4, long[1_000_000:1_000_500])]
    rows += [(100 + i, f"{prose(50 + i, 8)} {hot} {prose(90 + i, 8)}") for i in range(40)]
    found = {r.doc_id: r for r in suffix_dedup.remove_repeats(documents(spark, rows).repartition(4), keep_bytes=True).collect()}
    assert found[2**63 - 1].n_removed == len(shared) and found[None].n_removed == 200 and found[4].n_removed == 500
    assert found[3].n_removed == 0 and found[3].n_bytes == len(long) and found[3].kept_sha256 == hashlib.sha256(long.encode()).hexdigest()
    assert found[100].n_removed == 0 and all(found[100 + i].n_removed >= len(hot) for i in range(1, 40))
    assert all(r.n_removed + len(r.kept) == r.n_bytes for r in found.values())


def test_pieces_of_a_text_are_put_together(spark):
    text = prose(3, 4000)
    rows = [(1, text), (2, prose(4, 30) + text[5000:9000] + prose(5, 30))]
    for size in (700, 1 << 20):
        found = {r.doc_id: r for r in suffix_dedup.remove_repeats(documents(spark, rows), shard_bytes=size).collect()}
        assert found[1].n_removed == 0 and 4000 <= found[2].n_removed < 4100 and len(found[2].spans) == 1


def edit_distance(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        before, row[0] = row[0], i
        for j, y in enumerate(b, 1):
            before, row[j] = row[j], min(row[j] + 1, row[j - 1] + 1, before + (x != y))
    return row[-1]


def test_recall_of_fuzzy_lines(spark):
    """All pairs of the smallest table's lines of up to 200 characters are compared; of the links, nine tenths are in one class."""
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    norms = docs.select(F.explode(F.split("text", "\n")).alias("l")).select(line_dedup.normalised(F.col("l")).alias("n"))
    norms = norms.where("n <> '' and char_length(n) <= 200").distinct().cache()
    most = line_dedup.most_edits(F.char_length("n"), F.char_length("m"), 0.8)
    both = norms.repartition(8).crossJoin(norms.withColumnRenamed("n", "m")).where((F.col("n") < F.col("m")) & (F.abs(F.char_length("n") - F.char_length("m")) <= most))
    pairs = both.where(F.call_function("levenshtein", "n", "m", most) >= 0).collect()
    lines = [r.n for r in norms.collect()]
    found = line_dedup.judged_lines(documents(spark, list(enumerate(lines))), least_words=1).collect()
    label = {lines[r.doc_id]: r.classes[0]["label"] for r in found}
    hit = sum(label[r.n] == label[r.m] for r in pairs)
    print(f"recall of links: {hit} of {len(pairs)}")
    assert len(pairs) > 5 and hit >= 0.9 * len(pairs)


def test_lines_are_linked_by_edit_distance_alone(spark):
    rows = [(i, prose(i % 20, 12 + i % 7)) for i in range(60)]
    found = line_dedup.judged_lines(documents(spark, rows), least_words=1).collect()
    label = {r.doc_id: r.classes[0]["label"] for r in found}
    for i, x in rows:
        near = [j for j, y in rows if j != i and label[j] == label[i]]
        assert not near or min(edit_distance(x, rows[j][1]) / max(len(x), len(rows[j][1])) for j in near) <= 0.2


def test_simhash_of_many_words(spark):
    texts = {1: "a b c d e f g h", 2: " ".join(f"w{i % 977}" for i in range(40_000)), 3: " ".join(f"v{i}" for i in range(255))}
    rows = line_dedup.with_simhash(documents(spark, list(texts.items())).withColumn("words", F.split("text", " ")), "words", "sim").collect()
    for r in rows:
        words = spark.createDataFrame([(w,) for w in texts[r.doc_id].split()], "w string")
        hashes = np.array([x.h for x in words.select(F.xxhash64("w").alias("h")).collect()], np.int64).view(np.uint64)
        expected = sum(1 << b for b in range(64) if int(((hashes >> np.uint64(b)) & np.uint64(1)).sum()) * 2 > len(hashes))
        assert r.sim & (2**64 - 1) == expected


def test_archives_with_lost_swapped_and_foreign_records(spark, tmp_path):
    def archive(name, parts):
        path = tmp_path / name
        path.write_bytes(b"".join(parts))
        return f"file://{path}"

    body = b"word " * 3000
    block = warc.HTTP_HEAD + warc.chunked(body)
    cuts = [block[i : i + 4000] for i in range(0, len(block), 4000)]

    def segments(page, keep):
        for i in keep:
            head = {"WARC-Record-ID": f"<u:{page}:{i}>", "WARC-Segment-Number": i, "WARC-Type": "continuation", "WARC-Segment-Origin-ID": f"<u:{page}:1>"}
            if i == 1:
                head = {"WARC-Type": "response", "WARC-Record-ID": f"<u:{page}:1>", "X-Page-Id": page, "WARC-Segment-Number": 1}
            if i == len(cuts):
                head["WARC-Segment-Total-Length"] = len(block)
            yield warc.record(head, cuts[i - 1])

    n = len(cuts)
    everything = list(range(1, n + 1))
    foreign = [warc.record({"WARC-Type": "warcinfo"}, b"x"), warc.record({"WARC-Type": "request"}, b"GET /"), warc.record({"X-Nothing": 1}, b"?"), gzip.compress(b"WARC/1.1\r\nWARC-Type: response\r\n\r\n")]
    paths = [
        archive("swapped", segments(1, everything[::-1])), archive("lost", segments(2, everything[:1] + everything[2:])),
        archive("twice", [*segments(3, everything), *segments(3, [2])]), archive("foreign", foreign), archive("empty", []),
        archive("cut", [warc.record({"WARC-Type": "response", "X-Page-Id": 4}, block), warc.record({"WARC-Type": "response", "X-Page-Id": 5}, block)[:-900]]),
    ]
    found = {r.page_id: r for r in warc.read_warc(spark.createDataFrame([(p,) for p in paths], "path string")).collect()}
    assert set(found) == {1, 2, 3, 4}
    for page, good in ((1, True), (2, False), (3, False), (4, True)):
        r = found[page]
        assert r.valid == good and (r.payload_digest, r.payload_bytes) == ((hashlib.sha256(body).hexdigest(), len(body)) if good else (None, None))


def test_toxicity_of_nothing_and_of_clashing_columns(spark):
    labels = spark.createDataFrame([(i, i % 2) for i in range(80)], "doc_id long, toxic int")
    rows = [(i, prose(i, 20) + (" you scummish fool" * 3 if i % 2 else ""), 1.5, "r", [2.5]) for i in range(80)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, probability double, raw string, x array<double>")
    found = toxicity.toxicity(docs, labels, F.lit(True), keep_columns=True)
    assert found.columns == [*docs.columns, "score"]
    assert {(r.probability, r.raw, tuple(r.x)) for r in found.collect()} == {(1.5, "r", (2.5,))}
    assert toxicity.toxicity(docs.limit(0), labels, F.lit(True)).count() == 0


def test_a_hot_source_is_dealt_out(spark):
    docs = spark.range(4000).select(F.col("id").alias("doc_id"), F.lit("t").alias("text"), F.when(F.col("id") % 10 < 9, "hot").otherwise("cold").alias("source"))
    found = mixing.mix(docs, {"hot": 3, "cold": 1}, block_docs=4)
    assert found.count() == 4000 and found.select("slot", "block_pos").distinct().count() == 4000
    plan = found._jdf.queryExecution().executedPlan().toString()
    assert "_prefix" in plan and "Python" not in plan


def test_bounds_of_pivots_are_never_low():
    r = np.random.default_rng(2)
    for scale in (1.0, 256.0, 2.0**30):
        v, q = np.floor(scale * r.normal(size=(300, 24))), np.floor(scale * r.normal(size=(20, 24)))
        v[0] = q[0]
        for count in (0, 1, 6, 40):
            guide = search.Pivots(search.pivots_of(v, count))
            table, told = guide.table(v), guide.table(q)
            off = search.slack(told[:, 0], table[:, 0], 24)
            for i in range(len(q)):
                exact = [sum(int(a) * int(b) for a, b in zip(q[i], x, strict=True)) for x in v]
                bounds = search.upper_bounds(told[i], table, off)
                assert all(Fraction(b) >= s for b, s in zip(bounds.tolist(), exact, strict=True))
                # No single pivot's bound is below that of all.
                assert all((bounds <= search.upper_bounds(told[i, [0, j]], table[:, [0, j]], off)).all() for j in range(1, len(guide.rows)))


def test_search_stops_early_and_exactly():
    """Clusters: most rows are left out by a range of distances to one pivot or by the bounds, and the best stay those of all rows."""
    r = np.random.default_rng(4)
    middles = 2000 * r.normal(size=(30, 16))
    v = np.floor(middles[r.integers(0, 30, 3000)] + r.normal(size=(3000, 16)) * 50)
    ids, guide = np.arange(3000), search.Pivots(search.pivots_of(v, 20))
    table = guide.table(v)
    order = np.argsort(table[:, -1], kind="stable")
    work = 0
    for i in range(0, 3000, 100):
        q, want = v[i], search.Best(5)
        want.add((v @ q).astype(np.int64)[ids != i], ids[ids != i])
        off = search.slack(guide.table(q[None])[:, 0], table[:, 0], 16)
        for floor in (-np.inf, want.floor(), float(want.score[0])):
            best = search.Best(5)
            taken, done = search.evaluate(best, q, i, guide.table(q[None])[0], v[order], ids[order], table[order], off, floor)
            keep = want.score >= floor
            got = best.score >= floor
            assert best.id[got].tolist() == want.id[keep].tolist() and best.score[got].tolist() == want.score[keep].tolist()
            work += done
        assert taken < 3000 * len(guide.rows)
    assert work < 0.5 * 90 * 3000


SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, raw string, x array<int>, probability double, score int, items string, spans int, clean_text int, n_hit int, slot string, block int, release date, _gone int, label int"


@pytest.fixture(scope="module")
def odd(spark, tmp_path_factory):
    """A folder of tables: documents with nulls, empty, long, repeated and toxic ones, and columns whose names the operators use."""
    folder = str(tmp_path_factory.mktemp("odd"))
    passage = prose(700, 25)
    texts = [(i, prose(i, 40) + (" you scummish fool" * 4 if i % 4 == 0 else "")) for i in range(80)]
    texts += [(100, None), (101, ""), (102, " \n"), (None, "no id " + prose(300, 20)), (None, None), (103, prose(400, 30_000)), (1, prose(1, 40)), (104, prose(1, 40) + " end")]
    texts += [(105, f"{prose(500, 30)} {passage} {prose(501, 20)}"), (106, passage)]
    rows = [(d, t, "en", ("a", "b", None)[i % 3], None if t is None else len(t), "r", [1, None], 0.5, 7, "i", 3, 4, 5, "s", 6, None, 8, 9) for i, (d, t) in enumerate(texts)]
    spark.createDataFrame(rows, SCHEMA).write.parquet(f"{folder}/documents.parquet")
    spark.createDataFrame([(i, int(i % 4 == 0), int(i % 4 > 0)) for i in range(80)] + [(None, 1, 1), (103, None, None)], "doc_id long, toxic int, quality int").write.parquet(f"{folder}/labels.parquet")
    spark.createDataFrame([(1, passage), (2, None), (None, "x")], "item_id long, text string").write.parquet(f"{folder}/benchmark.parquet")
    return folder


def test_stages_keep_columns_and_what_they_must(spark, odd):
    docs = spark.read.parquet(f"{odd}/documents.parquet")
    given = docs.collect()
    for name, stage in corpus_pipeline.STAGES[:-1]:
        empty = stage(spark, docs.limit(0), odd)
        assert empty.count() == 0 and empty.columns == docs.columns, name
        out = stage(spark, docs, odd)
        assert out.columns == docs.columns and [t for _, t in out.dtypes] == [t for _, t in docs.dtypes], name
        rows = out.collect()
        same = {(r.doc_id, r.source, r.raw, tuple(r.x), r.probability, r.score, r.items, r.spans, r.slot, r.block, r._gone, r.label) for r in rows}
        assert same <= {(r.doc_id, r.source, r.raw, tuple(r.x), r.probability, r.score, r.items, r.spans, r.slot, r.block, r._gone, r.label) for r in given}, name
        ids = sorted(str(r.doc_id) for r in rows)
        if name == "toxicity":
            assert {str(r.doc_id) for r in given} - set(ids) <= {str(i) for i in range(0, 80, 4)} and len(ids) <= len(given) - 15
        elif name == "near-dedup":
            assert sorted({str(r.doc_id) for r in given} - set(ids)) == ["104"] and ids.count("1") == 2
        elif name == "decontamination":
            assert len(rows) == len(given)
            texts = {r.doc_id: (r.text, r.n_chars) for r in rows if r.doc_id is not None}
            assert texts[106] == ("", 0) and prose(500, 30) in texts[105][0] and prose(700, 25) not in texts[105][0] and texts[105][1] == len(texts[105][0])
            assert all(texts[i] == (r.text, r.n_chars) for r in given if (i := r.doc_id) is not None and i not in (105, 106))
        else:
            assert sorted(map(str, rows)) == sorted(map(str, given))


def test_last_stage_writes_every_document(spark, odd):
    from tokenizers import Tokenizer

    import public_tokenizers

    docs = spark.read.parquet(f"{odd}/documents.parquet")
    stage = corpus_pipeline.STAGES[-1][1]
    assert stage(spark, docs.limit(0), odd).count() == 0
    rows = stage(spark, docs, odd).orderBy("start").collect()
    assert len(rows) == docs.count() and rows[0].start == 0 and all(a.start + a.n_tokens == b.start for a, b in zip(rows, rows[1:], strict=False))
    tokenizer, expected = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json")), []
    for r in docs.collect():
        ids = np.array([*tokenizer.encode(r.text or "", add_special_tokens=False).ids, 0], "<u4")
        expected.append((str(r.doc_id), len(ids), zlib.crc32(ids.tobytes())))
    assert sorted((str(r.doc_id), r.n_tokens, r.ids_crc32) for r in rows) == sorted(expected)
    order = [r.doc_id for r in mixing.mix(docs.select("doc_id", "text", "source"), mixing.WEIGHTS).orderBy("slot", "block_pos").collect()]
    assert [r.doc_id for r in rows] == order
