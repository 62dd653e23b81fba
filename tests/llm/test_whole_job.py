"""Cases that an operator once left out."""

import random
import zlib

import numpy as np
from pyspark.sql import functions as F

from tripline.llm import components, line_dedup, near_dedup, tokens, toxicity

WORDS = [a + b + c for a in ("ka", "lo", "mi", "tu", "re") for b in ("n", "s", "rt", "ll") for c in ("o", "ae", "im", "us")]


def documents(spark, rows):
    return spark.createDataFrame(rows, "doc_id long, text string")


def test_lines_with_a_changed_word_are_linked(spark):
    rows, r = [], random.Random(5)
    for i in range(60):
        words = [r.choice(WORDS) for _ in range(10 + i % 3 * 10)]
        other = list(words)
        other[r.randrange(len(words))] = "zzq"
        rows += [(2 * i, " ".join(words)), (2 * i + 1, " ".join(other))]
    found = {x.doc_id: x.removed for x in line_dedup.removed_lines(documents(spark, rows)).collect()}
    lost = [i for i in range(60) if found[2 * i + 1] != [0]]
    assert len(lost) <= 1 and all(found[2 * i] == [] for i in range(60))


def test_short_lines_and_every_document(spark, tmp_path):
    rows = [(1, "Home\nContact us!\n"), (2, "home\ncontact us"), (3, "我们今天去公园散步看花然后回家吃饭"), (4, "我们今天去公园散步看花然后回家喝饭"), (5, None), (6, "contact ux\nabcde"), (7, "abde")]
    documents(spark, rows).write.parquet(f"{tmp_path}/documents.parquet")
    found = {x.doc_id: x for x in line_dedup.op5_fuzzy_lines(spark, str(tmp_path)).collect()}
    assert {i: x.removed for i, x in found.items()} == {1: "", 2: "0,1", 3: "", 4: "0", 5: "", 6: "0", 7: "0"}
    assert (found[1].n_lines, found[1].n_judged, found[5].n_lines) == (3, 2, 0)
    classes = {i: x.classes.split(",") for i, x in found.items()}
    assert classes[1] == [*classes[2], ""] and classes[3] == classes[4] and classes[6] == [classes[1][1], classes[7][0]]


def test_encoder_finds_added_tokens(spark):
    import public_tokenizers
    from tokenizers import Tokenizer

    path = public_tokenizers.path("byte_bpe_50k.json")
    tokenizer, encoder = Tokenizer.from_file(path), tokens.Encoder(path, added=True)
    texts = ["one <|endoftext|> two", "one two", "<|endoftext|>", "a b " * 300 + "x <|endoftext|> y" + " c d" * 300]
    expected = [tokenizer.encode(t, add_special_tokens=False).ids for t in texts]
    assert expected[0] == [505, 220, 50256, 734]
    assert [x.tolist() for x in encoder.encode(texts, 100)] == expected


def test_query_finds_added_tokens(spark, tmp_path):
    import public_tokenizers
    from tokenizers import Tokenizer

    documents(spark, [(1, "one <|endoftext|> two"), (2, "three")]).write.parquet(f"{tmp_path}/documents.parquet")
    tokenizer = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    rows = tokens.op4_token_files(spark, str(tmp_path)).orderBy("doc_id").collect()
    for r, t in zip(rows, ("one <|endoftext|> two", "three"), strict=True):
        ids = np.array([*tokenizer.encode(t, add_special_tokens=False).ids, 0], "<u4")
        assert (r.n_tokens, r.ids_crc32) == (len(ids), zlib.crc32(ids.tobytes()))


def test_low_bits_of_minima_are_independent():
    r, low = np.random.default_rng(3), []
    for _ in range(600):
        h = r.integers(0, 2**64, 8, dtype=np.uint64)
        one, other = near_dedup.minima(h[:7]), near_dedup.minima(h[[0, 1, 2, 3, 4, 5, 7]])
        differ = one != other
        a, b = near_dedup.low_bits(one), near_dedup.low_bits(other)
        low.append((a[differ] == b[differ]).mean())
    assert abs(np.mean(low) - 0.25) < 0.02 and np.std(low) < 0.1


def test_toxicity_of_held_out_documents(spark):
    folder = "/root/testdata/sf0.1"
    found = toxicity.op7_toxicity(spark, folder).where("held_out")
    labels = spark.read.parquet(f"{folder}/labels.parquet").where("toxic is not null").select("doc_id", "toxic")
    counts = {(x.toxic, x.predicted): x["count"] for x in found.join(labels, "doc_id").groupBy("toxic", "predicted").count().collect()}
    assert counts[1, 1] >= 0.9 * (counts[1, 1] + counts.get((1, 0), 0))
    assert counts.get((0, 1), 0) <= 0.01 * counts[0, 0]


def test_dealt_rows_are_joined_without_a_broadcast(spark):
    """Loops join hundreds of small frames; broadcast, each takes memory of the driver."""
    rows, labels = spark.range(1000), spark.range(100).withColumn("label", F.col("id") % 7)
    for kind in ("inner", "left", "left_semi", "left_anti"):
        joined = rows.join(components.dealt(labels, "id"), "id", kind)
        assert joined.count() == (1000 if kind == "left" else 900 if kind == "left_anti" else 100)
        plan = joined._jdf.queryExecution().executedPlan().toString()
        assert "SortMergeJoin" in plan and "Broadcast" not in plan


def test_near_simhashes_have_sizes_that_allow_a_link(spark):
    """Pairs that their sizes rule out go where they are found, before anything is joined or shuffled for them."""
    rows = [(0, 1, 100, None), (1, 2, 30, None), (2, 3, 110, None), (4, 4, 100, 9), (8, 5, 100, 9)]
    sims = spark.createDataFrame(rows, "sim long, id long, size int, label long")
    found = {(r.a, r.b) for r in line_dedup.near_sims(sims, 0.8).collect()}
    assert found == {(1, 3), (1, 4), (1, 5), (3, 4), (3, 5)}  # 2 is too short, 4 and 5 are linked already
    assert all(2 not in (r.a, r.b) for r in line_dedup.near_sims(sims, 0.8, line_dedup.FIRST).collect())


def test_keys_hold_near_lines_and_few_others(spark):
    """Pairs of SimHashes' blocks were shared by lines that have nothing but frequent words in common: more pairs than lines, over 0.1 GB."""
    r = random.Random(11)
    words = [r.choice(WORDS[:12]) if r.random() < 0.5 else f"{r.choice(WORDS)}{r.choice(WORDS)}" for _ in range(30 * 400)]
    rows = [(i, words[30 * i : 30 * i + 30]) for i in range(400)]
    rows += [(400 + i, [*x[: i % 30], "zzq", *x[i % 30 + 1 :]]) for i, x in rows[:200]]
    lines = spark.createDataFrame(rows, "id long, words array<string>").withColumn("hashes", F.transform("words", lambda w: F.hash(w)))
    nodes = line_dedup.least_keys(lines, "hashes", "keys").withColumns({"size": F.lit(150), "label": F.lit(None).cast("long")})
    found = {(x.a, x.b) for x in line_dedup.near_sims(nodes, 0.8, buckets=F.col("keys")).collect()}
    links = {(i, 400 + i) for i in range(200)}
    assert len(links & found) >= 196 and len(found - links) <= 20


def test_pieces_bound_the_edits_of_long_lines(spark):
    r, rows = random.Random(2), []
    for i in range(8):
        one = "".join(r.choice("abcdefgh ") for _ in range(2500 + 100 * i))
        other = "".join("" if (x := r.random()) < 0.01 * i / 2 else c + "z" if x < 0.01 * i else c for c in one)
        rows.append((one, other))
    rows.append((rows[0][0], rows[1][0]))
    found = spark.createDataFrame(rows, "a string, b string").select(line_dedup.edits_of_pieces(F.col("a"), F.col("b")).alias("most"), F.levenshtein("a", "b").alias("d"), F.length("a").alias("n")).collect()
    assert all(x.d <= x.most for x in found) and all(x.most <= 0.2 * x.n for x in found[:6]) and found[0].most == 0
