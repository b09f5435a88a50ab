"""Nulls, empty and long texts, ties, repeated rows, empty tables and extra columns, against brute force on small tables."""

import hashlib
import math
import random
from datetime import datetime, timedelta

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from normspark.session import cut, table
from normspark.llm import corpus_tokens, fraction_cutoff, leaked_passages, nearest_vectors, split_overlap, stable_sample, text_quality

RANKS = corpus_tokens.RANKS


def found(df):
    return {tuple(r) for r in df.collect()}


# 1: stable sample

SETTINGS = "name string, seed long, quick_train int, extra string"
MANIFEST = "sample_id string, category string, split string, ingested_at timestamp_ntz, experiment string, slot int"


def manifest(spark, n, start=0):
    at = datetime(2025, 1, 1)
    rows = [(f"s{i:05}", f"c{i % 2}" if i % 3 else "c0", [" Train", "TRAIN ", "train"][i % 3], at + timedelta(minutes=i // 2), "x", 1) for i in range(start, n)]
    return spark.createDataFrame(rows, MANIFEST)


def test_sample_is_the_same_in_any_order_and_stays(spark):
    settings = spark.createDataFrame([("e1", 1, 12, None), ("e2", 2, 12, None), ("none", 3, 0, None), (None, 3, 5, None)], SETTINGS)
    whole = manifest(spark, 300)
    base = found(stable_sample.draw(whole, settings))
    again = whole.unionByName(whole.withColumn("ingested_at", F.col("ingested_at") + F.expr("interval 9 days"))).repartition(5).orderBy(F.rand(2))
    assert found(stable_sample.draw(again, settings)) == base
    counts = {}
    for e, c, *_ in base:
        counts[e, c] = counts.get((e, c), 0) + 1
    # 12 slots of the quota, the last at 42 arrivals, and one more at 84 and at 168
    assert counts == {(e, c): n for e in ("e1", "e2") for c, n in (("c0", 14), ("c1", 13))}
    assert {r[3] for r in base if r[0] == "e1"} != {r[3] for r in base if r[0] == "e2"}
    earlier = set()
    for cut in (7, 20, 33, 61, 120, 299):
        part = found(stable_sample.draw(whole.where(F.col("ingested_at") <= F.lit(datetime(2025, 1, 1) + timedelta(minutes=cut // 2))), settings))
        assert earlier <= part <= base
        earlier = part


def test_ledger_is_kept_and_extended(spark, tmp_path):
    settings = spark.createDataFrame([("e", 1, 10, None)], SETTINGS)
    whole = manifest(spark, 200)
    half = stable_sample.draw(whole.where("ingested_at < timestamp_ntz'2025-01-01 00:12:00'"), settings)
    kept = found(half)
    assert found(stable_sample.draw(whole, settings, half)) == found(stable_sample.draw(whole, settings)) >= kept
    folder = str(tmp_path / "ledger")
    assert found(stable_sample.publish(half, folder)) == kept == found(stable_sample.read(spark, folder))
    assert found(stable_sample.draw(whole, settings, stable_sample.read(spark, folder))) == found(stable_sample.draw(whole, settings))
    foreign = spark.createDataFrame([("e", "c0", 10, "gone", datetime(2024, 1, 1))], half.schema)
    assert ("gone",) in found(stable_sample.draw(whole, settings, foreign).select("sample_id"))


def test_late_records_can_be_drawn(spark):
    """Every slot against a plain replay: the lowest hash among all unseen arrivals at the moment it opens."""
    settings = spark.createDataFrame([("e", 5, 4, None)], SETTINGS)
    whole = spark.createDataFrame([(f"s{i:05}", "c", "train", datetime(2025, 1, 1) + timedelta(minutes=i), "x", 1) for i in range(2000)], MANIFEST)
    opens = [1, 3, 7, 12] + [12 * 2**e for e in range(1, 8)]
    ids, want = [f"s{i:05}" for i in range(2000)], []
    for moment in opens:
        want.append(min((i for i in ids[:moment] if i not in want), key=lambda i: hashlib.sha256(f"5:c:{i}".encode()).hexdigest()))
    got = {r.slot: r.sample_id for r in stable_sample.draw(whole, settings).collect()}
    assert [got[k + 1] for k in range(len(opens))] == want and len(got) == len(opens)
    assert max(got.values()) > "s00100"


def test_sample_of_nulls_and_nothing(spark):
    settings = spark.createDataFrame([("e", None, 3, None)], SETTINGS)
    rows = [(None, "c", "train", datetime(2025, 1, 1), "", 0), ("a", None, "train", datetime(2025, 1, 1), "", 0), ("b", "c", None, datetime(2025, 1, 1), "", 0), ("d", "c", "train", None, "", 0)]
    assert stable_sample.draw(spark.createDataFrame(rows, MANIFEST), settings).count() == 0
    assert stable_sample.draw(spark.createDataFrame([], MANIFEST), settings.limit(0)).count() == 0


# 2: overlaps across splits


def test_overlaps_against_brute_force(spark):
    rng = np.random.default_rng(3)
    base = rng.integers(0, 200, 1024)
    rows, groups = [], []
    for i in range(60):
        thumb = base + rng.integers(0, 40, 1024) if i % 3 else base.copy()
        if i % 5 == 0:
            thumb = thumb.copy()
            thumb[: i % 7] += 3
        bits = 0xF0F0F0F0F0F0F0F0 ^ (1 << (i % 6)) ^ (1 << (40 + i % 3))
        text = [f"{bits:016x}", f"0x{bits:016X}", None][0 if i % 11 else 2] if i % 2 else f"0x{bits:016X}"
        rows.append((f"s{i:03}", "v1", "c", [" Train", "test", "VALIDATION", "excluded", None][i % 5 if i % 13 else 0], f"p{i}", f"0x{i % 20:064X}" if i % 4 else None, text, datetime(2025, 1, 1, 0, i), "clash"))
        if i % 17:
            groups.append((f"p{i}", [int(v) for v in thumb], "clash"))
    groups += [groups[0], ("p1", None, ""), ("p2", [1, 2], ""), (None, [0] * 1024, ""), ("p3", [None] * 1024, "")]
    schema = "sample_id string, dataset_version string, category string, split string, image_path string, image_sha256 string, perceptual_hash string, ingested_at timestamp_ntz, thumbnail string"
    m = spark.createDataFrame(rows + rows[:9], schema)
    g = spark.createDataFrame(groups, "image_path string, thumbnail array<int>, label string")
    limits = spark.createDataFrame([("v1", 2, 0.1)], "dataset_version string, perceptual_max_dhash_distance int, perceptual_max_normalized_mae double")
    side = {r[0]: (r[3] or "").strip().lower() for r in rows}
    thumb = {p: np.array(t) for p, t, _ in groups if p and t and len(t) == 1024 and None not in t}
    low = {p: t - int(t.mean()) for p, t in thumb.items()}
    want = set()
    for a in rows:
        for b in rows:
            if side[a[0]] == "train" and side[b[0]] in ("test", "validation"):
                same = a[5] and b[5] and int(a[5], 16) == int(b[5], 16)
                near = a[6] and b[6] and a[4] in low and b[4] in low and (int(a[6], 16) ^ int(b[6], 16)).bit_count() <= 2 and np.abs(low[a[4]] - low[b[4]]).mean() <= 0.1
                if same or near:
                    want.add((a[0], b[0]))
    assert want
    assert found(split_overlap.overlaps(m, g, limits).select("train_id", "eval_id")) == want
    assert split_overlap.overlaps(m.limit(0), g.limit(0), limits.limit(0)).count() == 0


def test_overlaps_of_an_image_with_several_thumbnails(spark, monkeypatch):
    """Only the thumbnail of the hit counts: a2 looks like the other thumbnail of a1, not like e1."""
    flat, other = [100] * 1024, [0] * 512 + [255] * 512
    at = datetime(2025, 1, 1)
    rows = [(i, "v", "k", split, f"{i}.png", None, "0", at) for i, split in (("a1", "train"), ("a2", "train"), ("e1", "test"))]
    m = spark.createDataFrame(rows, "sample_id string, dataset_version string, category string, split string, image_path string, image_sha256 string, perceptual_hash string, ingested_at timestamp")
    g = spark.createDataFrame([("a1.png", flat), ("a1.png", other), ("a2.png", other), ("e1.png", flat), ("e1.png", flat)], "image_path string, thumbnail array<int>")
    limits = spark.createDataFrame([("v", 2, 0.5)], "dataset_version string, perceptual_max_dhash_distance int, perceptual_max_normalized_mae double")
    for hot in (split_overlap.HOT, 1):  # with grams that are split, too
        monkeypatch.setattr(split_overlap, "HOT", hot)
        assert found(split_overlap.overlaps(m, g, limits).select("train_id", "eval_id")) == {("a1", "e1")}


# 3: neighbours


def test_neighbours_against_brute_force(spark):
    rng = np.random.default_rng(5)
    x = np.repeat(rng.normal(size=(60, 16)), 14, 0) + 0.05 * rng.normal(size=(840, 16))
    x[100:400] = x[100]  # a group of copies
    rows = [(i, [float(v) for v in r], "c") for i, r in enumerate(x)]
    bad = [(9001, None, ""), (9002, [0.0] * 16, ""), (9003, [float("nan")] * 16, ""), (9004, [1.0] * 3, ""), (9005, [None] * 16, ""), (None, [1.0] * 16, "")]
    df = spark.createDataFrame(rows + rows[:50] + bad, "id long, vec array<double>, is_query string").select("id", "vec", "is_query")
    asked = [*range(0, 840, 7), 9001, 9002]
    got = {}
    for r in nearest_vectors.neighbours(df.select("id", "vec"), spark.createDataFrame([(a,) for a in asked], "id long"), 16).collect():
        got.setdefault(r.query_id, []).append((r.place, r.id, r.cosine))
    u = (x / np.linalg.norm(x, axis=1)[:, None]).astype(np.float32)
    hits = total = 0
    for q in range(0, 840, 7):
        c = u @ u[q]
        c[q] = -2
        own = sorted(got[q])
        assert len(own) == 10 and len({i for _, i, _ in own}) == 10 and q not in {i for _, i, _ in own}
        tenth = np.sort(c)[-10]
        hits += sum(c[i] >= tenth - 1e-5 for _, i, _ in own)
        total += 10
    assert hits / total > 0.97 and 9001 not in got and 9002 not in got
    few = nearest_vectors.neighbours(df.select("id", "vec").where("id < 4"), spark.createDataFrame([(0,)], "id long"), 16)
    assert {r.id for r in few.collect()} == {1, 2, 3}
    assert nearest_vectors.neighbours(df.select("id", "vec").limit(0), spark.createDataFrame([(0,)], "id long"), 16).count() == 0


def test_neighbours_under_all_lines_are_exact(spark):
    rng = np.random.default_rng(8)
    x = rng.normal(size=(500, 24))
    df = spark.createDataFrame([(i, [float(v) for v in r]) for i, r in enumerate(x)], "id long, vec array<float>")
    u = x / np.linalg.norm(x, axis=1)[:, None]
    got = found(nearest_vectors.neighbours(df, df.where("id < 20").select("id"), 24, 5, share=1.0).select("query_id", "id"))
    assert got == {(q, int(i)) for q in range(20) for i in np.argsort(-(u @ u[q]))[1:6]}


def test_unsettled_neighbours_do_not_shuffle_the_vectors_again(spark, monkeypatch):
    rng = np.random.default_rng(8)
    x = rng.normal(size=(500, 24))
    rows = [(i, [float(v) for v in r]) for i, r in enumerate(x)]
    rows += [(499, [float(v) for v in x[0] + 0.01 * x[1]])] * 30 + [(3, None)]  # an id delivered often, also with another vector
    df = spark.createDataFrame(rows, "id long, vec array<float>")
    u, delivered = x / np.linalg.norm(x, axis=1)[:, None], (x[0] + 0.01 * x[1]) / np.linalg.norm(x[0] + 0.01 * x[1])
    asked, shuffled, spread = df.where("id < 20").select("id"), [], nearest_vectors._spread
    monkeypatch.setattr(nearest_vectors, "_spread", lambda layout, share: shuffled.append(share) or spread(layout, share))
    want = set()
    for q in range(20):
        cosines = u @ u[q]
        cosines[499] = max(cosines[499], delivered @ u[q])
        want |= {(q, int(i)) for i in np.argsort(-cosines) if i != q}.intersection((q, int(i)) for i in np.argsort(-cosines)[:6])
    got = nearest_vectors.neighbours(df, asked, 24, 5, share=1.0)
    assert found(got.select("query_id", "id")) == want and shuffled == [None]
    half = {(r.query_id, r.id, round(r.cosine, 5)) for r in nearest_vectors.neighbours(df.where("id < 499"), asked, 24, 5).collect()}
    monkeypatch.setattr(nearest_vectors, "SENT", 0)
    assert half == {(r.query_id, r.id, round(r.cosine, 5)) for r in nearest_vectors.neighbours(df.where("id < 499"), asked, 24, 5).collect()} and shuffled[-1] == nearest_vectors.WIDE


# 5: cutoffs

SCORES = "experiment string, model string, category string, sample_id string, split string, label string, score double, cutoff string"


@pytest.mark.parametrize("finish", [1, 7, 256])
def test_cutoffs_against_sorting(spark, finish):
    random.seed(6)
    rows = []
    for c, n in (("big", 400), ("ties", 90), ("one", 1), ("two", 2)):
        for i in range(n):
            score = {"ties": float(i % 4), "big": random.gauss(0, 1e6)}.get(c, float(i))
            rows.append(("e", "m", c, f"{c}{i}", " Validation", "normal", score, "x"))
    odd = [("e", "m", "big", "bad1", "validation", "normal", v, "") for v in (None, float("nan"), float("inf"))]
    odd += [("e", "m", "big", "t", "test", "normal", 9e9, ""), ("e", "m", "big", "a", "validation", "anomaly", 9e9, ""), ("e", None, "big", "z", "validation", "normal", 9e9, ""), ("other", "m2", "big", "z", "validation", "normal", 1.0, "")]
    df = spark.createDataFrame(rows + rows[:40] + odd, SCORES).repartition(6)
    settings = spark.createDataFrame([("e", 0.9, "x"), ("unused", 0.5, "x")], "name string, image_threshold_quantile double, category string")
    base, cut = fraction_cutoff.calibrated(df, settings, finish)
    got = {r.category: (r.n_records, r.cutoff, r.n_kept) for r in fraction_cutoff.report(base, cut).collect()}
    for c in ("big", "ties", "one", "two"):
        own = sorted(r[6] for r in rows if r[2] == c)
        place = own[math.ceil(0.9 * (len(own) - 1))]
        assert got.pop(c) == (len(own), place, sum(v <= place for v in own))
    assert not got
    base, cut = fraction_cutoff.calibrated(df.limit(0), settings)
    assert fraction_cutoff.not_kept(base, cut).count() == 0


# 6: tokens


def test_tokens_of_long_empty_and_null_texts(spark):
    random.seed(7)
    words = ["the", "Größe", " \n\n", "don't", "12345", "検査しました。", "🙂", "\t", "a" * 700, "  ", "<|endoftext|>", "x;y", "\r\n"]
    texts = [None, "", " ", "short", "é" * 5000, "b" * 3000 + " end", " " * 4000, *(" ".join(random.choice(words) for _ in range(n)) for n in (10, 600, 3000))]
    df = spark.createDataFrame([(i, t, "clash") for i, t in enumerate(texts)] + [(8, texts[8], "again"), (None, "null id", ""), (None, texts[9], "")], "doc_id long, text string, ids string")
    out = corpus_tokens.encode_corpus(df).collect()
    with open(RANKS, "rb") as f:
        enc = corpus_tokens.encoder(f.read())
    assert len(out) == len(texts) + 3
    for r in out:
        if r.doc_id is not None:
            assert r.ids == enc.encode_ordinary(texts[r.doc_id] or "")
    back = {r.doc_id: r.text for r in corpus_tokens.decode(corpus_tokens.encode_corpus(df.where("doc_id IS NOT NULL"))).collect()}
    assert back == {i: t or "" for i, t in enumerate(texts)}
    assert corpus_tokens.encode_corpus(df.limit(0)).count() == 0


# 7: leaks


def test_leaks_whole_partial_rewritten_and_near(spark):
    item = "Explain why the operator may keep micro switch V72695 out of the pilot session once the encoder was wiped by hand in room seven"
    short = "Name nine causes"
    docs = {
        1: f"Before. {item} after.",
        2: "so: EXPLAIN  why the oper­ator may\nkeep micro-switch V72695, out of the​ pilot ... end",
        3: "Explain why the operator may keep micro switch V72695 out of something else entirely",
        4: "please NAME nine, causes!",
        5: "Rename nine causes",
        6: "explain why the operator may keep micro switch V72695 out of thy pilot session once",
        7: None,
        8: "",
        9: "x " * 300_000 + item,
    }
    d = spark.createDataFrame([(k, v, "clash") for k, v in docs.items()] + [(1, docs[1], ""), (None, item, "")], "doc_id long, text string, item_id string")
    i = spark.createDataFrame([(10, "s", item), (11, "s", short), (12, "s", None), (13, "s", ""), (14, "s", "..."), (None, "s", item), (10, "s", item)], "item_id long, suite string, text string")
    assert found(leaked_passages.leaks(d, i, exact=True).select("doc_id", "item_id")) == {(1, 10), (2, 10), (4, 11), (9, 10)}
    near = {(r.doc_id, r.item_id): r.edits for r in leaked_passages.leaks(d, i).collect()}
    assert near[6, 10] == 1 and near[1, 10] == 0 and (3, 10) not in near
    assert leaked_passages.leaks(d.limit(0), i).count() == 0 and leaked_passages.leaks(d, i.limit(0)).count() == 0


def least_edits(window, text):
    """Plain dynamic programming: the least edits between the window and any part of the text."""
    row = np.zeros(len(text) + 1, int)
    for c in window:
        new = np.empty_like(row)
        new[0] = row[0] + 1
        best = np.minimum(row[1:] + 1, row[:-1] + (np.array(list(text)) != c))
        for j, b in enumerate(best, 1):
            new[j] = min(b, new[j - 1] + 1)
        row = new
    return int(row.min())


@pytest.mark.parametrize("edits", [0, 1, 2])
def test_near_passages_against_brute_force(spark, edits):
    rng = random.Random(edits)
    words = [f"{a}{b}{c}" for a in "bdfk" for b in "aeio" for c in ("rst", "lm", "nd", "p")]
    items = {i: [rng.choice(words) for _ in range(rng.choice([5, 12, 13, 14]))] for i in range(5)}
    docs = {}
    for d in range(30):
        text = list(" ".join(items[d % 5]))
        for _ in range(rng.randrange(5)):
            k = rng.randrange(len(text))
            text[k : k + 1] = rng.choice([[], [rng.choice("xyz")], [text[k], "q"]])
        docs[d] = " ".join([rng.choice(words) for _ in range(20)]) + " " + "".join(text) + " " + rng.choice(words)
    texts = {d: " ".join(leaked_passages.words_of(t)) for d, t in docs.items()}
    want = set()
    for d, t in texts.items():
        for i, w in items.items():
            size = min(12, len(w))
            for k in range(len(w) - size + 1):
                window = " ".join(w[k : k + size])
                if least_edits(window, t) <= min(edits, len(window) // leaked_passages.Q - 1):
                    want.add((d, i))
    df = spark.createDataFrame(list(docs.items()), "doc_id long, text string")
    held = spark.createDataFrame([(i, " ".join(w)) for i, w in items.items()], "item_id long, text string")
    assert want and found(leaked_passages.leaks(df, held, edits=edits).select("doc_id", "item_id")) == want


def test_alignment():
    assert leaked_passages.aligned("abcdef", "xxabcdefxx", 1) == 0
    assert leaked_passages.aligned("abcdefgh", "xabcdXfghx", 1) == 1
    assert leaked_passages.aligned("abcdefgh", "xabcdfghx", 1) == 1
    assert leaked_passages.aligned("abcdefgh", "xabcd0efghx", 1) == 1
    assert leaked_passages.aligned("abcdefgh", "xaXcdXfghx", 1) is None


# 8: quality

PROSE = "The threshold was kept at noon because the lamp had been changed. Nothing was found on the seal, and it is still in the tray."


def test_quality_flags_lists_tables_and_scrambles_but_not_prose(spark):
    """Known documents among those of a corpus, whose sketches say what is usual."""
    scrambled = "of was the in and on had the is at of because on with it is the was in of and the at had lamp on seal of the in"
    texts = {
        1: PROSE, 2: "- hex nut\n- heat sink\n- end cap", 3: "| a | b |\n| --- | --- |\n| 1 | 2 |", 4: "Left camera needs service. Gasket passed. Night inspector stopped line 6. Day crew counted 615, found 2 defects.", 5: None, 6: "   \n", 7: "a8f3 99c1 00de 12ab", 8: scrambled,
        9: "PLEASE CHECK THE LENS BEFORE THE NEXT PART IS PLACED ON IT.", 10: "Das Relais aus Los 7 ist in Ordnung, aber der Wert bleibt unter 3.", 11: "フィルターを交換した後、傷は見えなくなりました。", 12: PROSE + "\n" + "7;x;y;ok\n" * 60, 13: "",
    }
    corpus = table(spark, "/root/testdata/sf0.1", "documents").select((F.col("doc_id") + 1_000_000).alias("doc_id"), "text", "lang", F.lit("x").alias("n_words"))
    docs = spark.createDataFrame([(k, v, {10: "de", 11: "JA "}.get(k, "EN-en"), "x") for k, v in texts.items()], "doc_id long, text string, lang string, n_words string").unionByName(corpus)
    words = table(spark, "/root/testdata/sf0.01", "common_words").unionByName(spark.createDataFrame([(None, None)], "lang string, word string"))
    out = cut(text_quality.profile(docs, words))
    assert {r.doc_id for r in out.where("not_prose AND doc_id < 1000000").collect()} == {2, 3, 7, 8, 12}
    assert out.count() == docs.count()
    for r in out.where("doc_id IN (5, 6, 13)").collect():
        assert (r.n_words, r.common_share, r.sentence_share, r.not_prose, r.language) == (0, None, None, False, "en")


def test_quality_is_taught_by_all_documents(spark, monkeypatch):
    seen, ratios = [], text_quality.log_ratios

    def counted(prose, junk, n_prose, n_junk, smooth):
        if smooth == 0.5:  # the pair model, one call a round
            seen.append((n_prose, n_junk))
        return ratios(prose, junk, n_prose, n_junk, smooth)

    monkeypatch.setattr(text_quality, "log_ratios", counted)
    monkeypatch.setattr(text_quality, "SAMPLE", 100, raising=False)
    docs = table(spark, "/root/testdata/sf0.01", "documents")
    flags = text_quality.flagged(docs, table(spark, "/root/testdata/sf0.01", "common_words")).where("sentence_share IS NOT NULL").count()
    assert len(seen) == text_quality.ROUNDS and sum(seen[-1]) > 0.8 * flags


def test_tokens_are_kept_whole():
    """Long tokens, blank texts, and documents that are cut apart from their batch give the arrays they were made of."""
    texts = ["x" * 30 + " " + "7" * 5_000 + " a b a b", "", "one two. " * 40, "9" * 4_095 + " " + "9" * 4_094]
    batch = text_quality.Batch(texts)
    bucket, doc, size = batch.pairs()
    tokens, long = text_quality._kept(batch)
    kept = pa.RecordBatch.from_arrays([tokens, long], ["tokens", "long_sizes"])
    for part in (1, 1 << 17):
        parts = list(text_quality._tokens(kept)) if part > 1 else [p for i in range(4) for p in text_quality._tokens(kept.slice(i, 1))]
        assert np.concatenate([p[1] for p in parts]).tolist() == bucket.tolist() and np.concatenate([p[3] for p in parts]).tolist() == size.tolist()
        first = np.concatenate([p[4] for p in parts])
        assert len(set(zip(doc.tolist(), bucket.tolist(), strict=True))) == first.sum() == len({(d, b) for d, b in zip(doc[first].tolist(), bucket[first].tolist(), strict=True)})
    assert np.array_equal(parts[0][2], doc) and parts[0][0] == slice(0, 4)


def test_quality_of_an_empty_and_of_a_tiny_corpus(spark):
    words = spark.createDataFrame([("en", "the")], "lang string, word string")
    docs = spark.createDataFrame([(1, None, None), (1, PROSE, None), (None, PROSE, "de_AT")], "doc_id long, text string, lang string")
    assert text_quality.profile(docs.limit(0), words).count() == 0
    got = text_quality.profile(docs, words).collect()
    assert sorted((str(r.doc_id), r.language, r.n_words) for r in got) == [("1", "und", 0), ("1", "und", 25), ("None", "de", 25)]
    assert not any(r.not_prose for r in got if r.n_words == 0)


def test_plain_statistics(spark):
    """Counted by hand: words are runs of letters; lines end with a mark, also before a closing quote."""
    text = "The cap, it is 12.5 mm.\r\n\r\nnext line\n<p>\"Done!\"</p>"
    docs = spark.createDataFrame([(1, text, "en")], "doc_id long, text string, lang string")
    r = text_quality.document_statistics(docs, spark.createDataFrame([("en", w) for w in ("THE", "is", "it")], "lang string, word string")).first()
    assert r.n_words == 8 and r.mean_word_length == pytest.approx(24 / 8)
    assert r.symbol_ratio == pytest.approx(6 / 33) and r.digit_ratio == pytest.approx(3 / 33)
    assert r.punctuated_lines == pytest.approx(2 / 3) and r.common_share == pytest.approx(3 / 8)
    assert r.words_per_line == pytest.approx(8 / 3)


def test_sketches_merge(spark):
    rows = [(float(i),) * len(text_quality.STATISTICS) for i in range(2000)]
    df = spark.createDataFrame([("en", *r) for r in rows], "language string, " + ", ".join(f"{s} double" for s in text_quality.STATISTICS))
    parts = text_quality.language_sketches(df.where("run_words < 700")).unionByName(text_quality.language_sketches(df.where("run_words >= 700")))
    q = text_quality.quartiles(text_quality.merged_sketches(parts)).where("statistic = 'run_words'").first()
    assert q.n_values == 2000 and abs(q.median - 1000) < 60
