"""Small fixtures with nulls, empty and long texts, ties, repeated rows and clashing columns."""

import hashlib
import io
import random
import re
import zlib

import numpy as np
import pandas as pd
import public_tokenizers
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

import corpus_pipeline
from tidewatch.llm import decontamination, jaccard_join, language_id, line_dedup, mixing, quality_classifier, quality_rules, token_blocks, token_counts, warc
from tidewatch.llm.fm_index import FMIndex, suffix_order

SF = "/root/testdata/sf0.001"
BYTE_BPE = public_tokenizers.path("byte_bpe_50k.json")
WORD_BPE = public_tokenizers.path("word_bpe_49k.json")
rng = random.Random(3)
VOCAB = ["".join(rng.choice("abcdefghijklmnop") for _ in range(rng.randint(2, 8))) for _ in range(400)]


def prose(n, seed):
    r = random.Random(seed)
    return " ".join(r.choice(VOCAB) for _ in range(n))


PASSAGE = prose(60, 1)
ITEM = prose(14, 2)
LONG = prose(6000, 3)
ROWS = [
    (1, prose(80, 10) + "\n" + PASSAGE + "\n" + prose(20, 11), "en", "s0"),
    (2, prose(70, 12) + "\n" + PASSAGE + "\n" + prose(9, 13), "en", "s0"),
    (3, prose(90, 14) + " " + ITEM.upper() + " é ü " + prose(30, 15), None, "s1"),
    (4, prose(90, 16), "de", None),
    (5, prose(90, 16), "de", "s1"),
    (6, prose(90, 16) + " one more", "de", "s1"),
    (7, LONG, "en", "s2"),
    (7, LONG, "en", "s2"),
    (8, None, "en", "s2"),
    (9, "", None, "s2"),
    (10, "a b", "fr", "s2"),
    (None, prose(60, 17), "fr", "s2"),
    (11, "12 34 !! \t\r\n \x0b 7", "fr", "s3"),
    (12, "x" * 40_000, "fr", "s3"),
    (13, prose(12, 18) + " " + " ".join(["same words come here again"] * 6), "en", "s3"),
]


@pytest.fixture(scope="module")
def docs(spark):
    plain = spark.createDataFrame(ROWS, "doc_id long, text string, lang string, source string")
    for extra in ("TEXT", "score", "kept", "n_words", "Doc_Id", "pattern", "copies", "rep", "bucket", "__row"):
        plain = plain.withColumn("extra_" + extra, F.lit("?"))
    names = [c.removeprefix("extra_") for c in plain.columns]
    return plain.toDF(*names)


@pytest.fixture(scope="module")
def nothing(docs):
    return docs.limit(0)


@pytest.fixture(scope="module")
def labels(spark):
    return spark.createDataFrame([(1, 1, 0), (1, 1, 0), (2, 1, 0), (4, 0, 1), (13, 0, 0), (None, 1, 0), (5, None, None)], "doc_id long, quality int, toxic int")


def rows(df):
    return sorted((tuple(r) for r in df.collect()), key=repr)


def test_classifier(docs, labels, nothing):
    net = quality_classifier.fit(docs, labels, epochs=1)
    got = quality_classifier.score_documents(docs, net).toPandas()
    assert len(got) == len(ROWS) and got.score.between(0, 1).all()
    assert (got.predicted == (got.score >= 0.3)).all()
    assert all(h == (zlib.crc32(("" if pd.isna(d) else str(int(d))).encode()) % 5 == 0) for d, h in zip(got.doc_id, got.held_out))
    assert quality_classifier.score_documents(nothing, quality_classifier.fit(nothing, labels.limit(0))).count() == 0


def test_classifier_gradients():
    net, r = quality_classifier.ByteNet(), np.random.default_rng(0)
    net.w = {k: v.astype(np.float64) for k, v in net.w.items()}
    chunks, doc, y = r.integers(0, 257, (5, 40)), np.array([0, 0, 1, 2, 2]), np.array([1.0, 0.0, 1.0])

    def loss():
        z = net.document_vectors(net.pooled(chunks), doc) @ net.w["out"] + net.w["bias"]
        return float(np.mean(np.log1p(np.exp(z)) - y * z))

    found = net.gradients(chunks, doc, y)
    for name, w in net.w.items():
        for at in r.integers(0, w.size, 6):
            old, step = w.flat[at], 1e-5
            w.flat[at] = old + step
            up = loss()
            w.flat[at] = old - step
            down = loss()
            w.flat[at] = old
            assert found[name].flat[at] == pytest.approx((up - down) / (2 * step), abs=1e-4)


def test_language_gradients():
    net, r = language_id.LanguageNet(["a", "b", "c"]), np.random.default_rng(0)
    net.w = {k: v.astype(np.float64) for k, v in net.w.items()}
    chunks, y = r.integers(0, 257, (4, 9)), np.array([0, 1, 2, 1])

    def loss():
        p, _ = net.positions(chunks)
        real = chunks.T != language_id.PAD
        return float(-np.log(p[:, np.arange(4), y])[real].sum() / real.sum())

    found = net.gradients(chunks, y)
    for name, w in net.w.items():
        for at in r.integers(0, w.size, 6):
            old, step = w.flat[at], 1e-3
            w.flat[at] = old + step
            up = loss()
            w.flat[at] = old - step
            down = loss()
            w.flat[at] = old
            assert found[name].flat[at] == pytest.approx((up - down) / (2 * step), abs=2e-3)


def test_languages(spark, docs, nothing):
    net = language_id.fit(docs, steps=20)
    got = {r[0]: r for r in language_id.predict_languages(docs, net).collect()}
    assert len(language_id.predict_languages(docs, net).collect()) == len(ROWS)
    for d in (8, 9, 11):
        assert (got[d].lang_pred, got[d].score) == ("und", 0.0)
    assert all(0 <= r.score <= 1 for r in got.values())
    empty = language_id.fit(nothing)
    assert {r.lang_pred for r in language_id.predict_languages(docs, empty).collect()} == {"und"}


def test_held_out_accuracy(spark):
    d = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    got = language_id.predict_languages(d, language_id.fit(d)).join(d, "doc_id").where("held_out AND lang IS NOT NULL").selectExpr("avg(int(lang_pred = lang)) a").first().a
    assert got > 0.97
    known = spark.read.parquet("/root/testdata/sf0.01/labels.parquet")
    scored = quality_classifier.score_documents(d, quality_classifier.fit(d, known)).join(known, "doc_id").where("held_out").toPandas()
    assert (scored.predicted == scored.quality).mean() > 0.93


def test_models_learn_from_the_ends_of_long_texts(spark):
    """What tells the labels apart begins after 4,200 bytes of text that is alike."""
    data = [(i, prose(1100, i)[:4200] + (" QXZ WVJ" if i % 2 else " 0941 2b") * 300, i % 2, "ab"[i % 2]) for i in range(60)]
    d = spark.createDataFrame(data, "doc_id long, text string, quality int, lang string")
    net = quality_classifier.fit(d, d.select("doc_id", "quality"))
    scores = {r.doc_id: r.score for r in quality_classifier.score_documents(d, net).collect()}
    assert all(v > 0.9 if i % 2 else v < 0.1 for i, v in scores.items())
    tails = spark.createDataFrame([(i, text[4200:], lang) for i, text, _, lang in data], "doc_id long, text string, lang string")
    got = language_id.predict_languages(tails, language_id.fit(d.select("doc_id", "text", "lang"), steps=150)).collect()
    assert all(r.lang_pred == "ab"[r.doc_id % 2] for r in got)



def test_token_counts(docs, nothing):
    whole = token_counts.Encoder(BYTE_BPE).count([t or "" for _, t, *_ in ROWS])
    want = sorted(((d, len((t or "").encode()), n, n > 512) for (d, t, *_), n in zip(ROWS, whole)), key=repr)
    got = token_counts.count_tokens(docs, BYTE_BPE, chunk=500, overlap=16).select("doc_id", "n_bytes", "n_tokens", "over_limit")
    assert rows(got) == want
    assert token_counts.count_tokens(nothing, BYTE_BPE).count() == 0


ENCODER = token_counts.Encoder(BYTE_BPE)


@settings(max_examples=60, deadline=None)
@given(st.text(alphabet=st.sampled_from(list("ab ' \n\té<|>endoftx7.s")), max_size=300), st.integers(5, 40), st.integers(1, 8))
def test_spliced_chunks_equal_one_call(text, chunk, overlap):
    text += "<|endoftext|> "
    assert token_counts.encode_huge(ENCODER, text, chunk, overlap) == ENCODER.tokenizer.encode(text, add_special_tokens=False).ids


@settings(max_examples=200, deadline=None)
@given(st.lists(st.text(alphabet=st.sampled_from(list("ab ' \n\té<|>endoftx7.s\x0b\x1c\xa0\u2003\r")), max_size=80), max_size=6))
def test_counts_by_parts_equal_one_call(texts):
    texts = [t + "<|endoftext|> \n" + t for t in texts] + ["", " ", "\xa0 "]
    assert ENCODER.count_by_parts(texts) == [len(ENCODER.tokenizer.encode(t, add_special_tokens=False)) for t in texts]


def test_words_seen_are_not_encoded_again():
    encoder = token_counts.Encoder(BYTE_BPE)
    first, again = prose(500, 21), prose(3, 21) + "\n" + prose(2000, 21)
    want = encoder.count([first, again])
    asked, count = [], encoder.count
    encoder.count = lambda texts: asked.extend(texts) or count(texts)
    assert encoder.count_by_parts([first, again, first]) == want + want[:1]
    assert len(asked) == len(set(asked)) <= 2 * len(VOCAB) + 2


def brute_rules(text):
    words = re.findall(r"[^\x20\x09-\x0D]+", text or "")
    windows = [tuple(words[i : i + 5]) for i in range(len(words) - 4)]
    covered = {i + k for i, w in enumerate(windows) if windows.count(w) > 1 for k in range(5)} if len(windows) < 500 else set()
    lines = [x for x in (text or "").split("\n") if re.search(r"[^\x20\x09-\x0D]", x)]
    return len(words), sum(map(len, words)), len(re.findall(r"[#*$%&|<>]", text or "")), len(lines) - len(set(lines)), len(covered)


def test_quality_rules(docs, labels, nothing):
    got = quality_rules.quality_rules(docs, labels).select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed")
    want = []
    for d, t, *_ in ROWS:
        n, c, s, u, r = brute_rules(t)
        want.append((d, n, c, s, u, r, n < 10 or 100 * r > 20 * n))
    assert rows(got) == sorted(want, key=repr)
    kept = quality_rules.keep_good(docs, labels)
    assert kept.columns == docs.columns
    assert kept.count() == quality_rules.quality_rules(docs, labels).where("kept").count()
    assert quality_rules.quality_rules(nothing, labels).count() == 0
    assert {r.score_micro for r in quality_rules.quality_rules(docs, labels.limit(0)).collect()} == {0}


def test_archives(spark):
    data = [(3, "u", "p" * 200), (1, "v\n w", "p" * 200), (2, None, "p" * 200), (4, "x", None), (5, "y", ""), (6, "z", "short"), (7, "z", "short"), (None, "n", "q" * 150), (8, "é", "q" * 150), (9, "long", "é\r\n\r\n" * 90_000), (1, "v", "p" * 200)]
    pages = spark.createDataFrame(data, "page_id long, url string, html string").withColumn("payload", F.lit(1)).withColumn("record_type", F.lit(2))
    got = rows(warc.archive_pages(pages))
    want = []
    for page, _, html in data:
        raw = (html or "").encode()
        first = {200: 1, 150: 8}.get(len(raw), page)
        again = first != page
        want.append((page, len(raw), hashlib.sha256(raw).hexdigest(), "revisit" if again else "response", first if again else None))
    assert got == sorted(want, key=repr)
    assert warc.archive_pages(pages.limit(0)).count() == 0


def test_normaliser_makes_members():
    import gzip

    record = lambda n, body: b"WARC/1.1\r\nWARC-Type: response\r\nX-Page-Id: %d\r\nContent-Length: %d\r\n\r\n%s\r\n\r\n" % (n, len(body), body)
    bodies = [b"", b"a" * 300_000, bytes(range(256)) * 40]
    stream = gzip.compress(b"".join(record(i, b) for i, b in enumerate(bodies[:2]))) + gzip.compress(record(2, bodies[2]))
    target = io.BytesIO()
    index = list(warc.rewrite(io.BytesIO(stream), target))
    for (number, offset, length, kind, page), body in zip(index, bodies):
        assert zlib.decompress(target.getvalue()[offset : offset + length], 31) == record(number, body)
        assert (page, kind) == (number, "response")
    with pytest.raises(ValueError):
        list(warc.rewrite(io.BytesIO(gzip.compress(record(0, b"abc")[:-3])), io.BytesIO()))


def test_line_dedup(spark, docs, nothing):
    got = {r.doc_id: r for r in line_dedup.line_dedup(docs, with_text=True).collect()}
    assert len(line_dedup.line_dedup(docs).collect()) == len(ROWS)
    assert got[1].n_deleted == 0 and got[2].deleted_lines == "1" and PASSAGE not in got[2].clean_text
    assert got[5].n_deleted == 1 and got[6].n_deleted == 0 and got[7].n_deleted == 0
    assert got[8].n_lines == 1 and got[9].clean_text == ""
    assert line_dedup.line_dedup(nothing).count() == 0
    # a run of short lines is extended over its whole length, blank lines between do not matter
    run = [prose(8, 50 + k) for k in range(9)]
    two = spark.createDataFrame([(1, "\n".join(["head", *run, "tail a"])), (2, "\n".join(["other", *run[:4], " ", *run[4:], "tail b"])), (3, "\n".join(run[:3]))], "doc_id long, text string")
    found = {r.doc_id: (r.n_deleted, r.deleted_lines) for r in line_dedup.line_dedup(two).collect()}
    assert found == {1: (0, ""), 2: (9, "1,2,3,4,6,7,8,9,10"), 3: (0, "")}


def test_suffix_order_and_index():
    r = np.random.default_rng(1)
    for top in (1, 2, 5):
        words = r.integers(0, top, 300).astype(np.uint64)
        words[100:180] = words[:80]
        lengths = np.array([0, 50, 130, 0, 120])
        index = FMIndex(words, lengths)
        ends = np.cumsum(lengths)
        texts = [words[e - n : e].tolist() for e, n in zip(ends, lengths)]
        for size in (1, 2, 3, 10):
            phrases = np.array([words[k : k + size] for k in (0, 55, 120, 200)])
            low, high = index.find(index.number(phrases.reshape(-1)).reshape(phrases.shape))
            for p, a, b in zip(phrases.tolist(), low, high):
                want = sorted(int(index.doc_starts[d]) + i for d, t in enumerate(texts) for i in range(len(t) - size + 1) if t[i : i + size] == p)
                assert sorted(index.locate(np.arange(a, b)).tolist()) == want
    symbols = np.array([2, 2, 2, 2, 1, 2, 2, 0])
    assert suffix_order(symbols).tolist() == sorted(range(8), key=lambda i: symbols[i:].tolist())


def test_decontamination(spark, docs, nothing):
    items = spark.createDataFrame([("q1", ITEM), ("q2", "A  B!"), ("q3", None), ("q4", "..."), (None, prose(12, 16)), ("q1", ITEM)], "item_id string, text string")
    got = {r.doc_id: r for r in decontamination.contamination(docs, items, shard_bytes=2000).collect()}
    assert len(got) == len({r[0] for r in ROWS})
    assert (got[3].n_hit, got[3].items, got[3].items_sha256) == (14, ["q1"], hashlib.sha256(b"q1").hexdigest())
    assert ITEM.upper() not in decontamination.without_spans(ROWS[2][1], [s.asDict() for s in got[3].spans])
    assert (got[10].n_hit, got[10].items) == (2, ["q2"])
    assert (got[4].n_hit, got[4].n_items, got[4].contaminated) == (12, 0, True)
    assert (got[8].n_words, got[8].n_hit, got[8].items_sha256) == (0, 0, hashlib.sha256(b"").hexdigest())
    assert decontamination.contamination(nothing, items).count() == 0
    assert decontamination.contamination(docs, items.limit(0)).where("contaminated").count() == 0


def test_near_duplicates(docs, nothing):
    got = {r.doc_id: (r.class_id, r.n_links) for r in jaccard_join.near_duplicates(docs).collect()}
    assert got[4] == got[5] == got[6] == (4, 2)
    assert got[1] == (1, 0) and got[7] == (7, 0) and got[8] == (8, 0) and got[None] == (None, 0)
    kept = jaccard_join.one_of_each(docs)
    assert kept.columns == docs.columns
    ids = kept.toPandas().iloc[:, 0].tolist()
    assert sorted(-1 if pd.isna(i) else int(i) for i in ids) == [-1, 1, 2, 3, 4, 7, 8, 9, 10, 11, 12, 13]
    assert jaccard_join.near_duplicates(nothing).count() == 0


def test_a_text_goes_only_when_a_copy_stays(spark):
    """Ids with several texts: near copies X and X', and texts that are nobody's copy."""
    x, y, z, u = prose(90, 40), prose(90, 41), prose(90, 42), prose(90, 43)
    data = [(3, x + " end"), (5, x), (5, y), (5, z), (5, z), (6, u), (6, u + " end"), (7, y + " end"), (8, ""), (8, None), (None, x)]
    data += [(9, prose(40, 50 + i)) for i in range(5)]
    kept = [tuple(r) for r in jaccard_join.one_of_each(spark.createDataFrame(data, "doc_id long, text string")).collect()]
    whole = [(3, x + " end"), (5, y), (5, z), (8, ""), (8, None), (None, x), *data[-5:]]
    assert sorted((r for r in kept if r[0] != 6), key=str) == sorted(whole, key=str)
    assert len([r for r in kept if r[0] == 6]) == 1


def test_large_group_is_cut_into_tiles(spark, monkeypatch):
    monkeypatch.setattr(jaccard_join, "BLOCK_MEMBERS", 8)
    base = prose(120, 70).split()
    texts = []
    for k in range(60):
        w = list(base)
        w[(7 * k) % 110] = f"x{k}"
        texts.append(" ".join(w))
    data = [(k, t) for k, t in enumerate(texts)] + [(100 + k, texts[0]) for k in range(5)]
    got = jaccard_join.near_duplicates(spark.createDataFrame(data, "doc_id long, text string")).toPandas().set_index("doc_id")
    sets = {d: {tuple(t.split()[i : i + 5]) for i in range(len(t.split()) - 4)} for d, t in data}
    for d in (0, 1, 17, 100):
        want = sum(len(sets[d] & sets[o]) / len(sets[d] | sets[o]) >= 0.8 for o in sets if o != d)
        assert got.n_links[d] == want
    assert set(got.class_id) == {0}


def test_pruning_table():
    least = jaccard_join.least_matches(0.8, 1e-6)
    assert least == dict(sorted(least.items())) and all(0 <= m <= k for k, m in least.items())
    assert least[64] > 0.45 * 64


def test_targets_and_flow():
    targets = mixing.source_targets({"a": 10, "b": 100, None: 100}, 315)
    assert targets["a"] == 20 and sum(targets.values()) == pytest.approx(315) and targets[None] == pytest.approx(2 * targets["b"], abs=1e-6)
    flow = mixing.route({"p": (("a", "b"), 10), "q": (("a",), 10)}, {"a": 12, "b": 6})
    assert sum(flow["p"].values()) + sum(flow["q"].values()) == 18
    assert flow["q"]["a"] <= 10 and flow["p"]["b"] == 6  # first readings are used before any second


def test_mix(spark, docs, nothing):
    got = mixing.mix_sources(docs).toPandas()
    size = lambda t: len(re.findall(r"[^\x20\x09-\x0D]+", t or ""))
    assert sorted(got["size"]) == sorted(size(t) for _, t, *_ in ROWS)
    assert (got.taken <= 2 * got["size"]).all()
    assert rows(mixing.mix_sources(docs)) == rows(mixing.mix_sources(docs.repartition(5)))
    out = mixing.mixed_documents(docs)
    assert out.columns == docs.columns and out.count() == got.copies.sum()
    assert mixing.mix_sources(nothing).count() == 0
    whole = mixing.mix_sources(spark.read.parquet(f"{SF}/documents.parquet")).toPandas()
    by = whole.groupby("target").agg(taken=("taken", "sum"), sources=("source_size", "nunique"), big=("size", "max"))
    alone = whole.drop_duplicates(["target", "source_size"]).groupby("target").size()
    assert ((by.taken - by.index * alone).abs() <= by.big * alone).all()


@pytest.mark.parametrize("unit", ["bit", "byte"])
def test_planes(unit):
    r = np.random.default_rng(0)
    for n in (1, 7, 8, 1000):
        ids = r.integers(0, 50_000, n).astype("<u4")
        planes = token_blocks.planes_for(50_000, unit)
        assert (token_blocks.from_planes(token_blocks.to_planes(ids, planes, unit), n, unit) == ids).all()


def test_token_files(docs, nothing):
    folder, manifest = token_blocks.write_token_files(docs, WORD_BPE, block_ids=512, file_ids=2000)
    got = token_blocks.read_token_files(folder, manifest, with_ids=True).orderBy("start").collect()
    tokenizer = token_blocks.WordEncoder(WORD_BPE).tokenizer
    want = {}
    for d, t, *_ in ROWS:
        want.setdefault(d, []).append(tokenizer.encode(t or "", add_special_tokens=False).ids + [1])
    start = 0
    for r in got:
        assert r.ids in want[r.doc_id] and r.start == start and r.n_tokens == len(r.ids)
        assert r.ids_crc32 == zlib.crc32(np.array(r.ids, "<u4").tobytes())
        start += r.n_tokens
    ids = [r.doc_id for r in got]
    assert ids == sorted(ids, key=lambda x: -1 if x is None else x) and len(got) == len(ROWS)
    assert token_blocks.token_files(nothing, WORD_BPE).count() == 0


def test_pipeline(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    at, kept = docs, []
    for _, stage in corpus_pipeline.STAGES:
        at = corpus_pipeline.written(stage(spark, at, SF), "test")
        kept.append(at)
    labels = spark.read.parquet(f"{SF}/labels.parquet")
    assert {r.doc_id for r in kept[0].collect()} == {r.doc_id for r in quality_rules.quality_rules(docs, labels).where("kept").collect()}
    near = jaccard_join.near_duplicates(kept[0])
    assert sorted(r.doc_id for r in kept[1].collect()) == sorted({r.class_id for r in near.collect()})
    items = spark.read.parquet(f"{SF}/benchmark.parquet")
    assert decontamination.contamination(kept[2], items).where("contaminated").count() == 0
    dropped = {r.doc_id for r in kept[1].collect()} - {r.doc_id for r in kept[2].collect()}
    assert dropped == {r.doc_id for r in decontamination.contamination(docs, items).where("contaminated").collect()} & {r.doc_id for r in kept[1].collect()}
    assert all(k.columns == docs.columns for k in kept[:4])
    assert kept[4].count() == kept[3].count()


@pytest.mark.parametrize("stage", range(5))
def test_stages_on_messy_and_empty_documents(spark, docs, nothing, stage):
    name, work = corpus_pipeline.STAGES[stage]
    assert work(spark, nothing, SF).count() == 0
    out = work(spark, docs, SF)
    assert out.count() > 0
    assert stage == 4 or out.columns == docs.columns
