"""Sharding, importance resampling and hard negatives against plain Python on small fixtures."""

import hashlib
import itertools
import math
import os
import random
import re
import time
import zlib
from collections import Counter

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from tests.llm.test_operators import LONG, ROWS, docs, nothing, prose  # noqa: F401
from tidewatch.llm import common, hard_negatives, importance, jaccard_join, line_dedup, mixing, quality_rules, sharding, token_blocks

WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


# sharding


@pytest.fixture(scope="module")
def uneven(spark):
    """One source with a third of all rows, small ones, a null one; a row that repeats 300 times."""
    r = random.Random(5)
    rows = [(i, f"text {r.randint(0, 40)}", "hot") for i in range(400)]
    rows += [(400 + i, None if i % 9 == 0 else prose(3, i), f"s{i % 7}") for i in range(350)]
    rows += [(1000 + i, "", None) for i in range(40)] + [(None, f"n{i}", "s1") for i in range(20)] + [(7777, "again", "s2")] * 300
    return spark.createDataFrame(rows, "doc_id long, text string, source string").repartition(7)


@pytest.mark.parametrize("cell_rows", [40, 100_000])
def test_shards_hold_rows_and_mixture(uneven, cell_rows):
    got = sharding.assign_shards(uneven, 24, cell_rows=cell_rows).toPandas()
    n = uneven.count()
    assert sorted(got.place) == list(range(n))
    counts = got.groupby("shard").size()
    assert len(counts) == 24 and counts.max() - counts.min() <= 1
    for _, own in got.groupby("shard"):
        assert sorted(own.slot) == list(range(len(own)))
    for source, own in got.groupby("source", dropna=False):
        assert sorted(own["rank"]) == list(range(len(own)))
        in_shard = own.groupby("shard").size().reindex(range(24), fill_value=0)
        assert (in_shard - len(own) / 24).abs().max() <= 2.5, source
    assert Counter(got["size"]) == Counter(len((t or "").encode()) + 8 for t in uneven.toPandas()["text"])


def test_shards_do_not_depend_on_cells_or_partitions(uneven):
    columns = ["doc_id", "size", "text_crc32", "shard", "slot"]
    one = sorted(map(repr, sharding.assign_shards(uneven, cell_rows=40).select(columns).collect()))
    two = sorted(map(repr, sharding.assign_shards(uneven.repartition(3, "text")).select(columns).collect()))
    assert one == two
    other = sorted(map(repr, sharding.assign_shards(uneven, seed=12).select(columns).collect()))
    assert one != other


def test_shards_of_odd_tables(spark, docs, nothing, tmp_path):
    assert sharding.row_shards(nothing).collect() == []
    got = sharding.row_shards(docs).toPandas()
    assert len(got) == len(ROWS) and set(got.law) == {"rows"} and got.grown_shard.isna().all() and got.shard.nunique() == len(ROWS)
    assert Counter(got.text_crc32) == Counter(zlib.crc32((r[1] or "").encode()) for r in ROWS)
    back = sharding.write_shards(docs, str(tmp_path / "shards"), n_shards=4, rows_per_file=2)
    assert Counter((r.doc_id, r.text, r.source) for r in back.collect()) == Counter((r[0], r[1], r[3]) for r in ROWS)
    places = sorted((r.shard, r.slot) for r in back.collect())
    assert places == [(s, k) for s in range(4) for k in range(len([p for p in places if p[0] == s]))]


# importance resampling


def features(text, most):
    lowered = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
    w = WORD.findall(lowered)
    return len(w), [zlib.crc32(" ".join(w[i : i + n]).encode()) % 10_000 for n in range(1, most + 1) for i in range(len(w) - n + 1)]


def resampled(rows, target, most, seed=2024, min_words=20, percent=10):
    corpus, aim = Counter(), Counter()
    for _, text in rows:
        corpus.update(features(text, most)[1])
    for text in target:
        aim.update(features(text, most)[1])
    s_all, t_all = sum(corpus.values()), sum(aim.values())
    out = []
    for doc_id, text in rows:
        n, own = features(text, most)
        weight = sum(math.floor(1000 * math.log((aim[b] + 1) * (s_all + 10_000) / ((corpus[b] + 1) * (t_all + 10_000)))) for b in own)
        h = int(hashlib.sha256(f"{seed}:{'' if doc_id is None else doc_id}".encode()).hexdigest()[:8], 16)
        out.append([doc_id, n, len(own), weight, weight + math.floor(-1000 * math.log(-math.log((h + 0.5) / 4294967296)))])
    able = sorted((r for r in out if r[1] >= min_words), key=lambda r: (-r[4], math.inf if r[0] is None else r[0]))
    drawn = able[: percent * len(able) // 100]
    return sorted(map(repr, [(*r, k) for k, r in enumerate(drawn, 1)] + [(*r, None) for r in out if not any(r is d for d in drawn)]))


@pytest.mark.parametrize("most", [1, 3])
def test_resample_is_brute_force(spark, docs, most, monkeypatch):
    monkeypatch.setattr(importance, "ROWS_PER_RANGE", 3)
    aim = [ROWS[0][1], "É Straße 12", None, ""]
    target = spark.createDataFrame([(t, 1) for t in aim], "text string, doc_id int")
    got = importance.resample(docs, target, most_words=most, percent=60).drop("text_hash")
    assert sorted(repr(tuple(r)) for r in got.collect()) == resampled([(r[0], r[1]) for r in ROWS], aim, most, percent=60)


def test_resample_of_odd_tables(docs, nothing, spark):
    assert importance.resample(nothing, docs).collect() == []
    flat = importance.resample(docs, nothing, percent=100)
    assert flat.count() == len(ROWS)
    ranks = sorted(r["rank"] for r in flat.where("rank IS NOT NULL").collect())
    assert ranks == list(range(1, flat.where("n_words >= 20").count() + 1))
    texts = importance.sampled_documents(docs, flat)
    assert sorted(r["rank"] for r in texts.collect()) == ranks
    assert [r.text for r in texts.where("doc_id = 7").collect()] == [LONG, LONG]


@settings(max_examples=60, deadline=None)
@given(st.text(alphabet="aB1 \n\té٣,.<|", max_size=60), st.integers(1, 4), st.integers(1, 9))
def test_pieces_do_not_change_features(text, most, piece):
    made = importance.FeatureBuckets(most)
    old, importance.PIECE_CHARS = importance.PIECE_CHARS, piece
    try:
        n, own = made.of(text)
    finally:
        importance.PIECE_CHARS = old
    n_want, want = features(text, most)
    assert n == n_want and Counter(own.tolist()) == Counter(want)


# hard negatives


def mined(rows):
    fine = []
    for vec_id, vector, label in rows:
        if label is None or vector is None or any(x is None or not math.isfinite(x) for x in vector):
            continue
        if vec_id is not None and vec_id % 7 == 0:
            label = (label + 1) % 10
        fine.append((vec_id, [math.floor(256 * x) for x in vector], label))
    out = []
    last = lambda i: (i is None, i or 0)
    for a, av, al in fine:
        if a is None or a % 100:
            continue
        scored = [(sum(x * y for x, y in zip(av, v)), i, label) for i, v, label in fine]
        own = sorted(((s, i) for s, i, label in scored if label == al and i != a), key=lambda r: (-r[0], last(r[1])))[:5]
        for s, i in own:
            some = sorted(((n, k) for n, k, label in scored if label != al and 30 * s <= 100 * n <= 90 * s), key=lambda r: (-r[0], last(r[1])))[:10]
            out += [(a, i, rank, k, s, n) for rank, (n, k) in enumerate(some, 1)]
    return sorted(map(repr, out))


def vectors_of(spark, rows):
    frame = spark.createDataFrame(rows, "vec_id long, embedding array<double>, label int")
    for extra in ("LABEL", "vector", "anchor", "p", "rank"):
        frame = frame.withColumn("extra_" + extra, F.lit("?"))
    return frame.toDF(*[c.removeprefix("extra_") for c in frame.columns])


@pytest.mark.parametrize("scale", [1.0, 1e6])
def test_mining_is_brute_force(spark, scale):
    r = random.Random(9)
    some = lambda: [round(r.gauss(0.02, 0.1), 3) for _ in range(8)]
    rows = [(i, some(), i % 3) for i in range(0, 700)]
    rows += [(2000 + i, [0.25] * 8, i % 2) for i in range(30)]  # ties
    rows += [(100, some(), 1), (205, rows[205][1], 205 % 3)]  # ids that repeat
    rows += [(None, some(), 0), (None, [0.3] * 8, 1), (800, None, 1), (900, [None] * 8, 1), (1000, [math.inf] * 8, 1), (1100, [math.nan] * 8, 1), (1200, some(), None)]
    rows += [(1300, [], 1), (1400, [0.5, 0.5], 2), (1500, [0.0] * 8, 9)]
    rows = [(i, None if v is None else [None if x is None else x * scale for x in v], label) for i, v, label in rows]
    got = hard_negatives.hard_negatives(vectors_of(spark, rows).repartition(5), block_rows=3, batch_rows=101)
    assert sorted(repr(tuple(g)) for g in got.collect()) == mined(rows)


def test_mining_of_empty_tables(spark):
    assert hard_negatives.hard_negatives(vectors_of(spark, [(1, [0.1], 0)]).limit(0)).collect() == []
    assert hard_negatives.hard_negatives(vectors_of(spark, [(100, [0.1], 0), (200, None, 0)])).collect() == []


@settings(max_examples=80, deadline=None)
@given(st.integers(0, 6), st.integers(0, 6), st.integers(0, 5), st.integers(1, 53), st.randoms(use_true_random=False))
def test_packed_products_are_exact(n_anchors, n_candidates, d, bits, r):
    draw = lambda n: [[float(r.randint(-(1 << bits), 1 << bits)) for _ in range(d)] for _ in range(n)]
    a, c = draw(n_anchors), draw(n_candidates)
    got = hard_negatives.scores(np.array(a).reshape(n_anchors, d), np.array(c).reshape(n_candidates, d))
    most = (1 << 63) - 1
    assert got.tolist() == [[max(-most, min(most, sum(int(x) * int(y) for x, y in zip(p, q)))) for q in c] for p in a]


def test_fields_are_shared():
    """Several candidates really travel in one integer."""
    c = np.array([[1.0, 2.0], [3.0, 4.0], [5.0, 6.0]])
    packed = hard_negatives.pack(c, 3, 8)
    assert packed.tolist() == [[1 + (3 << 8) + (5 << 16), 2 + (4 << 8) + (6 << 16)]]
    assert hard_negatives.unpack(np.array([[2.0, 3.0]]) @ packed.T, 3, 3, 8).tolist() == [[8, 18, 28]]


# files of tasks


def test_a_second_attempt_replaces_its_file(tmp_path):
    folder = common.as_uri(str(tmp_path / "files"))
    for text in (b"first", b"second"):
        common.put_file(folder, "a.bin", lambda stream, text=text: stream.write(text))
    assert os.listdir(tmp_path / "files") == ["a.bin"] and (tmp_path / "files" / "a.bin").read_bytes() == b"second"


# words remembered by the token file writer

PARTS = ["the", "The,", "don't", "'sam", "l'été", "Größe", "ΣΑΣ", "éa", "́", "x1y22", "“oui”", "<|endoftext|>", "a<|startoftext|>b", "</w>", "&&&'s", " ", "İI", "한국어", "日本　語", "½²", "\x1c", "\u0085", "ŉ", "", "!!", "'re're", "ŁÓDŹ", "ŒUVRE's", "ſĲĸ"]


@pytest.fixture(scope="module")
def encoder():
    import public_tokenizers

    return token_blocks.WordEncoder(public_tokenizers.path("word_bpe_49k.json"))


@settings(max_examples=300, deadline=None)
@given(
    st.lists(st.lists(st.one_of(st.sampled_from(PARTS), st.sampled_from(" \t\n\r\x0b"), st.text(max_size=4)), max_size=14).map("".join), min_size=1, max_size=5),
    st.sampled_from([1, 7, 1 << 20]),
    st.sampled_from([3, 400_000]),
)
def test_remembered_words_are_whole_text_ids(encoder, texts, slice_chars, cached):
    old = token_blocks.SLICE_CHARS, token_blocks.CACHED_PARTS
    token_blocks.SLICE_CHARS, token_blocks.CACHED_PARTS = slice_chars, cached
    try:
        got = [np.frombuffer(b, "<u4").tolist() for b in encoder.encode_many([*texts, None])]
    finally:
        token_blocks.SLICE_CHARS, token_blocks.CACHED_PARTS = old
    assert encoder.exact and got == [encoder.tokenizer.encode(t, add_special_tokens=False).ids for t in texts] + [[]]


def test_other_tokenizers_encode_whole_texts():
    import public_tokenizers

    other = token_blocks.WordEncoder(public_tokenizers.path("byte_bpe_50k.json"))
    assert not other.exact
    text = "Don't  split\n\nme <|endoftext|> é"
    assert other.encode(text).tolist() == other.tokenizer.encode(text, add_special_tokens=False).ids


# links of ids with several texts


def test_links_are_between_documents(spark):
    x, y, z = prose(90, 40), prose(90, 41), prose(90, 42)
    data = [(3, x + " end"), (5, x), (5, "start " + x), (6, y), (7, y), (7, z), (8, z + " end"), (8, z), (9, x + " end"), (10, prose(60, 43)), (10, prose(60, 44)), (11, ""), (11, z), (12, y), (12, y)]
    got = jaccard_join.near_duplicates(spark.createDataFrame([(*r, "?") for r in data], "doc_id long, text string, rep string"))
    grams = lambda t: {tuple(t.split()[i : i + 5]) for i in range(len(t.split()) - 4)}
    near = {}
    for a, s in data:
        for b, t in data:
            if a != b and s and t and len(grams(s) & grams(t)) >= 0.8 * len(grams(s) | grams(t)):
                near.setdefault(a, set()).add(b)
    assert near[3] == {5, 9} and near[7] == {6, 12, 8, 11}
    rows = got.collect()
    assert len(rows) == len(data)
    for r in rows:
        empty = r.n_grams == 0
        want = {3: 3, 5: 3, 9: 3, 10: 10}.get(r.doc_id, 6)
        assert (r.class_id, r.n_links) == ((r.doc_id, 0) if empty else (want, len(near.get(r.doc_id, ())))), r


# fingerprints of lines


def test_fingerprints_of_one_place_are_dropped(spark):
    """A line that is in every document, each time among others, and one passage in three of them."""
    common, run = prose(12, 7), [prose(20, 80 + k) for k in range(4)]
    texts = {k: "\n".join([prose(20, 100 + k), common, prose(25, 200 + k), common, prose(30, 300 + k)]) for k in range(30)}
    for k in (5, 6, 29):
        texts[k] += "\n" + "\n".join(run)
    frame = spark.createDataFrame(list(texts.items()), "doc_id long, text string")
    windows = line_dedup._windows(line_dedup._lines(frame), 50)
    left = line_dedup._with_shared_print(windows)
    counts = Counter(r.print for r in windows.select("doc_id", "h", "pick", "print").distinct().collect())
    assert 0 < left.count() < windows.count()
    assert {r.print for r in left.collect()} == {x for x, n in counts.items() if n > 1}
    got = {r.doc_id: r.deleted_lines for r in line_dedup.line_dedup(frame).collect()}
    assert {d for d, lost in got.items() if lost} == {6, 29} and got[6] == "5,6,7,8"


def test_verdicts_can_be_filtered(spark):
    sf = "/root/testdata/sf0.001"
    judged = quality_rules.quality_rules(common.table(spark, sf, "documents"), common.table(spark, sf, "labels"))
    every = judged.toPandas()
    begun = time.monotonic()
    assert judged.where("kept").count() == every.kept.sum()
    assert judged.where("n_repeat_words > 0").count() == (every.n_repeat_words > 0).sum()
    assert judged.where("base_failed").count() == every.base_failed.sum()
    assert time.monotonic() - begun < 60


# mixing sources that overlap


def cheapest(patterns, quotas, costs):
    """(words routed, cost) of the best flow, by trying every way to split every pattern."""
    names, best = sorted(patterns), None
    ways = []
    for name in names:
        sources, words = patterns[name]
        own = [s for s in sources if s in quotas]
        splits = [()]
        for _ in own:
            splits = [(*s, k) for s in splits for k in range(words * len(costs) + 1) if sum(s) + k <= words * len(costs)]
        ways.append([dict(zip(own, s)) for s in splits])
    for choice in itertools.product(*ways):
        taken = Counter()
        for flow in choice:
            taken.update(flow)
        if any(taken[s] > quotas[s] for s in taken):
            continue
        cost = 0
        for name, flow in zip(names, choice):
            n, words = sum(flow.values()), patterns[name][1]
            cost += sum(c * max(0, min(words, n - k * words)) for k, c in enumerate(costs))
        key = (-sum(taken.values()), cost)
        best = key if best is None else min(best, key)
    return -best[0], best[1]


@settings(max_examples=40, deadline=None)
@given(
    st.lists(st.tuples(st.sets(st.sampled_from("abc"), min_size=1, max_size=2), st.integers(0, 2)), min_size=1, max_size=3),
    st.fixed_dictionaries({s: st.integers(0, 4) for s in "abc"}),
)
def test_routes_are_the_cheapest_of_all(found, quotas):
    patterns = {f"p{k}": (tuple(sorted(s)), n) for k, (s, n) in enumerate(found)}
    costs = mixing.REPEAT_COSTS
    flow = mixing.route(patterns, quotas, costs)
    taken, cost = Counter(), 0
    for name, (sources, words) in patterns.items():
        assert set(flow[name]) <= set(sources) and sum(flow[name].values()) <= words * len(costs)
        taken.update(flow[name])
        cost += sum(c * max(0, min(words, sum(flow[name].values()) - k * words)) for k, c in enumerate(costs))
    assert all(taken[s] <= quotas[s] for s in taken)
    assert (sum(taken.values()), cost) == cheapest(patterns, quotas, costs)


def test_overlapping_sources_are_mixed(spark):
    r = random.Random(4)
    lists = [["a"], ["b"], ["a", "b"], ["b", "c", "a"], ["c", None], [], None, ["a", "a"]]
    rows = [(i, prose(r.randint(1, 9), i), lists[i % 8]) for i in range(400)] + [(900, None, ["a"]), (901, "", ["b"])]
    frame = spark.createDataFrame([(*x, "?") for x in rows], "doc_id long, text string, members array<string>, pattern string")
    decided, mix = mixing.mix_overlapping(frame, share_percent=120)
    got = {x.doc_id: x for x in decided.collect()}
    assert len(got) == len(rows)
    by_pattern = Counter()
    for doc_id, text, members in rows:
        size = len((text or "").split())
        assert got[doc_id].size == size and 0 <= got[doc_id].copies <= len(mixing.REPEAT_COSTS) and got[doc_id].taken == size * got[doc_id].copies
        if not members:
            assert got[doc_id].copies == 0
        by_pattern[tuple(sorted({m or "" for m in members or []}))] += got[doc_id].taken
    # what the documents of a pattern take comes near what the flow routes there
    quotas = {s: round(t) for s, t in mix.targets.items()}
    flow = mixing.route(mix.patterns, quotas)
    for name, (sources, _) in mix.patterns.items():
        assert abs(by_pattern[tuple(sorted(s or "" for s in sources))] - sum(flow[name].values())) <= 9
