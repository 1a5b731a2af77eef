"""The pipeline against plain Python, stage by stage, on whole small tables.

Only the seeded draw (Spark's own hash) and the tokenizer are shared with the pipeline.
"""

import math
import re
import zlib

import numpy as np
import public_tokenizers
import pytest
from pyspark.sql import functions as F
from tokenizers import Tokenizer

import corpus_pipeline

SF = "/root/testdata/sf0.001"
WORD = re.compile(r"[^\x20\x09-\x0D]+")
ITEM_WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
BUCKETS = 1 << 15


def grams(text):
    hashes = [zlib.crc32(w.encode()) for w in WORD.findall(text or "")]
    return [h % BUCKETS for h in hashes] + [BUCKETS + (a * 40_503 + b) % BUCKETS for a, b in zip(hashes, hashes[1:])]


def good(docs, labels):
    trusted = {r["doc_id"] for r in labels if r["quality"] == 1}
    target, raw = np.ones(2 * BUCKETS), np.ones(2 * BUCKETS)
    for d in docs:
        for g in grams(d["text"]):
            raw[g] += 1
            target[g] += d["doc_id"] in trusted
    shift = math.log(raw.sum() / target.sum())
    weight = [round(1e6 * (math.log(t) - math.log(r) + shift)) for t, r in zip(target, raw)]
    kept = []
    for d in docs:
        w = WORD.findall(d["text"] or "")
        at = {}
        for i in range(len(w) - 4):
            at.setdefault(tuple(w[i : i + 5]), []).append(i)
        repeated = {i + k for places in at.values() if len(places) > 1 for i in places for k in range(5)}
        found = grams(d["text"])
        if len(w) >= 10 and 100 * len(repeated) <= 20 * len(w) and sum(weight[g] for g in found) >= -200_000 * len(found):
            kept.append(d)
    return kept


def distinct(docs):
    sets = {}
    for d in docs:
        w = WORD.findall(d["text"])
        sets[d["doc_id"]] = {tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))}
    head = {i: i for i in sets}

    def of(i):
        while head[i] != i:
            i = head[i]
        return i

    ids = sorted(sets)
    for n, a in enumerate(ids):
        for b in ids[n + 1 :]:
            shared = len(sets[a] & sets[b])
            if shared and 10 * shared >= 8 * (len(sets[a]) + len(sets[b]) - shared):
                x, y = of(a), of(b)
                head[max(x, y)] = min(x, y)
    return [d for d in docs if of(d["doc_id"]) == d["doc_id"]]


def item_words(text):
    return ITEM_WORD.findall("".join(c.lower() if "A" <= c <= "Z" else c for c in text or ""))


def clean(docs, items):
    windows = set()
    for item in items:
        w = item_words(item["text"])
        windows |= {tuple(w[i : i + 10]) for i in range(max(1, len(w) - 9))} - {()}
    sizes = {len(x) for x in windows}

    def hit(text):
        w = item_words(text)
        return any(tuple(w[i : i + n]) in windows for n in sizes for i in range(len(w) - n + 1))

    return [d for d in docs if not hit(d["text"])]


def mixed(docs, draws):
    size = {d["doc_id"]: len(WORD.findall(d["text"])) for d in docs}
    by_source = {}
    for d in docs:
        by_source.setdefault(d["source"], []).append(d["doc_id"])
    order = sorted(by_source, key=lambda s: (s is None, s or ""))
    total = {s: sum(size[i] for i in by_source[s]) for s in order}
    weight = {s: (3, 1, 2)[n % 3] for n, s in enumerate(order)}
    target, left, unfilled = {}, 1.5 * sum(total.values()), set(order)
    while unfilled:
        unit = left / sum(weight[s] for s in unfilled)
        over = {s for s in unfilled if unit * weight[s] > 2 * total[s]}
        if not over:
            target |= {s: unit * weight[s] for s in unfilled}
            break
        target |= {s: 2 * total[s] for s in over}
        left -= sum(2 * total[s] for s in over)
        unfilled -= over
    copies = {}
    for s in order:
        whole, rest = divmod(min(round(target[s]), 2 * total[s]), total[s])
        before = 0
        for i in sorted(by_source[s], key=draws.get):
            copies[i] = whole + (before + size[i] / 2 <= rest and before < rest)
            before += size[i]
    return copies


@pytest.fixture(scope="module")
def stages(spark):
    docs, out = spark.read.parquet(f"{SF}/documents.parquet"), []
    for _, stage in corpus_pipeline.STAGES:
        docs = corpus_pipeline.written(stage(spark, docs, SF), "plain-test")
        out.append(docs)
    return out


def test_every_stage(spark, stages):
    read = lambda name: spark.read.parquet(f"{SF}/{name}.parquet").collect()
    ids = lambda rows: sorted(r["doc_id"] for r in rows)
    at = good(read("documents"), read("labels"))
    assert ids(stages[0].collect()) == ids(at)
    at = distinct(at)
    assert ids(stages[1].collect()) == ids(at)
    at = clean(at, read("benchmark"))
    assert ids(stages[2].collect()) == ids(at)

    hashed = stages[2].select("doc_id", F.xxhash64(F.lit(17), "doc_id", "text").bitwiseAND(F.lit((1 << 63) - 1)).alias("draw"))
    copies = mixed(at, {r["doc_id"]: r["draw"] for r in hashed.collect()})
    assert ids(stages[3].collect()) == sorted(i for i, n in copies.items() for _ in range(n))
    assert len(set(copies.values())) > 1

    tokenizer = Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json"))
    want, start = [], 0
    for d in sorted(at, key=lambda d: d["doc_id"]):
        tokens = tokenizer.encode(d["text"], add_special_tokens=False).ids + [1]
        for _ in range(copies[d["doc_id"]]):
            want.append((d["doc_id"], start, len(tokens), zlib.crc32(np.array(tokens, "<u4").tobytes())))
            start += len(tokens)
    assert sorted(map(tuple, stages[4].select("doc_id", "start", "n_tokens", "ids_crc32").collect())) == want
