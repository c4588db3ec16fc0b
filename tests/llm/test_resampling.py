import hashlib
import math
import re
import zlib
from collections import Counter

import numpy as np
import pytest

from frostline.llm import importance_resampling as ir


def features(text, longest, buckets):
    fold = re.sub("[A-Z]", lambda m: m.group().lower(), text or "")
    w = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", fold)
    runs = [" ".join(w[i : i + n]) for n in range(1, longest + 1) for i in range(len(w) - n + 1)]
    return [zlib.crc32(r.encode()) % buckets for r in runs], len(w)


def brute(docs, target, buckets, longest, percent, least, seed):
    s = Counter(b for _, t in docs for b in features(t, longest, buckets)[0])
    t = Counter(b for (x,) in target for b in features(x, longest, buckets)[0])
    all_s, all_t = sum(s.values()), sum(t.values())
    gain = {
        b: math.floor(1000 * math.log((t[b] + 1) * (all_s + buckets) / ((s[b] + 1) * (all_t + buckets))))
        for b in set(s) | set(t)
    }
    rows = []
    for doc_id, text in docs:
        f, n_words = features(text, longest, buckets)
        weight = sum(gain[b] for b in f) // len(f) if f else 0
        h = int(hashlib.sha256(f"{seed}:{'' if doc_id is None else doc_id}".encode()).hexdigest()[:8], 16)
        score = weight + math.floor(-1000 * math.log(-math.log((h + 0.5) / 2**32)))
        rows.append([doc_id, n_words, len(f), weight, score, None])
    able = [r for r in rows if r[1] >= least]
    able.sort(key=lambda r: (-r[4], -1 if r[0] is None else r[0], r[2], r[3]))
    for i, r in enumerate(able[: percent * len(able) // 100]):
        r[5] = i + 1
    return sorted(map(tuple, rows), key=repr)


@pytest.mark.parametrize("longest,buckets", [(1, 10_000), (3, 700)])
def test_against_brute_force(spark, odd_documents, documents, longest, buckets, monkeypatch):
    monkeypatch.setattr(ir, "PIECE", 300)
    docs = odd_documents.select("doc_id", "text").unionByName(documents.select("doc_id", "text"))
    target = spark.read.parquet("/root/testdata/sf0.001/benchmark.parquet")
    found = ir.importance_resample(docs, target, buckets, longest, percent=37, least_words=4)
    want = brute(docs.collect(), target.select("text").collect(), buckets, longest, 37, 4, 2024)
    assert sorted(map(tuple, found.collect()), key=repr) == want


def test_odd_rows_names_and_empty_tables(spark, odd_documents, no_documents):
    target = spark.createDataFrame([(None,), ("",), ("Very odd words",)], "text string")
    clashing = odd_documents.withColumnsRenamed({"key": "rank", "row": "score"})
    found = ir.importance_resample(clashing, target, least_words=1)
    assert found.columns == ["doc_id", "n_words", "n_features", "weight", "score", "rank"]
    assert found.count() == odd_documents.count()
    kept = ir.importance_resample(odd_documents, target, least_words=1, keep=("text", "doc_id")).where("rank is not null")
    assert kept.count() == 10 * found.where("n_words > 0").count() // 100
    assert ir.importance_resample(no_documents, target).count() == 0
    alone = ir.importance_resample(odd_documents, no_documents.select("text"), least_words=1)
    assert alone.count() == odd_documents.count()


def test_planes_sum_like_products():
    pick = np.random.default_rng(1)
    gains = pick.integers(-9000, 9000, 997)
    docs = [pick.integers(0, 997, n) for n in (0, 1, 40, 5000)] + [np.full(70_000, 996), np.zeros(3, np.int64)]
    planes = ir.GainPlanes(gains)
    assert planes.sums(docs).tolist() == [int(gains[d].sum()) for d in docs]
    assert planes.sums([]).tolist() == []


def test_long_texts_are_read_in_pieces(monkeypatch):
    monkeypatch.setattr(ir, "PIECE", 7)
    text = b"One two-three FOUR " * 50 + b"x" * 100
    words = [w for part in ir.words_of(text) for w in part]
    assert words == [b"one", b"two", b"three", b"four"] * 50 + [b"x" * 100]
