import collections
import math
import zlib

import numpy as np
import pyarrow as pa
import pytest

from compare import differences, oracle
from hypothesis import given, settings
from hypothesis import strategies as st

from frostline.llm import brown_clusters as bc
from frostline.llm import winnowing as wn
from frostline.llm.oracles import ORACLES
from frostline.llm.queries import QUERIES

SF = "/root/testdata/sf0.001"


def tokens(text):
    return [*(text or "").encode().lower().split(), b"\n"]


@pytest.mark.parametrize("known", [1 << 20, 50])
def test_base_score_against_brute_force(spark, odd_documents, documents, monkeypatch, known):
    monkeypatch.setattr(bc, "KNOWN", known)
    df = documents.select("doc_id", "text").limit(60).union(odd_documents.select("doc_id", "text"))
    rows = df.collect()
    held = lambda d: zlib.crc32(str(d).encode() if d is not None else b"") % 5 == 1
    c = collections.Counter(t for r in rows if not held(r.doc_id) for t in tokens(r.text))
    n, v = sum(c.values()), len(c)
    want = []
    for r in rows:
        own = tokens(r.text)
        base = sum(math.log10((c[t] + 0.5) / (n + 0.5 * (v + 1))) for t in own)
        want.append((str(r.doc_id), held(r.doc_id), len(own), sum(c[t] > 0 for t in own), n, round(base, 6)))
    got = bc.brown_scores(df, classes=4, rounds=2).collect()
    have = [(str(r.doc_id), r.held_out, r.n_tokens, r.n_known, r.train_tokens, round(r.base_score, 6)) for r in got]
    assert sorted(have) == sorted(want)


def test_classes_help_on_held_out_text(spark):
    names, verbs = [f"name{i}" for i in range(30)], [f"verb{i}" for i in range(30)]
    pick = np.random.default_rng(1)
    text = lambda: " ".join(f"{names[pick.integers(30)]} {verbs[pick.integers(30)]}" for _ in range(30))
    df = spark.createDataFrame([(i, text()) for i in range(200)], "doc_id long, text string")
    held = [r for r in bc.brown_scores(df, classes=8).collect() if r.held_out]
    assert sum(r.score for r in held) > 0.9 * sum(r.base_score for r in held)  # about log10(60 / 30) a word


def test_exchange_gain_is_the_change_of_likelihood():
    pick = np.random.default_rng(2)
    pairs, k = pick.integers(0, 9, (9, 9)), 4
    of = pick.integers(0, k, 9)

    def matrix(of):
        out = np.zeros((k, k))
        for i in range(9):
            for j in range(9):
                out[of[i], of[j]] += pairs[i, j]
        return out

    def value(of):
        m, f = matrix(of), lambda x: (x * np.log(np.maximum(x, 1))).sum()
        return f(m) - f(m.sum(0)) - f(m.sum(1))

    for w in range(9):
        after = np.bincount(of, pairs[w], k)
        before = np.bincount(of, pairs[:, w], k)
        tried = [value(np.where(np.arange(9) == w, c, of)) for c in range(k)]
        best = bc.best_class(matrix(of), of[w], after, before, pairs[w, w], k)
        assert tried[best] == pytest.approx(max(tried))


def test_probabilities_add_up(spark):
    df = spark.createDataFrame([(0, "a b a c"), (2, "b b d a"), (3, "a")], "doc_id long, text string")
    model, counts = bc.train(df, classes=2, rounds=2)
    words = [r.word for r in counts.collect()]
    ids = model.ids.of(np.array(words, np.int64).view(np.uint64), bc.RARE)
    n = {r.word: r.n for r in counts.collect()}
    for before in range(len(model.weight)):
        total = sum((n[w] + 0.5) * 10 ** model.weight[before, model.classes[i]] for w, i in zip(words, ids))
        unseen = 0.5 * 10 ** model.weight[before, model.classes[bc.RARE]]
        assert total + unseen <= 1 + 1e-9


@pytest.mark.parametrize("known", [1 << 20, 80])
def test_words_too_rare_for_the_exchange_have_classes(spark, monkeypatch, known):
    """Ten names and verbs are frequent, the other fifty of each too rare to be exchanged."""
    monkeypatch.setattr(bc, "CLUSTERED", 60)
    monkeypatch.setattr(bc, "KNOWN", known)
    pick = np.random.default_rng(3)
    number = lambda: pick.integers(10) if pick.random() < 0.6 else 10 + pick.integers(50)
    text = lambda: " ".join(f"name{number()} verb{number()}" for _ in range(30))
    texts = [text() for _ in range(200)]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    model, counts = bc.train(df, classes=4, rounds=4)
    assert 4 <= len(model.ids.words) <= 60
    rows = {r.word: (r.n, r["class"]) for r in counts.collect()}
    hashes = np.array(list(rows), np.int64).view(np.uint64)
    own = {w: c if c >= 0 else rows[w][1] for w, c in zip(rows, model.held.of(hashes, -1).tolist())}
    assert all(c is not None and c != model.classes[bc.RARE] for c in own.values())
    for before in range(len(model.weight)):
        total = sum((n + 0.5) * 10 ** model.weight[before, own[w]] for w, (n, _) in rows.items())
        total += 0.5 * 10 ** model.weight[before, model.classes[bc.RARE]]
        assert total <= 1 + 1e-9
    # against the model's own probabilities, token by token, with words it has not seen
    odd = [(0, texts[0]), (1, "name1 new name55 new new verb59"), (2, "")]
    got = {r.doc_id: r.score for r in bc.score(spark.createDataFrame(odd, "doc_id long, text string"), model, counts).collect()}
    for doc, t in odd:
        want, before = 0.0, int(model.classes[bc.END])
        for h in bc.token_hashes(t.encode()).view(np.int64).tolist():
            c = own.get(h, int(model.classes[bc.RARE]))
            want += math.log10(rows.get(h, (0,))[0] + 0.5) + model.weight[before, c]
            before = c
        assert got[doc] == pytest.approx(want)
    held = [r for r in bc.brown_scores(df, classes=4, rounds=4).collect() if r.held_out]
    assert sum(r.score for r in held) > 0.93 * sum(r.base_score for r in held)


def test_scores_of_nothing(spark, no_documents):
    assert bc.brown_scores(no_documents).collect() == []
    one = spark.createDataFrame([(1, "held out or not")], "doc_id long, text string")
    assert bc.brown_scores(one).count() == 1


# --- winnowing ---


def word_list(text):
    out, word = [], []
    for ch in (text or "") + " ":
        ch = ch.lower() if ch < "\x80" else ch
        if ch >= "\x80" or ch.isascii() and ch.isalnum():
            word.append(ch)
        elif word:
            out.append("".join(word))
            word = []
    return out


def brute(docs, items):
    windows = collections.defaultdict(set)
    for item, text in items:
        w = word_list(text)
        n = min(13, len(w))
        for i in range(len(w) - n + 1 if n else 0):
            windows[tuple(w[i : i + n])].add(item)
    sizes = {len(w) for w in windows}
    out = []
    for doc, text in docs:
        w, hit, ids = word_list(text), set(), set()
        for n in sizes:
            for i in range(len(w) - n + 1):
                if tuple(w[i : i + n]) in windows:
                    hit |= set(range(i, i + n))
                    ids |= windows[tuple(w[i : i + n])]
        out.append((str(doc), len(w), len(hit), sorted(i for i in ids if i is not None), bool(hit) and 20 * len(hit) >= len(w)))
    return sorted(out)


def test_contamination_against_brute_force(spark, odd_documents):
    long = " ".join(f"w{i}" for i in range(40))
    items = [(1, long), (2, " ".join(long.split()[5:25])), (3, "tiny item"), (4, "One"), (5, None), (6, "..."), (7, long), (None, "a b c d e f g")]
    docs = [(100, f"x y {long} z"), (101, f"start {' '.join(long.split()[10:23])} end"), (102, " ".join(long.split()[10:22])), (103, "A tiny, ITEM one-two"), (104, "a b c d e f g " * 3), (105, " ".join(["q"] * 900) + " one"), (101, "again one")]
    docs += [(r.doc_id, r.text) for r in odd_documents.collect()]
    df = spark.createDataFrame(docs, "doc_id long, text string").selectExpr("*", "1 AS row", "2 AS hash", "3 AS n")
    bench = spark.createDataFrame(items, "item_id long, text string").selectExpr("*", "1 AS n")
    got = wn.contamination(df, bench).collect()
    have = sorted((str(r.doc_id), r.n_words, r.n_hit, list(r["items"]), r.contaminated) for r in got)
    assert have == brute(docs, items)


def test_contamination_against_sql(spark):
    assert differences(QUERIES["op9_winnowing"](spark, SF), oracle(SF), ORACLES["op9_winnowing"]) == []


def test_no_documents_or_items(spark, no_documents, odd_documents):
    none = spark.createDataFrame([], "item_id long, text string")
    assert wn.contamination(no_documents, none).collect() == []
    assert not any(r.contaminated for r in wn.contamination(odd_documents, none).collect())


def test_winnowing_guarantee():
    pick = np.random.default_rng(5)
    for _ in range(50):
        words = pick.integers(0, 6, 60).astype(np.uint64)
        grams = wn.gram_hashes(words, 7)
        chosen = set(wn.winnowed(grams, 7).tolist())
        assert all(chosen & set(range(i, i + 7)) for i in range(len(grams) - 6))


@given(st.lists(st.integers(0, 9), max_size=30), st.sets(st.integers(0, 9)))
@settings(max_examples=100, deadline=None)
def test_bigrams_are_held_or_joined_once(words, rare):
    """Every bigram is near, beside one word to be joined, or a pair of such words; a word is joined once."""
    k, end = 5, 4
    tokens = np.array([*words, 99], np.uint64)
    kept = np.array([*sorted(set(range(10)) - rare), 99], np.uint64)
    held = bc.Words(kept, np.where(kept == 99, end, kept % 4).astype(np.int64))
    there, near, beside, far, first, second = bc.bigrams(tokens, held, end, k)
    assert there.tolist() == [w not in rare for w in tokens.tolist()]
    classes = [end if w == 99 else w % 4 for w in tokens.tolist()]
    got = near.tolist() + [int(f) % 4 * k + int(s) % 4 for f, s in zip(first, second)]
    for b, w in zip(beside.tolist(), far.tolist()):
        before, behind = b // (k + 1) - 1, b % (k + 1) - 1
        got += [before * k + w % 4] * (before >= 0) + [w % 4 * k + behind] * (behind >= 0)
    assert sorted(got) == sorted(a * k + c for a, c in zip([end, *classes], classes))
    assert len(far) == sum(w in rare for w in words)


@pytest.mark.parametrize("size", [0, 1, 2, 3, 1000])
def test_places_of_words(size):
    pick = np.random.default_rng(size)
    words = np.unique(pick.integers(0, 1 << 64, size, np.uint64, endpoint=False) if size else np.zeros(0, np.uint64))
    words[size // 2 :] |= np.uint64(0xFFFF << 48)  # many with the same beginning
    words = np.unique(words)
    held = bc.Words(words[::-1], np.arange(len(words))[::-1])
    others = np.concatenate([words + np.uint64(1), words - np.uint64(1), np.array([0, (1 << 64) - 1], np.uint64)])
    tokens = pick.permutation(np.concatenate([words, words, others]))
    want = {w: i for i, w in enumerate(words.tolist())}
    assert held.places(tokens).tolist() == [want.get(t, -1) for t in tokens.tolist()]
    assert held.of(tokens, -7).tolist() == [want.get(t, -7) for t in tokens.tolist()]


def test_neighbours_of_a_word_stay_together(monkeypatch):
    """Rows sorted by word come in batches of any size; a word with many rows is added up."""
    monkeypatch.setattr(bc, "ROWS", 8)
    pick = np.random.default_rng(7)
    word = np.sort(np.concatenate([pick.integers(0, 20, 60), np.full(50, 9)]))
    sides = pick.integers(0, 5, len(word))
    table = pa.table({"sides": sides, "word": word})
    want = collections.Counter(zip(word.tolist(), sides.tolist()))
    for rows in (1, 3, 200):
        parts = list(bc.whole_words(iter(table.to_batches(rows))))
        assert not any(set(a[0]) & set(b[0]) for a, b in zip(parts, parts[1:]))
        got = collections.Counter()
        for w, s, n in zip(*(np.concatenate(x).tolist() for x in zip(*parts))):
            got[w, s] += n
        assert got == want
