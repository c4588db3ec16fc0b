import collections
import glob
import hashlib
import random
import tempfile

import numpy as np
import pytest
import xxhash
from hypothesis import given, settings
from hypothesis import strategies as st

from compare import differences, oracle
from frostline.llm import bitsliced_simhash as bs
from frostline.llm import compact_windows as cw
from frostline.llm import exact_substrings as es
from frostline.llm.components import components
from frostline.llm.induced_sorting import BucketQueue, suffix_order
from frostline.llm.oracles import ORACLES
from frostline.llm.perfect_hash_lines import PerfectHash, dedup_lines
from frostline.llm.queries import QUERIES
from frostline.llm.workspace import release, saved

SF = "/root/testdata/sf0.001"


def words_of(text):
    return (text or "").encode().lower().split()


def roots_of(n, links):
    root = list(range(n))

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a, b in links:
        a, b = find(a), find(b)
        root[max(a, b)] = min(a, b)
    return [find(x) for x in range(n)]


def classes(keys):
    groups = collections.defaultdict(list)
    for i, k in enumerate(keys):
        groups[k].append(i)
    return sorted(groups.values())


# --- SimHash ---


def plain_fingerprint(text):
    w = words_of(text)
    s = [b" ".join(w[i : i + 3]) for i in range(len(w) - 2)] if len(w) > 2 else [b" ".join(w)] * bool(w)
    h = [xxhash.xxh64_intdigest(x, 42) for x in s]
    return sum(1 << b for b in range(64) if 2 * sum(v >> b & 1 for v in h) > len(h))


def test_simhash_against_brute_force(spark, odd_documents):
    rows = odd_documents.select("doc_id", "text").collect()
    want = [plain_fingerprint(r.text) for r in rows]
    links = [(i, j) for i in range(len(rows)) for j in range(i) if (want[i] ^ want[j]).bit_count() <= 2]
    root = roots_of(len(rows), links)
    least = {}
    for i, r in enumerate(rows):
        ids = [x for x in (least.get(root[i]), r.doc_id) if x is not None]
        least[root[i]] = min(ids, default=None)
    expected = sorted((str(r.doc_id), want[i], str(least[root[i]])) for i, r in enumerate(rows))
    for block in (8192, 2):
        got = bs.near_duplicates(odd_documents, block=block).collect()
        assert sorted((str(r.doc_id), r.fp % (1 << 64), str(r.component.doc_id)) for r in got) == expected


def test_simhash_of_nothing(no_documents):
    assert bs.near_duplicates(no_documents).collect() == []


@given(st.lists(st.integers(0, 2**64 - 1), min_size=1, max_size=90), st.integers(0, 9), st.randoms())
@settings(max_examples=60, deadline=None)
def test_bit_slices_count_distances(values, radius, pick):
    values += [v ^ sum(1 << pick.randrange(64) for _ in range(radius)) % (1 << 64) for v in values]
    fps = np.array([v % (1 << 64) for v in values], np.uint64)
    got = {(int(i), int(j)) for a, b in bs.close_pairs(fps, radius, queries=16) for i, j in zip(a, b)}
    n = range(len(fps))
    want = {(i, j) for i in n for j in range(i) if (int(fps[i]) ^ int(fps[j])).bit_count() <= radius}
    assert got == want


def test_dense_fingerprints_in_small_blocks(spark):
    pick = random.Random(2)
    base = pick.getrandbits(63)
    fps = sorted({base ^ sum(1 << b for b in pick.sample(range(40), 3)) for _ in range(400)})
    df = spark.createDataFrame([(f,) for f in fps], "fp long")
    want = classes(roots_of(len(fps), [(i, j) for i in range(len(fps)) for j in range(i) if (fps[i] ^ fps[j]).bit_count() <= 2]))
    for block in (8192, 40):
        root = {r.node: r.root for r in components(bs.links(df, 2, block)).collect()}
        assert classes([root.get(f, f) for f in fps]) == want


def test_components(spark):
    pick = random.Random(1)
    links = [(pick.randrange(300), pick.randrange(300)) for _ in range(200)] + [(i, i + 1) for i in range(300, 420)]
    df = spark.createDataFrame([*links, (5, 5), (None, 1)], "u long, v long")
    got = {r.node: r.root for r in components(df).collect()}
    want = roots_of(421, links)
    assert got == {n: want[n] for link in links for n in link if link[0] != link[1]}


# --- exact substrings ---


def brute_substrings(texts, span):
    data = [(t or "").encode() for t in texts]
    count = collections.Counter(b[i : i + span] for b in data for i in range(len(b) - span + 1))
    out = []
    for b in data:
        gone = bytearray(len(b))
        for i in range(len(b) - span + 1):
            if count[b[i : i + span]] > 1:
                gone[i : i + span] = b"\1" * span
        spans = sum(1 for i in range(len(b)) if gone[i] and not (i and gone[i - 1]))
        kept = bytes(c for c, g in zip(b, gone) if not g)
        out.append((len(b), sum(gone), spans, hashlib.sha256(kept).hexdigest()))
    return out


@pytest.mark.parametrize("crowd", [20_000, 2])
def test_substrings_against_brute_force(spark, odd_documents, monkeypatch, crowd):
    pick = random.Random(7)
    base = "".join(pick.choice("abcdefgh ") for _ in range(900))
    more = [base[a : a + n] + pick.choice(["", "é", "\x00z"]) + base[b : b + 230] for a, n, b in [(pick.randrange(600), pick.randrange(300), pick.randrange(600)) for _ in range(25)]]
    texts = [r.text for r in odd_documents.collect()] + more + ["ab" * 400, "é" * 200, "\x00" * 400]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    whole = es.repeated_runs
    monkeypatch.setattr(es, "repeated_runs", lambda d, s, b: whole(d, s, b, crowd))
    got = {r.doc_id: r for r in es.dedup_substrings(df).collect()}
    for i, want in enumerate(brute_substrings(texts, 200)):
        r = got[i]
        assert (r.n_bytes, r.n_removed, r.n_spans, hashlib.sha256(r.kept).hexdigest()) == want


def test_substrings_of_nothing(no_documents):
    assert es.dedup_substrings(no_documents).collect() == []


@given(st.lists(st.integers(0, 3), max_size=50), st.sampled_from([1, 8, 4096]), st.sampled_from([64, 1 << 20]))
@settings(max_examples=300, deadline=None)
def test_suffix_order(text, small, memory):
    want = sorted(range(len(text)), key=lambda i: text[i:])
    assert suffix_order(np.array(text, np.int64), memory, small).tolist() == want


def test_bucket_queue_spills_in_order():
    queue, want = BucketQueue(5, 100), collections.defaultdict(list)
    pick = np.random.default_rng(3)
    for _ in range(30):
        keys, values = pick.integers(0, 5, 20), pick.integers(0, 1000, 20)
        queue.push(keys, values)
        for k, v in zip(keys.tolist(), values.tolist()):
            want[k].append(v)
    assert queue.file is not None
    assert [queue.pop(k).tolist() for k in range(5)] == [want[k] for k in range(5)]
    queue.close()


@given(st.text("ab", max_size=700))
@settings(max_examples=50, deadline=None)
def test_equal_strings_have_equal_anchors(text):
    data, span = text.encode(), 60
    first, last, gram = es.anchors(data, span)
    assert [s for a, z in zip(first, last) for s in range(a, z + 1)] == list(range(max(0, len(data) - span + 1)))
    seen = {}
    for a, z, g in zip(first, last, gram):
        for s in range(a, z + 1):
            assert seen.setdefault(data[s : s + span], g) == g


# --- passages ---


@given(st.lists(st.integers(0, 20), max_size=120), st.integers(1, 12))
@settings(max_examples=200, deadline=None)
def test_compact_windows_cover_every_long_run(values, least):
    values = np.array(values, np.uint64)
    found = cw.compact_windows(values, least)
    for i in range(len(values)):
        for j in range(i + least - 1, len(values)):
            low = values[i : j + 1].min()
            assert any(a <= i and j <= z and values[c] == low for a, c, z in found)
    assert all(z - a + 1 >= least and values[a : z + 1].min() == values[c] for a, c, z in found)


def test_verbatim_passages_are_found(spark, documents):
    pick = random.Random(9)
    text = lambda n: " ".join("w%d" % pick.randrange(9999) for _ in range(n))
    passage, near = text(55), text(90).split()
    changed = " ".join(w if i % 40 else "changed" for i, w in enumerate(near, 1))
    rows = [(9000 + i, f"{text(80)} {passage} {text(60)}") for i in range(6)]
    rows += [(9100, text(200)), (9101, None), (9102, ""), (9103, "short"), (9103, "short"), (None, text(70))]
    rows += [(9200, f"{text(30)} {' '.join(near)} {text(30)}"), (9201, f"{text(20)} {changed} {text(50)}")]
    copy = text(100)
    rows += [(9300, copy), (9301, copy)]
    df = documents.select("doc_id", "text").union(spark.createDataFrame(rows, "doc_id long, text string"))
    got = {r.doc_id: r for r in cw.near_passages(df.selectExpr("*", "1 AS node", "2 AS key")).collect()}
    assert len({got[9000 + i].class_id for i in range(6)}) == 1
    for i in range(6):
        assert any(s.s <= 80 and s.e >= 135 for s in got[9000 + i].spans)
    assert got[9200].class_id == got[9201].class_id == 9200
    assert (got[9300].class_id, got[9301].class_id, got[9301].n_near_words) == (9300, 9300, 100)
    for i in (9100, 9101, 9102, 9103, None):
        assert got[i].n_passages == 0 and got[i].class_id == i


def test_passages_that_stand_twice_in_a_text(spark):
    assert {(0, 1, 4), (0, 3, 4)} <= set(cw.compact_windows(np.array([5, 1, 5, 1, 5], np.uint64), 4))
    pick = random.Random(11)
    text = lambda n: " ".join("w%d" % pick.randrange(9999) for _ in range(n))
    passage = text(60)
    rows = [(1, f"{text(70)} {passage} {text(70)} {passage} {text(70)}"), (2, f"{text(40)} {passage} {text(40)}")]
    for order in (rows, [(2, rows[0][1]), (1, rows[1][1])]):
        df = spark.createDataFrame(order, "doc_id long, text string")
        got = {r.doc_id: r for r in cw.near_passages(df).collect()}
        twice, once = got[order[0][0]], got[order[1][0]]
        for s in (70, 200):
            assert any(x.s <= s and x.e >= s + 60 for x in twice.spans)
        assert any(x.s <= 40 and x.e >= 100 for x in once.spans) and twice.class_id == once.class_id == 1


def test_passages_of_the_documents(spark, documents):
    rows = [(r.doc_id, words_of(r.text)) for r in documents.collect()]
    held = collections.defaultdict(set)
    for d, w in rows:
        for i in range(len(w) - 50):
            held[tuple(w[i : i + 51])].add(d)
    got = {r.doc_id: r for r in cw.near_passages(documents).collect()}
    for ids in held.values():
        assert len({got[d].class_id for d in ids}) == 1
        assert len(ids) == 1 or all(got[d].n_near_words >= 50 for d in ids)


def test_pairs_that_share_frequent_words_are_found(spark):
    """Pairs with an equal passage of 60 words, the first 40 of which stand in all texts."""
    pick = random.Random(5)
    text = lambda n: ["w%d" % pick.randrange(10**6) for _ in range(n)]
    common, rows = text(40), []
    for i in range(300):
        passage = common + text(20)
        rows += [(2 * i + j, " ".join(text(70) + passage + text(70))) for j in range(2)]
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(7)
    got = {r.doc_id: r.class_id for r in cw.near_passages(df).collect()}
    assert sum(got[2 * i] == got[2 * i + 1] == 2 * i for i in range(300)) >= 297
    assert all(c in (d, d - d % 2) for d, c in got.items())  # no two pairs are one class


def alike_somewhere(a: list, b: list, least: int = 46) -> bool:
    """If any runs of `least` shingles are 0.8 alike, by comparing all with all."""
    if len(set(a) & set(b)) < 0.8 * least:
        return False
    runs = [[set(x[i : i + least]) for i in range(len(x) - least + 1)] for x in (a, b)]
    return any(5 * len(x & y) >= 4 * len(x | y) for x in runs[0] for y in runs[1])


def test_changed_passages_against_brute_force(spark):
    """Groups of 2 to 30 texts share a passage, changed in each, behind words of all texts."""
    pick = random.Random(8)
    text = lambda n: ["w%d" % pick.randrange(10**6) for _ in range(n)]
    common, rows = text(30), []
    for size in (*[2] * 20, 5, 5, 12, 30):
        passage = common + text(50)
        for _ in range(size):
            changed = list(passage)
            changed[pick.randrange(80)] = text(1)[0]
            rows.append((len(rows), text(20) + changed + text(20)))
    shingles = [[tuple(w[i : i + 5]) for i in range(len(w) - 4)] for _, w in rows]
    pairs = [(i, j) for j in range(len(rows)) for i in range(j) if alike_somewhere(shingles[i], shingles[j])]
    root = list(range(len(rows)))
    for i, j in pairs:
        old, new = max(root[i], root[j]), min(root[i], root[j])
        root = [new if r == old else r for r in root]
    df = spark.createDataFrame([(d, " ".join(w)) for d, w in rows], "doc_id long, text string")
    got = {r.doc_id: r.class_id for r in cw.near_passages(df).collect()}
    assert len(pairs) > 300
    assert sum(got[i] == got[j] for i, j in pairs) >= 0.95 * len(pairs)
    assert all(root[d] == root[c] for d, c in got.items())


def test_passages_with_words_put_in(spark):
    """Two words more in one of two texts: 42 shingles of 46 and of 48 are common, 0.81 of all."""
    pick = random.Random(4)
    text = lambda n: ["w%d" % pick.randrange(10**6) for _ in range(n)]
    rows = []
    for _ in range(40):
        passage = text(50)
        longer = passage[:25] + text(2) + passage[25:]
        rows += [(len(rows) + j, " ".join(text(30) + x + text(30))) for j, x in enumerate((passage, longer))]
    got = {r.doc_id: r.class_id for r in cw.near_passages(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert sum(got[i] == got[i + 1] == i for i in range(0, 80, 2)) >= 39


def test_all_windows_of_a_signature_are_linked(spark):
    """Nodes 0 to 9 share two signatures; 0 to 5 are one class, and 5 lies in no passage there."""
    rows = [(k, n, 0 if n < 6 else n, n != 5, n >= 5) for k in (1, 2) for n in range(10)]
    rows.append((3, 0, 0, True, False))
    rows += [(3, 77, 77, True, True)]  # one signature in common, and another class
    windows = spark.createDataFrame(rows, "key long, node long, root long, covered boolean, needy boolean")
    got = {(r.u, r.v, r.key) for r in cw.all_links(windows, 2).collect()}
    pairs = [(u, v) for u in range(10) for v in range(u + 1, 10) if v > 4]
    assert got == {(u, v, k) for u, v in pairs for k in (1, 2)}
    assert {(r.u, r.v) for r in cw.all_links(windows, 1).where("key = 3").collect()} == {(0, 77)}


@given(st.lists(st.integers(0, 9), min_size=1, max_size=300), st.data())
@settings(max_examples=100, deadline=None)
def test_reach_and_contexts(values, data):
    values = np.array(values, np.uint64)
    c = data.draw(st.integers(0, len(values) - 1))
    l, r = cw.reach(values, c)
    assert values[l : r + 1].min() == values[c]
    assert (l == 0 or values[l - 1] < values[c]) and (r == len(values) - 1 or values[r + 1] < values[c])
    twice = np.concatenate([values, values])
    n = len(values)
    right, left = cw.contexts(twice, np.array([c, c + n]))
    inside = min(n - c - 1, cw.STEP * cw.LEVELS) // cw.STEP * 2
    assert (right[0, :inside] == right[1, :inside]).all()
    before = min(c, cw.STEP * cw.LEVELS) // cw.STEP * 2
    assert (left[0, :before] == left[1, :before]).all()
    hashes = np.array([1, 2**40 - 1, 2**41], np.uint64)
    assert cw.unpacked(cw.packed(hashes)).tolist() == [1, 2**40 - 1, 0]


def test_passages_of_nothing(no_documents):
    assert cw.near_passages(no_documents).collect() == []


# --- lines ---


def brute_lines(rows):
    held = collections.defaultdict(list)
    split = [(d, (t or "").split("\n")) for d, t in rows]
    key = lambda x: x.strip(" \t\n\v\f\r").encode().lower().decode()
    for n, (_, lines) in enumerate(split):
        for k in {key(x) for x in lines}:
            held[k].append(n)
    out = []
    for d, lines in split:
        kept = []
        for x in lines:
            own = held[key(x)]
            last = max((split[n][0] for n in own if split[n][0] is not None), default=None)
            if len(key(x)) < 20 or len(own) < 3 or d == last:
                kept.append(x)
        out.append((str(d), "\n".join(kept), len(lines), len(lines) - len(kept)))
    return sorted(out)


@pytest.mark.parametrize("shard", [1 << 19, 3])
def test_lines_against_brute_force(spark, odd_documents, shard):
    want = brute_lines([(r.doc_id, r.text) for r in odd_documents.collect()])
    more = odd_documents.selectExpr("*", "1 AS kept", "'x' AS lo")
    got = dedup_lines(more, shard_lines=shard).collect()
    assert sorted((str(r.doc_id), r.kept, r.n_lines, r.n_dropped) for r in got) == want


def test_lines_against_sql(spark):
    query = QUERIES["op10_perfect_hash_lines"]
    assert differences(query(spark, SF), oracle(SF), ORACLES["op10_perfect_hash_lines"]) == []


def test_lines_of_nothing(no_documents):
    assert dedup_lines(no_documents).collect() == []


@given(st.sets(st.tuples(st.integers(0, 2**64 - 1), st.integers(0, 2**64 - 1)), max_size=200))
@settings(max_examples=100, deadline=None)
def test_perfect_hash_numbers_every_key_once(keys):
    lo, hi = (np.array([k[i] for k in keys], np.uint64) for i in (0, 1))
    index = PerfectHash.of(lo, hi)
    again = PerfectHash([np.frombuffer(x.tobytes(), np.uint64) for x in index.levels])
    assert sorted(again.find(lo, hi).tolist()) == list(range(len(keys)))


def test_dense_places_are_those_of_dense_runs():
    pick = random.Random(8)
    for _ in range(60):
        x = np.array([pick.random() < pick.choice([0.3, 0.7, 0.95]) for _ in range(60)])
        share, least = pick.choice([0.5, 0.8, 8 / 9]), pick.randint(3, 20)
        want = np.zeros(60, bool)
        for i in range(60):
            for j in range(i + least, 61):
                if x[i:j].mean() >= share - 1e-12:
                    want[i:j] = True
        assert (cw.dense_places(x, share, least) == want).all()


def test_shuffles_of_finished_steps_leave_the_disk(spark):
    files = lambda: set(glob.glob(f"{tempfile.gettempdir()}/blockmgr-*/*/shuffle_*.data"))
    before = files()
    saved(spark.range(1000).repartition(3), "numbers")
    made = files() - before
    assert made
    release(spark)
    assert not made & files()


def test_needy_windows_meet_once(spark):
    """Two windows that are both needy make one pair, those beside a settled one all theirs."""
    rows = [(1, n, n, False, n < 3) for n in range(5)]
    windows = spark.createDataFrame(rows, "key long, node long, root long, covered boolean, needy boolean")
    got = [(r.u, r.v, r.key) for r in cw.all_links(windows, 1).collect()]
    assert sorted(got) == [(a, b, 1) for a in range(3) for b in range(a + 1, 5)]


def test_a_text_is_linked_once_for_many_windows(spark):
    """A text with many windows of one signature has one row of it, and counts as not covered
    if any of them lies in no passage."""
    spans = lambda places: np.array([(p, p, p) for p in places], "<i4").tobytes()
    texts = [(0, spans(range(300)), [7] * 300), (1, spans([5, 90, 91]), [7, 7, 8]), (2, spans([9]), [7])]
    marked = spark.createDataFrame(texts, "node long, marks binary, keys array<long>")
    found = spark.createDataFrame([(0, 1, 0, 50, 0, 50)], "u long, v long, ua long, uz long, va long, vz long")
    states = cw.text_states(marked, found, 5)
    got = {(r.node, r.key): (r.root, r.n, r.covered) for r in states.collect()}
    assert got == {(0, 7): (0, 300, False), (1, 7): (0, 2, False), (1, 8): (0, 1, False), (2, 7): (2, 1, False)}
    links = [(r.u, r.v, r.key) for r in cw.all_links(cw.open_signatures(states), 1).collect()]
    assert sorted(links) == [(0, 1, 7), (0, 2, 7), (1, 2, 7)]


def test_shingles_of_texts_in_a_row():
    texts = [None, b"", b"a b", b"a b c d e", b"A b c d e f g", b"x", b"e f g h i j"]
    base, text, sizes = cw.shingles_in_a_row(texts, 5)
    alone = [cw.shingle_hashes(t, 5) for t in texts]
    assert base.tolist() == np.concatenate(alone).tolist() and sizes.tolist() == [len(x) for x in alone]
    assert text.tolist() == np.repeat(np.arange(7), sizes).tolist()
    assert cw.shingles_in_a_row([b"a"], 5)[0].tolist() == []
