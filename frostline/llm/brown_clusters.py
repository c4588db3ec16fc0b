"""Class-based bigram model: exchange clustering, transitions and emissions."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from frostline.llm.workspace import Batches, bounded_batches, forget, map_partitions, map_rows, saved, utf8

#: Words that hold 1 / CLUSTERED of all training tokens or more are exchanged between classes;
#: there are CLUSTERED of them at most, whatever the corpus. All others are then placed in the
#: class that suits their neighbours best.
CLUSTERED = 65_534
#: Counts and classes of words that hold 1 / KNOWN of the training tokens or more go to all tasks;
#: there are KNOWN of them at most. Those of all other words are joined.
KNOWN = 1 << 20
RARE, END = 0, 1  # ids of other words, and of the end of a text
_END = xxhash.xxh64_intdigest(b"\n")  # no word holds white space


def token_hashes(data: bytes | None) -> np.ndarray:
    """64-bit hashes of the words of a text (A-Z in lower case) and of its end."""
    words = (data or b"").lower().split()
    words.append(b"\n")
    return np.fromiter(map(xxhash.xxh64_intdigest, words), np.uint64, len(words))


def tokens_of(texts: list[bytes | None]) -> tuple[np.ndarray, np.ndarray]:
    """The tokens of all texts, one after the other, and how many each has. A text's last token is its
    end, so before a text's first one stands an end as well."""
    parts = [token_hashes(t) for t in texts]
    return np.concatenate(parts), np.array([len(x) for x in parts])


def word_counts(docs: DataFrame) -> DataFrame:
    """(word, n): the hash and the count of every token of all texts."""

    def batch(b: pa.RecordBatch) -> pa.RecordBatch:
        words, n = np.unique(tokens_of(utf8(b.column("text")))[0], return_counts=True)
        return pa.record_batch([pa.array(words.view(np.int64)), pa.array(n)], ["word", "n"])

    return map_rows(docs.select("text"), batch, "word long, n long").groupBy("word").agg(
        F.sum("n").alias("n")
    )


class Words:
    """A bounded set of words as sorted hashes, with one number each.

    starts: for each beginning of a hash, the first place of such a word or of a later one. Hashes are
    spread evenly, so a word is found in a few steps from there."""

    def __init__(self, words: np.ndarray, values: np.ndarray):
        order = np.argsort(words)
        self.words, self.values = words[order], values[order]
        self.shift = np.uint64(64 - max(1, len(words).bit_length() + 1))
        self.starts = None  # made where it is used, not sent

    def __getstate__(self):
        return self.__dict__ | {"starts": None}

    def places(self, tokens: np.ndarray) -> np.ndarray:
        """The place of each token among the words, or -1."""
        if not len(self.words):
            return np.full(len(tokens), -1, np.int64)
        if self.starts is None:
            heads = np.arange(1 << 64 - int(self.shift), dtype=np.uint64) << self.shift
            self.starts = np.searchsorted(self.words, heads).astype(np.int32)
        last = len(self.words) - 1
        at = np.minimum(self.starts[tokens >> self.shift], last)
        there = self.words[at]
        rest = np.flatnonzero(there != tokens)
        missing = rest
        while len(rest):
            rest = rest[(there[rest] < tokens[rest]) & (at[rest] < last)]
            at[rest] += 1
            there[rest] = self.words[at[rest]]
        at[missing[there[missing] != tokens[missing]]] = -1
        return at

    def of(self, tokens: np.ndarray, default: int) -> np.ndarray:
        at = self.places(tokens)
        return np.where(at >= 0, self.values[at], default) if len(self.words) else np.full(len(tokens), default, np.int64)


def _collected(counts: DataFrame, total: int, most: int) -> tuple[np.ndarray, np.ndarray]:
    """The words that hold 1 / most of all tokens or more: `most` at most."""
    found = counts.where(F.col("n") * most >= total).orderBy(F.desc("n"), "word").toArrow()
    return found["word"].to_numpy().view(np.uint64), found["n"].to_numpy()


def pair_counts(docs: DataFrame, ids) -> DataFrame:
    """(pair, n): how often id follows id, as first * 65536 + second."""

    def batch(b: pa.RecordBatch) -> pa.RecordBatch:
        own = ids.value.of(tokens_of(utf8(b.column("text")))[0], RARE)
        pairs, n = np.unique(np.concatenate(([END], own[:-1])) << 16 | own, return_counts=True)
        return pa.record_batch([pa.array(pairs), pa.array(n)], ["pair", "n"])

    return map_rows(docs.select("text"), batch, "pair long, n long").groupBy("pair").agg(
        F.sum("n").alias("n")
    )


# --- exchange ----------------------------------------------------------------------


def _xlogx(x: np.ndarray) -> np.ndarray:
    return x * np.log(np.maximum(x, 1))


def class_matrix(pairs: DataFrame, classes, k: int) -> np.ndarray:
    """How often class follows class; k * k numbers."""

    def batch(b: pa.RecordBatch) -> pa.RecordBatch:
        pair, n = (b.column(c).to_numpy(zero_copy_only=False) for c in ("pair", "n"))
        of = classes.value
        sums = np.bincount(of[pair >> 16] * k + of[pair & 0xFFFF], n, k * k).astype(np.int64)
        at = np.flatnonzero(sums)
        return pa.record_batch([pa.array(at), pa.array(sums[at])], ["at", "n"])

    out = np.zeros(k * k, np.int64)
    for r in map_rows(pairs, batch, "at long, n long").groupBy("at").agg(F.sum("n")).collect():
        out[r[0]] = r[1]
    return out.reshape(k, k)


def best_class(
    matrix: np.ndarray, own: int, after: np.ndarray, before: np.ndarray, self_: int, movable: int
) -> int:
    """The class in which a word serves the likelihood of the class bigrams most.

    after, before: how often each class follows and precedes the word, itself included.
    """
    n = matrix.astype(np.float64)
    r, l = after.astype(np.float64).copy(), before.astype(np.float64).copy()
    r[own] -= self_
    l[own] -= self_  # the word's own neighbours of its class, without itself
    n[own, :] -= r
    n[:, own] -= l
    n[own, own] -= self_
    rows, columns = n.sum(1) + l, n.sum(0) + r  # what is before or after the word stays so
    diag = np.diag(n)
    gain = (_xlogx(n + r) - _xlogx(n)).sum(1) - (_xlogx(diag + r) - _xlogx(diag))
    gain += (_xlogx(n + l[:, None]) - _xlogx(n)).sum(0) - (_xlogx(diag + l) - _xlogx(diag))
    gain += _xlogx(diag + r + l + self_) - _xlogx(diag)
    gain -= _xlogx(rows + r.sum() + self_) - _xlogx(rows)
    gain -= _xlogx(columns + l.sum() + self_) - _xlogx(columns)
    best = int(np.argmax(gain[:movable]))
    return best if gain[best] > gain[own] + 1e-9 else own


def likelihood(matrix: np.ndarray) -> float:
    """What the classes add to the log likelihood of the training text."""
    sums = (matrix, matrix.sum(0), matrix.sum(1))
    whole, columns, rows = (float(_xlogx(x.astype(np.float64)).sum()) for x in sums)
    return whole - columns - rows


def moves(
    pairs: DataFrame, classes, matrix: np.ndarray, movable: int, turn: int, turns: int
) -> dict[int, int]:
    """New classes of the words whose turn it is, by exchange against the present counts.

    Sums of a word's neighbours by class come from all tasks; a word has 2 * k + 1 of them.
    """
    k = len(matrix)
    width = 2 * k + 1

    def profile(batches: Batches) -> Batches:
        of = classes.value
        sums: dict[int, int] = {}
        for b in batches:
            pair, n = (b.column(c).to_numpy(zero_copy_only=False) for c in ("pair", "n"))
            first, second = pair >> 16, pair & 0xFFFF
            keys = [first * width + of[second], second * width + k + of[first]]
            keys.append((first * width + 2 * k)[first == second])
            counts = [n, n, n[first == second]]
            found, inverse = np.unique(np.concatenate(keys), return_inverse=True)
            total = np.bincount(inverse, np.concatenate(counts)).astype(np.int64)
            word = found // width
            mine = (word > END) & (((word * 2654435761 >> 12) + turn) % turns == 0)
            yield pa.record_batch(
                [pa.array(found[mine] // width), pa.array(found[mine] % width), pa.array(total[mine])],
                ["word", "at", "n"],
            )

    profiles = (
        bounded_batches(pairs).mapInArrow(profile, "word long, at long, n long")
        .groupBy("word", "at")
        .agg(F.sum("n").alias("n"))
        .groupBy("word")
        .agg(F.collect_list(F.struct("at", "n")).alias("sums"))
    )

    def choose(b: pa.RecordBatch) -> pa.RecordBatch:
        of, best = classes.value, []
        words = b.column("word").to_pylist()
        for w, sums in zip(words, b.column("sums").to_pylist()):
            x = np.zeros(width, np.int64)
            x[[s["at"] for s in sums]] = [s["n"] for s in sums]
            best.append(
                best_class(matrix, int(of[w]), x[:k], x[k : 2 * k], int(x[2 * k]), movable)
            )
        return pa.record_batch([b.column("word"), pa.array(best, pa.int64())], ["word", "best"])

    found = map_rows(profiles, choose, "word long, best long").collect()  # CLUSTERED at most
    return {r["word"]: r["best"] for r in found}


# --- words too rare to be exchanged ------------------------------------------------------


class Gains:
    """By how much x log x grows at each of some rows of counts, if n is added to all of a row."""

    KEPT = 16  # what smaller n give is kept

    def __init__(self, seen: np.ndarray):
        self.seen = seen
        self.kept = np.stack([_xlogx(seen + n) - _xlogx(seen) for n in range(self.KEPT)])

    def of(self, row: np.ndarray, n: np.ndarray) -> np.ndarray:
        out = self.kept[np.minimum(n, self.KEPT - 1), row]
        many = np.flatnonzero(n >= self.KEPT)
        there = self.seen[row[many]]
        out[many] = _xlogx(there + n[many, None]) - _xlogx(there)
        return out


#: Rows of neighbours that a task holds at once, besides those of one word.
ROWS = 1 << 14


def whole_words(batches: Batches) -> Iterator[list[np.ndarray]]:
    """The columns word and sides of rows sorted by word, and n, how often each was met: ROWS rows or more
    at once, no word parted. Of a word with more rows, those with the same sides are added up."""
    held, rows = [], 0
    for b in batches:
        held.append([b.column("word").to_numpy(), b.column("sides").to_numpy(), np.ones(b.num_rows, np.int64)])
        rows += b.num_rows
        if rows < ROWS:
            continue
        word, sides, n = (np.concatenate(x) for x in zip(*held))
        last = int(np.searchsorted(word, word[-1]))
        if last:
            yield [word[:last], sides[:last], n[:last]]
        sides, at = np.unique(sides[last:], return_inverse=True)
        n = np.bincount(at, n[last:]).astype(np.int64)
        held, rows = [[np.full(len(sides), word[-1]), sides, n]], len(sides)
    if rows:
        yield [np.concatenate(x) for x in zip(*held)]


def placed_words(docs: DataFrame, ids, of: np.ndarray, matrix: np.ndarray, movable: int) -> DataFrame:
    """(word, n, class) of all words without an id: the class in which a word's neighbours raise
    the likelihood of the class bigrams most. Neighbours without an id count as one class.

    A word's neighbours come to one task, a row for both sides each time it is met."""
    k = len(matrix)
    width = 2 * k
    shared = docs.sparkSession.sparkContext.broadcast(of)

    def profile(b: pa.RecordBatch) -> pa.RecordBatch:
        tokens, _ = tokens_of(utf8(b.column("text")))
        own = ids.value.of(tokens, RARE)
        classes = shared.value[own]
        rare = np.flatnonzero(own == RARE)  # an end has an id, so something follows
        before = np.where(rare > 0, classes[rare - 1], shared.value[END])
        sides = (classes[rare + 1] * k + before).astype(np.int32)
        return pa.record_batch([pa.array(tokens[rare].view(np.int64)), pa.array(sides)], ["word", "sides"])

    rows = map_rows(docs.select("text"), profile, "word long, sides int")
    rows = rows.repartition("word").sortWithinPartitions("word")
    full = matrix.astype(np.float64)
    # for each neighbour, how often it follows and how often it precedes each class
    seen = np.concatenate((full[:movable].T, full[:, :movable]))
    whole = full.sum(1)[None, :movable], full.sum(0)[None, :movable]

    def choose(batches: Batches) -> Batches:
        by_side, by_class = Gains(seen), [Gains(x) for x in whole]
        for word, sides, n in whole_words(batches):
            first = np.append(True, word[1:] != word[:-1])
            number = np.cumsum(first) - 1
            words = word[first]
            at = np.concatenate((number * width + sides // k, number * width + k + sides % k))
            sums = np.bincount(at, np.concatenate((n, n)), len(words) * width).astype(np.int64)
            n = np.bincount(number, n).astype(np.int64)
            at = np.flatnonzero(sums)
            gain = by_side.of(at % width, sums[at])
            gain = np.add.reduceat(gain, np.searchsorted(at, np.arange(len(words)) * width))
            for x in by_class:
                gain -= x.of(np.zeros(len(n), np.int64), n)
            gain[:, whole[0][0] == 0] = -np.inf  # an empty class would suit every word, but not all at once
            columns = [words, n, gain.argmax(1).astype(np.int64)]
            yield pa.record_batch([pa.array(x) for x in columns], ["word", "n", "class"])

    return saved(bounded_batches(rows).mapInArrow(choose, "word long, n long, class long"), "placed")


def bigrams(tokens: np.ndarray, held: Words | np.ndarray, end: int, k: int):
    """Which tokens of texts have a class that is held (held: those words, or the class of each token, -1 if none); the classes before and of each token if both
    are held, as before * k + class; the tokens whose class has to be joined, each with what stands beside it; and the pairs of such
    tokens that follow one another.

    What stands beside a token is one number for both sides; a side has 0 where no class is held,
    else its class and one."""
    own = held.of(tokens, -1) if isinstance(held, Words) else held
    before = np.concatenate(([end], own[:-1]))
    near = (own >= 0) & (before >= 0)
    far = np.flatnonzero(own < 0)  # an end is held, so something follows
    beside = (before[far] + 1) * (k + 1) + own[far + 1] + 1
    both = far[before[far] < 0]
    words = (tokens[far], tokens[both - 1], tokens[both])
    return own >= 0, before[near] * k + own[near], beside, *(w.view(np.int64) for w in words)


def beside_pairs(k: int) -> tuple:
    """Columns: class before * k + class and class * k + class behind, of a token with its `class`
    and what stands `beside` it; null where that side's class is not held."""
    before = F.floor(F.col("beside") / (k + 1)) - 1
    behind = F.col("beside") % (k + 1) - 1
    return (
        F.when(before >= 0, before * k + F.col("class")),
        F.when(behind >= 0, F.col("class") * k + behind),
    )


def with_class(rows: DataFrame, placed: DataFrame, word: str, unseen: int, *more: str) -> DataFrame:
    """The rows with the `class` of a word, and other columns of `placed`."""
    names = placed.select(F.col("word").alias(word), "class", *more)
    return rows.join(names, word, "left").drop(word).withColumn("class", F.coalesce("class", F.lit(unseen)))


def pairs_of_far(rows: DataFrame, placed: DataFrame, unseen: int, k: int) -> DataFrame:
    """The rows (first, second) of two joined words with `pair`, class * k + class."""
    rows = with_class(rows, placed, "first", unseen).withColumnRenamed("class", "before")
    rows = with_class(rows, placed, "second", unseen)
    return rows.withColumn("pair", F.col("before") * k + F.col("class")).drop("before", "class")


def whole_matrix(docs: DataFrame, held, placed: DataFrame, end: int, unseen: int, k: int) -> np.ndarray:
    """How often class follows class, when all words have one; k * k numbers."""

    def batch(b: pa.RecordBatch) -> pa.RecordBatch:
        _, near, beside, words, first, second = bigrams(tokens_of(utf8(b.column("text")))[0], held.value, end, k)
        n = np.bincount(near)
        pairs = np.flatnonzero(n)
        n = n[pairs]
        sizes = [len(pairs), len(words), len(first)]

        def column(part: int, values: np.ndarray) -> pa.Array:
            parts = [pa.nulls(size, pa.int64()) for size in sizes]
            parts[part] = pa.array(values, pa.int64())
            return pa.concat_arrays(parts)

        columns = [(0, pairs), (0, n), (1, words), (1, beside), (2, first), (2, second)]
        return pa.record_batch([column(*x) for x in columns], ["pair", "n", "word", "beside", "first", "second"])

    schema = "pair long, n long, word long, beside long, first long, second long"
    found = saved(map_rows(docs.select("text"), batch, schema), "bigrams")
    near = found.where("pair IS NOT NULL").select("pair", "n")
    one = F.lit(1).cast("long").alias("n")
    mixed = with_class(found.where("word IS NOT NULL").select("word", "beside"), placed, "word", unseen)
    mixed = mixed.select(F.explode(F.array(*beside_pairs(k))).alias("pair"), one).where("pair IS NOT NULL")
    far = pairs_of_far(found.where("first IS NOT NULL").select("first", "second"), placed, unseen, k)
    out = np.zeros(k * k, np.int64)
    for r in near.unionByName(mixed).unionByName(far.select("pair", one)).groupBy("pair").agg(F.sum("n")).collect():
        out[r[0]] = r[1]
    forget(found)
    return out.reshape(k, k)


class Model:
    """Counts and classes: what scoring needs beside those of rare words.

    masses: of the words placed in each class, their counts with 0.5 added to each. Words that
    training has not seen have a class of their own."""

    def __init__(self, ids: Words, known: Words, held: Words, classes, matrix, counts, masses, tokens, vocabulary, mix):
        self.ids, self.known, self.held, self.classes = ids, known, held, classes
        self.tokens, self.vocabulary = tokens, vocabulary
        k = len(matrix)
        self.floor = tokens + 0.5 * (vocabulary + 1)
        mass = np.bincount(classes, counts + 0.5, k) + masses  # of the words of each class
        mass[classes[RARE]] = 0.5
        transition = (matrix + 0.5) / (matrix.sum(1, keepdims=True) + 0.5 * k)
        share = np.divide(1.0, mass, out=np.zeros(k), where=mass > 0)
        self.weight = np.log10(mix * transition * share + (1 - mix) / self.floor)


def train(
    docs: DataFrame, classes: int = 64, rounds: int = 8, mix: float = 0.8
) -> tuple[Model, DataFrame]:
    """Learns from all `docs` (text): the model, and the table of all words (word, n), with their
    class if it is not among those that the model holds.

    Words are dealt to classes in the order of their counts, then exchanged: in every round
    half of them move to the class that raises the likelihood most. Words that move at once
    do not see one another; if the likelihood falls, the round is taken back and half as
    many move from then on. Words too rare for that are one class meanwhile; then each is placed
    in the class that suits its neighbours best. The end of a text has a class of its own.
    """
    context = docs.sparkSession.sparkContext
    counts = saved(word_counts(docs), "words")
    tokens, vocabulary = counts.agg(F.coalesce(F.sum("n"), F.lit(0)), F.count(F.lit(1))).first()
    known = Words(*_collected(counts, tokens, max(KNOWN, CLUSTERED)))  # of all words whose class is held
    words, n = _collected(counts, tokens, CLUSTERED)
    end = words == np.uint64(_END)
    words, n_end, n = words[~end][: CLUSTERED - 1], known.of(np.array([_END], np.uint64), 0), n[~end][: CLUSTERED - 1]
    all_words = np.concatenate((words, [np.uint64(_END)]))
    ids = Words(all_words, np.concatenate((np.arange(len(words)) + 2, [END])))
    if not n_end[0] and tokens:  # texts so long that their end is rare
        n_end = [counts.where(F.col("word") == np.uint64(_END).view(np.int64).item()).first()["n"]]
        known = Words(np.append(known.words, np.uint64(_END)), np.append(known.values, n_end[0]))
    own = np.concatenate(([0], n_end, n)).astype(np.int64)
    k = classes + 2
    of = np.concatenate(([classes, classes + 1], np.arange(len(words)) % classes)).astype(np.int64)
    sent = context.broadcast(ids)
    pairs = saved(pair_counts(docs, sent), "pairs")
    shared = context.broadcast(of)
    matrix = class_matrix(pairs, shared, k)
    turns = 2
    for turn in range(rounds if len(words) else 0):
        tried = of.copy()
        for w, c in moves(pairs, shared, matrix, classes, turn, turns).items():
            tried[w] = c
        sent_classes = context.broadcast(tried)
        changed = class_matrix(pairs, sent_classes, k)
        if likelihood(changed) > likelihood(matrix):
            of, matrix, shared = tried, changed, sent_classes
        else:
            turns *= 2
    forget(pairs)
    masses, held = np.zeros(k), Words(all_words, of[ids.of(all_words, RARE)])
    counts = counts.withColumn("class", F.lit(None).cast("long"))
    if vocabulary > len(all_words):
        placed = placed_words(docs, sent, of, matrix, classes)
        for r in placed.groupBy("class").agg(F.sum(F.col("n") + 0.5)).collect():
            masses[r[0]] = r[1]
        near = placed.where(F.col("n") * KNOWN >= tokens).select("word", "class").toArrow()  # KNOWN at most
        held = Words(
            np.concatenate((all_words, near["word"].to_numpy().view(np.uint64))),
            np.concatenate((held.of(all_words, 0), near["class"].to_numpy())),
        )
        far = placed.where(F.col("n") * KNOWN < tokens)
        matrix = whole_matrix(docs, context.broadcast(held), far, classes + 1, classes, k)
        counts = counts.drop("class").join(far.select("word", "class"), "word", "left")
        counts = saved(counts, "classes")
    return Model(ids, known, held, of, matrix, own, masses, tokens, vocabulary, mix), counts


LISTS = ["beside", "words", "first", "second"]


def score(docs: DataFrame, model: Model, counts: DataFrame) -> DataFrame:
    """doc_id, extra columns of `docs`, n_tokens, n_known, base_score, score of every row.

    Each task scores what the model holds; rarer words are joined once to their counts and
    classes, with the classes beside them, and added up by text. Two such words in a row
    are joined both.
    """
    sent = docs.sparkSession.sparkContext.broadcast(model)
    extra = [c for c in docs.columns if c != "text"]
    k = len(model.weight)

    def make():
        m = sent.value
        weights = m.weight.ravel()
        # by place among the held words; the last is for all others
        classes = np.append(m.held.values, -1)
        counts = np.append(m.known.of(m.held.words, 0), 0)
        logs = np.append(np.log10(counts[:-1] + 0.5), 0.0)

        def batch(b: pa.RecordBatch) -> pa.RecordBatch:
            tokens, n_tokens = tokens_of(utf8(b.column("text")))
            at = m.held.places(tokens)
            ends = np.cumsum(n_tokens)
            starts = ends - n_tokens
            there, near, *far = bigrams(tokens, classes[at], int(m.classes[END]), k)
            before = np.append(True, there[:-1])
            near_weights = np.zeros(len(tokens))
            near_weights[there & before] = weights[near]

            def lists(of: np.ndarray, values: np.ndarray) -> pa.Array:
                bounds = np.append(0, np.cumsum(of)[ends - 1]).astype(np.int32)
                return pa.ListArray.from_arrays(pa.array(bounds), pa.array(values))

            marks = [~there] * 2 + [~there & ~before] * 2
            far[0] = far[0].astype(np.int32)
            sums = [np.add.reduceat(x, starts) for x in ((counts[at] > 0).astype(np.int64), logs[at], near_weights)]
            return pa.record_batch(
                [*[b.column(c) for c in extra], *map(pa.array, (n_tokens, *sums)), *map(lists, marks, far)],
                [*extra, "n_tokens", "n_known", "logs", "weights", *LISTS],
            )

        return batch

    kept = [f"`{c}` {docs.schema[c].dataType.simpleString()}" for c in extra]
    schema = "n_tokens long, n_known long, logs double, weights double, beside array<int>, "
    schema += "words array<long>, first array<long>, second array<long>"
    table = saved(
        map_partitions(docs.select(*[F.col(f"`{c}`") for c in extra], "text"), make, ", ".join([*kept, schema])).withColumn(
            "row", F.monotonically_increasing_id()
        ),
        "scored",
    )
    placed = counts.where("class IS NOT NULL").select("word", "class", "n")
    unseen = int(model.classes[RARE])
    weights = [(i, float(w)) for i, w in enumerate(model.weight.ravel())]
    of_pair = F.broadcast(docs.sparkSession.createDataFrame(weights, "pair long, weight double"))  # k * k
    far = table.select("row", F.explode(F.arrays_zip("words", "beside")).alias("x"))
    far = far.select("row", F.col("x.words").alias("word"), F.col("x.beside").alias("beside"))
    far = with_class(far, placed, "word", unseen, "n").withColumn("n", F.coalesce("n", F.lit(0)))
    for name, pair in zip(("before", "behind"), beside_pairs(k)):
        far = far.withColumn("pair", pair).join(of_pair.withColumnRenamed("weight", name), "pair", "left").drop("pair")
    far = far.select(
        "row", "n", (F.coalesce("before", F.lit(0.0)) + F.coalesce("behind", F.lit(0.0))).alias("weight")
    )
    both = table.select("row", F.explode(F.arrays_zip("first", "second")).alias("x")).select("row", "x.*")
    both = pairs_of_far(both, placed, unseen, k).join(of_pair, "pair")
    sums = (
        far.unionByName(both.select("row", F.lit(None).cast("long").alias("n"), "weight"))
        .groupBy("row")
        .agg(
            F.sum(F.log10(F.col("n") + 0.5)).alias("more"),
            F.count_if(F.col("n") > 0).alias("seen"),
            F.sum("weight").alias("far"),
        )
    )
    logs = F.col("logs") + F.coalesce("more", F.lit(0.0))
    return table.join(sums, "row", "left").select(
        *extra,
        "n_tokens",
        (F.col("n_known") + F.coalesce("seen", F.lit(0))).alias("n_known"),
        (logs - F.col("n_tokens") * float(np.log10(model.floor or 1))).alias("base_score"),
        (logs + F.col("weights") + F.coalesce("far", F.lit(0.0))).alias("score"),
    )


def brown_scores(
    docs: DataFrame, classes: int = 64, rounds: int = 8, mix: float = 0.8, folds: int = 5, held: int = 1
) -> DataFrame:
    """Per row: doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score and
    perplexity (of `score`, per token).

    The model learns from the rows for which crc32(doc_id) mod `folds` is not `held`; all
    rows are scored. Tokens are words, A-Z in lower case, and one end per text; a null or
    empty text has the end alone. base_score is the unigram model with 0.5 added to every
    count. In `score`, a token has probability mix * P(class | class before) * P(token |
    class) + (1 - mix) * the unigram's, each with 0.5 added to counts; words that training
    has not seen share one class. A null doc_id is in training. If nothing is in training, all
    probabilities are those of no counts. Repeated rows count and are scored each time.
    """
    rows = docs.select(F.col("doc_id"), F.col("text")).withColumn(
        "held_out",
        F.crc32(F.coalesce(F.col("doc_id").cast("string"), F.lit("")).cast("binary")) % folds == held,
    )
    model, counts = train(rows.where("NOT held_out"), classes, rounds, mix)
    return (
        score(rows, model, counts)
        .withColumn("train_tokens", F.lit(int(model.tokens)).cast("long"))
        .withColumn("perplexity", F.pow(F.lit(10.0), -F.col("score") / F.col("n_tokens")))
        .select("doc_id", "held_out", "n_tokens", "n_known", "train_tokens", "base_score", "score", "perplexity")
    )
