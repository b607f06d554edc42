"""A class-based bigram language model with classes from exchange clustering.

Every word belongs to a unit: each word that occurs MIN times or more in training is its own (UNITS words at most, the most frequent), the
others share ENDINGS units by their ending, and the end of a text is one. Bigrams of units are counted over all training texts and laid out by word, in
blocks. The exchange algorithm moves units between classes while that raises the likelihood of class bigrams: first the SEQUENTIAL most
frequent units one after another, then all units in Spark rounds, where each block weighs its own words' moves exactly against the
classes at the start of the round, half of the words a round. Where moves at once undo each other, only the best part of those into each class is made. A word's probability is that of its class after the class before it, times its own in its
class; both add-constant smoothed. Words are counted over all training texts, by 64-bit hash. The counts of the LOCAL most frequent words go
to all tasks; a text's other words are joined with the counts by shuffle, so no count is left out at any size of the vocabulary.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from fieldglass.llm.common import bucket_of, flat, mixed, pieces, staged, word_hashes, words

#: Least count of a word with a unit of its own, units for endings, classes (0 is the end of a text), smoothing of class bigrams.
MIN, ENDINGS, CLASSES, SMOOTH = 20, 323, 128, 0.1
#: Units that are exchanged one after another, rounds of that, rounds over all units.
SEQUENTIAL, FIRST_ROUNDS, ROUNDS = 1024, 5, 8
#: Of the moves into a class at least the part 2 ** -LEAST_SHARE is tried (and always the best one).
LEAST_SHARE = 10
#: Words whose counts go to all tasks: LOCAL at most, none rarer than LOCAL_MIN. Units fit SHIFT bits.
SHIFT = 20
LOCAL, LOCAL_MIN = (1 << SHIFT) - 1024, 5
#: Tokens whose bigrams a task holds at once, pairs of a stored row, blocks of words at least and at most.
TOKENS, ROW_PAIRS, LEAST_BLOCKS, MOST_BLOCKS = 4_000_000, 1_000_000, 16, 1 << 14
HELD_OUT, MODULUS = 2, 7
#: Stands for the end of a text among word hashes.
END = np.uint64(0x656E64206F662074)


def endings(data: np.ndarray, starts: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """A number below ENDINGS from the last three bytes of each word, A-Z lower-cased."""
    code = np.zeros(len(starts), np.uint64)
    for k in range(3):
        byte = np.where(lengths > k, data[starts + np.maximum(lengths - 1 - k, 0)], 0).astype(np.uint64)
        byte += np.uint64(32) * ((byte >= 65) & (byte <= 90)).astype(np.uint64)
        code = code * np.uint64(256) + byte
    return (mixed(code + np.uint64(1)) % np.uint64(ENDINGS)).astype(np.int32)


def read(column: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Hash, ending and row of each token, each text followed by its END (ending -1)."""
    data, offsets = flat(column)
    starts, lengths, rows = words(data, offsets)
    h = word_hashes(data, starts, lengths) if len(starts) else np.zeros(0, np.uint64)
    tails = endings(data, starts, lengths) if len(starts) else np.zeros(0, np.int32)
    at = np.cumsum(np.bincount(rows, minlength=len(column)))
    return np.insert(h, at, END), np.insert(tails, at, -1), np.insert(rows, at, np.arange(len(column)))


def _counts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in pieces(batches, "text", 8_000_000):
        h, tails, _ = read(batch.column("text"))
        word, first, n = np.unique(h, return_index=True, return_counts=True)
        yield pa.RecordBatch.from_arrays([pa.array(word.view(np.int64)), pa.array(tails[first]), pa.array(n.astype(np.int64))], ["word", "tail", "n"])


@dataclass
class Vocabulary:
    """Sorted hashes of the LOCAL words, their counts and units (-1: by ending); how many words have a unit; tokens and distinct words of training."""

    words: np.ndarray
    counts: np.ndarray
    unit: np.ndarray
    own: int
    tokens: int
    distinct: int

    @property
    def size(self) -> int:
        """All units: own words, then endings, then the end of a text."""
        return self.own + ENDINGS + 1

    def find(self, h: np.ndarray, tails: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Unit of each token, whether it is a LOCAL word, and its count then."""
        at = np.minimum(np.searchsorted(self.words, h), len(self.words) - 1)
        here = (self.words[at] == h) & (self.counts[at] > 0)
        unit = np.where(here, self.unit[at], -1).astype(np.int64)
        unit = np.where(tails < 0, self.size - 1, np.where(unit < 0, self.own + np.maximum(tails, 0), unit))
        return unit, here, np.where(here, self.counts[at], 0)


def vocabulary(counts: DataFrame) -> Vocabulary:
    """From all words' counts (word, n). The driver gets LOCAL words at most."""
    distinct, total = counts.agg(F.count("*"), F.coalesce(F.sum("n"), F.lit(0))).first()
    # the least count with which all words fit, from how many words have each: 64 steps a doubling
    step = lambda c: F.floor(F.log2(c) * 64)
    often = counts.where(F.col("n") >= LOCAL_MIN).groupBy(step("n").alias("step")).agg(F.count("*").alias("words"), F.min("n").alias("least")).orderBy(F.desc("step")).collect()
    least, fit = None, 0
    for r in often:
        if (fit := fit + r["words"]) > LOCAL:
            break
        least = r["least"]
    if least is None:
        return Vocabulary(np.array([END]), np.zeros(1, np.int64), np.array([-1], np.int32), 0, int(total), int(distinct))
    top = counts.where(F.col("n") >= least).select("word", "n").toArrow()
    h, n = top.column("word").to_numpy().view(np.uint64), top.column("n").to_numpy()
    ranked = np.lexsort((h, -n))
    ranked = ranked[(h[ranked] != END) & (n[ranked] >= MIN)]
    unit = np.full(len(h), -1, np.int32)
    unit[ranked] = np.arange(len(ranked))
    order = np.argsort(h)
    return Vocabulary(h[order], n[order], unit[order], len(ranked), int(total), int(distinct))


def _coded(code: np.ndarray, n: np.ndarray) -> tuple[bytes, int]:
    """Sorted codes as differences, and their counts, compressed."""
    raw = np.diff(code, prepend=0).astype("<i8").tobytes() + n.astype("<i8").tobytes()
    return pa.compress(raw, "zstd", asbytes=True), len(code)


def _decoded(pairs: bytes, size: int) -> tuple[np.ndarray, np.ndarray]:
    raw = np.frombuffer(pa.decompress(pairs, 16 * size, "zstd"), "<i8")
    return np.cumsum(raw[:size]), raw[size:]


def _summed(code: np.ndarray, n: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    order = np.argsort(code, kind="stable")
    code, n = code[order], n[order]
    first = np.flatnonzero(np.diff(code, prepend=-1))
    return code[first], np.add.reduceat(n, first) if len(first) else n


def _bigrams(vocab: Vocabulary, blocks: int) -> Callable:
    """Rows of a block of words: codes of (word, 0, next word) and (word, 1, word before), and counts."""

    def sent(pairs: list[np.ndarray]) -> pa.RecordBatch:
        pair, n = np.unique(np.concatenate(pairs), return_counts=True)
        before, after = pair >> SHIFT, pair & ((1 << SHIFT) - 1)
        code = np.concatenate([before << SHIFT + 1 | after, after << SHIFT + 1 | 1 << SHIFT | before])
        n = np.concatenate([n, n])
        block = (code >> SHIFT + 1) % blocks
        order = np.lexsort((code, block))
        code, n, block = code[order], n[order], block[order]
        cuts = [*np.flatnonzero(np.diff(block, prepend=-1)).tolist(), len(block)]
        out = [(int(block[a]), *_coded(code[a:b], n[a:b])) for a, b in zip(cuts, cuts[1:], strict=False)]
        return pa.RecordBatch.from_arrays([pa.array(c) for c in zip(*out, strict=True)], ["block", "pairs", "size"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, n = [], 0
        for batch in pieces(batches, "text"):
            u = vocab.find(*read(batch.column("text"))[:2])[0]
            held.append(np.concatenate([[vocab.size - 1], u[:-1]]) << SHIFT | u)  # a text begins after an end
            if (n := n + len(u)) >= TOKENS:
                yield sent(held)
                held, n = [], 0
        if n:
            yield sent(held)

    return run


def _merged(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The rows of each block added up, as rows of about ROW_PAIRS that hold all pairs of their words."""
    block, held, size = None, [], 0

    def added() -> tuple[np.ndarray, np.ndarray]:
        return _summed(*(np.concatenate(x) for x in zip(*held, strict=True)))

    def sent() -> Iterator[pa.RecordBatch]:
        code, n = added()
        begin = np.flatnonzero(np.diff(code >> SHIFT + 1, prepend=-1))
        cuts = np.unique(begin[np.searchsorted(begin, np.arange(0, len(code), ROW_PAIRS), side="right") - 1])
        for a, b in zip(cuts, [*cuts[1:], len(code)], strict=True):
            pairs, many = _coded(code[a:b], n[a:b])
            yield pa.RecordBatch.from_arrays([pa.array([pairs]), pa.array([many])], ["pairs", "size"])

    for batch in batches:
        for row in batch.to_pylist():
            if held and row["block"] != block:
                yield from sent()
                held, size = [], 0
            block = row["block"]
            held.append(_decoded(row["pairs"], row["size"]))
            if (size := size + row["size"]) > 4 * ROW_PAIRS:
                held = [added()]
                size = len(held[0][0]) // 2  # so that a block of many distinct pairs isn't added up at each row
    if held:
        yield from sent()


def bigrams(train: DataFrame, vocab: Vocabulary) -> DataFrame:
    """All bigrams of units by word: rows of pairs (see _bigrams) and their number."""
    blocks = min(MOST_BLOCKS, max(LEAST_BLOCKS, vocab.tokens // TOKENS))
    found = train.mapInArrow(_bigrams(vocab, blocks), "block long, pairs binary, size long")
    placed = found.repartition(blocks, "block").sortWithinPartitions("block")
    return staged(placed.mapInArrow(_merged, "pairs binary, size long"), "bigrams")


def by_class(code: np.ndarray, n: np.ndarray, of: np.ndarray, classes: int = CLASSES) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Of the words of a row: ids, counts (word, side, class of the other), counts of the word after itself."""
    word, side, other = code >> SHIFT + 1, code >> SHIFT & 1, code & ((1 << SHIFT) - 1)
    ids, at = np.unique(word, return_inverse=True)
    cells = np.bincount((at * 2 + side) * classes + of[other], n, len(ids) * 2 * classes).reshape(len(ids), 2, classes)
    itself = np.bincount(at, n * ((side == 0) & (word == other)), len(ids))
    return ids, cells, itself


def _table(of: np.ndarray) -> Callable:
    """Counts of class bigrams of a task's rows, as one row."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros((CLASSES, CLASSES))
        for batch in batches:
            for pairs, size in zip(batch.column("pairs"), batch.column("size"), strict=True):
                code, n = _decoded(pairs.as_py(), size.as_py())
                next_ = code >> SHIFT & 1 == 0
                code, n = code[next_], n[next_]
                total += np.bincount(of[code >> SHIFT + 1].astype(np.int64) * CLASSES + of[code & ((1 << SHIFT) - 1)], n, CLASSES**2).reshape(CLASSES, CLASSES)
        yield pa.RecordBatch.from_arrays([pa.array([total.tobytes()])], ["counts"])

    return run


def class_table(pairs: DataFrame, of: np.ndarray) -> np.ndarray:
    total = np.zeros((CLASSES, CLASSES))
    for r in pairs.mapInArrow(_table(of), "counts binary").toLocalIterator():  # a small row a task
        total += np.frombuffer(r["counts"]).reshape(CLASSES, CLASSES)
    return total


def _xlogx(x: np.ndarray) -> np.ndarray:
    return x * np.log(np.maximum(x, 1e-300))


def likelihood(table: np.ndarray) -> float:
    """What classes add to the log likelihood of a class bigram model, but for a constant."""
    return float(_xlogx(table).sum() - _xlogx(table.sum(axis=0)).sum() - _xlogx(table.sum(axis=1)).sum())


def gains(table: np.ndarray, before: np.ndarray, after: np.ndarray, itself: np.ndarray, own: np.ndarray) -> np.ndarray:
    """For each word and class, the likelihood with the word there, less that without the word.

    before, after: counts of each class before and after the word, the word itself among its own class; itself: counts of the word after itself.
    """
    m, classes = before.shape
    at = np.arange(m)
    a, b = before.copy(), after.copy()
    a[at, own] -= itself
    b[at, own] -= itself
    rest = np.repeat(table[None], m, axis=0)
    rest[at, :, own] -= a
    rest[at, own, :] -= b
    rest[at, own, own] -= itself
    rest = np.maximum(rest, 0)
    rows, cols = rest.sum(axis=2), rest.sum(axis=1)
    gain = np.zeros((m, classes))
    for x, part in ((a, rest), (b, rest.transpose(0, 2, 1))):
        word, other = np.nonzero(x)  # a rare word is beside few classes, and no other cell changes
        if len(word):
            here = part[word, other]
            ids, first = np.unique(word, return_index=True)
            gain[ids] += np.add.reduceat(_xlogx(here + x[word, other][:, None]) - _xlogx(here), first, axis=0)
    cell = np.diagonal(rest, axis1=1, axis2=2)
    gain += _xlogx(cell + a + b + itself[:, None]) - _xlogx(cell + a) - _xlogx(cell + b) + _xlogx(cell)
    # other rows grow by a, the class's own row by b and the self count too; columns likewise
    for sums, x, y in ((rows, a, b), (cols, b, a)):
        grown = _xlogx(sums + x) - _xlogx(sums)
        gain -= grown.sum(axis=1, keepdims=True) - grown + _xlogx(sums + x + (y.sum(axis=1) + itself)[:, None]) - _xlogx(sums)
    return gain


def exchanged(pairs: np.ndarray, classes: int = CLASSES, rounds: int = FIRST_ROUNDS, fixed: int | None = None) -> np.ndarray:
    """The class of each unit: starting from classes by rank of count, each unit in turn moves to the class that raises the likelihood most.

    pairs: counts of each unit after each. fixed: a unit that stays alone in class 0.
    """
    size = len(pairs)
    often = pairs.sum(axis=0) + pairs.sum(axis=1)
    ranked = [w for w in np.argsort(-often, kind="stable") if w != fixed]
    least = 0 if fixed is None else 1
    of = np.zeros(size, np.int64)
    of[ranked] = least + np.arange(len(ranked)) % (classes - least)
    member = np.eye(classes)[of]
    left, right = pairs.T @ member, pairs @ member  # of each unit: counts after each class, before each class
    table = member.T @ right
    for _ in range(rounds):
        moved = 0
        for w in ranked:
            if not often[w]:
                break
            own, s = of[w], pairs[w, w]
            gain = gains(table, left[w][None], right[w][None], np.array([s]), np.array([own]))[0]
            best = least + int(np.argmax(gain[least:]))
            if best != own and gain[best] > gain[own] + 1e-9:
                moved += 1
                a, b = left[w].copy(), right[w].copy()
                a[own] -= s
                b[own] -= s
                for k, sign in ((own, -1), (best, 1)):
                    table[:, k] += sign * a
                    table[k, :] += sign * b
                    table[k, k] += sign * s
                of[w] = best
                left[:, own] -= pairs[w]
                left[:, best] += pairs[w]
                right[:, own] -= pairs[:, w]
                right[:, best] += pairs[:, w]
        if moved <= size // 200:
            break
    return of


def _first_units(chosen: np.ndarray) -> Callable:
    """Dense counts of the chosen units after each chosen one; place: number among the chosen, -1 of others."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        many = int(chosen.max()) + 1
        for batch in batches:
            for pairs, size in zip(batch.column("pairs"), batch.column("size"), strict=True):
                code, n = _decoded(pairs.as_py(), size.as_py())
                row, col = chosen[code >> SHIFT + 1], chosen[code & ((1 << SHIFT) - 1)]
                some = (code >> SHIFT & 1 == 0) & (row >= 0) & (col >= 0)
                row, col, n = row[some], col[some], n[some]
                which, at = np.unique(row, return_inverse=True)
                counts = np.bincount(at * many + col, n, len(which) * many).reshape(len(which), many)
                yield pa.RecordBatch.from_arrays([pa.array(which), pa.array([c.tobytes() for c in counts], pa.binary())], ["unit", "counts"])

    return run


def _moves(of: np.ndarray, table: np.ndarray, turn: int, last: int) -> Callable:
    """The words of this turn's half that move, where, and what each alone gains."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for pairs, size in zip(batch.column("pairs"), batch.column("size"), strict=True):
                ids, cells, itself = by_class(*_decoded(pairs.as_py(), size.as_py()), of)
                some = np.flatnonzero((mixed(ids.astype(np.uint64)) & np.uint64(1) == turn % 2) & (ids != last))
                unit, to, gained = [], [], []
                for part in np.array_split(some, max(1, len(some) // 64)):
                    if len(part):
                        own = of[ids[part]].astype(np.int64)
                        gain = gains(table, cells[part, 1], cells[part, 0], itself[part], own)[:, 1:]
                        best = gain.argmax(axis=1) + 1
                        more = gain[np.arange(len(part)), best - 1] - gain[np.arange(len(part)), own - 1]
                        better = more > 1e-6
                        unit.append(ids[part][better])
                        to.append(best[better])
                        gained.append(more[better])
                if unit:
                    yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(unit)), pa.array(np.concatenate(to).astype(np.int32)), pa.array(np.concatenate(gained))], ["unit", "class", "gain"])

    return run


def clustered(pairs: DataFrame, vocab: Vocabulary, tails: np.ndarray) -> tuple[np.ndarray, np.ndarray, list[float]]:
    """The class of each unit, the counts of class bigrams, and the likelihood at the start and after each round. tails: the ending of each own word."""
    last = vocab.size - 1
    own = min(SEQUENTIAL - ENDINGS - 1, vocab.own)
    chosen = np.full(vocab.size, -1)
    chosen[np.r_[0:own, vocab.own : vocab.size]] = np.arange(own + ENDINGS + 1)
    first = np.zeros((own + ENDINGS + 1,) * 2)
    for r in pairs.mapInArrow(_first_units(chosen), "unit long, counts binary").toLocalIterator():  # SEQUENTIAL rows
        first[r["unit"]] += np.frombuffer(r["counts"])
    start = exchanged(first, fixed=len(first) - 1)
    of = np.zeros(vocab.size, np.int16)
    of[chosen >= 0] = start
    of[own : vocab.own] = of[vocab.own + tails[own:]]  # a word begins with its ending's class
    table = class_table(pairs, of)
    log = [likelihood(table)]
    share, still = 0, 0
    for turn in range(ROUNDS):
        moves = pairs.mapInArrow(_moves(of, table, turn, last), "unit long, class int, gain double").toArrow()  # LOCAL rows at most
        unit, to, gain = (moves.column(c).to_numpy() for c in ("unit", "class", "gain"))
        # moves at once into one class can undo each other: then only the best part of each class's, in later rounds too
        order = np.lexsort((unit, -gain, to))
        of_class = np.bincount(to, minlength=CLASSES)
        place = np.empty(len(unit), np.int64)
        place[order] = np.arange(len(unit)) - (np.cumsum(of_class) - of_class)[to[order]]
        raised = False
        while len(unit) and share <= LEAST_SHARE and not raised:
            some = place <= (of_class[to] - 1) >> share
            moved = of.copy()
            moved[unit[some]] = to[some]
            new = class_table(pairs, moved)
            if raised := likelihood(new) > likelihood(table):
                of, table = moved, new
                log.append(likelihood(table))
            else:
                share += 2
        still = 0 if raised else still + 1
        if still == 2:
            break
    return of, table, log


@dataclass
class ClassModel:
    """The vocabulary; the class of each unit; log10 class bigrams; log10 (words + tokens + 1) of each class."""

    vocab: Vocabulary
    of: np.ndarray
    steps: np.ndarray
    bases: np.ndarray


def _score(m: ClassModel) -> Callable:
    kinds = ["uid", "doc_id", "held_out", "n_tokens", "known", "base", "model", "words", "times"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        uid = TaskContext.get().partitionId() << 33
        unit_base = math.log10(m.vocab.tokens + m.vocab.distinct + 1)
        for batch in pieces(batches, "text"):
            size = batch.num_rows
            h, tails, rows = read(batch.column("text"))
            unit, here, count = m.vocab.find(h, tails)
            c = m.of[unit]
            before = np.concatenate([[m.of[m.vocab.size - 1]], c[:-1]])
            step = m.steps[before, c] - m.bases[c]
            emit = np.log10(count + 1.0)
            n = np.bincount(rows, minlength=size)
            known = np.bincount(rows, here, size).astype(np.int64)
            emitted = np.bincount(rows, emit, size)
            far = np.flatnonzero(~here)
            far = far[np.lexsort((h[far], rows[far]))]
            first = np.flatnonzero(np.r_[True, (np.diff(rows[far]) != 0) | (np.diff(h[far]) != 0)]) if len(far) else np.zeros(0, np.int64)
            times = np.diff(np.r_[first, len(far)])
            cuts = np.searchsorted(rows[far][first], np.arange(size + 1)).astype(np.int32)
            lists = [pa.ListArray.from_arrays(cuts, x) for x in (h[far][first].view(np.int64), times.astype(np.int64))]
            ids = np.arange(uid, uid + size)
            uid += size
            values = [pa.array(ids), batch.column("doc_id"), batch.column("held_out"), pa.array(n.astype(np.int64)), pa.array(known), pa.array(emitted - n * unit_base), pa.array(emitted + np.bincount(rows, step, size)), *lists]
            yield pa.RecordBatch.from_arrays(values, kinds)

    return run


def trained(train: DataFrame) -> tuple[ClassModel, DataFrame]:
    """The model, and the counts of all training words: word, tail, n. train: text."""
    counts = staged(train.mapInArrow(_counts, "word long, tail int, n long").groupBy("word").agg(F.first("tail").alias("tail"), F.sum("n").alias("n")), "vocabulary")
    vocab = vocabulary(counts)
    # distinct words and tokens of each ending, of words without a unit; endings of those with one
    own = np.sort(vocab.words[vocab.unit >= 0])
    least = int(vocab.counts[vocab.unit >= 0].min()) if len(own) else None
    rare = counts.where("tail >= 0") if least is None else counts.where((F.col("tail") >= 0) & (F.col("n") < least))
    spread, tokens = np.zeros(vocab.size), np.zeros(vocab.size)
    for r in rare.groupBy("tail").agg(F.count("*").alias("words"), F.sum("n").alias("n")).collect():  # ENDINGS rows
        spread[vocab.own + r["tail"]], tokens[vocab.own + r["tail"]] = r["words"], r["n"]
    tails = np.zeros(vocab.own, np.int64)
    if least is not None:
        found = counts.where((F.col("tail") >= 0) & (F.col("n") >= least)).select("word", "tail").toArrow()  # LOCAL rows at most
        at = np.searchsorted(vocab.words, found.column("word").to_numpy().view(np.uint64))
        tails[vocab.unit[at]] = found.column("tail").to_numpy()
        spread[: vocab.own] = 1
        tokens[vocab.unit[vocab.unit >= 0]] = vocab.counts[vocab.unit >= 0]
    spread[-1] = 1
    tokens[-1] = vocab.tokens - tokens.sum()  # what isn't a word is an end
    of, table, _ = clustered(bigrams(train, vocab), vocab, tails)
    steps = np.log10((table + SMOOTH) / (table.sum(axis=1, keepdims=True) + SMOOTH * CLASSES))
    bases = np.log10(np.bincount(of, tokens + spread, CLASSES) + 1)
    return ClassModel(vocab, of, steps, bases), counts


def scored(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score, perplexity for each row of docs.

    A null text counts as empty: its one token is the end. Repeated rows are counted and scored each. A null id's remainder is that of
    the empty text. An empty table gives no rows; if no row is for training, all words are unknown. Other columns play no part.
    """
    source = docs.select(F.col(id_col).cast("long").alias("doc_id"), (bucket_of(id_col, MODULUS) == HELD_OUT).alias("held_out"), F.col(text_col).alias("text"))
    model, counts = trained(source.where(~F.col("held_out")).select("text"))
    kinds = "uid long, doc_id long, held_out boolean, n_tokens long, known long, base double, model double, words array<long>, times array<long>"
    local = staged(source.mapInArrow(_score(model), kinds), "scores")
    far = local.select("uid", F.explode(F.arrays_zip("words", "times")).alias("w")).select("uid", "w.words", "w.times")
    joined = far.join(counts.select(F.col("word").alias("words"), "n"), "words")
    # an unknown word's log10(0 + 1) is 0, so it needs no row
    sums = joined.groupBy("uid").agg(F.sum("times").alias("more"), F.sum(F.col("times") * F.log10(F.col("n") + 1.0)).alias("gain"))
    whole = local.select("uid", "doc_id", "held_out", "n_tokens", "known", "base", "model").join(sums, "uid", "left")
    gain = F.coalesce("gain", F.lit(0.0))
    score = F.col("model") + gain
    return whole.select(
        "doc_id", "held_out", "n_tokens", (F.col("known") + F.coalesce("more", F.lit(0))).alias("n_known"), F.lit(model.vocab.tokens).cast("long").alias("train_tokens"),
        (F.col("base") + gain).alias("base_score"), score.alias("score"), F.pow(F.lit(10.0), -score / F.col("n_tokens")).alias("perplexity"),
    )
