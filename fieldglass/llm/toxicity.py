"""Toxic passages as maximum-scoring segments of token log-odds.

Words (runs of letters, A-Z lower-cased), and beginnings of STEMS letters of longer words, get the log-odds of toxic over clean training documents
under a Dirichlet prior that follows their share in both. Words whose documents are toxic more or less often than chance allows (log-likelihood ratio beyond the log of the number of words
tried, plus MARGIN) score their own; toxic ones only if they still stand out when each pair of neighbours counts once (so copies of a text don't).
The words that tell nothing share one score, the log-odds of all of them together. A linear scan finds all maximal-scoring segments of a text. The chance that a clean text of as many
tokens has a segment as good follows the extreme-value law 1 - exp(-K n exp(-L s)), K and L fitted on clean training texts by maximum likelihood; a logistic of its logarithm, fitted on training rows, is the score.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from fieldglass.llm.common import bucket_of, flat, mixed, pieces, staged, word_hashes, words
from fieldglass.llm.quality import one_label

#: Weight of the prior in tokens, significance, least documents of a listed word, decision.
PRIOR, MARGIN, LEAST_DOCS, CUT = 1000.0, 2.0, 3, 0.5
STEMS = (4, 5)
#: Letters stay, all else separates.
_LETTER = np.full(256, 0x20, np.uint8)
for _c in [*range(65, 91), *range(97, 123), *range(128, 256)]:
    _LETTER[_c] = _c


def tokens(column: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Hash, row, start and length in bytes of each token; the starts count from the text's first byte."""
    data, offsets = flat(column)
    data = _LETTER[data]
    starts, lengths, rows = words(data, offsets)
    return word_hashes(data, starts, lengths) if len(starts) else np.zeros(0, np.uint64), rows, starts - offsets[rows], lengths


def forms(column: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Hashes of each token (a row for whole words, one for each of STEMS; 0 where a word has no more letters), row, start and length."""
    data, offsets = flat(column)
    data = _LETTER[data]
    starts, lengths, rows = words(data, offsets)
    out = np.zeros((1 + len(STEMS), len(starts)), np.uint64)
    if len(starts):
        out[0] = word_hashes(data, starts, lengths)
        letters = np.flatnonzero(data & 0xC0 != 0x80)  # the first byte of each
        first, after = np.searchsorted(letters, starts), np.searchsorted(letters, starts + lengths)
        for k, n in enumerate(STEMS, 1):
            longer = np.flatnonzero(after - first > n)
            out[k, longer] = mixed(word_hashes(data, starts[longer], letters[first[longer] + n] - starts[longer]) + np.uint64(n))
    return out, rows, starts - offsets[rows], lengths


def segments(score: np.ndarray) -> list[tuple[float, int, int]]:
    """All maximal-scoring segments (score, first token, last token) of a text with these scores of its tokens, in linear time.

    Candidates keep the sum before and up to their end, and which earlier candidate is the nearest to begin lower. A new one merges leftwards into
    that, as long as it ends higher.
    """
    sums = np.concatenate([[0.0], np.cumsum(score)])
    gains = np.flatnonzero(score > 0)
    low: list[float] = []
    high: list[float] = []
    first: list[int] = []
    last: list[int] = []
    lower: list[int] = []
    for place, before, after in zip(gains.tolist(), sums[gains].tolist(), sums[gains + 1].tolist(), strict=True):
        begin, j = place, len(low) - 1
        while True:
            while j >= 0 and low[j] >= before:
                j = lower[j]
            if j < 0 or high[j] >= after:
                break
            before, begin, k = low[j], first[j], lower[j]
            for kept in (low, high, first, last, lower):
                del kept[j:]
            j = k
        for kept, x in zip((low, high, first, last, lower), (before, after, begin, place, j), strict=True):
            kept.append(x)
    return [(b - a, i, j) for a, b, i, j in zip(low, high, first, last, strict=True)]


def _count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in pieces(batches, "text", 8_000_000):
        h, rows, _, _ = forms(batch.column("text"))
        rows, h = np.tile(rows, len(h))[(some := h.ravel() != 0)], h.ravel()[some]
        y = batch.column("y").to_numpy(zero_copy_only=False)[rows] if len(h) else np.zeros(0, np.int64)
        word, at = np.unique(h, return_inverse=True)
        pair = np.unique(at.astype(np.uint64) << np.uint64(32) | rows.astype(np.uint64))
        of, label = (pair >> np.uint64(32)).astype(np.int64), batch.column("y").to_numpy(zero_copy_only=False)[(pair & np.uint64(0xFFFFFFFF)).astype(np.int64)]
        docs, toxic_docs = np.bincount(of, minlength=len(word)), np.bincount(of, label, len(word)).astype(np.int64)
        toxic = np.bincount(at, y, len(word)).astype(np.int64)
        total = np.bincount(at, minlength=len(word))
        yield pa.RecordBatch.from_arrays([pa.array(word.view(np.int64)), pa.array(toxic), pa.array(total - toxic), pa.array(toxic_docs), pa.array(docs - toxic_docs)], ["word", "toxic", "clean", "toxic_docs", "clean_docs"])


def _contexts(word: np.ndarray):
    """Listed words with a hash of the two neighbours of each occurrence."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in pieces(batches, "text", 8_000_000):
            h, rows, _, _ = forms(batch.column("text"))
            same = np.concatenate([[False], rows[1:] == rows[:-1], [False]]) if len(rows) else np.zeros(1, bool)
            wide = np.concatenate([[np.uint64(0)], h[0], [np.uint64(0)]])
            y = batch.column("y").to_numpy(zero_copy_only=False)
            found = []
            for kind in h:
                hits = np.flatnonzero(np.isin(kind, word))
                left, right = np.where(same[hits], wide[hits], 1), np.where(same[hits + 1], wide[hits + 2], 2)
                around = mixed(left.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15) + right.astype(np.uint64))
                found.append(np.stack([kind[hits], around, y[rows[hits]].astype(np.uint64)]))
            word_, around, label = np.unique(np.concatenate(found, axis=1), axis=1)
            yield pa.RecordBatch.from_arrays([pa.array(word_.view(np.int64)), pa.array(around.view(np.int64)), pa.array(label.astype(np.int32))], ["word", "around", "y"])

    return run


@dataclass
class Words:
    """Sorted hashes of the telling words and their log-odds, the loss of any other token; K and L of the extreme-value law; the logistic's slope and base."""

    word: np.ndarray
    value: np.ndarray
    loss: float
    k: float = 0.0
    decay: float = 1.0
    slope: float = 0.0
    base: float = 0.0

    def rarity(self, best: np.ndarray, n: np.ndarray) -> np.ndarray:
        """-log of the chance of such a segment in a clean text; 0 without a segment."""
        chance = np.clip(self.k * n * np.exp(-self.decay * best), 1e-30, 30.0)
        return np.where(best > 0, -np.log(-np.expm1(-chance)), 0.0)

    def score(self, best: np.ndarray, n: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-(self.slope * self.rarity(best, n) + self.base)))

    def values(self, h: np.ndarray) -> np.ndarray:
        """Score of each token: of its listed forms the most toxic one's, else the loss. h: hashes of its forms."""
        value = np.full(h.shape[1], -np.inf)
        if len(self.word):
            for kind in h:
                at = np.minimum(np.searchsorted(self.word, kind), len(self.word) - 1)
                value = np.maximum(value, np.where(self.word[at] == kind, self.value[at], -np.inf))
        return np.where(np.isinf(value), -self.loss, value)

    def passages(self, column: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray, list[list[dict]]]:
        """Of each text: tokens, toxic ones, best segment's score, all segments."""
        size = len(column)
        h, rows, starts, lengths = forms(column)
        n = np.bincount(rows, minlength=size).astype(np.int64)
        begin = np.cumsum(n) - n
        value = self.values(h)
        best, count, spans = np.zeros(size), np.bincount(rows, value > 0, size).astype(np.int64), [[] for _ in range(size)]
        for i in np.flatnonzero(count):
            found = segments(value[begin[i] : begin[i] + n[i]])
            best[i] = max(f[0] for f in found)
            spans[i] = [{"score": s, "first_byte": int(starts[begin[i] + a]), "end_byte": int(starts[begin[i] + b] + lengths[begin[i] + b])} for s, a, b in found]
        return n, count, best, spans


def _measure(words_: Words):
    kind = pa.list_(pa.struct([("score", pa.float64()), ("first_byte", pa.int64()), ("end_byte", pa.int64())]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in pieces(batches, "text"):
            n, count, best, spans = words_.passages(batch.column("text"))
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("held_out"), pa.array(best), pa.array(n), pa.array(count), pa.array(spans, kind)], ["doc_id", "held_out", "best", "n_tokens", "n_hits", "passages"])

    return run


def _logistic(x: np.ndarray, y: np.ndarray, w: np.ndarray) -> tuple[float, float]:
    """Slope and intercept by Newton steps with a slight ridge; w: rows of each (x, y)."""
    beta = np.zeros(2)
    design = np.column_stack([x, np.ones_like(x)])
    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip(design @ beta, -30, 30)))
        grad = design.T @ (w * (y - p)) - 1e-3 * beta
        hess = (design * (w * p * (1 - p))[:, None]).T @ design + 1e-3 * np.eye(2)
        step = np.linalg.solve(hess, grad)
        beta += step
        if np.abs(step).max() < 1e-9:
            break
    return max(float(beta[0]), 0.0), float(beta[1])


def extreme_value(best: np.ndarray, n: np.ndarray, w: np.ndarray) -> tuple[float, float]:
    """K and L of largest likelihood, w rows of each (best segment, tokens): P(best <= s) = exp(-K n exp(-L s)), and best is 0 if there is no segment.

    For each L the best K is (texts with a segment) / sum of n exp(-L best); half a text more with one keeps K positive.
    """
    some = best > 0
    hits = float(w[some].sum()) + 0.5
    whole = lambda decay: float((w * n * np.exp(-decay * best)).sum()) + 1e-9
    rates = np.geomspace(0.05, 5, 400) if some.any() else np.ones(1)
    fit = [hits * np.log(rate * hits / whole(rate)) - rate * float((w * best).sum()) for rate in rates]
    rate = float(rates[int(np.argmax(fit))])
    return hits / whole(rate), rate


def word_list(docs: DataFrame, y: DataFrame) -> Words:
    """The telling words of the labelled texts; they are as many as these texts have, and go to all tasks."""
    names = ("toxic", "clean", "toxic_docs", "clean_docs")
    known = docs.select("doc_id", "text").join(y, "doc_id").select("text", "y")
    counts = known.mapInArrow(_count, "word long, " + ", ".join(f"{c} long" for c in names))
    counts = staged(counts.groupBy("word").agg(*(F.sum(c).alias(c) for c in names)), "counts")
    tried = F.expr(f"toxic_docs + clean_docs >= {LEAST_DOCS}")
    nt, nc, in_toxic_docs, in_clean_docs, words_tried = counts.agg(*(F.coalesce(F.sum(c), F.lit(0)) for c in names), F.count(F.when(tried, 1))).first()
    # toxic documents may be longer: the share of all words in documents that is in toxic ones
    share = in_toxic_docs / max(1, in_toxic_docs + in_clean_docs)
    if not nt or not nc:
        return Words(np.zeros(0, np.uint64), np.zeros(0), 1.0)
    prior = (F.col("toxic") + F.col("clean")) * (PRIOR / (nt + nc))
    t, c = F.col("toxic") + prior, F.col("clean") + prior
    odds = F.log(t / (nt + PRIOR - t)) - F.log(c / (nc + PRIOR - c))
    least = float(np.log(max(words_tried, 1))) + MARGIN

    def telling(a: Column, b: Column) -> Column:
        term = lambda x, p: F.when(x > 0, x * F.log(x / ((a + b) * p))).otherwise(0.0)
        return term(a, share) + term(b, 1 - share) >= least

    more = lambda a, b: a > (a + b) * share
    apart = more(F.col("toxic_docs"), F.col("clean_docs")) == (F.col("odds") > 0)
    listed = staged(counts.where(tried).withColumn("odds", odds).where(apart & telling(F.col("toxic_docs"), F.col("clean_docs"))), "listed")
    toxic = listed.where("odds > 0")
    hashes = toxic.select("word").toArrow().column("word").to_numpy().view(np.uint64)
    around = known.mapInArrow(_contexts(hashes), "word long, around long, y int").distinct().groupBy("word")
    around = around.agg(F.count(F.when(F.col("y") == 1, 1)).alias("a"), F.count(F.when(F.col("y") == 0, 1)).alias("b"))
    stands = around.where(more(F.col("a"), F.col("b")) & telling(F.col("a"), F.col("b"))).select("word")
    kept = toxic.join(stands, "word").select("word", "toxic", "clean", "odds").unionAll(listed.where("odds <= 0").select("word", "toxic", "clean", "odds")).toArrow()
    word, value, in_toxic, in_clean = (kept.column(c).to_numpy() for c in ("word", "odds", "toxic", "clean"))
    order = np.argsort(word.view(np.uint64))
    loss = float(np.log(max(1e-9, 1 - in_clean.sum() / nc) / max(1e-9, 1 - in_toxic.sum() / nt)))
    return Words(word.view(np.uint64)[order], value[order], max(loss, 1e-3))


def calibrated(found: Words, known: DataFrame) -> Words:
    """With K, L and the logistic fitted on known: y, best, n_tokens of training rows."""
    long_ = F.round(F.log(F.greatest(F.col("n_tokens"), F.lit(1))), 1)
    grid = known.where("y = 0").groupBy(F.round(F.least("best", F.lit(200.0)), 1).alias("best"), long_.alias("n")).agg(F.count("*").alias("w")).collect()  # 2001 * 300 rows at most
    found.k, found.decay = extreme_value(*(np.array([f(r) for r in grid], float) for f in (lambda r: r["best"], lambda r: np.exp(r["n"]), lambda r: r["w"])))
    chance = F.least(F.greatest(F.lit(found.k) * F.col("n_tokens") * F.exp(-F.lit(found.decay) * F.col("best")), F.lit(1e-30)), F.lit(30.0))
    rare = F.when(F.col("best") > 0, -F.log(-F.expm1(-chance))).otherwise(F.lit(0.0))
    grid = known.groupBy("y", F.round(rare, 1).alias("x")).agg(F.count("*").alias("w")).orderBy("y", "x").collect()  # 2 * 700 rows at most
    if len({r["y"] for r in grid}) == 2:
        found.slope, found.base = _logistic(*(np.array([r[c] for r in grid], float) for c in ("x", "y", "w")))
    else:
        found.base = (100.0 if grid[0]["y"] else -100.0) if grid else 0.0
    return found


SPANS = "n_tokens long, n_hits long, passages array<struct<score double, first_byte long, end_byte long>>"
KIND = f"doc_id long, held_out boolean, best double, {SPANS}"


def toxicity_scores(docs: DataFrame, labels: DataFrame, cut: float = CUT, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, held_out, score, predicted, n_tokens, n_hits, passages (score, bytes from and to) for each row of docs.

    Null and empty texts have no tokens and no passage, and the score of any text without one. Rows with a null id are scored but never
    trained on. Repeated rows get equal scores. Without labels of both classes no word is listed and every score is the class of all labels
    (0.5 without any). Other columns play no part.
    """
    source = docs.select(F.col(id_col).cast("long").alias("doc_id"), (bucket_of(id_col, 5) == 0).alias("held_out"), F.col(text_col).alias("text"))
    y = staged(one_label(labels, "toxic"), "labels")
    model = word_list(source, y)
    found = staged(source.mapInArrow(_measure(model), KIND), "passages")
    model = calibrated(model, found.join(y, "doc_id"))

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            s = model.score(*(batch.column(c).to_numpy() for c in ("best", "n_tokens")))
            own = {"doc_id": batch.column("doc_id"), "held_out": batch.column("held_out"), "score": pa.array(s), "predicted": pa.array((s >= cut).astype(np.int32))}
            yield pa.RecordBatch.from_pydict(own | {c: batch.column(c) for c in ("n_tokens", "n_hits", "passages")})

    return found.mapInArrow(score, f"doc_id long, held_out boolean, score double, predicted int, {SPANS}")


def clean_only(docs: DataFrame, labels: DataFrame, cut: float = CUT) -> DataFrame:
    """The rows of docs, in all their columns, that score less than `cut`. Null and empty texts score as texts without a passage, repeated rows alike."""
    y = staged(one_label(labels, "toxic"), "labels")
    known = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.lit(False).alias("held_out"), "text")
    model = word_list(known, y)
    found = staged(known.join(y.select("doc_id"), "doc_id", "left_semi").select("doc_id", "held_out", "text").mapInArrow(_measure(model), KIND), "passages")
    model = calibrated(model, found.join(y, "doc_id"))

    def keep(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in pieces(batches, "text"):
            n, _, best, _ = model.passages(batch.column("text"))
            yield batch.filter(pa.array(model.score(best, n) < cut))

    return docs.mapInArrow(keep, docs.schema)
