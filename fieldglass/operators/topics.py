"""Words, co-occurrence, TF-IDF, topics and their quality."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from fieldglass.functions.text import tokens, without_links, without_signs
from fieldglass.functions.vectors import cosine
from fieldglass.operators.shared import fresh, written
from fieldglass.operators.windows import top_per_group

#: Words that go to all tasks, at most.
FEW_WORDS = 100_000


def corpus(df: DataFrame, text: str, id_col: str) -> DataFrame:
    """Distinct lower-cased texts with the smallest id of each."""
    return df.where(F.col(text).isNotNull()).groupBy(F.lower(text).alias("text")).agg(F.min(id_col).alias(id_col))


def terms(df: DataFrame, ids: Sequence[str], text: str, pattern: str = r"[a-z]{2,}", stopwords: Sequence[str] = (), ngrams: tuple[int, int] = (1, 1)) -> DataFrame:
    """A row for each term of each text: ids, term."""
    words = F.regexp_extract_all(F.lower(text), F.lit(f"({pattern})"), 1)
    if stopwords:
        words = F.filter(words, lambda t: ~t.isin(*stopwords))
    lo, hi = ngrams
    if (lo, hi) == (1, 1):
        grams = words
    else:
        base = df.select(*ids, words.alias("_w"))
        # each longer gram is the one before and the next word: a string is put together once, no part of the array is copied for it
        spans, gram = [], F.col("_w")
        for n in range(1, hi + 1):
            if n > 1:
                gram = F.zip_with(F.slice(gram, 1, F.greatest(F.size("_w") - (n - 1), F.lit(0))), F.slice("_w", n, F.greatest(F.size("_w") - (n - 1), F.lit(0))), lambda a, b: F.concat(a, F.lit(" "), b))
            if n >= lo:
                spans.append(gram)
        return base.select(*ids, F.explode(F.concat(*spans)).alias("term"))
    return df.select(*ids, F.explode(grams).alias("term"))


def with_facts(rows: DataFrame, facts: DataFrame, keys: Sequence[str], most: str) -> DataFrame:
    """The inner join of rows with facts (written; a row for each value of the keys). The FEW_WORDS facts of the highest `most`, which most rows ask for, go to all tasks: only
    rows with rarer keys are shuffled, and no frequent word is a skewed join."""
    if facts.limit(FEW_WORDS + 1).count() <= FEW_WORDS:
        return rows.join(F.broadcast(facts), list(keys))
    common = F.broadcast(written(facts.orderBy(F.desc(most), *keys).limit(FEW_WORDS), "common"))
    rare = rows.join(common.select(*keys), list(keys), "left_anti").join(facts, list(keys))
    return rows.join(common, list(keys)).unionByName(rare)


def few(df: DataFrame) -> DataFrame:
    """df (written), sent to all tasks if it has FEW_WORDS rows at most."""
    return F.broadcast(df) if df.limit(FEW_WORDS + 1).count() <= FEW_WORDS else df


def word_freq(df: DataFrame, text: str) -> DataFrame:
    """How often each lower-cased token occurs."""
    return df.select(F.explode(tokens(F.lower(text))).alias("word")).groupBy("word").agg(F.count("*").alias("n"))


def tfidf(df: DataFrame, id_col: str, text: str, stopwords: Sequence[str] = (), pattern: str = r"[a-z]{2,}") -> DataFrame:
    """id, term, weight: tf * (ln((1 + n) / (1 + df)) + 1), each document's weights scaled to unit length.

    Texts are dealt out by their id, so their terms are counted where they are, and go by a shuffle once more, with their weights.
    """
    tf = written(terms(df.select(id_col, text).repartition(id_col), [id_col], text, pattern, stopwords).groupBy(id_col, "term").agg(F.count("*").alias("tf")), "terms")
    of = written(tf.groupBy("term").agg(F.count("*").alias("df")), "of")
    n = df.agg(F.count("*").alias("n"))
    raw = with_facts(tf, of, ["term"], "df").crossJoin(F.broadcast(n)).withColumn("w", F.col("tf") * (F.log((1 + F.col("n")) / (1 + F.col("df"))) + 1))
    length = F.sqrt(F.sum(F.col("w") * F.col("w")).over(Window.partitionBy(id_col)))
    return raw.select(id_col, "term", (F.col("w") / length).alias("weight"))


def ctfidf(df: DataFrame, topic: str, text: str, reduce_frequent: bool = False, stopwords: Sequence[str] = (), ngrams: tuple[int, int] = (1, 1)) -> DataFrame:
    """topic, term, weight: tf(term, topic) / words(topic) * ln(1 + average words of a topic, cut to an integer, / f(term))."""
    tf = written(terms(df, [topic], text, stopwords=stopwords, ngrams=ngrams).groupBy(topic, "term").agg(F.count("*").alias("tf")), "terms")
    size = written(tf.groupBy(topic).agg(F.sum("tf").alias("size")), "sizes")
    average = size.agg(F.floor(F.avg("size")).alias("average"))
    share = F.col("tf") / F.col("size")
    # a term has a row a topic at most
    each = tf.withColumn("f", F.sum("tf").over(Window.partitionBy("term")))
    out = each.join(few(size), topic).crossJoin(F.broadcast(average))
    return out.select(topic, "term", ((F.sqrt(share) if reduce_frequent else share) * F.log(1 + F.col("average") / F.col("f"))).alias("weight"))


def topic_words(weights: DataFrame, topic: str, n: int) -> DataFrame:
    """The n best terms of each topic with rank from 1."""
    return top_per_group(weights, [topic], [F.desc("weight"), F.asc("term")], n)


def topic_names(words: DataFrame, topic: str, n: int = 4) -> DataFrame:
    """topic, words (in rank order), name: id and the first n words joined by underscores."""
    lists = words.groupBy(topic).agg(F.transform(F.array_sort(F.collect_list(F.struct("rank", "term"))), lambda s: s["term"]).alias("words"))
    return lists.withColumn("name", F.concat_ws("_", F.col(topic).cast("string"), F.slice("words", 1, n)))


def evolving_words(df: DataFrame, topic: str, bin_: str, text: str, n: int, stopwords: Sequence[str] = ()) -> DataFrame:
    """topic, bin, term, weight, rank: the n best terms of each topic in each bin of time.

    A weight is the term's share of the topic's words in the bin times ln(1 + average words of a topic, cut to an integer, / its count in all texts), and each list of
    weights is scaled to sum 1. A bin's list is averaged with that of the bin before, if the topic is there, and the result with the topic's own list over
    all bins. Weights count to 10 digits; of equal ones the first term. Rows without topic, bin or text play no part.
    """
    tf = terms(df.where(F.col(topic).isNotNull() & F.col(bin_).isNotNull()), [topic, bin_], text, stopwords=stopwords).groupBy(topic, bin_, "term").agg(F.count("*").alias("tf"))
    tf = written(tf, "terms")
    whole = written(tf.groupBy(topic, "term").agg(F.sum("tf").alias("tf")), "whole")
    size = whole.groupBy(topic).agg(F.sum("tf").alias("size"))
    odds = F.log(1 + F.col("average") / F.sum("tf"))
    idf = whole.crossJoin(F.broadcast(size.agg(F.floor(F.avg("size")).alias("average")))).groupBy("term", "average").agg(odds.alias("idf")).select("term", "idf")

    def scaled(counts: DataFrame, keys: list[str]) -> DataFrame:
        raw = written(counts.join(idf, "term").withColumn("w", F.col("tf") * F.col("idf")), "raw")
        # a topic's total divides out the number of its words
        return raw.join(few(written(raw.groupBy(*keys).agg(F.sum("w").alias("all")), "totals")), keys).select(*keys, "term", (F.col("w") / F.col("all")).alias("w"))

    own = written(scaled(tf, [topic, bin_]), "own")
    # topics and bins are few beside terms: joined by them, all terms of one would be sorted in one task
    seen = few(written(own.select(topic, bin_).distinct(), "seen"))
    later = own.withColumn(bin_, F.col(bin_) + 1).join(seen, [topic, bin_], "left_semi")
    count = seen.join(seen.select(topic, (F.col(bin_) + 1).alias(bin_), F.lit(2).alias("lists")), [topic, bin_], "left")
    count = few(written(count, "count"))
    both = own.unionAll(later.select(own.columns)).groupBy(topic, bin_, "term").agg(F.sum("w").alias("w"))
    both = both.join(count, [topic, bin_]).select(topic, bin_, "term", (F.col("w") / F.coalesce("lists", F.lit(1))).alias("w"))
    # a term of the topic that is missing in the bin has half its weight in the topic
    fixed = scaled(whole, [topic]).join(seen, topic).select(topic, bin_, "term", "w")
    weight = F.round(F.sum("w") / 2, 10).alias("weight")
    return top_per_group(both.unionAll(fixed).groupBy(topic, bin_, "term").agg(weight), [topic, bin_], [F.desc("weight"), F.asc("term")], n)


def representatives(df: DataFrame, topic: str, id_col: str, text: str, n: int, stopwords: Sequence[str] = ()) -> DataFrame:
    """topic, id, similarity, rank: the n texts of each topic that are most like it, by the cosine of their term weights.

    A text's weights are its term counts times ln(1 + average words of a topic, cut to an integer, / the term's count in all texts); a topic's are those of all its texts together.
    Every text is compared; before the shuffle each task keeps the n best of a topic. Similarities count to 8 digits; of equal ones the smallest id.
    Texts without terms are no one's representative.
    """
    known = df.where(F.col(topic).isNotNull()).select(topic, id_col, text).repartition(id_col)
    tf = written(terms(known, [topic, id_col], text, stopwords=stopwords).groupBy(topic, id_col, "term").agg(F.count("*").alias("tf")), "terms")
    whole = written(tf.groupBy(topic, "term").agg(F.sum("tf").alias("of_topic")), "topics")
    average = whole.groupBy(topic).agg(F.sum("of_topic").alias("size")).agg(F.floor(F.avg("size")).alias("average"))
    idf = whole.groupBy("term").agg(F.sum("of_topic").alias("f")).crossJoin(F.broadcast(average)).select("term", F.log(1 + F.col("average") / F.col("f")).alias("idf"))
    weighted = written(whole.join(idf, "term").select(topic, "term", "idf", "of_topic", (F.col("of_topic") * F.col("idf")).alias("w")), "weighted")
    length = few(written(weighted.groupBy(topic).agg(F.sqrt(F.sum(F.col("w") * F.col("w"))).alias("length")), "length"))
    own = F.col("tf") * F.col("idf")
    texts = with_facts(tf, weighted, [topic, "term"], "of_topic").groupBy(topic, id_col).agg(F.sum(own * F.col("w")).alias("dot"), F.sqrt(F.sum(own * own)).alias("its"))
    found = texts.join(length, topic).select(topic, id_col, F.round(F.col("dot") / F.col("its") / F.col("length"), 8).alias("similarity"))
    return top_per_group(found, [topic], [F.desc("similarity"), F.asc(id_col)], n)


def cooccurrence(df: DataFrame, id_col: str, text: str, vocabulary: DataFrame, window: int = 5, group: Sequence[str] = ()) -> DataFrame:
    """w1 <= w2, weight: pairs of listed words in the same window of `window` tokens, twice the number of windows that hold the pair of places.

    Windows lie within a text; one shorter than a window has none. Only listed words (vocabulary.word) are exploded to places, and places
    of a text meet by blocks of `window` places, so a long text is never paired with itself whole.
    """
    rows = df.select(*group, id_col, tokens(F.lower(text)).alias("_t"))
    places = rows.select(*group, id_col, F.size("_t").alias("_n"), F.posexplode("_t").alias("pos", "word")).where(F.col("_n") >= window)
    places = places.join(vocabulary.select("word"), "word").withColumn("block", F.floor(F.col("pos") / window))
    right = places.select(*group, id_col, F.col("word").alias("w2"), F.col("pos").alias("pos2"), F.col("block").alias("block2"))
    # a place meets those of its own block and the next
    left = places.select("*", F.explode(F.array(F.col("block"), F.col("block") + 1)).alias("block2"))
    gap = F.col("pos2") - F.col("pos")
    pairs = left.join(right, [*group, id_col, "block2"]).where((gap > 0) & (gap < window))
    # windows [s, s + window) within the text that hold both places
    held = F.least(F.col("pos"), F.col("_n") - window) - F.greatest(F.col("pos2") - (window - 1), F.lit(0)) + 1
    return pairs.groupBy(*group, F.least("word", "w2").alias("w1"), F.greatest("word", "w2").alias("w2")).agg((2 * F.sum(held)).cast("long").alias("weight"))


def topic_overlap(words: DataFrame, topic: str) -> DataFrame:
    """Mean number of words that two topics share."""
    a, b = words.select(F.col(topic).alias("ta"), "term"), words.select(F.col(topic).alias("tb"), "term")
    shared = a.join(b, "term").where("ta < tb").agg(F.count("*").alias("shared"))
    k = words.agg(F.countDistinct(topic).alias("k"))
    return shared.crossJoin(k).select(F.try_divide(F.col("shared") * 2, F.col("k") * (F.col("k") - 1)).alias("overlap"))


def _listed(words: DataFrame) -> DataFrame:
    """The distinct terms of words (written); up to FEW_WORDS of them go to all tasks, so that texts aren't shuffled to find them."""
    listed = words.select("term").distinct()
    return F.broadcast(listed) if listed.limit(FEW_WORDS + 1).count() <= FEW_WORDS else listed


def _pair_counts(words: DataFrame, topic: str, df: DataFrame, id_col: str, text: str) -> DataFrame:
    """Document counts of each topic's words and pairs of words: topic, rank and term of both, n1, n2, both, n."""
    words = written(words.select(topic, "rank", "term"), "words")
    own = F.array_distinct(F.regexp_extract_all(F.lower(text), F.lit("([a-z]{2,})"), 1))
    has = written(df.select(id_col, F.explode(own).alias("term")).join(_listed(words), "term").distinct(), "has")
    single = has.groupBy("term").agg(F.count("*").alias("n1"))
    a, b = words.select(topic, F.col("rank").alias("r1"), F.col("term").alias("t1")), words.select(topic, F.col("rank").alias("r2"), F.col("term").alias("t2"))
    pairs = a.join(b, topic).where("r1 < r2")
    wanted = pairs.select("t1", "t2").distinct()
    both = has.withColumnRenamed("term", "t1").join(wanted, "t1").join(has.select(F.col(id_col), F.col("term").alias("t2")), [id_col, "t2"]).groupBy("t1", "t2").agg(F.count("*").alias("both"))
    out = pairs.join(both, ["t1", "t2"], "left").na.fill({"both": 0})
    out = out.join(single.select(F.col("term").alias("t1"), "n1"), "t1", "left").join(single.select(F.col("term").alias("t2"), F.col("n1").alias("n2")), "t2", "left")
    return out.na.fill({"n1": 0, "n2": 0}).crossJoin(F.broadcast(df.agg(F.count("*").alias("n"))))


def coherence_umass(words: DataFrame, topic: str, df: DataFrame, id_col: str, text: str) -> DataFrame:
    """Mean of ln((documents with both + 1) / documents with the better-ranked word), over the pairs of each topic."""
    pairs = _pair_counts(words, topic, df, id_col, text)
    return pairs.groupBy(topic).agg(F.avg(F.log((F.col("both") + 1) / F.col("n1"))).alias("coherence"))


def coherence_npmi(words: DataFrame, topic: str, df: DataFrame, id_col: str, text: str, epsilon: float = 1e-12) -> DataFrame:
    """Mean normalised pointwise mutual information over the pairs of each topic."""
    p = F.col("both") / F.col("n") + epsilon
    npmi = F.log(p / ((F.col("n1") / F.col("n")) * (F.col("n2") / F.col("n")))) / -F.log(p)
    return _pair_counts(words, topic, df, id_col, text).groupBy(topic).agg(F.avg(npmi).alias("coherence"))


def _window_counts(words: DataFrame, topic: str, df: DataFrame, id_col: str, text: str, window: int) -> tuple[DataFrame, DataFrame, DataFrame]:
    """In how many windows of so many tokens each word is (term, n), each pair of a topic's words is (t1 < t2, both), and how many windows there are (n).

    A window is known by its start. An occurrence stands for the starts of those windows in which it is the word's first, so a word's spans don't overlap and two
    words share as many windows as their spans have starts in common. Spans are cut at multiples of `window` and meet by text and block, never a text whole.
    """
    rows = df.select(id_col, F.coalesce(tokens(F.lower(text)), F.array()).alias("_t")).withColumn("_starts", F.greatest(F.size("_t") - (window - 1), F.lit(1)))
    places = rows.select(id_col, "_starts", F.posexplode("_t").alias("pos", "term")).join(_listed(words), "term")
    before = F.lag("pos").over(Window.partitionBy(id_col, "term").orderBy("pos"))
    low = F.greatest(F.coalesce(before + 1, F.lit(0)), F.col("pos") - (window - 1), F.lit(0))
    spans = written(places.select(id_col, "term", low.alias("low"), F.least("pos", F.col("_starts") - 1).alias("high")).where("low <= high"), "spans")
    cut = spans.select("*", F.explode(F.sequence(F.floor(F.col("low") / window), F.floor(F.col("high") / window))).alias("block"))
    first = F.col("block") * window
    cut = cut.select(id_col, "term", "block", F.greatest("low", first).alias("low"), F.least("high", first + (window - 1)).alias("high"))
    a, b = words.select(topic, F.col("term").alias("t1")), words.select(topic, F.col("term").alias("t2"))
    wanted = a.join(b, topic).where("t1 < t2").select("t1", "t2").distinct()
    left = cut.withColumnRenamed("term", "t1").join(wanted, "t1")
    right = cut.select(id_col, "block", F.col("term").alias("t2"), F.col("low").alias("low2"), F.col("high").alias("high2"))
    shared = F.least("high", "high2") - F.greatest("low", "low2") + 1
    pairs = left.join(right, [id_col, "block", "t2"]).withColumn("shared", shared).where("shared > 0").groupBy("t1", "t2").agg(F.sum("shared").alias("both"))
    return spans.groupBy("term").agg(F.sum(F.col("high") - F.col("low") + 1).alias("n")), pairs, rows.agg(F.sum("_starts").alias("n"))


def coherence_cv(words: DataFrame, topic: str, df: DataFrame, id_col: str, text: str, window: int = 110, epsilon: float = 1e-12) -> DataFrame:
    """C_v: each word of a topic has a vector of its normalised pointwise mutual information with all the topic's words, itself included; mean cosine with the sum of these.

    Counts are of sliding windows of white-space tokens, lower-cased; a text shorter than a window is one. A word that is in no window shares nothing with any; a
    word whose vector is zero has cosine 0. id_col: unique.
    """
    words = written(words.select(topic, "term"), "words")
    single, pairs, total = _window_counts(words, topic, df, id_col, text, window)
    a, b = words.select(topic, F.col("term").alias("a")), words.select(topic, F.col("term").alias("b"))
    own = single.select(F.col("term").alias("t1"), F.col("term").alias("t2"), F.col("n").alias("both"))
    each = a.join(b, topic).withColumns({"t1": F.least("a", "b"), "t2": F.greatest("a", "b")}).join(pairs.unionByName(own), ["t1", "t2"], "left")
    each = each.join(single.select(F.col("term").alias("a"), F.col("n").alias("n1")), "a", "left").join(single.select(F.col("term").alias("b"), F.col("n").alias("n2")), "b", "left")
    each = each.crossJoin(F.broadcast(total))  # one row
    p = F.coalesce("both", F.lit(0)) / F.col("n") + epsilon
    npmi = F.coalesce(F.log(p / ((F.col("n1") / F.col("n")) * (F.col("n2") / F.col("n")))) / -F.log(p), F.lit(0.0))
    vectors = each.select(topic, "a", "b", npmi.alias("x"))
    sums = vectors.groupBy(topic, "b").agg(F.sum("x").alias("s"))
    product = lambda x, y: F.sum(F.col(x) * F.col(y))
    cosines = vectors.join(sums, [topic, "b"]).groupBy(topic, "a").agg(F.coalesce(F.try_divide(product("x", "s"), F.sqrt(product("x", "x")) * F.sqrt(product("s", "s"))), F.lit(0.0)).alias("c"))
    return cosines.groupBy(topic).agg(F.avg("c").alias("coherence"))


def topics_meet_criteria(words: DataFrame, topic: str, groups: Mapping[str, Sequence[str]], least_topics: int = 3) -> DataFrame:
    """Whether each keyword group occurs among the words of some topic, in at least so many topics together."""
    hits = words.select(topic, F.explode(F.array(*[F.when(F.col("term").isin(*v), k) for k, v in groups.items()])).alias("group")).where("group is not null")
    return hits.agg(F.countDistinct("group").alias("groups"), F.countDistinct(topic).alias("topics")).select(((F.col("groups") == len(groups)) & (F.col("topics") >= least_topics)).alias("meets"))


def centroids(df: DataFrame, topic: str, vector: str) -> DataFrame:
    """The mean vector of each topic."""
    each = df.select(topic, F.posexplode(vector).alias("d", "x")).groupBy(topic, "d").agg(F.avg(F.col("x").cast("double")).alias("x"))
    return each.groupBy(topic).agg(F.transform(F.array_sort(F.collect_list(F.struct("d", "x"))), lambda s: s["x"]).alias("centroid"))


def nearest(items: DataFrame, vector: str, labels: DataFrame, label: str, label_vector: str, k: int) -> DataFrame:
    """The k labels nearest by cosine to each item, as an array of (score, label), best first; labels are few and broadcast as one row."""
    listed = labels.agg(F.collect_list(F.struct(F.col(label).alias("label"), F.col(label_vector).alias("v"))).alias("_all"))
    scored = F.transform("_all", lambda s: F.struct((-cosine(F.col(vector), s["v"])).alias("m"), s["label"].alias("label")))
    best = F.slice(F.array_sort(scored), 1, k)
    return items.crossJoin(F.broadcast(listed)).withColumn("best", F.transform(best, lambda s: F.struct((-s["m"]).alias("score"), s["label"].alias("label")))).drop("_all")


def truecase_lexicon(df: DataFrame, text: str, least_share: float = 0.9, least_uses: int = 3) -> DataFrame:
    """Words that stand capitalised within sentences in nearly all their uses: word (lower case), uses, share."""
    rows = df.select(tokens(F.col(text)).alias("_w"))
    inner = F.filter("_w", lambda x, i: (i > 0) & ~F.get(F.col("_w"), i - 1).rlike("[.!?:]$") & x.rlike("^[A-Za-z]+$"))
    uses = rows.select(F.explode(inner).alias("w")).groupBy(F.lower("w").alias("word"))
    out = uses.agg(F.count("*").alias("uses"), F.avg(F.col("w").rlike("^[A-Z]").cast("int")).alias("share"))
    return out.where((F.col("uses") >= least_uses) & (F.col("share") >= least_share))


def sentences_with_names(df: DataFrame, id_col: str, text: str, names: DataFrame) -> DataFrame:
    """id, text: cleaned sentences in lower case, but for words among names (column word, lower case), which keep theirs.

    URLs and tags go, a slash between words becomes a space. Each word with a capital, without the signs around it, is looked up, once a row; the names of a row
    come back to it, and the text then loses signs, numbers and single characters like clean_sentences. Each row of df gives one, a null text a null; ids needn't be unique.
    """
    place, words, key, own = (fresh(c) for c in ("row", "words", "key", "own"))
    look = lambda w: F.lower(F.regexp_replace(w, r"^[^A-Za-z]+|[^A-Za-z]+$", ""))
    # rows are told apart by a number that is written with them
    rows = written(df.select(id_col, tokens(without_links(F.col(text))).alias(words), F.monotonically_increasing_id().alias(place)), "words")
    capital = F.array_distinct(F.transform(F.filter(words, lambda w: w != F.lower(w)), look))
    kept = rows.select(place, F.explode(capital).alias(key)).join(few(written(names.select(F.col("word").alias(key)).distinct(), "names")), key)
    out = rows.join(kept.groupBy(place).agg(F.collect_list(key).alias(own)), place, "left")
    back = F.transform(words, lambda w: F.when(w == F.lower(w), w).when(F.array_contains(own, look(w)), w).otherwise(F.lower(w)))
    # without a name in the row no word is looked up
    out = out.withColumn(words, F.array_join(F.when(F.col(own).isNull(), F.transform(words, lambda w: F.lower(w))).otherwise(back), " "))
    return out.select(id_col, without_signs(F.col(words)).alias(text))


def mmr(words: DataFrame, topic: str, vectors: DataFrame, n: int, diversity: float = 0.3, candidates: int = 30) -> DataFrame:
    """n diverse terms of each topic out of its best `candidates`: each next one has the best (1 - diversity) * weight - diversity * similarity to those chosen.

    words: topic, term, weight, rank; vectors: term, vector. Weights are scaled by the topic's best. A group has `candidates` rows at most.
    """

    def choose(rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows.sort_values("rank").reset_index(drop=True)
        v = np.stack(rows["vector"].to_numpy()).astype(float)
        v /= np.maximum(np.linalg.norm(v, axis=1, keepdims=True), 1e-12)
        relevance, likeness = rows["weight"].to_numpy() / max(rows["weight"].max(), 1e-12), v @ v.T
        chosen = [0]
        while len(chosen) < min(n, len(rows)):
            gain = (1 - diversity) * relevance - diversity * likeness[:, chosen].max(axis=1)
            gain[chosen] = -np.inf
            chosen.append(int(gain.argmax()))
        return rows.iloc[chosen].assign(place=range(1, len(chosen) + 1))[[topic, "term", "place"]]

    rows = words.where(F.col("rank") <= candidates).join(vectors, "term").select(topic, "term", "weight", "rank", "vector")
    kind = dict(rows.dtypes)[topic]
    return rows.groupBy(topic).applyInPandas(choose, f"{topic} {kind}, term string, place int")


def lexicon_score(df: DataFrame, ids: Sequence[str], text: str, lexicon: DataFrame) -> DataFrame:
    """ids, score: the sum of the weights of each text's words. lexicon: term, weight, a row a term. Texts without a listed word score 0; null texts have no row."""
    texts = df.where(F.col(text).isNotNull())
    found = terms(texts, ids, text).join(lexicon, "term").groupBy(*ids).agg(F.sum("weight").alias("score"))
    return texts.select(*ids).join(found, list(ids), "left").na.fill(0, ["score"])


def language_by_words(df: DataFrame, id_col: str, text: str, hints: DataFrame, language: str) -> DataFrame:
    """id, guess: the language of which a text has most words, the first by name of several; null without any. hints: term, language, rows of frequent words."""
    hits = terms(df, [id_col], text).join(hints, "term").groupBy(id_col, language).agg(F.count("*").alias("n"))
    best = hits.groupBy(id_col).agg(F.min(F.struct((-F.col("n")).alias("n"), language)).alias("s"))
    return df.select(id_col).join(best, id_col, "left").select(id_col, F.col(f"s.{language}").alias("guess"))


def with_lemmas(df: DataFrame, id_col: str, words: str, lemmas: DataFrame) -> DataFrame:
    """df with each word of the array column replaced by its lemma, where there is one. lemmas: word, lemma, a row a word; id_col: unique."""
    each = df.select(id_col, F.posexplode(words).alias("_at", "word")).join(lemmas, "word", "left")
    found = each.groupBy(id_col).agg(F.array_sort(F.collect_list(F.struct("_at", F.coalesce("lemma", "word").alias("word")))).alias("_all"))
    back = found.select(id_col, F.transform("_all", lambda s: s["word"]).alias("_words"))
    return df.join(back, id_col, "left").withColumn(words, F.coalesce("_words", words)).drop("_words")
