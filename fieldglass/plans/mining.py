"""Queries on topics, clusters, models, frames and streams."""

from __future__ import annotations

from pyspark.ml.feature import Word2Vec
from pyspark.sql import Window
from pyspark.sql import functions as F

from fieldglass.functions import text as X
from fieldglass.functions import vectors as V
from fieldglass.operators import clusters as K
from fieldglass.operators import frames as M
from fieldglass.operators import lda as A
from fieldglass.operators import learning as L
from fieldglass.operators import tables as B
from fieldglass.operators import topics as P
from fieldglass.operators import windows as W
from fieldglass.plans.registry import Registry
from fieldglass.plans.tabular import boxes, scratch
from fieldglass.sources import sinks
from fieldglass.sources.scorers import score_batches
from fieldglass.streaming import streams

R = Registry()
query = R.query

_TERMS = "SELECT doc_id, source, unnest(regexp_extract_all(lower(text), '[a-z]{2,}')) AS term FROM documents"
_CTFIDF = f"""
    tf AS (SELECT source, term, count(*) AS tf FROM ({_TERMS}) GROUP BY ALL), f AS (SELECT term, sum(tf) AS f FROM tf GROUP BY 1), s AS (SELECT source, sum(tf) AS size FROM tf GROUP BY 1),
    w AS (SELECT source, term, tf / size * ln(1 + (SELECT floor(avg(size)) FROM s) / f) AS weight FROM tf JOIN f USING (term) JOIN s USING (source)),
    k AS (SELECT source, term, weight, row_number() OVER (PARTITION BY source ORDER BY weight DESC, term)::INT AS rank FROM w QUALIFY rank <= 10)"""


def topic_terms(t, n: int = 10):
    """The best terms of each source, its topic words."""
    return P.topic_words(P.ctfidf(t("documents"), "source", "text"), "source", n)


# --- text mining


@query("corpus", "SELECT lower(text) AS text, min(doc_id) AS doc_id FROM documents GROUP BY 1")
def _(t):
    return P.corpus(t("documents"), "text", "doc_id")


_STOP = ", ".join(f"'{w}'" for w in X.STOPWORDS)


def _keyword_weights(t):
    """Of all words of two word characters or more, in any script, that aren't stop-words."""
    return P.tfidf(t("documents"), "doc_id", "text", X.STOPWORDS, r"[\pL\pN_]{2,}")


@query("tfidf_keywords", rf"""
    WITH t AS (SELECT * FROM (SELECT doc_id, unnest(regexp_extract_all(lower(text), '[\pL\pN_]{{2,}}')) AS term FROM documents) WHERE term NOT IN ({_STOP})), tf AS (SELECT doc_id, term, count(*) AS tf FROM t GROUP BY ALL), d AS (SELECT term, count(*) AS df FROM tf GROUP BY 1),
         r AS (SELECT doc_id, term, tf * (ln((1 + (SELECT count(*) FROM documents)) / (1 + df)) + 1) AS w FROM tf JOIN d USING (term)), n AS (SELECT doc_id, term, w / sqrt(sum(w * w) OVER (PARTITION BY doc_id)) AS weight FROM r),
         k AS (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY round(weight, 10) DESC, term) AS rank FROM n QUALIFY rank <= 3)
    SELECT doc_id, round(sum(weight), 5) AS top3, string_agg(term, ' ' ORDER BY rank) AS keywords FROM k GROUP BY 1""")
def _(t):
    """The three best terms of each document and the sum of their weights; weights count to 10 digits, of equal ones the first term."""
    best = W.top_per_group(_keyword_weights(t), ["doc_id"], [F.desc(F.round("weight", 10)), F.asc("term")], 3)
    words = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("rank", "term"))), lambda s: s["term"]), " ")
    return best.groupBy("doc_id").agg(F.round(F.sum("weight"), 5).alias("top3"), words.alias("keywords"))


@query("top_n_keywords")
def _(t):
    """The three best terms of each document as columns; equal weights make the SQL form's order depend on rounding."""
    return W.top_as_columns(_keyword_weights(t), "doc_id", "term", "weight", 3)


@query("bag_of_words", r"WITH w AS (SELECT doc_id, regexp_extract_all(lower(text), '[a-z]{2,}') AS w FROM documents) SELECT term, count(*) AS n FROM (SELECT unnest(w) AS term FROM w UNION ALL SELECT unnest(list_transform(range(1, len(w)), lambda i: w[i] || ' ' || w[i + 1])) FROM w) GROUP BY 1 HAVING count(*) >= 5")
def _(t):
    counts = P.terms(t("documents"), ["doc_id"], "text", ngrams=(1, 2)).groupBy("term").agg(F.count("*").alias("n"))
    return counts.where("n >= 5")


@query("ctfidf", f"WITH {_CTFIDF} SELECT source, term, round(weight, 8) AS weight FROM w")
def _(t):
    return P.ctfidf(t("documents"), "source", "text").withColumn("weight", F.round("weight", 8))


@query("topic_words", f"WITH {_CTFIDF} SELECT source, rank, round(weight, 8) AS weight FROM k")
def _(t):
    return topic_terms(t).select("source", "rank", F.round("weight", 8).alias("weight"))


@query("topic_info", f"WITH {_CTFIDF} SELECT source, n, source || '_' || array_to_string(l[1:4], '_') AS name FROM (SELECT source, list(term ORDER BY rank) AS l FROM k GROUP BY 1) JOIN (SELECT source, count(*) AS n FROM documents GROUP BY 1) USING (source)")
def _(t):
    counts = t("documents").groupBy("source").agg(F.count("*").alias("n"))
    return P.topic_names(topic_terms(t), "source").join(counts, "source").select("source", "n", "name")


@query("keywords_of_cluster", r"""
    WITH d AS (SELECT lang, regexp_extract_all(lower(text), '[a-z]{2,}') AS w FROM documents), g AS (SELECT lang, unnest(w) AS term FROM d UNION ALL SELECT lang, unnest(list_transform(range(1, len(w)), lambda i: w[i] || ' ' || w[i + 1])) FROM d),
         tf AS (SELECT lang, term, count(*) AS tf FROM g GROUP BY ALL), f AS (SELECT term, sum(tf) AS f FROM tf GROUP BY 1), s AS (SELECT lang, sum(tf) AS size FROM tf GROUP BY 1),
         w AS (SELECT lang, term, tf / size * ln(1 + (SELECT floor(avg(size)) FROM s) / f) AS weight FROM tf JOIN f USING (term) JOIN s USING (lang))
    SELECT lang, term, round(weight, 8) AS weight, row_number() OVER (PARTITION BY lang ORDER BY weight DESC, term)::INT AS rank FROM w QUALIFY rank <= 10""")
def _(t):
    weights = P.ctfidf(t("documents"), "lang", "text", ngrams=(1, 2))
    return P.topic_words(weights, "lang", 10).withColumn("weight", F.round("weight", 8))


@query("summarize_clusters", f"WITH {_CTFIDF} SELECT source, round(n / sum(n) OVER () * 100, 6) AS percent, words, first_doc FROM (SELECT source, count(*) AS n, min(doc_id) AS first_doc FROM documents GROUP BY 1) JOIN (SELECT source, array_to_string(list(term ORDER BY rank), ' ') AS words FROM k GROUP BY 1) USING (source)")
def _(t):
    sizes = B.share_of_counts(t("documents"), "source").select("source", F.round(F.col("share") * 100, 6).alias("percent"))
    first = t("documents").groupBy("source").agg(F.min("doc_id").alias("first_doc"))
    words = P.topic_names(topic_terms(t), "source").select("source", F.array_join("words", " ").alias("words"))
    return sizes.join(first, "source").join(words, "source")


@query("wordcloud_weights", f"WITH {_CTFIDF} SELECT source, count(*) AS n, round(sum(weight), 6) AS total FROM (SELECT * FROM w QUALIFY row_number() OVER (PARTITION BY source ORDER BY weight DESC, term) <= 1000) GROUP BY 1")
def _(t):
    return topic_terms(t, 1000).groupBy("source").agg(F.count("*").alias("n"), F.round(F.sum("weight"), 6).alias("total"))


@query("truecase_lexicon", r"WITH d AS (SELECT list_filter(regexp_split_to_array(text, '[ \t\r\n]+'), lambda x: x <> '') AS w FROM documents), u AS (SELECT unnest(list_filter(w, lambda x, i: i > 1 AND NOT regexp_matches(w[i - 1], '[.!?:]$') AND regexp_matches(x, '^[A-Za-z]+$'))) AS w FROM d) SELECT lower(w) AS word, count(*) AS uses, round(avg(regexp_matches(w, '^[A-Z]')::INT), 6) AS share FROM u GROUP BY 1 HAVING count(*) >= 3 AND avg(regexp_matches(w, '^[A-Z]')::INT) >= 0.5")
def _(t):
    return P.truecase_lexicon(t("documents"), "text", 0.5).withColumn("share", F.round("share", 6))


@query("mmr")
def _(t):
    """Terms are alike when they weigh alike in the languages."""
    weights = P.ctfidf(t("documents"), "source", "text")
    langs = ["de", "en", "es", "fr"]
    by_lang = P.ctfidf(t("documents"), "lang", "text").groupBy("term")
    vectors = by_lang.agg(*[F.sum(F.when(F.col("lang") == k, F.col("weight")).otherwise(0.0)).alias(k) for k in langs]).select("term", F.array(*langs).alias("vector"))
    return P.mmr(P.topic_words(weights, "source", 30), "source", vectors, 10)


_COOC = r"""
    v AS (SELECT word FROM (SELECT unnest(list_filter(regexp_split_to_array(lower(text), '[ \t\r\n]+'), lambda x: x <> '')) AS word FROM conversations) GROUP BY 1 ORDER BY count(*) DESC, word LIMIT 100),
    d AS (SELECT conv_id * 1000 + turn AS id, role, list_filter(regexp_split_to_array(lower(text), '[ \t\r\n]+'), lambda x: x <> '') AS w FROM conversations),
    p AS (SELECT id, role, len(w) AS n, unnest(w) AS word, unnest(range(0, len(w))) AS pos FROM d WHERE len(w) >= 5), q AS (SELECT * FROM p JOIN v USING (word)),
    x AS (SELECT a.role, least(a.word, b.word) AS w1, greatest(a.word, b.word) AS w2, 2 * (least(a.pos, a.n - 5) - greatest(b.pos - 4, 0) + 1) AS c FROM q a JOIN q b ON a.id = b.id AND b.pos > a.pos AND b.pos < a.pos + 5)"""


def _turns(t):
    return t("conversations").select((F.col("conv_id") * 1000 + F.col("turn")).alias("id"), "role", "text")


@query("cooccurrence_windows", f"WITH {_COOC} SELECT w1, w2, sum(c)::BIGINT AS weight FROM x GROUP BY ALL")
def _(t):
    vocabulary = P.word_freq(t("conversations"), "text").orderBy(F.desc("n"), "word").limit(100)
    return P.cooccurrence(_turns(t), "id", "text", vocabulary)


@query("cooccurrence_graph", f"WITH {_COOC} SELECT role, w1, w2, sum(c)::BIGINT AS weight FROM x GROUP BY ALL HAVING sum(c) >= 20")
def _(t):
    vocabulary = P.word_freq(t("conversations"), "text").orderBy(F.desc("n"), "word").limit(100)
    return P.cooccurrence(_turns(t), "id", "text", vocabulary, group=["role"]).where("weight >= 20")


def stored(df):
    """df, written once and read back."""
    sinks.write_parquet(df, path := scratch(df))
    return df.sparkSession.read.schema(df.schema).parquet(path)


def _counted(t, batches: int = 8):
    """Word counts of each document, stored: each batch of a model reads its own."""
    return A.counted(t("documents"), "doc_id", "text", batches)[0]


def _lda(counted, k: int = 4, passes: int = 1):
    """Each pass is over all documents and words, batch by batch."""
    last = counted.agg(F.max(F.array_max("terms"))).first()[0]  # each number is in some document
    shares = A.shares(counted, A.fitted(counted, 0 if last is None else last + 1, k, passes)).withColumnRenamed("id", "doc_id")
    return stored(shares).withColumn("topic", V.argmax(F.col("shares")))  # each reference to the column would infer the topics again


@query("lda_topics")
def _(t):
    return _lda(_counted(t)).select("doc_id", "topic")


@query("lda_silhouette")
def _(t):
    return K.silhouette(_lda(_counted(t)), "topic", "shares")


@query("lda_grid_search")
def _(t):
    """A model for each setting, each result appended to the log as it comes; best first."""
    path, counted = None, _counted(t, 5)
    for k in (3, 4):
        found = K.silhouette(_lda(counted, k), "topic", "shares").withColumns({"num_topics": F.lit(k), "passes": F.lit(1), "iterations": F.lit(5)})
        path = path or scratch(found)
        sinks.append_log(found, path)
    return found.sparkSession.read.parquet(path).orderBy(F.desc("silhouette"))


@query("topic_dataset", "SELECT vec_id, label, n FROM embeddings JOIN (SELECT label, count(*) AS n FROM embeddings GROUP BY 1) USING (label) WHERE label <> 0")
def _(t):
    info = t("embeddings").groupBy("label").agg(F.count("*").alias("n"))
    return t("embeddings").where("label <> 0").join(info, "label").select("vec_id", "label", "n")


@query("topics_over_time", "WITH e AS (SELECT event_type, (greatest(ceil((epoch_us(ts) - min(epoch_us(ts)) OVER ()) / ((max(epoch_us(ts)) OVER () - min(epoch_us(ts)) OVER ()) / 20)), 1) - 1)::INT AS bin FROM events) SELECT event_type, bin, count(*) AS frequency FROM e GROUP BY ALL")
def _(t):
    micros = F.unix_micros(F.col("ts").cast("timestamp")).cast("double")
    return B.binned(t("events").withColumn("at", micros), "at", 20).groupBy("event_type", "bin").agg(F.count("*").alias("frequency"))


_CENTRES = "c AS (SELECT label, list(m ORDER BY d) AS v FROM (SELECT label, d, avg(x) AS m FROM (SELECT label, unnest(embedding::DOUBLE[]) AS x, unnest(range(0, 64)) AS d FROM embeddings) GROUP BY ALL) GROUP BY 1)"
_BEST = "s AS (SELECT vec_id, e.label AS own, c.label, list_cosine_similarity(embedding::DOUBLE[], c.v) AS score FROM embeddings e, c), b AS (SELECT *, row_number() OVER (PARTITION BY vec_id ORDER BY score DESC, label) AS r FROM s)"


def _near(t, k):
    return P.nearest(t("embeddings"), "embedding", P.centroids(t("embeddings"), "label", "embedding").withColumnRenamed("label", "name"), "name", "centroid", k)


@query("nearest_labels", f"WITH {_CENTRES}, {_BEST} SELECT vec_id, label AS name, round(score, 6) AS score FROM b WHERE r = 1")
def _(t):
    return _near(t, 1).select("vec_id", F.col("best")[0]["label"].alias("name"), F.round(F.col("best")[0]["score"], 6).alias("score"))


def _columns(k):
    return [c for i in range(k) for c in (F.col("best")[i]["label"].alias(f"label_{i + 1}"), F.round(F.col("best")[i]["score"], 6).alias(f"score_{i + 1}"))]


def _best_sql(k):
    return f"WITH {_CENTRES}, {_BEST} SELECT vec_id, " + ", ".join(f"max(label) FILTER (r = {i}) AS label_{i}, round(max(score) FILTER (r = {i}), 6) AS score_{i}" for i in range(1, k + 1)) + " FROM b GROUP BY 1"


@query("top3_labels", _best_sql(3))
def _(t):
    return _near(t, 3).select("vec_id", *_columns(3))


@query("top2_labels", _best_sql(2))
def _(t):
    return _near(t, 2).select("vec_id", *_columns(2))


@query("topic_label_zeroshot", f"WITH {_CENTRES}, s AS (SELECT a.label, b.label AS name, list_cosine_similarity(a.v, b.v) AS score FROM c a, c b WHERE a.label <> b.label) SELECT label, coalesce(string_agg(name::VARCHAR, ' - ' ORDER BY name) FILTER (score >= 0.1), 'words of ' || label) AS title FROM s GROUP BY 1")
def _(t):
    c = P.centroids(t("embeddings"), "label", "embedding")
    other = c.select(F.col("label").alias("name"), F.col("centroid").alias("v"))
    near = P.nearest(c, "centroid", other, "name", "v", 1000)
    names = F.array_sort(F.transform(F.filter("best", lambda s: (s["score"] >= 0.1) & (s["label"] != F.col("label"))), lambda s: s["label"]))
    text = F.array_join(F.transform(names, lambda x: x.cast("string")), " - ")
    return near.select("label", F.when(F.size(names) > 0, text).otherwise(F.concat(F.lit("words of "), F.col("label").cast("string"))).alias("title"))


def _halves(t):
    e = t("embeddings")
    old, new = P.centroids(e.where("vec_id % 2 = 0"), "label", "embedding"), e.where("vec_id % 2 = 1")
    return old, new


@query("predict_topics", "WITH " + _CENTRES.replace("FROM embeddings", "FROM embeddings WHERE vec_id % 2 = 0") + ", " + _BEST.replace("FROM embeddings e, c", "FROM embeddings e, c WHERE vec_id % 2 = 1") + " SELECT vec_id, r::INT AS rank, label, round(score, 6) AS score FROM b WHERE r <= 3")
def _(t):
    old, new = _halves(t)
    near = P.nearest(new, "embedding", old.withColumnRenamed("label", "name"), "name", "centroid", 3)
    return near.select("vec_id", F.posexplode("best").alias("rank", "s")).select("vec_id", (F.col("rank") + 1).alias("rank"), F.col("s.label").alias("label"), F.round("s.score", 6).alias("score"))


@query("predict_single_topic", "WITH " + _CENTRES.replace("FROM embeddings", "FROM embeddings WHERE vec_id % 2 = 0") + ", " + _BEST.replace("FROM embeddings e, c", "FROM embeddings e, c WHERE vec_id % 2 = 1") + " SELECT vec_id, label FROM b WHERE r = 1")
def _(t):
    old, new = _halves(t)
    return P.nearest(new, "embedding", old.withColumnRenamed("label", "name"), "name", "centroid", 1).select("vec_id", F.col("best")[0]["label"].alias("label"))


@query("merge_topic_models", "WITH a AS (SELECT label, list(m ORDER BY d) AS v FROM (SELECT label, d, avg(x) AS m FROM (SELECT label, unnest(embedding::DOUBLE[]) AS x, unnest(range(0, 64)) AS d FROM embeddings WHERE vec_id % 2 = 0) GROUP BY ALL) GROUP BY 1), n AS (SELECT label, list(m ORDER BY d) AS v FROM (SELECT label, d, avg(x) AS m FROM (SELECT label, unnest(embedding::DOUBLE[]) AS x, unnest(range(0, 64)) AS d FROM embeddings WHERE vec_id % 2 = 1) GROUP BY ALL) GROUP BY 1), s AS (SELECT n.label AS topic, a.label AS old, list_cosine_similarity(n.v, a.v) AS score FROM n, a QUALIFY row_number() OVER (PARTITION BY n.label ORDER BY score DESC, a.label) = 1) SELECT topic, CASE WHEN score >= 0.5 THEN old ELSE ((SELECT max(label) FROM a) + dense_rank() OVER (PARTITION BY score >= 0.5 ORDER BY topic)) END::INT AS merged FROM s")
def _(t):
    old, new = _halves(t)
    fresh = P.centroids(new, "label", "embedding").select(F.col("label").alias("topic"), F.col("centroid").alias("v"))
    best = P.nearest(fresh, "v", old.withColumnRenamed("label", "name"), "name", "centroid", 1).select("topic", F.col("best")[0]["score"].alias("score"), F.col("best")[0]["label"].alias("old"))
    joins = F.col("score") >= 0.5
    top = old.agg(F.max("label").alias("top"))
    number = F.dense_rank().over(Window.partitionBy(joins).orderBy("topic"))  # a row a topic
    return best.crossJoin(F.broadcast(top)).select("topic", F.when(joins, F.col("old")).otherwise(F.col("top") + number).cast("int").alias("merged"))


@query("topic_overlap", f"WITH {_CTFIDF}, p AS (SELECT count(*) AS n FROM k a JOIN k b ON a.term = b.term AND a.source < b.source), c AS (SELECT count(DISTINCT source) AS k FROM k) SELECT round(n * 2 / (k * (k - 1)), 6) AS overlap FROM p, c")
def _(t):
    return P.topic_overlap(topic_terms(t), "source").select(F.round("overlap", 6).alias("overlap"))


_LANGS = _CTFIDF.replace("source", "lang").replace("<= 10", "<= 6")
_PAIRS = f"""{_LANGS}, h AS (SELECT DISTINCT doc_id, term FROM ({_TERMS.replace('source', 'lang')}) WHERE term IN (SELECT term FROM k)), o AS (SELECT term, count(*) AS n FROM h GROUP BY 1),
    p AS (SELECT a.lang, a.term AS t1, b.term AS t2 FROM k a JOIN k b ON a.lang = b.lang AND a.rank < b.rank),
    z AS (SELECT p.lang, t1, t2, any_value(o1.n) AS n1, any_value(o2.n) AS n2, count(y.doc_id) AS pair_n, (SELECT count(*) FROM documents) AS n FROM p JOIN o o1 ON o1.term = t1 JOIN o o2 ON o2.term = t2 LEFT JOIN h x ON x.term = t1 LEFT JOIN h y ON y.term = t2 AND y.doc_id = x.doc_id GROUP BY p.lang, t1, t2)"""


def _lang_words(t):
    return stored(P.topic_words(P.ctfidf(t("documents"), "lang", "text"), "lang", 6))  # read many times; a few rows a language


@query("topic_coherence", f"WITH {_PAIRS} SELECT lang, round(avg(ln((pair_n + 1) / n1)), 6) AS coherence FROM z GROUP BY 1")
def _(t):
    return P.coherence_umass(_lang_words(t), "lang", t("documents"), "doc_id", "text").withColumn("coherence", F.round("coherence", 6))


@query("topic_coherence_npmi", f"WITH {_PAIRS}, q AS (SELECT *, pair_n / n + 1e-12 AS p FROM z) SELECT lang, round(avg(ln(p / ((n1 / n) * (n2 / n))) / -ln(p)), 6) AS coherence FROM q GROUP BY 1")
def _(t):
    return P.coherence_npmi(_lang_words(t), "lang", t("documents"), "doc_id", "text").withColumn("coherence", F.round("coherence", 6))


_CV = f"""{_LANGS}, d AS (SELECT doc_id, list_filter(regexp_split_to_array(lower(text), '[ \\t\\r\\n]+'), lambda x: x <> '') AS w FROM documents), g AS (SELECT doc_id, greatest(len(w) - 109, 1) AS s, w FROM d),
    o AS (SELECT doc_id, s, unnest(w) AS term, unnest(range(0, len(w))) AS pos FROM g), v AS (SELECT DISTINCT doc_id, term, unnest(range(greatest(pos - 109, 0), least(pos, s - 1) + 1)) AS start FROM o WHERE term IN (SELECT term FROM k)),
    n AS (SELECT term, count(*) AS n FROM v GROUP BY 1), p AS (SELECT a.lang, a.term AS t1, b.term AS t2 FROM k a JOIN k b USING (lang)), c AS (SELECT x.term AS t1, y.term AS t2, count(*) AS c FROM v x JOIN v y USING (doc_id, start) GROUP BY ALL),
    q AS (SELECT lang, t1, t2, coalesce(c, 0) / (SELECT sum(s) FROM g) + 1e-12 AS p, n1.n / (SELECT sum(s) FROM g) * (n2.n / (SELECT sum(s) FROM g)) AS pp FROM p LEFT JOIN c USING (t1, t2) LEFT JOIN n n1 ON n1.term = t1 LEFT JOIN n n2 ON n2.term = t2),
    m AS (SELECT lang, t1, t2, coalesce(ln(p / pp) / -ln(p), 0) AS m FROM q), u AS (SELECT lang, t2, sum(m) AS s FROM m GROUP BY ALL),
    z AS (SELECT lang, t1, sum(m * s) / (sqrt(sum(m * m)) * sqrt(sum(s * s))) AS cos FROM m JOIN u USING (lang, t2) GROUP BY ALL)"""


@query("topic_coherence_cv", f"WITH {_CV} SELECT lang, round(avg(cos), 6) AS coherence FROM z GROUP BY 1")
def _(t):
    return P.coherence_cv(_lang_words(t), "lang", t("documents"), "doc_id", "text").withColumn("coherence", F.round("coherence", 6))


@query("topics_meet_criteria", f"WITH {_LANGS}, g AS (SELECT lang, CASE WHEN term IN ('the', 'of') THEN 'english' WHEN term IN ('der', 'die') THEN 'german' WHEN term IN ('de', 'la') THEN 'romance' END AS g FROM k) SELECT count(DISTINCT g) = 3 AND count(DISTINCT lang) >= 3 AS meets FROM g WHERE g IS NOT NULL")
def _(t):
    return P.topics_meet_criteria(_lang_words(t), "lang", {"english": ["the", "of"], "german": ["der", "die"], "romance": ["de", "la"]})


@query("outlier_share", "SELECT count(*) FILTER (label = 0) AS n, round(avg((label = 0)::INT), 6) AS share FROM embeddings")
def _(t):
    return t("embeddings").agg(F.count_if(F.col("label") == 0).alias("n"), F.round(F.avg((F.col("label") == 0).cast("int")), 6).alias("share"))


_TERM_ROWS = "SELECT doc_id, lang, unnest(regexp_extract_all(lower(text), '[a-z]{2,}')) AS term FROM documents"


@query("detect_language", f"""
    WITH w AS ({_TERM_ROWS}), c AS (SELECT lang, term, count(*) AS n FROM w GROUP BY ALL), h AS (SELECT lang AS of, term FROM c QUALIFY row_number() OVER (PARTITION BY lang ORDER BY n DESC, term) <= 100),
         g AS (SELECT doc_id, of, count(*) AS n FROM w JOIN h USING (term) GROUP BY ALL), b AS (SELECT doc_id, of FROM g QUALIFY row_number() OVER (PARTITION BY doc_id ORDER BY n DESC, of) = 1)
    SELECT d.doc_id, b.of AS guess FROM documents d LEFT JOIN b USING (doc_id)""")
def _(t):
    """The hundred most frequent words of each language of the corpus are its hints."""
    counts = P.terms(t("documents"), ["lang"], "text").groupBy("lang", "term").agg(F.count("*").alias("n"))
    hints = W.top_per_group(counts, ["lang"], [F.desc("n"), F.asc("term")], 100).select("term", F.col("lang").alias("language"))
    return P.language_by_words(t("documents"), "doc_id", "text", hints, "language")


@query("sentiment_score", f"""
    WITH w AS (SELECT DISTINCT doc_id, term FROM ({_TERM_ROWS})), l AS (SELECT term, count(*) AS n, avg(quality) AS share FROM w JOIN labels USING (doc_id) WHERE quality IS NOT NULL GROUP BY 1),
         x AS (SELECT term, CASE WHEN share >= 0.9 THEN 1 ELSE -1 END AS weight FROM l WHERE n >= 5 AND (share >= 0.9 OR share <= 0.5)),
         s AS (SELECT conv_id, turn, sum(weight) AS s FROM (SELECT conv_id, turn, unnest(regexp_extract_all(lower(text), '[a-z]{{2,}}')) AS term FROM conversations) JOIN x USING (term) GROUP BY ALL)
    SELECT conv_id, turn, CASE WHEN s > 0 THEN 'POS' WHEN s < 0 THEN 'NEG' ELSE 'NEU' END AS sentiment FROM conversations LEFT JOIN s USING (conv_id, turn) WHERE text IS NOT NULL""")
def _(t):
    """Words of texts that people judged good or bad are the lexicon."""
    words = P.terms(t("documents"), ["doc_id"], "text").distinct().join(t("labels").where("quality is not null"), "doc_id")
    share = words.groupBy("term").agg(F.count("*").alias("n"), F.avg("quality").alias("share"))
    lexicon = share.where("n >= 5 and (share >= 0.9 or share <= 0.5)").select("term", F.when(F.col("share") >= 0.9, 1).otherwise(-1).alias("weight"))
    s = F.col("score")
    return P.lexicon_score(t("conversations"), ["conv_id", "turn"], "text", lexicon).select("conv_id", "turn", F.when(s > 0, "POS").when(s < 0, "NEG").otherwise("NEU").alias("sentiment"))


@query("topic_label_clean", f"WITH {_CTFIDF} SELECT source, array_to_string(list(term ORDER BY rank), '; ') AS label FROM k WHERE rank <= 3 GROUP BY 1")
def _(t):
    """Prompts of topic words go to a caller's model; its raw answers are tidied."""
    prompts = P.topic_names(topic_terms(t, 3), "source").select("source", F.array_join("words", ", ").alias("prompt"))
    answers = score_batches(prompts, "prompt", lambda texts: [(f'1. - "{x}": what these words share', 1.0) for x in texts], "answer string, p double", ("Error", 0.0))
    return answers.select("source", X.clean_topic_label(F.col("answer")).alias("label"))


@query("text_clf_vectors")
def _(t):
    rows = t("labels").join(t("documents").select("doc_id", "text"), "doc_id").select("doc_id", "quality", X.tokens(F.lower("text")).alias("words"))
    rows = stored(rows)  # words are read to list them, to learn, and to average
    vectors = stored(Word2Vec(vectorSize=16, minCount=5, maxIter=1, seed=7, numPartitions=4, inputCol="words", outputCol="features").fit(rows).transform(rows).select("doc_id", "quality", "features"))
    parts = L.split(vectors, "doc_id", [("train", 80), ("test", 20)]).withColumn("label", F.col("quality").cast("double"))
    model = L.CLASSIFIERS["logistic"]().fit(parts.where("part = 'train'"))
    return L.accuracy(model.transform(parts.where("part = 'test'")), "label", "prediction")


# --- clusters


@query("pca_reduce")
def _(t):
    return K.pca_reduce(t("embeddings"), "embedding", 5).select("vec_id", "reduced")


@query("pca_optimal_k")
def _(t):
    return K.pca_optimal_k(t("embeddings"), "embedding", 64)


@query("cumulative_variance", "WITH x AS (SELECT unnest(range(64)) AS d, unnest(embedding)::DOUBLE AS x FROM embeddings), v AS (SELECT d, var_pop(x) AS v FROM x GROUP BY 1) SELECT d, round(sum(v) OVER (ORDER BY v DESC, d) / (SELECT sum(v) FROM v), 6) AS share FROM v")
def _(t):
    """Variance by dimension, largest first, with its running share."""
    each = t("embeddings").select(F.posexplode("embedding").alias("d", "x")).groupBy("d").agg(F.var_pop("x").alias("v"))
    total = each.agg(F.sum("v").alias("total"))
    return each.crossJoin(total).select("d", F.round(F.sum("v").over(Window.orderBy(F.desc("v"), "d")) / F.col("total"), 6).alias("share"))


@query("kmeans_cluster")
def _(t):
    return K.kmeans_cluster(t("embeddings"), "embedding", 10).select("vec_id", "cluster")


@query("kmeans_elbow")
def _(t):
    return K.kmeans_elbow(t("embeddings"), "embedding", (2, 5, 10))


@query("hierarchical_cluster")
def _(t):
    return K.hierarchical_cluster(t("embeddings"), "embedding", 6).select("vec_id", "cluster")


@query("hierarchical_batches")
def _(t):
    return K.hierarchical_batches(t("embeddings"), "vec_id", "embedding", 200, 5)


_SIMILAR = "SELECT a.vec_id AS a, b.vec_id AS b, round(list_cosine_similarity(a.embedding::DOUBLE[], b.embedding::DOUBLE[]), 6) AS similarity FROM embeddings a JOIN embeddings b ON a.vec_id < b.vec_id WHERE round(list_cosine_similarity(a.embedding::DOUBLE[], b.embedding::DOUBLE[]), 6) >= 0.8"


@query("similarity_join", _SIMILAR)
def _(t):
    return K.similar_pairs_exact(t("embeddings"), "vec_id", "embedding", 0.8)


@query("density_cluster", f"""
    WITH RECURSIVE p AS ({_SIMILAR.replace(">= 0.8", ">= 0.75")}), e AS (SELECT a, b FROM p UNION ALL SELECT b, a FROM p), o AS (SELECT a FROM e GROUP BY 1 HAVING count(*) + 1 >= 3),
        c AS (SELECT a, b FROM e WHERE a IN (FROM o) AND b IN (FROM o)), r(id, low) AS (SELECT a, a FROM o UNION SELECT c.a, r.low FROM r JOIN c ON c.b = r.id), l AS (SELECT id, min(low) AS cluster FROM r GROUP BY 1),
        m AS (FROM l UNION ALL SELECT a, min(cluster) FROM e JOIN l ON b = id WHERE a NOT IN (SELECT id FROM l) GROUP BY 1), g AS (SELECT cluster FROM m GROUP BY 1 HAVING count(*) >= 3)
    SELECT vec_id, coalesce(cluster, -1) AS cluster FROM embeddings LEFT JOIN (SELECT id, cluster FROM m JOIN g USING (cluster)) ON vec_id = id""")
def _(t):
    pairs = K.similar_pairs_exact(t("embeddings"), "vec_id", "embedding", 0.75)
    return K.density_cluster(t("embeddings"), "vec_id", pairs, 3, 3)


@query("similar_neighbours", f"WITH p AS ({_SIMILAR}), n AS (SELECT a AS x FROM p UNION ALL SELECT b FROM p) SELECT x AS vec_id, count(*) AS neighbours FROM n GROUP BY 1 HAVING count(*) >= 2")
def _(t):
    """Candidate centres of communities: rows with enough similar ones."""
    pairs = stored(K.similar_pairs_exact(t("embeddings"), "vec_id", "embedding", 0.8))
    both = pairs.select(F.col("a").alias("vec_id")).unionAll(pairs.select(F.col("b").alias("vec_id")))
    return both.groupBy("vec_id").agg(F.count("*").alias("neighbours")).where("neighbours >= 2")


@query("community_detection")
def _(t):
    pairs = K.similar_pairs_exact(t("embeddings"), "vec_id", "embedding", 0.8)
    return K.communities(pairs, 2).withColumnsRenamed({"id": "vec_id"})


@query("silhouette", """
    WITH p AS (SELECT a.vec_id, a.label AS own, b.label AS other, sum(list_distance(a.embedding::DOUBLE[], b.embedding::DOUBLE[]) ** 2) AS s, count(*) AS n FROM embeddings a, embeddings b WHERE a.vec_id <> b.vec_id GROUP BY ALL),
         m AS (SELECT vec_id, own, max(s / n) FILTER (own = other) AS a, min(s / n) FILTER (own <> other) AS b FROM p GROUP BY ALL)
    SELECT round(avg(coalesce((b - a) / greatest(a, b), 0)), 6) AS silhouette FROM m""")
def _(t):
    return K.silhouette(t("embeddings"), "label", "embedding").select(F.round("silhouette", 6).alias("silhouette"))


@query("davies_bouldin", f"WITH {_CENTRES}, s AS (SELECT label, avg(list_distance(embedding::DOUBLE[], v)) AS s FROM embeddings JOIN c USING (label) GROUP BY 1), k AS (SELECT * FROM c JOIN s USING (label)) SELECT round(avg(r), 6) AS davies_bouldin FROM (SELECT a.label, max((a.s + b.s) / list_distance(a.v, b.v)) AS r FROM k a JOIN k b ON a.label <> b.label GROUP BY 1)")
def _(t):
    return K.davies_bouldin(t("embeddings"), "label", "embedding").select(F.round("davies_bouldin", 6).alias("davies_bouldin"))


@query("cluster_pipeline")
def _(t):
    # each step passes over its rows many times
    unit = stored(t("embeddings").select("vec_id", V.l2_normalize(F.col("embedding")).alias("u")))
    reduced = stored(K.pca_reduce(unit, "u", 8).withColumn("r", V.l2_normalize(F.col("reduced"))).select("vec_id", "r"))
    return K.silhouette_euclidean(stored(K.kmeans_cluster(reduced, "r", 8)), "cluster", "r")


@query("topic_grid_search")
def _(t):
    path = None
    for k in (5, 10):
        found = K.silhouette(K.kmeans_cluster(t("embeddings"), "embedding", k), "cluster", "embedding").withColumn("n_clusters", F.lit(k))
        path = path or scratch(found)
        sinks.append_log(found, path)
    return found.sparkSession.read.parquet(path)


@query("topic_model")
def _(t):
    """Vectors are reduced and clustered; each document's cluster then gets its words."""
    reduced = K.pca_reduce(t("embeddings").select("vec_id", "embedding"), "embedding", 5)
    found = K.kmeans_cluster(reduced.select("vec_id", "reduced"), "reduced", 8).select(F.col("vec_id").alias("doc_id"), "cluster")
    texts = t("documents").join(found, "doc_id").select("cluster", "text")
    return P.topic_names(P.topic_words(P.ctfidf(texts, "cluster", "text"), "cluster", 10), "cluster")


# --- models and their evaluation


def _features(t):
    """Text statistics of labelled documents, stored: models pass over them many times, and folds drawn by row must be the same in each."""
    words = X.tokens(F.col("text"))
    df = t("labels").join(t("documents").select("doc_id", "text"), "doc_id")
    return stored(df.select("doc_id", "quality", "toxic", F.length("text").cast("double").alias("chars"), F.size(words).cast("double").alias("words"), (F.size(F.array_distinct(words)) / F.greatest(F.size(words), F.lit(1))).alias("distinct"), F.length(F.regexp_replace("text", "[^A-Z]", "")).cast("double").alias("upper")))


_FEATURES = ("chars", "words", "distinct", "upper")


def split_facts(t, shares):
    """Of each part: whether its share of the keys is as asked (to 3 points), keys that are in another part too, and the rows of all parts."""
    rows = L.split(t("lineitem"), "l_orderkey", shares)
    keys = rows.groupBy("l_orderkey").agg(F.min("part").alias("part"), F.max("part").alias("other"), F.count("*").alias("n"))
    asked = F.create_map(*[F.lit(x) for kv in shares for x in kv])[F.col("part")]
    parts = keys.groupBy("part").agg(F.count("*").alias("keys"), F.count_if(F.col("part") != F.col("other")).alias("in_two"), F.sum("n").alias("rows"))
    whole = Window.partitionBy(F.lit(1))  # a row a part
    return parts.select("part", (F.abs(100 * F.col("keys") / F.sum("keys").over(whole) - asked) < 3).alias("as_asked"), "in_two", F.sum("rows").over(whole).alias("all_rows"))


@query("split_two", "SELECT part, true AS as_asked, 0 AS in_two, (SELECT count(*) FROM lineitem) AS all_rows FROM (VALUES ('train'), ('test')) p(part)")
def _(t):
    return split_facts(t, [("train", 80), ("test", 20)])


@query("training_log")
def _(t):
    return L.training_log(_order_features(t), ("month", "year", "c"), "o_totalprice", "o_orderkey", 5)


@query("store_model")
def _(t):
    rows = L.assembled(_features(t), _FEATURES).withColumn("label", F.col("quality").cast("double"))
    model = L.stored_and_loaded(L.CLASSIFIERS["logistic"](maxIter=10).fit(rows), scratch(rows))
    return L.accuracy(model.transform(rows), "label", "prediction")


@query("split_three", "SELECT part, true AS as_asked, 0 AS in_two, (SELECT count(*) FROM lineitem) AS all_rows FROM (VALUES ('train'), ('valid'), ('test')) p(part)")
def _(t):
    return split_facts(t, [("train", 70), ("valid", 15), ("test", 15)])


@query("split_stratified", """
    WITH c AS (SELECT quality, count(*) AS n FROM labels GROUP BY 1), r AS (SELECT quality, n, unnest(range(n)) AS i FROM c)
    SELECT quality, CASE WHEN coalesce(i / nullif(n - 1, 0), 0) <= 0.7 + 1e-12 THEN 'train' WHEN i / (n - 1) <= 0.7 + 0.15 + 1e-12 THEN 'valid' ELSE 'test' END AS part, count(*) AS n FROM r GROUP BY ALL""")
def _(t):
    return L.split_stratified(t("labels"), "doc_id", "quality", [("train", 0.7), ("valid", 0.15), ("test", 0.15)]).groupBy("quality", "part").agg(F.count("*").alias("n"))


@query("random_forest")
def _(t):
    found, _ = L.classify(_features(t), _FEATURES, "quality", "doc_id")
    return L.accuracy(found, "label", "prediction")


@query("rf_per_subject")
def _(t):
    out, df = None, _features(t)
    for name, columns in {"length": ("chars", "words"), "form": ("distinct", "upper")}.items():
        found, _ = L.classify(df, columns, "quality", "doc_id", numTrees=20)
        one = found.agg(F.lit(name).alias("subject"), F.count_if(F.col("prediction") > 0.5).alias("n_positive"))
        out = one if out is None else out.unionByName(one)
    return out


@query("feature_importance")
def _(t):
    df = _features(t)
    _, model = L.classify(df, _FEATURES, "quality", "doc_id")
    return L.feature_importance(model, _FEATURES, df.sparkSession)


@query("gbm_multiclass")
def _(t):
    found, _ = L.classify(t("embeddings"), "embedding", "label", "vec_id", "gbt", maxIter=3, maxDepth=3)
    return L.classification_report(found, "label", "prediction")


@query("mlp_with_time")
def _(t):
    day = F.array(((F.col("vec_id") % 365) / 365).cast("double"))
    df = t("embeddings").select("vec_id", "label", F.concat(F.col("embedding").cast("array<double>"), day).alias("v"))
    found, _ = L.classify(df, "v", "label", "vec_id", "mlp", layers=[65, 24, 10], maxIter=60)
    return L.accuracy(found, "label", "prediction")


@query("one_vs_rest")
def _(t):
    found, _ = L.classify(t("embeddings"), "embedding", "label", "vec_id", "one_vs_rest", maxIter=10)
    return L.accuracy(found, "label", "prediction")


@query("knn_classify")
def _(t):
    df = t("lineitem").select((F.col("l_orderkey") * 10 + F.col("l_linenumber")).alias("id"), "l_linenumber", (F.floor(F.col("l_quantity") / 10)).alias("q"), "l_returnflag")
    return L.accuracy(L.knn_classify(df, ("l_linenumber", "q"), "l_returnflag", "id"), "l_returnflag", "prediction")


def _order_features(t):
    return t("orders").select("o_orderkey", "o_totalprice", F.month("o_orderdate").cast("double").alias("month"), F.year("o_orderdate").cast("double").alias("year"), (F.col("o_custkey") % 100).cast("double").alias("c"))


@query("random_forest_reg")
def _(t):
    return L.regression_metrics(L.regress(_order_features(t), ("month", "year", "c"), "o_totalprice", "o_orderkey"), "label", "prediction")


@query("gbt_reg")
def _(t):
    return L.regression_metrics(L.regress(_order_features(t), ("month", "year", "c"), "o_totalprice", "o_orderkey", ["gbt"]), "label", "prediction")


@query("voting_reg")
def _(t):
    return L.regression_metrics(L.regress(_order_features(t), ("month", "year", "c"), "o_totalprice", "o_orderkey", ["random_forest", "gbt"]), "label", "prediction")


@query("multi_target_best")
def _(t):
    return L.best_per_target(_order_features(t), ("month", "c"), ("o_totalprice", "year"), "o_orderkey")


@query("grid_search_cv")
def _(t):
    return L.grid_search(_features(t), _FEATURES, "quality", (2, 4), (10,), 2)


@query("k_fold_recall")
def _(t):
    return L.k_fold_recall(_features(t), _FEATURES, "quality", "doc_id")


@query("k_fold_summary", "SELECT (doc_id % 3)::INT AS fold, round(avg(r), 6) AS mean, round(stddev_samp(r), 6) AS std FROM (SELECT doc_id % 3 AS doc_id, quality, avg((quality = toxic)::INT) AS r FROM labels GROUP BY 1, 2) GROUP BY 1")
def _(t):
    recalls = t("labels").groupBy((F.col("doc_id") % 3).cast("int").alias("fold"), "quality").agg(F.avg((F.col("quality") == F.col("toxic")).cast("int")).alias("recall"))
    return L.k_fold_summary(recalls).select("fold", F.round("mean", 6).alias("mean"), F.round("std", 6).alias("std"))


@query("smote", "WITH c AS (SELECT label, count(*) AS n FROM embeddings GROUP BY 1), m AS (SELECT max(n) AS m FROM c) SELECT label, m - n AS n, 64 AS dimensions FROM c, m WHERE n < m")
def _(t):
    made = L.smote(t("embeddings"), "vec_id", "label", "embedding")
    return made.groupBy("label").agg(F.count("*").alias("n"), F.max(F.size("embedding")).alias("dimensions"))


@query("random_oversample", "SELECT quality, (SELECT max(c) FROM (SELECT count(*) AS c FROM labels GROUP BY quality)) AS n FROM labels GROUP BY 1")
def _(t):
    return L.random_oversample(t("labels"), "doc_id", "quality").groupBy("quality").agg(F.count("*").alias("n"))


@query("confusion_matrix", "SELECT quality, toxic, count(*) AS n FROM labels GROUP BY ALL")
def _(t):
    return L.confusion_matrix(t("labels"), "quality", "toxic")


@query("classification_report", "WITH c AS (SELECT unnest([0, 1]) AS class), s AS (SELECT class, count(*) FILTER (quality = class) AS support, count(*) FILTER (toxic = class) AS guessed, count(*) FILTER (quality = class AND toxic = class) AS hit FROM c, labels GROUP BY 1) SELECT class, round(hit / guessed, 6) AS precision, round(hit / support, 6) AS recall, round(2 * hit / (guessed + support), 6) AS f1, support FROM s")
def _(t):
    out = L.classification_report(t("labels"), "quality", "toxic")
    return out.withColumns({c: F.round(c, 6) for c in ("precision", "recall", "f1")})


@query("accuracy", "SELECT quality, round(avg((quality = toxic)::INT), 6) AS accuracy FROM labels GROUP BY 1")
def _(t):
    return L.accuracy(t("labels"), "quality", "toxic", "quality").withColumn("accuracy", F.round("accuracy", 6))


_ROC = "e AS (SELECT l_quantity AS score, count(*) FILTER (l_returnflag = 'R') AS p, count(*) FILTER (l_returnflag <> 'R') AS q FROM lineitem GROUP BY 1), c AS (SELECT score, sum(p) OVER w AS tp, sum(q) OVER w AS fp, sum(p) OVER () AS P1, sum(q) OVER () AS Q1 FROM e WINDOW w AS (ORDER BY score DESC))"


def _positive():
    return F.col("l_returnflag") == "R"


@query("roc_curve", f"WITH {_ROC} SELECT score, round(fp / Q1, 6) AS fpr, round(tp / P1, 6) AS tpr FROM c")
def _(t):
    return L.roc_curve(t("lineitem"), "l_quantity", _positive()).select("score", F.round("fpr", 6).alias("fpr"), F.round("tpr", 6).alias("tpr"))


@query("auc", f"WITH {_ROC}, d AS (SELECT fp / Q1 AS x, tp / P1 AS y, coalesce(lag(fp / Q1) OVER (ORDER BY score DESC), 0) AS x0, coalesce(lag(tp / P1) OVER (ORDER BY score DESC), 0) AS y0 FROM c) SELECT round(sum((x - x0) * (y + y0) / 2), 6) AS auc FROM d")
def _(t):
    return L.auc(t("lineitem"), "l_quantity", _positive()).select(F.round("auc", 6).alias("auc"))


@query("pr_curve", f"WITH {_ROC} SELECT score, round(tp / (tp + fp), 6) AS precision, round(tp / P1, 6) AS recall FROM c")
def _(t):
    return L.pr_curve(t("lineitem"), "l_quantity", _positive()).select("score", F.round("precision", 6).alias("precision"), F.round("recall", 6).alias("recall"))


@query("average_precision", f"WITH {_ROC}, d AS (SELECT tp / P1 - coalesce(lag(tp / P1) OVER (ORDER BY score DESC), 0) AS dr, tp / (tp + fp) AS pr FROM c) SELECT round(sum(dr * pr), 6) AS average_precision FROM d")
def _(t):
    return L.average_precision(t("lineitem"), "l_quantity", _positive()).select(F.round("average_precision", 6).alias("average_precision"))


@query("regression_metrics", "SELECT round(avg((l_quantity - p) ** 2), 4) AS mse, round(avg(abs(l_quantity - p)), 4) AS mae, round(1 - avg((l_quantity - p) ** 2) / var_pop(l_quantity), 6) AS r2, round(avg((abs(l_quantity - p) / l_quantity < 0.1)::INT), 6) AS within FROM (SELECT l_quantity, l_linenumber * 7.0 AS p FROM lineitem)")
def _(t):
    out = L.regression_metrics(t("lineitem").withColumn("p", F.col("l_linenumber") * 7.0), "l_quantity", "p")
    return out.select(F.round("mse", 4).alias("mse"), F.round("mae", 4).alias("mae"), F.round("r2", 6).alias("r2"), F.round("within", 6).alias("within"))


@query("align_clusters_to_labels", "WITH c AS (SELECT vec_id % 7 AS cluster, label, count(*) AS n FROM embeddings GROUP BY ALL) SELECT cluster, label, round(n / sum(n) OVER (PARTITION BY cluster), 6) AS share FROM c QUALIFY row_number() OVER (PARTITION BY cluster ORDER BY n DESC, label) = 1")
def _(t):
    return L.align_clusters(t("embeddings").withColumn("cluster", F.col("vec_id") % 7), "cluster", "label").withColumn("share", F.round("share", 6))


@query("balanced_train_valid", """
    WITH c AS (SELECT quality, count(*) AS n FROM labels WHERE quality IS NOT NULL GROUP BY 1), m AS (SELECT min(n) AS m FROM c)
    SELECT quality, unnest(['train', 'valid']) AS part, unnest([m * 3 // 4, m - m * 3 // 4]) AS n, m AS keys FROM c, m""")
def _(t):
    out = L.balanced(t("labels").where("quality is not null"), "doc_id", "quality", 0.75)
    keys = out.groupBy("quality").agg(F.count_distinct("doc_id").alias("keys"))
    return out.groupBy("quality", "part").agg(F.count("*").alias("n")).join(keys, "quality")


# --- frames

_PT = "embedding::DOUBLE[]"


def _gap(i, j):
    return f"sqrt((e[{2 * i + 1}] - e[{2 * j + 1}]) ** 2 + (e[{2 * i + 2}] - e[{2 * j + 2}]) ** 2)"


@query("eye_ratio", f"WITH p AS (SELECT vec_id, {_PT} AS e FROM embeddings) SELECT vec_id, round(({_gap(0, 1)} / ({_gap(2, 3)} + 1e-4) + {_gap(4, 5)} / ({_gap(6, 7)} + 1e-4)) / 2, 4) AS ratio FROM p")
def _(t):
    return t("embeddings").select("vec_id", F.round(M.eye_ratio(M.points(F.col("embedding"))), 4).alias("ratio"))


@query("mouth_ratio", f"WITH p AS (SELECT vec_id, {_PT} AS e FROM embeddings) SELECT vec_id, round(({_gap(1, 7)} + {_gap(2, 5)}) / (2 * {_gap(3, 0)}), 4) AS ratio FROM p")
def _(t):
    return t("embeddings").select("vec_id", F.round(M.mouth_ratio(M.points(F.col("embedding")), (1, 2), (7, 5), (3, 0)), 4).alias("ratio"))


@query("scale_landmarks", "SELECT vec_id, floor(embedding[1]::DOUBLE * 320)::INT AS x, floor(embedding[2]::DOUBLE * 240)::INT AS y FROM embeddings")
def _(t):
    p = M.scale_points(M.points(F.col("embedding")), 320, 240)
    return t("embeddings").select("vec_id", p[0]["x"].alias("x"), p[0]["y"].alias("y"))


@query("yawn_frames", "WITH f AS (SELECT event_id, abs(value) / 100 AS ratio, CASE WHEN user_id % 2 = 0 THEN 'a-Mirror.avi' ELSE 'a-Dash.avi' END AS name FROM events) SELECT event_id FROM f WHERE ratio > CASE WHEN name LIKE '%Mirror%' THEN 0.7 ELSE 1.0 END")
def _(t):
    f = t("events").select("event_id", (F.abs("value") / 100).alias("ratio"), F.when(F.col("user_id") % 2 == 0, "a-Mirror.avi").otherwise("a-Dash.avi").alias("name"))
    return M.yawn_frames(f, "ratio", "name").select("event_id")


@query("box_normalize", "SELECT l_orderkey, l_linenumber, round((l_linenumber * 20 + l_quantity::INT) / 2 / 640, 8) AS xc, round(l_quantity::INT / 640, 8) AS w FROM lineitem")
def _(t):
    b = t("lineitem").select("l_orderkey", "l_linenumber", (F.col("l_linenumber") * 10).alias("xmin"), (F.col("l_linenumber") * 10 + F.col("l_quantity").cast("int")).alias("xmax"), F.lit(1).alias("ymin"), F.lit(2).alias("ymax"), F.lit(640).alias("width"), F.lit(480).alias("height"))
    return M.box_normalize(b, "xmin", "ymin", "xmax", "ymax", "width", "height").select("l_orderkey", "l_linenumber", F.round("xc", 8).alias("xc"), F.round("w", 8).alias("w"))


@query("format_label_line", "SELECT l_orderkey, l_linenumber, printf('%d %.6f %.6f', l_linenumber, l_quantity, l_discount) AS line FROM lineitem")
def _(t):
    return t("lineitem").select("l_orderkey", "l_linenumber", M.label_line(F.col("l_linenumber"), F.col("l_quantity").cast("double"), F.col("l_discount").cast("double")).alias("line"))


@query("single_face_frames", "SELECT user_id, ts::DATE AS day, min(event_id) AS event_id FROM events WHERE value >= 60 GROUP BY ALL HAVING count(*) = 1")
def _(t):
    f = t("events").select("user_id", F.to_date("ts").alias("day"), "event_id", "value")
    return M.single_box_frames(f, ["user_id", "day"], "value", 60).select("user_id", "day", "event_id")


@query("eye_class_lines", r"SELECT l_orderkey, string_agg(CASE WHEN l_returnflag = 'A' THEN '0 ' ELSE '1 ' END || l_linenumber, chr(10) ORDER BY CASE WHEN l_returnflag = 'A' THEN '0 ' ELSE '1 ' END || l_linenumber) AS record FROM lineitem GROUP BY 1")
def _(t):
    return M.eye_class_lines(t("lineitem"), ["l_orderkey"], "l_returnflag", "l_linenumber", "A")


@query("zero_shot_frames", "WITH f AS (SELECT user_id, ts::DATE AS day, event_type, value / 100 AS score, CASE WHEN user_id % 3 = 0 THEN 's5' ELSE 's1' END AS session FROM events), b AS (SELECT * FROM f QUALIFY row_number() OVER (PARTITION BY user_id, day ORDER BY score DESC, event_type) = 1) SELECT user_id, day, CASE WHEN event_type IN ('click', 'view') THEN 'distraction' ELSE 'drowsiness' END AS kind FROM b WHERE (event_type IN ('click', 'view') AND score > 0.85) OR (event_type NOT IN ('click', 'view') AND session = 's5')")
def _(t):
    f = t("events").select("user_id", F.to_date("ts").alias("day"), "event_type", (F.col("value") / 100).alias("score"), F.when(F.col("user_id") % 3 == 0, "s5").otherwise("s1").alias("session"))
    return M.zero_shot_frames(f, ["user_id", "day"], "event_type", "score", "session", ("click", "view")).select("user_id", "day", "kind")


@query("detection_filter", "SELECT event_id, CASE user_id % 7 WHEN 0 THEN 'face' WHEN 1 THEN 'phone' ELSE 'cup' END || ': ' || round_even((event_id % 128) / 128.0::DOUBLE, 2)::VARCHAR AS label FROM events WHERE user_id % 7 IN (0, 1, 5)")
def _(t):
    f = t("events").select("event_id", (F.col("user_id") % 7).cast("int").alias("class"), ((F.col("event_id") % 128) / 128).alias("conf"))
    return M.detection_labels(f, "class", "conf", {0: "face", 1: "phone", 5: "cup"}).select("event_id", "label")


@query("frame_join", "SELECT a.event_id, a.value AS eye, b.value AS mouth FROM events a JOIN events b ON a.user_id = b.user_id AND a.event_id = b.event_id")
def _(t):
    eye = t("events").select("user_id", "event_id", F.col("value").alias("eye"))
    mouth = t("events").select("user_id", "event_id", F.col("value").alias("mouth"))
    return eye.join(mouth, ["user_id", "event_id"]).select("event_id", "eye", "mouth")


@query("video_name_parts", "SELECT page_id, split_part(replace(url, '/', '_'), '_', 3) AS part FROM pages")
def _(t):
    return t("pages").select("page_id", M.video_name_parts(F.replace("url", F.lit("/"), F.lit("_"))).alias("part"))


# --- streams


def _events(t):
    """The events table as a stream: a copy in a folder of its own, since streams read folders, and a last event that closes all windows."""
    df = t("events")
    df.write.parquet(path := scratch(df))
    streams.closing_event(df, "ts").write.mode("append").parquet(path)
    return streams.event_stream(df.sparkSession, path, df.schema)


@query("stream_daily_counts", "SELECT ts::DATE AS day, event_type, count(*) AS n FROM events GROUP BY ALL")
def _(t):
    return streams.drained(streams.daily_counts(_events(t), "ts", "event_type"))


@query("stream_frames", """
    SELECT user_id, start, count(*) AS frames, round(avg((value > 50)::INT), 6) AS closed_share
    FROM (SELECT user_id, value, unnest([time_bucket(INTERVAL '5 minutes', ts), time_bucket(INTERVAL '5 minutes', ts) - INTERVAL '5 minutes']) AS start FROM events) GROUP BY ALL""")
def _(t):
    out = streams.drained(streams.frame_alerts(_events(t), "user_id", "ts", F.col("value") > 50))
    return out.withColumn("closed_share", F.round("closed_share", 6))


@query("stream_dedupe", "SELECT DISTINCT ts::DATE AS day, user_id, event_type FROM events")
def _(t):
    found = streams.first_of_each(_events(t), ["user_id", "event_type"], "ts")
    return streams.drained(found).select("day", "user_id", "event_type")


@query("stream_score", f"WITH {_CENTRES}, {_BEST} SELECT vec_id, label FROM b WHERE r = 1")
def _(t):
    df = t("embeddings")
    df.write.parquet(path := scratch(df))
    stream = df.sparkSession.readStream.schema(df.schema).parquet(path).select("vec_id", "embedding")
    names = P.centroids(df, "label", "embedding").withColumnRenamed("label", "name")
    return streams.drained(streams.scored(stream, "embedding", names, "name", "centroid").select("vec_id", F.col("best")[0]["label"].alias("label")))
