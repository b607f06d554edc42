"""Queries on clusterings by trees, boosting with early stopping, language by n-grams, and keep-first on a stream."""

from __future__ import annotations

from pyspark.sql import functions as F

from fieldglass.operators import agglomerate, boosting, clusters, density, language, search
from fieldglass.operators import learning as L
from fieldglass.operators import tables as B
from fieldglass.operators import topics as P
from fieldglass.plans.mining import _events
from fieldglass.plans.registry import Registry
from fieldglass.streaming import streams

R = Registry()
query = R.query


@query("density_cluster_tree")
def _(t):
    """Clusters of at least a fiftieth of all rows, by stability."""
    return density.hdbscan(t("embeddings"), "vec_id", "embedding", 0.02, 3)


@query("hierarchical_average")
def _(t):
    return agglomerate.average_linkage(t("embeddings"), "vec_id", "embedding", 10)


def quadrants(t):
    """The vectors with a label that can be learned: the signs of their first two entries."""
    v = F.col("embedding")
    planted = (v[0] > 0).cast("int") + 2 * (v[1] > 0).cast("int")
    return L.split(t("embeddings").select("vec_id", "embedding", planted.alias("quadrant")), "vec_id", [("train", 60), ("valid", 20), ("test", 20)])


@query("gbm_early_stopping")
def _(t):
    """The log of the rounds: losses of both parts, whether the round is kept, and the accuracy of the kept model on the rest."""
    rows = quadrants(t)
    model = boosting.boosted(rows.where("part <> 'test'"), "embedding", "quadrant", F.col("part") == "valid", rounds=40)
    log = rows.sparkSession.createDataFrame([(r, a, b, r <= model.best) for r, a, b in model.log], "round int, train_loss double, valid_loss double, kept boolean")
    return log.crossJoin(F.broadcast(L.accuracy(model.transform(rows.where("part = 'test'"), "embedding"), "quadrant", "prediction")))


@query("stream_keep_first", """
    WITH RECURSIVE k AS (SELECT user_id, event_type, min({'at': ts, 'id': event_id}) AS e FROM events GROUP BY ALL
        UNION ALL SELECT k.user_id, k.event_type, min({'at': v.ts, 'id': v.event_id}) FROM k JOIN events v ON v.user_id = k.user_id AND v.event_type = k.event_type AND v.ts > k.e.at + INTERVAL 3 DAY GROUP BY k.user_id, k.event_type)
    SELECT events.event_id, events.user_id, events.event_type, value, props FROM k JOIN events ON event_id = k.e.id""")
def _(t):
    """Whole first rows: the next one of a user and type is kept when three days have passed since the last."""
    found = streams.keep_first(_events(t), ["user_id", "event_type"], "ts", "event_id", "3 days", "40 days")
    return streams.drained(found).select("event_id", "user_id", "event_type", "value", "props")


@query("kmeans_minibatch")
def _(t):
    df = t("embeddings")
    return clusters.assigned(df.select("vec_id", "embedding"), "embedding", clusters.kmeans_minibatch(df, "embedding", 10, 1000, epochs=4)).select("vec_id", "cluster")


@query("detect_language_model")
def _(t):
    """Learned on four fifths of the documents; the guess for all, and which of them were held out."""
    held = L.hash_bucket("doc_id", 5) == 0
    model = language.learned(t("documents"), "text", "lang", ~held)
    return model.detect(t("documents").select("doc_id", "text", held.alias("held_out")), "text").select("doc_id", "held_out", "language", F.round("probability", 6).alias("probability"))


_DATED = """
    d AS (SELECT source, text, (greatest(ceil((epoch_us(ts) - min(epoch_us(ts)) OVER ()) / ((max(epoch_us(ts)) OVER () - min(epoch_us(ts)) OVER ()) / 5)), 1) - 1)::INT AS bin FROM documents JOIN events ON event_id = doc_id)"""


@query("topics_over_time_words", f"""
    WITH {_DATED}, w AS (SELECT source, bin, unnest(regexp_extract_all(lower(text), '[a-z]{{2,}}')) AS term FROM d), tf AS (SELECT source, bin, term, count(*) AS tf FROM w GROUP BY ALL),
         g AS (SELECT source, term, sum(tf) AS tf FROM tf GROUP BY ALL), i AS (SELECT term, ln(1 + (SELECT floor(avg(s)) FROM (SELECT sum(tf) AS s FROM g GROUP BY source)) / sum(tf)) AS idf FROM g GROUP BY 1),
         o AS (SELECT source, bin, term, tf * idf / sum(tf * idf) OVER (PARTITION BY source, bin) AS w FROM tf JOIN i USING (term)), b AS (SELECT DISTINCT source, bin FROM o),
         e AS (SELECT source, bin, term, sum(w) / (1 + (EXISTS (FROM b WHERE b.source = x.source AND b.bin = x.bin - 1))::INT) AS w FROM (FROM o UNION ALL SELECT o.source, o.bin + 1, term, w FROM o JOIN b ON b.source = o.source AND b.bin = o.bin + 1) x GROUP BY x.source, x.bin, x.term),
         f AS (SELECT source, bin, term, w FROM (SELECT source, term, tf * idf / sum(tf * idf) OVER (PARTITION BY source) AS w FROM g JOIN i USING (term)) JOIN b USING (source)),
         a AS (SELECT source, bin, term, round(sum(w) / 2, 10) AS weight FROM (FROM e UNION ALL FROM f) GROUP BY ALL),
         r AS (SELECT *, row_number() OVER (PARTITION BY source, bin ORDER BY weight DESC, term) AS r FROM a QUALIFY r <= 5)
    SELECT source, bin, frequency, words FROM (SELECT source, bin, string_agg(term, ', ' ORDER BY r) AS words FROM r GROUP BY ALL) JOIN (SELECT source, bin, count(*) AS frequency FROM d GROUP BY ALL) USING (source, bin)""")
def _(t):
    """Documents dated by the event of their number; the five words of each source in each fifth of the time."""
    micros = F.unix_micros(F.col("ts").cast("timestamp")).cast("double")
    dated = t("documents").join(t("events").select(F.col("event_id").alias("doc_id"), "ts"), "doc_id").withColumn("at", micros)
    dated = B.binned(dated, "at", 5)
    words = P.evolving_words(dated, "source", "bin", "text", 5)
    lists = words.groupBy("source", "bin").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("rank", "term"))), lambda s: s["term"]), ", ").alias("words"))
    return lists.join(dated.groupBy("source", "bin").agg(F.count("*").alias("frequency")), ["source", "bin"]).select("source", "bin", "frequency", "words")


@query("topic_info_representatives", """
    WITH w AS (SELECT source, doc_id, unnest(regexp_extract_all(lower(text), '[a-z]{2,}')) AS term FROM documents), tf AS (SELECT source, doc_id, term, count(*) AS tf FROM w GROUP BY ALL),
         g AS (SELECT source, term, sum(tf) AS s FROM tf GROUP BY ALL), i AS (SELECT term, ln(1 + (SELECT floor(avg(n)) FROM (SELECT sum(s) AS n FROM g GROUP BY source)) / sum(s)) AS idf FROM g GROUP BY 1),
         l AS (SELECT source, sqrt(sum((s * idf) ** 2)) AS l FROM g JOIN i USING (term) GROUP BY 1),
         c AS (SELECT source, doc_id, round(sum(tf * idf * s * idf) / sqrt(sum((tf * idf) ** 2)) / any_value(l), 8) AS similarity FROM tf JOIN g USING (source, term) JOIN i USING (term) JOIN l USING (source) GROUP BY ALL)
    SELECT source, doc_id, similarity, row_number() OVER (PARTITION BY source ORDER BY similarity DESC, doc_id)::INT AS rank FROM c QUALIFY rank <= 3""")
def _(t):
    return P.representatives(t("documents"), "source", "doc_id", "text", 3)


_CLASSES = "x AS (SELECT l_returnflag AS f, unnest([{'c': 'A', 's': l_quantity}, {'c': 'N', 's': -l_quantity}, {'c': 'R', 's': l_discount * l_quantity}], recursive := true) FROM lineitem), e AS (SELECT c, s, count(*) FILTER (f = c) AS p, count(*) FILTER (f <> c) AS q FROM x GROUP BY ALL), k AS (SELECT *, sum(p) OVER w AS tp, sum(q) OVER w AS fp, sum(p) OVER (PARTITION BY c) AS ap, sum(q) OVER (PARTITION BY c) AS aq FROM e WINDOW w AS (PARTITION BY c ORDER BY s DESC))"


def _by_class(t):
    """A score for each return flag, as a model of three classes would give."""
    return L.class_scores(t("lineitem"), "l_returnflag", {"A": F.col("l_quantity"), "N": -F.col("l_quantity"), "R": F.col("l_discount") * F.col("l_quantity")})


@query("roc_curve_by_class", f"WITH {_CLASSES} SELECT c AS class, s AS score, round(tp / ap, 6) AS tpr, round(fp / aq, 6) AS fpr, round(tp / (tp + fp), 6) AS precision FROM k")
def _(t):
    return L.class_curves(_by_class(t)).select("class", "score", *(F.round(c, 6).alias(c) for c in ("tpr", "fpr", "precision")))


@query("auc_by_class", f"WITH {_CLASSES}, a AS (SELECT c AS class, sum(q / aq * (2 * tp - p) / ap / 2) AS auc, sum(p / ap * tp / (tp + fp)) AS ap FROM k GROUP BY 1) SELECT class, round(auc, 6) AS auc, round(ap, 6) AS average_precision FROM (FROM a UNION ALL SELECT NULL, avg(auc), avg(ap) FROM a)")
def _(t):
    """The last row, without class, is the macro mean."""
    return L.class_areas(_by_class(t)).select("class", *(F.round(c, 6).alias(c) for c in ("auc", "average_precision")))


@query("classification_report_means", """
    WITH c AS (SELECT unnest([0, 1]) AS class), s AS (SELECT class, count(*) FILTER (quality = class) AS n, count(*) FILTER (toxic = class) AS g, count(*) FILTER (quality = class AND toxic = class) AS h FROM c, labels GROUP BY 1),
         r AS (SELECT h / g AS p, h / n AS r, 2 * h / (g + n) AS f, n FROM s)
    SELECT 'macro' AS class, round(avg(p), 6) AS precision, round(avg(r), 6) AS recall, round(avg(f), 6) AS f1, sum(n)::BIGINT AS support FROM r
    UNION ALL SELECT 'weighted', round(sum(p * n) / sum(n), 6), round(sum(r * n) / sum(n), 6), round(sum(f * n) / sum(n), 6), sum(n)::BIGINT FROM r
    UNION ALL SELECT 'accuracy', a, a, a, n FROM (SELECT round(avg((quality = toxic)::INT), 6) AS a, count(*) AS n FROM labels WHERE quality IS NOT NULL AND toxic IS NOT NULL)""")
def _(t):
    out = L.report_means(L.classification_report(t("labels"), "quality", "toxic"))
    return out.withColumns({c: F.round(c, 6) for c in ("precision", "recall", "f1")})


_PLAIN = r"regexp_replace(regexp_replace(regexp_replace(regexp_replace(text, '(http|https)://[^ \t\r\n\v\f]+|www\.[^ \t\r\n\v\f]+', '', 'gi'), '([\pL\pN_])/([\pL\pN_])', '\1 \2', 'g'), '([\pL\pN_])/([\pL\pN_])', '\1 \2', 'g'), '<[^>]*>', '', 'g')"


@query("clean_sentences_names", rf"""
    WITH t AS (SELECT list_filter(regexp_split_to_array(text, '[ \t\r\n]+'), lambda x: x <> '') AS w FROM documents), u AS (SELECT unnest(list_filter(w, lambda x, i: i > 1 AND NOT regexp_matches(w[i - 1], '[.!?:]$') AND regexp_matches(x, '^[A-Za-z]+$'))) AS w FROM t),
         l AS (SELECT lower(w) AS k FROM u GROUP BY 1 HAVING count(*) >= 3 AND avg(regexp_matches(w, '^[A-Z]')::INT) >= 0.5),
         d AS (SELECT doc_id, list_filter(regexp_split_to_array({_PLAIN}, '[ \t\r\n\v\f]+'), lambda x: x <> '') AS w FROM documents),
         e AS (SELECT doc_id, unnest(w) AS w, unnest(range(len(w))) AS i FROM d), k AS (SELECT doc_id, i, CASE WHEN lower(regexp_replace(w, '^[^A-Za-z]+|[^A-Za-z]+$', '', 'g')) IN (FROM l) THEN w ELSE lower(w) END AS w FROM e),
         s AS (SELECT doc_id, string_agg(w, ' ' ORDER BY i) AS s FROM k GROUP BY 1),
         p AS (SELECT doc_id, list_filter(regexp_split_to_array(regexp_replace(regexp_replace(s, '[^a-zA-Z0-9 ]', '', 'g'), '[0-9]', ' ', 'g'), ' +'), lambda x: length(x) > 1) AS w FROM s)
    SELECT doc_id, array_to_string(w, ' ') AS text FROM d LEFT JOIN (SELECT doc_id, w FROM p) q USING (doc_id)""".replace("array_to_string(w", "array_to_string(coalesce(q.w, [])"))
def _(t):
    """Words that are capitalised within sentences in half of their uses keep their case."""
    names = P.truecase_lexicon(t("documents"), "text", 0.5)
    return P.sentences_with_names(t("documents"), "doc_id", "text", names)


@query("multi_target_filled")
def _(t):
    """A tenth of the prices and of the years is taken away and filled again: for each target its models, and how far the filled values are from the true ones."""
    gone = lambda c, k: F.when(F.pmod(F.xxhash64("o_orderkey", F.lit(k)), F.lit(10)) > 0, F.col(c))
    known = t("orders").select(
        "o_orderkey", F.month("o_orderdate").alias("month"), F.dayofyear("o_orderdate").alias("day"), F.col("o_custkey").cast("double").alias("c"), F.year("o_orderdate").cast("double").alias("year"),
        (F.dayofyear("o_orderdate") * 10.0 + F.col("o_custkey") % 7).alias("price"),
    )
    some = known.withColumns({"year": gone("year", 1), "price": gone("price", 2)})
    out, log = L.filled_targets(some, ("month", "day", "c"), ("price", "year"), "o_orderkey")
    both = out.select("o_orderkey", *(F.col(c).alias(f"filled_{c}") for c in ("price", "year"))).join(known, "o_orderkey").join(some.select("o_orderkey", *(F.col(c).isNull().alias(f"no_{c}") for c in ("price", "year"))), "o_orderkey")
    each = [F.struct(F.lit(c).alias("target"), F.col(f"filled_{c}").isNull().cast("int").alias("left"), F.abs(F.col(f"filled_{c}") - F.col(c)).alias("error"), F.col(f"no_{c}").alias("gone")) for c in ("price", "year")]
    far = both.select(F.inline(F.array(*each))).groupBy("target").agg(F.sum("left").alias("left_null"), F.avg(F.when(F.col("gone"), F.col("error"))).alias("error"), F.max(F.when(~F.col("gone"), F.col("error"))).alias("changed"))
    return log.join(far, "target")


@query("topic_search_log")
def _(t):
    """Two least sizes of density clusters of the documents by their vectors: outliers, quality, criteria, sizes and words of each."""
    docs = t("documents").select("doc_id", "text").join(t("embeddings").select(F.col("vec_id").alias("doc_id"), "embedding"), "doc_id")
    groups = {"english": ["the", "of", "and"], "german": ["der", "die", "und"]}
    return search.topic_search(docs, "doc_id", "text", "embedding", [(5, 0.02, 3), (5, 0.05, 3)], groups, 2)
