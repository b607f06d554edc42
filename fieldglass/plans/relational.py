"""Queries on text and vector columns, joins, counts, windows, order and sets."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from fieldglass.functions import text as X
from fieldglass.functions import vectors as V
from fieldglass.operators import clean as C
from fieldglass.operators import learning as L
from fieldglass.operators import tables as B
from fieldglass.operators import topics as P
from fieldglass.operators import windows as W
from fieldglass.operators.shared import dealt
from fieldglass.plans.registry import Registry
from fieldglass.sources.scorers import score_distinct

R = Registry()
query = R.query

_STOP = "[" + ", ".join(f"'{w}'" for w in X.STOPWORDS) + "]"
_TOKENS = r"list_filter(regexp_split_to_array({}, '[ \t\r\n]+'), lambda x: x <> '')"

# --- text


@query("strip_html", r"""
    WITH a AS (SELECT page_id, regexp_replace(regexp_replace(regexp_replace(regexp_replace(html, '(?is)<script\b.*?</script\s*>', ' ', 'g'), '(?is)<style\b.*?</style\s*>', ' ', 'g'), '(?s)<!--.*?-->', ' ', 'g'), '(?s)<[^>]*>', ' ', 'g') AS h FROM pages),
         b AS (SELECT page_id, replace(replace(replace(replace(replace(replace(replace(replace(h, '&nbsp;', ' '), '&lt;', '<'), '&gt;', '>'), '&quot;', '"'), '&#39;', ''''), '&copy;', '©'), '&middot;', '·'), '&amp;', '&') AS h FROM a)
    SELECT page_id, trim(regexp_replace(regexp_replace(h, '[ \t\r\n]+', ' ', 'g'), '[0-9]', '', 'g')) AS text FROM b""")
def _(t):
    return t("pages").select("page_id", X.strip_html(F.col("html")).alias("text"))


@query("preprocess_content", rf"SELECT doc_id, array_to_string(list_filter({_TOKENS.format('lower(text)')}, lambda x: regexp_matches(x, '^[A-Za-z]+$') AND NOT list_contains({_STOP}, lower(x))), ' ') AS text FROM documents")
def _(t):
    return t("documents").select("doc_id", X.preprocess_content(F.col("text")).alias("text"))


@query("preprocess_title", rf"""
    WITH w AS (SELECT page_id, list_filter({_TOKENS.format('lower(title)')}, lambda x: regexp_matches(x, '^[A-Za-z]+$') AND NOT list_contains({_STOP}, lower(x))) AS w FROM (SELECT page_id, regexp_extract(html, '<title>([^<]*)</title>', 1) AS title FROM pages)),
         d AS (SELECT DISTINCT unnest(w) AS x FROM w), l AS (SELECT a.x AS word, b.x AS lemma FROM d a JOIN d b ON a.x = b.x || 's'),
         e AS (SELECT page_id, unnest(w) AS word, unnest(range(len(w))) AS i FROM w)
    SELECT page_id, coalesce((SELECT string_agg(coalesce(lemma, word), ' ' ORDER BY i) FROM e LEFT JOIN l USING (word) WHERE e.page_id = w.page_id), '') AS title FROM w""")
def _(t):
    """A plural whose singular is in some title has that as its lemma."""
    words = X.without_stopwords(X.alphabetic(X.tokens(F.lower(F.regexp_extract("html", "<title>([^<]*)</title>", 1)))))
    titles = t("pages").select("page_id", words.alias("words"))
    known = titles.select(F.explode("words").alias("lemma")).distinct()
    lemmas = known.select(F.concat("lemma", F.lit("s")).alias("word"), "lemma").join(known.withColumnRenamed("lemma", "word"), "word")
    return P.with_lemmas(titles, "page_id", "words", lemmas).select("page_id", F.array_join("words", " ").alias("title"))


_PUNCT = r"[!-/:-@\[-`{-~]"


@query("clean_sentences", rf"""
    WITH u AS (SELECT doc_id, regexp_replace(text, '(http|https)://[^ \t\r\n\v\f]+|www\.[^ \t\r\n\v\f]+', '', 'gi') AS s FROM documents),
         h AS (SELECT doc_id, lower(regexp_replace(regexp_replace(regexp_replace(s, '([\pL\pN_])/([\pL\pN_])', '\1 \2', 'g'), '([\pL\pN_])/([\pL\pN_])', '\1 \2', 'g'), '<[^>]*>', '', 'g')) AS s FROM u),
         w AS (SELECT doc_id, list_filter(regexp_split_to_array(regexp_replace(regexp_replace(s, '[^a-z0-9 \t\r\n\v\f]', '', 'g'), '[0-9]', ' ', 'g'), '[ \t\r\n\v\f]+'), lambda x: length(x) > 1) AS w FROM h)
    SELECT doc_id, array_to_string(w, ' ') AS text FROM w""")
def _(t):
    return t("documents").select("doc_id", X.clean_sentences(F.col("text")).alias("text"))


@query("remove_single_chars", r"SELECT item_id, regexp_replace(regexp_replace(text, '[^ -~]', '', 'g'), '\b[A-Za-z0-9_]\b\s*', '', 'g') AS text FROM benchmark")
def _(t):
    return t("benchmark").select("item_id", X.remove_single_chars(F.regexp_replace("text", "[^ -~]", "")).alias("text"))


@query("clean_text", rf"SELECT conv_id, turn, trim(regexp_replace(regexp_replace(regexp_replace(lower(text), '[0-9]+', '', 'g'), '{_PUNCT}', '', 'g'), '[ \t\r\n]+', ' ', 'g')) AS text FROM conversations")
def _(t):
    return t("conversations").select("conv_id", "turn", X.clean_text(F.col("text")).alias("text"))


@query("remove_stopwords", rf"SELECT conv_id, turn, array_to_string(list_filter({_TOKENS.format('lower(text)')}, lambda x: NOT list_contains({_STOP}, x)), ' ') AS text FROM conversations")
def _(t):
    return t("conversations").select("conv_id", "turn", F.array_join(X.without_stopwords(X.tokens(F.lower("text"))), " ").alias("text"))


@query("handle_negations", rf"""
    WITH w AS (SELECT conv_id, turn, list_transform({_TOKENS.format('text')}, lambda x: CASE lower(x) WHEN 'the' THEN 'Not' WHEN 'that' THEN 'NEVER' ELSE x END) AS w FROM conversations)
    SELECT conv_id, turn, array_to_string(list_filter(list_transform(w, lambda x, i: CASE WHEN lower(x) IN ('not', 'no', 'never') THEN NULL WHEN i > 1 AND lower(w[i - 1]) IN ('not', 'no', 'never') THEN 'not_' || x ELSE x END), lambda y: y IS NOT NULL), ' ') AS text FROM w""")
def _(t):
    words = F.transform(X.tokens(F.col("text")), lambda x: F.when(F.lower(x) == "the", "Not").when(F.lower(x) == "that", "NEVER").otherwise(x))
    return t("conversations").select("conv_id", "turn", F.array_join(X.handle_negations(words), " ").alias("text"))


@query("url_host_head", r"SELECT page_id, split_part(regexp_replace(regexp_replace(url, '^https?://', ''), '^www\.', ''), '.', 1) AS head FROM pages")
def _(t):
    return t("pages").select("page_id", X.url_host_head(F.col("url")).alias("head"))


@query("url_extract", "SELECT page_id, CASE WHEN regexp_matches(url, '/en/([^/?]+)') THEN regexp_extract(url, '/en/([^/?]+)', 1) END AS part FROM pages")
def _(t):
    return t("pages").select("page_id", X.url_extract(F.col("url"), "/en/([^/?]+)").alias("part"))


@query("word_count", f"SELECT doc_id, len({_TOKENS.format('text')})::INT AS n FROM documents")
def _(t):
    return t("documents").select("doc_id", X.word_count(F.col("text")).alias("n"))


@query("parse_prob_string", "SELECT vec_id, round(embedding[1]::DOUBLE, 4) AS a, round(embedding[2]::DOUBLE, 4) AS b, 2 AS n FROM embeddings")
def _(t):
    text = F.concat_ws(" ", *[F.get("embedding", F.lit(i)).cast("double").cast("string") for i in (0, 1)])
    p = X.parse_numbers(text)
    return t("embeddings").select("vec_id", F.round(p[0], 4).alias("a"), F.round(p[1], 4).alias("b"), F.size(p).alias("n"))


@query("clean_topic_label", r"""
    -- what is left of: a number, a dash, name and brand (whose one-digit number goes) in quotes, a word and a letter, and a tail of one of three kinds
    SELECT p_partkey, p_name || '; ' || regexp_replace(p_brand, '#.$', '#') || ' Talk' || CASE p_partkey % 3 WHEN 2 THEN ' ' ELSE '' END AS label FROM part""")
def _(t):
    tail = F.when(F.col("p_partkey") % 3 == 0, ": and more, 2. too").when(F.col("p_partkey") % 3 == 1, " - because").otherwise(" Explanation: none")
    raw = F.concat(F.lit('3. - "'), "p_name", F.lit("\", '"), "p_brand", F.lit("'  Talk  x"), tail)
    return t("part").select("p_partkey", X.clean_topic_label(raw).alias("label"))


@query("build_prompt", "SELECT source, 'Documents: ' || array_to_string(list_transform(list_sort(list(doc_id))[1:3], lambda x: x::VARCHAR), ', ') || '. Languages: ' || array_to_string(list_sort(list_distinct(list(lang))), ', ') || '.' AS prompt FROM documents GROUP BY source")
def _(t):
    # the three smallest ids are kept by a bounded aggregate, not a list of all
    first = W.top_per_group(t("documents").select("source", "doc_id"), ["source"], [F.asc("doc_id")], 3).groupBy("source").agg(F.array_sort(F.collect_list("doc_id")).alias("ids"))
    langs = t("documents").groupBy("source").agg(F.array_sort(F.collect_set("lang")).alias("langs"))
    text = F.format_string("Documents: %s. Languages: %s.", F.array_join(F.transform("ids", lambda x: x.cast("string")), ", "), F.array_join("langs", ", "))
    return first.join(langs, "source").select("source", text.alias("prompt"))


# --- vectors


@query("l2_normalize", "SELECT vec_id, round(list_sum(list_transform(embedding::DOUBLE[], lambda x: x / sqrt(list_dot_product(embedding::DOUBLE[], embedding::DOUBLE[])))), 6) AS total FROM embeddings")
def _(t):
    unit = V.l2_normalize(F.col("embedding"))
    return t("embeddings").select("vec_id", F.round(F.aggregate(unit, F.lit(0.0), lambda a, x: a + x), 6).alias("total"))


@query("array_max_value", "SELECT vec_id, list_max(embedding)::DOUBLE AS best FROM embeddings")
def _(t):
    return t("embeddings").select("vec_id", F.array_max("embedding").cast("double").alias("best"))


@query("explode_embedding", "SELECT vec_id, " + ", ".join(f"embedding[{i + 1}]::DOUBLE AS e{i}" for i in range(8)) + " FROM embeddings")
def _(t):
    return t("embeddings").select("vec_id", *[F.get("embedding", F.lit(i)).cast("double").alias(f"e{i}") for i in range(8)])


@query("argmax_class", "SELECT vec_id, (list_position(embedding, list_max(embedding)) - 1)::INT AS class FROM embeddings")
def _(t):
    return t("embeddings").select("vec_id", V.argmax(F.col("embedding")).alias("class"))


@query("cosine", "SELECT a.vec_id, round(list_cosine_similarity(a.embedding::DOUBLE[], b.embedding::DOUBLE[]), 6) AS similarity FROM embeddings a JOIN embeddings b ON b.vec_id = a.vec_id + 1")
def _(t):
    b = t("embeddings").select((F.col("vec_id") - 1).alias("vec_id"), F.col("embedding").alias("other"))
    return t("embeddings").join(b, "vec_id").select("vec_id", F.round(V.cosine(F.col("embedding"), F.col("other")), 6).alias("similarity"))


@query("softmax", "WITH e AS (SELECT vec_id, list_transform(embedding::DOUBLE[], lambda x: exp(x - list_max(embedding::DOUBLE[]))) AS v FROM embeddings) SELECT vec_id, round(v[1] / list_sum(v), 6) AS p0, round(v[2] / list_sum(v), 6) AS p1 FROM e")
def _(t):
    p = V.softmax(F.col("embedding"))
    return t("embeddings").select("vec_id", F.round(p[0], 6).alias("p0"), F.round(p[1], 6).alias("p1"))


@query("mean_word_vector", rf"""
    WITH v AS (SELECT 'w' || vec_id AS word, embedding FROM embeddings), w AS (SELECT conv_id, turn, unnest({_TOKENS.format('text')}) AS word FROM conversations),
         k AS (SELECT conv_id, turn, 'w' || (('0x' || md5(word)[1:5])::BIGINT % 10000) AS word FROM w)
    SELECT c.conv_id, c.turn, round(coalesce(avg(embedding[1]::DOUBLE), 0), 6) AS d0, round(coalesce(avg(embedding[2]::DOUBLE), 0), 6) AS d1
    FROM conversations c LEFT JOIN (k JOIN v USING (word)) k ON k.conv_id = c.conv_id AND k.turn = c.turn GROUP BY ALL""")
def _(t):
    """Each word stands for one of 10,000 names; those that are the name of a vector have it, the others are unknown. Without a known word the mean is zeros."""
    listed = t("embeddings").select(F.concat(F.lit("w"), F.col("vec_id").cast("string")).alias("word"), "embedding")
    words = t("conversations").select("conv_id", "turn", F.explode_outer(X.tokens(F.col("text"))).alias("word"))
    name = F.conv(F.substring(F.md5(F.col("word").cast("binary")), 1, 5), 16, 10).cast("long") % 10_000
    keyed = words.withColumn("word", F.concat(F.lit("w"), name.cast("string")))
    means = [F.round(F.coalesce(F.avg(F.get("embedding", F.lit(i)).cast("double")), F.lit(0.0)), 6).alias(f"d{i}") for i in (0, 1)]
    return keyed.join(listed, "word", "left").groupBy("conv_id", "turn").agg(*means)


# --- joins


@query("join_boards_threads", "SELECT c_custkey, c_name, n_name AS board FROM customer JOIN nation ON c_nationkey = n_nationkey")
def _(t):
    boards = t("nation").select(F.col("n_nationkey").alias("c_nationkey"), F.col("n_name").alias("board"))
    return t("customer").join(boards, "c_nationkey").select("c_custkey", "c_name", "board")


@query("join_threads_members", "SELECT o_orderkey, c_name, o_totalprice FROM orders JOIN customer ON o_custkey = c_custkey AND o_orderkey % 25 = c_nationkey")
def _(t):
    members = t("customer").select(F.col("c_custkey").alias("o_custkey"), F.col("c_nationkey").cast("long").alias("site"), "c_name")
    return t("orders").withColumn("site", F.col("o_orderkey") % 25).join(members, ["o_custkey", "site"]).select("o_orderkey", "c_name", "o_totalprice")


@query("join_posts", "SELECT a.conv_id, a.turn, a.role AS role, b.role AS next_role FROM conversations a JOIN conversations b ON a.conv_id = b.conv_id AND b.turn = a.turn + 1")
def _(t):
    after = t("conversations").select("conv_id", (F.col("turn") - 1).alias("turn"), F.col("role").alias("next_role"))
    return t("conversations").join(after, ["conv_id", "turn"]).select("conv_id", "turn", "role", "next_role")


@query("merge_pipeline", "SELECT r_name, n_name, count(*) AS n, round(sum(l_extendedprice), 2) AS total FROM (SELECT DISTINCT r_name, n_name, l_orderkey, l_linenumber, l_extendedprice FROM region JOIN nation ON r_regionkey = n_regionkey JOIN customer ON c_nationkey = n_nationkey JOIN orders ON o_custkey = c_custkey JOIN lineitem ON l_orderkey = o_orderkey WHERE l_extendedprice IS NOT NULL) GROUP BY ALL")
def _(t):
    place = t("region").join(t("nation"), F.col("r_regionkey") == F.col("n_regionkey")).select("r_name", "n_name", "n_nationkey")
    people = t("customer").join(place, F.col("c_nationkey") == F.col("n_nationkey")).select("c_custkey", "r_name", "n_name")
    threads = t("orders").join(people, F.col("o_custkey") == F.col("c_custkey")).select(F.col("o_orderkey").alias("l_orderkey"), "r_name", "n_name")
    # both by order, so that equal rows are in one task without another shuffle
    lines, n = t("lineitem").select("l_orderkey", "l_linenumber", "l_extendedprice"), t("lineitem").count()
    posts = dealt(lines, n, "l_orderkey").join(dealt(threads, n, "l_orderkey"), "l_orderkey").distinct().na.drop()
    return posts.groupBy("r_name", "n_name").agg(F.count("*").alias("n"), F.round(F.sum("l_extendedprice"), 2).alias("total"))


@query("join_topic_info", "SELECT vec_id, label, count(*) OVER (PARTITION BY label) AS n FROM embeddings")
def _(t):
    info = t("embeddings").groupBy("label").agg(F.count("*").alias("n"))
    return t("embeddings").join(info, "label").select("vec_id", "label", "n")


@query("join_cluster_summary", "SELECT vec_id, label, round(avg(embedding[1]::DOUBLE) OVER (PARTITION BY label), 6) AS m FROM embeddings")
def _(t):
    summary = t("embeddings").groupBy("label").agg(F.avg(F.get("embedding", F.lit(0)).cast("double")).alias("m"))
    return t("embeddings").join(summary, "label").select("vec_id", "label", F.round("m", 6).alias("m"))


@query("attach_cached_scores", "SELECT doc_id, length(text)::BIGINT AS n, CASE WHEN length(text) > 2000 THEN 'long' ELSE 'short' END AS label FROM documents")
def _(t):
    def model(texts):
        return [("long" if len(x) > 2000 else "short", len(x)) for x in texts]

    return score_distinct(t("documents").select("doc_id", "text"), "text", model, "label string, n long", ("None", 0)).select("doc_id", "n", "label")


@query("concat_columns", "SELECT o_orderkey, o_totalprice, o_orderstatus FROM orders")
def _(t):
    return t("orders").select("o_orderkey", "o_totalprice").join(t("orders").select("o_orderkey", "o_orderstatus"), "o_orderkey")


@query("align_labels_index", "SELECT doc_id, quality FROM labels WHERE quality IS NOT NULL")
def _(t):
    return t("labels").where("quality is not null").select("doc_id", "quality")


@query("files_without_pair", "SELECT o_orderkey FROM orders WHERE o_orderkey NOT IN (SELECT l_orderkey FROM lineitem WHERE l_quantity > 30)")
def _(t):
    pairs = t("lineitem").where("l_quantity > 30").select(F.col("l_orderkey").alias("o_orderkey"))
    return t("orders").join(pairs, "o_orderkey", "left_anti").select("o_orderkey")


@query("splits_disjoint", "SELECT 0::BIGINT AS n_common")
def _(t):
    parts = L.split(t("orders"), "o_orderkey", [("train", 70), ("valid", 15), ("test", 15)]).groupBy("o_orderkey").agg(F.countDistinct("part").alias("n"))
    return parts.agg(F.count_if(F.col("n") > 1).alias("n_common"))


@query("topic_pairs", "SELECT DISTINCT a.label AS a, b.label AS b FROM embeddings a JOIN embeddings b ON a.label < b.label")
def _(t):
    k = t("embeddings").select("label").distinct()
    return k.select(F.col("label").alias("a")).join(k.select(F.col("label").alias("b")), F.col("a") < F.col("b"))


# --- counts and tables


@query("value_counts", "SELECT event_type, count(*) AS n FROM events GROUP BY 1")
def _(t):
    return B.value_counts(t("events"), "event_type")


@query("value_counts_nulls", "SELECT quality, count(*) AS n FROM documents LEFT JOIN labels USING (doc_id) GROUP BY 1")
def _(t):
    return B.value_counts(t("documents").select("doc_id").join(t("labels"), "doc_id", "left"), "quality")


@query("value_counts_by_key", "SELECT strftime(o_orderdate, '%Y-%m') AS ym, count(*) AS n FROM orders GROUP BY 1")
def _(t):
    return t("orders").groupBy(F.date_format("o_orderdate", "yyyy-MM").alias("ym")).agg(F.count("*").alias("n")).orderBy(F.desc("ym"))


@query("value_share_domain", "SELECT d.l_linenumber, round(coalesce(n / sum(n) OVER (), 0), 6) AS share FROM (SELECT unnest(range(1, 10))::INT AS l_linenumber) d LEFT JOIN (SELECT l_linenumber, count(*) AS n FROM lineitem GROUP BY 1) USING (l_linenumber)")
def _(t):
    return B.value_share_domain(t("lineitem"), "l_linenumber", range(1, 10)).withColumn("share", F.round("share", 6))


@query("share_equal", "SELECT year(o_orderdate)::INT AS year, round(avg((o_orderstatus = 'F')::INT) * 100, 6) AS percent FROM orders GROUP BY 1")
def _(t):
    return B.share_equal(t("orders").withColumn("year", F.year("o_orderdate")), ["year"], "o_orderstatus", "F").withColumn("percent", F.round("percent", 6))


@query("share_of_counts", "SELECT event_type, count(*) AS n, round(count(*) / sum(count(*)) OVER (), 6) AS share FROM events GROUP BY 1")
def _(t):
    return B.share_of_counts(t("events"), "event_type").withColumn("share", F.round("share", 6))


@query("daily_counts", "SELECT ts::DATE AS day, count(*) AS n FROM events GROUP BY 1")
def _(t):
    return t("events").groupBy(F.to_date("ts").alias("day")).agg(F.count("*").alias("n"))


@query("count_by_datepart", " UNION ALL ".join(f"SELECT '{p}' AS part, ({e})::INT AS value, count(*) AS n FROM events GROUP BY 2" for p, e in (("year", "year(ts)"), ("month", "month(ts)"), ("day", "day(ts)"), ("weekday", "isodow(ts) - 1"), ("weekend", "(isodow(ts) >= 6)::INT"))))
def _(t):
    return B.counts_by_parts(t("events"), "ts")


@query("topn_plus_other", "WITH c AS (SELECT ts::DATE::VARCHAR AS value, count(*) AS n FROM events GROUP BY 1), k AS (SELECT * FROM c ORDER BY n DESC, value LIMIT 5) SELECT * FROM k UNION ALL SELECT 'other', (SELECT sum(n) FROM c)::BIGINT - (SELECT sum(n) FROM k)::BIGINT")
def _(t):
    return B.top_plus_other(t("events"), F.to_date("ts"), 5)


@query("pivot_heatmap", "SELECT d.row, " + ", ".join(f"count(*) FILTER (month(ts) = {m}) AS m{m}" for m in range(1, 13)) + " FROM (SELECT unnest(range(0, 7))::INT AS row) d LEFT JOIN events ON isodow(ts) - 1 = d.row GROUP BY 1")
def _(t):
    return B.pivot_counts(t("events"), F.weekday("ts"), range(7), F.month("ts"), range(1, 13), "m")


@query("pivot_weekend", "SELECT d.row, " + ", ".join(f"count(*) FILTER (month(ts) = {m}) AS m{m}" for m in range(1, 13)) + " FROM (SELECT unnest(range(0, 2))::INT AS row) d LEFT JOIN events ON (isodow(ts) >= 6)::INT = d.row GROUP BY 1")
def _(t):
    return B.pivot_counts(t("events"), (F.weekday("ts") >= 5).cast("int"), range(2), F.month("ts"), range(1, 13), "m")


@query("group_stats", "SELECT event_type, round(max(value), 6) AS max, round(min(value), 6) AS min, round(avg(value), 6) AS mean, round(median(value), 6) AS median FROM events GROUP BY 1")
def _(t):
    out = B.group_stats(t("events"), ["event_type"], "value")
    return out.select("event_type", *[F.round(c, 6).alias(c) for c in ("max", "min", "mean", "median")])


@query("melt_stats", "SELECT event_type, unnest(['max', 'min']) AS statistic, round(unnest([max(value), min(value)]), 6) AS value FROM events GROUP BY event_type")
def _(t):
    out = B.melt(B.group_stats(t("events"), ["event_type"], "value"), ["event_type"], ["max", "min"])
    return out.withColumn("value", F.round("value", 6))


@query("counts_over_time", "SELECT date_trunc('month', ts)::DATE AS month, " + ", ".join(f"count(*) FILTER (event_id % 3 = {k}) AS s{k}" for k in range(3)) + " FROM events GROUP BY 1")
def _(t):
    return t("events").groupBy(F.trunc("ts", "month").alias("month")).agg(*[F.count_if(F.col("event_id") % 3 == k).alias(f"s{k}") for k in range(3)])


@query("group_mean_sorted", "SELECT l_returnflag, round(avg(l_extendedprice), 4) AS mean FROM lineitem GROUP BY 1")
def _(t):
    return t("lineitem").groupBy("l_returnflag").agg(F.round(F.avg("l_extendedprice"), 4).alias("mean")).orderBy("mean")


_YEARS = range(1992, 1999)


@query("rate_by_group_year", "SELECT l_linenumber, " + ", ".join(f"coalesce(round(avg((l_returnflag = 'R')::INT) FILTER (year(l_shipdate) = {y}) * 100, 6), 0) AS y{y}" for y in _YEARS) + " FROM lineitem GROUP BY 1")
def _(t):
    rate = [F.coalesce(F.round(F.avg(F.when(F.year("l_shipdate") == y, (F.col("l_returnflag") == "R").cast("int"))) * 100, 6), F.lit(0.0)).alias(f"y{y}") for y in _YEARS]
    return t("lineitem").groupBy("l_linenumber").agg(*rate)


@query("share_of_bucket_by_year", "WITH b AS (SELECT l_returnflag, year(l_shipdate)::INT AS year, CASE WHEN l_quantity <= 10 THEN 'few' WHEN l_quantity >= 40 THEN 'many' END AS bucket FROM lineitem) SELECT l_returnflag, year, bucket, round(n * 100 / sum(n) OVER (PARTITION BY l_returnflag, year), 6) AS percent FROM (SELECT l_returnflag, year, bucket, count(*) AS n FROM b WHERE bucket IS NOT NULL GROUP BY 1, 2, 3)")
def _(t):
    bucket = F.when(F.col("l_quantity") <= 10, "few").when(F.col("l_quantity") >= 40, "many")
    rows = t("lineitem").select("l_returnflag", F.year("l_shipdate").alias("year"), bucket.alias("bucket"))
    return B.share_of_buckets(rows, ["l_returnflag"], "year", "bucket").withColumn("percent", F.round("percent", 6))


@query("crosstab_hue", "SELECT o_orderpriority, o_orderstatus, count(*) AS n FROM orders GROUP BY ALL")
def _(t):
    return B.value_counts(t("orders"), "o_orderpriority", "o_orderstatus")


@query("bar_means", "SELECT o_orderpriority, round(avg(o_totalprice), 4) AS mean, round(stddev_samp(o_totalprice) / sqrt(count(*)), 4) AS error FROM orders GROUP BY 1")
def _(t):
    return B.bar_means(t("orders"), ["o_orderpriority"], "o_totalprice").select("o_orderpriority", F.round("mean", 4).alias("mean"), F.round("error", 4).alias("error"))


@query("column_means_sorted", " UNION ALL ".join(f"SELECT '{c}' AS column_name, round(avg({c}), 4) AS mean FROM lineitem" for c in ("l_quantity", "l_discount", "l_tax")))
def _(t):
    return B.column_means(t("lineitem"), ["l_quantity", "l_discount", "l_tax"]).withColumn("mean", F.round("mean", 4))


@query("box_stats", """
    WITH q AS (SELECT l_returnflag, quantile_cont(l_extendedprice, 0.25) AS q1, quantile_cont(l_extendedprice, 0.5) AS q2, quantile_cont(l_extendedprice, 0.75) AS q3 FROM lineitem GROUP BY 1),
         r AS (SELECT *, l_extendedprice BETWEEN q1 - 0.5 * (q3 - q1) AND q3 + 0.5 * (q3 - q1) AS inside FROM lineitem JOIN q USING (l_returnflag))
    SELECT l_returnflag, round(q1, 4) AS q1, round(q2, 4) AS q2, round(q3, 4) AS q3, min(l_extendedprice) FILTER (inside) AS whisker_low, max(l_extendedprice) FILTER (inside) AS whisker_high, count(*) FILTER (NOT inside) AS n_outside FROM r GROUP BY ALL""")
def _(t):
    out = B.box_stats(t("lineitem"), "l_returnflag", "l_extendedprice", 0.5)
    return out.withColumns({c: F.round(c, 4) for c in ("q1", "q2", "q3")})


@query("histogram", "WITH e AS (SELECT min(o_totalprice) AS lo, max(o_totalprice) AS hi FROM orders) SELECT least(floor((o_totalprice - lo) / ((hi - lo) / 30)), 29)::INT AS bin, count(*) AS n FROM orders, e GROUP BY 1")
def _(t):
    return B.histogram(t("orders"), "o_totalprice", 30)


@query("histogram_2d", "WITH e AS (SELECT min(l_quantity) AS a, max(l_quantity) AS b, min(l_extendedprice) AS c, max(l_extendedprice) AS d FROM lineitem) SELECT least(floor((l_quantity - a) / ((b - a) / 20)), 19)::INT AS bin_x, least(floor((l_extendedprice - c) / ((d - c) / 20)), 19)::INT AS bin_y, count(*) AS n FROM lineitem, e GROUP BY ALL")
def _(t):
    return B.histogram_2d(t("lineitem"), "l_quantity", "l_extendedprice", 20)


@query("kde_curve", """
    WITH e AS (SELECT min(o_totalprice) AS lo, max(o_totalprice) AS hi, count(*) AS n FROM orders), c AS (SELECT floor((o_totalprice - lo) / (hi - lo) * 999 + 0.5) AS cell, count(*) AS w FROM orders, e GROUP BY 1),
         g AS (SELECT lo + (hi - lo) * i / 49 AS x FROM e, range(50) r(i))
    SELECT round(x, 2) AS x, round(sum(w * exp(-(((x - (lo + (hi - lo) * cell / 999)) / 20000) ** 2) / 2)) / (any_value(n) * 20000 * sqrt(2 * pi())) * 1e6, 6) AS density FROM g, c, e GROUP BY g.x""")
def _(t):
    return B.kde_curve(t("orders"), "o_totalprice", 50, 20000.0).select(F.round("x", 2).alias("x"), F.round(F.col("density") * 1e6, 6).alias("density"))


_CORR = ("l_quantity", "l_extendedprice", "l_discount")


@query("corr_matrix", " UNION ALL ".join(f"SELECT '{a}' AS a, '{b}' AS b, round(corr({a}, {b}), 6) AS r FROM lineitem" for i, a in enumerate(_CORR) for b in _CORR[i:]))
def _(t):
    return B.corr_matrix(t("lineitem"), _CORR).withColumn("r", F.round("r", 6))


@query("regression_line", "SELECT round(regr_slope(l_extendedprice, l_quantity), 4) AS slope, round(regr_intercept(l_extendedprice, l_quantity), 4) AS intercept, round(regr_r2(l_extendedprice, l_quantity), 6) AS r2 FROM lineitem")
def _(t):
    return B.regression_line(t("lineitem"), "l_quantity", "l_extendedprice").select(F.round("slope", 4).alias("slope"), F.round("intercept", 4).alias("intercept"), F.round("r2", 6).alias("r2"))


@query("pair_sample")
def _(t):
    """A scatter plot's points: about one row in ten, by hash of the key."""
    return t("lineitem").where(L.hash_bucket("l_orderkey", 10) == 0).select("l_quantity", "l_extendedprice")


@query("length_stats", f"WITH w AS (SELECT len({_TOKENS.format('text')})::INT AS n FROM documents), m AS (SELECT n FROM w GROUP BY n ORDER BY count(*) DESC, n LIMIT 1) SELECT round(avg(w.n), 6) AS mean, median(w.n) AS median, any_value(m.n) AS mode FROM w, m")
def _(t):
    n = t("documents").select(X.word_count(F.col("text")).alias("n"))
    return n.agg(F.round(F.avg("n"), 6).alias("mean"), F.median("n").alias("median"), F.mode("n", True).alias("mode"))


@query("word_freq", f"SELECT word, count(*) AS n FROM (SELECT unnest({_TOKENS.format('lower(text)')}) AS word FROM documents) GROUP BY 1")
def _(t):
    return P.word_freq(t("documents"), "text")


@query("concat_by_group", f"SELECT source, sum(len({_TOKENS.format('text')}))::BIGINT AS words, sum(length(text))::BIGINT AS chars FROM documents GROUP BY 1")
def _(t):
    return t("documents").groupBy("source").agg(F.sum(X.word_count(F.col("text"))).alias("words"), F.sum(F.length("text")).alias("chars"))


@query("cluster_size_pct", "SELECT label, count(*) AS n, round(count(*) / sum(count(*)) OVER () * 100, 6) AS percent FROM embeddings GROUP BY 1")
def _(t):
    return B.share_of_counts(t("embeddings"), "label").select("label", "n", F.round(F.col("share") * 100, 6).alias("percent"))


@query("cluster_examples", "SELECT label, vec_id FROM embeddings QUALIFY row_number() OVER (PARTITION BY label ORDER BY vec_id) <= 3 UNION SELECT label, vec_id FROM embeddings QUALIFY row_number() OVER (PARTITION BY label ORDER BY vec_id DESC) <= 3")
def _(t):
    df = t("embeddings").select("label", "vec_id")
    ends = [W.top_per_group(df, ["label"], [o], 3).drop("rank") for o in (F.asc("vec_id"), F.desc("vec_id"))]
    return ends[0].union(ends[1]).distinct()


@query("class_balance", "SELECT quality, count(*) AS n, max(count(*)) OVER () - count(*) AS missing FROM labels GROUP BY 1")
def _(t):
    return B.class_balance(t("labels"), "quality")


@query("label_class_counts", "SELECT l_returnflag AS class, count(*) AS n FROM lineitem GROUP BY 1")
def _(t):
    return B.value_counts(t("lineitem").select(F.col("l_returnflag").alias("class")), "class")


@query("annotation_stats", "SELECT l_returnflag AS class, count(*) AS n, round(avg(l_quantity::INT * 2 * l_quantity::INT / (640 * 480)), 8) AS area FROM lineitem GROUP BY 1")
def _(t):
    from fieldglass.plans.tabular import boxes

    area = (F.col("xmax") - F.col("xmin")) * (F.col("ymax") - F.col("ymin")) / (F.col("width") * F.col("height"))
    return boxes(t).groupBy("class").agg(F.count("*").alias("n"), F.round(F.avg(area), 8).alias("area"))


@query("weighted_share", "SELECT l_linestatus, round(sum(l_quantity * (l_returnflag = 'R')::INT) / sum(l_quantity), 6) AS share FROM lineitem GROUP BY 1")
def _(t):
    return B.weighted_share(t("lineitem"), ["l_linestatus"], F.col("l_returnflag") == "R", "l_quantity").withColumn("share", F.round("share", 6))


# --- windows


def _user():
    return W.along(["user_id"], ["ts", "event_id"])


_W = "(PARTITION BY user_id ORDER BY ts, event_id)"


@query("lag_features", f"SELECT event_id, lag(value, 1) OVER {_W} AS value_lag1, lag(value, 2) OVER {_W} AS value_lag2 FROM events")
def _(t):
    return W.lag_features(t("events"), ["value"], [1, 2], _user()).select("event_id", "value_lag1", "value_lag2")


@query("moving_average", "SELECT event_id, round(CASE WHEN count(value) OVER w = 3 THEN avg(value) OVER w END, 6) AS value_ma3 FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id ROWS BETWEEN 2 PRECEDING AND CURRENT ROW)")
def _(t):
    return W.moving_average(t("events"), ["value"], 3, _user()).select("event_id", F.round("value_ma3", 6).alias("value_ma3"))


@query("diff_features", f"SELECT event_id, round(value - lag(value) OVER {_W}, 6) AS value_diff FROM events")
def _(t):
    return W.diff_features(t("events"), ["value"], _user()).select("event_id", F.round("value_diff", 6).alias("value_diff"))


@query("process_data", f"""
    WITH f AS (SELECT event_id, lag(value, 1) OVER {_W} AS l, CASE WHEN count(value) OVER w = 3 THEN avg(value) OVER w END AS m, value - lag(value) OVER {_W} AS d FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id ROWS BETWEEN 2 PRECEDING AND CURRENT ROW))
    SELECT event_id, round(coalesce(l, avg(l) OVER ()), 5) AS value_lag1, round(coalesce(m, avg(m) OVER ()), 5) AS value_ma3, round(coalesce(d, avg(d) OVER ()), 5) AS value_diff FROM f""")
def _(t):
    out = W.process_series(t("events"), ["value"], [1], 3, _user())
    return out.select("event_id", *[F.round(c, 5).alias(c) for c in ("value_lag1", "value_ma3", "value_diff")])


@query("sample_per_group")
def _(t):
    return W.sample_per_group(t("events").select("user_id", "event_id"), ["user_id"], "event_id", 3)


@query("sample_per_group_sizes", "SELECT user_id, least(3, count(*)) AS n, least(3, count(DISTINCT event_id)) AS n_events FROM events GROUP BY 1")
def _(t):
    """Of each sample of sample_per_group: its rows, and its events that are events of the group."""
    found = W.sample_per_group(t("events").select("user_id", "event_id"), ["user_id"], "event_id", 3)
    own = found.join(t("events").select("user_id", "event_id"), ["user_id", "event_id"], "left_semi").groupBy("user_id").agg(F.count_distinct("event_id").alias("n_events"))
    return found.groupBy("user_id").agg(F.count("*").alias("n")).join(own, "user_id")


@query("adjacent_size_ratio", "WITH c AS (SELECT label, count(*) AS n FROM embeddings GROUP BY 1 ORDER BY n DESC, label LIMIT 4), d AS (SELECT n, lag(n) OVER (ORDER BY n DESC, label) AS b FROM c) SELECT bool_and((b - n) / b <= 0.15) AS within FROM d WHERE b IS NOT NULL")
def _(t):
    top = t("embeddings").groupBy("label").agg(F.count("*").alias("n")).orderBy(F.desc("n"), "label").limit(4)
    before = F.lag("n").over(Window.orderBy(F.desc("n"), "label"))  # four rows
    return top.withColumn("b", before).where("b is not null").agg(F.bool_and((F.col("b") - F.col("n")) / F.col("b") <= 0.15).alias("within"))


# --- order and sets


@query("top_k_words", f"SELECT word, count(*) AS n FROM (SELECT unnest({_TOKENS.format('lower(text)')}) AS word FROM documents) GROUP BY 1 ORDER BY n DESC, word LIMIT 100")
def _(t):
    return P.word_freq(t("documents"), "text").orderBy(F.desc("n"), "word").limit(100)


@query("top_k_values", "SELECT user_id, count(*) AS n FROM events GROUP BY 1 ORDER BY n DESC, user_id LIMIT 10")
def _(t):
    return B.value_counts(t("events"), "user_id").limit(10)


@query("sort_by_column", "SELECT event_id, value FROM events")
def _(t):
    return t("events").select("event_id", "value").orderBy(F.desc("value"), "event_id")


@query("head", "SELECT * FROM orders ORDER BY o_orderkey LIMIT 5")
def _(t):
    return t("orders").orderBy("o_orderkey").limit(5)


@query("shuffle", "SELECT o_orderkey FROM orders")
def _(t):
    return t("orders").select("o_orderkey").orderBy(F.xxhash64("o_orderkey", F.lit(7)), "o_orderkey")


@query("union_waves", "SELECT o_orderkey, 'early' AS wave FROM orders WHERE year(o_orderdate) < 1995 UNION ALL SELECT o_orderkey, 'late' FROM orders WHERE year(o_orderdate) >= 1995")
def _(t):
    early = F.year("o_orderdate") < 1995
    return t("orders").where(early).select("o_orderkey", F.lit("early").alias("wave")).unionByName(t("orders").where(~early).select("o_orderkey", F.lit("late").alias("wave")))


@query("set_difference", "SELECT c_custkey FROM customer EXCEPT SELECT o_custkey FROM orders WHERE o_orderstatus = 'F'")
def _(t):
    return t("customer").select("c_custkey").subtract(t("orders").where("o_orderstatus = 'F'").select(F.col("o_custkey").alias("c_custkey")))


@query("set_intersect", "SELECT DISTINCT l_partkey FROM lineitem WHERE l_returnflag = 'R' INTERSECT SELECT l_partkey FROM lineitem WHERE l_returnflag = 'A'")
def _(t):
    parts = lambda f: t("lineitem").where(F.col("l_returnflag") == f).select("l_partkey")
    return parts("R").intersect(parts("A"))


@query("set_distinct", "SELECT DISTINCT lower(text) AS text FROM documents")
def _(t):
    return t("documents").select(F.lower("text").alias("text")).distinct()


@query("count_pairs_keep_first", "SELECT user_id, event_type, min(event_id) AS event_id FROM events GROUP BY ALL")
def _(t):
    return C.keep_first(t("events").select("user_id", "event_type", "event_id"), ["user_id", "event_type"], ["event_id"])
