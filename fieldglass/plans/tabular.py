"""Queries over tables: sources, columns, repair of nulls, features and dates."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from fieldglass.operators import clean as C
from fieldglass.operators import dates as D
from fieldglass.operators import features as E
from fieldglass.operators.shared import shared_dir
from fieldglass.plans.registry import Registry
from fieldglass.sources import readers, sinks

R = Registry()
query = R.query


def scratch(df) -> str:
    """A new folder among those that driver and executors share."""
    return f"{shared_dir(df.sparkSession)}/{uuid.uuid4().hex}"


# --- sources and sinks


@query("scan_csv", "SELECT * FROM customer")
def _(t):
    sinks.write_csv(df := t("customer"), path := scratch(df))
    return readers.read_csv(df.sparkSession, path, df.schema)


@query("scan_csv_multiline", "SELECT conv_id, turn, role, text FROM conversations")
def _(t):
    sinks.write_csv(df := t("conversations").select("conv_id", "turn", "role", "text"), path := scratch(df))
    return readers.read_csv(df.sparkSession, path, df.schema, multi_line=True)


@query("sink_csv", "SELECT o_orderkey, o_orderstatus, o_totalprice FROM orders WHERE o_orderstatus <> 'F'")
def _(t):
    df = t("orders").select("o_orderkey", "o_orderstatus", "o_totalprice").where("o_orderstatus <> 'F'")
    sinks.write_csv(df, path := scratch(df))
    return readers.read_csv(df.sparkSession, path, df.schema)


@query("scan_parquet", "SELECT vec_id, label, len(embedding)::INT AS dimensions FROM embeddings")
def _(t):
    return t("embeddings").select("vec_id", "label", F.size("embedding").alias("dimensions"))


@query("store_embeddings", "SELECT vec_id, round(list_sum(embedding::DOUBLE[]), 6) AS total FROM embeddings")
def _(t):
    df = t("embeddings").select("vec_id", "embedding")
    sinks.write_parquet(df, path := scratch(df))
    back = df.sparkSession.read.schema(df.schema).parquet(path)
    return back.select("vec_id", F.round(F.aggregate(F.col("embedding").cast("array<double>"), F.lit(0.0), lambda a, x: a + x), 6).alias("total"))


@query("sink_parquet", "SELECT * FROM events")
def _(t):
    df = t("events")
    sinks.write_parquet(df.withColumn("day", F.to_date("ts")), path := scratch(df), "day")
    return df.sparkSession.read.parquet(path).drop("day")


@query("scan_waves", "SELECT o_orderkey, o_totalprice, CASE WHEN year(o_orderdate) >= 1995 THEN o_orderpriority END AS o_orderpriority, year(o_orderdate)::INT AS Year FROM orders WHERE year(o_orderdate) BETWEEN 1993 AND 1996")
def _(t):
    orders = t("orders")
    waves = {y: orders.where(F.year("o_orderdate") == y).select("o_orderkey", "o_totalprice", *(["o_orderpriority"] if y >= 1995 else [])) for y in (1993, 1994, 1995, 1996)}
    return readers.read_waves(waves)


@query("scan_lists", "SELECT DISTINCT p_type AS intent FROM part")
def _(t):
    df = t("part").select(F.col("p_type").alias("intent"), F.lit(None).cast("string").alias("spare")).distinct()
    sinks.write_csv(df, path := scratch(df))
    return readers.read_csv(df.sparkSession, path, df.schema).select("intent")


@query("scan_filtered", "SELECT doc_id, text, source FROM documents WHERE text IS NOT NULL QUALIFY row_number() OVER (PARTITION BY text ORDER BY doc_id) = 1")
def _(t):
    return readers.read_filtered(t("documents").select("doc_id", "text", "source"), "text", ["doc_id"])


@query("scan_files_by_class", r"SELECT page_id, CASE WHEN regexp_matches(url, '/en/') THEN 0 WHEN regexp_matches(url, '/de/') THEN 5 WHEN regexp_matches(url, '\.html') THEN 10 END AS class FROM pages")
def _(t):
    return readers.files_by_class(t("pages"), "url", {"/en/": 0, "/de/": 5, r"\.html": 10}).select("page_id", "class")


@query("scan_label_lines", "SELECT l_linenumber AS class, l_quantity AS xc, l_discount AS yc, l_tax AS w, l_discount AS h FROM lineitem")
def _(t):
    df = t("lineitem").select(F.concat_ws(" ", *[F.col(c).cast("string") for c in ("l_linenumber", "l_quantity", "l_discount", "l_tax", "l_discount")]).alias("value"))
    df.write.text(path := scratch(df))
    return readers.read_label_lines(df.sparkSession, path)


_BOXES = "SELECT 'v' || l_orderkey || '.jpg' AS filename, 640 AS width, 480 AS height, l_returnflag AS class, l_linenumber * 10 AS xmin, l_linenumber * 20 AS ymin, l_linenumber * 10 + l_quantity::INT AS xmax, l_linenumber * 20 + 2 * l_quantity::INT AS ymax FROM lineitem"


def boxes(t):
    line = F.col("l_linenumber")
    return t("lineitem").select(
        F.concat(F.lit("v"), F.col("l_orderkey").cast("string"), F.lit(".jpg")).alias("filename"), F.lit(640).alias("width"), F.lit(480).alias("height"), F.col("l_returnflag").alias("class"),
        (line * 10).alias("xmin"), (line * 20).alias("ymin"), (line * 10 + F.col("l_quantity").cast("int")).alias("xmax"), (line * 20 + 2 * F.col("l_quantity").cast("int")).alias("ymax"),
    )


@query("scan_annotations", _BOXES)
def _(t):
    sinks.write_csv(df := boxes(t), path := scratch(df))
    return readers.read_annotations(df.sparkSession, path)


@query("scan_csv_zip", "SELECT p_partkey, p_size FROM part")
def _(t):
    """Each 500 parts make one zip file."""
    import io
    import zipfile

    df = t("part").select("p_partkey", "p_size")
    text = df.groupBy(F.floor(F.col("p_partkey") / 500)).agg(F.array_sort(F.collect_list(F.concat_ws(",", *[F.col(c).cast("string") for c in df.columns]))).alias("rows")).select("rows")

    def pack(batches):
        import pyarrow as pa

        for batch in batches:
            files = []
            for rows in batch.column("rows").to_pylist():
                out = io.BytesIO()
                with zipfile.ZipFile(out, "w") as z:
                    z.writestr("part.csv", "\n".join(["p_partkey,p_size", *rows]) + "\n")
                files.append(out.getvalue())
            yield pa.RecordBatch.from_arrays([pa.array(files, pa.binary())], ["content"])

    return readers.unzipped(text.mapInArrow(pack, "content binary"), df.schema)


@query("sink_append_log", "SELECT o_orderstatus, count(*) AS n, run FROM orders, (VALUES (1), (2)) r(run) GROUP BY ALL")
def _(t):
    df = t("orders").groupBy("o_orderstatus").agg(F.count("*").alias("n"))
    path = scratch(df)
    for k in (1, 2):
        sinks.append_log(df.withColumn("run", F.lit(k)), path)
    return df.sparkSession.read.parquet(path)


@query("sink_chunked", "SELECT doc_id, length(text)::BIGINT AS n FROM documents")
def _(t):
    df = t("documents").select("doc_id", "text")
    path = scratch(df)
    for _ in range(2):  # the second run finds all chunks done
        sinks.write_chunked(df, "doc_id", path, lambda part: part.select("doc_id", F.length("text").cast("long").alias("n")), 4)
    return df.sparkSession.read.parquet(path).drop("chunk")


@query("save_labels", "SELECT DISTINCT label AS topic, 'topic ' || label AS name FROM embeddings")
def _(t):
    df = t("embeddings").select(F.col("label").alias("topic"), F.concat(F.lit("topic "), F.col("label").cast("string")).alias("name")).distinct()
    sinks.write_parquet(df, path := scratch(df))
    return df.sparkSession.read.parquet(path)


# --- columns, filters, profiles


@query("drop_columns", "SELECT * EXCLUDE (l_tax, l_discount) FROM lineitem")
def _(t):
    return t("lineitem").drop("l_tax", "l_discount")


@query("select_columns", "SELECT l_orderkey, l_quantity FROM lineitem")
def _(t):
    return t("lineitem").select("l_orderkey", "l_quantity")


@query("select_by_name_pattern", "SELECT l_orderkey, l_partkey, l_suppkey FROM lineitem")
def _(t):
    return C.select_by_name(t("lineitem"), "l_", "key")


@query("rename_suffix", "SELECT n_nationkey, n_name AS n_name_board, n_regionkey AS n_regionkey_board FROM nation")
def _(t):
    return C.rename_suffix(t("nation"), "_board", ["n_nationkey"])


@query("filter_eq_cols", "SELECT l_orderkey, l_linenumber, l_suppkey FROM lineitem WHERE l_linenumber = l_suppkey")
def _(t):
    return C.filter_equal_columns(t("lineitem"), "l_linenumber", "l_suppkey").select("l_orderkey", "l_linenumber", "l_suppkey")


@query("filter_value", "SELECT o_orderkey FROM orders WHERE o_orderstatus <> 'F' AND o_orderpriority <> '5-LOW' AND o_totalprice > 100000")
def _(t):
    return t("orders").where("o_orderstatus <> 'F' and o_orderpriority <> '5-LOW' and o_totalprice > 100000").select("o_orderkey")


@query("filter_in_keys", "SELECT o_orderkey, o_custkey FROM orders WHERE o_custkey IN (SELECT c_custkey FROM customer WHERE c_acctbal < 0)")
def _(t):
    keys = t("customer").where("c_acctbal < 0").select(F.col("c_custkey").alias("o_custkey"))
    return C.in_keys(t("orders"), keys, "o_custkey").select("o_orderkey", "o_custkey")


@query("filter_not_outlier", "SELECT vec_id, label FROM embeddings WHERE label <> 0")
def _(t):
    return t("embeddings").where("label <> 0").select("vec_id", "label")


_LABELLED = "(SELECT d.doc_id, d.n_chars, l.quality, l.toxic FROM documents d LEFT JOIN labels l USING (doc_id))"


def labelled(t):
    return t("documents").select("doc_id", "n_chars").join(t("labels"), "doc_id", "left")


@query("dropna_subset", f"SELECT * FROM {_LABELLED} WHERE quality IS NOT NULL AND toxic IS NOT NULL")
def _(t):
    return labelled(t).na.drop(subset=["quality", "toxic"])


@query("dedupe_keep_first", "SELECT doc_id, source, text FROM documents QUALIFY row_number() OVER (PARTITION BY text ORDER BY doc_id) = 1")
def _(t):
    return C.keep_first(t("documents").select("doc_id", "source", "text"), ["text"], ["doc_id"])


@query("dedupe_rows", "SELECT DISTINCT user_id, event_type FROM events")
def _(t):
    return t("events").select("user_id", "event_type").distinct()


@query("count_duplicates", "SELECT (count(*) - count(DISTINCT text))::BIGINT AS n_duplicates FROM documents")
def _(t):
    return C.count_duplicates(t("documents"), ["text"])


def _each(columns, expr):
    return " UNION ALL ".join(f"SELECT '{c}' AS column_name, {expr.format(c=c)} FROM {{table}}" for c in columns)


_ORDERS = ("o_orderkey", "o_custkey", "o_orderstatus", "o_totalprice", "o_orderdate", "o_orderpriority")


@query("profile_nunique", _each(_ORDERS, "count(DISTINCT {c}) AS n_unique").format(table="orders"))
def _(t):
    return C.profile_nunique(t("orders"))


@query("profile_nulls", _each(("doc_id", "n_chars", "quality", "toxic"), "count(*) FILTER ({c} IS NULL) AS n_nulls").format(table=_LABELLED))
def _(t):
    return C.profile_nulls(labelled(t))


@query("profile_shape", "SELECT count(*) AS n_rows, 6::BIGINT AS n_columns FROM orders")
def _(t):
    return C.profile_shape(t("orders"))


@query("describe_numeric", " UNION ALL ".join(f"SELECT '{c}' AS column_name, count({c})::DOUBLE AS n, round(avg({c}), 6) AS mean, round(stddev_samp({c}), 6) AS std, min({c})::DOUBLE AS min, round(quantile_cont({c}, 0.25), 6) AS q25, round(quantile_cont({c}, 0.5), 6) AS q50, round(quantile_cont({c}, 0.75), 6) AS q75, max({c})::DOUBLE AS max FROM lineitem" for c in ("l_quantity", "l_extendedprice")))
def _(t):
    out = C.describe_numeric(t("lineitem"), ["l_quantity", "l_extendedprice"])
    return out.select(*[F.round(c, 6).alias(c) if c in ("mean", "std", "q25", "q50", "q75") else F.col(c) for c in out.columns])


@query("describe_object", " UNION ALL ".join(f"(SELECT '{c}' AS column_name, (SELECT count({c}) FROM orders) AS n, (SELECT count(DISTINCT {c}) FROM orders) AS n_unique, {c} AS top, count(*) AS freq FROM orders GROUP BY {c} ORDER BY count(*) DESC, {c} LIMIT 1)" for c in ("o_orderstatus", "o_orderpriority")))
def _(t):
    return C.describe_object(t("orders"), ["o_orderstatus", "o_orderpriority"])


@query("schema_info", " UNION ALL ".join(f"SELECT '{c}' AS column_name, count({c}) AS n_present, '{k}' AS type FROM orders" for c, k in zip(_ORDERS, ("bigint", "bigint", "string", "double", "timestamp_ntz", "string"), strict=True)))
def _(t):
    return C.schema_info(t("orders"))


@query("split_numeric_columns", " UNION ALL ".join(f"SELECT '{c}' AS column_name, count({c}) AS n_present, {str(n).lower()} AS is_numeric FROM orders" for c, n in zip(_ORDERS, (True, True, False, True, False, False), strict=True)))
def _(t):
    return C.split_numeric(t("orders"))


@query("list_non_numeric", "SELECT DISTINCT 'p_brand' AS column_name, p_brand AS value FROM part UNION ALL SELECT DISTINCT 'p_type', p_type FROM part")
def _(t):
    return C.non_numeric_values(t("part"), ["p_brand", "p_type"])


@query("blank_to_null", "SELECT p_partkey, CASE WHEN p_size > 25 THEN p_brand END AS p_brand FROM part")
def _(t):
    blanked = t("part").select("p_partkey", F.when(F.col("p_size") > 25, F.col("p_brand")).otherwise(F.lit(" ")).alias("p_brand"))
    return C.blank_to_null(blanked, ["p_brand"])


@query("to_numeric_coerce", "SELECT p_partkey, try_cast(CASE WHEN p_size > 25 THEN p_brand ELSE p_size::VARCHAR END AS DOUBLE) AS code FROM part")
def _(t):
    mixed = t("part").select("p_partkey", F.when(F.col("p_size") > 25, F.col("p_brand")).otherwise(F.col("p_size").cast("string")).alias("code"))
    return C.to_numeric(mixed, ["code"])


@query("fill_constant", f"SELECT doc_id, coalesce(quality, 0) AS quality, coalesce(toxic, 0) AS toxic FROM {_LABELLED}")
def _(t):
    return labelled(t).na.fill(0, ["quality", "toxic"]).select("doc_id", "quality", "toxic")


_PRICED = "(SELECT o_orderkey, CASE WHEN o_orderkey % 3 > 0 THEN o_totalprice END AS price, CASE WHEN o_orderkey % 4 > 0 THEN o_orderstatus END AS status FROM orders)"


def priced(t):
    return t("orders").select("o_orderkey", F.expr("case when o_orderkey % 3 > 0 then o_totalprice end").alias("price"), F.expr("case when o_orderkey % 4 > 0 then o_orderstatus end").alias("status"))


@query("fill_median", f"SELECT o_orderkey, round(coalesce(price, (SELECT median(price) FROM {_PRICED})), 6) AS price FROM {_PRICED}")
def _(t):
    return C.fill_median(priced(t), ["price"]).select("o_orderkey", F.round("price", 6).alias("price"))


@query("fill_mode", f"SELECT o_orderkey, coalesce(status, (SELECT status FROM {_PRICED} WHERE status IS NOT NULL GROUP BY status ORDER BY count(*) DESC, status LIMIT 1)) AS status FROM {_PRICED}")
def _(t):
    return C.fill_mode(priced(t), ["status"]).select("o_orderkey", "status")


@query("impute_mean", f"SELECT o_orderkey, round(coalesce(price, (SELECT avg(price) FROM {_PRICED})), 4) AS price FROM {_PRICED}")
def _(t):
    return C.fill_mean(priced(t), ["price"]).select("o_orderkey", F.round("price", 4).alias("price"))


# --- features


@query("one_hot", "SELECT o_orderkey, " + ", ".join(f"(o_orderstatus = '{v}')::INT AS \"o_orderstatus_{v}\"" for v in "FOP") + " FROM orders")
def _(t):
    return E.one_hot(t("orders").select("o_orderkey", "o_orderstatus"), "o_orderstatus", ["F", "O", "P"])


def _customer(f, *a, **k):
    return lambda t: f(t("customer").select("c_custkey", "c_acctbal"), "c_acctbal", *a, **k)


@query("standardize", "SELECT c_custkey, round((c_acctbal - avg(c_acctbal) OVER ()) / stddev_pop(c_acctbal) OVER (), 6) AS c_acctbal FROM customer")
def _(t):
    return _customer(E.standardize)(t).select("c_custkey", F.round("c_acctbal", 6).alias("c_acctbal"))


@query("normalize_minmax", "SELECT c_custkey, round((c_acctbal - min(c_acctbal) OVER ()) / (max(c_acctbal) OVER () - min(c_acctbal) OVER ()), 6) AS c_acctbal FROM customer")
def _(t):
    return _customer(E.normalize_minmax)(t).select("c_custkey", F.round("c_acctbal", 6).alias("c_acctbal"))


@query("minmax_scale", "SELECT c_custkey, 0.0::DOUBLE AS c_acctbal FROM customer")
def _(t):
    return E.normalize_minmax(t("customer").select("c_custkey", F.lit(5.0).alias("c_acctbal")), "c_acctbal", 0.0)


@query("binarize", "SELECT c_custkey, (c_acctbal > 5000)::INT AS c_acctbal FROM customer")
def _(t):
    return _customer(E.binarize, 5000)(t)


@query("discretize", "SELECT o_orderkey, (greatest(ceil((o_totalprice - min(o_totalprice) OVER ()) / ((max(o_totalprice) OVER () - min(o_totalprice) OVER ()) / 10)), 1) - 1)::INT AS o_totalprice FROM orders")
def _(t):
    return E.discretize(t("orders").select("o_orderkey", "o_totalprice"), "o_totalprice", 10)


@query("remove_outliers_iqr", "WITH q AS (SELECT quantile_cont(l_extendedprice, 0.25) AS a, quantile_cont(l_extendedprice, 0.75) AS b FROM lineitem) SELECT l_orderkey, l_linenumber, l_extendedprice FROM lineitem, q WHERE l_extendedprice > a - 0.3 * (b - a) AND l_extendedprice < b + 0.3 * (b - a)")
def _(t):
    return E.without_outliers(t("lineitem").select("l_orderkey", "l_linenumber", "l_extendedprice"), "l_extendedprice", 0.3)


@query("label_encode", "SELECT p_partkey, (dense_rank() OVER (ORDER BY p_brand) - 1)::INT AS code FROM part")
def _(t):
    return E.label_encode(t("part"), "p_brand", "code").select("p_partkey", "code")


@query("factorize", "WITH f AS (SELECT o_orderpriority, row_number() OVER (ORDER BY min(o_orderkey)) - 1 AS code FROM orders GROUP BY 1) SELECT o_orderkey, code::INT AS code FROM orders JOIN f USING (o_orderpriority)")
def _(t):
    return E.factorize(t("orders"), "o_orderpriority", "o_orderkey", "code").select("o_orderkey", "code")


@query("map_codes", "SELECT o_orderkey, CASE o_orderpriority WHEN '1-URGENT' THEN 5 WHEN '2-HIGH' THEN 4 END AS code FROM orders")
def _(t):
    return t("orders").select("o_orderkey", E.map_codes(F.col("o_orderpriority"), {"1-URGENT": 5, "2-HIGH": 4}).alias("code"))


@query("replace_codes", "SELECT o_orderkey, CASE o_orderpriority WHEN '1-URGENT' THEN 'A' WHEN '5-LOW' THEN 'F' ELSE o_orderpriority END AS grade FROM orders")
def _(t):
    return t("orders").select("o_orderkey", E.map_codes(F.col("o_orderpriority"), {"1-URGENT": "A", "5-LOW": "F"}, True).alias("grade"))


@query("bucket_answers", "SELECT l_orderkey, l_linenumber, CASE WHEN l_quantity IN (1, 2, 3) THEN 'few' WHEN l_quantity IN (48, 49, 50) THEN 'many' END AS answer FROM lineitem")
def _(t):
    return t("lineitem").select("l_orderkey", "l_linenumber", E.bucket_answers(F.col("l_quantity"), {"few": [1, 2, 3], "many": [48, 49, 50]}).alias("answer"))


@query("classify_in_set", "SELECT p_partkey, CASE WHEN p_type LIKE '%E%' THEN 'in' ELSE 'out' END AS kind FROM part")
def _(t):
    return t("part").select("p_partkey", F.when(F.col("p_type").contains("E"), "in").otherwise("out").alias("kind"))


@query("first_word", "SELECT p_partkey, split_part(p_type, ' ', 1) AS word FROM part")
def _(t):
    return t("part").select("p_partkey", F.split("p_type", " ")[0].alias("word"))


_FLAGS = "(SELECT *, CASE WHEN l_linenumber = 1 THEN 1 END AS f1, CASE WHEN l_quantity > 40 THEN 1 END AS f2, CASE WHEN l_returnflag = 'R' THEN 1 END AS f3, CASE WHEN l_tax > 0.05 THEN 1 END AS also FROM lineitem)"


@query("merge_multi_flag", f"SELECT l_orderkey, l_linenumber, CASE WHEN n > 1 OR (n = 1 AND also IS NOT NULL) THEN 7 WHEN f1 IS NOT NULL THEN 1 WHEN f2 IS NOT NULL THEN 2 WHEN f3 IS NOT NULL THEN 3 WHEN also IS NOT NULL THEN 6 END AS race FROM (SELECT *, (f1 IS NOT NULL)::INT + (f2 IS NOT NULL)::INT + (f3 IS NOT NULL)::INT AS n FROM {_FLAGS})")
def _(t):
    flags = {1: F.expr("case when l_linenumber = 1 then 1 end"), 2: F.expr("case when l_quantity > 40 then 1 end"), 3: F.expr("case when l_returnflag = 'R' then 1 end")}
    return t("lineitem").select("l_orderkey", "l_linenumber", E.merge_flags(flags, F.expr("case when l_tax > 0.05 then 1 end")).alias("race"))


@query("row_mean", "SELECT l_orderkey, l_linenumber, round((l_quantity + l_tax + l_discount) / 3, 6) AS mean FROM lineitem")
def _(t):
    return t("lineitem").select("l_orderkey", "l_linenumber", F.round(E.row_mean(F.col("l_quantity"), F.col("l_tax"), F.col("l_discount")), 6).alias("mean"))


@query("combine_semesters", "SELECT l_orderkey, l_linenumber, round(CASE WHEN l_linenumber % 2 = 0 THEN l_tax ELSE (l_tax + l_discount) / 2 END, 6) AS grade FROM lineitem")
def _(t):
    df = t("lineitem").select("l_orderkey", "l_linenumber", F.col("l_tax").alias("fall"), F.expr("case when l_linenumber % 2 = 1 then l_discount end").alias("spring"))
    return E.combine_pairs(df, {"grade": ["fall", "spring", "summer"]}).withColumn("grade", F.round("grade", 6))


@query("interactions", "SELECT l_orderkey, l_linenumber, l_quantity, l_tax, round(l_quantity * l_tax, 6) AS l_quantity_x_l_tax FROM lineitem")
def _(t):
    return E.interactions(t("lineitem").select("l_orderkey", "l_linenumber", "l_quantity", "l_tax"), ["l_quantity", "l_tax"]).withColumn("l_quantity_x_l_tax", F.round("l_quantity_x_l_tax", 6))


@query("pair_ratios", "SELECT l_orderkey, l_linenumber, round(l_extendedprice / (l_quantity + 1e-9), 4) AS ratio FROM lineitem")
def _(t):
    return E.pair_ratios(t("lineitem"), ["l_extendedprice", "l_quantity"]).select("l_orderkey", "l_linenumber", F.round("l_extendedprice_per_l_quantity", 4).alias("ratio"))


@query("within_tolerance", "SELECT round(avg((abs(l_quantity - l_linenumber * 8) / l_quantity < 0.1)::INT), 6) AS share FROM lineitem")
def _(t):
    return t("lineitem").agg(F.round(E.within_tolerance(F.col("l_quantity"), F.col("l_linenumber") * 8), 6).alias("share"))


@query("round_int", "SELECT o_orderkey, round_even(o_totalprice, 0)::INT AS price FROM orders")
def _(t):
    return t("orders").select("o_orderkey", F.bround("o_totalprice", 0).cast("int").alias("price"))


# --- dates


@query("date_as_int", "SELECT o_orderkey, (year(o_orderdate) * 10000 + month(o_orderdate) * 100 + day(o_orderdate))::INT AS d FROM orders")
def _(t):
    return t("orders").select("o_orderkey", D.date_as_int(F.col("o_orderdate")).alias("d"))


@query("date_format", "SELECT o_orderkey, strftime(o_orderdate, '%Y-%m-%d') AS d FROM orders")
def _(t):
    return t("orders").select("o_orderkey", F.date_format("o_orderdate", "yyyy-MM-dd").alias("d"))


@query("parse_ts_two_formats", "SELECT event_id, CASE WHEN event_id % 2 = 0 THEN ts ELSE date_trunc('second', ts) END AS ts FROM events")
def _(t):
    text = F.when(F.col("event_id") % 2 == 0, F.date_format("ts", "yyyy-MM-dd HH:mm:ss.SSSSSS")).otherwise(F.date_format("ts", "yyyy-MM-dd HH:mm:ss"))
    return t("events").select("event_id", D.parse_two_formats(text).cast("timestamp_ntz").alias("ts"))


@query("date_features", "WITH e AS (SELECT event_id, coalesce(CASE WHEN event_id % 5 > 0 THEN ts END, TIMESTAMP '1900-01-01') AS ts FROM events) SELECT event_id, year(ts)::INT AS year, month(ts)::INT AS month, day(ts)::INT AS day, (isodow(ts) - 1)::INT AS dayofweek, (isodow(ts) >= 6)::INT AS is_weekend FROM e")
def _(t):
    e = t("events").select("event_id", F.expr("case when event_id % 5 > 0 then ts end").alias("ts"))
    return D.date_features(e, "ts").drop("ts")


@query("date_cyclic", "SELECT event_id, round(sin(month(ts) * (2 * pi() / 12)), 6) + 0.0 AS month_sin, round(cos(month(ts) * (2 * pi() / 12)), 6) + 0.0 AS month_cos, round(sin(year(ts) * 2 * pi()), 6) + 0.0 AS year_sin, round(cos(year(ts) * 2 * pi()), 6) + 0.0 AS year_cos FROM events")
def _(t):
    out = D.date_cyclic(t("events").select("event_id", "ts"), "ts").drop("ts")
    return out.select("event_id", *[(F.col(c) + 0.0).alias(c) for c in out.columns if c != "event_id"])


@query("year_month", "SELECT o_orderkey, strftime(o_orderdate, '%Y-%m') AS ym FROM orders")
def _(t):
    return t("orders").select("o_orderkey", F.date_format("o_orderdate", "yyyy-MM").alias("ym"))


@query("month_period", "SELECT event_id, date_trunc('month', ts)::DATE AS month FROM events")
def _(t):
    return t("events").select("event_id", F.trunc("ts", "month").alias("month"))


@query("days_since_start", "SELECT event_id, date_diff('day', (SELECT min(ts) FROM events), ts)::INT AS days FROM events")
def _(t):
    return D.days_since_start(t("events").select("event_id", "ts"), "ts").select("event_id", "days")

