"""Costly steps are done once, and without shuffles of their copies."""

import uuid

import numpy as np
import pytest
from pyspark.sql import functions as F

from fieldglass.operators import clusters, density, search, topics
from fieldglass.plans import mining, relational
from fieldglass.streaming import streams

SF = "/root/testdata/sf0.001"


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def tables(spark):
    return lambda name: spark.read.parquet(f"{SF}/{name}.parquet")


def noted(df, folder):
    """df through a step that leaves a file for each batch it makes."""

    def run(batches):
        for batch in batches:
            if batch.num_rows:
                (folder / uuid.uuid4().hex).write_text("")
            yield batch

    return df.coalesce(1).mapInArrow(run, df.schema)


@pytest.mark.parametrize("use", [lambda df, p: clusters.density_cluster(df, "id", p, 2, 2), lambda df, p: clusters.communities(p, 2)])
def test_pairs_are_computed_once(spark, tmp_path, use):
    spark.sparkContext.setCheckpointDir(spark.conf.get("spark.checkpoint.dir"))
    pairs = noted(spark.createDataFrame([(1, 2), (2, 3), (5, 6)], "a long, b long"), tmp_path)
    assert use(spark.createDataFrame([(i,) for i in range(8)], "id long"), pairs).count() >= 5
    assert len(list(tmp_path.iterdir())) == 1


def test_similarity_join_shuffles_no_vectors(spark):
    rng = np.random.default_rng(3)
    df = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(rng.normal(size=(50, 4)))], "id long, v array<double>").repartition(3)
    found = clusters.similar_pairs_exact(df, "id", "v", 0.9)
    assert "Exchange" not in plan(found)
    odd = df.unionAll(spark.createDataFrame([(90, [float("nan"), 1.0, 1.0, 1.0]), (91, [0.0] * 4), (None, [1.0, 0.0, 0.0, 0.0])], df.schema))
    assert sorted(map(tuple, clusters.similar_pairs_exact(odd, "id", "v", 0.9).collect())) == sorted(map(tuple, found.collect()))


def test_search_finds_the_tree_once(spark, monkeypatch):
    calls, real = [], search.reachability_tree
    monkeypatch.setattr(search, "reachability_tree", lambda *a: calls.append(a[1:]) or real(*a))
    rng = np.random.default_rng(4)
    x = np.concatenate([rng.normal(size=(30, 3)) * 0.1 + c for c in ([0, 0, 0], [4, 0, 0], [0, 5, 0])])
    docs = spark.createDataFrame([(i, "word", v.tolist()) for i, v in enumerate(x)], "id long, text string, v array<double>")
    log = search.topic_search(docs, "id", "text", "v", [(2, 0.1, 3), (2, 0.3, 3)], {"a": ["word"]}, 1)
    assert log.count() == 2 and calls == [("id", "point", 3)]
    alone = density.hdbscan(docs, "id", "v", 0.1, 3)
    shared = density.hdbscan(docs, "id", "v", 0.1, 3, density.reachability_tree(docs, "id", "v", 3))
    assert sorted(map(tuple, alone.collect())) == sorted(map(tuple, shared.collect()))


def test_rows_of_models_are_stored(spark):
    """Each pass of a model reads numbers, and a fold drawn by row is the same in each pass."""
    for df in (mining._features(tables(spark)), mining._counted(tables(spark))):
        assert not any(x in plan(df) for x in ("Join", "Exchange", "regexp", "UDF"))


def test_equal_lines_meet_where_orders_do(spark):
    assert "l_linenumber" not in "".join(x for x in plan(relational.R.queries["merge_pipeline"](spark, SF)).splitlines() if "hashpartitioning" in x)


def test_first_rows_of_values_that_share_a_state(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(streams, "BUCKETS", 2)
    rows = [(i, f"k{i % 7}" if i % 7 else None, f"2024-01-0{1 + i % 3} 00:00:{i:02d}") for i in range(40)]
    df = spark.createDataFrame(rows, "id long, k string, ts string").withColumn("ts", F.to_timestamp("ts"))
    df.write.parquet(str(tmp_path / "in"))
    streams.closing_event(df, "ts").write.mode("append").parquet(str(tmp_path / "in"))
    found = streams.drained(streams.keep_first(streams.event_stream(spark, str(tmp_path / "in"), df.schema), ["k"], "ts", "id", "1 day", "5 days"))
    want, last = set(), {}
    for r in sorted(df.collect(), key=lambda r: (r["ts"], r["id"])):
        if r["k"] not in last or (r["ts"] - last[r["k"]]).total_seconds() > 86400:
            last[r["k"]] = r["ts"]
            want.add(r["id"])
    assert {r["id"] for r in found.collect()} == want and len(want) > 7


def test_rare_and_frequent_words_weigh_the_same(spark, monkeypatch):
    """Facts of frequent words go to all tasks, those of rare ones come by a shuffle."""
    docs = spark.createDataFrame([(i, i % 2, " ".join(["the", "of", f"word{'abc'[i % 3]}", "rare" * (i == 5), "Paris is. We like Paris"])) for i in range(12)], "id long, topic long, text string")
    names = spark.createDataFrame([("paris",), ("rare",), ("zzz",)], "word string")
    uses = [lambda: topics.tfidf(docs, "id", "text"), lambda: topics.representatives(docs, "topic", "id", "text", 3), lambda: topics.sentences_with_names(docs, "id", "text", names)]
    rounded = lambda df: sorted(tuple(round(v, 9) if isinstance(v, float) else v for v in r) for r in df.collect())
    want = [rounded(use()) for use in uses]
    monkeypatch.setattr(topics, "FEW_WORDS", 2)
    assert [rounded(use()) for use in uses] == want
    facts = spark.createDataFrame([("the", 9), ("of", 8), ("a", 1)], "term string, n int")
    assert "BroadcastHashJoin" in plan(topics.with_facts(docs.select(F.substring("text", 1, 3).alias("term")), facts, ["term"], "n"))
