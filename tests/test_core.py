import datetime as dt
import json
import os

import pytest

import __spark_entry__ as entry_module
from chronoloom import queries
from chronoloom.functions import dates, names, text
from chronoloom.operators import evaluate, graph, resolve, search
from chronoloom.sources.store import AlreadyExists, GraphStore, NotFound
from chronoloom.streaming.ingest import ingest_stream
from pyspark.sql import functions as F

DATA = "/root/testdata/sf0.001"
EDGE = "id string, source_id string, target_id string, relation string, valid_from timestamp, valid_until timestamp"


def day(n):
    return dt.datetime(2024, 1, 1) + dt.timedelta(days=n)


def test_query_parser():
    assert search.parse("a b").kind == "and"
    assert search.parse("a OR b c").parts[1].kind == "and"
    assert search.parse("a NOT b").kind == "not"
    assert search.parse('"a b"').words == ("a", "b")
    for bad in ("why Postgres?", "", '"open', "(a", "a)", "OR a"):
        with pytest.raises(search.QueryError):
            search.parse(bad)


def test_interval_is_half_open(spark):
    e = spark.createDataFrame([("e", "a", "b", "r", day(-30), day(-10))], EDGE)
    found = [graph.as_of(e, str(day(n))).count() for n in (-40, -30, -20, -10, -5)]
    assert found == [0, 1, 1, 0, 0]


def test_walk_keeps_depths_and_reach_does_not(spark):
    e = spark.createDataFrame([(str(i), a, b, "r", None, None) for i, (a, b) in enumerate([("a", "b"), ("b", "c"), ("c", "a")])], EDGE)
    seed = spark.createDataFrame([("a",)], "id string")
    assert graph.walk_levels(e, seed, 2).count() == 1 + 2 + 3
    assert sorted(map(tuple, graph.reach(e, seed, 2).collect())) == [("a", 0), ("b", 1), ("c", 1)]
    assert graph.reach(e, spark.createDataFrame([], "id string"), 2).count() == 0


def test_invalidate_counts_repeated_ids_once(spark):
    e = spark.createDataFrame([("x", "a", "b", "r", None, None), ("y", "a", "c", "r", None, day(1))], EDGE)
    out = graph.invalidate(e, spark.createDataFrame([("x",), ("x",), ("y",)], "id string"), str(day(5)))
    assert {r["id"]: r["valid_until"] for r in out.collect()} == {"x": day(5), "y": day(1)}


def test_hints_choose_the_fact_with_most_words(spark):
    hints = spark.createDataFrame([("1", "Alice chose Postgres")], "episode string, hint string")
    facts = spark.createDataFrame([("1", "f1", "Bob chose Redis"), ("1", "f2", "Alice chose Postgres for billing")], "episode string, id string, fact string")
    assert [r["id"] for r in graph.hint_matches(hints, facts).collect()] == ["f2"]


def test_jaro_winkler():
    assert resolve.jaro_winkler("martha", "marhta") == pytest.approx(0.961111, abs=1e-6)
    assert resolve.jaro_winkler("postgresql", "postgres") > 0.85 > resolve.jaro_winkler("postgresql", "redis")
    assert resolve.jaro_winkler("", "a") == 0


def test_dates(spark):
    rows = spark.createDataFrame([("on 2026-02-30 and 2026-03-11, 2026-04; March 11, 2026, 11 March 2026, March 2026; yesterday, 2 weeks ago, last month; Q2 2026 FY2025 FY25 FY24; for 3 weeks, over 2 months",)], "t string").withColumn("m", F.lit("2026-03-15").cast("timestamp"))
    got = [(r["kind"], str(r["start"]), r["days"], r["months"]) for r in dates.references(rows, "t", "m").collect()]
    assert got[:5] == [("date", d, None, None) for d in ("2026-03-11", "2026-04-01", "2026-03-11", "2026-03-11", "2026-03-01")]
    assert [g[1] for g in got if g[0] == "relative"] == ["2026-03-14", "2026-03-01", "2026-02-13"]
    assert [g[1] for g in got if g[0] == "range"] == ["2026-04-01", "2025-01-01", "2024-01-01"]
    assert [g[2:] for g in got if g[0] == "duration"] == [(21, None), (None, 2)]


def test_text_functions(spark):
    row = spark.range(1).select(
        text.sanitize(F.lit("auth-service: why?")).alias("s"), text.strip_interrogatives(F.lit("Who is the owner")).alias("q"), text.ngrams(F.array(F.lit("a"), F.lit("b")), 3).alias("n"),
        text.json_object(F.lit('<think>{}</think> ```json {"a": 1} ```')).alias("j"), text.garbage_id(F.lit("e12")).alias("g"), text.strip_article(F.lit("The API")).alias("a"),
        names.product_name(F.lit("@scope/pg@1.2"), {"pg": "PostgreSQL"}).alias("p"), names.without_suffix(F.lit("Redis service")).alias("x"), evaluate.marked(F.lit("A uses B"), F.lit("A"), F.lit("B")).alias("m"),
    ).first()
    assert row["s"] == "auth service why" and row["q"] == "owner" and row["n"] == ["a", "b", "a b"]
    assert json.loads(row["j"]) == {"a": 1} and row["g"] and row["a"] == "API" and row["p"] == "PostgreSQL" and row["x"] == "Redis"
    assert row["m"] == "[E1]A[/E1] uses [E2]B[/E2]"


def test_cosine_of_odd_vectors(spark):
    rows = spark.createDataFrame([([1.0, 0.0], [0.0, 1.0]), ([1.0], [1.0, 0.0]), ([], []), ([0.0], [1.0]), ([2.0], [3.0])], "a array<float>, b array<float>")
    assert [r[0] for r in rows.select(search.cosine(F.col("a"), F.col("b"))).collect()] == [0.0, 0.0, 0.0, 0.0, 1.0]


def test_store(spark, tmp_path):
    folder = str(tmp_path / "store")
    with pytest.raises(NotFound):
        GraphStore.open(spark, folder)
    store = GraphStore.init(spark, folder)
    with pytest.raises(AlreadyExists):
        GraphStore.init(spark, folder)
    store.append("episodes", spark.createDataFrame([("1", "x", None, day(0)), ("2", "y", "unknown", day(1))], "id string, content string, source string, recorded_at timestamp"))
    link = spark.createDataFrame([("1", "e", 5, 6), ("1", "e", 2, 3)], "episode_id string, entity_id string, span_start int, span_end int")
    store.link(link)
    store.link(link)
    assert [r["span_start"] for r in store.table("mentions").collect()] == [2]
    assert [tuple(r) for r in store.sources().collect()] == [("unknown", 1), ("unknown", 1)]
    assert [r["id"] for r in store.episodes(1).collect()] == ["2"] and store.stats()["episodes"] == 2


def test_stream_adds_each_episode_once(spark, tmp_path):
    store = GraphStore.open_or_create(spark, str(tmp_path / "store"))
    os.makedirs(tmp_path / "in")
    for name in ("a", "b"):
        (tmp_path / "in" / f"{name}.json").write_text('{"id": "1", "content": "x", "recorded_at": "2024-01-01T00:00:00Z"}\n')
        ingest_stream(store, str(tmp_path / "in"), str(tmp_path / "check")).awaitTermination(60)
    assert store.table("episodes").count() == 1


@pytest.mark.parametrize("name", ["fts_or", "fts_phrase", "rrf_fused", "edges_as_of", "negative_pairs", "review_candidates"])
def test_queries_have_rows(spark, name):
    assert queries.QUERIES[name](spark, DATA).limit(1).count() == 1


def test_entry(spark):
    assert entry_module.entry(spark).count() > 0
    assert set(entry_module.oracle_sql()) <= set(entry_module.queries())
