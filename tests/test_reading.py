"""Extraction, relations, questions, envelopes, configuration and training-set generators on small fixtures."""

import pytest
from pyspark.sql import functions as F

from chronoloom.operators import envelope, evaluate, extract, questions, relations
from chronoloom.sources import config

NAMES = {"Redis": "Database", "Redis Cluster": "Infrastructure", "Ana": "Person"}


def test_dictionary_takes_the_first_whole_word():
    found = extract.Dictionary(NAMES).scan("Rediska, Redis; Redis Cluster. Redis")
    assert [(m["text"], m["start"], m["end"]) for m in found] == [("Redis", 9, 14), ("Redis Cluster", 16, 29)]
    assert extract.Dictionary(NAMES).scan("") == []


def test_dictionary_is_bounded(monkeypatch):
    monkeypatch.setattr(extract, "LARGEST_DICTIONARY", 2)
    with pytest.raises(ValueError):
        extract.Dictionary(NAMES)


def test_names_by_ending():
    found = extract.scan_endings("The AuthService and RateLimiter, Service, authService, AuthService", {"x"})
    assert [(m["text"], m["entity_type"]) for m in found] == [("AuthService", "Service"), ("RateLimiter", "Component")]


def test_overlaps():
    m = [extract._mention("a b", "X", 0, 3, 0.9), extract._mention("b", "X", 2, 3, 0.9), extract._mention("c", "X", 4, 5, 0.1)]
    assert [x["text"] for x in extract.without_overlaps(m)] == ["b", "c"]
    assert [x["text"] for x in extract.without_overlaps(m, frozenset({"a b"}))] == ["a b", "c"]


def test_pronouns_take_the_nearest_that_fits():
    text = "Ana runs Redis. She likes it. They"
    found = extract.Dictionary(NAMES).scan(text)
    assert [(x["text"], x["start"]) for x in extract.resolve_pronouns(text, found)] == [("Ana", 16), ("Redis", 26), ("Redis", 30)]
    assert extract.resolve_pronouns("She", []) == []


def test_chain_on_null_empty_and_repeated_rows(spark):
    rows = spark.createDataFrame([(1, None), (2, ""), (3, "Ana uses Redis. She"), (3, "Ana uses Redis. She")], "id int, text string")
    got = rows.select("id", extract.mentions(F.col("text"), NAMES).alias("m")).orderBy("id").collect()
    assert [[x["text"] for x in r["m"]] for r in got] == [[], [], ["Ana", "Redis", "Ana"], ["Ana", "Redis", "Ana"]]


def test_relations(spark):
    texts = spark.createDataFrame([(1, "Ana chose Redis. It was fast."), (2, None), (3, "Nothing."), (4, "Redis was picked, said Ana.")], "id int, text string")
    said = [(1, "Ana", "Person", 0), (1, "Redis", "Database", 10), (4, "Redis", "Database", 0), (4, "Ana", "Person", 23)]
    got = relations.relations(texts, spark.createDataFrame(said, "id int, name string, entity_type string, start int"), least=0.3).orderBy("id").collect()
    assert [(r["id"], r["head"], r["relation"], r["tail"]) for r in got] == [(1, "Ana", "chose", "Redis"), (4, "Ana", "chose", "Redis")]
    # the middle of the keyword is at 6: distances 6 and 4
    assert got[0]["confidence"] == round(0.65 / (1 + 5 / 50) * 1.4, 6)


def test_relations_need_a_near_sentence(spark):
    texts = spark.createDataFrame([(1, "Ana chose. Rain fell. Rain fell. Redis ran.")], "id int, text string")
    said = spark.createDataFrame([(1, "Ana", "Person", 0), (1, "Redis", "Database", 33)], "id int, name string, entity_type string, start int")
    assert relations.relations(texts, said, least=0.0).count() == 0


@pytest.fixture(scope="module")
def people(spark):
    rows = [("1", "Redis", "Database"), ("2", "Redis Cluster", "Infrastructure"), ("3", "Ana Maria", "Person")]
    return spark.createDataFrame(rows, "id string, name string, entity_type string").withColumn("summary", F.lit(None).cast("string")).withColumn("created_at", F.lit("2024-01-01").cast("timestamp"))


def test_link(spark, people):
    asked = ["Who chose Redis Cluster?", "what is redis", "the maria", "why?", "", None]
    q = spark.createDataFrame(list(enumerate(asked)), "qid int, question string")
    got = [(r["entity_id"], r["verb"]) for r in questions.link(q, people).orderBy("qid").collect()]
    assert got[:5] == [("2", "chose"), ("1", ""), ("3", ""), (None, ""), (None, "")] and got[5][0] is None


def test_complex_questions(spark):
    q = spark.createDataFrame([("who came first", True), ("a, b, c", True), ("who uses redis", False)], "q string, yes boolean")
    assert q.where(questions.is_complex(F.col("q")) != F.col("yes")).count() == 0


def test_dispatch(spark, people):
    edges = spark.createDataFrame([("e", "3", "1", "chose"), ("f", "3", "2", "rejected")], "id string, source_id string, target_id string, relation string").withColumn("valid_until", F.lit(None).cast("timestamp"))
    names = lambda op: sorted(r["name"] for r in questions.dispatch(op, edges, people).collect())
    assert names({"op": "traverse", "head": "Ana Maria"}) == ["Redis", "Redis Cluster"]
    assert names({"op": "lookup", "head": "Ana Maria", "relation": "chose"}) == ["Redis"]
    assert names({"op": "lookup", "head": ""}) == []
    assert names({"op": "list", "filters": {"entity_type": "Person"}}) == ["Ana Maria"]
    with pytest.raises(ValueError):
        questions.dispatch({"op": "drop"}, edges, people)


def test_envelope(spark, tmp_path):
    raw = ['noise {"entities": [{"id": "e1", "name": "A"}, {"id": "e1", "name": "B"}], "relations": [{"head": "e1", "relation": "r", "tail": "e2"}], "suggestions": [{"kind": "relation", "name": "n"}]}', "none", None]
    rows = spark.createDataFrame(list(enumerate(raw)), "k int, raw string").select("k", envelope.parse(F.col("raw")).alias("e"))
    assert [tuple(r) for r in envelope.named_relations(rows, "k", "e").collect()] == [(0, "A", "r", "e2", 1.0, False)]
    folder = str(tmp_path / "log")
    envelope.log_suggestions(rows, "k", "e", folder)
    envelope.log_suggestions(rows, "k", "e", folder)
    assert [r["suggestion"]["name"] for r in envelope.read_log(spark, folder).collect()] == ["n", "n"]


def test_schema_round_trip(spark, tmp_path):
    made = config.default_schema()
    assert config.parse_schema(config.to_toml(made)).relations == made.relations
    flat = config.parse_schema('[entities]\nA = "a"\nB = "b"\n[relations]\nr = "says"\n')
    assert flat.allowed(spark).count() == 4 and flat.settings["extraction"]["confidence_threshold"] == 0.5
    for bad in ("= 1", "[entities]\n", '[entities]\nA = "a"\n[relations.r]\nhead = ["Z"]\n'):
        with pytest.raises(config.SchemaError):
            config.parse_schema(bad)
    assert config.cached_schema(str(tmp_path)).name == "default"


def test_generators(spark):
    p = spark.createDataFrame([("a", "b", "r"), ("b", "a", "r"), ("c", "d", "s")], "head string, tail string, relation string")
    assert [tuple(r) for r in evaluate.reversed_negatives(p).collect()] == [("d", "c", "none")]
    assert {r["relation"] for r in evaluate.near_misses(p.where("relation = 's'"), ("r", "s", "t")).collect()} <= {"r", "t"}
    assert evaluate.augmented(p, "relation", 3).groupBy("relation").count().where("count < 3").count() == 0
    none = p.withColumn("relation", F.lit("none")).withColumn("priority", F.lit(0))
    assert evaluate.capped(none, "relation", "head").count() == 3
    assert evaluate.capped(none.unionByName(p.where("head = 'c'").withColumn("priority", F.lit(0))), "relation", "head").where("relation = 'none'").count() == 2


def test_greedy_f1_query_compares_whole_texts(spark, tmp_path):
    from chronoloom import queries

    turns = {
        1: [("user", "the very same start, one"), ("assistant", "the very same start, two")],  # equal up to character 12 only
        2: [("user", "short"), ("assistant", "a text that only holds SHORT behind character 12"), ("assistant", "short")],
        3: [("user", "Where is the store?"), ("user", "store"), ("assistant", "store"), ("assistant", "where is the store? ")],
        4: [("user", "alone")],
        5: [("assistant", "alone")],
    }
    rows = [(c, i, role, text) for c, said in turns.items() for i, (role, text) in enumerate(said)]
    spark.createDataFrame(rows, "conv_id long, turn int, role string, text string").write.parquet(str(tmp_path / "conversations.parquet"))
    want = {}
    for c, said in turns.items():
        gold, given, hits = [t.strip().lower() for r, t in said if r == "user"], [t.strip().lower() for r, t in said if r != "user"], 0
        taken = set()
        for x in given:
            for i, g in enumerate(gold):
                if i not in taken and (x in g or g in x):
                    taken.add(i)
                    hits += 1
                    break
        want[c] = (hits, round(2 * hits / (len(gold) + len(given)), 6))
    assert {r["conv_id"]: (r["hits"], r["f1"]) for r in queries.f1_greedy(spark, str(tmp_path)).collect()} == want
    assert want[1] == (0, 0.0) and want[2][0] == 1
