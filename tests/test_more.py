"""Names, phrases, directions, decoders, scores, training sets, ingestion, index, store, tools and commands."""

import io
import json
import random

import pytest
from pyspark.sql import functions as F

from chronoloom import __main__ as commands
from chronoloom.api import Graph
from chronoloom.functions import dates, names, text
from chronoloom.model import AlreadyExists, InvalidInput, NotFound
from chronoloom.operators import decode, evaluate, extract, graph, ingest, patterns, relations, resolve, scoring, search, training
from chronoloom.operators.index import SearchIndex, fused
from chronoloom.sources import fixtures
from chronoloom.sources.store import GraphStore
from chronoloom.tools import Tools, answer

SAID = "id int, name string, entity_type string, start int, end int"


def one(spark, column):
    return spark.range(1).select(column.alias("x")).first()["x"]


@pytest.mark.parametrize(
    ("name", "want"),
    [("@stripe/stripe-node@3.0", "Stripe"), ("Elasticsearch 8.x", "Elasticsearch"), ("Kubernetes v1.28", "Kubernetes"), ("user@host", "user@host"), ("Acme SDK", "Acme"), ("a CLI", "a CLI"), ("Node 18", "Node"), ("", "")],
)
def test_product_names(spark, name, want):
    assert one(spark, names.product_name(F.lit(name))) == want


def test_names_and_types(spark):
    cut = lambda x, known=(): one(spark, names.without_suffix(F.lit(x), known))
    assert cut("Redis service") == "Redis" and cut("redis service") == "redis service" and cut("redis service", ("Redis",)) == "redis" and cut("Saga Pattern") == "Saga Pattern" and cut(" model") == " model"
    kind = lambda x, **more: one(spark, names.retyped(F.lit(x), F.lit("Thing"), **more))
    assert [kind(x) for x in ("Redis", "teams", "slack", "PayService", "x")] == ["Database", "Metric", "Constraint", "Service", "Thing"] and kind("Redis", vocabulary={"Redis": "Mine"}) == "Mine"
    assert one(spark, names.mapped_relation(F.lit("Was rewritten in"))) == "replaced" and one(spark, names.mapped_relation(F.lit("likes"))) is None
    m = spark.createDataFrame([([("Redis service", "Database", 3, 16, 0.9)],)], f"m {extract.MENTIONS}").select(names.canonical(F.col("m")).alias("m")).first()["m"][0]
    assert (m["text"], m["start"], m["end"]) == ("Redis", 3, 8)


def test_text_pieces(spark):
    assert [tuple(x) for x in one(spark, text.spans_of(F.lit("aaa.a"), F.lit("aa")))] == [(0, 2), (1, 3)] and one(spark, text.spans_of(F.lit("a.b"), F.lit(""))) == [] and one(spark, text.spans_of(F.lit("a.b a\\Eb"), F.lit("a\\Eb")))[0]["start"] == 4
    assert [tuple(x) for x in one(spark, text.words_with_offsets(F.lit(" a  bc\n")))] == [("a", 1, 2), ("bc", 4, 6)] and one(spark, text.words_with_offsets(F.lit(None).cast("string"))) == []
    assert json.loads(one(spark, text.metadata(F.create_map(F.lit("a"), F.lit("1")), F.array(F.lit("x"), F.lit("y"))))) == {"a": "1", "tags": ["x", "y"]}
    assert one(spark, text.metadata(F.create_map().cast("map<string,string>"), F.array().cast("array<string>"))) is None
    assert one(spark, text.sentences(F.lit("1 one. 2 two. 3"))) == ["1 one.", "2 two.", "3"]
    assert one(spark, text.verified(F.lit("x"), F.lit("PENDING"))) and not one(spark, text.verified(F.lit("x"), F.lit("ab")))
    assert one(spark, evaluate.marked(F.lit("Redis Cluster"), F.lit("Redis Cluster"), F.lit("Redis"))) is None
    shares = one(spark, text.softmax(F.array(F.lit(1000.0), F.lit(1000.0))))
    assert shares == [0.5, 0.5] and one(spark, text.filled("{a}-{b}", {"a": F.lit("x"), "b": F.lit(None)})) == "x-"


def test_dates_of_any_length(spark):
    rows = spark.createDataFrame([("123456 days ago for 1234567 weeks, 99999999999 days ago",)], "t string").withColumn("m", F.lit("2026-03-15").cast("timestamp"))
    got = dates.references(rows, "t", "m").collect()
    assert [(r["kind"], r["days"]) for r in got] == [("relative", -123456), ("relative", -300_000_000), ("duration", 1234567 * 7)]
    assert str(got[0]["start"]) == "1688-03-10" and got[1]["start"] is None


def test_dictionary_of_any_size(spark):
    words = spark.createDataFrame([("Redis", "Database"), ("Redis Cluster", "Infrastructure"), ("Ana", "Person"), ("...", "None")], "name string, entity_type string")
    texts = spark.createDataFrame([(1, "Rediska, Redis; Redis Cluster. Redis"), (2, None), (3, ""), (4, "no Ana's")], "id int, text string")
    got = sorted((r["id"], r["start"], r["end"], r["text"]) for r in extract.mentions_by_join(texts, words).collect())
    assert got == [(1, 9, 14, "Redis"), (1, 16, 29, "Redis Cluster"), (4, 3, 6, "Ana")]
    plain = extract.Dictionary({"Redis": "Database", "Redis Cluster": "Infrastructure", "Ana": "Person"}).scan("Rediska, Redis; Redis Cluster. Redis")
    assert [(m["start"], m["end"]) for m in plain] == [(9, 14), (16, 29)]


def test_local_chain(spark):
    rows = spark.createDataFrame([("The Redis service of Ana broke. She said PayService v2 is up.",), (None,)], "t string")
    got = [[(m["text"], m["entity_type"]) for m in r["m"]] for r in rows.select(extract.local_mentions(F.col("t"), {"Redis": "Other", "Ana": "Person"}).alias("m")).collect()]
    assert got == [[("Redis", "Database"), ("Ana", "Person"), ("Ana", "Person"), ("PayService", "Service")], []]


def test_similar_pairs_lose_nothing(spark):
    rng = random.Random(9)
    words = {"".join(rng.choice("abcde é1") for _ in range(rng.randint(1, 9))) for _ in range(120)} | {"postgresql", "postgres", "Postgre SQL", "martha", "marhta", "x"}
    df = spark.createDataFrame([(w, rng.choice(["A", "B"])) for w in sorted(words)], "name string, entity_type string")
    rows = [(r["name"], r["entity_type"]) for r in df.collect()]
    for least in (0.85, 0.7):
        want = {(a, b) for a, s in rows for b, t in rows if s == t and round(resolve.jaro_winkler(a.lower(), b.lower()), 9) >= least}
        assert {(r["name"], r["match"]) for r in resolve.similar_pairs(df, df, least).collect()} == want


def test_alias_with_two_owners(spark):
    known = spark.createDataFrame([("b", "PG"), ("a", "pg")], "canonical_id string, alias_name string")
    assert resolve.by_alias(spark.createDataFrame([("Pg",)], "name string"), known).first()["canonical_id"] == "a"


def _case(spark, said, *mentions):
    spots = [(1, n, t, said.index(n), said.index(n) + len(n)) for n, t in mentions]
    return spark.createDataFrame([(1, said)], "id int, text string"), spark.createDataFrame(spots, SAID)


def _triples(df):
    return sorted((r["head"], r["relation"], r["tail"]) for r in df.collect())


def test_phrase_patterns(spark):
    assert _triples(patterns.from_to(*_case(spark, "Moved from Solr. Then on to Vitess.", ("Solr", "Database"), ("Vitess", "Database")))) == []
    assert _triples(patterns.from_to(*_case(spark, "Ana moved from Java to Java 21.", ("Java", "Language"), ("Java 21", "Language")))) == []
    assert _triples(patterns.for_support(*_case(spark, "Portal is up for CQRS, no help.", ("Portal", "Service"), ("CQRS", "Pattern")))) == []
    assert _triples(patterns.chosen_over(*_case(spark, "Solr over the long run. Ana left.", ("Solr", "Database"), ("Ana", "Person")))) == []
    late = _case(spark, "Ana said that they will soon have replaced Solr.", ("Ana", "Person"), ("Solr", "Database"))
    assert _triples(patterns.person_replaced(*late)) == []
    none = spark.createDataFrame([], SAID)
    for made in (patterns.from_to, patterns.for_support, patterns.chosen_over, patterns.person_replaced):
        assert made(spark.createDataFrame([(1, None), (2, "")], "id int, text string"), none).count() == 0
    rows = spark.createDataFrame([(1, "a", "introduced", "b", 0.6), (1, "a", "replaced", "b", 0.5), (1, "b", "rejected", "a", 0.55), (1, "a", "chose", "z", 0.9)], "id int, head string, relation string, tail string, confidence double")
    assert _triples(patterns.without_conflicts(rows)) == [("a", "chose", "z"), ("a", "introduced", "b"), ("b", "rejected", "a")]


def test_relations_follow_cues(spark):
    found = relations.relations(*_case(spark, "We replaced Solr with Vitess.", ("Solr", "Database"), ("Vitess", "Database")), least=0.1)
    assert _triples(found.where("relation = 'replaced'")) == [("Vitess", "replaced", "Solr")]
    kinds = lambda said, *m: {r["relation"] for r in relations.relations(*_case(spark, said, *m), least=0.0).collect()}
    pay, redis, slow = ("Pay", "Service"), ("Redis", "Database"), ("p95", "Metric")
    assert "depends_on" in kinds("Pay uses Redis.", pay, redis) and "depends_on" not in kinds("We implement Pay using Redis.", pay, redis)
    assert "constrained_by" not in kinds("p95 is capped at 2. Pay ran.", slow, pay) and "caused" not in kinds("fix: Pay caused p95.", pay, slow) and "caused" in kinds("Pay caused p95.", pay, slow)


def test_decoders(spark):
    entities = spark.createDataFrame([(1, 0, "A", "Service"), (1, 1, "B", "Database")], "id int, position int, name string, entity_type string")
    texts = spark.createDataFrame([(1, "x", [9.0, -9.0, 8.0, 7.0])], "id int, text string, logits array<double>")
    assert _triples(decode.pair_relations(texts, entities, ("chose", "fixed"))) == [("A", "chose", "B"), ("B", "fixed", "A")]
    spans = spark.createDataFrame([(1, "a b", "X", 0, 3, 0.9), (1, "b", "X", 2, 3, 0.95), (1, "c", "X", 4, 5, 0.1)], "id int, text string, entity_type string, start int, end int, confidence double")
    assert sorted(r["text"] for r in decode.without_weaker(spans).collect()) == ["b", "c"]
    assert decode.best_engine([("model", None), ("rules", print)])[0] == "rules"
    row = spark.createDataFrame([([0.0, 5.0],), ([5.0, 0.0],), ([0.1, 0.0],), ([],)], "s array<double>").select(decode.classified(F.col("s"), ("none", "r")).alias("c")).collect()
    assert [r["c"]["relation"] if r["c"] else None for r in row] == ["r", None, None, None]


def _items(spark, rows):
    return spark.createDataFrame([(i, n, *r) for i, those in rows.items() for n, r in enumerate(those)], "id int, position int, head string, relation string, tail string")


def test_relation_scores_against_plain_matching(spark):
    rng = random.Random(4)
    draw = lambda: (rng.choice(["a", "ab", "b", "B "]), rng.choice(["r", "s"]), rng.choice(["a", "ab", "c"]))
    gold, given = ({i: [draw() for _ in range(rng.randint(0, 5))] for i in range(25)} for _ in range(2))
    episodes = spark.createDataFrame([(i,) for i in range(26)], "id int")
    got = {r["id"]: r for r in scoring.relation_scores(episodes, _items(spark, gold), _items(spark, given)).collect()}
    close = lambda a, b: a.lower().strip() in b.lower().strip() or b.lower().strip() in a.lower().strip()
    rules = {
        "strict": lambda p, g: tuple(x.lower() for x in p) == tuple(x.lower() for x in g), "directed": lambda p, g: p[1] == g[1] and close(p[0], g[0]) and close(p[2], g[2]),
        "pair": lambda p, g: close(p[0], g[0]) and close(p[2], g[2]) or close(p[0], g[2]) and close(p[2], g[0]),
    }
    for i in range(25):
        for name, fits in rules.items():
            used, hits = set(), 0
            for p in given[i]:
                for j, g in enumerate(gold[i]):
                    if j not in used and fits(p, g):
                        used.add(j)
                        hits += 1
                        break
            total = len(gold[i]) + len(given[i])
            assert got[i][name] == (1.0 if not total else round(2 * hits / total, 6)), (i, name)
    assert got[25]["strict"] == 1.0 and got[25]["n_gold"] == 0


def test_semantic_matching():
    near = [{"name": "a", "vector": [1.0, 0.0]}, {"name": "b", "vector": [0.9, 0.1]}]
    assert scoring.semantic_hits(near, [{"name": "x", "vector": [1.0, 0.1]}, {"name": "y", "vector": [0.0, 1.0]}]) == 1
    assert scoring.semantic_hits(near, [{"name": "B b", "vector": [0.0, 1.0]}, {"name": "z", "vector": [1.0, 0.0]}]) == 2 and scoring.semantic_hits([], near) == 0


def test_exact_scores_of_empty_groups(spark):
    empty = spark.createDataFrame([], "g int, x string")
    row = evaluate.f1_exact(empty, empty, "g", "x", spark.createDataFrame([(1,)], "g int")).first()
    assert (row["precision"], row["recall"], row["f1"], row["gold"]) == (1.0, 1.0, 1.0, 0)


def test_split_by_buckets_equals_one_window(spark, monkeypatch):
    rows = spark.range(500).select(F.col("id"), F.when(F.col("id") % 7 == 0, "b").when(F.col("id") == 1, None).otherwise("a").alias("label"))
    plain = {r["id"]: r["split"] for r in evaluate.stratified_split(rows, "label", "id").collect()}
    monkeypatch.setattr(evaluate, "BUCKET_ROWS", 10)
    assert {r["id"]: r["split"] for r in evaluate.stratified_split(rows, "label", "id").collect()} == plain and plain[1] == "val"
    assert sum(s == "val" for i, s in plain.items() if i % 7 and i != 1) == int(0.2 * sum(1 for i in plain if i % 7 and i != 1))


def test_training_set(spark):
    rows = [("t one " * 30 + "x", "a", "b", "r", "gold"), ("t one " * 30 + "y", "a", "b", "r", "paraphrase")] + [(f"n{i}", "a", "b", "none", "pair" if i % 2 else "hard") for i in range(8)]
    made = training.training_set(spark.createDataFrame(rows, "text string, head string, tail string, label string, kind string")).collect()
    assert sum(r["label"] == "r" for r in made) == 1 and sorted(r["kind"] for r in made if r["label"] == "none") == ["hard", "hard"] and {r["split"] for r in made} == {"val", "train"}
    empty = spark.createDataFrame([], "episode int, name string, entity_type string, position int")
    assert training.template_pairs(empty, ("{head} {tail}",), 5).count() == 0


def test_index_equals_scan_and_follows_changes(spark, tmp_path):
    rows = [(str(i), f"{w} of the {w} house {i}", None) for i, w in enumerate(["red", "blue", "red blue", "green", "of the"])] + [("x", None, None), ("y", "", "")]
    df = spark.createDataFrame(rows, "id string, content string, source string")
    index = SearchIndex.build(df, "id", ["content", "source"], str(tmp_path / "i"), 4)
    for q in ("red", "red OR blue", "house NOT blue", '"of the"', "gr*", "(red OR green) house", "nothing", '"the red"'):
        assert [tuple(r) for r in index.bm25(q).collect()] == [tuple(r) for r in search.bm25(df, "id", ["content", "source"], q).collect()], q
    index.add(spark.createDataFrame([("0", "grey", None), ("9", "red fox", None)], df.schema), "id", ["content", "source"])
    index.remove(spark.createDataFrame([("2",)], "id string"))
    now = spark.createDataFrame([r for r in rows if r[0] not in "02"] + [("0", "grey", None), ("9", "red fox", None)], df.schema)
    for q in ("red", "grey OR blue"):
        want = [tuple(r) for r in search.bm25(now, "id", ["content", "source"], q).collect()]
        assert [tuple(r) for r in index.bm25(q).collect()] == want == [tuple(r) for r in index.compact(str(tmp_path / f"c{q[:2]}")).bm25(q).collect()]
    plan = index.postings(search.parse("red"))._jdf.queryExecution().toString()
    assert "PartitionFilters: [isnotnull(part" in plan and "PushedFilters: [IsNotNull(term)" in plan
    episodes = now.withColumn("recorded_at", F.lit("2024-01-01").cast("timestamp"))
    vectors = spark.createDataFrame([("9", [1.0, 0.0]), ("gone", [1.0, 0.1]), ("1", [0.0, 1.0])], "id string, embedding array<float>")
    assert [r["id"] for r in fused(index, "red", vectors, [1.0, 0.0], episodes, 2).collect()] == ["9"]
    assert [r["id"] for r in fused(index, "why red?", vectors, [1.0, 0.0], episodes, 3).collect()] == ["9", "1"]
    with pytest.raises(search.QueryError):
        fused(index, "why red?", vectors, None, episodes, 2)


def test_nearest_of_odd_vectors(spark):
    rows = spark.createDataFrame([("a", [1.0, 0.0]), ("b", [1.0, 0.0]), ("c", [0.0, 1.0]), ("d", [1.0]), ("e", None), ("f", [0.0, 0.0])], "id string, v array<float>")
    got = search.similar_batch(rows, rows.where("id in ('a', 'd', 'e')"), "id", "v", 2, block=1).collect()
    assert sorted((r["query"], r["rank"], r["id"], r["score"]) for r in got) == [("a", 1, "b", 1.0), ("a", 2, "c", 0.0)]
    assert search.similar_batch(rows, rows.limit(0), "id", "v").count() == 0


def test_ingest_resolves_links_and_ends(spark, tmp_path):
    store = GraphStore.init(spark, str(tmp_path / "g"))
    first = spark.createDataFrame([("1", "Ana chose PostgreSQL. Postgres is fine.", "s")], "id string, content string, source string").withColumn("recorded_at", F.lit("2024-01-01").cast("timestamp"))
    said = spark.createDataFrame([("1", "Ana", "Person", 0, 3, 0), ("1", "PostgreSQL", "Database", 10, 20, 1), ("1", "Postgres", "Database", 22, 30, 2)], ingest.MENTIONS)
    told = spark.createDataFrame([("1", "Ana", "chose", "Postgres", 0.9, None), ("1", "Ana", "chose", "Nobody", 0.9, None)], ingest.RELATIONS)
    assert ingest.ingest(store, first, lambda _: (said, told)) == ingest.Counts(1, 2, 1, 1)
    assert sorted(r["name"] for r in store.table("entities").collect()) == ["Ana", "PostgreSQL"] and store.table("mentions").count() == 2
    assert [(r["alias_name"], round(r["similarity"], 2)) for r in store.table("aliases").collect()] == [("Postgres", 0.96)]
    again = ingest.ingest(store, first, lambda _: (said, told))
    assert again == ingest.Counts(0, 0, 0, 0)
    second = spark.createDataFrame([("2", "Ana left POSTGRES", None)], "id string, content string, source string").withColumn("recorded_at", F.lit("2024-01-01").cast("timestamp"))
    more = spark.createDataFrame([("2", "Ana", "Person", 0, 3, 0), ("2", "POSTGRES", "Service", 9, 17, 1)], ingest.MENTIONS)
    hints = spark.createDataFrame([("2", "Ana chose PostgreSQL")], "episode string, hint string")
    counts = ingest.ingest(store, second, lambda _: (more, told.limit(0)), hints=hints)
    assert counts == ingest.Counts(1, 0, 0, 0, 1)  # the alias decides for any type
    edge = store.table("edges").first()
    assert edge["fact"] == "Ana chose Postgres" and edge["valid_until"] is not None and edge["episode_id"] == "1"
    assert store.orphans().count() == 0


def test_new_names_resolve_one_after_the_other(spark, tmp_path):
    store = GraphStore.init(spark, str(tmp_path / "g"))
    words = ["alpha service", "alpha services", "alpha servicess", "alphabet service", "beta"]
    said = spark.createDataFrame([(f"{i:02d}", w, "T", 0, 1, 0) for i, w in enumerate(words)], ingest.MENTIONS)
    got = {r["name"]: r["match"] for r in ingest.resolved(said, store.table("entities"), store.table("aliases"), 0.95).collect()}
    heads, want = [], {}
    for w in words:
        best = max(((resolve.jaro_winkler(w, h), h) for h in heads), default=(0, None))
        want[w] = best[1] if best[0] >= 0.95 else w
        heads += [w] if want[w] == w else []
    assert got == want and len(set(want.values())) < len(words)


def test_answers_of_a_model(spark, tmp_path):
    store = GraphStore.init(spark, str(tmp_path / "g"))
    raw = '{"entities": [{"id": "e1", "name": "Ana", "type": "Person"}, {"id": "e2", "name": "Redis", "type": "Tool"}], "relations": [{"head": "e1", "relation": "uses", "tail": "e2"}, {"head": "e1", "relation": "uses", "tail": "e9"}], "invalidates": ["Ana uses Solr"], "suggestions": [{"kind": "relation", "name": "uses"}]}'
    row = spark.createDataFrame([("1", "x")], "id string, content string")
    got = ingest.ingest_answers(store, row, lambda e: e.withColumn("raw", F.lit(raw)), str(tmp_path / "log"))
    assert got == ingest.Counts(1, 2, 1, 1, 0, 1)
    local = spark.createDataFrame([("1", "Ana")], "episode string, name string"), spark.createDataFrame([("1", "Ana", "uses", "Redis")], "episode string, head string, relation string, tail string")
    more = spark.createDataFrame([("1", "ANA"), ("1", "Solr")], "episode string, name string"), spark.createDataFrame([("1", "redis", "is", "ana"), ("1", "Ana", "uses", "Solr")], "episode string, head string, relation string, tail string")
    mentions, rels = ingest.with_answers(*local, *more)
    assert sorted(r["name"] for r in mentions.collect()) == ["Ana", "Solr"] and rels.count() == 2


def test_store_versions_and_vectors(spark, tmp_path):
    store = GraphStore.in_memory(spark)
    assert store.version() == 2 and store.migrate() == 2 and spark.read.json(f"{store.folder}/version").count() == 2
    store.append("episodes", spark.createDataFrame([("1", "x"), ("2", "y")], "id string, content string"))
    store.store_embeddings(spark.createDataFrame([("1", [1.0]), ("9", [2.0])], "id string, embedding array<float>"))
    store.store_embeddings(spark.createDataFrame([("1", [3.0])], "id string, embedding array<float>"))
    assert [(r["id"], list(r["embedding"])) for r in store.embeddings().collect()] == [("1", [3.0])] and store.size() > 0 and store.readable_size().split()[1] in ("B", "KB", "MB")
    store.drop()
    with pytest.raises(NotFound):
        GraphStore.open(spark, store.folder)


def test_graph_object_tools_and_commands(spark, tmp_path):
    def read(episodes):
        told = episodes.select(F.col("id").alias("episode"), F.split("content", " ").alias("w"))
        said = told.select("episode", F.posexplode(F.array(F.get("w", F.lit(0)), F.get("w", F.lit(2)))).alias("position", "name")).select("episode", "name", F.lit("Thing").alias("entity_type"), F.lit(0).alias("start"), F.lit(1).alias("end"), "position")
        return said, told.select("episode", F.get("w", F.lit(0)).alias("head"), F.get("w", F.lit(1)).alias("relation"), F.get("w", F.lit(2)).alias("tail"), F.lit(1.0).alias("confidence"), F.lit(None).cast("string").alias("fact"))

    g = Graph.init(spark, str(tmp_path / "g"), extract=read, embed=lambda t: [float("Solr" in t), 1.0])
    key, counts = g.add_episode("Ana uses Redis", "chat", ["x"], {"k": "v"})
    g.add_episode("Bob uses Solr")
    assert counts.entities == 2 and json.loads(g.episode(key).first()["metadata"]) == {"k": "v", "tags": ["x"]}
    assert [r["content"] for r in g.search("redis", 1).collect()] == ["Ana uses Redis"] and g.search("redis", 5, source="none").count() == 0
    assert g.precedents("Solr", 1).first()["content"] == "Bob uses Solr"
    nodes, edges = g.traverse(["Ana"], 9)
    assert [(r["name"], r["depth"]) for r in nodes.collect()] == [("Ana", 0), ("Redis", 1)] and edges.count() == 1
    with pytest.raises(NotFound):
        g.traverse(["Nobody"])
    edge = edges.first()["id"]
    g.invalidate_edge(edge)
    with pytest.raises(NotFound):
        g.invalidate_edge(edge)
    assert g.add_entity_deduped("Rediss", "Thing")[1] and not g.add_entity_deduped("Kafka", "Thing")[1]
    with pytest.raises(InvalidInput):
        g.add_answered_episode("x")
    with pytest.raises(AlreadyExists):
        Graph.init(spark, str(tmp_path / "g"))
    t = Tools(g)
    ask = lambda method, **params: json.loads(answer(t, json.dumps({"jsonrpc": "2.0", "id": 1, "method": method, "params": params})))
    call = lambda name, **arguments: json.loads(ask("tools/call", name=name, arguments=arguments)["result"]["content"][0]["text"])
    assert len(ask("tools/list")["result"]["tools"]) == 8 and ask("initialize")["result"]["protocolVersion"]
    assert call("list_entities", limit=2, offset=1)["count"] == 2 and call("export_graph", include_episodes=True)["episode_count"] == 2
    assert call("get_decision", id=key)["episode"]["source"] == "chat" and call("traverse_batch", entity_names=["Bob", "Nobody"])["entities"] and call("traverse_batch", entity_names=[])["edges"] == []
    assert "error" in call("traverse", entity_name="Nobody") and "error" in call("nothing") and "error" in call("search")
    assert ask("tools/call")["error"]["code"] == -32602 and ask("other")["error"]["code"] == -32601
    assert json.loads(answer(t, "{"))["error"]["code"] == -32700 and answer(t, '{"method": "notifications/initialized"}') is None
    for line, want in ((["log", "Eve uses Vim", "-t", "a, b"], "2 entities"), (["query", "who uses Vim?"], "Eve uses Vim"), (["entities", "list"], "Vim"), (["decisions", "list", "-l", "1"], "Eve"), (["stats"], "3 episodes"), (["decisions", "show", key], "chat")):
        out = io.StringIO()
        commands.run(g, commands.parser().parse_args(line), out)
        assert want in out.getvalue(), line


def test_fixtures(spark, tmp_path):
    (tmp_path / "f.json").write_text(json.dumps([{"text": "Ana x", "expected_entities": [{"name": "Ana", "type": "Person", "span_start": 0, "span_end": 3}, {"name": "Bob", "entity_type": "Person", "span_start": 0, "span_end": 3}], "source": "commit"}, {"text": "y"}]))
    rows = fixtures.labelled_episodes(spark, str(tmp_path / "f.json"))
    assert sorted((r["text"], r["domain"], len(r["entities"])) for r in rows.collect()) == [("Ana x", "commit", 2), ("y", "tech", 0)] and [r["name"] for r in fixtures.span_errors(rows).collect()] == ["Bob"]
    (tmp_path / "run.log").write_text("x\n── Episode 1/50 ──\nEntities extracted: []\n── Episode 2/50 ──\nEntities extracted: ['A', 'B']\nRelations extracted: [('A', 'r', 'B')]\n")
    got = fixtures.log_episodes(fixtures.read_logs(spark, str(tmp_path / "run.log"))).orderBy("episode").collect()
    assert [(r["episode"], r["entities"], len(r["relations"])) for r in got] == [(1, [], 0), (2, ["A", "B"], 1)]
    fixtures.write_json(rows, str(tmp_path / "out"))
    assert spark.read.json(str(tmp_path / "out")).count() == 2


def test_traversal_reads_only_what_a_level_meets(spark):
    edges = spark.createDataFrame([(str(i), str(i), str(i + 1), "r", None) for i in range(6)] + [("s", "9", "9", "r", None)], "id string, source_id string, target_id string, relation string, valid_until timestamp")
    seeds = spark.createDataFrame([("0",), ("9",)], "id string")
    assert sorted((r["id"], r["depth"]) for r in graph.reach(edges, seeds, 9).collect()) == [(str(i), i) for i in range(6)] + [("9", 0)]
