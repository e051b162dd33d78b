"""Further queries over the driver's tables: names, phrases, decoders, scores, training sets and ingestion.

Input that the tables lack is made by one template a query, the same in Spark and in SQL; the templates vary by row.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import model
from .functions import names, text
from .operators import decode, direction, evaluate, extract, graph, ingest, patterns, relations, scoring, training
from .operators.index import fused
from .plans.stored import kept
from .queries import _bm25_sql, _index, _term, query
from .sources import fixtures
from .sources.store import GraphStore

_E, _N, _D = model.EPISODES_SQL, model.ENTITIES_SQL, model.EDGES_SQL


def _list(items) -> str:
    return "[" + ", ".join("'" + x.replace("'", "''") + "'" for x in items) + "]"


def _cases(column: str, n: int, variants: list[str]) -> str:
    """SQL that chooses among ``variants`` by ``column`` modulo ``n``."""
    return "CASE " + " ".join(f"WHEN {column} % {n} = {i} THEN {v}" for i, v in enumerate(variants)) + " END"


def _case(column: str, n: int, variants: list) -> Column:
    out = F
    for i, v in enumerate(variants):
        out = out.when(F.col(column) % n == i, v)
    return out


# full text over all columns, and edges


@query(_bm25_sql({"a": _term("src1"), "b": _term("fr")}, "a > 0 OR b > 0", ["a", "b"], "episodes", "episodes AS (SELECT CAST(doc_id AS VARCHAR) AS id, concat_ws(' ', text, source, '{\"lang\":\"' || lang || '\",\"n_chars\":' || n_chars || '}') AS content FROM documents)", "content"))
def fts_episode_fields(spark, d):
    return _index(spark, d, "episodes").bm25("src1 OR fr")


@query(_bm25_sql({"a": "len(list_filter(range(1, len(w)), lambda i: w[i] = 's' AND w[i + 1] = '1'))", "b": _term("supplies")}, "a > 0 AND b > 0", ["a", "b"], "e", f"{_D}, e AS (SELECT id, source_id || ' ' || relation || ' ' || target_id || ' ' || relation AS content FROM edges)", "content"))
def fts_edges(spark, d):
    return _index(spark, d, "edges").bm25('"s 1" supplies')


@query(f"WITH e AS (SELECT CAST(doc_id AS VARCHAR) AS id, source FROM documents), p AS ({_bm25_sql({'a': _term('with')}, 'a > 0', ['a'], 'episodes', _E, 'content').replace('LIMIT 10', '')}) SELECT p.id, score, source FROM p JOIN e ON e.id = p.id WHERE source = 'src1' ORDER BY score DESC, p.id LIMIT 5")
def search_by_source(spark, d):
    return fused(_index(spark, d, "content"), "with", None, None, model.episodes(spark, d), 5, "src1").select("id", "score", "source")


# names


_NAMED = ["p_name || ' service'", "'@scope/pg@2.' || p_partkey", "'Redis v' || p_partkey || '.x'", "upper(p_name) || ' pattern'", "'saga pattern'", "'Kafka Client'", "p_name"]
_PRODUCT = "coalesce(map_extract(MAP {k}, lower(b))[1], CASE WHEN regexp_matches(b, ' (SDK|sdk|CLI|cli|client|Client)$') AND length(b) > length(regexp_extract(b, ' (SDK|sdk|CLI|cli|client|Client)$')) + 2 THEN regexp_replace(b, ' (SDK|sdk|CLI|cli|client|Client)$', '') ELSE b END)"
_PACKAGES = "{" + ", ".join(f"'{k}': '{v}'" for k, v in names.PACKAGES.items()) + "}"
_ENDING = "(" + "|".join(s for s in names.SUFFIXES) + ")$"


def _part_names(spark, d) -> DataFrame:
    key, name = F.col("p_partkey").cast("string"), F.col("p_name")
    made = [F.concat(name, F.lit(" service")), F.concat(F.lit("@scope/pg@2."), key), F.concat(F.lit("Redis v"), key, F.lit(".x")), F.concat(F.upper(name), F.lit(" pattern")), F.lit("saga pattern"), F.lit("Kafka Client"), name]
    return model.read(spark, d, "part").select("p_partkey", _case("p_partkey", 7, made).alias("name"))


@query(f"WITH n AS (SELECT p_partkey, {_cases('p_partkey', 7, _NAMED)} AS name FROM part), b AS (SELECT p_partkey, name, regexp_replace(regexp_replace(regexp_replace(name, '^@[^/]*/', ''), '^([^@]*)@[0-9v].*$', '\\1'), ' v?[0-9][^ ]*$', '') AS b FROM n), c AS (SELECT p_partkey, {_PRODUCT.format(k=_PACKAGES)} AS c FROM b) SELECT p_partkey, CASE WHEN list_contains({_list(x.lower() for x in names.PRESERVED)}, lower(c)) THEN c WHEN regexp_matches(lower(c), '{_ENDING}') AND regexp_matches(c, '^\\p{{Lu}}') THEN substr(c, 1, length(c) - length(regexp_extract(lower(c), '{_ENDING}'))) ELSE c END AS name FROM c")
def canonical_names(spark, d):
    rows = _part_names(spark, d)
    one = F.array(F.struct(F.col("name").alias("text"), F.lit("Component").alias("entity_type"), F.lit(0).alias("start"), F.length("name").alias("end"), F.lit(0.9).alias("confidence")))
    return rows.select("p_partkey", F.get(names.canonical(one), F.lit(0))["text"].alias("name"))


_TYPED = ["'Redis'", "'Go'", "'SLA'", "p_name || 'Service'", "p_partkey || 'ms'", "'p95 of ' || p_name", "'compliance of ' || p_name", "p_name", "'CDN'"]


@query(f"WITH n AS (SELECT p_partkey, {_cases('p_partkey', 9, _TYPED)} AS name FROM part) SELECT p_partkey, CASE {' '.join(f'WHEN list_contains({_list(v)}, name) THEN {chr(39)}{k}{chr(39)}' for k, v in names.KNOWN_TYPES.items())} WHEN regexp_matches(name, '(Service|Provider)$') THEN 'Service' WHEN regexp_matches(lower(name), '({'|'.join(names.METRIC_UNITS)})$') OR regexp_matches(lower(name), '{'|'.join(names.METRIC_TERMS)}') THEN 'Metric' WHEN regexp_matches(lower(name), '{'|'.join(names.CONSTRAINT_TERMS)}') THEN 'Constraint' ELSE 'Part' END AS entity_type FROM n")
def retyped_names(spark, d):
    key, name = F.col("p_partkey").cast("string"), F.col("p_name")
    made = [F.lit("Redis"), F.lit("Go"), F.lit("SLA"), F.concat(name, F.lit("Service")), F.concat(key, F.lit("ms")), F.concat(F.lit("p95 of "), name), F.concat(F.lit("compliance of "), name), name, F.lit("CDN")]
    rows = model.read(spark, d, "part").select("p_partkey", _case("p_partkey", 9, made).alias("name"))
    return rows.select("p_partkey", names.retyped(F.col("name"), F.lit("Part")).alias("entity_type"))


_FREE = ["'was migrated to'", "'uses library'", "'ROUTES TRAFFIC TO'", "'is forbidden'", "'knows'", "'led to'", "'has constraint'"]


@query(f"WITH n AS (SELECT p_partkey, replace(upper({_cases('p_partkey', 7, _FREE)}), ' ', '_') AS u FROM part) SELECT p_partkey, CASE {' '.join(f'WHEN regexp_matches(u, {chr(39)}{p}{chr(39)}) THEN {chr(39)}{r}{chr(39)}' for p, r in names.FREE_RELATIONS)} END AS relation FROM n")
def mapped_relations(spark, d):
    rows = model.read(spark, d, "part").select("p_partkey", _case("p_partkey", 7, [F.lit(x.strip("'")) for x in _FREE]).alias("r"))
    return rows.select("p_partkey", names.mapped_relation(F.col("r")).alias("relation"))


@query("SELECT c_custkey, CASE WHEN c_custkey % 4 = 3 THEN 'Nobody' ELSE c_name END AS name FROM customer")
def answer_names(spark, d):
    name = F.col("c_name")
    said = _case("c_custkey", 4, [F.concat(F.lit("The "), name), F.concat(name, F.lit(" API")), F.concat(name, F.lit(" platform")), F.lit("the Nobody system")])
    texts = _case("c_custkey", 4, [F.concat(F.lit("by "), name), F.concat(F.lit("of "), F.lower(name)), F.concat(name, F.lit(" platform")), F.lit("the nobody system")])
    return model.read(spark, d, "customer").select("c_custkey", names.answer_name(said, texts).alias("name"))


# text


@query("SELECT n_nationkey, CASE n_nationkey % 3 WHEN 0 THEN '{\"k\":\"' || n_name || '\",\"tags\":[\"' || n_name || '\",\"x\"]}' WHEN 1 THEN '{\"tags\":[\"' || n_name || '\",\"x\"]}' END AS metadata FROM nation")
def episode_metadata(spark, d):
    tags = F.when(F.col("n_nationkey") % 3 == 2, F.array().cast("array<string>")).otherwise(text.tag_list(F.concat("n_name", F.lit(" ,  x"))))
    pairs = F.when(F.col("n_nationkey") % 3 == 0, F.create_map(F.lit("k"), F.col("n_name"))).otherwise(F.create_map().cast("map<string,string>"))
    return model.read(spark, d, "nation").select("n_nationkey", text.metadata(pairs, tags).alias("metadata"))


@query("SELECT o_orderkey, CASE WHEN o_orderkey % 3 = 0 THEN TIMESTAMP '2000-01-01' ELSE o_orderdate END AS moment FROM orders")
def parsed_times(spark, d):
    said = F.when(F.col("o_orderkey") % 3 == 0, F.lit("some day")).otherwise(F.date_format("o_orderdate", "yyyy-MM-dd'T'HH:mm:ss'Z'"))
    return model.read(spark, d, "orders").select("o_orderkey", text.parsed_time(said, F.lit("2000-01-01").cast("timestamp")).alias("moment"))


@query("WITH w AS (SELECT doc_id, regexp_extract_all(coalesce(text, ''), '[^\\x20\\x09-\\x0D]+') AS w FROM documents) SELECT doc_id, CAST(len(w) AS INTEGER) AS n, md5(array_to_string(w, ' ')) AS words FROM w")
def word_offsets(spark, d):
    rows = model.read(spark, d, "documents").select("doc_id", "text", text.words_with_offsets(F.col("text")).alias("w"))
    cut = F.transform("w", lambda x: F.substring(F.col("text"), x["start"] + 1, x["end"] - x["start"]))
    return rows.select("doc_id", F.size("w").alias("n"), F.md5(F.array_join(cut, " ")).alias("words"))


@query("SELECT doc_id, CAST(len(list_filter(range(1, length(text)), lambda i: substr(text, i, 2) = 'th')) AS INTEGER) AS n FROM documents")
def name_places(spark, d):
    return model.read(spark, d, "documents").select("doc_id", F.size(text.spans_of(F.col("text"), F.lit("th"))).alias("n"))


@query("SELECT c_custkey, CASE c_custkey % 3 WHEN 0 THEN c_name || ' uses A1 here.' WHEN 1 THEN c_name || ' is late. Then A1 came.' ELSE 'No name. Nothing.' END AS context FROM customer")
def pair_contexts(spark, d):
    n = F.col("c_name")
    said = _case("c_custkey", 3, [F.concat(F.lit("First one. "), n, F.lit(" uses A1 here. Last one.")), F.concat(F.lit("First. "), n, F.lit(" is late. Then A1 came. End.")), F.lit("No name. Nothing.")])
    return model.read(spark, d, "customer").select("c_custkey", text.pair_context(said, n, F.lit("a1")).alias("context"))


@query("SELECT c_custkey, CASE c_custkey % 4 WHEN 0 THEN '[E1]' || c_name || '[/E1] uses [E2]Redis[/E2]; Redis' WHEN 1 THEN '[E2]Redis[/E2] Cluster of Redis by [E1]' || c_name || '[/E1]' WHEN 2 THEN 'the [E1]Redis Cluster[/E1] and [E2]Redis[/E2]' END AS marked FROM customer")
def marked_pairs(spark, d):
    n = F.col("c_name")
    said = _case("c_custkey", 4, [F.concat(n, F.lit(" uses Redis; Redis")), F.concat(F.lit("Redis Cluster of Redis by "), n), F.lit("the Redis Cluster and Redis"), F.concat(n, F.lit(" alone"))])
    head = F.when(F.col("c_custkey") % 4 == 2, F.lit("Redis Cluster")).otherwise(n)
    return model.read(spark, d, "customer").select("c_custkey", evaluate.marked(said, head, F.lit("Redis")).alias("marked"))


@query("WITH s AS (SELECT vec_id, list_transform(range(1, 6), lambda i: exp(CAST(embedding[i] AS DOUBLE) - list_max(list_transform(range(1, 6), lambda j: CAST(embedding[j] AS DOUBLE))))) AS e FROM embeddings) SELECT vec_id, round(e[1] / list_sum(e), 6) AS first, round(list_max(e) / list_sum(e), 6) AS most FROM s")
def class_shares(spark, d):
    shares = text.softmax(F.transform(F.slice("embedding", 1, 5), lambda x: x.cast("double")))
    return model.read(spark, d, "embeddings").select("vec_id", F.round(F.get(shares, F.lit(0)), 6).alias("first"), F.round(F.array_max(shares), 6).alias("most"))


@query("SELECT s_suppkey, 'ask <PRIVATE_0> or <PRIVATE_1>, again <PRIVATE_0>' AS hidden, 'ask s' || s_suppkey || '@x.org or AKIA' || lpad(CAST(s_suppkey AS VARCHAR), 16, '0') || ', again s' || s_suppkey || '@x.org' AS shown FROM supplier")
def hidden_values(spark, d):
    key = F.col("s_suppkey").cast("string")
    mail = F.concat(F.lit("s"), key, F.lit("@x.org"))
    said = F.concat(F.lit("ask "), mail, F.lit(" or AKIA"), F.lpad(key, 16, "0"), F.lit(", again "), mail)
    rows = model.read(spark, d, "supplier").select("s_suppkey", text.pseudonymized(said).alias("p"))
    back = F.array_join(F.transform(F.split("p.text", "(?=<)|(?<=>)"), lambda x: text.rehydrated(x, F.col("p.hidden"))), "")
    return rows.select("s_suppkey", F.col("p.text").alias("hidden"), back.alias("shown"))


@query("SELECT doc_id, left(sha256(coalesce(text, '')), 8) AS short, CASE WHEN length(text) > 50 THEN left(text, 47) || '...' ELSE text END AS line, doc_id % 2 = 0 AS verified FROM documents")
def rendered_rows(spark, d):
    body = F.coalesce("text", F.lit(""))
    given = F.when(F.col("doc_id") % 2 == 0, F.sha2(body, 256)).otherwise(F.lit("0"))
    return model.read(spark, d, "documents").select("doc_id", names.short_id(F.sha2(body, 256)).alias("short"), text.shortened(F.col("text"), 50).alias("line"), text.verified(body, given).alias("verified"))


# graph


def _dated_entities(spark, d) -> DataFrame:
    return model.entities(spark, d).withColumn("created_at", F.lit("2024-01-01").cast("timestamp"))


_NEAR = f"{_D}, {_N}, near AS (SELECT source_id AS a, target_id AS b FROM edges WHERE valid_until IS NULL UNION SELECT target_id, source_id FROM edges WHERE valid_until IS NULL)"


@query(f"WITH {_NEAR}, l0 AS (SELECT min(id) AS id FROM entities WHERE name IN (SELECT n_name FROM nation WHERE n_nationkey IN (1, 2)) GROUP BY name), u AS (SELECT id, 0 AS depth FROM l0 UNION ALL SELECT b, 1 FROM l0 JOIN near ON a = id), m AS (SELECT id, min(depth) AS depth FROM u GROUP BY id) SELECT entities.id, name, entity_type, depth FROM m JOIN entities ON entities.id = m.id")
def traverse_named(spark, d):
    asked = [r["n_name"] for r in model.read(spark, d, "nation").where("n_nationkey in (1, 2)").select("n_name").distinct().collect()]
    nodes, _ = graph.traverse(model.stored_edges(spark, d), _dated_entities(spark, d), [*asked, "nobody at all"], 1, skip_unknown=True)
    return nodes.select("id", "name", "entity_type", "depth")


_TOUCH = "t AS (SELECT 'e' || s_suppkey AS episode, 's:' || s_suppkey AS entity_id FROM supplier WHERE s_suppkey <= 20)"


def _touched(spark, d):
    s = model.read(spark, d, "supplier").where("s_suppkey <= 20")
    return s.select(F.concat(F.lit("e"), F.col("s_suppkey").cast("string")).alias("episode"), F.concat(F.lit("s:"), F.col("s_suppkey").cast("string")).alias("entity_id"))


_FACTS = f"{_D}, {_N}, {_TOUCH}, f AS (SELECT DISTINCT episode, edges.id, a.name || ' ' || relation || ' ' || b.name AS fact FROM t JOIN edges ON valid_until IS NULL AND (source_id = entity_id OR target_id = entity_id) JOIN entities a ON a.id = source_id JOIN entities b ON b.id = target_id)"


@query(f"WITH {_FACTS} SELECT * FROM f")
def touching_edges(spark, d):
    e = model.stored_edges(spark, d).withColumn("fact", F.lit(None).cast("string"))
    return graph.candidate_edges(e, model.entities(spark, d), _touched(spark, d))


@query(f"WITH {_FACTS}, h AS (SELECT 'e' || s_suppkey AS episode, s_name || ' located_at somewhere' AS hint FROM supplier WHERE s_suppkey <= 20), w AS (SELECT episode, hint, list_filter(regexp_split_to_array(lower(hint), '\\W+'), lambda x: length(x) > 2) AS w FROM h), o AS (SELECT w.episode, hint, id, round(len(list_filter(w.w, lambda x: contains(lower(fact), x))) / greatest(len(w.w), 1), 6) AS overlap FROM w JOIN f ON f.episode = w.episode), r AS (SELECT *, row_number() OVER (PARTITION BY episode, hint ORDER BY overlap DESC, id) AS r FROM o WHERE overlap >= 0.5) SELECT DISTINCT id FROM r WHERE r = 1")
def edges_ended_by_hints(spark, d):
    e = model.stored_edges(spark, d).withColumn("fact", F.lit(None).cast("string"))
    s = model.read(spark, d, "supplier").where("s_suppkey <= 20")
    hints = s.select(F.concat(F.lit("e"), F.col("s_suppkey").cast("string")).alias("episode"), F.concat("s_name", F.lit(" located_at somewhere")).alias("hint"))
    _, ended = graph.invalidate_by_hints(e, model.entities(spark, d), _touched(spark, d), hints, "2024-01-01")
    return ended


@query(f"WITH {_D}, {_N}, n AS (SELECT id FROM entities WHERE entity_type = 'Nation' ORDER BY id LIMIT 7) SELECT id, relation FROM edges WHERE source_id IN (SELECT id FROM n) OR target_id IN (SELECT id FROM n)")
def export_of_type(spark, d):
    e = _dated_entities(spark, d)
    return graph.export(model.stored_edges(spark, d), e, 7, "Nation", [F.desc("created_at"), "id"]).select("id", "relation")


# phrases


def _phrases(spark, d) -> tuple[DataFrame, DataFrame]:
    """Customers' sentences of five kinds with the places of the names in them; lengths are those of the templates' parts."""
    name, n = F.col("c_name"), F.length("c_name")
    kinds = {
        0: (["", " moved the Portal from Solr to Vitess. End."], [(0, "Person"), ("Portal", 11, "Service"), ("Solr", 23, "Database"), ("Vitess", 31, "Database")]),
        1: (["", ". The Portal was upgraded for CQRS support."], [(0, "Person"), ("Portal", 6, "Service"), ("CQRS", 30, "Pattern")]),
        2: (["", " chose Redis over Solr. End."], [(0, "Person"), ("Redis", 7, "Database"), ("Solr", 18, "Database")]),
        3: (["", " replaced the old CQRS. End."], [(0, "Person"), ("CQRS", 18, "Pattern")]),
        4: (["", " said: from Java 11 to Java 21."], [(0, "Person"), ("Java 11", 12, "Language"), ("Java 21", 23, "Language")]),
    }
    rows = model.read(spark, d, "customer").select(F.col("c_custkey").alias("id"), "c_name")
    texts = rows.select("id", F.concat(name, _case("id", 5, [F.lit(kinds[k][0][1]) for k in range(5)])).alias("text"))
    said = []
    for k, (_, those) in kinds.items():
        parts = [F.struct(name.alias("name"), F.lit(those[0][1]).alias("entity_type"), F.lit(0).alias("start"), n.alias("end"))]
        parts += [F.struct(F.lit(w).alias("name"), F.lit(t).alias("entity_type"), (n + at).alias("start"), (n + at + len(w)).alias("end")) for w, at, t in those[1:]]
        said.append(rows.where(F.col("id") % 5 == k).select("id", F.explode(F.array(*parts)).alias("m")).select("id", "m.*"))
    mentions = said[0]
    for more in said[1:]:
        mentions = mentions.unionByName(more)
    return texts, mentions


@query("SELECT c_custkey AS id, 'Vitess' AS head, 'replaced' AS relation, 'Solr' AS tail, 0.75 AS confidence FROM customer WHERE c_custkey % 5 = 0 UNION ALL SELECT c_custkey, 'Portal', 'depends_on', 'Vitess', 0.6 FROM customer WHERE c_custkey % 5 = 0 UNION ALL SELECT c_custkey, 'Java 21', 'replaced', 'Java 11', 0.75 FROM customer WHERE c_custkey % 5 = 4")
def relations_from_to(spark, d):
    return patterns.from_to(*_phrases(spark, d)).drop("at")


@query("SELECT c_custkey AS id, 'Portal' AS head, 'introduced' AS relation, 'CQRS' AS tail, 0.7 AS confidence FROM customer WHERE c_custkey % 5 = 1")
def relations_for_support(spark, d):
    return patterns.for_support(*_phrases(spark, d)).drop("at")


@query("SELECT c_custkey AS id, c_name AS head, 'rejected' AS relation, 'Solr' AS tail, 0.6 AS confidence FROM customer WHERE c_custkey % 5 = 2")
def relations_chosen_over(spark, d):
    return patterns.chosen_over(*_phrases(spark, d)).drop("at")


@query("SELECT c_custkey AS id, c_name AS head, 'deprecated' AS relation, 'CQRS' AS tail, 0.55 AS confidence FROM customer WHERE c_custkey % 5 = 3")
def relations_person_replaced(spark, d):
    return patterns.person_replaced(*_phrases(spark, d)).drop("at")


@query("SELECT c_custkey AS id, 'Portal' AS head, 'depends_on' AS relation, 'Vitess' AS tail, 0.55 AS confidence FROM customer WHERE c_custkey % 5 = 0")
def relations_service_needs(spark, d):
    texts, mentions = _phrases(spark, d)
    return patterns.services_need_the_new(patterns.from_to(texts, mentions), mentions).drop("at")


@query("WITH r AS (SELECT c_custkey AS id, c_name, c_custkey % 5 AS k FROM customer) SELECT id, 'Vitess' AS head, 'replaced' AS relation, 'Solr' AS tail, 0.75 AS confidence FROM r WHERE k = 0 UNION ALL SELECT id, 'Portal', 'depends_on', 'Vitess', 0.6 FROM r WHERE k = 0 UNION ALL SELECT id, 'Portal', 'introduced', 'CQRS', 0.7 FROM r WHERE k = 1 UNION ALL SELECT id, c_name, 'rejected', 'Solr', 0.6 FROM r WHERE k = 2 UNION ALL SELECT id, c_name, 'deprecated', 'CQRS', 0.55 FROM r WHERE k = 3")
def relations_by_phrases(spark, d):
    return patterns.pattern_relations(*_phrases(spark, d))


_RIVALS = "c AS (SELECT c_custkey AS id, c_custkey % 6 AS k FROM customer)"


@query(f"WITH {_RIVALS} SELECT id, 'A' AS head, 'chose' AS relation, 'B' AS tail FROM c WHERE k = 0 UNION ALL SELECT id, 'B', 'introduced', 'T' FROM c WHERE k = 1 UNION ALL SELECT id, 'X', 'replaced', 'Y' FROM c WHERE k = 2 UNION ALL SELECT id, 'A', 'fixed', 'B' FROM c WHERE k = 5")
def filtered_relations(spark, d):
    made = {
        0: [("A", "chose", "B", 0.8), ("B", "rejected", "A", 0.7)], 1: [("A", "introduced", "T", 0.6), ("B", "introduced", "T", 0.7)], 2: [("X", "replaced", "Y", 0.6), ("Y", "caused", "Z", 0.9)],
        3: [("Java 21", "replaced", "Java 11", 0.9)], 4: [("fix", "caused", "B", 0.9), ("A", "chose", "Deploy", 0.9)], 5: [("A", "fixed", "B", 0.8), ("A", "caused", "B", 0.8 - 1e-9)],
    }
    rows = [F.array(*[F.struct(F.lit(h).alias("head"), F.lit(r).alias("relation"), F.lit(t).alias("tail"), F.lit(c).alias("confidence")) for h, r, t, c in made[k]]) for k in range(6)]
    c = model.read(spark, d, "customer").select(F.col("c_custkey").alias("id"))
    return patterns.filtered(c.select("id", F.explode(_case("id", 6, rows)).alias("r")).select("id", "r.*")).drop("confidence")


#: (relation, sentence with names A1 first and B2, types of both, whether A1 is the head), one for each rung of the ladder.
_TURNS = (
    ("replaced", "we went from a1 to b2", "Database", "Database", False), ("replaced", "to a1 it went, from b2", "Database", "Database", True), ("replaced", "a1 is down, fallback using b2", "Database", "Database", False),
    ("replaced", "a1 broke and we replaced it with b2", "Database", "Database", False), ("replaced", "replace a1 with b2", "Database", "Database", False), ("replaced", "a1 goes in favor of b2", "Database", "Database", False),
    ("replaced", "a1 replaced b2", "Database", "Database", True), ("deprecated", "a1 is deprecated, says b2", "Service", "Component", False), ("deprecated", "b2-based a1 was deprecated", "Service", "Pattern", True),
    ("depends_on", "a1 used by b2", "Service", "Service", False), ("depends_on", "a1 managed by b2", "Service", "Service", True), ("depends_on", "a1 via b2", "Pattern", "Pattern", True),
    ("depends_on", "a1-based b2", "Pattern", "Pattern", False), ("depends_on", "a1 runtime holds b2", "Pattern", "Pattern", False), ("depends_on", "a1 and b2", "Database", "Service", False), ("depends_on", "a1 and b2", "Pattern", "Service", False),
    ("constrained_by", "a1 and b2", "Constraint", "Service", False), ("caused", "a1 and b2", "Service", "Service", True),
)


@query("SELECT p_partkey, CASE (p_partkey % 18) " + " ".join(f"WHEN {i} THEN {str(t[4]).lower()}" for i, t in enumerate(_TURNS)) + " END AS first_is_head FROM part")
def relation_directions(spark, d):
    pick = lambda k: _case("p_partkey", 18, [F.lit(t[k]) for t in _TURNS])
    rows = model.read(spark, d, "part").select("p_partkey", pick(0).alias("relation"), pick(1).alias("s"), pick(2).alias("x"), pick(3).alias("y"))
    types = F.col("x"), F.col("y")
    pair = direction.Pair(F.col("s"), F.lit("A1"), F.lit("B2"), *types)
    r = F.col("relation")
    return rows.select("p_partkey", direction.first_is_head(r, pair, relations.allowed(r, *types), relations.allowed(r, *types[::-1])).alias("first_is_head"))


# decoders, over scores that follow from the keys


def _scored_texts(spark, d) -> tuple[DataFrame, DataFrame]:
    """A text a supplier with three entities, and logits for its six ordered pairs and two labels."""
    s = model.read(spark, d, "supplier").select(F.col("s_suppkey").alias("id"))
    logits = F.transform(F.sequence(F.lit(0), F.lit(11)), lambda i: ((F.col("id") * 7 + i * 5) % 13 - 6).cast("double"))
    texts = s.select("id", F.when(F.col("id") % 2 == 0, "it uses that").otherwise("nothing").alias("text"), logits.alias("logits"))
    kinds = [("A", "Service"), ("B", "Database"), ("C", "Person")]
    entities = s.select("id", F.posexplode(F.array(*[F.struct(F.lit(n).alias("name"), F.lit(t).alias("entity_type")) for n, t in kinds])).alias("position", "e")).select("id", "position", "e.*")
    return texts, entities


_LOGITS = "l AS (SELECT s_suppkey AS id, unnest(range(0, 12)) AS n FROM supplier), p AS (SELECT id, n, n // 2 AS pair, n % 2 AS label, 1 / (1 + exp(-((id * 7 + n * 5) % 13 - 6))) AS p FROM l), q AS (SELECT id, n, label, p, CASE pair WHEN 0 THEN 'A' WHEN 1 THEN 'A' WHEN 2 THEN 'B' WHEN 3 THEN 'B' ELSE 'C' END AS head, CASE pair WHEN 0 THEN 'B' WHEN 1 THEN 'C' WHEN 2 THEN 'A' WHEN 3 THEN 'C' WHEN 4 THEN 'A' ELSE 'B' END AS tail FROM p WHERE p >= 0.5)"


@query(f"WITH {_LOGITS}, o AS (SELECT * FROM q QUALIFY row_number() OVER (PARTITION BY id, least(head, tail), greatest(head, tail), label ORDER BY p DESC, n) = 1), b AS (SELECT id, n, head, tail, label, p * CASE WHEN label = 0 AND id % 2 = 0 THEN 1.3 ELSE 1 END AS p FROM o) SELECT id, head, CASE label WHEN 0 THEN 'depends_on' ELSE 'chose' END AS relation, tail, round(p, 6) AS confidence FROM b QUALIFY row_number() OVER (PARTITION BY id, head, tail ORDER BY p DESC, n) = 1")
def pair_scores(spark, d):
    return decode.pair_relations(*_scored_texts(spark, d), ("depends_on", "chose"))


@query("WITH m AS (SELECT s_suppkey AS id, unnest(range(0, 6)) AS k FROM supplier), e AS (SELECT id, k, (id + k) % 3 AS i, (id * 2 + k) % 4 AS j, (id + k) % 5 >= 1 AS mask, 1 / (1 + exp(-((id * 7 + k * 5) % 13 - 6))) AS p FROM m), t AS (SELECT id, k, p, ['A', 'B', 'C'][i + 1] AS h, ['A', 'B', 'C'][j + 1] AS t FROM e WHERE mask AND j < 3 AND i <> j AND p >= 0.5), v AS (SELECT id, k, p, CASE WHEN h = 'A' AND t = 'B' OR h = 'B' AND t = 'A' THEN 'A' END AS head, 'B' AS tail FROM t) SELECT id, head, 'depends_on' AS relation, tail, round(min_by(p, k), 6) AS confidence FROM v WHERE head IS NOT NULL GROUP BY id, head, tail")
def masked_pair_scores(spark, d):
    texts, entities = _scored_texts(spark, d)
    pairs = F.transform(F.sequence(F.lit(0), F.lit(5)), lambda k: F.struct(((F.col("id") + k) % 3).cast("int").alias("i"), ((F.col("id") * 2 + k) % 4).cast("int").alias("j"), F.when((F.col("id") + k) % 5 >= 1, 1.0).otherwise(0.0).alias("mask"), F.array(((F.col("id") * 7 + k * 5) % 13 - 6).cast("double")).alias("logits")))
    return decode.masked_relations(texts.select("id", pairs.alias("pairs")), entities, ("depends_on",))


@query("WITH h AS (SELECT s_suppkey AS id, unnest(['A depends on B', 'A uses B', 'C chose B', 'C selected B', 'C rejected B', 'C decided against B', 'C deprecated B', 'C introduced B']) AS hyp FROM supplier), s AS (SELECT id, hyp, (length(hyp) * 7 + id) % 11 / 10.0 AS e FROM h), r AS (SELECT id, CASE WHEN hyp LIKE 'A%' THEN 'A' ELSE 'C' END AS head, CASE WHEN hyp LIKE '%uses%' OR hyp LIKE '%depends%' THEN 'depends_on' WHEN hyp LIKE '%chose%' OR hyp LIKE '%selected%' THEN 'chose' WHEN hyp LIKE '%against%' OR hyp LIKE '%rejected%' THEN 'rejected' ELSE 'other' END AS relation, e FROM s), b AS (SELECT id, head, relation, max(e) AS confidence FROM r WHERE relation <> 'other' GROUP BY ALL HAVING max(e) >= 0.5) SELECT id, head, relation, 'B' AS tail, confidence FROM b QUALIFY row_number() OVER (PARTITION BY id, head ORDER BY confidence DESC, relation) = 1")
def entailed_relations(spark, d):
    _, entities = _scored_texts(spark, d)
    h = decode.hypotheses(entities).where("relation in ('depends_on', 'chose', 'rejected')")
    h = h.where("(head = 'A' and relation = 'depends_on' or head = 'C') and tail = 'B'")
    return decode.entailed(h.withColumn("entailment", ((F.length("hypothesis") * 7 + F.col("id")) % 11 / 10.0)))


_CLASSES = ("none", "depends_on", "replaced")


@query("WITH s AS (SELECT s_suppkey AS id, [(s_suppkey % 5) / 1.0, (s_suppkey % 7) / 1.0, (s_suppkey % 3) / 1.0] AS f FROM supplier), e AS (SELECT id, f, list_transform(f, lambda x: exp(x - list_max(f))) AS e FROM s), p AS (SELECT id, f, list_transform(e, lambda x: x / list_sum(e)) AS p FROM e), b AS (SELECT id, list_position(p, list_max(p)) AS c, round(list_max(p), 6) AS confidence FROM p WHERE list_max(p) >= 0.55) SELECT id, CASE WHEN id % 2 = 0 THEN 'Y' ELSE 'X' END AS head, CASE c WHEN 2 THEN 'depends_on' ELSE 'replaced' END AS relation, CASE WHEN id % 2 = 0 THEN 'X' ELSE 'Y' END AS tail, confidence FROM b WHERE c <> 1")
def classified_pairs(spark, d):
    s = model.read(spark, d, "supplier").select(F.col("s_suppkey").alias("id"))
    said = F.when(F.col("id") % 2 == 0, F.lit("Y uses X; from X to Y")).otherwise(F.lit("X and Y"))
    texts = s.select("id", said.alias("text"))
    entities = s.select("id", F.posexplode(F.array(F.lit("X"), F.lit("Y"), F.lit("X"))).alias("position", "name"))
    scores = F.array(*[(F.col("id") % n / 1.0) for n in (5, 7, 3)])
    pairs = decode.pairs_to_classify(texts, entities).withColumn("forward", scores).withColumn("backward", F.array(F.lit(9.0), F.lit(0.0), F.lit(0.0)))
    return decode.classified_relations(pairs, _CLASSES)


@query("WITH s AS (SELECT s_suppkey AS id, [(s_suppkey % 5) / 1.0, (s_suppkey % 7) / 1.0, (s_suppkey % 3) / 1.0] AS f FROM supplier), e AS (SELECT id, list_transform(f, lambda x: exp(x - list_max(f))) AS e FROM s), p AS (SELECT id, list_transform(e, lambda x: x / list_sum(e)) AS p FROM e) SELECT id, 'depends_on' AS relation FROM p WHERE NOT (p[1] > 0.5 OR (list_position(p, list_max(p)) = 3 AND list_max(p) > 0.6 AND p[1] < 0.2))")
def confirmed_relations(spark, d):
    rows = model.read(spark, d, "supplier").select(F.col("s_suppkey").alias("id"), F.lit("depends_on").alias("relation"), F.array(*[(F.col("s_suppkey") % n / 1.0) for n in (5, 7, 3)]).alias("scores"))
    return decode.confirmed(rows, _CLASSES).drop("scores")


@query()
def scored_spans(spark, d):
    s = model.read(spark, d, "supplier").select(F.col("s_suppkey").alias("id"), F.lit("one two three").alias("content"))
    logits = F.transform(F.sequence(F.lit(0), F.lit(11)), lambda i: ((F.col("id") * 7 + i * 5) % 13 - 6).cast("double"))
    return decode.span_entities(s.select("id", "content", text.words_with_offsets(F.col("content")).alias("words"), logits.alias("logits")), ("X", "Y"), 2)


@query("SELECT s_suppkey AS id, CASE s_suppkey % 4 WHEN 0 THEN 'Redis' WHEN 1 THEN 'Redis Cluster' WHEN 2 THEN 'Redis Cluster' END AS entity FROM supplier")
def spans_as_entities(spark, d):
    s = model.read(spark, d, "supplier").select(F.col("s_suppkey").alias("id"))
    spans = s.select("id", _case("id", 4, [F.lit("redis"), F.lit("the Redis Cluster"), F.lit("Cluster"), F.lit("Solr")]).alias("span"))
    entities = s.select("id", F.posexplode(F.array(F.lit("Redis"), F.lit("Redis Cluster"))).alias("position", "name"))
    return decode.spans_to_entities(spans, entities).select("id", "entity")


@query("SELECT s_suppkey AS id, 0 AS position, 1 AS first, 2 AS last FROM supplier UNION ALL SELECT s_suppkey, 1, 3, 3 FROM supplier")
def words_of_entities(spark, d):
    s = model.read(spark, d, "supplier").select(F.col("s_suppkey").alias("id"), F.lit("run  Redis Cluster on AWS").alias("t"))
    entities = s.select("id", F.posexplode(F.array(F.struct(F.lit(5).alias("start"), F.lit(18).alias("end")), F.struct(F.lit(19).alias("start"), F.lit(21).alias("end")))).alias("position", "e")).select("id", "position", "e.*")
    return decode.entity_words(entities, s.select("id", text.words_with_offsets(F.col("t")).alias("words")))


@query("SELECT a.s_suppkey AS episode, CASE WHEN a.s_suppkey % 2 = 0 THEN 3 ELSE 2 END AS n_mentions, CASE WHEN a.s_suppkey % 2 = 0 THEN 2 ELSE 1 END AS n_relations FROM supplier a")
def merged_answers(spark, d):
    s = model.read(spark, d, "supplier").select(F.col("s_suppkey").alias("episode"))
    rows = lambda names_, where: s.where(where).select("episode", F.explode(F.array(*[F.lit(x) for x in names_])).alias("name"))
    triple = lambda h, t, where: s.where(where).select("episode", F.lit(h).alias("head"), F.lit("r").alias("relation"), F.lit(t).alias("tail"))
    more = triple("b", "A", "true").unionByName(triple("A", "C", "episode % 2 = 0"))
    mentions, found = ingest.with_answers(rows(["A", "B"], "true"), triple("A", "B", "true"), rows(["a", "C"], "episode % 2 = 0").unionByName(rows(["b"], "episode % 2 = 1")), more)
    return mentions.groupBy("episode").agg(F.count("*").alias("n_mentions")).join(found.groupBy("episode").agg(F.count("*").alias("n_relations")), "episode")


# scores


def _judged(spark, d) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Orders as episodes: their parts as gold relations of the supplier, predicted ones wrong where the line number says so."""
    line = model.read(spark, d, "lineitem").select(F.col("l_orderkey").alias("id"), F.col("l_linenumber").alias("position"), F.concat(F.lit("s"), F.col("l_suppkey").cast("string")).alias("head"), F.concat(F.lit("p"), F.col("l_partkey").cast("string")).alias("tail"))
    gold = line.withColumn("relation", F.lit("Supplies"))
    return line.select("id"), gold, gold.withColumn("relation", F.when(F.col("position") % 3 == 0, "other").otherwise("supplies")).withColumn("head", F.when(F.col("position") % 5 == 0, F.lit("x")).otherwise(F.upper("head")))


@query("WITH l AS (SELECT l_orderkey AS id, l_linenumber AS n, 's' || l_suppkey AS h, 'p' || l_partkey AS t FROM lineitem), g AS (SELECT id, h, t, count(*) AS n FROM l GROUP BY ALL), p AS (SELECT id, CASE WHEN n % 5 = 0 THEN 'x' ELSE h END AS h, t, count(*) AS n FROM l WHERE n % 3 <> 0 GROUP BY ALL), s AS (SELECT id, count(*) AS n FROM l GROUP BY id), m AS (SELECT g.id, sum(least(g.n, p.n)) AS hits FROM g JOIN p ON g.id = p.id AND g.h = p.h AND g.t = p.t GROUP BY g.id) SELECT s.id, s.n AS n_predicted, s.n AS n_gold, round(2.0 * coalesce(hits, 0) / (2 * s.n), 6) AS strict FROM s LEFT JOIN m ON m.id = s.id")
def relation_f1_strict(spark, d):
    return scoring.relation_scores(*_judged(spark, d)).select("id", "n_predicted", "n_gold", "strict")


@query()
def relation_f1_all(spark, d):
    return scoring.relation_scores(*_judged(spark, d))


@query("WITH l AS (SELECT l_orderkey AS id, l_linenumber AS n, 'p' || l_partkey AS name FROM lineitem), g AS (SELECT id, name, count(*) AS n FROM l GROUP BY ALL), p AS (SELECT id, name, count(*) AS n FROM l WHERE n % 4 <> 0 GROUP BY ALL), s AS (SELECT id, count(*) AS n, count(*) FILTER (n % 4 <> 0) AS k FROM l GROUP BY id), m AS (SELECT g.id, sum(least(g.n, p.n)) AS hits FROM g JOIN p ON g.id = p.id AND g.name = p.name GROUP BY g.id) SELECT s.id, k AS n_predicted, s.n AS n_gold, round(2.0 * coalesce(hits, 0) / (s.n + k), 6) AS strict FROM s LEFT JOIN m ON m.id = s.id")
def entity_f1_strict(spark, d):
    line = model.read(spark, d, "lineitem").select(F.col("l_orderkey").alias("id"), F.col("l_linenumber").alias("position"), F.concat(F.lit("P"), F.col("l_partkey").cast("string")).alias("name"), F.lit("Part").alias("entity_type"))
    return scoring.entity_scores(line.select("id"), line, line.where("position % 4 <> 0")).select("id", "n_predicted", "n_gold", "strict")


@query()
def semantic_f1(spark, d):
    v = model.read(spark, d, "embeddings").select((F.col("vec_id") % 50).alias("id"), F.col("vec_id").alias("position"), F.concat(F.lit("n"), F.col("vec_id").cast("string"), F.lit("n")).alias("name"), F.col("embedding").alias("vector"), "label")
    return scoring.semantic_scores(v.select("id"), v.where("position % 2 = 0"), v.where("position % 2 = 1"), least=0.2)


@query("WITH g AS (SELECT DISTINCT l_orderkey AS id, 's' || l_suppkey AS h, 'p' || l_partkey AS t FROM lineitem), p AS (SELECT DISTINCT l_orderkey AS id, 's' || l_suppkey AS h, 'p' || l_partkey AS t, l_linenumber % 2 AS k FROM lineitem), n AS (SELECT id, count(*) AS n_gold FROM g GROUP BY id), q AS (SELECT id, count(*) AS n_predicted, count(*) FILTER (k = 0) AS n_mapped FROM p GROUP BY id) SELECT n.id, n_gold, n_predicted, n_mapped, 0.0 AS raw, round(2.0 * n_mapped / (n_gold + n_mapped), 6) AS mapped FROM n JOIN q ON q.id = n.id")
def mapped_f1(spark, d):
    line = model.read(spark, d, "lineitem").select(F.col("l_orderkey").alias("id"), F.concat(F.lit("s"), F.col("l_suppkey").cast("string")).alias("head"), F.concat(F.lit("p"), F.col("l_partkey").cast("string")).alias("tail"), "l_linenumber")
    free = F.when(F.col("l_linenumber") % 2 == 0, F.lit("uses library")).otherwise(F.lit("knows"))
    return scoring.mapped_scores(line.withColumn("relation", F.lit("depends_on")), line.withColumn("relation", free))


_RUNS = "r AS (SELECT event_type AS domain, event_id % 7 = 0 AS failed, event_id % 11 / 10.0 AS es, event_id % 5 / 4.0 AS ef, event_id % 3 / 2.0 AS rs, event_id % 9 / 8.0 AS rp, value AS t, event_id % 4 / 100.0 AS cost, event_id % 3 + 1 AS calls FROM events)"
_MEAN = "round(avg(CASE WHEN NOT failed THEN {0} END), 6)"


def _run_results(spark, d) -> DataFrame:
    e, i = model.read(spark, d, "events"), F.col("event_id")
    return e.select(F.col("event_type").alias("domain"), F.when(i % 7 == 0, "timeout").alias("error"), (i % 11 / 10.0).alias("ent_strict"), (i % 5 / 4.0).alias("ent_fuzzy"), (i % 3 / 2.0).alias("rel_strict"), (i % 9 / 8.0).alias("rel_pair"), F.col("value").alias("elapsed_s"), (i % 4 / 100.0).alias("cost"), (i % 3 + 1).alias("calls"))


_SUMMARY = f"count(*) AS n_episodes, count(*) FILTER (NOT failed) AS n_ok, count(*) FILTER (failed) AS n_errors, {_MEAN.format('es')} AS ent_f1_strict, {_MEAN.format('ef')} AS ent_f1_fuzzy, {_MEAN.format('rs')} AS rel_f1_strict, {_MEAN.format('rp')} AS rel_f1_pair, round((avg(CASE WHEN NOT failed THEN es END) + avg(CASE WHEN NOT failed THEN rs END)) / 2, 6) AS combined_f1_strict, round((avg(CASE WHEN NOT failed THEN ef END) + avg(CASE WHEN NOT failed THEN rp END)) / 2, 6) AS combined_f1_fuzzy_pair, round(avg(t), 6) AS avg_time_s, round(sum(cost) / count(*) * 1000, 6) AS cost_per_1k_episodes, round(avg(calls), 6) AS calls_per_episode"


@query(f"WITH {_RUNS} SELECT {_SUMMARY} FROM r")
def run_summary(spark, d):
    return scoring.run_summary(_run_results(spark, d))


@query(f"WITH {_RUNS}, s AS (SELECT domain, {_SUMMARY} FROM r WHERE NOT failed GROUP BY domain) SELECT domain, n_ok, ent_f1_strict, ent_f1_fuzzy, rel_f1_strict, rel_f1_pair, combined_f1_strict, combined_f1_fuzzy_pair FROM s")
def domain_scores(spark, d):
    return scoring.domain_scores(_run_results(spark, d))


@query("WITH a AS (SELECT event_id % 6 AS k FROM events) SELECT count(*) AS n, round(avg(CASE WHEN k <> 0 THEN 1.0 ELSE 0 END), 6) AS json_valid, round(avg(CASE WHEN k NOT IN (0, 1, 2) THEN 1.0 ELSE 0 END), 6) AS schema_valid, round(avg(CASE WHEN k IN (2, 3, 4) THEN 1.0 ELSE 0 END), 6) AS op_accuracy, round(avg(CASE WHEN k IN (3, 5) THEN 1.0 ELSE 0 END), 6) AS relation_accuracy FROM a")
def operation_accuracy(spark, d):
    k = F.col("event_id") % 6
    pick = lambda *v: _case("event_id", 6, [F.lit(x).cast("string") for x in v])
    e = model.read(spark, d, "events").where(k >= 0)
    rows = e.select(pick(None, "drop", "traverse", "traverse", "traverse", "list").alias("op"), pick(None, "caused", "likes", "caused", None, None).alias("relation"), pick(*["traverse"] * 6).alias("expected_op"), pick("caused", "part_of", "caused", "caused", "caused", None).alias("expected_relation"))
    return scoring.operation_scores(rows, ("caused", "part_of"))


@query("WITH a AS (SELECT event_id % 4 AS k FROM events) SELECT count(*) AS n, round(avg(CASE WHEN k = 0 THEN 1.0 ELSE 0 END), 6) AS accuracy, round(avg(CASE WHEN k IN (0, 1) THEN 1.0 ELSE 0 END), 6) AS accuracy_in_two FROM a")
def relation_matcher_accuracy(spark, d):
    pick = lambda *v: _case("event_id", 4, [F.lit(x) for x in v])
    e = model.read(spark, d, "events")
    return scoring.matcher_accuracy(e.select(F.lit("caused").alias("expected"), pick("caused", "fixed", "fixed", "fixed").alias("relation"), pick("fixed", "caused", "chose", "chose").alias("runner_up")))


@query("WITH r AS (SELECT *, row_number() OVER (PARTITION BY quality ORDER BY md5('7' || doc_id), doc_id) AS r, count(*) OVER (PARTITION BY quality) AS n FROM labels) SELECT quality, count(*) AS total, count(*) FILTER (r > greatest(floor(n * 0.2), 1)) AS train, count(*) FILTER (r <= greatest(floor(n * 0.2), 1)) AS val FROM r GROUP BY quality")
def split_histogram(spark, d):
    return scoring.class_histogram(evaluate.stratified_split(model.read(spark, d, "labels"), "quality", "doc_id"), "quality", "split")


@query("WITH s AS (SELECT event_type AS kind, 'k' || CAST(json_extract(props, '$.k') AS VARCHAR) AS name, event_id, CASE WHEN event_id % 3 > 0 THEN 'r' || event_id ELSE ' ' END AS why FROM events), g AS (SELECT kind, lower(name) AS folded, count(*) AS n_rows, list(why ORDER BY event_id) FILTER (trim(why) <> '') AS w FROM s GROUP BY 1, 2) SELECT kind, folded, coalesce(w, [])[1:3] AS rationales FROM g WHERE n_rows >= 2")
def review_reasons(spark, d):
    e = model.read(spark, d, "events")
    why = F.when(F.col("event_id") % 3 > 0, F.concat(F.lit("r"), F.col("event_id").cast("string"))).otherwise(F.lit(" "))
    s = e.select(F.col("event_type").alias("kind"), F.concat(F.lit("k"), F.get_json_object("props", "$.k")).alias("name"), F.col("event_id").alias("episode_idx"), F.lit(None).cast("string").alias("domain"), F.lit(None).cast("double").alias("confidence"), why.alias("rationale"))
    return evaluate.review(s, spark.createDataFrame([], "kind string, name string"), 2, 3, 0.5).select("kind", "folded", "rationales")


# training sets


def _labelled(spark, d) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Customers as episodes of two sentences with three entities and one relation."""
    c = model.read(spark, d, "customer").select(F.col("c_custkey").alias("episode"), "c_name")
    episodes = c.select("episode", F.concat("c_name", F.lit(" uses Redis. Solr is late.")).alias("text"))
    kinds = [(F.col("c_name"), "Person"), (F.lit("Redis"), "Database"), (F.lit("Solr"), "Database")]
    entities = c.select("episode", F.posexplode(F.array(*[F.struct(n.alias("name"), F.lit(t).alias("entity_type")) for n, t in kinds])).alias("position", "e")).select("episode", "position", "e.*")
    return episodes, entities, c.select("episode", F.col("c_name").alias("head"), F.lit("chose").alias("relation"), F.lit("Redis").alias("tail"))


_TEMPLATES = {"chose": ("{head} picked {tail}.", "We see {head} choosing {tail}."), "replaced": ("{head} took over from {tail}.",), "caused": ("{tail} came of {head}.",)}


@query("SELECT c_name AS head, 'Redis' AS tail, 'chose' AS label, '[E1]' || c_name || '[/E1] uses [E2]Redis[/E2]. Solr is late.' AS text FROM customer")
def gold_examples(spark, d):
    e, _, r = _labelled(spark, d)
    return training.positives(e, r).select("head", "tail", "label", "text")


@query("SELECT c_name AS head, 'Solr' AS tail, '[E1]' || c_name || '[/E1] uses Redis. [E2]Solr[/E2] is late.' AS text FROM customer UNION ALL SELECT 'Redis', 'Solr', c_name || ' uses [E1]Redis[/E1]. [E2]Solr[/E2] is late.' FROM customer")
def unrelated_examples(spark, d):
    return training.unrelated_in_episode(*_labelled(spark, d)).select("head", "tail", "text")


@query("SELECT 'Redis' AS head, c_name AS tail, '[E1]Redis[/E1] took over from [E2]' || c_name || '[/E2].' AS text FROM customer")
def reversed_examples(spark, d):
    _, _, r = _labelled(spark, d)
    return training.reversed_pairs(r.withColumn("relation", F.lit("replaced")), _TEMPLATES, ("replaced",)).select("head", "tail", "text")


@query("WITH p AS (SELECT DISTINCT c_name AS head FROM customer), o AS (SELECT head, CAST(('0x' || substr(md5('7|' || head || '|Redis|chose'), 1, 8)) AS BIGINT) % 2 AS k FROM p) SELECT head, 'Redis' AS tail, CASE k WHEN 0 THEN '[E2]Redis[/E2] came of [E1]' || head || '[/E1].' ELSE '[E1]' || head || '[/E1] took over from [E2]Redis[/E2].' END AS text FROM o")
def near_miss_examples(spark, d):
    _, _, r = _labelled(spark, d)
    return training.near_miss_pairs(r, _TEMPLATES).select("head", "tail", "text")


@query("SELECT 40 AS n, 40 AS different, 0 AS unmarked")
def hard_examples(spark, d):
    _, e, _ = _labelled(spark, d)
    made = training.template_pairs(e, ("{head} beside {tail}.", "{tail} and {head} apart."), 40)
    return made.agg(F.count("*").cast("int").alias("n"), F.sum((F.col("head") != F.col("tail")).cast("int")).cast("int").alias("different"), F.sum((~F.col("text").rlike(r"\[E1\].*\[/E1\]") | ~F.col("text").rlike(r"\[E2\]")).cast("int")).cast("int").alias("unmarked"))


@query()
def mixed_examples(spark, d):
    _, e, r = _labelled(spark, d)
    return training.mixed_across(e, r, _TEMPLATES)


@query("SELECT 'chose' AS label, least(greatest(100 - 25, 0), 25 * 2) AS n FROM (SELECT 1)")
def paraphrased_examples(spark, d):
    c = model.read(spark, d, "nation").select(F.col("n_name").alias("head"), F.lit("Redis").alias("tail"), F.lit("chose").alias("label"))
    return training.paraphrases(c, _TEMPLATES).groupBy("label").agg(F.count("*").cast("int").alias("n"))


@query("SELECT c_name AS head, '[E1]' || c_name || '[/E1] uses Redis. Solr is late.' AS head_text, c_name || ' uses [E2]Redis[/E2]. Solr is late.' AS tail_text, c_name || ' Redis' AS pair_text FROM customer")
def triple_texts(spark, d):
    e, _, r = _labelled(spark, d)
    return training.triple_texts(training.positives(e, r)).select("head", "head_text", "tail_text", "pair_text")


@query("WITH k AS (SELECT count(*) AS n FROM customer), m AS (SELECT CAST(floor(2.5 * n) AS BIGINT) AS most, n FROM k) SELECT 'none' AS label, least(most, 3 * n) AS total FROM m UNION ALL SELECT 'chose', n FROM m")
def training_classes(spark, d):
    e, n, r = _labelled(spark, d)
    made = [training.positives(e, r), training.unrelated_in_episode(e, n, r), training.reversed_pairs(r, _TEMPLATES, ("chose",)), training.positives(e, r)]
    every = made[0]
    for more in made[1:]:
        every = every.unionByName(more)
    return training.training_set(every).groupBy("label").agg(F.count("*").alias("total"))


# sources and ingestion


@query("SELECT s_suppkey AS episode, ['A', s_name] AS entities, 'A' AS head, 'knows' AS relation, s_name AS tail FROM supplier")
def run_log(spark, d):
    one = F.concat(F.lit("start\n── Episode "), F.col("s_suppkey").cast("string"), F.lit("/50 ──\nEntities extracted: ['A', '"), "s_name", F.lit("']\nRelations extracted: [('A', 'knows', '"), "s_name", F.lit("')]\n"))
    rows = fixtures.log_episodes(model.read(spark, d, "supplier").select(one.alias("value")))
    return rows.select("episode", "entities", F.explode("relations").alias("r")).select("episode", "entities", "r.*")


@query("SELECT s_name || ' lives in ' || n_name AS text, s_name AS head, 'Live_In' AS relation, n_name AS tail, 'Person' AS head_type, 'Location' AS tail_type FROM supplier JOIN nation ON n_nationkey = s_nationkey")
def token_records(spark, d):
    s = model.read(spark, d, "supplier").join(model.read(spark, d, "nation"), F.col("n_nationkey") == F.col("s_nationkey"))
    a, b = F.split("s_name", " "), F.split("n_name", " ")
    span = lambda t, x, y: F.struct(F.lit(t).alias("type"), x.alias("start"), y.alias("end"))
    size = F.size(a)
    entities = F.array(span("Peop", F.lit(0), size), span("Loc", size + 2, size + 2 + F.size(b)))
    rows = s.select(F.concat(a, F.array(F.lit("lives"), F.lit("in")), b).alias("tokens"), entities.alias("entities"), F.array(F.struct(F.lit("Live_In").alias("type"), F.lit(0).alias("head"), F.lit(1).alias("tail"))).alias("relations"))
    made = fixtures.token_episodes(rows)
    kind = lambda i: F.get("entities", F.lit(i))["entity_type"]
    return made.select("text", F.get("relations", F.lit(0)).alias("r"), kind(0).alias("head_type"), kind(1).alias("tail_type")).select("text", "r.*", "head_type", "tail_type")


def _ingested(spark, d) -> GraphStore:
    """A store into which nations were read as episodes, twice: the second time nothing is new."""

    def make(folder: str) -> GraphStore:
        store = GraphStore.init(spark, folder)
        n = model.read(spark, d, "nation").join(model.read(spark, d, "region"), F.col("n_regionkey") == F.col("r_regionkey"))
        named = lambda c: F.md5(c)
        key = F.col("n_nationkey").cast("string")
        episodes = n.select(key.alias("id"), F.concat("n_name", F.lit(" in "), "r_name").alias("content"), F.lit("atlas").alias("source"), F.lit("2024-01-01").cast("timestamp").alias("recorded_at"))
        said = n.select(key.alias("episode"), F.explode(F.array(F.struct(named(F.col("n_name")).alias("name"), F.lit("Nation").alias("entity_type"), F.lit(0).alias("start"), F.length("n_name").alias("end"), F.lit(0).alias("position")), F.struct(named(F.col("r_name")).alias("name"), F.lit("Region").alias("entity_type"), (F.length("n_name") + 4).alias("start"), (F.length("n_name") + 4 + F.length("r_name")).alias("end"), F.lit(1).alias("position")))).alias("m")).select("episode", "m.*")
        told = n.select(key.alias("episode"), named(F.col("n_name")).alias("head"), F.lit("part_of").alias("relation"), named(F.col("r_name")).alias("tail"), F.lit(0.9).alias("confidence"), F.lit(None).cast("string").alias("fact"))
        lost = told.withColumn("tail", F.lit("nobody"))
        for _ in range(2):
            ingest.ingest(store, episodes, lambda _: (said, told.unionByName(lost)))
        return store

    return kept(spark, ("ingested", d), make)


@query("SELECT md5(n_name) AS head, 'part_of' AS relation, md5(r_name) AS tail, md5(n_name) || ' part_of ' || md5(r_name) AS fact, CAST(n_nationkey AS VARCHAR) AS episode_id FROM nation JOIN region ON n_regionkey = r_regionkey")
def ingested_edges(spark, d):
    store = _ingested(spark, d)
    e = store.table("entities").select("id", "name")
    side = lambda p, c: e.select(F.col("id").alias(c), F.col("name").alias(p))
    return store.table("edges").join(side("head", "source_id"), "source_id").join(side("tail", "target_id"), "target_id").select("head", "relation", "tail", "fact", "episode_id")


@query("SELECT CAST(n_nationkey AS VARCHAR) AS episode_id, md5(n_name) AS name, 0 AS span_start FROM nation UNION ALL SELECT CAST(n_nationkey AS VARCHAR), md5(r_name), CAST(length(n_name) + 4 AS INTEGER) FROM nation JOIN region ON n_regionkey = r_regionkey")
def ingested_mentions(spark, d):
    store = _ingested(spark, d)
    return store.table("mentions").join(store.table("entities"), F.col("entity_id") == F.col("id")).select("episode_id", "name", "span_start")


@query("SELECT entity_type, count(*) AS n FROM (SELECT DISTINCT n_name, 'Nation' AS entity_type FROM nation UNION ALL SELECT DISTINCT r_name, 'Region' FROM region WHERE r_regionkey IN (SELECT n_regionkey FROM nation)) GROUP BY entity_type")
def ingested_entities(spark, d):
    return _ingested(spark, d).table("entities").groupBy("entity_type").agg(F.count("*").alias("n"))


@query("SELECT o_orderkey % 3 = 0 AS messy, count(*) AS n FROM orders GROUP BY 1")
def escalated_texts(spark, d):
    names_ = F.array(*[F.struct(F.lit(x).alias("text"), F.lit("Service").alias("entity_type"), F.lit(0).alias("start"), F.lit(1).alias("end"), F.lit(0.9).alias("confidence")) for x in ("a", "b", "c")])
    said = F.when(F.col("o_orderkey") % 3 == 0, F.lit("a b c broke")).otherwise(F.lit("a b c run"))
    rows = model.read(spark, d, "orders").select(extract.escalates(said, names_, ("Service",)).alias("messy"))
    return rows.groupBy("messy").agg(F.count("*").alias("n"))


@query("SELECT s_suppkey, n_name AS text, CAST(9 AS INTEGER) AS start FROM supplier JOIN nation ON s_nationkey = n_nationkey UNION ALL SELECT s_suppkey, r_name, CAST(15 + length(n_name) AS INTEGER) FROM supplier JOIN nation ON s_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey")
def dictionary_join(spark, d):
    s, n, r = (model.read(spark, d, x) for x in ("supplier", "nation", "region"))
    rows = s.join(n, F.col("s_nationkey") == F.col("n_nationkey")).join(r, F.col("n_regionkey") == F.col("r_regionkey"))
    texts = rows.select("s_suppkey", F.concat(F.lit("ships to "), "n_name", F.lit(" from "), "r_name").alias("text"))
    words = n.select(F.col("n_name").alias("name"), F.lit("Nation").alias("entity_type")).unionByName(r.select(F.col("r_name").alias("name"), F.lit("Region").alias("entity_type")))
    return extract.mentions_by_join(texts, words, "s_suppkey").select("s_suppkey", "text", "start")

