"""Queries of the graph engine over the driver's tables, with SQL that gives the same rows."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from . import model
from .functions import dates, text
from .operators import envelope, evaluate, extract, graph, questions, relations, resolve, search
from .operators.index import SearchIndex
from .plans.stored import kept

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}
_E, _N, _D = model.EPISODES_SQL, model.ENTITIES_SQL, model.EDGES_SQL


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            SQL[f.__name__] = sql
        return f

    return add


def _bm25_sql(terms: dict[str, str], where: str, score: list[str], table: str, cte: str, content: str) -> str:
    """``terms``: name -> SQL over the token list w that counts it in a row."""
    counts = ", ".join(f"{sql} AS {name}" for name, sql in terms.items())
    stats = ", ".join(f"count(*) FILTER ({name} > 0) AS d_{name}" for name in score)
    idf = lambda x: f"CASE WHEN n - d_{x} > d_{x} THEN greatest(ln((n - d_{x} + 0.5) / (d_{x} + 0.5)), 1e-6) ELSE 1e-6 END"
    total = " + ".join(f"{idf(x)} * {x} * 2.2 / ({x} + 1.2 * (0.25 + 0.75 * dl / av))" for x in score)
    return f"""WITH {cte}, t AS (SELECT id, regexp_extract_all(lower(coalesce({content}, '')), '[\\p{{L}}\\p{{N}}]+') AS w FROM {table}),
 f AS (SELECT id, len(w) AS dl, {counts} FROM t), s AS (SELECT count(*) AS n, avg(dl) AS av, {stats} FROM f)
 SELECT id, round({total}, 6) AS score FROM f, s WHERE {where} ORDER BY score DESC, id LIMIT 10"""


def _term(word: str) -> str:
    return f"len(list_filter(w, lambda x: x = '{word}'))"


def _documents(spark: SparkSession, d: str) -> DataFrame:
    return model.episodes(spark, d)


#: Columns of each searched table and the partitions of its index.
_INDEXED = {"content": (model.episodes, ["content"]), "episodes": (model.episodes, ["content", "source", "metadata"]), "entities": (model.entities, ["name", "entity_type"]), "edges": (model.stored_edges, ["fact", "relation"])}


def _index(spark: SparkSession, d: str, table: str) -> SearchIndex:
    """The index of a table, built once an application over all rows and stored, as a graph's store holds its own."""
    rows, columns = _INDEXED[table]

    def make(folder: str) -> SearchIndex:
        found = rows(spark, d)
        found = found.withColumn("fact", F.concat_ws(" ", "source_id", "relation", "target_id")) if table == "edges" else found
        return SearchIndex.build(found, "id", columns, folder, 16)

    return kept(spark, ("index", table, d), make)


_TWO = {"a": _term("with"), "b": _term("para")}


@query(_bm25_sql({"a": _term("with"), "b": _term("that")}, "a > 0 AND b > 0", ["a", "b"], "episodes", _E, "content"))
def fts_and(spark, d):
    return _index(spark, d, "content").bm25("with that")


@query(_bm25_sql(_TWO, "a > 0 OR b > 0", ["a", "b"], "episodes", _E, "content"))
def fts_or(spark, d):
    return _index(spark, d, "content").bm25("with OR para")


@query(_bm25_sql({"a": _term("that"), "b": _term("with")}, "a > 0 AND NOT b > 0", ["a"], "episodes", _E, "content"))
def fts_not(spark, d):
    return _index(spark, d, "content").bm25("that NOT with")


@query(_bm25_sql({"a": "len(list_filter(w, lambda x: starts_with(x, 'heing')))"}, "a > 0", ["a"], "episodes", _E, "content"))
def fts_prefix(spark, d):
    return _index(spark, d, "content").bm25("heing*")


@query(_bm25_sql({"a": "len(list_filter(range(1, len(w)), lambda i: w[i] = 'of' AND w[i + 1] = 'the'))"}, "a > 0", ["a"], "episodes", _E, "content"))
def fts_phrase(spark, d):
    return _index(spark, d, "content").bm25('"of the"')


@query(_bm25_sql({"a": _term("part"), "b": _term("customer")}, "a > 0 OR b > 0", ["a", "b"], "entities", _N, "name || ' ' || entity_type"))
def fts_entities(spark, d):
    return _index(spark, d, "entities").bm25("part OR customer")


_DOT = "list_sum(list_transform(range(1, 65), lambda i: CAST({a}[i] AS DOUBLE) * CAST({b}[i] AS DOUBLE)))"
_COS = f"round({_DOT.format(a='x', b='y')} / (sqrt({_DOT.format(a='x', b='x')}) * sqrt({_DOT.format(a='y', b='y')})), 6)"


def _vectors(spark, d):
    return model.read(spark, d, "embeddings").select(F.col("vec_id").cast("string").alias("id"), "embedding")


@query(f"WITH q AS (SELECT embedding AS y FROM embeddings WHERE vec_id = 0), v AS (SELECT CAST(vec_id AS VARCHAR) AS id, embedding AS x, y FROM embeddings, q) SELECT id, {_COS} AS score FROM v ORDER BY score DESC, id LIMIT 10")
def cosine_topk(spark, d):
    v = _vectors(spark, d)
    asked = v.where("id = '0'").first()["embedding"]
    return search.similar(v, "id", "embedding", list(asked), 10)


@query(f"WITH v AS (SELECT CAST(vec_id AS VARCHAR) AS id, embedding AS x FROM embeddings), p AS (SELECT q.id AS query, v.id, v.x, q.x AS y FROM v JOIN v q ON q.id <> v.id AND CAST(q.id AS BIGINT) % 50 = 0), s AS (SELECT query, id, {_COS} AS score FROM p), r AS (SELECT *, row_number() OVER (PARTITION BY query ORDER BY score DESC, id) AS rank FROM s) SELECT query, id, score, CAST(rank AS INTEGER) AS rank FROM r WHERE rank <= 5")
def cosine_batch_topk(spark, d):
    v = _vectors(spark, d)
    return search.similar_batch(v, v.where("cast(id as bigint) % 50 = 0"), "id", "embedding", 5)


_FTS_TEXT = _bm25_sql(_TWO, "a > 0 OR b > 0", ["a", "b"], "episodes", _E, "content").replace("LIMIT 10", "LIMIT 200")


@query(f"WITH f AS ({_FTS_TEXT}), q AS (SELECT embedding AS y FROM embeddings WHERE vec_id = 0), v AS (SELECT CAST(vec_id AS VARCHAR) AS id, embedding AS x, y FROM embeddings, q), c AS (SELECT id, {_COS} AS score FROM v ORDER BY score DESC, id LIMIT 200), r AS (SELECT id, row_number() OVER (ORDER BY score DESC, id) AS rank FROM f UNION ALL SELECT id, row_number() OVER (ORDER BY score DESC, id) FROM c) SELECT id, round(sum(1.0 / (60 + rank)), 9) AS score FROM r GROUP BY id ORDER BY score DESC, id LIMIT 10")
def rrf_fused(spark, d):
    v = _vectors(spark, d)
    asked = list(v.where("id = '0'").first()["embedding"])
    lists = [_index(spark, d, "content").bm25("with OR para", 200), search.similar(v, "id", "embedding", asked, 200)]
    return search.fuse([search.ranked(x, "id") for x in lists], "id")


@query(f"WITH {_D} SELECT relation, count(*) AS n FROM edges WHERE valid_until IS NULL GROUP BY relation")
def edges_current(spark, d):
    return graph.current(model.stored_edges(spark, d)).groupBy("relation").agg(F.count("*").alias("n"))


@query(f"WITH {_D} SELECT relation, count(*) AS n, min(id) AS first_id FROM edges WHERE coalesce(valid_from <= TIMESTAMP '1998-01-01', true) AND coalesce(valid_until > TIMESTAMP '1998-01-01', true) GROUP BY relation")
def edges_as_of(spark, d):
    return graph.as_of(model.stored_edges(spark, d), "1998-01-01").groupBy("relation").agg(F.count("*").alias("n"), F.min("id").alias("first_id"))


@query(f"WITH {_D}, o AS (SELECT 'c:' || o_custkey AS customer, o_orderkey, o_orderdate AS t FROM orders) SELECT o_orderkey, count(*) AS n_valid FROM o JOIN edges ON source_id = customer AND relation = 'ordered' WHERE coalesce(valid_from <= t, true) AND coalesce(valid_until > t, true) GROUP BY o_orderkey")
def edge_asof_join(spark, d):
    o = model.read(spark, d, "orders").select(F.concat(F.lit("c:"), F.col("o_custkey").cast("string")).alias("customer"), "o_orderkey", F.col("o_orderdate").cast("timestamp").alias("t"))
    return graph.as_of_join(o, model.stored_edges(spark, d).where("relation = 'ordered'"), "customer", "t").groupBy("o_orderkey").agg(F.count("*").alias("n_valid"))


@query(f"WITH {_D} SELECT relation, count(*) AS n, count(valid_until) AS ended FROM (SELECT id, relation, CASE WHEN valid_until IS NULL AND relation = 'supplies' AND source_id = 's:1' THEN TIMESTAMP '2002-01-01' ELSE valid_until END AS valid_until FROM edges) GROUP BY relation")
def invalidate(spark, d):
    e = model.stored_edges(spark, d)
    return graph.invalidate(e, e.where("relation = 'supplies' and source_id = 's:1'"), "2002-01-01").groupBy("relation").agg(F.count("*").alias("n"), F.count("valid_until").alias("ended"))


_NEAR = f"{_D}, near AS (SELECT source_id AS a, target_id AS b FROM edges WHERE valid_until IS NULL UNION SELECT target_id, source_id FROM edges WHERE valid_until IS NULL)"
_L = "l0 AS (SELECT 's:1' AS id), l1 AS (SELECT DISTINCT b AS id FROM l0 JOIN near ON a = id), l2 AS (SELECT DISTINCT b AS id FROM l1 JOIN near ON a = id)"


def _seed(spark):
    return spark.createDataFrame([("s:1",)], "id string")


@query(f"WITH {_NEAR}, {_L} SELECT id, 0 AS depth FROM l0 UNION ALL SELECT id, 1 FROM l1 UNION ALL SELECT id, 2 FROM l2")
def walk_2_levels(spark, d):
    return graph.walk_levels(model.stored_edges(spark, d), _seed(spark), 2)


@query(f"WITH {_NEAR}, {_L}, l3 AS (SELECT DISTINCT b AS id FROM l2 JOIN near ON a = id), u AS (SELECT id, 0 AS depth FROM l0 UNION ALL SELECT id, 1 FROM l1 UNION ALL SELECT id, 2 FROM l2 UNION ALL SELECT id, 3 FROM l3) SELECT id, min(depth) AS depth FROM u GROUP BY id")
def reach_3(spark, d):
    return graph.reach(model.stored_edges(spark, d), _seed(spark), 3)


@query(f"WITH {_NEAR}, {_L}, u AS (SELECT id FROM l0 UNION SELECT id FROM l1 UNION SELECT id FROM l2) SELECT relation, count(*) AS n, min(id) AS first_id FROM edges WHERE valid_until IS NULL AND source_id IN (SELECT id FROM u) AND target_id IN (SELECT id FROM u) GROUP BY relation")
def induced_2(spark, d):
    e = graph.current(model.stored_edges(spark, d))
    return graph.induced(e, graph.reach(e, _seed(spark), 2)).groupBy("relation").agg(F.count("*").alias("n"), F.min("id").alias("first_id"))


@query(f"WITH {_D}, {_N}, m AS (SELECT id, relation, CASE WHEN source_id = 's:1' THEN target_id ELSE source_id END AS neighbor_id FROM edges WHERE valid_until IS NULL AND (source_id = 's:1' OR target_id = 's:1')) SELECT m.id, relation, neighbor_id, name AS neighbor FROM m JOIN entities ON entities.id = neighbor_id")
def entity_context(spark, d):
    return graph.context(model.stored_edges(spark, d), model.entities(spark, d), "s:1").select("id", "relation", "neighbor_id", "neighbor")


@query(f"WITH {_NEAR}, l0 AS (SELECT unnest(['s:1', 'c:1', 'n:3']) AS id), u AS (SELECT id, 0 AS depth FROM l0 UNION ALL SELECT b, 1 FROM l0 JOIN near ON a = id) SELECT id, min(depth) AS depth FROM u GROUP BY id")
def traverse_batch(spark, d):
    return graph.reach(model.stored_edges(spark, d), spark.createDataFrame([("s:1",), ("c:1",), ("n:3",)], "id string"), 1)


@query(f"WITH {_D}, {_N}, s AS (SELECT id AS n FROM entities ORDER BY id LIMIT 50) SELECT id, source_id, relation, target_id FROM edges WHERE source_id IN (SELECT n FROM s) OR target_id IN (SELECT n FROM s)")
def export_edges(spark, d):
    return graph.export(model.stored_edges(spark, d), model.entities(spark, d), 50).select("id", "source_id", "relation", "target_id")


@query(f"WITH {_E} SELECT source, count(*) AS n FROM episodes GROUP BY source")
def stats_sources(spark, d):
    return _documents(spark, d).groupBy("source").agg(F.count("*").alias("n"))


@query(f"WITH {_E} SELECT id, source, recorded_at FROM episodes ORDER BY recorded_at DESC, id LIMIT 20 OFFSET 40")
def list_episodes_page(spark, d):
    return _documents(spark, d).select("id", "source", "recorded_at").orderBy(F.desc("recorded_at"), "id").offset(40).limit(20)


@query(f"WITH {_N} SELECT id, name FROM entities WHERE entity_type = 'Supplier' ORDER BY id LIMIT 25")
def list_entities_type(spark, d):
    return model.entities(spark, d).where("entity_type = 'Supplier'").select("id", "name").orderBy("id").limit(25)


@query("WITH p AS (SELECT DISTINCT p_name FROM part), j AS (SELECT a.p_name AS name, b.p_name AS match, round(jaro_winkler_similarity(lower(a.p_name), lower(b.p_name)), 9) AS similarity FROM p a JOIN p b ON a.p_name < b.p_name) SELECT name, match, similarity FROM j WHERE similarity >= 0.85")
def jw_pairs(spark, d):
    p = model.read(spark, d, "part").select(F.col("p_name").alias("name"), F.lit("Part").alias("entity_type"))
    return resolve.similar_pairs(p, p).where("name < match").select("name", "match", "similarity")


@query("WITH k AS (SELECT DISTINCT p_name AS match FROM part), n AS (SELECT DISTINCT p_name || 's' AS name FROM part), j AS (SELECT name, match, round(jaro_winkler_similarity(lower(name), lower(match)), 9) AS similarity FROM n, k), r AS (SELECT *, row_number() OVER (PARTITION BY name ORDER BY similarity DESC, match) AS r FROM j WHERE similarity >= 0.85) SELECT name, 'Part' AS entity_type, match, similarity FROM r WHERE r = 1")
def fuzzy_resolve(spark, d):
    p = model.read(spark, d, "part").select(F.col("p_name").alias("name"), F.lit("Part").alias("entity_type"))
    return resolve.fuzzy(p.select(F.concat("name", F.lit("s")).alias("name"), "entity_type"), p)


@query(f"WITH {_N}, a AS (SELECT DISTINCT upper(n_name) AS alias_name, 'n:' || n_nationkey AS canonical_id FROM nation) SELECT id, canonical_id FROM entities JOIN a ON lower(name) = lower(alias_name)")
def alias_lookup(spark, d):
    n = model.read(spark, d, "nation").select(F.upper("n_name").alias("alias_name"), F.concat(F.lit("n:"), F.col("n_nationkey").cast("string")).alias("canonical_id"))
    return resolve.by_alias(model.entities(spark, d), n).where("canonical_id is not null").select("id", "canonical_id")


def _dated(spark, d):
    """Orders as sentences; the same template stands in the SQL."""
    o = model.read(spark, d, "orders")
    t = F.concat(F.lit("placed "), F.date_format("o_orderdate", "yyyy-MM-dd"), F.lit(" or "), F.date_format("o_orderdate", "MMMM d, yyyy"), F.lit(" in Q"), F.quarter("o_orderdate").cast("string"), F.lit(" "), F.year("o_orderdate").cast("string"), F.lit(", "), (F.col("o_orderkey") % 30).cast("string"), F.lit(" days ago, for "), (F.col("o_orderkey") % 9 + 1).cast("string"), F.lit(" weeks"))
    return o.select("o_orderkey", t.alias("text"), F.lit("2024-03-01").cast("timestamp").alias("moment"))


_ORDERS = "o AS (SELECT o_orderkey, CAST(o_orderdate AS DATE) AS day FROM orders)"


@query(f"WITH {_ORDERS} SELECT o_orderkey, day AS start FROM o UNION ALL SELECT o_orderkey, day FROM o")
def dates_absolute(spark, d):
    rows = dates.references(_dated(spark, d), "text", "moment", ("date",))
    return rows.select("o_orderkey", "start")


@query(f"WITH {_ORDERS} SELECT o_orderkey, CAST(DATE '2024-03-01' - CAST(o_orderkey % 30 AS INTEGER) AS DATE) AS start, CAST(-(o_orderkey % 30) AS INTEGER) AS days FROM o")
def dates_relative(spark, d):
    return dates.references(_dated(spark, d), "text", "moment", ("relative",)).select("o_orderkey", "start", "days")


@query(f"WITH {_ORDERS} SELECT o_orderkey, CAST(date_trunc('quarter', day) AS DATE) AS start, CAST(date_trunc('quarter', day) + INTERVAL 3 MONTH - INTERVAL 1 DAY AS DATE) AS \"end\" FROM o")
def dates_fiscal(spark, d):
    return dates.references(_dated(spark, d), "text", "moment", ("range",)).select("o_orderkey", "start", "end")


@query(f"WITH {_ORDERS} SELECT o_orderkey, CAST((o_orderkey % 9 + 1) * 7 AS INTEGER) AS days FROM o")
def dates_duration(spark, d):
    return dates.references(_dated(spark, d), "text", "moment", ("duration",)).select("o_orderkey", "days")


@query("SELECT doc_id, CAST(len(list_filter(regexp_extract_all(lower(text), '[a-z]+'), lambda x: list_contains(['he','she','him','her','his','hers','it','its','this','that','these','those','they','them','their','theirs','we','us','our'], x))) AS INTEGER) AS n FROM documents")
def pronoun_counts(spark, d):
    return model.read(spark, d, "documents").select("doc_id", F.size(text.pronouns(F.col("text"))).alias("n"))


@query("SELECT doc_id, CAST(len(list_filter(list_transform(string_split(regexp_replace(regexp_replace(text, '([.!?])\\s+', '\\1' || chr(1), 'g'), '\\n\\s*\\n', chr(1), 'g'), chr(1)), lambda x: trim(x)), lambda x: x <> '')) AS INTEGER) AS n FROM documents")
def sentence_counts(spark, d):
    return model.read(spark, d, "documents").select("doc_id", F.size(text.sentences(F.col("text"))).alias("n"))


@query("WITH g AS (SELECT source, doc_id FROM documents JOIN labels USING (doc_id) WHERE quality = 1), p AS (SELECT source, doc_id FROM documents JOIN labels USING (doc_id) WHERE n_chars > 1000), b AS (SELECT coalesce(g.source, p.source) AS source, count(g.doc_id) AS gold, count(p.doc_id) AS predicted, count(*) FILTER (g.doc_id IS NOT NULL AND p.doc_id IS NOT NULL) AS hits FROM (SELECT DISTINCT * FROM g) g FULL JOIN (SELECT DISTINCT * FROM p) p ON g.source = p.source AND g.doc_id = p.doc_id GROUP BY 1) SELECT source, gold, predicted, hits, round(CASE WHEN predicted > 0 THEN hits / predicted ELSE 0 END, 6) AS precision, round(CASE WHEN gold > 0 THEN hits / gold ELSE 0 END, 6) AS recall, round(2 * hits / (gold + predicted), 6) AS f1 FROM b")
def f1_exact(spark, d):
    rows = model.read(spark, d, "documents").join(model.read(spark, d, "labels"), "doc_id")
    return evaluate.f1_exact(rows.where("quality = 1"), rows.where("n_chars > 1000"), "source", "doc_id")


@query("WITH s AS (SELECT event_type AS kind, 'k' || CAST(json_extract(props, '$.k') AS VARCHAR) AS name, event_id, user_id % 7 AS domain, value / 100 AS c FROM events), g AS (SELECT kind, lower(name) AS folded, count(*) AS n_rows, count(DISTINCT event_id) AS n_episodes, count(DISTINCT domain) AS n_domains, round(avg(c), 6) AS confidence, min_by(name, event_id) AS name FROM s GROUP BY 1, 2) SELECT * FROM g WHERE n_rows >= 5 AND n_domains >= 3 AND confidence >= 0.2 AND NOT (kind = 'click' AND folded = 'k1')")
def review_candidates(spark, d):
    e = model.read(spark, d, "events")
    s = e.select(F.col("event_type").alias("kind"), F.concat(F.lit("k"), F.get_json_object("props", "$.k")).alias("name"), F.col("event_id").alias("episode_idx"), (F.col("user_id") % 7).cast("string").alias("domain"), (F.col("value") / 100).alias("confidence"))
    return evaluate.review(s, spark.createDataFrame([("click", "K1")], "kind string, name string"), 5, 3, 0.2)


@query("WITH c AS (SELECT quality, count(*) AS n FROM labels GROUP BY 1), t AS (SELECT sum(n) AS total, count(*) AS k FROM c) SELECT quality, n, round(n / total, 6) AS share, round(total / (k * n), 6) AS weight FROM c, t")
def class_balance(spark, d):
    return evaluate.class_weights(model.read(spark, d, "labels"), "quality")


@query("WITH r AS (SELECT *, row_number() OVER (PARTITION BY quality ORDER BY md5('7' || doc_id), doc_id) AS r, count(*) OVER (PARTITION BY quality) AS n FROM labels) SELECT doc_id, quality, CASE WHEN r <= greatest(floor(n * 0.2), 1) THEN 'val' ELSE 'train' END AS split FROM r")
def stratified_split(spark, d):
    return evaluate.stratified_split(model.read(spark, d, "labels"), "quality", "doc_id").select("doc_id", "quality", "split")


@query("WITH m AS (SELECT l_orderkey AS episode, l_partkey AS entity, l_linenumber AS position FROM lineitem), g AS (SELECT episode, min(entity) AS head, max(entity) AS tail FROM m GROUP BY 1) SELECT a.episode, a.entity AS head, b.entity AS tail FROM m a JOIN m b ON a.episode = b.episode AND a.position < b.position AND a.entity <> b.entity WHERE NOT EXISTS (SELECT 1 FROM g WHERE g.episode = a.episode AND least(g.head, g.tail) = least(a.entity, b.entity) AND greatest(g.head, g.tail) = greatest(a.entity, b.entity))")
def negative_pairs(spark, d):
    m = model.read(spark, d, "lineitem").select(F.col("l_orderkey").alias("episode"), F.col("l_partkey").alias("entity"), F.col("l_linenumber").alias("position"))
    return evaluate.negative_pairs(m, m.groupBy("episode").agg(F.min("entity").alias("head"), F.max("entity").alias("tail")), "episode")


@query()
def f1_greedy(spark, d):
    c = model.read(spark, d, "conversations").select("conv_id", "turn", "role", F.col("text").alias("item"))
    return evaluate.f1_greedy(c.where("role = 'user'"), c.where("role <> 'user'"), "conv_id", "item", "turn")


@query(f"WITH {_D}, r AS (SELECT relation, source_id, id, row_number() OVER (PARTITION BY relation, source_id ORDER BY valid_from, id) AS r FROM edges) SELECT relation, source_id, id FROM r WHERE r = 1")
def first_edge_of_entity(spark, d):
    first = Window.partitionBy("relation", "source_id").orderBy(F.asc_nulls_last("valid_from"), "id")
    return model.stored_edges(spark, d).withColumn("r", F.row_number().over(first)).where("r = 1").select("relation", "source_id", "id")


_STOP = ", ".join(f"'{w}'" for w in questions.STOP_WORDS)
_CLEAN = "trim(regexp_replace(regexp_replace({}, '[^\\p{{L}}\\p{{N}}_ ]', ' ', 'g'), ' +', ' ', 'g'))"
_RUNS = f"""{_N}, ew AS (SELECT id, name, string_split(lower({_CLEAN.format("name")}), ' ') AS w FROM entities),
 er AS (SELECT id, name, len(w) AS n, unnest(list_distinct(flatten(list_transform(range(1, 6), lambda n: list_transform(range(1, len(w) - n + 2), lambda i: array_to_string(w[i:i + n - 1], ' ')))))) AS run FROM ew),
 eb AS (SELECT run, id, name FROM er QUALIFY row_number() OVER (PARTITION BY run ORDER BY (len(string_split(run, ' ')) <> n), n, id) = 1),
 q AS (SELECT s_suppkey AS qid, 'which nation is ' || s_name || ' located in?' AS question FROM supplier),
 qw AS (SELECT qid, question, string_split(rtrim(question, '?'), ' ') AS w FROM q),
 qs AS (SELECT qid, w, unnest(flatten(list_transform(range(1, 6), lambda n: list_transform(range(1, len(w) - n + 2), lambda i: {{'n': n, 'i': i, 's': array_to_string(w[i:i + n - 1], ' ')}})))) AS s FROM qw),
 hit AS (SELECT qid, w, s.n AS n, s.i AS i, eb.id, eb.name FROM qs JOIN eb ON eb.run = lower({_CLEAN.format("s.s")}) WHERE len(list_filter(string_split(lower(s.s), ' '), lambda x: NOT list_contains([{_STOP}], x))) > 0
 QUALIFY row_number() OVER (PARTITION BY qid ORDER BY s.n DESC, s.i) = 1)"""


def _asked(spark, d):
    s = model.read(spark, d, "supplier")
    return s.select(F.col("s_suppkey").alias("qid"), F.concat(F.lit("which nation is "), "s_name", F.lit(" located in?")).alias("question"))


@query(f"WITH {_RUNS} SELECT qid, id AS entity_id, name AS entity, array_to_string(w[1:i - 1] || w[i + n:], ' ') AS verb FROM hit")
def ngram_link(spark, d):
    return questions.link(_asked(spark, d), model.entities(spark, d)).drop("question")


@query(f"WITH {_D}, {_RUNS} SELECT qid, target_id AS neighbor_id, e.name AS neighbor FROM hit JOIN edges ON source_id = hit.id AND relation = 'located_at' AND valid_until IS NULL JOIN entities e ON e.id = target_id")
def question_answers(spark, d):
    n = model.entities(spark, d)
    linked = questions.link(_asked(spark, d), n).withColumn("relation", F.lit("located_at"))
    return questions.answers(linked, model.stored_edges(spark, d), n).select("qid", "neighbor_id", "neighbor")


_MARKERS = " OR ".join(f"contains(lower(text), '{m}')" for m in questions.COMPLEX_MARKERS)


@query(f"SELECT doc_id, ({_MARKERS} OR length(regexp_replace(text, '[^,]', '', 'g')) >= 2) AS complex FROM documents")
def complex_questions(spark, d):
    return model.read(spark, d, "documents").select("doc_id", questions.is_complex(F.col("text")).alias("complex"))


@query(f"WITH r AS (SELECT 'r' || vec_id AS name, embedding AS y FROM embeddings WHERE vec_id < 10), p AS (SELECT vec_id, name, {_COS} AS score FROM (SELECT vec_id, embedding AS x, name, y FROM embeddings, r)), o AS (SELECT *, row_number() OVER (PARTITION BY vec_id ORDER BY score DESC, name) AS k FROM p) SELECT a.vec_id, a.name AS relation, a.score, b.name AS runner_up, b.score AS runner_up_score FROM o a JOIN o b ON a.vec_id = b.vec_id AND a.k = 1 AND b.k = 2")
def relation_match(spark, d):
    v = model.read(spark, d, "embeddings")
    vocabulary = {f"r{r['vec_id']}": list(r["embedding"]) for r in v.where("vec_id < 10").collect()}
    return v.select("vec_id", questions.match_relation(F.col("embedding"), vocabulary).alias("m")).select("vec_id", "m.*")


@query("WITH t AS (SELECT c_custkey AS id, c_name AS head, p_name AS tail, length(c_name) AS n FROM customer JOIN part ON c_custkey = p_partkey) SELECT id, head, 'chose' AS relation, tail, round(0.65 / (1 + ((n + 3) + 4) / 2.0 / 50) * (1 + CASE WHEN regexp_matches(tail, '^\\p{Lu}') THEN 1 WHEN regexp_matches(tail, '\\p{N}') THEN 0.95 ELSE 0.75 END) / 2 * 1.4, 6) AS confidence FROM t")
def relations_heuristic(spark, d):
    c = model.read(spark, d, "customer").join(model.read(spark, d, "part"), F.col("c_custkey") == F.col("p_partkey"))
    texts = c.select(F.col("c_custkey").alias("id"), F.concat("c_name", F.lit(" chose "), "p_name", F.lit(". It was late.")).alias("text"))
    heads = c.select(F.col("c_custkey").alias("id"), F.col("c_name").alias("name"), F.lit("Person").alias("entity_type"), F.lit(0).alias("start"))
    tails = c.select(F.col("c_custkey").alias("id"), F.col("p_name").alias("name"), F.lit("Component").alias("entity_type"), (F.length("c_name") + 7).alias("start"))
    return relations.relations(texts, heads.unionByName(tails))


@query("SELECT s_suppkey, n_name AS text, 'Nation' AS entity_type, 9 AS start, CAST(9 + length(n_name) AS INTEGER) AS \"end\", 0.85 AS confidence FROM supplier JOIN nation ON s_nationkey = n_nationkey UNION ALL SELECT s_suppkey, r_name, 'Region', CAST(15 + length(n_name) AS INTEGER), CAST(15 + length(n_name) + length(r_name) AS INTEGER), 0.85 FROM supplier JOIN nation ON s_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey")
def dictionary_scan(spark, d):
    s, n, r = (model.read(spark, d, x) for x in ("supplier", "nation", "region"))
    names = {x["n_name"]: "Nation" for x in n.select("n_name").collect()} | {x["r_name"]: "Region" for x in r.select("r_name").collect()}
    rows = s.join(F.broadcast(n), F.col("s_nationkey") == F.col("n_nationkey")).join(F.broadcast(r), F.col("n_regionkey") == F.col("r_regionkey"))
    text_of = F.concat(F.lit("ships to "), "n_name", F.lit(" from "), "r_name")
    return rows.select("s_suppkey", F.explode(extract.dictionary_mentions(text_of, names)).alias("m")).select("s_suppkey", "m.*")


@query("SELECT n_nationkey, n_name AS head, 'part_of' AS relation, r_name AS tail, 0.7 AS confidence, true AS resolved FROM nation JOIN region ON n_regionkey = r_regionkey UNION ALL SELECT n_nationkey, n_name, 'near', 'e9', 1.0, false FROM nation JOIN region ON n_regionkey = r_regionkey")
def envelope_relations(spark, d):
    rows = model.read(spark, d, "nation").join(model.read(spark, d, "region"), F.col("n_regionkey") == F.col("r_regionkey"))
    raw = F.concat(F.lit('```json {"entities": [{"id": "e1", "name": "'), "n_name", F.lit('"}, {"id": "e2", "name": "'), "r_name", F.lit('"}], "relations": [{"head": "e1", "relation": "part_of", "tail": "e2", "confidence": 0.7}, {"head": "e1", "relation": "near", "tail": "e9"}]} ```'))
    return envelope.named_relations(rows.select("n_nationkey", envelope.parse(raw).alias("e")), "n_nationkey", "e")


_PAIRS = "p AS (SELECT DISTINCT l_partkey AS head, l_suppkey AS tail, CASE l_linenumber % 3 WHEN 0 THEN 'a' WHEN 1 THEN 'b' ELSE 'c' END AS relation FROM lineitem)"


def _positives(spark, d):
    kind = F.when(F.col("l_linenumber") % 3 == 0, "a").when(F.col("l_linenumber") % 3 == 1, "b").otherwise("c")
    return model.read(spark, d, "lineitem").select(F.col("l_partkey").alias("head"), F.col("l_suppkey").alias("tail"), kind.alias("relation")).distinct()


@query(f"WITH {_PAIRS} SELECT p.tail AS head, p.head AS tail, 'none' AS relation FROM p WHERE NOT EXISTS (SELECT 1 FROM p t WHERE t.head = p.tail AND t.tail = p.head)")
def reversed_negatives(spark, d):
    return evaluate.reversed_negatives(_positives(spark, d))


@query(f"WITH {_PAIRS} SELECT head, tail, list_filter(['a', 'b', 'c'], lambda x: x <> relation)[CAST(CAST('0x' || substr(md5('7|' || head || '|' || tail), 1, 8) AS BIGINT) % 2 AS INTEGER) + 1] AS relation FROM p")
def near_misses(spark, d):
    return evaluate.near_misses(_positives(spark, d), ("a", "b", "c"))


@query("WITH c AS (SELECT n_regionkey AS label, count(*) AS n FROM nation GROUP BY 1) SELECT n_nationkey, n_regionkey, unnest(range(0, CAST(greatest(ceil(20 / n), 1) AS BIGINT))) AS copy FROM nation JOIN c ON label = n_regionkey")
def augmented_classes(spark, d):
    return evaluate.augmented(model.read(spark, d, "nation").select("n_nationkey", "n_regionkey"), "n_regionkey", 20)


@query("WITH r AS (SELECT doc_id, CASE WHEN quality = 1 THEN 'good' WHEN toxic = 1 THEN 'toxic' ELSE 'none' END AS label, doc_id % 2 AS priority FROM labels), m AS (SELECT CAST(floor(0.2 * avg(n)) AS BIGINT) AS most FROM (SELECT count(*) AS n FROM r WHERE label <> 'none' GROUP BY label)), k AS (SELECT *, row_number() OVER (ORDER BY priority, md5('7' || doc_id), doc_id) AS i FROM r WHERE label = 'none') SELECT doc_id, label, priority FROM r WHERE label <> 'none' UNION ALL SELECT doc_id, label, priority FROM k, m WHERE i <= most")
def capped_none(spark, d):
    kind = F.when(F.col("quality") == 1, "good").when(F.col("toxic") == 1, "toxic").otherwise("none")
    rows = model.read(spark, d, "labels").select("doc_id", kind.alias("label"), (F.col("doc_id") % 2).alias("priority"))
    return evaluate.capped(rows, "label", "doc_id", times=0.2)
