"""Canonical names and types of entities, as Column expressions over small vocabularies."""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Generic last words, and names that keep theirs.
SUFFIXES = (
    " architecture", " framework", " component", " approach", " protocol", " library", " modules", " pattern", " service", " system", " module", " model",
)
PRESERVED = (
    "saga pattern", "circuit breaker", "strangler fig", "sliding window", "service mesh", "API gateway", "feature flag", "CAP theorem", "isolation level", "exponential backoff", "load shedding",
    "rate limiting", "long polling", "A/B testing", "event sourcing",
)
#: Products that packages belong to.
PACKAGES = {
    "stripe-node": "Stripe", "stripe": "Stripe", "express": "Express", "fastify": "Fastify", "next": "Next.js", "react": "React", "vue": "Vue", "angular": "Angular", "django": "Django", "flask": "Flask",
    "fastapi": "FastAPI", "rails": "Rails", "spring-boot": "Spring Boot", "tokio": "tokio", "actix-web": "Actix", "deadpool-postgres": "deadpool-postgres", "pg": "Postgres", "mysql2": "MySQL",
    "redis": "Redis", "mongoose": "MongoDB",
}
#: Endings that a model adds to a name.
ANSWER_SUFFIXES = (" LMS", " EHR", " CRM", " APIs", " API", " system", " systems", " platform", " platforms")
#: Parts of a name that speak of a metric or of a constraint.
METRIC_UNITS = ("ms", "qps", "gb", "mb", "rps")
METRIC_TERMS = (
    "latency", "throughput", "error rate", "cpu", "memory", "p50", "p95", "p99", "ttfb", "gc pause", "build time", "file descriptor", "max connection", "race condition", "memory leak",
)
CONSTRAINT_TERMS = (
    "sla", "slo", "compliance", "consistency", "guarantee", "zero-trust", "least privilege", "backward compat", "exactly-once", "at-least-once", "at-most-once",
)
#: Names whose type is known, in order of precedence. Larger vocabularies are a parameter of ``retyped``.
KNOWN_TYPES: dict[str, tuple[str, ...]] = {
    "Database": (
        "Postgres", "PostgreSQL", "MySQL", "MongoDB", "Redis", "Elasticsearch", "Cassandra", "DynamoDB", "CockroachDB", "SQLite", "Aurora", "Solr", "TimescaleDB", "MariaDB", "Neo4j", "InfluxDB",
        "ClickHouse", "Memcached", "RocksDB", "Vitess", "PlanetScale", "Supabase", "Firestore", "BigQuery", "Redshift", "Snowflake",
    ),
    "Constraint": (
        "ACID", "compliance", "zero-trust", "least privilege", "backward compatibility", "memory safety", "Eventual consistency", "Strong consistency", "exactly-once delivery",
        "exactly-once guarantees", "GDPR", "SOC2", "HIPAA", "PCI-DSS", "SLA", "SLO", "SLI", "idempotency", "at-least-once", "at-most-once", "CAP theorem", "linearizability", "serializability",
        "isolation level",
    ),
    "Component": (
        "OpenTelemetry", "Resilience4j", "SQLAlchemy", "PgBouncer", "Flyway", "Pandas", "LaunchDarkly", "Apollo Router", "CDN", "IAM", "ORM", "Monolith", "Validator", "API Gateway", "SLO Dashboard",
        "Scheduler",
    ),
    "Language": (
        "Python", "Rust", "Go", "Java", "TypeScript", "JavaScript", "Kotlin", "C++", "C#", "Ruby", "Scala", "Elixir", "Haskell", "Swift", "Dart", "PHP", "Perl", "Lua", "Zig", "Clojure",
    ),
}


def _ends(name: Column, endings: tuple[str, ...]) -> Column:
    """The first ending, in the given order, that the name has; null without one."""
    return F.coalesce(*[F.when(F.endswith(name, F.lit(e)), F.lit(e)) for e in endings])


def _without(name: Column, ending: Column) -> Column:
    return F.substring(name, F.lit(1), F.length(name) - F.length(ending))


def without_suffix(name: Column, known: tuple[str, ...] = (), suffixes: tuple[str, ...] = SUFFIXES, preserved: tuple[str, ...] = PRESERVED) -> Column:
    """``name`` without a generic last word, if what remains is one of ``known`` or begins with a capital."""
    lower = F.lower(name)
    known_lower = [k.lower() for k in known]

    def shorter(ending: str) -> Column:
        rest = _without(name, F.lit(ending))
        fits = F.lower(rest).isin(*known_lower) | rest.rlike(r"^\p{Lu}") if known else rest.rlike(r"^\p{Lu}")
        return F.when(F.endswith(lower, F.lit(ending)) & (F.length(rest) > 0) & fits, rest)

    return F.when(lower.isin(*[p.lower() for p in preserved]), name).otherwise(F.coalesce(*[shorter(s) for s in suffixes], name))


def product_name(name: Column, packages: Mapping[str, str] = PACKAGES) -> Column:
    """No package scope, no version, the product of a known package; else no closing ``SDK``, ``CLI`` or ``client``."""
    bare = F.regexp_replace(name, "^@[^/]*/", "")
    bare = F.regexp_replace(bare, "(?s)^([^@]*)@(?=[0-9v]).*$", "$1")
    bare = F.regexp_replace(bare, r"(?s) v?[0-9][^ ]*$", "")
    table = F.create_map(*[F.lit(x) for k, v in packages.items() for x in (k, v)])
    ending = _ends(bare, (" SDK", " sdk", " CLI", " cli", " client", " Client"))
    short = F.when(ending.isNotNull() & (F.length(bare) > F.length(ending) + 2), _without(bare, ending)).otherwise(bare)
    return F.coalesce(F.try_element_at(table, F.lower(bare)), short)


def canonical(mentions: Column, known: tuple[str, ...] = ()) -> Column:
    """Mentions (text, start, ..) with product names and without generic last words; ``end`` follows the new length."""

    def renamed(m: Column) -> Column:
        text = without_suffix(product_name(m["text"]), known)
        return m.withField("end", F.when(text == m["text"], m["end"]).otherwise((m["start"] + F.length(text)).cast("int"))).withField("text", text)

    return F.transform(mentions, renamed)


def is_metric(name: Column) -> Column:
    lower = F.lower(name)
    return lower.rlike(f"({'|'.join(METRIC_UNITS)})$") | lower.rlike("|".join(METRIC_TERMS))


def is_constraint(name: Column) -> Column:
    return F.lower(name).rlike("|".join(CONSTRAINT_TERMS))


def retyped(name: Column, entity_type: Column, vocabulary: Mapping[str, str] | None = None) -> Column:
    """The type of a known name, else by ending, metric and constraint words; else ``entity_type``.

    ``vocabulary`` (name to type, bounded by what a plan can hold as a literal) goes before the names known here. The
    metric rule is by letters alone: a name that ends in ``ms``, such as ``teams``, is a metric.
    """
    table = {n: kind for kind, names in KNOWN_TYPES.items() for n in names} | dict(vocabulary or {})
    known = F.try_element_at(F.create_map(*[F.lit(x) for k, v in table.items() for x in (k, v)]), name)
    service = name.rlike("(Service|Provider)$")
    return F.coalesce(known, F.when(service, "Service").when(is_metric(name), "Metric").when(is_constraint(name), "Constraint").otherwise(entity_type))


def answer_name(name: Column, text: Column) -> Column:
    """A model's name for an entity as the text spells it: no articles, possessives, or endings that the text lacks."""
    bare = F.regexp_replace(F.regexp_replace(F.regexp_replace(name, "^[Tt]he ", ""), "^[Aa] ", ""), "^[Aa]n ", "")
    bare = F.replace(bare, F.lit("'s "), F.lit(" "))
    said = lambda x: F.contains(F.lower(text), F.lower(x))

    def shorter(ending: str) -> Column:
        rest = _without(bare, F.lit(ending))
        return F.when(F.endswith(bare, F.lit(ending)) & (F.length(rest) >= 3) & said(rest), rest)

    short = F.coalesce(*[shorter(e) for e in ANSWER_SUFFIXES], bare)
    return F.when(~said(short) & said(name), name).otherwise(short)


#: Relation of this schema that a free name of another system speaks of; the first that fits.
FREE_RELATIONS = (
    ("CHOSE|CHOOSE|SELECTED|DECIDED_TO_USE|DECIDED_TO_ADOPT|PROPOSED_ADOPTING|CHOSE_FOR|CHOOSES_AS", "chose"),
    ("REJECTED|DOES_NOT_CHOOSE|DID_NOT_CHOOSE|REJECTS", "rejected"),
    ("REPLACED|MIGRATED_TO|MIGRATED_FROM|REWRITTEN_TO|REWRITTEN_FROM|WAS_REWRITTEN|CONVERTED_TO|UPGRADED_TO|UPGRADED_FROM|SWITCHED_FROM|SWITCHED_TO|WAS_CONVERTED", "replaced"),
    ("DEPENDS_ON|USES|BACKED_BY|CONNECTS_TO|INTEGRATED_IN|INTEGRATED_WITH|IS_MANAGED_BY|USES_LIBRARY|RUNS_ON|ENABLED_ON|PERSISTED_TO|PROVISION_ON|LEVERAGES|ROUTES_TRAFFIC_TO", "depends_on"),
    ("FIXED|IDENTIFIED_MISSING|PATCHED|RESOLVED|RESOLVED_BY", "fixed"),
    ("INTRODUCED|ADDED_TO|IMPLEMENTED|ENABLED_AT|IMPLEMENTS_PATTERN|USES_PATTERN|PROPOSED", "introduced"),
    ("DEPRECATED|FORBIDDEN|STOPPED_USING|IS_FORBIDDEN", "deprecated"),
    ("CAUSED|IMPROVED_BY|CRASHES_WHEN|SPIKED_AFTER|AFFECTED|RESULTS_IN|REDUCED|IMPROVED|LED_TO", "caused"),
    ("CONSTRAINED_BY|MUST_COMPLY|MANDATED|REQUIRES|ENFORCES|HAS_CONSTRAINT|SCOPED_PER|CAPPED_AT", "constrained_by"),
)


def mapped_relation(name: Column) -> Column:
    """The schema's relation for a free relation name; null if none fits."""
    upper = F.replace(F.upper(name), F.lit(" "), F.lit("_"))
    return F.coalesce(*[F.when(upper.rlike(pattern), F.lit(relation)) for pattern, relation in FREE_RELATIONS])


def short_id(key: Column, length: int = 8) -> Column:
    return F.substring(key, 1, length)
