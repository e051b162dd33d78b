"""Schemas and settings in TOML: read, written and cached on the driver; a schema is a vocabulary of tens of names."""

from __future__ import annotations

import json
import os
import tomllib
from dataclasses import dataclass, field
from itertools import product

from pyspark.sql import DataFrame, SparkSession

from ..operators.relations import SCHEMA


class SchemaError(ValueError):
    """A schema file that does not say what a schema must."""


@dataclass(frozen=True)
class Schema:
    name: str
    entity_types: dict[str, str]
    relations: dict[str, tuple[tuple[str, ...], tuple[str, ...], str]]
    settings: dict = field(default_factory=dict)

    def allowed(self, spark: SparkSession) -> DataFrame:
        """(relation, head_type, tail_type), one row for each pair of types a relation may join."""
        rows = [(r, h, t) for r, (heads, tails, _) in sorted(self.relations.items()) for h, t in product(heads, tails)]
        return spark.createDataFrame(rows, "relation string, head_type string, tail_type string")


#: What the types of the default schema mean.
DEFAULT_TYPES = {
    "Person": "person, team, or role", "Component": "software, tool, or product", "Service": "service, platform, or API", "Language": "programming language",
    "Database": "database or data store", "Infrastructure": "server, hardware, or cloud platform", "Decision": "decision or policy",
    "Constraint": "constraint or requirement", "Metric": "metric or measurement", "Pattern": "pattern or methodology",
}


def default_schema() -> Schema:
    return Schema("default", DEFAULT_TYPES, {r: (h, t, r.replace("_", " ")) for r, (h, t) in SCHEMA.items()})


def parse_schema(text: str) -> Schema:
    """Constrained (``relations`` are tables with head and tail) or flat (relations are descriptions: every type fits)."""
    try:
        raw = tomllib.loads(text)
    except tomllib.TOMLDecodeError as e:
        raise SchemaError(str(e)) from e
    body = raw.get("schema", raw)
    types = {k: v if isinstance(v, str) else v.get("description", k) for k, v in (body.get("entities") or body.get("entity_types") or {}).items()}
    if not types:
        raise SchemaError("no entity types")
    every = tuple(sorted(types))
    relations = {}
    for name, spec in (body.get("relations") or body.get("relation_types") or {}).items():
        if isinstance(spec, str):
            relations[name] = (every, every, spec)
            continue
        heads, tails = tuple(spec.get("head", every)), tuple(spec.get("tail", every))
        unknown = sorted({*heads, *tails} - set(types))
        if unknown:
            raise SchemaError(f"{name} names types that are not declared: {', '.join(unknown)}")
        relations[name] = (heads, tails, spec.get("description", name))
    settings = {k: raw[k] for k in ("llm", "extraction") if k in raw}
    settings.setdefault("extraction", {}).setdefault("confidence_threshold", 0.5)
    return Schema(str(body.get("name", "schema")), types, relations, settings)


def to_toml(schema: Schema) -> str:
    text = lambda x: json.dumps(x, ensure_ascii=False)
    lines = ["[schema]", f"name = {text(schema.name)}", "", "[schema.entities]"]
    lines += [f"{text(k)} = {text(v)}" for k, v in sorted(schema.entity_types.items())]
    for name, (heads, tails, about) in sorted(schema.relations.items()):
        lines += ["", f"[schema.relations.{text(name)}]", f"head = {text(list(heads))}", f"tail = {text(list(tails))}", f"description = {text(about)}"]
    return "\n".join(lines) + "\n"


def cached_schema(folder: str) -> Schema:
    """``schema.toml`` of a store's folder; the default where it is missing or cannot be read."""
    try:
        with open(os.path.join(folder, "schema.toml"), encoding="utf-8") as f:
            return parse_schema(f.read())
    except (OSError, SchemaError):
        return default_schema()
