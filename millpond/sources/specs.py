"""Table schemas from an OpenAPI v3 document. Runs on the driver, once per connector."""

from __future__ import annotations

from pyspark.sql import types as T

STRING_FORMATS = {"date-time": T.TimestampNTZType(), "date": T.DateType()}
SCALARS = {"integer": T.LongType(), "number": T.DecimalType(38, 10), "boolean": T.BooleanType()}


def resource_names(spec: dict) -> list[str]:
    return list(spec.get("components", {}).get("schemas", {}))


def _resolve(spec: dict, node: dict) -> dict:
    seen = set()
    while "$ref" in node:
        ref = node["$ref"]
        if ref in seen:
            return {}
        seen.add(ref)
        node = spec
        for step in ref.lstrip("#/").split("/"):
            node = node.get(step, {})
    return node


def _members(spec: dict, node: dict) -> list[dict]:
    """The nodes whose columns make up a node: itself without ``allOf``, else those of its members, then its own part."""
    node = _resolve(spec, node)
    if "allOf" not in node:
        return [node]
    return [leaf for member in node["allOf"] for leaf in _members(spec, member)] + [{k: v for k, v in node.items() if k != "allOf"}]


def merged(spec: dict, node: dict) -> dict:
    """The node with references followed and all members of ``allOf`` joined, base columns included.

    A later member's column replaces an earlier one. The description is that of the node, else of its first member that
    has one.
    """
    parts = _members(spec, node)
    if len(parts) == 1:
        return parts[0]
    told = [p["description"] for p in (parts[-1], *parts[:-1]) if p.get("description")]
    return {
        "type": "object",
        "properties": {name: column for p in parts for name, column in p.get("properties", {}).items()},
        "required": list(dict.fromkeys(name for p in parts for name in p.get("required", []))),
        **({"description": told[0]} if told else {}),
    }


def find_schema(spec: dict, name: str) -> dict | None:
    """By name, else by title."""
    schemas = spec.get("components", {}).get("schemas", {})
    if name in schemas:
        return merged(spec, schemas[name])
    for node in schemas.values():
        if node.get("title") == name:
            return merged(spec, node)
    return None


def _refs(spec: dict, node: dict) -> set[str]:
    """All references that are followed to get at a node."""
    found = set()
    while "$ref" in node and node["$ref"] not in found:
        found.add(node["$ref"])
        target = spec
        for step in node["$ref"].lstrip("#/").split("/"):
            target = target.get(step, {})
        node = target
    for member in node.get("allOf", []):
        found |= {m["$ref"] for m in [member] if "$ref" in m}
    return found


def spark_type(spec: dict, node: dict, above: frozenset[str] = frozenset()) -> T.DataType:
    """Declared type to Spark type, however deep it nests. What refers to itself is kept as JSON text."""
    own = _refs(spec, node)
    if own & above:
        return T.StringType()
    above |= own
    node = merged(spec, node)
    kind = node.get("type")
    if kind == "string":
        return STRING_FORMATS.get(node.get("format"), T.StringType())
    if kind in SCALARS:
        return SCALARS[kind]
    if kind == "array":
        items = node.get("items")
        return T.ArrayType(spark_type(spec, items, above)) if items else T.VariantType()
    if kind == "object" or "properties" in node:
        properties = node.get("properties")
        if properties:
            return T.StructType([T.StructField(n, spark_type(spec, p, above)) for n, p in properties.items()])
        extra = node.get("additionalProperties")
        if isinstance(extra, dict):
            return T.MapType(T.StringType(), spark_type(spec, extra, above))
        return T.VariantType()
    return T.StringType()


def resource_schema(spec: dict, name: str) -> T.StructType:
    """Columns with their descriptions as comments; empty for an unknown name."""
    node = find_schema(spec, name)
    if node is None:
        return T.StructType([])
    fields = []
    for column, declared in node.get("properties", {}).items():
        text = _resolve(spec, declared).get("description") or declared.get("description")
        fields.append(
            T.StructField(column, spark_type(spec, declared), True, {"comment": text} if text else None)
        )
    return T.StructType(fields)


def required_columns(spec: dict, name: str) -> list[str]:
    return list((find_schema(spec, name) or {}).get("required", []))


def time_columns(spec: dict, name: str) -> list[str]:
    """Columns that hold a time: by format, or text named like one. A boolean never is."""
    node = find_schema(spec, name) or {}
    out = []
    for column, declared in node.get("properties", {}).items():
        kind = merged(spec, declared)
        dated = kind.get("format") in STRING_FORMATS
        named = kind.get("type") == "string" and any(w in column.lower() for w in ("date", "time"))
        if dated or named:
            out.append(column)
    return out
