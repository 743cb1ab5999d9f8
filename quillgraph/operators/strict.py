"""Closed JSON schemas: what a reply may not add, leave out or say otherwise, as column expressions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def closed(schema: dict) -> dict:
    """A JSON schema in which no object takes keys beside its own, at any depth; the given one isn't changed."""
    out = {k: closed(v) if isinstance(v, dict) else [closed(x) if isinstance(x, dict) else x for x in v] if isinstance(v, list) else v for k, v in schema.items()}
    return out | {"additionalProperties": False} if out.get("type") == "object" else out


def _one(found: Column, message: Column | str) -> Column:
    return F.when(found, F.array(F.lit(message) if isinstance(message, str) else message)).otherwise(F.array().cast("array<string>"))


def _resolved(schema: dict, root: dict) -> dict:
    """What a reference within the schema stands for."""
    while "$ref" in schema:
        at = root
        for part in schema["$ref"].removeprefix("#/").split("/"):
            at = at[part]
        schema = at
    return schema


def problems(raw: Column | str, schema: dict, root: dict | None = None, path: str = "$") -> Column:
    """What is wrong with JSON text under a schema, as an array of ``path: problem``; empty if nothing is.

    Understands objects with properties, required and additionalProperties,
    arrays with items, strings, numbers, integers, booleans, enum, and
    references within the schema that don't go round. A null, or no JSON, is ``not JSON``.
    JSON's null counts as absent.
    """
    text, root = (F.col(raw) if isinstance(raw, str) else raw), root or schema
    schema = _resolved(schema, root)
    kind = schema.get("type")
    start = F.substring(F.ltrim(text), 1, 1)
    if kind == "object":
        fields, own = F.from_json(text, "map<string,string>"), schema.get("properties", {})
        keys = F.map_keys(F.map_filter(fields, lambda k, v: v.isNotNull()))
        names = F.array(*map(F.lit, own)).cast("array<string>") if own else F.array().cast("array<string>")
        required = schema.get("required", [])
        parts = [F.transform(F.array_except(F.array(*map(F.lit, required)), keys), lambda k: F.concat(F.lit(f"{path}."), k, F.lit(": missing")))] if required else []
        if schema.get("additionalProperties") is False:
            parts.append(F.transform(F.array_except(F.map_keys(fields), names), lambda k: F.concat(F.lit(f"{path}."), k, F.lit(": not in the schema"))))
        for name, inner in own.items():
            value = F.element_at(fields, F.lit(name))
            parts.append(F.when(value.isNotNull(), problems(value, inner, root, f"{path}.{name}")).otherwise(F.array().cast("array<string>")))
        inside = F.concat(*parts) if parts else F.array().cast("array<string>")
        wrong = fields.isNull() | (start != "{") | text.isNull()
        return F.when(F.coalesce(wrong, F.lit(True)), F.array(F.lit(f"{path}: not " + ("JSON" if path == "$" else "an object")))).otherwise(inside)
    if kind == "array":
        items = F.from_json(text, "array<string>")
        inside = F.flatten(F.transform(items, lambda x: F.when(x.isNull(), F.array(F.lit(f"{path}[]: missing"))).otherwise(problems(x, schema.get("items", {}), root, f"{path}[]"))))
        return F.when(F.coalesce(items.isNull() | (start != "["), F.lit(True)), F.array(F.lit(f"{path}: not an array"))).otherwise(inside)
    if "enum" in schema:
        return _one(~text.isin([str(v) for v in schema["enum"]]), F.concat(F.lit(f"{path}: not one of the values: "), text))
    if kind == "integer":
        return _one(~text.rlike(r"^-?\d+$"), f"{path}: not an integer")
    if kind == "number":
        return _one(text.try_cast("double").isNull(), f"{path}: not a number")
    if kind == "boolean":
        return _one(~text.isin("true", "false"), f"{path}: not a boolean")
    return F.array().cast("array<string>")


def checked(rows: DataFrame, column: str, schema: dict, result: str) -> DataFrame:
    """rows with ``parsed`` (column as the DDL type ``result``) and ``problems``; parsed is null where there are any."""
    found = rows.withColumn("problems", F.array_distinct(problems(column, closed(schema))))
    return found.withColumn("parsed", F.when(F.size("problems") == 0, F.from_json(column, result)))


def quarantined(rows: DataFrame, column: str, schema: dict, result: str) -> tuple[DataFrame, DataFrame]:
    """(rows that hold, with ``parsed``; rows that don't, with their ``problems``)."""
    every = checked(rows, column, schema, result)
    return every.filter(F.size("problems") == 0).drop("problems"), every.filter(F.size("problems") > 0).drop("parsed")
