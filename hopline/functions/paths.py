"""Path lineage helpers (P1-P7) as Column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from hopline.schema import PATH_MESSAGE


def append_element(path: Column, element: Column) -> Column:
    """A new path with ``element`` at the end."""
    return F.concat(path, F.array(element))


def path_string(path: Column, sep: str = ">") -> Column:
    """``>``-joined (metrics) or space-joined (grouping key)."""
    return F.array_join(path, sep)


def endpoint_parts(path: Column, first: bool = True) -> Column:
    """P5: the first or last element split on ``:`` (all parts kept)."""
    el = F.try_element_at(path, F.lit(1 if first else -1))
    return F.split(el, ":", -1)


def endpoint_component(path: Column, first: bool = True) -> Column:
    return F.try_element_at(endpoint_parts(path, first), F.lit(1))


def endpoint_task(path: Column, first: bool = True) -> Column:
    """Task id of an endpoint as bigint; NULL when not an integer."""
    return F.try_element_at(endpoint_parts(path, first), F.lit(2)).try_cast("bigint")


def spout_task(path: Column) -> Column:
    """The integer after ``:`` in element 0."""
    return endpoint_task(path, first=True)


def payload_struct(message_id: Column, origin: Column, latency: Column, path: Column) -> Column:
    return F.struct(
        message_id.alias("messageID"),
        origin.cast("bigint").alias("originTimestamp"),
        latency.cast("double").alias("stormMilliLatencyMs"),
        path.alias("path"),
    )


def to_payload(message_id: Column, origin: Column, latency: Column, path: Column) -> Column:
    """JSON text in declared field order (edges only)."""
    return F.to_json(payload_struct(message_id, origin, latency, path))


def to_json_fields(**fields: Column) -> Column:
    """JSON of the given payload fields only, in declared field order (fixtures)."""
    order = [f.name for f in PATH_MESSAGE.fields]
    return F.to_json(F.struct(*[fields[k].alias(k) for k in order if k in fields]))


def json_values(text: Column) -> Column:
    """The JSON values of ``text`` as an array of variants, by one parse; NULL for malformed text.

    The text is read as the inside of an array: text after the object, a second object and single quotes make it malformed or longer.
    """
    return F.try_variant_get(F.try_parse_json(F.concat(F.lit("["), text, F.lit("]"))), "$", "array<variant>")


def json_object(values: Column) -> Column:
    """The JSON object that ``values`` (of ``json_values``) is, and nothing else; NULL otherwise."""
    one = F.get(values, F.lit(0))
    return F.when((F.size(values) == 1) & F.startswith(F.schema_of_variant(one), F.lit("OBJECT")), one)


def _field(value: Column, name: str) -> Column:
    return F.try_variant_get(value, f"$.{name}", "variant")


def _kind(value: Column, name: str) -> Column:
    return F.schema_of_variant(_field(value, name))


def payload_fields(value: Column) -> Column:
    """The typed payload struct of a JSON object (a variant); a field of another JSON type is NULL.

    An origin time is a whole number, a latency any number, a path an array; other values of messageID become text.
    """
    return F.struct(
        F.try_variant_get(value, "$.messageID", "string").alias("messageID"),
        F.when(_kind(value, "originTimestamp") == "BIGINT", F.try_variant_get(value, "$.originTimestamp", "bigint")).alias("originTimestamp"),
        F.when(_kind(value, "stormMilliLatencyMs").rlike("^(BIGINT|DOUBLE|FLOAT|DECIMAL)"), F.try_variant_get(
            value, "$.stormMilliLatencyMs", "double")).alias("stormMilliLatencyMs"),
        F.when(_kind(value, "path").startswith("ARRAY<"), F.try_variant_get(value, "$.path", "array<string>")).alias("path"),
    )


def parse_payload(text: Column) -> Column:
    """Typed struct; NULL for text that is not one JSON object."""
    value = json_object(json_values(text))
    return F.when(value.isNotNull(), payload_fields(value))


def strings_only(value: Column) -> Column:
    """Whether the elements of ``path`` in a JSON object (a variant) are all strings (or null, which the typed path shows)."""
    return F.coalesce(_kind(value, "path").isin("ARRAY<STRING>", "ARRAY<VOID>"), F.lit(False))
