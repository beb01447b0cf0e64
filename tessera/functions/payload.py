"""Payload union: text projection, JSON codec, field rules."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tessera.functions.text import json_number
from tessera.schemas import PAYLOAD

# Fixed values: (required, optional) fields of each payload kind, in declared order.
FIELDS: dict[str, tuple[list[str], list[str]]] = {
    "note": (["body"], []),
    "observation": (["statement"], ["observed_at"]),
    "decision": (["choice"], ["question", "rationale", "decided_at"]),
    "idea": (["proposal"], []),
    "snippet": (["language", "code", "origin"], ["runtime", "dependencies"]),
    "metric": (["name", "value", "unit", "dimensions"], ["observed_at", "interval", "method"]),
    "evidence": (["claim"], ["action", "outcome", "impact"]),
}
# Order of the fields in encoded and projected text.
ORDER = [f.name for f in PAYLOAD.fields if f.name != "kind"]
MAIN_TEXT = {
    "note": "body",
    "observation": "statement",
    "decision": "choice",
    "idea": "proposal",
    "snippet": "code",
    "metric": "method",
    "evidence": "claim",
}
_METRIC_ORDER = ["name", "value", "unit", "observed_at", "interval", "dimensions", "method"]


def fields_of(kind: str) -> list[str]:
    """All fields of a kind in declared order."""
    if kind == "metric":
        return _METRIC_ORDER
    required, optional = FIELDS[kind]
    return required + optional


def _sorted_map(m: Column) -> Column:
    return F.array_sort(F.map_entries(m))


def _by_kind(payload: Column, build) -> Column:
    """One ``when`` branch per kind."""
    result = None
    for kind in FIELDS:
        test = payload["kind"] == kind
        result = F.when(test, build(kind)) if result is None else result.when(test, build(kind))
    return result


def payload_kind(payload: Column) -> Column:
    return payload["kind"]


def payload_text(payload: Column) -> Column:
    """Newline-joined non-null fields in declared order."""

    def parts(kind: str) -> Column:
        items = []
        for name in fields_of(kind):
            field = payload[name]
            if name == "value":
                items.append(json_number(field))
            elif name == "interval":
                items.append(F.concat(F.lit("start: "), field["start"]))
                items.append(F.concat(F.lit("end: "), field["end"]))
            elif name == "dimensions":
                items.append(
                    F.transform(_sorted_map(field), lambda e: F.concat_ws(": ", e.key, e.value))
                )
            else:
                items.append(field)
        return F.concat_ws("\n", *items)

    return _by_kind(payload, parts)


def payload_encode(payload: Column) -> Column:
    """JSON text with the fields of the payload's own kind, nulls written out."""

    def encode(kind: str) -> Column:
        items = [F.lit(kind).alias("kind")]
        for name in fields_of(kind):
            field = payload[name]
            if name == "dimensions":
                field = F.map_from_entries(_sorted_map(field))
            items.append(field.alias(name))
        return F.to_json(F.struct(*items), {"ignoreNullFields": "false"})

    return _by_kind(payload, encode)


_CHECKED = T.StructType([*PAYLOAD.fields, T.StructField("_corrupt", T.StringType())])
_KEY = r"(?:`(?:[^`]|``)*`|[^<>,:` ]+)"


def decode(
    rows: DataFrame, text: str, payload: str = "payload", error: str = "decode_error"
) -> DataFrame:
    """Add the payload struct of a JSON column, and why a text is not a payload.

    The text is parsed once per view of it; the rules then read those columns. ``from_json``
    alone would skip unknown fields and turn numbers into strings, so field names and the
    written types are looked at as well.
    """
    source = F.col(text)
    parsed = rows.withColumns(
        {
            "_raw": F.from_json(source, _CHECKED, {"columnNameOfCorruptRecord": "_corrupt"}),
            "_keys": F.json_object_keys(source),
            "_interval_keys": F.json_object_keys(F.get_json_object(source, "$.interval")),
            "_types": F.schema_of_variant(F.try_parse_json(source)),
        }
    )
    judged = parsed.withColumn(
        error, _error(F.col("_raw"), F.col("_keys"), F.col("_interval_keys"), F.col("_types"))
    )
    good = F.struct(*[F.col("_raw")[f.name].alias(f.name) for f in PAYLOAD.fields])
    return judged.withColumn(payload, F.when(F.col(error).isNull(), good)).drop(
        "_raw", "_keys", "_interval_keys", "_types"
    )


def _error(raw: Column, keys: Column, interval_keys: Column, types: Column) -> Column:
    allowed = F.create_map(
        *[
            item
            for k in FIELDS
            for item in (F.lit(k), F.array(*[F.lit(n) for n in ["kind", *fields_of(k)]]))
        ]
    )
    known = F.try_element_at(allowed, raw["kind"])
    missing = F.lit(False)
    for kind, (required, _) in FIELDS.items():
        for name in required:
            missing = missing | ((raw["kind"] == kind) & raw[name].isNull())
    interval = raw["interval"]
    missing = missing | (
        interval.isNotNull() & (interval["start"].isNull() | interval["end"].isNull())
    )
    flat = F.regexp_replace(
        types, f"dimensions: OBJECT<(?:{_KEY}: STRING(?:, )?)*>", "dimensions: VOID"
    )
    number = F.regexp_replace(flat, r"value: (BIGINT|DOUBLE|DECIMAL\(\d+,\d+\))", "value: VOID")
    mistyped = (
        raw["_corrupt"].isNotNull()
        | number.rlike(r"BIGINT|DOUBLE|DECIMAL|BOOLEAN|dimensions: OBJECT|value: STRING")
        | ~F.coalesce(raw["origin"].isin("imported", "generated"), F.lit(True))
    )

    def beyond(names: Column, allowed_names: Column) -> Column:
        return F.coalesce(F.size(F.array_except(names, allowed_names)) > 0, F.lit(False))

    unknown = beyond(keys, known) | beyond(interval_keys, F.array(F.lit("start"), F.lit("end")))
    return (
        F.when(keys.isNull(), "not an object")
        .when(known.isNull(), "unknown kind")
        .when(unknown, "unknown field")
        .when(F.coalesce(mistyped, F.lit(True)), "wrong type")
        .when(missing, "missing field")
    )
