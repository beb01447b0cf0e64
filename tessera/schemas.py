"""Schemas of the ledger tables and of the payload union."""

from __future__ import annotations

from pyspark.sql import types as T

STR, LONG, DBL, BOOL = T.StringType(), T.LongType(), T.DoubleType(), T.BooleanType()
TS = T.TimestampNTZType()


def _struct(**fields: T.DataType) -> T.StructType:
    return T.StructType([T.StructField(k, v) for k, v in fields.items()])


INTERVAL = _struct(start=STR, end=STR)

# One nullable field per payload attribute; ``kind`` is the tag of the union.
PAYLOAD = _struct(
    kind=STR,
    body=STR,
    statement=STR,
    observed_at=STR,
    choice=STR,
    question=STR,
    rationale=STR,
    decided_at=STR,
    proposal=STR,
    language=STR,
    code=STR,
    origin=STR,
    runtime=STR,
    dependencies=T.ArrayType(STR),
    name=STR,
    value=DBL,
    unit=STR,
    interval=INTERVAL,
    dimensions=T.MapType(STR, STR),
    method=STR,
    claim=STR,
    action=STR,
    outcome=STR,
    impact=STR,
)

SOURCE = _struct(identity=STR, locator=STR, version=STR, content_hash=STR, anchor=STR, quote=STR)

_PROVENANCE = dict(created_at=TS, actor=STR, thread=STR, client=STR, idempotency_key=STR)

TABLES: dict[str, T.StructType] = {
    "scopes": _struct(id=LONG, name=STR, **_PROVENANCE),
    "records": _struct(
        id=LONG,
        scope_id=LONG,
        kind=STR,
        title=STR,
        lifecycle=STR,
        current_revision=LONG,
        readable=BOOL,
        updated_at=TS,
        import_metadata=STR,
        **_PROVENANCE,
    ),
    "record_revisions": _struct(
        record_id=LONG, revision=LONG, title=STR, payload=PAYLOAD, reason=STR, **_PROVENANCE
    ),
    "source_references": _struct(
        id=LONG,
        record_id=LONG,
        revision=LONG,
        position=LONG,
        **{f.name: f.dataType for f in SOURCE.fields},
    ),
    "labels": _struct(id=LONG, facet=STR, key=STR, display_name=STR, active=BOOL, **_PROVENANCE),
    "label_aliases": _struct(label_id=LONG, alias=STR),
    "label_assertions": _struct(
        id=LONG, record_id=LONG, label_id=LONG, reason=STR, **_PROVENANCE
    ),
    "label_retractions": _struct(assertion_id=LONG, reason=STR, **_PROVENANCE),
    "record_relations": _struct(
        id=LONG,
        source_record_id=LONG,
        target_record_id=LONG,
        kind=STR,
        reason=STR,
        **_PROVENANCE,
    ),
    "relation_retractions": _struct(relation_id=LONG, reason=STR, **_PROVENANCE),
    "lifecycle_transitions": _struct(
        id=LONG, record_id=LONG, from_state=STR, to_state=STR, reason=STR, **_PROVENANCE
    ),
    "write_keys": _struct(key=STR, operation=STR, request_hash=STR, result_id=LONG),
    "record_embeddings": _struct(
        record_id=LONG,
        revision=LONG,
        model=STR,
        model_revision=STR,
        dimensions=LONG,
        vector=T.ArrayType(T.FloatType()),
    ),
}
