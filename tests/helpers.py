"""Small hand-made ledgers."""

from __future__ import annotations

import datetime as dt

from tessera.schemas import TABLES
from tessera.sources.store import LedgerStore

T0 = dt.datetime(2026, 1, 1)


def rows_of(spark, table, rows):
    """DataFrame of a ledger table; absent columns are null."""
    schema = TABLES[table]
    return spark.createDataFrame([[r.get(f.name) for f in schema.fields] for r in rows], schema)


def payload(kind="note", **fields):
    from tessera.schemas import PAYLOAD

    return tuple(kind if f.name == "kind" else fields.get(f.name) for f in PAYLOAD.fields)


def build_store(spark, root, **tables):
    """A store with the given rows; tables that are not named are empty."""
    store = LedgerStore(spark, str(root))
    for name in TABLES:
        store.write(name, rows_of(spark, name, tables.get(name, [])))
    return store


def simple_store(spark, root, bodies, scopes=None, **extra):
    """Records 1..n of kind note with the given (title, body) pairs, all in scope 1."""
    records = [
        dict(id=i, scope_id=1, kind="note", title=t, lifecycle="active", current_revision=1,
             readable=True, **extra.get("record", {}).get(i, {}))
        for i, (t, _) in enumerate(bodies, 1)
    ]
    for r in records:
        r.update(extra.get("override", {}).get(r["id"], {}))
    revisions = [
        dict(record_id=i, revision=1, title=t, payload=payload(body=b), reason="created",
             created_at=T0, actor="a", thread="t", client="c")
        for i, (t, b) in enumerate(bodies, 1)
    ]
    tables = dict(
        records=records,
        record_revisions=revisions + extra.get("revisions", []),
        scopes=scopes or [dict(id=1, name="work"), dict(id=2, name="global")],
        labels=[dict(id=1, facet="workflow", key="inbox", display_name="Inbox", active=True),
                dict(id=2, facet="topic", key="spark", display_name="Spark", active=True)],
        label_assertions=extra.get(
            "assertions", [dict(id=i, record_id=i, label_id=1) for i in range(1, len(bodies) + 1)]
        ),
        source_references=extra.get("sources", []),
        record_embeddings=extra.get("embeddings", []),
    )
    return build_store(spark, root, **tables)
