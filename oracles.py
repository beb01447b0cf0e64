"""DuckDB statements that state what each query must return.

They are written against the driver's tables alone: the ledger views are restated here as
common table expressions, so both sides share no code.
"""

from __future__ import annotations

N = "(SELECT count(*) FROM documents)"
NV = "(SELECT count(*) FROM embeddings)"
WS = r"[\t-\r\x{85}\p{Z}]"


def squeeze(x: str) -> str:
    return f"trim(regexp_replace({x}, '{WS}+', ' ', 'g'))"


def utrim(x: str) -> str:
    return f"regexp_replace({x}, '^{WS}+|{WS}+$', '', 'g')"


def tok(x: str) -> str:
    return rf"regexp_extract_all(strip_accents(lower({x})), '[\p{{L}}\p{{N}}]+')"


def payload_text(t: str) -> str:
    return f"""CASE kind WHEN 'note' THEN {t} WHEN 'idea' THEN {t}
        WHEN 'observation' THEN {t} || chr(10) || '2026-08-30T10:00:00Z'
        WHEN 'decision' THEN {t} || chr(10) || 'from ' || source
        WHEN 'snippet' THEN lang || chr(10) || {t} || chr(10) || 'generated' || chr(10) || source
        WHEN 'metric' THEN 'n_chars' || chr(10) || CAST(n_chars AS DOUBLE) || chr(10) || 'chars'
             || chr(10) || 'lang: ' || lang || chr(10) || 'source: ' || source || chr(10) || {t}
        WHEN 'evidence' THEN {t} || chr(10) || 'lang ' || lang END"""


KINDS = "['note','observation','decision','idea','snippet','metric','evidence']"
DIRECT = "['references','mentions','derived_from','supports','contradicts','summarizes']"
LANG_ID = "(ascii(lang[1]) - 97) * 26 + ascii(lang[2]) - 97 + 4"

# name -> (tables it reads, body)
CTES: dict[str, tuple[list[str], str]] = {
    "l_scopes": ([], """SELECT DISTINCT CAST(substr(source, 4) AS BIGINT) + 1 AS id,
        CASE WHEN source = 'src0' THEN 'global' ELSE source END AS name FROM documents"""),
    "l_docs": ([], f"""SELECT *, doc_id + 1 AS record_id, {KINDS}[doc_id % 7 + 1] AS kind,
        'Document ' || doc_id AS title, CAST(substr(source, 4) AS BIGINT) + 1 AS scope_id
        FROM documents"""),
    "l_commands": ([], f"""SELECT 'k' || event_id AS key, op, ts, event_id * 4 AS seq,
        event_id % {N} + 1 AS record_id,
        CASE WHEN op IN ('add_label','retract_label') THEN k % 3 + 1 END AS label_id,
        CASE WHEN op = 'revise_record' THEN k % 3 + 1 END AS expected_revision,
        CASE WHEN op = 'add_relation' THEN k + 1 END AS target_record_id,
        CASE WHEN op = 'add_relation' THEN {DIRECT}[k % 6 + 1] END AS relation_kind,
        CASE WHEN op = 'retract_relation' THEN event_id % {N} + 1 END AS relation_id,
        'user ' || user_id AS reason, props AS request, 'user-' || user_id AS actor, value,
        event_type
        FROM (SELECT *, CAST(props->>'$.k' AS BIGINT) AS k,
              CASE WHEN event_type = 'error' AND value > 80 THEN 'transition_record'
                   WHEN event_type = 'error' THEN 'retract_relation'
                   WHEN event_type = 'click' THEN 'add_label'
                   WHEN event_type = 'view' THEN 'retract_label'
                   WHEN event_type = 'signup' THEN 'revise_record'
                   ELSE 'add_relation' END AS op FROM events)"""),
    "l_delivered": (["l_commands"], """SELECT key, op, ts, seq, request FROM l_commands
        UNION ALL SELECT key, op, ts, seq + 1, request FROM l_commands WHERE value > 60
        UNION ALL SELECT key, op, ts, seq + 2, request || ' ' FROM l_commands WHERE value < 2
        UNION ALL SELECT key, 'read_record', ts, seq + 3, request FROM l_commands
                  WHERE value > 150"""),
    "l_write_keys": (["l_commands"], """SELECT key, op, sha256(request) AS request_hash
        FROM l_commands WHERE op = 'revise_record'"""),
    "l_records": (["l_docs", "l_commands"], """SELECT d.record_id AS id, d.scope_id, d.kind,
        d.title, d.doc_id, l.doc_id IS NULL AS readable,
        CASE WHEN l.doc_id IS NULL AND t.record_id IS NOT NULL THEN 'retracted'
             ELSE 'active' END AS lifecycle,
        coalesce(c.newest, 1) AS current_revision
        FROM l_docs d
        LEFT JOIN (SELECT doc_id FROM labels WHERE toxic = 1) l ON l.doc_id = d.doc_id
        LEFT JOIN (SELECT DISTINCT record_id FROM l_commands WHERE op = 'transition_record') t
               ON t.record_id = d.record_id
        LEFT JOIN (SELECT conv_id + 1 AS record_id, max(turn) + 2 AS newest
                   FROM conversations GROUP BY ALL) c ON c.record_id = d.record_id"""),
    "l_revisions": (["l_docs"], f"""SELECT record_id, 1 AS revision, title, kind, lang, source,
        n_chars, text AS main, 'record created' AS reason, {payload_text("text")} AS body
        FROM l_docs UNION ALL
        SELECT record_id, turn + 2, title, kind, lang, source, n_chars, c.text,
        'turn by ' || role, {payload_text("c.text")}
        FROM conversations c JOIN (SELECT * EXCLUDE (text) FROM l_docs) d
          ON d.record_id = c.conv_id + 1"""),
    "l_sources": ([], """SELECT doc_id * 4 + p + 1 AS id, doc_id + 1 AS record_id, 1 AS revision,
        p AS position, 'source-' || p AS identity, 'file:///' || source AS locator,
        CASE WHEN p > 0 THEN 'sha256:' || doc_id END AS content_hash
        FROM documents, range(4) r(p) WHERE p < doc_id % 4"""),
    "l_labels": ([], f"""SELECT DISTINCT 1 AS id, 'workflow' AS facet, 'inbox' AS key FROM documents
        UNION ALL SELECT DISTINCT quality + 2, 'quality',
                  CASE WHEN quality = 1 THEN 'high' ELSE 'low' END FROM labels
        UNION ALL SELECT DISTINCT {LANG_ID}, 'lang', lang FROM documents"""),
    "l_aliases": (["l_labels"], """SELECT id AS label_id, facet || ' ' || key AS alias FROM l_labels
        UNION ALL SELECT id, key || '-' || facet FROM l_labels"""),
    "l_assertions": ([], f"""SELECT (doc_id + 1) * 3 AS id, doc_id + 1 AS record_id,
            CAST(1 AS BIGINT) AS label_id FROM documents
        UNION ALL SELECT (doc_id + 1) * 3 + 1, doc_id + 1, {LANG_ID} FROM documents
        UNION ALL SELECT (doc_id + 1) * 3 + 2, doc_id + 1, quality + 2 FROM labels"""),
    "l_active": (["l_assertions"], """SELECT * FROM l_assertions
        WHERE id NOT IN (SELECT (doc_id + 1) * 3 FROM labels)"""),
    "l_relations": ([], f"""SELECT * FROM (SELECT doc_id + 1 AS id, doc_id + 1 AS source_record_id,
        ((doc_id + 1) * 7 + 3) % {N} + 1 AS target_record_id,
        {DIRECT}[(doc_id + 1) % 6 + 1] AS kind FROM documents)
        WHERE source_record_id <> target_record_id"""),
    "l_rel_retracted": (["l_relations"], """SELECT doc_id + 1 AS relation_id FROM labels
        WHERE quality = 0 AND doc_id + 1 IN (SELECT id FROM l_relations)"""),
    "l_visible": (["l_relations", "l_records"], """SELECT r.* FROM l_relations r
        JOIN l_records s ON s.id = r.source_record_id AND s.readable
        JOIN l_records t ON t.id = r.target_record_id AND t.readable"""),
    "l_transitions": (["l_records"], """SELECT id * 2 AS id, id AS record_id,
            NULL AS from_state, 'active' AS to_state FROM l_records
        UNION ALL SELECT id * 2 + 1, id, 'active', 'retracted' FROM l_records
            WHERE lifecycle = 'retracted'"""),
    "l_full": (["l_records"], f"""SELECT r.id AS record_id, r.current_revision AS revision,
        e.embedding AS vector FROM l_records r
        JOIN embeddings e ON e.vec_id = (r.id - 1) % {NV}"""),
    "l_partial": (["l_records"], """SELECT vec_id + 1 AS record_id, label % 2 + 1 AS revision,
        embedding AS vector FROM embeddings WHERE vec_id + 1 IN (SELECT id FROM l_records)"""),
    "l_queries": ([], f"""SELECT row_number() OVER (ORDER BY item_id, part) AS query_id,
        array_to_string(terms[part * 8 + 1 : part * 8 + 8], ' ') AS query,
        item_id % 20 + 1 AS scope_id, item_id % 2 = 0 AS include_global,
        (item_id * 7 + part) % {NV} AS vec_id
        FROM (SELECT item_id, list_filter(string_split({squeeze("text")}, ' '), lambda w: w <> '')
              AS terms FROM benchmark) b,
        LATERAL (SELECT unnest(range(0, greatest(len(terms) - 1, 0) // 8 + 1)) AS part) p"""),
    "l_qscopes": (["l_queries", "l_scopes"], """SELECT query_id, scope_id FROM l_queries
        UNION SELECT query_id, s.id FROM l_queries, l_scopes s
        WHERE include_global AND s.name = 'global'"""),
    "l_indexed": (["l_records", "l_revisions"], f"""SELECT r.id AS record_id, r.scope_id,
        {tok("v.title")} AS tt, {tok("v.body")} AS bt FROM l_records r
        JOIN l_revisions v ON v.record_id = r.id AND v.revision = r.current_revision
        WHERE r.readable"""),
    "l_places": (["l_indexed"], """SELECT record_id, scope_id, len(tt) + len(bt) AS dl, 't' AS side,
            unnest(tt) AS term, unnest(range(len(tt))) AS pos FROM l_indexed
        UNION ALL SELECT record_id, scope_id, len(tt) + len(bt), 'b',
            unnest(bt), unnest(range(len(bt))) FROM l_indexed"""),
    "l_postings": (["l_places"], """SELECT term, record_id, scope_id, dl, count(*) AS tf
        FROM l_places GROUP BY ALL"""),
    "l_df": (["l_postings"], "SELECT term, count(*) AS df FROM l_postings GROUP BY term"),
    "l_corpus": (["l_indexed"], """SELECT count(*) AS n_docs,
        sum(len(tt) + len(bt)) / count(*) AS avgdl FROM l_indexed"""),
    "l_terms": (["l_queries"], f"""SELECT query_id, ix - 1 AS term_ix, term, {tok("term")} AS tokens
        FROM (SELECT query_id, unnest(ts) AS term, generate_subscripts(ts, 1) AS ix
              FROM (SELECT query_id, list_filter(string_split({squeeze("query")}, ' '),
                    lambda w: w <> '') AS ts FROM l_queries))"""),
    "l_gain": (["l_terms", "l_qscopes", "l_postings", "l_df", "l_corpus"], """
        SELECT t.query_id, p.record_id,
          CAST(round(greatest(ln((c.n_docs - d.df + 0.5) / (d.df + 0.5)), 1e-6)
            * (p.tf * 2.2) / (p.tf + 1.2 * (1.0 - 0.75 + 0.75 * p.dl / c.avgdl)) * 1e14)
            AS BIGINT) AS units
        FROM l_terms t JOIN l_qscopes s ON s.query_id = t.query_id
        JOIN l_postings p ON p.term = t.tokens[1] AND p.scope_id = s.scope_id
        JOIN l_df d ON d.term = p.term, l_corpus c"""),
    "l_scores": (["l_gain"], """SELECT query_id, record_id, sum(units) AS units,
        CAST(sum(units) AS DOUBLE) / 1e14 AS score FROM l_gain GROUP BY ALL"""),
    "l_lexical": (["l_scores", "l_records"], """SELECT * FROM (SELECT s.*, row_number() OVER (
          PARTITION BY query_id ORDER BY units DESC, record_id DESC) AS bm25_rank
        FROM l_scores s JOIN l_records r ON r.id = s.record_id AND r.lifecycle = 'active')
        WHERE bm25_rank <= 20"""),
    "l_qvec": (["l_queries"], """SELECT query_id, embedding AS qv FROM l_queries q
        JOIN embeddings e ON e.vec_id = q.vec_id"""),
    "l_similar": (["l_qvec", "l_qscopes", "l_full", "l_records"], """
        SELECT q.query_id, f.record_id, r.kind,
          list_inner_product(CAST(f.vector AS DOUBLE[]), CAST(q.qv AS DOUBLE[])) AS similarity
        FROM l_qvec q JOIN l_qscopes s ON s.query_id = q.query_id
        JOIN l_records r ON r.scope_id = s.scope_id AND r.readable AND r.lifecycle = 'active'
        JOIN l_full f ON f.record_id = r.id"""),
    "l_dense": (["l_similar"], """SELECT * FROM (SELECT *, row_number() OVER (
          PARTITION BY query_id ORDER BY round(similarity, 9) DESC, record_id DESC) AS dense_rank
        FROM l_similar) WHERE dense_rank <= 20"""),
    "l_fused": (["l_lexical", "l_dense"], """SELECT coalesce(l.query_id, d.query_id) AS query_id,
        coalesce(l.record_id, d.record_id) AS record_id, l.bm25_rank, l.score AS bm25_score,
        d.dense_rank, d.similarity AS dense_similarity FROM l_lexical l FULL JOIN l_dense d
        ON d.query_id = l.query_id AND d.record_id = l.record_id"""),
    "l_ordered": (["l_fused"], """SELECT * FROM (SELECT *, row_number() OVER (
          PARTITION BY query_id ORDER BY dense_rank NULLS LAST, bm25_rank NULLS LAST,
          record_id DESC) AS position FROM l_fused) WHERE position <= 5"""),
}


def closure(names: list[str]) -> list[str]:
    """The needed expressions in dependency order."""
    out: list[str] = []

    def visit(name: str) -> None:
        for dep in CTES[name][0]:
            visit(dep)
        if name not in out:
            out.append(name)

    for n in names:
        visit(n)
    return out


def sql(uses: str, select: str, recursive: str = "") -> str:
    parts = [f"{n} AS ({CTES[n][1]})" for n in closure(uses.split())]
    if recursive:
        parts.append(recursive)
    head = "WITH RECURSIVE " if recursive else "WITH "
    return (head + ",\n".join(parts) + "\n" if parts else "") + select


ORACLES: dict[str, str] = {}
O = ORACLES

# Sources, sinks, codecs

_counted = {
    "scopes": "l_scopes", "records": "l_records", "record_revisions": "l_revisions",
    "source_references": "l_sources", "labels": "l_labels", "label_aliases": "l_aliases",
    "label_assertions": "l_assertions", "label_retractions": "labels",
    "record_relations": "l_relations", "relation_retractions": "l_rel_retracted",
    "lifecycle_transitions": "l_transitions", "write_keys": "l_write_keys",
    "record_embeddings": "l_full",
}
O["ledger_scan"] = sql(
    " ".join(v for v in _counted.values() if v.startswith("l_")),
    " UNION ALL ".join(
        f"SELECT '{k}' AS table_name, count(*) AS n_rows FROM {v}" for k, v in _counted.items()
    ),
)
ENCODED = """CAST(CASE kind
    WHEN 'note' THEN json_object('kind', kind, 'body', main)
    WHEN 'observation' THEN json_object('kind', kind, 'statement', main,
         'observed_at', '2026-08-30T10:00:00Z')
    WHEN 'decision' THEN json_object('kind', kind, 'choice', main, 'question', NULL,
         'rationale', 'from ' || source, 'decided_at', NULL)
    WHEN 'idea' THEN json_object('kind', kind, 'proposal', main)
    WHEN 'snippet' THEN json_object('kind', kind, 'language', lang, 'code', main,
         'origin', 'generated', 'runtime', NULL, 'dependencies', [source])
    WHEN 'metric' THEN json_object('kind', kind, 'name', 'n_chars',
         'value', CAST(n_chars AS DOUBLE), 'unit', 'chars', 'observed_at', NULL,
         'interval', NULL, 'dimensions', json_object('lang', lang, 'source', source),
         'method', main)
    WHEN 'evidence' THEN json_object('kind', kind, 'claim', main, 'action', NULL,
         'outcome', 'lang ' || lang, 'impact', NULL) END AS VARCHAR)"""
O["payload_encode"] = sql(
    "l_revisions", f"SELECT record_id, revision, {ENCODED} AS payload_json FROM l_revisions"
)
O["payload_decode"] = sql("l_revisions", """
    SELECT 'r:' || record_id || ':' || revision AS item, NULL AS error, kind, body AS text
      FROM l_revisions
    UNION ALL SELECT 'x:' || record_id || ':' || revision, 'unknown field', NULL, NULL
      FROM l_revisions
    UNION ALL SELECT 'n:' || doc_id, 'wrong type', NULL, NULL FROM documents
    UNION ALL SELECT 'm:' || doc_id, 'missing field', NULL, NULL FROM documents
    UNION ALL SELECT 'p:' || event_id, 'unknown kind', NULL, NULL FROM events
    UNION ALL SELECT 't:' || conv_id || ':' || turn, 'not an object', NULL, NULL
      FROM conversations WHERE NOT json_valid(text)""")
_POSTING_ROWS = """SELECT term, record_id, count(*) AS tf, dl,
    coalesce(array_to_string(list(pos ORDER BY pos) FILTER (side = 't'), ','), '') AS title_pos,
    coalesce(array_to_string(list(pos ORDER BY pos) FILTER (side = 'b'), ','), '') AS body_pos
    FROM l_places GROUP BY term, record_id, dl"""
O["text_index_build"] = sql("l_places", _POSTING_ROWS)
_first = sql("l_places", _POSTING_ROWS)
O["text_index_refresh"] = _first.replace(
    "v.revision = r.current_revision", "v.revision = 1"
)
O["segment_postings"] = O["text_index_refresh"]
O["segment_terms"] = sql("l_df", "SELECT term, df FROM l_df").replace(
    "v.revision = r.current_revision", "v.revision = 1"
)
O["corpus_stats"] = sql("l_corpus", "SELECT n_docs, round(avgdl, 6) AS avgdl FROM l_corpus")
O["document_frequency"] = sql("l_df", "SELECT term, df FROM l_df")

# Projections

O["payload_kind"] = sql("l_revisions", "SELECT record_id, revision, kind FROM l_revisions")
O["payload_text"] = sql("l_revisions", "SELECT record_id, revision, body AS text FROM l_revisions")
O["number_text"] = "SELECT o_orderkey, CAST(o_totalprice AS VARCHAR) AS text FROM orders"
O["label_canonical"] = sql("l_labels", "SELECT id, facet || ':' || key AS canonical FROM l_labels")
O["normalized_text"] = sql("l_revisions", f"""SELECT record_id, revision,
    {squeeze("nfc_normalize(title || chr(10) || body)")} AS text FROM l_revisions""")
_scope_tag = "CASE WHEN include_global THEN 'scope:exact_or_global' ELSE 'scope:exact' END"
O["match_explanation"] = sql("l_queries", f"""SELECT query_id,
    'fts:title_or_payload,' || {_scope_tag} || ',kind,lifecycle' AS text_tags,
    'semantic:cosine,model:m@v1,' || {_scope_tag} || ',lifecycle,labels:all' AS dense_tags
    FROM l_queries""")

# Filters and state views

O["readable_filter"] = sql("l_records", "SELECT id FROM l_records WHERE readable")
O["label_division"] = sql("l_active", """SELECT record_id FROM l_active WHERE label_id IN (3, 121)
    GROUP BY record_id HAVING count(DISTINCT label_id) = 2""")
O["eligible_records"] = sql("l_records l_scopes l_active", """SELECT id, scope_id, kind, lifecycle
    FROM l_records r WHERE readable AND kind IN ('note','decision','metric')
    AND lifecycle IN ('active','retracted')
    AND (scope_id = 3 OR scope_id IN (SELECT id FROM l_scopes WHERE name = 'global'))
    AND EXISTS (SELECT 1 FROM l_active a WHERE a.record_id = r.id AND a.label_id = 3)
    AND EXISTS (SELECT 1 FROM l_active a WHERE a.record_id = r.id AND a.label_id = 121)""")
O["eligible_default"] = sql("l_records", """SELECT id FROM l_records
    WHERE readable AND lifecycle = 'active' AND scope_id = 2""")
O["keyset_page"] = sql("l_records", """SELECT scope_id, id, position,
    CASE WHEN fetched > 20 THEN min(id) OVER (PARTITION BY scope_id) END AS next_before_id
    FROM (SELECT *, count(*) OVER (PARTITION BY scope_id) AS fetched FROM (
      SELECT r.scope_id, r.id, row_number() OVER (PARTITION BY r.scope_id ORDER BY id DESC) AS position
      FROM l_records r LEFT JOIN (SELECT scope_id, max(id) AS before_id FROM l_records
        WHERE NOT readable GROUP BY scope_id) c ON c.scope_id = r.scope_id
      WHERE readable AND (before_id IS NULL OR id < before_id)) WHERE position <= 21)
    WHERE position <= 20""")
O["keyset_page_single"] = sql("l_records", """SELECT id,
    row_number() OVER (ORDER BY id DESC) AS position,
    CASE WHEN (SELECT count(*) FROM l_records WHERE readable) > 50
         THEN min(id) OVER () END AS next_before_id
    FROM (SELECT id FROM l_records WHERE readable ORDER BY id DESC LIMIT 50)""")
O["search_labels"] = sql("l_labels l_aliases", """SELECT id, facet || ':' || key AS canonical,
    upper(key[1]) || key[2:] AS display_name FROM l_labels l
    WHERE lower(facet || ':' || key) LIKE '%h%h-qu%' OR key LIKE '%h%h-qu%'
    OR EXISTS (SELECT 1 FROM l_aliases a WHERE a.label_id = l.id AND lower(alias) LIKE '%h%h-qu%')
    ORDER BY facet, key, id LIMIT 50""")
O["latest_active_assertion"] = sql("l_active", """SELECT record_id, label_id,
    max(id) AS assertion_id FROM l_active GROUP BY ALL""")
O["relation_absent"] = sql("l_commands l_relations l_rel_retracted", """
    SELECT DISTINCT record_id AS source_record_id, target_record_id, relation_kind AS kind
    FROM l_commands c WHERE op = 'add_relation' AND NOT EXISTS (SELECT 1 FROM l_relations r
      WHERE r.source_record_id = c.record_id AND r.target_record_id = c.target_record_id
      AND r.kind = c.relation_kind AND r.id NOT IN (SELECT relation_id FROM l_rel_retracted))""")
O["current_revision"] = sql("l_records l_revisions", """SELECT v.record_id, v.revision,
    v.body AS text FROM l_revisions v JOIN l_records r
    ON r.id = v.record_id AND r.current_revision = v.revision""")
O["active_labels"] = sql("l_active l_labels", """SELECT record_id, label_id,
    facet || ':' || key AS canonical FROM l_active a JOIN l_labels l ON l.id = a.label_id""")
_both_ends = """SELECT {cols} FROM (SELECT *, source_record_id AS record_id FROM l_visible
    UNION ALL SELECT *, target_record_id FROM l_visible) {where}"""
O["relations_visible"] = sql("l_visible l_rel_retracted", _both_ends.format(
    cols="record_id, id, source_record_id, target_record_id, kind",
    where="WHERE id NOT IN (SELECT relation_id FROM l_rel_retracted)"))
O["relations_with_retracted"] = sql("l_visible", _both_ends.format(cols="record_id, id", where=""))
O["relation_with_retraction"] = sql("l_visible l_rel_retracted", """SELECT id, kind,
    CASE WHEN id IN (SELECT relation_id FROM l_rel_retracted) THEN 'low quality' END
    AS retraction_reason FROM l_visible""")
O["active_label_count"] = sql("l_active", """SELECT record_id, count(*) AS active_labels
    FROM l_active GROUP BY ALL""")
O["record_document"] = sql(
    "l_records l_revisions l_scopes l_sources l_active l_labels l_visible l_rel_retracted", """
    SELECT r.id AS record_id, s.name AS scope_name, r.kind, r.title, r.lifecycle,
    r.current_revision, v.body AS text,
    coalesce((SELECT string_agg(identity, ',' ORDER BY position) FROM l_sources x
      WHERE x.record_id = r.id AND x.revision = r.current_revision), '') AS sources,
    coalesce((SELECT string_agg(facet || ':' || key, ',' ORDER BY facet, key) FROM l_active a
      JOIN l_labels l ON l.id = a.label_id WHERE a.record_id = r.id), '') AS labels,
    CASE WHEN r.lifecycle = 'retracted' THEN 'active>retracted' ELSE 'active' END AS steps,
    (SELECT count(*) FROM l_visible e WHERE r.id IN (e.source_record_id, e.target_record_id)
      AND e.id NOT IN (SELECT relation_id FROM l_rel_retracted)) AS n_relations,
    (SELECT count(*) FROM l_revisions h WHERE h.record_id = r.id) AS n_revisions
    FROM l_records r JOIN l_scopes s ON s.id = r.scope_id
    JOIN l_revisions v ON v.record_id = r.id AND v.revision = r.current_revision
    WHERE r.readable""")
O["label_document"] = sql("l_labels l_aliases", """SELECT id AS label_id,
    facet || ':' || key AS canonical,
    (SELECT string_agg(alias, ',' ORDER BY alias) FROM l_aliases a WHERE a.label_id = l.id)
    AS aliases, true AS active FROM l_labels l""")
O["lifecycle_history"] = sql("l_transitions l_records", """SELECT record_id,
    string_agg(coalesce(from_state, '') || '>' || to_state, ',' ORDER BY t.id) AS path
    FROM l_transitions t JOIN l_records r ON r.id = t.record_id AND r.readable
    GROUP BY record_id""")
O["ledger_refold"] = sql("l_records l_commands", """SELECT id AS record_id, lifecycle, current_revision,
    strftime(CASE WHEN lifecycle = 'retracted' THEN greatest(first_at, TIMESTAMP '2026-01-01')
      ELSE TIMESTAMP '2026-01-01' END, '%Y-%m-%d %H:%M:%S.%f') AS updated_at
    FROM l_records r LEFT JOIN (SELECT record_id, min(ts) AS first_at FROM l_commands
      WHERE op = 'transition_record' GROUP BY ALL) t ON t.record_id = r.id""")
O["alias_ownership"] = sql("l_aliases", """SELECT w.alias, label_id FROM (
    SELECT n_name AS alias FROM nation UNION ALL SELECT upper(alias) FROM l_aliases) w
    LEFT JOIN l_aliases a ON lower(a.alias) = lower(w.alias)""")
O["revision_history"] = sql("l_revisions l_records", """SELECT record_id, revision, v.title, reason
    FROM l_revisions v JOIN l_records r ON r.id = v.record_id AND r.readable""")
O["list_scopes"] = sql("l_scopes", "SELECT id, name FROM l_scopes")

# Text retrieval

O["tokenize"] = f"SELECT doc_id, array_to_string({tok('text')}, ' ') AS tokens FROM documents"
O["query_terms"] = sql("l_terms", """SELECT query_id, term_ix, term,
    array_to_string(tokens, ' ') AS tokens FROM l_terms""")
PAIRS = f"""pairs AS (SELECT row_number() OVER (ORDER BY item_id, part) AS query_id, item_id, ws[part * 2 + 1 : part * 2 + 2] AS two
    FROM (SELECT item_id, string_split({squeeze("text")}, ' ') AS ws FROM benchmark) b,
    LATERAL (SELECT unnest(range(0, (len(ws) + 1) // 2)) AS part) p)"""
O["phrase_match"] = sql("l_places", """SELECT query_id, 0 AS term_ix, record_id, count(*) AS tf
    FROM (SELECT query_id, phrase, len(phrase) AS n, unnest(phrase) AS term,
            unnest(range(len(phrase))) AS off
          FROM (SELECT query_id, """ + tok("array_to_string(two, '-')") + """ AS phrase FROM pairs)) q
    JOIN (SELECT record_id, side, pos, term FROM l_places) p USING (term)
    WHERE off = 0 AND (n = 1 OR EXISTS (SELECT 1 FROM l_places x WHERE x.record_id = p.record_id
      AND x.side = p.side AND x.pos = p.pos + 1 AND x.term = q.phrase[2]))
    AND n <= 2 GROUP BY query_id, record_id""", PAIRS)
O["search_and"] = sql("l_postings", """SELECT a.query_id, a.record_id FROM
    (SELECT query_id, record_id, count(*) AS found FROM
       (SELECT query_id, unnest(two) AS w FROM pairs) t
       JOIN l_postings p ON p.term = """ + tok("w") + """[1] GROUP BY ALL) a
    JOIN pairs q ON q.query_id = a.query_id AND found = len(two)""", PAIRS)
O["match_any"] = sql("l_gain", "SELECT DISTINCT query_id, record_id FROM l_gain")
O["bm25_score"] = sql("l_scores", """SELECT query_id, record_id, round(score, 6) AS score
    FROM l_scores""")
O["bm25_topk"] = sql("l_lexical", """SELECT query_id, bm25_rank, record_id,
    round(score, 6) AS score FROM l_lexical""")
O["segment_search"] = O["bm25_topk"]

# Vector index and dense retrieval

O["embedding_valid"] = sql("l_partial l_records", """SELECT p.record_id FROM l_partial p
    JOIN l_records r ON r.id = p.record_id AND r.readable AND r.current_revision = p.revision""")
O["embedding_pending"] = sql("l_partial l_records", """SELECT r.id AS record_id,
    r.current_revision AS revision FROM l_records r LEFT JOIN l_partial p ON p.record_id = r.id
    WHERE readable AND p.revision IS DISTINCT FROM r.current_revision""")
O["embedding_status"] = sql("l_partial l_records", """SELECT 'm' AS model, 'v1' AS model_revision,
    64 AS dimensions, count(*) AS eligible_records, count(p.record_id) AS indexed_records,
    count(*) - count(p.record_id) AS pending_records FROM l_records r LEFT JOIN l_partial p
    ON p.record_id = r.id AND p.revision = r.current_revision WHERE r.readable""")
O["index_gate"] = sql("l_partial l_records", """SELECT 'full' AS index, 0 AS pending_records,
    'dense' AS strategy UNION ALL
    SELECT 'partial', count(*) - count(p.record_id),
      CASE WHEN count(*) = count(p.record_id) THEN 'dense' ELSE 'bm25' END
    FROM l_records r LEFT JOIN l_partial p
    ON p.record_id = r.id AND p.revision = r.current_revision WHERE r.readable""")
_norm = "sqrt(list_inner_product(CAST(v AS DOUBLE[]), CAST(v AS DOUBLE[])))"
O["vector_valid"] = f"""SELECT vec_id, CASE WHEN abs({_norm} - 1) > 0.001
      THEN 'embedding must be L2-normalized' END AS as_stored,
    CASE WHEN label % 2 = 1 THEN 'embedding has invalid dimensions or values'
         WHEN abs({_norm} - 1) > 0.001 THEN 'embedding must be L2-normalized' END AS other_size,
    CASE WHEN abs({_norm} * (label + 1) - 1) > 0.001 THEN 'embedding must be L2-normalized' END
    AS scaled FROM (SELECT *, embedding AS v FROM embeddings)"""
O["l2_normalize"] = """SELECT vec_id, CASE WHEN label > 0 THEN 1.0::DOUBLE END AS norm,
    CASE WHEN label > 0 THEN 1.0::DOUBLE END AS cosine FROM embeddings"""
O["dense_score"] = sql("l_gain l_full l_qvec", """SELECT g.query_id, g.record_id,
    round(list_inner_product(CAST(vector AS DOUBLE[]), CAST(qv AS DOUBLE[])), 6) AS similarity
    FROM (SELECT DISTINCT query_id, record_id FROM l_gain) g
    JOIN l_full f ON f.record_id = g.record_id JOIN l_qvec q ON q.query_id = g.query_id""")
O["dense_topk"] = sql("l_dense", """SELECT query_id, dense_rank, record_id,
    round(similarity, 6) AS similarity FROM l_dense""")
O["semantic_search"] = sql("l_similar l_active l_queries", f"""SELECT s.query_id,
    row_number() OVER (PARTITION BY s.query_id ORDER BY round(similarity, 9) DESC, record_id DESC)
      AS dense_rank, record_id, round(similarity, 6) AS similarity,
    'semantic:cosine,model:m@v1,' || {_scope_tag} || ',kind,lifecycle,labels:all' AS tags
    FROM l_similar s JOIN l_queries q ON q.query_id = s.query_id
    WHERE kind IN ('note','metric','idea')
    AND record_id IN (SELECT record_id FROM l_active WHERE label_id = 121)
    QUALIFY dense_rank <= 10""")
O["search_records"] = sql("l_postings l_records l_active l_scopes", f"""SELECT query_id, position,
    record_id, CASE WHEN fetched > 10 THEN min(record_id) OVER (PARTITION BY query_id) END
    AS next_before_id, 'fts:title_or_payload,' || {_scope_tag} || ',kind,lifecycle,labels:all'
    AS tags FROM (SELECT *, count(*) OVER (PARTITION BY query_id) AS fetched FROM (
      SELECT q.query_id, include_global, a.record_id,
        row_number() OVER (PARTITION BY q.query_id ORDER BY a.record_id DESC) AS position
      FROM (SELECT query_id, two, item_id % 20 + 1 AS scope_id,
              item_id % 2 = 0 AS include_global FROM pairs) q
      JOIN (SELECT query_id, record_id, count(*) AS found FROM
         (SELECT query_id, unnest(two) AS w FROM pairs) t
         JOIN l_postings p ON p.term = {tok("w")}[1] GROUP BY ALL) a
        ON a.query_id = q.query_id AND found = len(two)
      JOIN l_records r ON r.id = a.record_id AND r.kind IN ('note','metric','idea','snippet')
      WHERE (r.scope_id = q.scope_id
             OR (include_global AND r.scope_id IN (SELECT id FROM l_scopes WHERE name = 'global')))
      AND a.record_id IN (SELECT record_id FROM l_active WHERE label_id = 121))
    WHERE position <= 11) WHERE position <= 10""", PAIRS)
O["search_blank"] = sql("l_records l_active l_scopes", f"""SELECT query_id, position, record_id,
    CASE WHEN fetched > 10 THEN min(record_id) OVER (PARTITION BY query_id) END AS next_before_id,
    {_scope_tag} || CASE WHEN query_id % 3 = 0 THEN ',kind' ELSE '' END || ',lifecycle'
      || CASE WHEN query_id % 5 = 0 THEN ',labels:all' ELSE '' END AS tags
    FROM (SELECT *, count(*) OVER (PARTITION BY query_id) AS fetched FROM (
      SELECT item_id AS query_id, item_id % 2 = 0 AS include_global, r.id AS record_id,
        row_number() OVER (PARTITION BY item_id ORDER BY r.id DESC) AS position
      FROM benchmark JOIN l_records r ON readable AND lifecycle = 'active'
       AND (r.scope_id = item_id % 20 + 1 OR (item_id % 2 = 0
            AND r.scope_id IN (SELECT id FROM l_scopes WHERE name = 'global')))
       AND (item_id % 3 > 0 OR kind IN ('note','metric'))
       AND (item_id % 5 > 0 OR r.id IN (SELECT record_id FROM l_active WHERE label_id = 121))
       AND (item_id % 4 = 0 OR r.id < {N} - item_id * 7)) WHERE position <= 11)
    WHERE position <= 10""")
O["query_guards"] = sql("l_scopes l_labels", """SELECT item_id AS query_id,
    CASE WHEN item_id % 25 + 1 NOT IN (SELECT id FROM l_scopes)
      THEN 'scope ' || (item_id % 25 + 1) || ' does not exist'
    WHEN item_id % 4 + 1 NOT IN (SELECT id FROM l_labels) THEN 'label does not exist' END AS guard
    FROM benchmark""")
_outcome = "CASE WHEN reason IS NULL THEN 'answered' ELSE 'refused' END AS outcome, reason"
_bad_limit = "query_id % 60 NOT BETWEEN 1 AND 50 THEN 'limit must be between 1 and 50'"
O["guarded_search"] = sql("l_postings l_records l_active l_scopes", f"""SELECT a.query_id, {_outcome},
    position, record_id, next_before_id, tags FROM asked a LEFT JOIN (
      SELECT query_id, position, record_id,
        CASE WHEN fetched > lim THEN min(record_id) OVER (PARTITION BY query_id) END AS next_before_id,
        'fts:title_or_payload,' || {_scope_tag} || ',lifecycle,labels:all' AS tags
      FROM (SELECT *, count(*) OVER (PARTITION BY query_id) AS fetched FROM (
        SELECT q.query_id, include_global, lim, f.record_id,
          row_number() OVER (PARTITION BY q.query_id ORDER BY f.record_id DESC) AS position
        FROM asked q JOIN (SELECT query_id, record_id, count(*) AS found FROM
           (SELECT query_id, unnest(two) AS w FROM pairs) t
           JOIN l_postings p ON p.term = {tok("w")}[1] GROUP BY ALL) f
          ON f.query_id = q.query_id AND found = len(two)
        JOIN l_records r ON r.id = f.record_id AND r.lifecycle = 'active'
        WHERE reason IS NULL AND (r.scope_id = q.scope_id
          OR (include_global AND r.scope_id IN (SELECT id FROM l_scopes WHERE name = 'global')))
        AND f.record_id IN (SELECT record_id FROM l_active WHERE label_id = 121))
      WHERE position <= lim + 1) WHERE position <= lim) USING (query_id)""", PAIRS + f""",
  asked AS (SELECT query_id, two, item_id % 25 AS scope_id, item_id % 2 = 0 AS include_global,
    CASE WHEN query_id % 9 > 0 THEN query_id % 60 ELSE 20 END AS lim,
    CASE WHEN item_id % 25 = 0 THEN 'scope_id must be positive'
      WHEN query_id % 9 > 0 AND {_bad_limit}
      WHEN query_id % 41 = 0 THEN 'search query exceeds 256 bytes'
      WHEN item_id % 25 NOT IN (SELECT id FROM l_scopes)
        THEN 'scope ' || (item_id % 25) || ' does not exist'
      WHEN query_id % 13 = 0 THEN 'label does not exist' END AS reason FROM pairs)""")
O["guarded_semantic"] = sql("l_similar l_queries l_scopes", f"""SELECT a.query_id, {_outcome},
    dense_rank, record_id, round(similarity, 6) AS similarity FROM asked a LEFT JOIN (
      SELECT query_id, record_id, similarity, row_number() OVER (PARTITION BY query_id
        ORDER BY round(similarity, 9) DESC, record_id DESC) AS dense_rank FROM l_similar) s
    ON s.query_id = a.query_id AND reason IS NULL AND dense_rank <= lim""", f"""asked AS (
    SELECT query_id, query_id % 60 AS lim,
    CASE WHEN query_id % 19 = 0 OR query_id % 13 = 0 THEN 'embedding has invalid dimensions or values'
      WHEN query_id % 11 = 0 THEN 'embedding must be L2-normalized'
      WHEN {_bad_limit}
      WHEN query_id % 17 = 0 THEN 'scope 999999 does not exist'
      WHEN scope_id NOT IN (SELECT id FROM l_scopes)
        THEN 'scope ' || scope_id || ' does not exist' END AS reason FROM l_queries)""")
_nth = ", ".join(f"max(record_id) FILTER (position = {i}) AS record_{i}" for i in (1, 2, 3))
O["guarded_recall"] = sql("l_ordered l_queries l_scopes", f"""SELECT a.query_id, {_outcome},
    CASE WHEN reason IS NULL THEN budget END AS budget_bytes, {_nth},
    CASE WHEN reason IS NULL THEN true END AS exact,
    CASE WHEN reason IS NULL THEN true END AS within_budget
    FROM asked a LEFT JOIN l_ordered o ON o.query_id = a.query_id AND reason IS NULL
    GROUP BY a.query_id, reason, budget""", """asked AS (SELECT query_id,
    CASE WHEN query_id % 7 > 0 THEN query_id % 32 * 1000 + 2000 ELSE 12000 END AS budget,
    CASE WHEN query_id % 7 > 0 AND query_id % 32 * 1000 + 2000 NOT BETWEEN 4000 AND 32000
        THEN 'max_bytes must be between 4000 and 32000'
      WHEN query_id % 23 > 0 AND strlen(query) > 256 THEN 'search query exceeds 256 bytes'
      WHEN query_id % 23 = 0 OR trim(query) = '' THEN 'recall query must not be empty'
      WHEN scope_id NOT IN (SELECT id FROM l_scopes)
        THEN 'scope ' || scope_id || ' does not exist' END AS reason FROM l_queries)""")
O["embedding_upsert"] = sql("l_partial l_records", """
    SELECT 'outcome' AS part, p.record_id, p.revision, CASE WHEN p.record_id % 10 = 0 THEN 'invalid'
      WHEN NOT r.readable THEN 'missing' WHEN r.current_revision <> p.revision THEN 'stale'
      ELSE 'applied' END AS outcome FROM l_partial p JOIN l_records r ON r.id = p.record_id
    UNION ALL SELECT 'stored', p.record_id, p.revision, '' FROM l_partial p
      JOIN l_records r ON r.id = p.record_id WHERE p.revision > 1
      OR (p.record_id % 10 <> 0 AND r.readable AND r.current_revision = p.revision)""")
_count = "length(t) - length(replace(t, '{}', '')) + 1"
_held = """held AS (SELECT p.record_id, p.revision, p.record_id % 3 = 1 AS other,
      CASE WHEN p.record_id % 3 = 1 THEN p.vector[1:4] ELSE [1, 0, 0, 0]::FLOAT[] END AS w
    FROM l_partial p),
  valid AS (SELECT h.* FROM held h JOIN l_records r ON r.id = h.record_id
    WHERE NOT r.readable OR (NOT other AND r.current_revision = h.revision))"""
O["embedding_sync"] = sql("l_records l_revisions l_partial", f"""SELECT record_id, revision,
    {", ".join(f"round(CAST(w[{i + 1}] AS DOUBLE), 5) AS v{i}" for i in range(4))} FROM valid
    UNION ALL SELECT record_id, revision,
    {", ".join(f"round(CAST(CAST(c{i} / n AS FLOAT) AS DOUBLE), 5) AS v{i}" for i in range(4))}
    FROM (SELECT *, sqrt(CAST(c0 * c0 + c1 * c1 + c2 * c2 + c3 * c3 AS DOUBLE)) AS n FROM (
      SELECT record_id, revision,
      {", ".join(f"{_count.format(c)} AS c{i}" for i, c in enumerate("aent"))} FROM (
        SELECT r.id AS record_id, v.revision,
          {squeeze("nfc_normalize(v.title || chr(10) || v.body)")} AS t
        FROM l_records r JOIN l_revisions v ON v.record_id = r.id
          AND v.revision = r.current_revision WHERE r.readable
          AND r.id NOT IN (SELECT record_id FROM valid))))""", _held)
O["record_text"] = sql("l_records l_revisions", f"""SELECT r.id AS record_id, v.revision,
    {squeeze("nfc_normalize(v.title || chr(10) || v.body)")} AS text FROM l_records r
    JOIN l_revisions v ON v.record_id = r.id AND v.revision = r.current_revision""")

# Recall

O["candidate_fusion"] = sql("l_fused", """SELECT query_id, record_id, bm25_rank,
    round(bm25_score, 6) AS bm25_score, dense_rank, round(dense_similarity, 6) AS dense_similarity
    FROM l_fused""")
O["recall_candidates"] = sql("l_lexical", """SELECT query_id, record_id, bm25_rank,
    NULL::BIGINT AS dense_rank, round(score, 6) AS bm25_score FROM l_lexical""")
_rrf = """round(coalesce(1.0::DOUBLE / (60 + bm25_rank), 0)
    + coalesce(1.0::DOUBLE / (60 + dense_rank), 0), 9)"""
O["rrf_score"] = sql("l_fused", f"SELECT query_id, record_id, {_rrf} AS rrf_score FROM l_fused")
O["matched_by"] = sql("l_fused", """SELECT query_id, record_id, concat_ws(',',
    CASE WHEN bm25_rank IS NOT NULL THEN 'bm25' END,
    CASE WHEN dense_rank IS NOT NULL THEN 'dense' END) AS matched_by FROM l_fused""")
O["recall_order"] = sql("l_ordered", "SELECT query_id, position, record_id FROM l_ordered")
_used = "Dense ordering is used because the semantic index is complete."
O["recall_explanation"] = sql("l_fused", f"""SELECT query_id, record_id, CASE
    WHEN dense_rank IS NOT NULL AND bm25_rank IS NOT NULL THEN
      printf('Dense rank %d with cosine %.4f; BM25 rank %d with score %.6f. {_used}',
             dense_rank, dense_similarity, bm25_rank, bm25_score)
    WHEN dense_rank IS NOT NULL THEN printf(
      'Dense rank %d with cosine %.4f; no top-20 BM25 match. {_used}', dense_rank, dense_similarity)
    ELSE printf('BM25 rank %d with score %.6f; no top-20 dense match.', bm25_rank, bm25_score)
    END AS text FROM l_fused""")
O["recall_explanation_bm25"] = sql("l_lexical", """SELECT query_id, record_id, printf(
    'BM25 rank %d with score %.6f; semantic retrieval is unavailable.', bm25_rank, score) AS text
    FROM l_lexical""")
O["recall_sources"] = sql("l_sources", """SELECT record_id, revision,
    string_agg(identity, ',' ORDER BY position) FILTER (position < 3) AS identities,
    string_agg(coalesce(content_hash, '-'), ',' ORDER BY position) FILTER (position < 3) AS hashes,
    count(*) AS source_count FROM l_sources GROUP BY ALL""")
O["recall_context"] = sql("l_ordered", f"""SELECT query_id, position, record_id, bm25_rank,
    round(bm25_score, 6) AS bm25_score, dense_rank, round(dense_similarity, 6) AS dense_similarity,
    {_rrf} AS rrf_score FROM l_ordered""")
O["recall_context_bm25"] = sql("l_lexical", """SELECT query_id, bm25_rank AS position, record_id,
    bm25_rank, round(score, 6) AS bm25_score FROM l_lexical WHERE bm25_rank <= 5""")
O["used_bytes"] = sql("l_queries", """SELECT query_id, true AS exact, true AS within_budget,
    true AS at_most_five FROM l_queries""")

# Ledger application

_judged = """j AS (SELECT d.*, sha256(request) AS h, w.op AS stored_op, w.request_hash AS stored_h,
      first_value(d.op) OVER x AS first_op, first_value(sha256(request)) OVER x AS first_h,
      row_number() OVER x AS nth
    FROM l_delivered d LEFT JOIN l_write_keys w ON w.key = d.key
    WINDOW x AS (PARTITION BY d.key ORDER BY ts, seq)),
  judged AS (SELECT *, CASE
      WHEN stored_op IS NOT NULL THEN CASE WHEN op = stored_op AND h = stored_h
           THEN 'replayed' ELSE 'conflict' END
      WHEN nth = 1 THEN 'applied' WHEN op = first_op AND h = first_h THEN 'replayed'
      ELSE 'conflict' END AS outcome FROM j)"""
O["idempotent_intake"] = sql("l_delivered l_write_keys", """SELECT key, seq, outcome,
    CASE WHEN outcome = 'conflict' THEN
      'idempotency key was already used for a different write' END AS reason FROM judged""", _judged)
O["stream_intake"] = O["idempotent_intake"]
O["new_write_keys"] = sql("l_delivered l_write_keys l_commands", """SELECT j.key,
    j.op AS operation, h AS request_hash, c.record_id AS result_id FROM judged j
    JOIN l_commands c ON c.key = j.key WHERE outcome = 'applied'""", _judged)
O["command_guards"] = sql("l_commands l_records l_labels l_visible", """SELECT c.key,
    r.kind AS record_kind, r.current_revision, r.lifecycle, CASE
    WHEN op <> 'retract_relation' AND r.id IS NULL
      THEN 'record ' || c.record_id || ' does not exist'
    WHEN op = 'add_label' AND l.id IS NULL THEN 'label ' || c.label_id || ' does not exist'
    WHEN op = 'add_relation' AND t.id IS NULL
      THEN 'record ' || c.target_record_id || ' does not exist'
    WHEN op = 'retract_relation' AND v.id IS NULL
      THEN 'relation ' || c.relation_id || ' does not exist' END AS guard
    FROM l_commands c LEFT JOIN l_records r ON r.id = c.record_id AND r.readable
    LEFT JOIN l_records t ON t.id = c.target_record_id AND t.readable
    LEFT JOIN l_labels l ON l.id = c.label_id LEFT JOIN l_visible v ON v.id = c.relation_id""")
O["derived_keys"] = sql("l_commands", """SELECT key,
    concat_ws(':', key, 'label', label_id) AS label_key, key || ':lifecycle' AS created_key,
    concat_ws(':', key, 'lifecycle', record_id) AS lifecycle_key,
    concat_ws(':', key, 'relation', record_id, target_record_id, relation_kind) AS relation_key
    FROM l_commands""")
O["id_allocation"] = sql("l_commands", f"""SELECT key,
    {N} + row_number() OVER (ORDER BY ts, seq) AS id FROM l_commands""")
_asked_scopes = f"""asked AS (SELECT *, CASE WHEN lower({utrim("name")}) = 'global' THEN 'global'
      ELSE {utrim("name")} END AS canon FROM (
    SELECT 'c' || c_custkey AS key, c_custkey AS seq, CASE c_nationkey % 4
      WHEN 0 THEN upper(c_mktsegment) WHEN 1 THEN lower(c_mktsegment)
      WHEN 2 THEN '  ' || c_mktsegment || chr(9) ELSE ' ' || chr(10) || ' ' END AS name FROM customer
    UNION ALL SELECT 's' || s_suppkey, s_suppkey + 100000000, 'Global' FROM supplier)),
  firsts AS (SELECT lower(canon) AS k, min(seq) AS seq, arg_min(canon, seq) AS name,
      arg_min(key, seq) AS key FROM asked
    WHERE canon <> '' AND lower(canon) NOT IN (SELECT lower(name) FROM l_scopes) GROUP BY ALL),
  made AS (SELECT *, (SELECT max(id) FROM l_scopes) + row_number() OVER (ORDER BY seq) AS id
    FROM firsts)"""
O["created_scopes"] = sql("l_scopes", "SELECT id, name, key FROM made", _asked_scopes)
O["apply_create_scope"] = sql("l_scopes", """SELECT a.key,
    CASE WHEN canon = '' THEN 'invalid' ELSE 'applied' END AS outcome, CASE WHEN canon = '' THEN
      'scope name must be a non-empty single line of at most 200 bytes' END AS reason,
    CASE WHEN canon <> '' THEN coalesce(s.id, m.id) END AS result_id,
    m.seq IS NOT DISTINCT FROM a.seq AS created
    FROM asked a LEFT JOIN l_scopes s ON lower(s.name) = lower(canon)
    LEFT JOIN made m ON m.k = lower(canon)""", _asked_scopes)
_owner = """owner AS (SELECT c_nationkey AS n, arg_min(lower(c_mktsegment), c_custkey) AS seg
    FROM customer GROUP BY ALL)"""
O["apply_create_label"] = f"""WITH {_owner} SELECT 'c' || c_custkey AS key,
    CASE WHEN lower(c_mktsegment) = seg THEN 'applied' ELSE 'conflict' END AS outcome
    FROM customer JOIN owner ON n = c_nationkey"""
O["created_label_aliases"] = f"""WITH {_owner} SELECT seg AS key, 'nation-' || n AS alias,
    (SELECT any_value(c_mktsegment) FROM customer WHERE lower(c_mktsegment) = seg) AS display_name
    FROM owner"""
_creates = """c AS (SELECT d.*, quality, CASE
      WHEN quality = 0 THEN 'record requires at least one active label'
      WHEN kind IN ('observation','metric','evidence') AND n_chars <= 300
        THEN kind || ' requires at least one source'
      WHEN lang = 'de' THEN 'scope 100000 does not exist' END AS error
    FROM l_docs d LEFT JOIN labels l ON l.doc_id = d.doc_id),
  made AS (SELECT *, (SELECT count(*) FROM documents) + row_number() OVER (ORDER BY doc_id) AS new_id
    FROM c WHERE error IS NULL)"""
O["apply_create_record"] = sql("l_docs", """SELECT 'd' || c.doc_id AS key,
    CASE WHEN c.error IS NULL THEN 'applied' ELSE 'invalid' END AS outcome, c.error AS reason,
    new_id AS result_id FROM c LEFT JOIN made m ON m.doc_id = c.doc_id""", _creates)
O["created_rows"] = sql("l_docs", """
    SELECT 'record' AS part, new_id AS record_id,
      kind || '|' || source || ' ' || doc_id || '|d' || doc_id AS row FROM made
    UNION ALL SELECT 'source', new_id, '0|id ' || doc_id || '|file:///' || source || '|-' FROM made
      WHERE n_chars > 300
    UNION ALL SELECT 'label', new_id, l || '|d' || doc_id || ':label:' || l FROM (
      SELECT *, unnest(CASE WHEN quality = 1 THEN [3] ELSE [1, 2] END) AS l FROM made)
    UNION ALL SELECT 'state', new_id, 'active|d' || doc_id || ':lifecycle' FROM made""", _creates)
O["apply_revise"] = sql("l_commands l_records", """SELECT o.key, o.record_id,
    CASE WHEN r.id IS NULL THEN 'invalid' WHEN won THEN 'applied' ELSE 'conflict' END AS outcome,
    CASE WHEN r.id IS NULL THEN 'record ' || o.record_id || ' does not exist'
      WHEN NOT won THEN 'revision conflict: expected ' || expected_revision || ', current ' || cur
    END AS reason, CASE WHEN r.id IS NOT NULL AND won THEN expected_revision + 1 END AS new_revision
    FROM steps o LEFT JOIN l_records r ON r.id = o.record_id AND r.readable""", """
  o AS (SELECT key, record_id, expected_revision,
      row_number() OVER (PARTITION BY record_id ORDER BY ts, seq) AS nth
    FROM l_commands WHERE op = 'revise_record'),
  steps AS (SELECT key, record_id, expected_revision, nth, expected_revision = 1 AS won,
      CASE WHEN expected_revision = 1 THEN 2 ELSE 1 END AS cur FROM o WHERE nth = 1
    UNION ALL SELECT o.key, o.record_id, o.expected_revision, o.nth, o.expected_revision = s.cur,
      CASE WHEN o.expected_revision = s.cur THEN s.cur + 1 ELSE s.cur END
    FROM steps s JOIN o ON o.record_id = s.record_id AND o.nth = s.nth + 1)""")
_label_run = """
  o AS (SELECT c.key, op, c.record_id, c.label_id,
      row_number() OVER (PARTITION BY c.record_id ORDER BY ts, seq) AS nth
    FROM l_commands c JOIN l_records r ON r.id = c.record_id AND r.readable
    JOIN l_labels l ON l.id = c.label_id WHERE op IN ('add_label','retract_label')),
  base AS (SELECT record_id, list(label_id) AS held FROM l_active GROUP BY ALL),
  steps AS (SELECT record_id, 0::BIGINT AS nth, held, NULL::VARCHAR AS key, NULL::VARCHAR AS op,
      NULL::VARCHAR AS reason FROM base
    UNION ALL SELECT s.record_id, s.nth + 1,
      CASE WHEN o.op = 'add_label' AND NOT list_contains(held, label_id)
             THEN list_append(held, label_id)
           WHEN o.op = 'retract_label' AND list_contains(held, label_id) AND len(held) > 1
             THEN list_filter(held, lambda x: x <> label_id) ELSE held END,
      o.key, o.op, CASE WHEN o.op = 'add_label' THEN CASE WHEN list_contains(held, label_id)
             THEN 'label is already active on record' END
           WHEN NOT list_contains(held, label_id) THEN 'label is not active on record'
           WHEN len(held) = 1 THEN 'a record must retain at least one active label' END
    FROM steps s JOIN o ON o.record_id = s.record_id AND o.nth = s.nth + 1)"""
for _op in ("add_label", "retract_label"):
    O[f"apply_{_op}"] = sql("l_commands l_records l_labels l_active", f"""SELECT c.key, CASE
      WHEN r.id IS NULL OR (l.id IS NULL AND c.op = 'add_label') THEN 'invalid'
      WHEN s.reason IS NULL THEN 'applied' ELSE 'conflict' END AS outcome,
      CASE WHEN r.id IS NULL THEN 'record ' || c.record_id || ' does not exist'
           WHEN l.id IS NULL AND c.op = 'add_label' THEN 'label ' || c.label_id || ' does not exist'
           ELSE s.reason END AS reason
      FROM l_commands c LEFT JOIN l_records r ON r.id = c.record_id AND r.readable
      LEFT JOIN l_labels l ON l.id = c.label_id LEFT JOIN steps s ON s.key = c.key
      WHERE c.op = '{_op}'""", _label_run)
_inbox_run = _label_run.replace(
    "SELECT record_id, list(label_id) AS held FROM l_active GROUP BY ALL",
    "SELECT doc_id + 1 AS record_id, [1::BIGINT] AS held FROM documents",
)
O["apply_last_label"] = sql("l_commands l_records l_labels", """SELECT c.key, CASE
    WHEN r.id IS NULL OR (l.id IS NULL AND c.op = 'add_label') THEN 'invalid'
    WHEN s.reason IS NULL THEN 'applied' ELSE 'conflict' END AS outcome,
    CASE WHEN r.id IS NULL THEN 'record ' || c.record_id || ' does not exist'
         WHEN l.id IS NULL AND c.op = 'add_label' THEN 'label ' || c.label_id || ' does not exist'
         ELSE s.reason END AS reason
    FROM l_commands c LEFT JOIN l_records r ON r.id = c.record_id AND r.readable
    LEFT JOIN l_labels l ON l.id = c.label_id LEFT JOIN steps s ON s.key = c.key
    WHERE c.op IN ('add_label', 'retract_label')""", _inbox_run)
O["label_ledger_rows"] = sql("l_commands l_records l_labels l_active l_assertions", """
    SELECT part, assertion_id, key FROM (
      SELECT 'assertion' AS part, id AS assertion_id, key FROM adds
      UNION ALL SELECT 'retraction', coalesce(
        (SELECT max(a.id) FROM adds a WHERE a.record_id = d.record_id AND a.label_id = d.label_id
           AND (a.ts, a.seq) < (d.ts, d.seq)),
        (SELECT max(a.id) FROM l_active a WHERE a.record_id = d.record_id
           AND a.label_id = d.label_id)), key
      FROM done d WHERE d.op = 'retract_label')""", _label_run + """,
  done AS (SELECT c.* FROM l_commands c JOIN steps s ON s.key = c.key AND s.reason IS NULL),
  adds AS (SELECT *, (SELECT max(id) FROM l_assertions) + row_number() OVER (ORDER BY ts, seq)
    AS id FROM done WHERE op = 'add_label')""")
_revise_run = """
  o AS (SELECT key, actor, c.record_id, expected_revision,
      row_number() OVER (PARTITION BY c.record_id ORDER BY ts, seq) AS nth
    FROM l_commands c JOIN l_records r ON r.id = c.record_id AND r.readable
    WHERE op = 'revise_record'),
  steps AS (SELECT record_id, 0::BIGINT AS nth, 1::BIGINT AS cur, NULL::VARCHAR AS key,
      NULL::VARCHAR AS actor, false AS won FROM o WHERE nth = 1
    UNION ALL SELECT o.record_id, o.nth, s.cur + CASE WHEN expected_revision = s.cur THEN 1
      ELSE 0 END, o.key, o.actor, expected_revision = s.cur
    FROM steps s JOIN o ON o.record_id = s.record_id AND o.nth = s.nth + 1)"""
O["revision_ledger_rows"] = sql("l_commands l_records", """
    SELECT 'revision' AS part, record_id, cur AS revision, 'by ' || actor || '|' || key AS row
      FROM steps WHERE won
    UNION ALL SELECT 'source', record_id, cur, '0|' || actor FROM steps WHERE won
    UNION ALL SELECT 'record', id, coalesce(last, 1), coalesce('by ' || who, title) FROM l_records r
      LEFT JOIN (SELECT record_id, max(cur) AS last, arg_max(actor, cur) AS who FROM steps
        WHERE won GROUP BY record_id) n ON n.record_id = r.id""", _revise_run)
O["apply_add_relation"] = sql("l_commands l_records l_relations l_rel_retracted", """
    SELECT key, CASE WHEN error IS NOT NULL THEN 'invalid' WHEN nth = 1 AND NOT taken THEN 'applied'
      ELSE 'conflict' END AS outcome,
    CASE WHEN error IS NOT NULL THEN error WHEN nth = 1 AND NOT taken THEN NULL
      ELSE 'relation is already active' END AS reason
    FROM (SELECT *, row_number() OVER (PARTITION BY record_id, target_record_id, relation_kind,
        error IS NULL ORDER BY ts, seq) AS nth,
      EXISTS (SELECT 1 FROM l_relations e WHERE e.source_record_id = q.record_id
        AND e.target_record_id = q.target_record_id AND e.kind = q.relation_kind
        AND e.id NOT IN (SELECT relation_id FROM l_rel_retracted)) AS taken FROM (
      SELECT c.*, CASE WHEN c.record_id = c.target_record_id
          THEN 'a relation cannot target its source'
        WHEN s.id IS NULL THEN 'record ' || c.record_id || ' does not exist'
        WHEN t.id IS NULL THEN 'record ' || c.target_record_id || ' does not exist' END AS error
      FROM l_commands c LEFT JOIN l_records s ON s.id = c.record_id AND s.readable
      LEFT JOIN l_records t ON t.id = c.target_record_id AND t.readable
      WHERE op = 'add_relation') q)""")
O["apply_retract_relation"] = sql("l_commands l_visible l_rel_retracted", """SELECT c.key,
    CASE WHEN v.id IS NULL THEN 'invalid' WHEN nth = 1 AND NOT gone THEN 'applied'
      ELSE 'conflict' END AS outcome,
    CASE WHEN v.id IS NULL THEN 'relation ' || c.relation_id || ' does not exist'
      WHEN nth = 1 AND NOT gone THEN NULL ELSE 'relation is already retracted' END AS reason
    FROM (SELECT *, row_number() OVER (PARTITION BY relation_id ORDER BY ts, seq) AS nth,
      relation_id IN (SELECT relation_id FROM l_rel_retracted) AS gone
      FROM l_commands WHERE op = 'retract_relation') c
    LEFT JOIN l_visible v ON v.id = c.relation_id""")
O["apply_transition"] = sql("l_commands l_records", """SELECT c.key,
    CASE WHEN r.id IS NULL THEN 'invalid' WHEN nth = 1 THEN 'applied' ELSE 'conflict' END AS outcome,
    CASE WHEN r.id IS NULL THEN 'record ' || c.record_id || ' does not exist'
      WHEN nth > 1 THEN 'only an active record can transition' END AS reason
    FROM (SELECT *, row_number() OVER (PARTITION BY record_id ORDER BY ts, seq) AS nth
      FROM l_commands WHERE op = 'transition_record') c
    LEFT JOIN l_records r ON r.id = c.record_id AND r.readable""")
_plain = O["apply_add_relation"]
_mixed_add = sql("l_commands l_records l_relations l_rel_retracted l_visible", """
    SELECT key, CASE WHEN error IS NOT NULL THEN 'invalid' WHEN nth = 1 AND free THEN 'applied'
      ELSE 'conflict' END AS outcome, CASE WHEN error IS NOT NULL THEN error
      WHEN nth = 1 AND free THEN NULL ELSE 'relation is already active' END AS reason
    FROM (SELECT *, row_number() OVER (PARTITION BY record_id, target_record_id, relation_kind, free
        ORDER BY ts, seq) AS nth FROM (
      SELECT c.*, CASE WHEN c.record_id = c.target_record_id
          THEN 'a relation cannot target its source'
        WHEN s.id IS NULL THEN 'record ' || c.record_id || ' does not exist'
        WHEN t.id IS NULL THEN 'record ' || c.target_record_id || ' does not exist' END AS error,
        error IS NULL AND (e.id IS NULL OR coalesce((c.ts, c.seq) > x.released, false)) AS free
      FROM l_commands c LEFT JOIN l_records s ON s.id = c.record_id AND s.readable
      LEFT JOIN l_records t ON t.id = c.target_record_id AND t.readable
      LEFT JOIN l_relations e ON e.source_record_id = c.record_id
        AND e.target_record_id = c.target_record_id AND e.kind = c.relation_kind
        AND e.id NOT IN (SELECT relation_id FROM l_rel_retracted)
      LEFT JOIN (SELECT relation_id, min((ts, seq)) AS released FROM l_commands c
        JOIN l_visible v ON v.id = c.relation_id WHERE op = 'retract_relation' GROUP BY relation_id) x
        ON x.relation_id = e.id
      WHERE op = 'add_relation'))""")
_fresh_revise = O["apply_revise"].replace(
    "WHERE op = 'revise_record'", "WHERE op = 'revise_record' AND CAST(substr(key, 2) AS BIGINT) % 3 <> 0")
_outcomes = f"""firsts AS (SELECT key, outcome, reason, new_revision FROM ({_fresh_revise})
    {" ".join(f"UNION ALL SELECT key, outcome, reason, NULL FROM ({q})" for q in (
        O["apply_add_label"], O["apply_retract_label"], _mixed_add, O["apply_retract_relation"],
        O["apply_transition"]))}),
  judged AS (SELECT d.key, d.seq, d.seq = c.seq AS is_first, CASE
      WHEN f.key IS NULL OR (d.seq <> c.seq AND f.outcome = 'applied') THEN
        CASE WHEN d.op = c.op AND d.request = c.request THEN 'replayed' ELSE 'conflict' END
      WHEN d.op = 'read_record' THEN 'invalid' ELSE f.outcome END AS outcome,
    CASE WHEN f.key IS NULL OR (d.seq <> c.seq AND f.outcome = 'applied') THEN
        CASE WHEN NOT (d.op = c.op AND d.request = c.request)
          THEN 'idempotency key was already used for a different write' END
      WHEN d.op = 'read_record' THEN 'operation is not known' ELSE f.reason END AS reason,
    CASE WHEN d.seq = c.seq THEN new_revision END AS new_revision
    FROM l_delivered d JOIN l_commands c ON c.key = d.key LEFT JOIN firsts f ON f.key = d.key)"""
_head = f"""WITH {", ".join(f"{n} AS ({CTES[n][1]})" for n in closure(
    ["l_delivered", "l_commands", "l_records", "l_relations"]))}, {_outcomes}"""
O["apply_batch"] = f"{_head} SELECT key, seq, outcome, reason, new_revision FROM judged"
O["creating_batch"] = sql("l_records l_scopes", """asked AS (
    SELECT c_custkey::BIGINT + 1 AS k, n_name, unnest(range(1, 9)) AS step FROM customer JOIN nation ON n_nationkey = c_nationkey
  ), judged AS (
    SELECT *, step <= 2 OR step = 5 OR step = 3 OR (step = 6 AND k % 3 = 2) AS won FROM asked
    WHERE k % [1, 1, 3, 6, 5, 7, 11, 13][step] = 0
  ), scope_ids AS (
    SELECT n_name, (SELECT max(id) FROM l_scopes) + row_number() OVER (ORDER BY min(k)) AS id FROM judged WHERE step = 1 GROUP BY n_name
  ), record_ids AS (
    SELECT k, step, (SELECT max(id) FROM l_records) + row_number() OVER (ORDER BY k, step) AS id
    FROM judged WHERE won AND step IN (2, 3, 6)
  )
  SELECT ['s', 'r', 'x', 't', 'a', 'm', 'z', 'f'][j.step] || j.k AS key, j.k * 10 + j.step AS seq,
    CASE WHEN won THEN 'applied' WHEN j.step IN (4, 6) THEN 'conflict' ELSE 'invalid' END AS outcome,
    CASE WHEN won THEN NULL WHEN j.step = 4 THEN 'only an active record can transition'
      WHEN j.step = 6 THEN 'only active records can be merged' WHEN j.step = 7 THEN 'operation is not known'
      ELSE 'no earlier command made a record under the key r' || (j.k + 1) END AS reason,
    CASE j.step WHEN 1 THEN s.id ELSE r.id END AS made_id
  FROM judged j LEFT JOIN scope_ids s ON s.n_name = j.n_name AND j.step = 1
    LEFT JOIN record_ids r ON r.k = j.k AND r.step = j.step""").replace(")\nasked AS", "),\nasked AS", 1)
O["ledger_after_batch"] = f"""{_head}, won AS (SELECT c.*, j.new_revision FROM judged j
    JOIN l_commands c ON c.key = j.key WHERE is_first AND outcome = 'applied'),
  edges AS (SELECT *, (SELECT max(id) FROM l_relations) + row_number() OVER (ORDER BY ts, seq) AS id
    FROM won WHERE op = 'add_relation')
  SELECT 'records' AS part, id, coalesce(last, 1) || '|' || CASE WHEN id IN (
      SELECT record_id FROM won WHERE op = 'transition_record') THEN 'retracted' ELSE 'active' END
      || '|' || coalesce('by ' || who, title) AS row FROM l_records r LEFT JOIN (
        SELECT record_id, max(new_revision) AS last, arg_max(actor, new_revision) AS who FROM won
        WHERE op = 'revise_record' GROUP BY record_id) n ON n.record_id = r.id
  UNION ALL SELECT 'record_revisions', record_id, new_revision || '|by ' || actor || '|' || actor
    || '|' || key FROM won WHERE op = 'revise_record'
  UNION ALL SELECT 'label_assertions', record_id, label_id || '|' || actor || '|' || key || ':label:'
    || label_id FROM won WHERE op = 'add_label'
  UNION ALL SELECT 'label_retractions', 0, actor || '|' || key FROM won WHERE op = 'retract_label'
  UNION ALL SELECT 'record_relations', id, record_id || '|' || actor || '|' || concat_ws(':', key,
    'relation', record_id, target_record_id, relation_kind) FROM edges
  UNION ALL SELECT 'relation_retractions', relation_id, actor || '|' || key FROM won
    WHERE op = 'retract_relation'
  UNION ALL SELECT 'lifecycle_transitions', record_id, 'retracted|' || actor || '|' || key
    || ':lifecycle:' || record_id FROM won WHERE op = 'transition_record'
  UNION ALL SELECT 'write_keys', CASE op WHEN 'retract_relation' THEN relation_id
      WHEN 'add_relation' THEN (SELECT id FROM edges e WHERE e.key = w.key) ELSE record_id END,
    key || '|' || op || '|' || sha256(request) FROM won w"""
O["relation_ledger_rows"] = f"""WITH added AS ({_plain}), ended AS ({O["apply_retract_relation"]}),
    {", ".join(f"{n} AS ({CTES[n][1]})" for n in closure(["l_commands", "l_relations"]))}
    SELECT 'edge' AS part, (SELECT max(id) FROM l_relations)
      + row_number() OVER (ORDER BY ts, seq) AS id, concat_ws(':', c.key, 'relation', record_id,
      target_record_id, relation_kind) AS idempotency_key
    FROM l_commands c JOIN added a ON a.key = c.key AND a.outcome = 'applied'
    UNION ALL SELECT 'end', relation_id, c.key FROM l_commands c
    JOIN ended e ON e.key = c.key AND e.outcome = 'applied'"""
O["transition_ledger_rows"] = sql("l_commands l_records", """
    SELECT 'transition' AS part, c.record_id, key || ':lifecycle:' || c.record_id AS row
    FROM (SELECT *, row_number() OVER (PARTITION BY record_id ORDER BY ts, seq) AS nth
      FROM l_commands WHERE op = 'transition_record') c
    JOIN l_records r ON r.id = c.record_id AND r.readable WHERE nth = 1
    UNION ALL SELECT 'record', id, lifecycle FROM l_records""")
_turns = f"""t AS (SELECT conv_id, turn, 't:' || conv_id || ':' || turn AS key,
      row_number() OVER (ORDER BY conv_id, turn) AS seq, (conv_id * 3 + turn * 5) % {N} + 1 AS record_id
    FROM conversations)"""
_superseded = _turns + f""",
  s AS (SELECT t.*, r.id IS NOT NULL AS seen, lifecycle = 'active' AND row_number() OVER (
      PARTITION BY record_id ORDER BY seq) = 1 AS won
    FROM t LEFT JOIN l_records r ON r.id = t.record_id AND r.readable),
  made AS (SELECT *, {N} + row_number() OVER (ORDER BY seq) AS new_id FROM s WHERE seen AND won)"""
O["apply_supersede"] = sql("l_records", """SELECT s.key, CASE WHEN NOT s.seen THEN 'invalid'
    WHEN s.won THEN 'applied' ELSE 'conflict' END AS outcome,
    CASE WHEN NOT s.seen THEN 'record ' || s.record_id || ' does not exist'
      WHEN NOT s.won THEN 'only an active record can be superseded' END AS reason,
    new_id AS result_id FROM s LEFT JOIN made m ON m.seq = s.seq""", _superseded)
O["superseded_edges"] = sql("l_records", """SELECT new_id AS source_record_id,
    record_id AS target_record_id, 'supersedes' AS kind,
    key || ':relation:' || new_id || ':' || record_id || ':supersedes' AS idempotency_key
    FROM made""", _superseded)
_merged = _turns + f""",
  m AS (SELECT conv_id, list_sort(list(DISTINCT record_id)) AS ids, row_number() OVER (
      ORDER BY conv_id) AS nth FROM t GROUP BY conv_id),
  states AS (SELECT conv_id, ids, nth, min(CASE WHEN r.id IS NULL THEN x END) AS missing,
      bool_and(coalesce(lifecycle = 'active', false)) AS fine
    FROM (SELECT *, unnest(ids) AS x FROM m) LEFT JOIN l_records r ON r.id = x AND r.readable
    GROUP BY ALL),
  run AS (SELECT 0::BIGINT AS nth, []::BIGINT[] AS gone, false AS won
    UNION ALL SELECT s.nth,
      CASE WHEN len(ids) >= 2 AND fine AND NOT list_has_any(gone, ids)
           THEN list_concat(gone, ids) ELSE gone END,
      len(ids) >= 2 AND fine AND NOT list_has_any(gone, ids)
    FROM run JOIN states s ON s.nth = run.nth + 1),
  done AS (SELECT s.*, won, CASE WHEN won THEN {N} + count(*) FILTER (won) OVER (ORDER BY s.nth) END
      AS new_id FROM states s JOIN run USING (nth))"""
O["apply_merge"] = sql("l_records", """SELECT 'm' || conv_id AS key,
    CASE WHEN len(ids) < 2 OR missing IS NOT NULL THEN 'invalid' WHEN won THEN 'applied'
      ELSE 'conflict' END AS outcome,
    CASE WHEN len(ids) < 2 THEN 'merge requires at least two records'
      WHEN missing IS NOT NULL THEN 'record ' || missing || ' does not exist'
      WHEN NOT won THEN 'only active records can be merged' END AS reason,
    new_id AS result_id FROM done""", _merged)
O["merged_transitions"] = sql("l_records", """SELECT id AS record_id, 'active' AS from_state,
    'merged' AS to_state, 'm' || conv_id || ':lifecycle:' || id AS idempotency_key
    FROM (SELECT conv_id, unnest(ids) AS id FROM done WHERE won)""", _merged)

# Quality rules

_line = "{} must be a non-empty single line of at most {} bytes"


def bad_line(x: str, n: int) -> str:
    t = utrim(x)
    return f"({x} IS NULL OR {t} = '' OR octet_length(encode({t})) > {n} OR regexp_matches({t}, '[\\r\\n]'))"


_sources_missing = "kind IN ('observation','metric','evidence')"
O["validate_records"] = sql("l_docs", f"""SELECT 'd' || d.doc_id AS key, CASE
    WHEN {bad_line("title", 200)} THEN '{_line.format("title", 200)}'
    WHEN quality = 0 THEN 'record requires at least one active label'
    WHEN {_sources_missing} AND n_chars <= 300 THEN kind || ' requires at least one source'
    END AS error FROM (SELECT * REPLACE (CASE WHEN doc_id % 2 = 0 THEN source || ' ' || doc_id
      WHEN kind = 'note' THEN text END AS title) FROM l_docs) d
    LEFT JOIN labels l ON l.doc_id = d.doc_id""")
O["validate_payload"] = sql("l_revisions", f"""SELECT record_id, revision,
    CASE WHEN {_sources_missing} AND (revision > 1 OR (record_id - 1) % 4 = 0)
      THEN kind || ' requires at least one source' END AS error FROM l_revisions""")
O["validate_source"] = f"""SELECT page_id, CASE WHEN page_id % 3 = 0 OR {bad_line("url", 200)}
      THEN '{_line.format("source identity", 200)}'
    WHEN page_id % 3 = 1 AND {bad_line("html", 200)}
      THEN '{_line.format("source locator", 200)}' END AS error FROM pages"""
O["validate_text"] = """SELECT doc_id, NULL AS as_is, 'body must not be empty' AS blanked,
    'Mermaid block 1 is unclosed' AS unclosed FROM documents"""
O["validate_single_line"] = f"""SELECT item, CASE WHEN {bad_line("text", 200)}
    THEN '{_line.format("title", 200)}' END AS error FROM (
    SELECT 'c:' || conv_id || ':' || turn AS item, text FROM conversations
    UNION ALL SELECT 'b:' || item_id, text FROM benchmark
    UNION ALL SELECT 'p:' || page_id, chr(10) || url FROM pages)"""
O["validate_label_part"] = f"""SELECT value, CASE WHEN {bad_line("value", 64)}
      THEN '{_line.format("facet", 64)}'
    WHEN NOT regexp_full_match({utrim("value")}, '[a-z0-9_-]+') THEN
      'facet must contain only lowercase ASCII letters, digits, underscore, or hyphen' END AS error
    FROM (SELECT p_brand AS value FROM part UNION SELECT lower(p_type) FROM part
    UNION SELECT lower(replace(p_brand, '#', '-')) FROM part UNION SELECT ' ' || source FROM documents
    UNION SELECT n_name FROM nation UNION SELECT text FROM benchmark)"""
O["canonical_aliases"] = """SELECT p_partkey, array_to_string(list_sort(list_distinct(
    [lower(trim(p_type)), lower(p_brand)])), '|') AS aliases FROM part"""
O["validate_context"] = f"""SELECT conv_id, turn, CASE
    WHEN turn = 0 THEN '{_line.format("idempotency_key", 200)}'
    WHEN {bad_line("text", 500)} THEN '{_line.format("actor", 500)}' END AS error
    FROM conversations"""
O["validate_timestamp"] = """SELECT event_id, CASE WHEN event_type NOT IN ('view','click')
      THEN 'observed_at must be an RFC 3339 timestamp' END AS error,
    CASE event_type WHEN 'view' THEN epoch_us(ts) // 1000
      WHEN 'click' THEN epoch_us(ts) // 1000 - 7200000 END
    AS millis FROM events"""
O["validate_query"] = """SELECT item_id, CASE WHEN item_id % 3 = 0 THEN 'scope_id must be positive'
    WHEN (item_id + 20) % 60 NOT BETWEEN 1 AND 50 THEN 'limit must be between 1 and 50'
    WHEN octet_length(encode(text)) > 256 THEN 'search query exceeds 256 bytes'
    WHEN item_id * 500 + 12000 > 32000 THEN 'max_bytes must be between 4000 and 32000' END AS error
    FROM benchmark"""
O["trim_option"] = f"""SELECT conv_id, turn, CASE WHEN turn % 3 = 1 THEN
    nullif({utrim("text")}, '') END AS value FROM conversations"""

# Links, blocks, legacy import

_notes = f"""notes AS (SELECT doc_id + 1 AS id, CASE WHEN lang = 'en' THEN 'note' ELSE 'artifact' END
      AS kind, CASE WHEN doc_id IN (SELECT doc_id FROM labels WHERE toxic = 1) THEN 'private'
      ELSE 'shared' END AS visibility, CASE WHEN lang = 'fr' THEN 'agent' ELSE 'user' END AS author,
      text, ((doc_id + 1) * 7 + 3) % ({N} + 20) + 1 AS a, ((doc_id + 1) * 5) % {N} + 1 AS b
    FROM documents),
  bodies AS (SELECT *, ' [[note:' || a || '|see it]] ' || text || ' [[note:' || b || '|see it]]'
      || ' [[note:' || a || '|see it]] [[note:0|x]].' AS body FROM notes),
  edges AS (SELECT DISTINCT id AS source_record_id, t AS target_record_id FROM (
      SELECT id, unnest([a, b]) AS t FROM notes) WHERE t <> id AND t <= {N})"""
O["link_extract"] = f"""WITH {_notes} SELECT id, position, target_id FROM (
    SELECT id, unnest(ids) AS target_id, generate_subscripts(ids, 1) - 1 AS position FROM (
      SELECT id, list_transform(regexp_extract_all(body,
        '\\[\\[note:(\\d+)\\|[^\\]\\|\\n\\r\\\\]*\\]\\]', 1), lambda x: CAST(x AS BIGINT)) AS ids
      FROM bodies)) WHERE target_id > 0"""
O["link_redact"] = f"""WITH {_notes}, open AS (SELECT id FROM notes WHERE visibility = 'shared')
    SELECT id AS record_id, CASE WHEN a IN (FROM open) THEN ' [[note:' || a || '|see it]] '
      ELSE '  ' END || text || CASE WHEN b IN (FROM open) THEN ' [[note:' || b || '|see it]]'
      ELSE ' ' END || CASE WHEN a IN (FROM open) THEN ' [[note:' || a || '|see it]]'
      ELSE ' ' END || ' [[note:0|x]].' AS body FROM notes"""
O["visible_revisions"] = O["link_redact"]
_edge_key = "'schema-v8:legacy-reference:' || source_record_id || ':' || target_record_id"
O["legacy_relations"] = f"""WITH {_notes} SELECT source_record_id, target_record_id,
    'references' AS kind, 'legacy note link' AS reason, {_edge_key} AS idempotency_key FROM edges"""
_title = "'Imported legacy ' || kind || ' ' || id"
O["imported_title"] = f"WITH {_notes} SELECT id, {_title} AS title FROM notes"
O["import_metadata"] = f"""WITH {_notes} SELECT id, CAST(json_object('legacy', json_object(
    'created_at', '2026-01-01T08:00:00Z', 'updated_at', '2026-01-02T08:00:00Z', 'author', author,
    'day', '2026-01-01', 'kind', kind, 'visibility', visibility, 'revision', 1)) AS VARCHAR)
    AS metadata FROM notes"""
O["legacy_import"] = f"""WITH {_notes}
    SELECT 'record' AS part, id, {_title} || '|note|' || CASE WHEN visibility = 'shared' THEN 'true'
      ELSE 'false' END || '|schema-v8:legacy-record:' || id AS row FROM notes
    UNION ALL SELECT 'revision', id, body FROM bodies
    UNION ALL SELECT 'label', id, 'schema-v8:legacy-record:' || id || ':label' FROM notes
    UNION ALL SELECT 'state', id, 'schema-v8:legacy-record:' || id || ':lifecycle' FROM notes
    UNION ALL SELECT 'edge', source_record_id, {_edge_key} FROM edges"""
_entries = """entries AS (SELECT event_id AS id, strftime(ts, '%Y-%m-%d') AS day,
      strftime(ts, '%Y-%m-%dT%H:%M') AS created_at,
      strftime(ts + INTERVAL 1 DAY, '%Y-%m-%dT%H:%M') AS updated_at,
      CASE WHEN value < 10 THEN '' ELSE props END AS body FROM events),
  days AS (SELECT day, arg_min(id, (created_at, id)) AS id, min(created_at) AS created_at,
      max(updated_at) AS updated_at FROM entries GROUP BY day)"""
O["legacy_day_rollup"] = f"""WITH {_entries} SELECT id, day, created_at, updated_at FROM days"""
O["legacy_day_rollup_parts"] = f"""WITH {_entries} SELECT day, id AS entry_id, body,
    row_number() OVER (PARTITION BY day ORDER BY created_at, id) - 1 AS position
    FROM entries WHERE body <> ''"""
O["legacy_defaults"] = f"""WITH {_entries} SELECT id, day, 'shared' AS visibility,
    'user' AS author, 1 AS revision FROM days"""
O["daily_conflicts"] = f"""WITH {_entries} SELECT day, count(*) AS n FROM entries GROUP BY day
    HAVING count(*) > 1"""
_lines = "len(string_split(text, chr(10)))"
O["fence_scan"] = f"""SELECT doc_id, 1 AS block, 1 AS first_line, {_lines} + 3 AS last_line,
      true AS closed FROM documents
    UNION ALL SELECT doc_id, 2, {_lines} + 7, 2 * {_lines} + 8, lang <> 'de' FROM documents"""

# Streams

O["stream_embedding_sync"] = O["embedding_sync"]
