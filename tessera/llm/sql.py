"""DuckDB statements for the queries that SQL can express."""

WORDS = r"regexp_extract_all(text, '[^\x20\x09-\x0D]+')"
ASCII_LOWER = "translate({}, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
BLANKS = "chr(32) || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)"

OP2 = f"""
WITH lines AS (
  SELECT doc_id, unnest(l) AS line, generate_subscripts(l, 1) AS pos
  FROM (SELECT doc_id, string_split(coalesce(text, ''), chr(10)) AS l FROM documents)
), keyed AS (
  SELECT *, {ASCII_LOWER.format(f"trim(line, {BLANKS})")} AS key FROM lines
), repeated AS (
  SELECT key, min(doc_id) AS first FROM keyed WHERE length(key) >= 10
  GROUP BY key HAVING count(DISTINCT doc_id) > 1
), judged AS (
  SELECT k.*, r.first IS NOT NULL AND k.doc_id > r.first AS gone
  FROM keyed k LEFT JOIN repeated r USING (key)
)
SELECT doc_id, count(*) AS n_lines, count(*) FILTER (gone) AS n_dropped,
  sha256(coalesce(string_agg(line, chr(10) ORDER BY pos) FILTER (NOT gone), '')) AS kept_sha256
FROM judged GROUP BY doc_id
"""

OP6 = f"""
WITH split AS (
  SELECT doc_id, coalesce({WORDS}, []) AS w FROM documents
), places AS (
  SELECT doc_id, unnest(range(1, len(w) + 1)) AS p, w FROM split
), runs AS (
  SELECT doc_id, p, hash(list_slice(w, p, p + 34)) AS h, array_to_string(list_slice(w, p, p + 34), ' ') AS run
  FROM places WHERE p + 34 <= len(w)
), repeated AS (
  SELECT doc_id, p FROM (SELECT doc_id, p, count(*) OVER (PARTITION BY h, run) AS n FROM runs) WHERE n > 1
), gone AS (
  SELECT DISTINCT doc_id, p + d AS p FROM repeated, (SELECT unnest(range(35)) AS d)
), judged AS (
  SELECT l.doc_id, l.p, l.w[l.p] AS word, g.p IS NOT NULL AS gone
  FROM places l LEFT JOIN gone g ON l.doc_id = g.doc_id AND l.p = g.p
), by_doc AS (
  SELECT doc_id, count(*) AS n_words, count(*) FILTER (gone) AS n_removed,
    coalesce(string_agg(word, ' ' ORDER BY p) FILTER (NOT gone), '') AS kept
  FROM judged GROUP BY doc_id
)
SELECT s.doc_id, coalesce(b.n_words, 0) AS n_words, coalesce(b.n_removed, 0) AS n_removed,
  sha256(coalesce(b.kept, '')) AS kept_sha256
FROM split s LEFT JOIN by_doc b ON s.doc_id = b.doc_id
"""

OP9 = f"""
WITH RECURSIVE split AS (
  SELECT doc_id, regexp_extract_all({ASCII_LOWER.format("text")}, '[^\\x20\\x09-\\x0D]+') AS w FROM documents
), shingles AS (
  SELECT DISTINCT doc_id, array_to_string(list_slice(w, p, p + 4), ' ') AS s
  FROM (SELECT doc_id, w, unnest(range(1, greatest(len(w) - 4, 1) + 1)) AS p FROM split WHERE len(w) > 0)
), sizes AS (
  SELECT doc_id, count(*) AS n FROM shingles GROUP BY doc_id
), pairs AS (
  SELECT a.doc_id AS x, b.doc_id AS y, count(*) AS shared
  FROM shingles a JOIN shingles b ON a.s = b.s AND a.doc_id <> b.doc_id GROUP BY ALL
), links AS (
  SELECT x, y FROM pairs p JOIN sizes a ON a.doc_id = x JOIN sizes b ON b.doc_id = y
  WHERE 100 * shared >= 75 * (a.n + b.n - shared)
), reach AS (
  SELECT x AS doc_id, x AS r FROM (SELECT DISTINCT x FROM links)
  UNION
  SELECT reach.doc_id, links.y FROM reach JOIN links ON links.x = reach.r
), least_id AS (
  SELECT doc_id, min(r) AS c FROM reach GROUP BY doc_id
)
SELECT d.doc_id, coalesce(n, 0) AS n_shingles, coalesce(c, d.doc_id) AS component_id,
  coalesce(c, d.doc_id) = d.doc_id AS kept
FROM documents d LEFT JOIN sizes s ON s.doc_id = d.doc_id LEFT JOIN least_id l ON l.doc_id = d.doc_id
"""

OP7 = """
WITH v AS (
  SELECT vec_id, list_transform(embedding, lambda x: floor(64 * x::DOUBLE)::BIGINT) AS x FROM embeddings
  WHERE vec_id IS NOT NULL AND embedding IS NOT NULL
    AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
), scored AS (
  SELECT q.vec_id AS query_id, c.vec_id, list_sum(list_transform(list_zip(q.x, c.x), lambda p: p[1] * p[2]))::BIGINT AS score
  FROM v q JOIN v c ON q.vec_id % 20 = 0 AND c.vec_id <> q.vec_id
), ranked AS (
  SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id)::INTEGER AS rank FROM scored
)
SELECT query_id, rank, vec_id, score FROM ranked WHERE rank <= 20
"""

OP4 = """
WITH p AS (
  SELECT page_id, octet_length(encode(coalesce(html, ''))) AS payload_bytes,
    sha256(coalesce(html, '')) AS payload_digest FROM pages
), o AS (
  SELECT *, min(page_id) OVER (PARTITION BY payload_digest) AS first FROM p
)
SELECT page_id, payload_bytes, payload_digest,
  CASE WHEN payload_bytes >= 100 AND page_id > first THEN 'revisit' ELSE 'response' END AS record_type,
  CASE WHEN payload_bytes >= 100 AND page_id > first THEN first END AS refers_to
FROM o
"""

#: Unsigned CRC-32 of a text of ASCII characters, bit by bit.
CRC32 = """xor(4294967295, list_reduce(
  list_prepend(4294967295::BIGINT, list_transform(string_split({}, ''), lambda ch: ascii(ch)::BIGINT)),
  lambda c, b: list_reduce([xor(c, b), 0, 0, 0, 0, 0, 0, 0, 0], lambda x, ignored:
    xor(x >> 1, (x & 1) * 3988292384))))"""


def _merkle_field(column: str) -> str:
    return f"coalesce(octet_length(encode({column}::VARCHAR))::VARCHAR || ':' || {column}::VARCHAR, '-')"


def _merkle_leaf(text: str) -> str:
    columns = ("doc_id", "source", "lang", "n_chars", text)
    return f"sha256({' || '.join(_merkle_field(c) for c in columns)})"


OP12 = f"""
WITH RECURSIVE hashed AS (
  SELECT doc_id, lang, {_merkle_leaf("text")} AS leaf, {_merkle_leaf("low")} AS changed,
    {CRC32.format("doc_id::VARCHAR")} % 3 = 0 AS tampered
  FROM (SELECT *, {ASCII_LOWER.format("text")} AS low FROM documents)
), leaves AS (
  SELECT doc_id, lang, leaf, CASE WHEN tampered THEN changed ELSE leaf END AS shown,
    row_number() OVER (PARTITION BY lang ORDER BY doc_id NULLS FIRST, leaf) - 1 AS r,
    count(*) OVER (PARTITION BY lang) AS n
  FROM hashed
), up AS (
  SELECT lang, 0 AS l, r AS i, n, leaf AS d FROM leaves
  UNION ALL
  SELECT lang, any_value(l) + 1, i // 8, any_value((n + 7) // 8), sha256(string_agg(d, '' ORDER BY i))
  FROM up WHERE n > 1 GROUP BY lang, i // 8
), subroots AS (
  SELECT lang, d, row_number() OVER (ORDER BY lang NULLS FIRST) - 1 AS i, count(*) OVER () AS n FROM up WHERE n = 1
), top AS (
  SELECT 0 AS l, i, n, d FROM subroots
  UNION ALL
  SELECT any_value(l) + 1, i // 8, any_value((n + 7) // 8), sha256(string_agg(d, '' ORDER BY i))
  FROM top WHERE n > 1 GROUP BY i // 8
), steps AS (
  SELECT f.lang, f.r, u.l,
    string_agg(u.d, '' ORDER BY u.i) FILTER (u.i < f.r >> (3 * u.l)) AS before,
    string_agg(u.d, '' ORDER BY u.i) FILTER (u.i > f.r >> (3 * u.l)) AS after
  FROM leaves f JOIN up u ON f.lang IS NOT DISTINCT FROM u.lang AND u.n > 1 AND u.i // 8 = f.r >> (3 * u.l + 3)
  GROUP BY ALL
  UNION ALL
  SELECT f.lang, f.r, 1000 + t.l,
    string_agg(t.d, '' ORDER BY t.i) FILTER (t.i < s.i >> (3 * t.l)),
    string_agg(t.d, '' ORDER BY t.i) FILTER (t.i > s.i >> (3 * t.l))
  FROM leaves f JOIN subroots s ON f.lang IS NOT DISTINCT FROM s.lang
    JOIN top t ON t.n > 1 AND t.i // 8 = s.i >> (3 * t.l + 3)
  GROUP BY ALL
), counted AS (
  SELECT lang, r, coalesce(before, '') AS before, coalesce(after, '') AS after,
    row_number() OVER (PARTITION BY lang, r ORDER BY l) AS k, count(*) OVER (PARTITION BY lang, r) AS of
  FROM steps
), proofs AS (
  SELECT lang, r, any_value(of) AS of, string_agg(before || after, '' ORDER BY k) AS proof FROM counted GROUP BY lang, r
), folds AS (
  SELECT lang, r, 0 AS k, shown AS d FROM leaves
  UNION ALL
  SELECT f.lang, f.r, f.k + 1, sha256(c.before || f.d || c.after)
  FROM folds f JOIN counted c ON f.lang IS NOT DISTINCT FROM c.lang AND f.r = c.r AND c.k = f.k + 1
)
SELECT e.doc_id, e.leaf, s.d AS subroot, t.d AS root, sha256(coalesce(p.proof, '')) AS proof_sha256,
  f.d AS folded_root, f.d = t.d AS verified
FROM leaves e
JOIN subroots s ON e.lang IS NOT DISTINCT FROM s.lang
JOIN (SELECT d FROM top WHERE n = 1) t ON true
LEFT JOIN proofs p ON e.lang IS NOT DISTINCT FROM p.lang AND e.r = p.r
JOIN folds f ON e.lang IS NOT DISTINCT FROM f.lang AND e.r = f.r AND f.k = coalesce(p.of, 0)
"""

OP13_RULES = (("block", "net/"), ("allow", "example.net/en/"), ("block", "example.com/de/"), ("allow", "org/fr/"))


def _rule_fits(rule: str) -> str:
    host, _, path = rule.partition("/")
    return f"(host = '{host}' OR ends_with(host, '.{host}')) AND starts_with(path, '/{path}')"


def _smoothed(kind: str, below: str) -> str:
    return f"""CASE WHEN coalesce(x.n_{kind}, 0) > 0
      THEN (coalesce(s.{kind}, 0) + x.kinds_{kind} * {below}) / (x.n_{kind} + x.kinds_{kind}) ELSE {below} END AS p_{kind}"""


def _url_models(order: int) -> str:
    """Statements seen, contexts and p for contexts of 0 to ``order`` characters."""
    out = []
    for k in range(order + 1):
        below = ("1.0::DOUBLE / 1114112",) * 2 if k == 0 else ("b.p_allowed", "b.p_blocked")
        join = f"JOIN p{k - 1} b ON b.model = w.model AND b.piece = right(w.piece, {k})" if k else ""
        out.append(f"""seen{k} AS MATERIALIZED (
  SELECT model, right(piece, {k + 1}) AS piece, sum(allowed)::BIGINT AS allowed, sum(blocked)::BIGINT AS blocked
  FROM counts GROUP BY ALL
), contexts{k} AS MATERIALIZED (
  SELECT model, left(piece, {k}) AS context, sum(allowed)::BIGINT AS n_allowed, count(*) FILTER (allowed > 0) AS kinds_allowed,
    sum(blocked)::BIGINT AS n_blocked, count(*) FILTER (blocked > 0) AS kinds_blocked
  FROM seen{k} GROUP BY ALL
), p{k} AS MATERIALIZED (
  SELECT w.model, w.piece, {_smoothed("allowed", below[0])}, {_smoothed("blocked", below[1])}
  FROM (SELECT DISTINCT model, right(piece, {k + 1}) AS piece FROM pieces) w
  LEFT JOIN seen{k} s ON s.model = w.model AND s.piece = w.piece
  LEFT JOIN contexts{k} x ON x.model = w.model AND x.context = left(w.piece, {k})
  {join}
)""")
    return ", ".join(out)


OP13 = f"""
WITH parts AS (
  SELECT row_number() OVER () AS r, page_id, url,
    CASE WHEN instr(url, '://') > 0 THEN substr(url, instr(url, '://') + 3) END AS rest FROM pages
), split AS (
  SELECT r, page_id, url, coalesce(rest, url, '') AS text,
    {ASCII_LOWER.format("coalesce(regexp_extract(rest, '^[^/?#]*'), '')")} AS host,
    coalesce(regexp_extract(rest, '^[^/?#]*([^?#]*)', 1), '') AS path FROM parts
), ruled AS (
  SELECT *, CASE {" ".join(f"WHEN {_rule_fits(r)} THEN '{r}'" for _, r in sorted(OP13_RULES, key=lambda x: -len(x[1])))} END AS rule FROM split
), urls AS MATERIALIZED (
  SELECT *, CASE {" ".join(f"WHEN rule = '{r}' THEN '{v}'" for v, r in OP13_RULES)} END AS decided,
    CASE WHEN rule IS NULL THEN 2 WHEN left(md5(url), 1) < '8' THEN 0 ELSE 1 END AS model FROM ruled
), pieces AS MATERIALIZED (
  SELECT r, model, decided, substr(repeat(chr(2), 4) || text || chr(3), i, 5) AS piece
  FROM (SELECT *, unnest(range(1, length(text) + 2)) AS i FROM urls)
), counts AS MATERIALIZED (
  SELECT m.model, piece, count(*) FILTER (decided = 'allow') AS allowed, count(*) FILTER (decided = 'block') AS blocked
  FROM pieces p JOIN (VALUES (0), (1), (2)) m(model) ON m.model <> p.model WHERE decided IS NOT NULL GROUP BY ALL
), {_url_models(4)}, scored AS (
  SELECT r, greatest(-8192, least(8191, floor(sum(round((log2(p_allowed) - log2(p_blocked)) * 1048576)::BIGINT)::DOUBLE
    / (count(*) * 4096))))::BIGINT AS step
  FROM pieces JOIN p4 USING (model, piece) GROUP BY r
), judged AS MATERIALIZED (
  SELECT u.*, s.step FROM urls u JOIN scored s USING (r)
), steps AS (
  SELECT step, count(*) FILTER (decided = 'allow') AS a, count(*) FILTER (decided = 'block') AS b
  FROM judged WHERE decided IS NOT NULL GROUP BY step
), sums AS (
  SELECT greatest(lag(step) OVER (ORDER BY step) + 1, least(step, 0)) AS step, sum(a) OVER (ORDER BY step ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS above,
    coalesce(sum(b) OVER (ORDER BY step ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS below,
    sum(a) OVER () AS a, sum(b) OVER () AS b FROM steps
), best AS (
  SELECT step FROM sums WHERE a > 0 AND b > 0 ORDER BY above * b + below * a DESC, abs(step), step LIMIT 1
)
SELECT page_id, host, path, rule, coalesce(decided,
  CASE WHEN step >= coalesce((SELECT step FROM best), 0) THEN 'allow' ELSE 'block' END) AS verdict, step
FROM judged
"""


def _code_rounds(rounds: int) -> str:
    """Statements near (assignment) and book (codebooks after it), round by round."""
    out = []
    for k in range(rounds + 1):
        out.append(f"""near{k} AS MATERIALIZED (
  SELECT r, a.p, min(256 * list_sum(list_transform(list_zip(a.v, b.v), lambda z: (z[1] - z[2]) * (z[1] - z[2])))::BIGINT + e) AS m
  FROM parts a JOIN book{k} b ON a.p = b.p GROUP BY r, a.p
)""")
        if k < rounds:
            out.append(f"""book{k + 1} AS MATERIALIZED (
  SELECT b.p, b.e, coalesce(n.v, b.v) AS v FROM book{k} b LEFT JOIN (
    SELECT p, e, list(((s - ((s % n) + n) % n) // n)::BIGINT ORDER BY i) AS v FROM (
      SELECT a.p, m % 256 AS e, i, sum(a.v[i])::BIGINT AS s, count(*) AS n
      FROM near{k} JOIN (SELECT *, unnest(range(1, len(v) + 1)) AS i FROM parts) a USING (r, p) GROUP BY ALL
    ) GROUP BY p, e
  ) n ON n.p = b.p AND n.e = b.e
)""")
    return ", ".join(out)


OP11 = f"""
WITH kept AS MATERIALIZED (
  SELECT row_number() OVER () AS r, vec_id, label, list_transform(embedding, lambda x: floor(1024 * x::DOUBLE)::BIGINT) AS x
  FROM embeddings
  WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
), parts AS MATERIALIZED (
  SELECT r, vec_id, p, list_slice(x, p * (len(x) // 4) + 1, (p + 1) * (len(x) // 4)) AS v
  FROM kept, (SELECT unnest(range(4)) AS p)
), book0 AS MATERIALIZED (
  SELECT p, e, v FROM (SELECT p, v, row_number() OVER (PARTITION BY p ORDER BY vec_id) - 1 AS e FROM parts) WHERE e < 256
), {_code_rounds(4)}, coded AS (
  SELECT r, string_agg(lower(format('{{:02x}}', m % 256)), '' ORDER BY p) AS code, sum(m // 256)::BIGINT AS error FROM near4 GROUP BY r
), digest AS (
  SELECT sha256(string_agg(array_to_string(v, ','), ',' ORDER BY p, e)) AS codebooks_sha256 FROM book4
)
SELECT vec_id, code, error, sum(error) OVER (PARTITION BY label)::BIGINT AS label_error, codebooks_sha256
FROM kept JOIN coded USING (r), digest
"""

ORACLES = {
    "op4_warc_transactions": OP4,
    "op7_topk_search": OP7,
    "op6_substring_dedup": OP6,
    "op9_minhash_near_dedup": OP9,
    "op2_line_dedup": OP2,
    "op11_vector_codes": OP11,
    "op12_merkle_manifest": OP12,
    "op13_url_filters": OP13,
}
