"""DuckDB SQL for the queries of this subpackage."""

SQL: dict[str, str] = {}

SQL["op7_url_filter"] = r"""
WITH u AS (
  SELECT page_id, coalesce(translate(regexp_extract(rest, '^[^/?#]*'), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '') AS host,
    coalesce(regexp_extract(rest, '^[^/?#]*([^?#]*)', 1), '') AS path, row_number() OVER () AS rid
  FROM (SELECT page_id, CASE WHEN instr(url, '://') > 0 THEN substr(url, instr(url, '://') + 3) ELSE '' END AS rest FROM pages)
), r(h, p, v) AS (VALUES ('com', '/', 'allow'), ('example.com', '/en/', 'block'), ('www.example.com', '/en/', 'allow'), ('net', '/es/', 'block'), ('net', '/fr/', 'block')),
m AS (
  SELECT u.*, h || p AS rule, v, row_number() OVER (PARTITION BY rid ORDER BY length(h || p) DESC NULLS LAST, length(h) DESC) AS n
  FROM u LEFT JOIN r ON (host = h OR ends_with(host, '.' || h)) AND starts_with(path, p)
)
SELECT page_id, host, path, rule, coalesce(v, 'allow') AS verdict FROM m WHERE n = 1
"""

SQL["op3_chat_windows"] = r"""
WITH t0 AS (
  SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL SELECT -7, 0, 'user', '\### Assistant: </turn> ok' UNION ALL SELECT -7, 1, 'assistant', '\### Assistant: </turn> ok'
), t1 AS (
  SELECT *, CAST(ceil(strlen(text) / 4.0) AS BIGINT) + 4 AS size, row_number() OVER w AS pos,
    15 + length(text) + length(role) + length(regexp_replace(text, '[^\\<#]', '', 'g')) + length(regexp_replace(role, '[^\\<#:]', '', 'g')) AS chars
  FROM t0 WINDOW w AS (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, text)
), t2 AS (
  SELECT *, pos = 1 AND role = 'system' AS sys, max(CASE WHEN pos = 1 AND role = 'system' THEN size END) OVER c AS sys_size0,
    max(CASE WHEN pos = 1 AND role = 'system' THEN chars END) OVER c AS sys_chars
  FROM t1 WINDOW c AS (PARTITION BY conv_id)
), t3 AS (
  SELECT *, greatest(1024 - coalesce(sys_size0, 0), 2) AS rest, CAST(floor(greatest(1024 - coalesce(sys_size0, 0), 2) * 0.25) AS BIGINT) AS kept,
    sum(CASE WHEN sys THEN 0 ELSE size END) OVER (PARTITION BY conv_id ORDER BY pos) AS ends
  FROM t2
), t4 AS (
  SELECT *, greatest(rest - kept, 1) AS stride, ends - CASE WHEN sys THEN 0 ELSE size END AS starts FROM t3
), t5 AS (SELECT *, starts // stride AS cut FROM t4),
t6 AS (
  SELECT *, 2 * cut + CASE WHEN floor((ends - 1) / stride) > cut AND ends - min(starts) OVER (PARTITION BY conv_id, cut) > stride THEN 1 ELSE 0 END AS span0 FROM t5
), t7 AS (
  SELECT *, CASE WHEN sys THEN coalesce(min(CASE WHEN NOT sys THEN span0 END) OVER (PARTITION BY conv_id), 0) ELSE span0 END AS span FROM t6
), t8 AS (
  SELECT *, coalesce(lag(span) OVER w <> span, true) AS begins, coalesce(NOT lag(sys) OVER w AND lag(size) OVER w <= kept, false) AS fit1,
    coalesce(NOT lag(sys, 2) OVER w AND lag(size) OVER w + lag(size, 2) OVER w <= kept, false) AS fit2, lag(chars) OVER w AS chars1, lag(chars, 2) OVER w AS chars2
  FROM t7 WINDOW w AS (PARTITION BY conv_id ORDER BY pos)
)
SELECT conv_id, count(*) AS n_turns, sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY pos)) AS turns_sha256,
  CAST(sum(CASE WHEN role = 'assistant' THEN length(text) ELSE 0 END) AS BIGINT) AS loss_chars,
  sha256(coalesce(string_agg(CASE WHEN role = 'assistant' THEN text END, '' ORDER BY pos), '')) AS loss_sha256,
  CAST(sum(chars + CASE WHEN begins THEN CASE WHEN NOT sys THEN coalesce(sys_chars, 0) ELSE 0 END + CASE WHEN fit1 THEN chars1 ELSE 0 END + CASE WHEN fit2 THEN chars2 ELSE 0 END ELSE 0 END) AS BIGINT) AS formatted_chars
FROM t8 GROUP BY conv_id
"""

SQL["op2_revisits"] = r"""
WITH p AS (
  SELECT page_id, md5(html) AS body, regexp_replace(url, '#.*$', '') AS x FROM pages
), q AS (
  SELECT page_id, body, lower(regexp_extract(x, '^([A-Za-z][A-Za-z0-9+.-]*)://', 1)) AS scheme, regexp_extract(x, '^[A-Za-z][A-Za-z0-9+.-]*://(.*)$', 1) AS rest, x FROM p
), h AS (
  SELECT *, CASE WHEN contains(auth, '@') THEN regexp_extract(auth, '^.*@') ELSE '' END || CASE WHEN starts_with(lower(bare), 'www.') THEN substr(lower(bare), 5) ELSE lower(bare) END AS host
  FROM (SELECT *, regexp_extract(auth, '[^@]*$') AS bare FROM (SELECT *, regexp_extract(rest, '^[^/?]*') AS auth FROM q))
), u AS (
  SELECT page_id, body, CASE WHEN scheme = '' THEN trim(x) ELSE scheme || '://' || CASE WHEN scheme = 'http' AND ends_with(host, ':80') THEN left(host, length(host) - 3) WHEN scheme = 'https' AND ends_with(host, ':443') THEN left(host, length(host) - 4) ELSE host END
    || CASE WHEN regexp_extract(rest, '^[^/?]*([^?]*)', 1) = '' THEN '/' ELSE regexp_extract(rest, '^[^/?]*([^?]*)', 1) END
    || coalesce('?' || nullif(array_to_string(list_filter(string_split(regexp_extract(rest, '\?(.*)$', 1), '&'), lambda z: z <> '' AND NOT starts_with(z, 'utm_')), '&'), ''), '') END AS canonical
  FROM h
), c AS (
  SELECT page_id * 4 + k AS record_id, canonical, 1600000000 + page_id % 1000 * 60 + k * 40000 AS at_s,
    CASE WHEN k = 0 OR (page_id + k) % 5 = 0 THEN 'response' ELSE 'revisit' END AS kind,
    CASE WHEN (page_id + k) % 7 <> 0 THEN '"' || substr(body, 1, 8) || CASE WHEN page_id % 11 = 0 AND k = 3 THEN 'x' ELSE '' END || '"' END AS etag,
    CASE WHEN page_id % 3 <> 0 THEN 'day ' || page_id % 28 END AS last_modified, CASE WHEN page_id % 2 = 0 THEN body END AS digest, k
  FROM u, (SELECT unnest([0, 1, 2, 3]) AS k)
), b AS (
  SELECT v.*, r.record_id AS r_id, r.etag AS r_etag, r.last_modified AS r_mod, r.digest AS r_digest, r.k AS r_k,
    row_number() OVER (PARTITION BY v.record_id ORDER BY r.at_s DESC NULLS LAST, r.record_id DESC) AS n
  FROM c v LEFT JOIN c r ON v.canonical = r.canonical AND r.kind = 'response' AND r.at_s < v.at_s WHERE v.kind = 'revisit'
), s AS (
  SELECT *, CASE WHEN r_id IS NULL THEN 'unresolved'
    WHEN etag IS NOT NULL AND r_etag IS NOT NULL THEN CASE WHEN etag = r_etag THEN 'resolved' ELSE 'mismatch' END
    WHEN last_modified IS NOT NULL AND r_mod IS NOT NULL THEN CASE WHEN last_modified = r_mod THEN 'resolved' ELSE 'mismatch' END
    WHEN digest IS NOT NULL AND r_digest IS NOT NULL THEN CASE WHEN digest = r_digest THEN 'resolved' ELSE 'mismatch' END
    ELSE 'unverified' END AS status FROM b WHERE n = 1
)
SELECT record_id, canonical, at_s, status, CASE WHEN status IN ('resolved', 'unverified') THEN r_id END AS response_id,
  CASE WHEN status IN ('resolved', 'unverified') THEN 't' || k END AS date, CASE WHEN status IN ('resolved', 'unverified') THEN 'html' || r_k END AS content_type,
  CASE WHEN status IN ('resolved', 'unverified') THEN coalesce(r_digest, digest) END AS digest
FROM s
"""

SQL["op11_repeats"] = r"""
WITH d AS (
  SELECT row_number() OVER () AS r, doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w FROM documents
), win AS (
  SELECT r, i, array_to_string(w[i:i + 34], ' ') AS t FROM (SELECT r, w, unnest(range(1, len(w) - 33)) AS i FROM d WHERE len(w) >= 35)
), hit AS (
  SELECT DISTINCT r, unnest(range(i, i + 35)) AS p FROM win JOIN (SELECT t FROM win GROUP BY t HAVING count(*) > 1) USING (t)
), kept AS (
  SELECT r, string_agg(x, ' ' ORDER BY p) AS kept, count(*) AS n
  FROM (SELECT r, unnest(w) AS x, unnest(range(1, len(w) + 1)) AS p FROM d) ANTI JOIN hit USING (r, p) GROUP BY r
)
SELECT doc_id, len(w) AS n_words, len(w) - coalesce(n, 0) AS n_removed, sha256(coalesce(kept, '')) AS kept_sha256 FROM d LEFT JOIN kept USING (r)
"""


def _lloyd(rounds: int = 10) -> str:
    """Rounds of Lloyd's algorithm, each two named tables: t (each vector's cluster) and c (the centroids)."""
    nearest = """t{0} AS MATERIALIZED (
  SELECT r, arg_min(k, (d, k)) AS k, min(d) AS d FROM (SELECT r, k, sum((v.x - c.x) * (v.x - c.x)) AS d FROM v JOIN c{0} c USING (i) GROUP BY r, k) GROUP BY r
)"""
    moved = """c{1} AS MATERIALIZED (
  SELECT k, i, coalesce(m, c.x) AS x FROM c{0} c LEFT JOIN (SELECT k, i, CAST((sum(x) - ((sum(x) % count(*)) + count(*)) % count(*)) // count(*) AS BIGINT) AS m FROM v JOIN t{0} USING (r) GROUP BY k, i) USING (k, i)
)"""
    return ",\n".join(x for n in range(rounds) for x in (nearest.format(n), moved.format(n, n + 1))) + ",\n" + nearest.format(rounds)


SQL["op12_centroids"] = f"""
WITH e AS MATERIALIZED (
  SELECT row_number() OVER (ORDER BY vec_id) AS r, vec_id, sha256('3:' || CAST(vec_id AS VARCHAR)) AS h, embedding FROM embeddings
  WHERE len(embedding) = 64 AND len(list_filter(embedding, lambda x: x IS NOT NULL AND isfinite(x))) = 64
), v AS MATERIALIZED (
  SELECT r, i, CAST(floor(1024 * CAST(embedding[i] AS DOUBLE)) AS BIGINT) AS x FROM (SELECT r, embedding, unnest(range(1, 65)) AS i FROM e)
), c0 AS MATERIALIZED (
  SELECT k, i, x FROM (SELECT r, row_number() OVER (ORDER BY h) - 1 AS k FROM e ORDER BY h LIMIT 8) JOIN v USING (r)
),
{_lloyd()}
SELECT vec_id, CAST(t.k AS INTEGER) AS cluster, CAST(d AS BIGINT) AS distance, CAST(sum(d) OVER (PARTITION BY t.k) AS BIGINT) AS cluster_inertia, CAST(sum(d) OVER () AS BIGINT) AS inertia, s AS centroid_sha256
FROM t10 t JOIN e USING (r) JOIN (SELECT k, sha256(string_agg(CAST(x AS VARCHAR), ',' ORDER BY i)) AS s FROM c10 GROUP BY k) n ON n.k = t.k
"""
