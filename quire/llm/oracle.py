"""DuckDB SQL for the queries that SQL expresses on whole tables. The trained
classifiers, XXH64 fingerprints and the tokenizer have none; their queries are
tested against brute force, held-out labels and the library."""

from __future__ import annotations

SQL: dict[str, str] = {}

SQL["op2_exact_dedup"] = r"""
WITH d AS (SELECT doc_id, length(coalesce(text, '')) len, regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]', '', 'g') norm
           FROM documents),
     k AS (SELECT norm, count(*) n, max(len) keep_len FROM d GROUP BY norm),
     i AS (SELECT d.norm, min(doc_id) keep_id FROM d JOIN k ON d.norm = k.norm AND d.len = k.keep_len GROUP BY d.norm)
SELECT doc_id, keep_id, n::BIGINT group_size, doc_id IS NOT DISTINCT FROM keep_id AND len = keep_len kept, sha256(d.norm) text_sha256
FROM d JOIN k ON d.norm = k.norm JOIN i ON d.norm = i.norm
"""

SQL["op3_exact_topk"] = r"""
WITH v AS (SELECT vec_id, list_transform(embedding, lambda x: floor(64 * x::DOUBLE)) e FROM embeddings
           WHERE vec_id IS NOT NULL AND embedding IS NOT NULL
             AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
     s AS (SELECT q.vec_id query_id, v.vec_id, list_dot_product(q.e, v.e)::BIGINT score
           FROM v q JOIN v ON q.vec_id <> v.vec_id WHERE q.vec_id % 20 = 0),
     r AS (SELECT query_id, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id)::INTEGER rank, vec_id, score FROM s)
SELECT * FROM r WHERE rank <= 20
"""

SQL["op5_url_filter"] = r"""
WITH u AS (SELECT page_id, translate(regexp_extract(coalesce(url, ''), '(?s)^.*?://([^/?#]*)', 1),
                                     'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') host,
                  regexp_extract(coalesce(url, ''), '(?s)^.*?://[^/?#]*([^?#]*)', 1) path FROM pages),
     h AS (SELECT *, '.' || host h, host || path hp FROM u),
     s AS (SELECT *, CASE WHEN h LIKE '%.example.org' AND path LIKE '/en/1%' THEN 'example.org/en/1'
                          WHEN h LIKE '%.example.org' AND path LIKE '/es/%' THEN 'example.org/es/'
                          WHEN h LIKE '%.com' AND path LIKE '/fr/%' THEN 'com/fr/'
                          WHEN h LIKE '%.com' AND path LIKE '/de/%' THEN 'com/de/'
                          WHEN h LIKE '%.org' AND path LIKE '/%' THEN 'org/' END rule FROM h)
SELECT page_id, host, path, rule,
       CASE WHEN rule IN ('org/', 'com/fr/') THEN 'allow' WHEN rule IS NOT NULL THEN 'block'
            WHEN regexp_matches(hp, '^([^/]*\.)?ads-track\.[^/]+(/.*)?$') OR regexp_matches(hp, '^([^/]*\.)?ads?\d*\.[^/]+/.*\bbanner\b')
              OR regexp_matches(hp, '^[^/]*/(.*/)?wp-login\.php$') OR regexp_matches(hp, '^[^/]*/(.*/)?cgi-bin/')
              OR regexp_matches(hp, '^([^/]*\.)?casino(\.[^/]+)+(/.*)?$') THEN 'block' ELSE 'allow' END verdict
FROM s
"""


def _pii(kind: str, pattern: str, confirmed: str) -> str:
    """Confirmed (kind, start, end) of one kind; m is a match."""
    return f"""
SELECT doc_id, '{kind}' kind, s, s + length(m) e FROM (
  SELECT doc_id, text, m[i] m, (list_sum(list_transform(g[1:i], lambda x: length(x))) + coalesce(list_sum(list_transform(m[1:i-1], lambda x: length(x))), 0))::BIGINT s
  FROM (SELECT doc_id, text, regexp_extract_all(text, '{pattern}') m, string_split_regex(text, '{pattern}') g FROM d),
       unnest(range(1, len(m) + 1)) t(i))
WHERE {confirmed}"""


_DIGITS = "regexp_replace(m, '[^0-9]', '', 'g')"
_LUHN = (f"list_sum(list_transform(range(0, length({_DIGITS})), lambda i: CASE WHEN i % 2 = 0 THEN substr(reverse({_DIGITS}), i + 1, 1)::INT "
         f"ELSE substr(reverse({_DIGITS}), i + 1, 1)::INT * 2 - CASE WHEN substr(reverse({_DIGITS}), i + 1, 1)::INT > 4 THEN 9 ELSE 0 END END)) % 10 = 0")
_BARE = "replace(m, ' ', '')"
_MOD97 = (f"list_reduce(list_prepend(0, list_transform(string_split(substr({_BARE}, 5) || substr({_BARE}, 1, 4), ''), "
          "lambda c: CASE WHEN ascii(c) >= 65 THEN ascii(c) - 55 ELSE ascii(c) - 48 END)), lambda a, x: CASE WHEN x > 9 THEN (a * 100 + x) % 97 ELSE (a * 10 + x) % 97 END) = 1")



def _near(words: str) -> str:
    """Does one of the words stand within 40 characters before or after?"""
    return (f"regexp_matches(lower(substr(text, greatest(s - 40, 0) + 1, s - greatest(s - 40, 0)) || ' ' || substr(text, s + length(m) + 1, 40)), '{words}')")


SQL["op7_pii"] = "WITH d AS (SELECT doc_id, coalesce(text, '') \"text\" FROM documents), spans AS (" + " UNION ALL ".join([
    "SELECT * FROM (" + _pii("email", r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+", "true") + ")",
    "SELECT * FROM (" + _pii("ip", r"[0-9]+\.[0-9]+\.[0-9]+\.[0-9]+", "list_max(list_transform(string_split(m, '.'), lambda x: x::DOUBLE)) <= 255") + ")",
    "SELECT * FROM (" + _pii("card", r"[0-9](?:[\x20-]?[0-9])+", f"length({_DIGITS}) BETWEEN 13 AND 19 AND {_LUHN}") + ")",
    "SELECT * FROM (" + _pii("phone", r"\+[0-9][\x20().0-9-]+[0-9]", f"length({_DIGITS}) BETWEEN 9 AND 15") + ")",
    "SELECT * FROM (" + _pii("iban", r"\b[A-Z]{2}[0-9]{2}(?:\x20?[A-Z0-9]{4}){2,7}(?:\x20?[A-Z0-9]{1,3})?\b",
                             f"length({_BARE}) BETWEEN 15 AND 34 AND {_MOD97}") + ")",
    "SELECT * FROM (" + _pii("secret", "[A-Za-z0-9_-]{20,}", "regexp_matches(m, '[0-9]') AND regexp_matches(m, '[A-Za-z]') AND " + _near(
        "token|secret|passw|credential|bearer|api[ _-]?key|access[ _-]?key|private[ _-]?key")) + ")",
    "SELECT * FROM (" + _pii("account", "[0-9]+", "length(m) BETWEEN 8 AND 17 AND " + _near(
        "account|konto|compte|cuenta|passport|tax id|social security")) + ")"]) + r"""),
o AS (SELECT *, list_position(['email', 'ip', 'card', 'phone', 'iban', 'secret', 'account'], kind) k, concat_ws(':', kind, s, e) x FROM spans),
a AS (SELECT doc_id, count(*) FILTER (kind = 'email') n_email, count(*) FILTER (kind = 'ip') n_ip, count(*) FILTER (kind = 'card') n_card,
             count(*) FILTER (kind = 'phone') n_phone, string_agg(x, ',' ORDER BY k, s) FILTER (k < 5) base, string_agg(x, ',' ORDER BY k, s) spans
      FROM o GROUP BY doc_id)
SELECT d.doc_id, coalesce(n_email, 0) n_email, coalesce(n_ip, 0) n_ip, coalesce(n_card, 0) n_card, coalesce(n_phone, 0) n_phone,
       sha256(coalesce(base, '')) base_sha256, coalesce(spans, '') spans
FROM d LEFT JOIN a ON d.doc_id = a.doc_id
"""

SQL["op8_chat"] = r"""
WITH t AS (SELECT conv_id, turn, coalesce(role, '') "role", coalesce(text, '') "text" FROM conversations
           UNION ALL VALUES (-1, 0, 'user', '</s>[INST] ok [/INST]'), (-1, 1, 'assistant', '</s>[INST] ok [/INST]')),
     m AS (SELECT *, length("role" || "text") + length(regexp_replace("role" || "text", '[^\\<\[]', '', 'g'))
                     + length('<|start|><|text|><|end|>') chars FROM t)
SELECT conv_id, count(*) n_turns, sha256(string_agg("role" || chr(10) || "text" || chr(10), '' ORDER BY turn, "role", "text")) turns_sha256,
       coalesce(sum(length("text")) FILTER ("role" = 'assistant'), 0)::BIGINT loss_chars,
       sha256(coalesce(string_agg("text", '' ORDER BY turn, "role", "text") FILTER ("role" = 'assistant'), '')) loss_sha256,
       sum(chars)::BIGINT formatted_chars
FROM m GROUP BY conv_id
"""

SQL["op10_mixing"] = r"""
WITH d AS (SELECT doc_id, source, len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')) size,
                  md5('0:' || coalesce(doc_id::VARCHAR, '') || ':' || coalesce(text, '')) key FROM documents),
     s AS (SELECT source, sum(size)::BIGINT source_size FROM d GROUP BY source),
     w AS (SELECT *, [5, 2, 1][((row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 + 1)::INT]::BIGINT w FROM s),
     a AS (SELECT *, (source_size * 3) / w::DOUBLE held_at FROM w),
     l AS (SELECT *, (sum(source_size) OVER () - coalesce(sum(source_size) OVER (ORDER BY held_at, source NULLS LAST
                       ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) * 3)::BIGINT
                     / (sum(w) OVER (ORDER BY held_at, source NULLS LAST ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING))::DOUBLE lev FROM a),
     f AS (SELECT arg_min(lev, held_at) lev FROM l WHERE lev <= held_at),
     t AS (SELECT source, source_size, least((source_size * 3)::DOUBLE, f.lev * w) target FROM l, f),
     e AS (SELECT *, CASE WHEN source_size > 0 THEN floor(target / source_size)::BIGINT ELSE 0 END epochs FROM t),
     p AS (SELECT source, key, sum(size) size, sum(sum(size)) OVER (PARTITION BY source ORDER BY key) - sum(size) begin FROM d GROUP BY source, key),
     c AS (SELECT p.source, max(key) last FROM p JOIN e ON p.source IS NOT DISTINCT FROM e.source
           WHERE begin + size / 2.0::DOUBLE < target - epochs * source_size GROUP BY p.source)
SELECT doc_id, size::BIGINT size, source_size, target, (size * (epochs + CASE WHEN key <= last THEN 1 ELSE 0 END))::BIGINT taken
FROM d JOIN e ON d.source IS NOT DISTINCT FROM e.source LEFT JOIN c ON d.source IS NOT DISTINCT FROM c.source
"""

SQL["op11_quality_rules"] = r"""
WITH d AS (SELECT row_number() OVER () AS r, doc_id, coalesce(text, '') AS t,
                  regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w FROM documents),
     lines AS (SELECT r, unnest(string_split(t, chr(10))) AS line FROM d),
     dup AS (SELECT r, sum(n)::BIGINT AS n_lines, sum(n - 1)::BIGINT AS n_dup_lines
             FROM (SELECT r, line, count(*) AS n FROM lines WHERE regexp_matches(line, '[^\x20\x09-\x0D]') GROUP BY r, line) GROUP BY r),
     windows AS (SELECT r, p, array_to_string(w[p:p + 7], ' ') AS k FROM d, unnest(range(1, len(w) - 6)) u(p)),
     again AS (SELECT r, p FROM (SELECT r, p, count(*) OVER (PARTITION BY r, k) AS n FROM windows) WHERE n > 1),
     covered AS (SELECT r, sum(least(8, coalesce(next - p, 8)))::BIGINT AS n_repeat_words
                 FROM (SELECT r, p, lead(p) OVER (PARTITION BY r ORDER BY p) AS next FROM again) GROUP BY r),
     c AS (SELECT doc_id, w, len(w)::BIGINT AS n_words, length(array_to_string(w, ''))::BIGINT AS word_chars,
                  length(regexp_replace(t, '[^#*$%&|<>]', '', 'g'))::BIGINT AS n_symbols, coalesce(n_lines, 0) AS n_lines,
                  coalesce(n_dup_lines, 0) AS n_dup_lines, coalesce(n_repeat_words, 0) AS n_repeat_words
           FROM d LEFT JOIN dup USING (r) LEFT JOIN covered USING (r)),
     b AS (SELECT *, n_words < 20 OR 100 * n_repeat_words > 30 * n_words AS base_failed,
                  len(list_filter(w, lambda x: upper(x) = x AND lower(x) <> x)) AS shouted,
                  len(list_filter(w, lambda x: NOT regexp_matches(x, '\p{L}'))) AS letterless,
                  len(list_filter(range(1, len(w)), lambda i: w[i] = w[i + 1])) AS stuttered FROM c)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed,
       NOT (base_failed OR 10 * n_symbols > n_words OR word_chars < 2 * n_words OR word_chars > 20 * n_words OR 2 * n_dup_lines > n_lines
            OR 100 * shouted > 30 * n_words OR 100 * letterless > 30 * n_words OR 100 * stuttered > 30 * n_words) AS kept
FROM b
"""


def _centroids(rounds: int = 3, k: int = 16) -> str:
    """Each round: squared distances of all vectors to the k centroids, the
    nearest, and the floors of the means; empty clusters keep their centroid."""
    def assigned(r):
        return f"""
     a{r} AS (SELECT n, vec_id, e, cluster, distance FROM (
       SELECT n, vec_id, v.e, c.cluster, list_sum(list_transform(list_zip(v.e, c.e), lambda p: (p[1] - p[2]) * (p[1] - p[2])))::BIGINT AS distance,
              row_number() OVER (PARTITION BY n ORDER BY distance, c.cluster) AS place FROM v, c{r} c) WHERE place = 1),"""

    def mean(r):
        return f"""
     s{r} AS (SELECT cluster, i, sum(e[i])::BIGINT AS s, count(*) AS m FROM a{r}, unnest(range(1, 65)) t(i) GROUP BY cluster, i),
     m{r} AS (SELECT cluster, list((s - ((s % m) + m) % m) // m ORDER BY i) AS e FROM s{r} GROUP BY cluster),
     c{r + 1} AS (SELECT c.cluster, coalesce(m.e, c.e) AS e FROM c{r} c LEFT JOIN m{r} m ON c.cluster = m.cluster),"""

    return f"""
WITH v AS (SELECT row_number() OVER () AS n, vec_id, list_transform(embedding, lambda x: floor(64 * x::DOUBLE)::BIGINT) AS e FROM embeddings
           WHERE len(embedding) = 64 AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
     c0 AS (SELECT row_number() OVER (ORDER BY h, e) - 1 AS cluster, e
            FROM (SELECT sha256('1:' || coalesce(vec_id::VARCHAR, '')) AS h, e FROM v ORDER BY h, e LIMIT {k})),
     {"".join(assigned(r) + mean(r) for r in range(rounds))}{assigned(rounds).rstrip(",")}
SELECT vec_id, a.cluster::INTEGER AS cluster, distance, sum(distance) OVER (PARTITION BY a.cluster)::BIGINT AS cluster_inertia,
       sum(distance) OVER ()::BIGINT AS inertia, sha256(array_to_string(c.e, ',')) AS centroid_sha256
FROM a{rounds} a JOIN c{rounds} c ON a.cluster = c.cluster
"""


SQL["op13_centroids"] = _centroids()
