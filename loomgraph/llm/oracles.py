"""DuckDB SQL for the operators whose results SQL can state on whole tables."""

from __future__ import annotations

_BASE32 = "array_to_string(list_transform(range(0, 32), lambda i: substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567', ((('0x' || substr(s, (1 + 5 * (i // 4))::INT, 5))::INT >> (15 - 5 * (i % 4))::INT) & 31) + 1, 1)), '')"

OP3 = f"""
WITH p AS (SELECT page_id, encode(coalesce(html, '')) AS h, sha1(coalesce(html, '')) AS s FROM pages),
r AS (SELECT *, min(page_id) OVER (PARTITION BY h) AS first_id FROM p)
SELECT page_id, octet_length(h)::BIGINT AS payload_bytes, {_BASE32} AS payload_digest,
  CASE WHEN page_id = first_id THEN 'response' ELSE 'revisit' END AS record_type, CASE WHEN page_id <> first_id THEN first_id END AS refers_to FROM r"""

_REACH = """
r(a, b) AS (SELECT id, id FROM d UNION SELECT r.a, l.b FROM r JOIN l ON r.b = l.a),
c AS (SELECT a, min(b) AS least FROM r GROUP BY 1),
n AS (SELECT a, count(*) AS n FROM l GROUP BY 1)"""

OP5 = f"""
WITH RECURSIVE w AS (SELECT doc_id AS id, list_filter(regexp_split_to_array(coalesce(text, ''), '[\\x20\\x09-\\x0D]+'), lambda x: x <> '') AS w FROM documents),
d AS (SELECT id, list_distinct(CASE WHEN len(w) >= 5 THEN list_transform(range(1, len(w) - 3), lambda i: array_to_string(w[i:i + 4], ' ')) WHEN len(w) > 0 THEN [array_to_string(w, ' ')] ELSE [] END) AS g FROM w),
s AS (SELECT id, len(g) AS size, hash(unnest(g)) AS h FROM d),
m AS (SELECT x.id AS a, y.id AS b, any_value(x.size) AS p, any_value(y.size) AS q, count(*) AS i FROM s x JOIN s y ON x.h = y.h AND x.id <> y.id GROUP BY 1, 2),
l AS (SELECT a, b FROM m WHERE i >= 0.8 * (p + q - i)), {_REACH}
SELECT id AS doc_id, least AS class_id, coalesce(n, 0) AS n_links, id = least AS kept FROM d JOIN c ON c.a = id LEFT JOIN n ON n.a = id"""

OP6 = f"""
WITH RECURSIVE d AS (SELECT vec_id AS id, embedding::DOUBLE[] AS e FROM embeddings),
l AS (SELECT x.id AS a, y.id AS b FROM d x JOIN d y ON x.id <> y.id AND list_cosine_similarity(x.e, y.e) >= 0.95), {_REACH}
SELECT id AS vec_id, coalesce(n, 0) AS n_links, least AS component_id, id = least AS kept FROM d JOIN c ON c.a = id LEFT JOIN n ON n.a = id"""

OP11 = """
WITH d AS (SELECT doc_id, coalesce(text, '') AS t, length(coalesce(text, ''))::BIGINT AS n, sha256('1:' || doc_id) AS s FROM documents),
h AS (SELECT doc_id, t, n, list_transform([1, 9, 17, 25], lambda i: ('0x' || substr(s, i::INT, 8))::BIGINT) AS h FROM d),
c AS (SELECT *, least(h[1] % (n + 1), h[2] % (n + 1)) AS a, greatest(h[1] % (n + 1), h[2] % (n + 1)) AS b,
  CASE WHEN t = '' OR contains(t, '<P>') OR contains(t, '<S>') OR contains(t, '<M>') OR h[3] % 100 >= 90 THEN 'plain' WHEN h[4] % 100 < 20 THEN 'spm' ELSE 'psm' END AS form FROM h),
p AS (SELECT *, substr(t, 1, a) AS prefix, substr(t, a + 1, b - a) AS middle, substr(t, b + 1, n - b) AS suffix FROM c)
SELECT doc_id, n, form, CASE WHEN form <> 'plain' THEN a END AS prefix_chars, CASE WHEN form <> 'plain' THEN b - a END AS middle_chars,
  sha256(CASE form WHEN 'plain' THEN t WHEN 'psm' THEN '<P>' || prefix || '<S>' || suffix || '<M>' || middle ELSE '<S>' || suffix || '<P>' || prefix || '<M>' || middle END) AS output_sha256,
  sha256(t) AS restored_sha256 FROM p"""


def _codes_sql(parts: int = 8, entries: int = 16, rounds: int = 6) -> str:
    """Rounds of assignment and of means in integers, a pair of tables a round."""
    steps = [
        "v AS MATERIALIZED (SELECT vec_id, label, list_transform(embedding, lambda x: floor(4096 * x::DOUBLE)::BIGINT) AS x FROM embeddings"
        " WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0)",
        f"s AS MATERIALIZED (SELECT vec_id, label, part, list_slice(x, part * len(x) // {parts} + 1, (part + 1) * len(x) // {parts}) AS p FROM v, range({parts}) r(part))",
        f"f AS (SELECT vec_id, row_number() OVER (ORDER BY vec_id) - 1 AS e FROM v ORDER BY vec_id LIMIT {entries})",
        "c0 AS MATERIALIZED (SELECT part, e, p AS c FROM s JOIN f USING (vec_id))",
    ]
    far = "list_sum(list_transform(range(1, len(p) + 1), lambda i: (p[i] - c[i]) * (p[i] - c[i])))"
    for r in range(rounds + 1):
        steps.append(f"a{r} AS MATERIALIZED (SELECT vec_id, label, part, p, min(({far}, e)) AS m FROM s JOIN c{r} USING (part) GROUP BY ALL)")
        if r < rounds:
            steps.append(f"u{r} AS (SELECT part, m[2] AS e, i, sum(p[i]) AS t, count(*) AS n FROM a{r}, LATERAL (SELECT unnest(range(1, len(p) + 1)) AS i) GROUP BY ALL)")
            steps.append(f"n{r} AS (SELECT part, e, list(((t - ((t % n) + n) % n) // n)::BIGINT ORDER BY i) AS c FROM u{r} GROUP BY ALL)")
            steps.append(f"c{r + 1} AS MATERIALIZED (SELECT o.part, o.e, coalesce(n.c, o.c) AS c FROM c{r} o LEFT JOIN n{r} n ON n.part = o.part AND n.e = o.e)")
    steps.append(f"g AS (SELECT vec_id, any_value(label) AS label, string_agg(printf('%02x', m[2]), '' ORDER BY part) AS code, sum(m[1])::BIGINT AS error FROM a{rounds} GROUP BY vec_id)")
    steps.append(f"b AS (SELECT sha256(string_agg(array_to_string(c, ','), ',' ORDER BY part, e)) AS codebooks_sha256 FROM c{rounds})")
    return "WITH " + ",\n".join(steps) + "\nSELECT vec_id, code, error, (sum(error) OVER (PARTITION BY label))::BIGINT AS label_error, codebooks_sha256 FROM g, b"


SQL = {"op3_warc": OP3, "op5_ngram_jaccard_join": OP5, "op6_embedding_near_dedup": OP6, "op11_fill_middle": OP11, "op13_vector_codes": _codes_sql()}
