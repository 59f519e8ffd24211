"""The queries of this package as DuckDB SQL, where SQL can say it. Constants are written out."""

from __future__ import annotations

ORACLES: dict[str, str] = {
    "op3_line_dedup": """
WITH lines AS (
  SELECT doc_id, string_split(coalesce(text, ''), chr(10)) AS ls FROM documents
), starts AS (
  SELECT doc_id, ls, unnest(range(len(ls) - 2)) AS i FROM lines WHERE len(ls) >= 3
), wins AS (
  SELECT doc_id, i, ls[i + 1] || chr(10) || ls[i + 2] || chr(10) || ls[i + 3] AS w FROM starts
), firsts AS (
  SELECT w, min(struct_pack(d := doc_id, i := i)) AS f FROM wins
  WHERE regexp_matches(w, '[^\\x20\\x09-\\x0D]') GROUP BY w HAVING count(*) > 1
), later AS (
  SELECT doc_id, i FROM wins JOIN firsts USING (w) WHERE struct_pack(d := doc_id, i := i) <> f
), gone AS (
  SELECT DISTINCT doc_id, unnest([i, i + 1, i + 2]) AS i FROM later
), runs AS (
  SELECT doc_id, i, i - row_number() OVER (PARTITION BY doc_id ORDER BY i) AS run FROM gone
), spans AS (
  SELECT doc_id, min(i) AS a, max(i) AS b, count(*) AS n FROM runs GROUP BY doc_id, run
), removed AS (
  SELECT doc_id, sum(n) AS n, string_agg(a || '-' || b, ',' ORDER BY a) AS removed FROM spans GROUP BY doc_id
), numbered AS (
  SELECT doc_id, unnest(ls) AS line, unnest(range(len(ls))) AS i FROM lines
), kept AS (
  SELECT n.doc_id, string_agg(line, chr(10) ORDER BY n.i) AS text
  FROM numbered n LEFT JOIN gone g ON n.doc_id = g.doc_id AND n.i = g.i WHERE g.i IS NULL GROUP BY n.doc_id
)
SELECT l.doc_id, CAST(len(ls) AS BIGINT) AS n_lines, CAST(coalesce(r.n, 0) AS BIGINT) AS n_removed,
       coalesce(removed, '') AS removed, sha256(coalesce(k.text, '')) AS text_sha256
FROM lines l LEFT JOIN removed r ON l.doc_id = r.doc_id LEFT JOIN kept k ON l.doc_id = k.doc_id
""",
    "op8_topk": """
WITH v AS (
  SELECT vec_id, list_transform(embedding, lambda x: CAST(floor(1024 * CAST(x AS DOUBLE)) AS BIGINT)) AS v
  FROM embeddings
  WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
), pairs AS (
  SELECT q.vec_id AS query_id, c.vec_id AS vec_id,
         CAST(list_sum(list_transform(range(1, len(q.v) + 1), lambda i: q.v[i] * c.v[i])) AS BIGINT) AS score
  FROM v q JOIN v c ON q.vec_id % 100 = 0 AND q.vec_id <> c.vec_id
), ranked AS (
  SELECT query_id, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS INTEGER) AS rank, vec_id, score
  FROM pairs
)
SELECT query_id, rank, vec_id, score FROM ranked WHERE rank <= 10
""",
    "op10_exact_dedup": """
WITH t AS (
  SELECT doc_id, length(coalesce(text, '')) AS n,
         regexp_replace(coalesce(text, ''), '[\\x20\\x09-\\x0D]', '', 'g') AS body
  FROM documents
), g AS (
  SELECT body, arg_max(doc_id, struct_pack(n := n, d := -doc_id)) AS keep_id, count(*) AS group_size FROM t GROUP BY body
)
SELECT doc_id, keep_id, CAST(group_size AS BIGINT) AS group_size, doc_id = keep_id AS kept, sha256(body) AS text_sha256
FROM t JOIN g USING (body)
""",
}
