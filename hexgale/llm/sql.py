"""DuckDB SQL of the text queries that SQL can express: plain definitions, written without the operators' methods."""

from __future__ import annotations

#: Every word of every text with the words before it, all n-grams, and their counts in all other texts.
OP1 = """
WITH d AS (SELECT doc_id, regexp_extract_all(coalesce(text, ''), '[^\\x20\\x09-\\x0D]+') AS words FROM documents),
p AS (SELECT doc_id, len(words) AS size, unnest(words) AS w, generate_subscripts(words, 1) AS i FROM d),
w AS (SELECT doc_id, size, i, w, lag(w, 1) OVER o AS w1, lag(w, 2) OVER o AS w2 FROM p WINDOW o AS (PARTITION BY doc_id ORDER BY i)),
g AS (SELECT doc_id, i, 1 AS n, w AS gram, '' AS context FROM w
      UNION ALL SELECT doc_id, i, 2, w1 || ' ' || w, w1 FROM w WHERE w1 IS NOT NULL
      UNION ALL SELECT doc_id, i, 3, w2 || ' ' || w1 || ' ' || w, w2 || ' ' || w1 FROM w WHERE w2 IS NOT NULL),
own AS MATERIALIZED (SELECT doc_id, gram, count(*) AS k FROM g GROUP BY doc_id, gram),
c AS MATERIALIZED (SELECT gram, sum(k) AS k FROM own GROUP BY gram),
other AS MATERIALIZED (SELECT doc_id, gram, CAST(c.k - own.k AS BIGINT) AS k FROM own JOIN c USING (gram) WHERE c.k > own.k
      UNION ALL SELECT doc_id, '', greatest((SELECT count(*) FROM p) - len(words), 1) FROM d),
best AS (SELECT g.doc_id, i, max(n) AS n, max_by(o.k / x.k, n) AS share
         FROM g JOIN other o ON o.doc_id = g.doc_id AND o.gram = g.gram JOIN other x ON x.doc_id = g.doc_id AND x.gram = g.context GROUP BY g.doc_id, i),
s AS (SELECT w.doc_id, least(w.i, 3) - coalesce(n, 0) AS short, coalesce(share, 1.0 / o.k) AS share
      FROM w JOIN other o ON o.doc_id = w.doc_id AND o.gram = '' LEFT JOIN best ON best.doc_id = w.doc_id AND best.i = w.i),
sums AS (SELECT doc_id, sum(CAST(round_even(ln(share) * 1000000, 0) AS BIGINT) + short * CAST(round_even(ln(0.4) * 1000000, 0) AS BIGINT)) AS score_micro, sum(CAST(short > 0 AS INT)) AS backed FROM s GROUP BY doc_id)
SELECT d.doc_id, CAST(len(words) AS BIGINT) AS n_words, CAST(coalesce(score_micro, 0) AS BIGINT) AS score_micro, CAST(coalesce(backed, 0) AS BIGINT) AS n_backed_off
FROM d LEFT JOIN sums USING (doc_id)
"""

#: All pairs of a label; components by recursion over links.
OP2 = """
WITH RECURSIVE v AS (SELECT vec_id, label, CAST(embedding AS DOUBLE[]) AS e FROM embeddings WHERE label IS NOT NULL AND embedding IS NOT NULL),
u AS (SELECT vec_id, label, e, sqrt(list_inner_product(e, e)) AS norm FROM v),
links AS (SELECT a.vec_id AS a, b.vec_id AS b FROM u a JOIN u b ON a.label = b.label AND a.vec_id <> b.vec_id WHERE list_inner_product(a.e, b.e) / (a.norm * b.norm) >= 0.98),
reach AS (SELECT vec_id AS a, vec_id AS b FROM embeddings UNION SELECT r.a, l.b FROM reach r JOIN links l ON r.b = l.a)
SELECT e.vec_id, (SELECT count(*) FROM links WHERE a = e.vec_id) AS n_links, (SELECT min(b) FROM reach WHERE a = e.vec_id) AS component_id,
       e.vec_id = (SELECT min(b) FROM reach WHERE a = e.vec_id) AS kept
FROM embeddings e
"""

#: CRC-32 from its polynomial, leaves, levels of both trees by recursion, siblings of every path, and the fold by recursion.
OP13 = """
WITH RECURSIVE bits AS (SELECT range AS i, 0 AS k, range AS c FROM range(256)
                        UNION ALL SELECT i, k + 1, CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END FROM bits WHERE k < 8),
tab AS (SELECT list(c ORDER BY i) AS t FROM bits WHERE k = 8),
src AS (SELECT doc_id, coalesce('=' || lang, '') AS tree, n_chars,
               coalesce(strlen(doc_id::VARCHAR) || ':' || doc_id, '-') || coalesce(strlen(source) || ':' || source, '-') || coalesce(strlen(lang) || ':' || lang, '-') AS head,
               coalesce(strlen(text) || ':' || text, '-') AS tail,
               xor(list_reduce(list_prepend(4294967295, list_transform(string_split(doc_id::VARCHAR, ''), lambda x: ascii(x)::BIGINT)), lambda c, b: xor(c >> 8, t[(xor(c, b) & 255) + 1])), 4294967295) % 7 = 0 AS bad
        FROM documents, tab),
dig AS (SELECT doc_id, tree, sha256(head || coalesce(strlen(n_chars::VARCHAR) || ':' || n_chars, '-') || tail) AS d,
               sha256(head || coalesce(strlen((n_chars + CAST(coalesce(bad, false) AS INT))::VARCHAR) || ':' || (n_chars + CAST(coalesce(bad, false) AS INT)), '-') || tail) AS told FROM src),
leaf AS (SELECT *, row_number() OVER (PARTITION BY tree ORDER BY doc_id NULLS FIRST, d) - 1 AS i, row_number() OVER (ORDER BY tree, doc_id NULLS FIRST, d) AS r FROM dig),
lv AS (SELECT tree, 0 AS l, i, d FROM leaf
       UNION ALL SELECT tree, l + 1, i // 2, sha256(string_agg(d, '' ORDER BY i)) FROM (SELECT *, count(*) OVER (PARTITION BY tree) AS n FROM lv) WHERE n > 1 GROUP BY tree, l, i // 2),
sub AS (SELECT tree, d AS subroot, depth, row_number() OVER (ORDER BY tree) - 1 AS g FROM (SELECT tree, max_by(d, l) AS d, max(l) AS depth FROM lv GROUP BY tree)),
top AS (SELECT 0 AS l, g AS i, subroot AS d FROM sub
        UNION ALL SELECT l + 1, i // 2, sha256(string_agg(d, '' ORDER BY i)) FROM (SELECT *, count(*) OVER () AS n FROM top) WHERE n > 1 GROUP BY l, i // 2),
root AS (SELECT max_by(d, l) AS root, max(l) AS depth FROM top),
step AS (SELECT leaf.r, s.l AS pos, leaf.i >> s.l AS own, s.i AS sib, s.d FROM leaf JOIN sub USING (tree) JOIN lv s ON s.tree = leaf.tree AND s.l < sub.depth AND s.i // 2 = (leaf.i >> s.l) // 2
         UNION ALL SELECT leaf.r, 1000 + s.l, sub.g >> s.l, s.i, s.d FROM leaf JOIN sub USING (tree), root, top s WHERE s.l < root.depth AND s.i // 2 = (sub.g >> s.l) // 2),
side AS (SELECT r, row_number() OVER (PARTITION BY r ORDER BY pos) AS k, coalesce(string_agg(d, '') FILTER (WHERE sib < own), '') AS before, coalesce(string_agg(d, '') FILTER (WHERE sib > own), '') AS after FROM step GROUP BY r, pos),
f AS (SELECT r, 0 AS k, told AS d FROM leaf UNION ALL SELECT f.r, f.k + 1, sha256(before || f.d || after) FROM f JOIN side ON side.r = f.r AND side.k = f.k + 1),
done AS (SELECT r, max_by(d, k) AS folded_root FROM f GROUP BY r),
proof AS (SELECT r, sha256(string_agg(before || after, '' ORDER BY k)) AS proof_sha256 FROM side GROUP BY r)
SELECT doc_id, leaf.d AS leaf, subroot, root, coalesce(proof_sha256, sha256('')) AS proof_sha256, folded_root, folded_root = root AS verified
FROM leaf JOIN sub USING (tree) JOIN done USING (r) LEFT JOIN proof USING (r), root
"""

ORACLES: dict[str, str] = {"op1_lm_score": OP1, "op2_embedding_near_dedup": OP2, "op13_merkle_manifest": OP13}
