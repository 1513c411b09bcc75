"""SQL that gives the rows of the queries which SQL can express, over whole tables and whole texts.

Packing, the classifiers, the graph search, decontamination, HTML and sharding depend on a tokenizer, a
fitted model, a graph, substitutions, markup or a propagation that SQL can't state.
"""

from __future__ import annotations

from .chat import PROBE_ID, PROBE_TEXT

_WORDS = r"regexp_extract_all({text}, '[^\x20\x09-\x0D]+')"
_LOWER = "translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"

#: Sets that are equal are one node, so that copies are not joined in pairs.
NGRAMS = f"""
WITH RECURSIVE w AS (SELECT doc_id, coalesce({_WORDS.format(text=_LOWER)}, []) AS words FROM documents),
s AS (SELECT doc_id, CASE WHEN len(words) BETWEEN 1 AND 3 THEN [array_to_string(words, ' ')]
      ELSE list_sort(list_distinct(list_transform(range(1, len(words) - 2), lambda i: array_to_string(words[i : i + 3], ' ')))) END AS shingles FROM w),
d AS (SELECT doc_id, shingles, len(shingles) AS n, md5(array_to_string(shingles, chr(10))) AS sig FROM s),
nodes AS (SELECT sig, any_value(shingles) AS shingles, any_value(n) AS n, min(doc_id) AS doc_id FROM d WHERE n > 0 GROUP BY sig),
e AS (SELECT doc_id, n, unnest(shingles) AS shingle FROM nodes),
common AS (SELECT a.doc_id AS a, b.doc_id AS b, a.n AS na, b.n AS nb, count(*) AS k FROM e a JOIN e b ON a.shingle = b.shingle AND a.doc_id <> b.doc_id
           AND 100 * least(a.n, b.n) >= 85 * greatest(a.n, b.n) GROUP BY ALL),
links AS (SELECT a, b FROM common WHERE 100 * k >= 85 * (na + nb - k)),
reach AS (SELECT doc_id AS a, doc_id AS b FROM nodes UNION SELECT r.a, l.b FROM reach r JOIN links l ON r.b = l.a),
least AS (SELECT a, min(b) AS component_id FROM reach GROUP BY a)
SELECT d.doc_id, d.n::BIGINT AS n_shingles, coalesce(least.component_id, d.doc_id) AS component_id
FROM d LEFT JOIN nodes ON nodes.sig = d.sig AND d.n > 0 LEFT JOIN least ON least.a = nodes.doc_id
"""

_ESCAPED = r"regexp_replace({0}, '({1})', '\\\1', 'g')"

CHAT = f"""
WITH t AS (SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
           UNION ALL SELECT {PROBE_ID}, 0, 'user', '{PROBE_TEXT}' UNION ALL SELECT {PROBE_ID}, 1, 'assistant', '{PROBE_TEXT}')
SELECT conv_id, count(*) AS n_turns,
       sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn NULLS FIRST, role, text)) AS turns_sha256,
       coalesce(sum(length(text)) FILTER (WHERE role = 'assistant'), 0)::BIGINT AS loss_chars,
       sha256(coalesce(string_agg(text, '' ORDER BY turn NULLS FIRST, role, text) FILTER (WHERE role = 'assistant'), '')) AS loss_sha256,
       sum(length('### : </turn>') + 1 + length({_ESCAPED.format("role", r"\\|#|</turn>|:|" + chr(10))}) + length({_ESCAPED.format("text", r"\\|#|</turn>")}))::BIGINT AS formatted_chars
FROM t GROUP BY conv_id
"""

SUBSTRINGS = f"""
WITH w AS (SELECT row_number() OVER () AS k, doc_id, coalesce({_WORDS.format(text="text")}, []) AS words FROM documents),
windows AS (SELECT k, doc_id, p, md5(array_to_string(words[p : p + 49], ' ')) AS content FROM w, LATERAL (SELECT unnest(range(1, len(words) - 48)) AS p)),
firsts AS (SELECT content, min(doc_id) AS first FROM windows GROUP BY content),
hits AS (SELECT k, p FROM windows JOIN firsts USING (content) WHERE first < doc_id),
each AS (SELECT k, p, words[p] AS word FROM w, LATERAL (SELECT unnest(range(1, len(words) + 1)) AS p)),
marked AS (SELECT each.k, each.p, word, count(hits.p) OVER (PARTITION BY each.k ORDER BY each.p ROWS BETWEEN 49 PRECEDING AND CURRENT ROW) > 0 AS gone
           FROM each LEFT JOIN hits ON hits.k = each.k AND hits.p = each.p),
kept AS (SELECT k, count(*) FILTER (WHERE gone) AS n_removed, string_agg(word, ' ' ORDER BY p) FILTER (WHERE NOT gone) AS text FROM marked GROUP BY k)
SELECT doc_id, len(words)::BIGINT AS n_words, coalesce(n_removed, 0)::BIGINT AS n_removed, sha256(coalesce(kept.text, '')) AS kept_sha256 FROM w LEFT JOIN kept USING (k)
"""
