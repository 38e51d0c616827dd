"""The queries of this subpackage, by name, and the SQL of those that SQL can express."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from .ann import op1_inner_product_search
from .divergence import op12_source_divergence
from .embedding_dedup import op7_embedding_near_dedup
from .language import op10_page_language
from .lexical_search import op13_lexical_search
from .line_dedup import op11_line_dedup
from .mixing import op9_source_mixing
from .ngram_join import op4_ngram_jaccard_join
from .packing import op5_best_fit_packing
from .pii import op2_personal_data
from .quality import op6_weak_label_quality
from .sharding import op8_byte_sharding
from .toxicity import op3_toxicity

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    f.__name__: f
    for f in (
        op1_inner_product_search,
        op2_personal_data,
        op3_toxicity,
        op4_ngram_jaccard_join,
        op5_best_fit_packing,
        op6_weak_label_quality,
        op7_embedding_near_dedup,
        op8_byte_sharding,
        op9_source_mixing,
        op10_page_language,
        op11_line_dedup,
        op12_source_divergence,
        op13_lexical_search,
    )
}
ORACLE_SQL: dict[str, str] = {
    "op1_inner_product_search": """
WITH v AS (SELECT vec_id, CAST(embedding AS DOUBLE[]) AS e FROM embeddings WHERE len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0 AND len(list_filter(embedding, lambda x: x <> 0)) > 0),
s AS (SELECT q.vec_id AS query_id, v.vec_id, list_inner_product(q.e, v.e) AS score FROM v q JOIN v ON q.vec_id % 20 = 0 AND v.vec_id <> q.vec_id)
SELECT query_id, CAST(rank AS INT) AS rank, vec_id, score FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS rank FROM s) WHERE rank <= 20""",
    # the checksum by a table of 256 entries, one byte after the other
    "op8_byte_sharding": """
WITH t AS (SELECT list_transform(range(256), lambda n: list_reduce(list_concat([n], range(8)), lambda c, k: CASE WHEN c & 1 = 1 THEN xor(3988292384, c >> 1) ELSE c >> 1 END)) AS t),
h AS (SELECT doc_id, hex(encode(coalesce(text, ''))) AS h FROM documents),
b AS (SELECT doc_id, list_transform(range(0, strlen(h) // 2), lambda i: 16 * (instr('0123456789ABCDEF', h[2 * i + 1]) - 1) + instr('0123456789ABCDEF', h[2 * i + 2]) - 1) AS b FROM h),
c AS (SELECT doc_id, CAST(len(b) + 1 AS BIGINT) AS size, CAST(xor(list_reduce(list_concat([4294967295], b), lambda c, x: xor(t[(xor(c, x) & 255) + 1], c >> 8)), 4294967295) AS BIGINT) AS text_crc32 FROM b, t),
s AS (SELECT *, sum(size) OVER (ORDER BY doc_id NULLS FIRST, text_crc32, size ROWS UNBOUNDED PRECEDING) AS ends, sum(size) OVER () AS total FROM c),
p AS (SELECT *, CAST((2 * ends - size) * 16 // (2 * total) AS INT) AS shard FROM s)
SELECT doc_id, size, text_crc32, 'bytes' AS law, shard, row_number() OVER (PARTITION BY shard ORDER BY doc_id NULLS FIRST, text_crc32, size) - 1 AS slot, CAST(NULL AS INT) AS grown_shard FROM p""",
    "op4_ngram_jaccard_join": r"""
WITH RECURSIVE w AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS w FROM documents),
s AS (SELECT DISTINCT doc_id, unnest(CASE WHEN len(w) >= 3 THEN list_transform(range(1, len(w) - 1), lambda i: w[i] || ' ' || w[i + 1] || ' ' || w[i + 2]) WHEN len(w) > 0 THEN [array_to_string(w, ' ')] END) AS g FROM w),
n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
p AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS c FROM s a JOIN s b ON a.g = b.g AND a.doc_id <> b.doc_id GROUP BY ALL),
l AS (SELECT p.a, p.b FROM p JOIN n x ON x.doc_id = p.a JOIN n y ON y.doc_id = p.b WHERE 100 * c >= 90 * (x.n + y.n - c)),
r AS (SELECT doc_id, doc_id AS other FROM documents UNION SELECT r.doc_id, l.b FROM r JOIN l ON l.a = r.other)
SELECT d.doc_id, coalesce(n.n, 0) AS n_shingles, c.component_id FROM documents d LEFT JOIN n USING (doc_id) JOIN (SELECT doc_id, min(other) AS component_id FROM r GROUP BY doc_id) c USING (doc_id)""",
    "op7_embedding_near_dedup": """
WITH RECURSIVE v AS (SELECT vec_id, label, CAST(embedding AS DOUBLE[]) AS e FROM embeddings),
l AS (SELECT a.vec_id AS a, b.vec_id AS b FROM v a JOIN v b ON a.label = b.label AND a.vec_id <> b.vec_id AND list_cosine_similarity(a.e, b.e) >= 0.98),
r AS (SELECT vec_id, vec_id AS other FROM v UNION SELECT r.vec_id, l.b FROM r JOIN l ON l.a = r.other),
c AS (SELECT vec_id, min(other) AS component_id FROM r GROUP BY vec_id), d AS (SELECT a AS vec_id, count(*) AS n FROM l GROUP BY a)
SELECT v.vec_id, coalesce(d.n, 0) AS n_links, c.component_id, v.vec_id = c.component_id AS kept FROM v LEFT JOIN d USING (vec_id) JOIN c USING (vec_id)""",
    "op11_line_dedup": r"""
WITH l AS (SELECT doc_id, unnest(string_split(coalesce(text, ''), chr(10))) AS line, generate_subscripts(string_split(coalesce(text, ''), chr(10)), 1) AS place FROM documents),
k AS (SELECT *, translate(regexp_replace(line, '^[\x20\x09-\x0D]+|[\x20\x09-\x0D]+$', '', 'g'), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS key FROM l),
f AS (SELECT key, min(doc_id) AS first FROM k WHERE length(key) >= 10 GROUP BY key HAVING min(doc_id) <> max(doc_id)),
d AS (SELECT k.*, f.first IS NOT NULL AND f.first <> k.doc_id AS gone FROM k LEFT JOIN f USING (key))
SELECT doc_id, count(*) AS n_lines, count(*) FILTER (gone) AS n_dropped, sha256(coalesce(string_agg(line, chr(10) ORDER BY place) FILTER (NOT gone), '')) AS kept_sha256 FROM d GROUP BY doc_id""",
    "op12_source_divergence": r"""
WITH d AS (SELECT row_number() OVER () AS d, coalesce(lang, '') AS lang, coalesce(source, '') AS source, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x40\x5B-\x60\x7B-\x7F]+') AS t FROM documents),
w AS (SELECT d, lang, source, unnest(t) AS term FROM d), v AS (SELECT lang, term, count(*) AS c FROM w GROUP BY ALL HAVING count(DISTINCT d) >= 30),
l AS (SELECT lang, count(*) AS v, sum(c) AS n FROM v GROUP BY lang),
c AS (SELECT lang, source, term, count(*) AS c FROM w SEMI JOIN v USING (lang, term) GROUP BY ALL), s AS (SELECT lang, source, sum(c) AS n FROM c GROUP BY ALL),
g AS (SELECT DISTINCT d.lang, d.source, coalesce(s.n, 0) AS n FROM d LEFT JOIN s USING (lang, source)),
p AS (SELECT g.lang, g.source, v.term, coalesce(c.c, 0) AS c, CAST(1 + CAST(1000000000 AS HUGEINT) * (coalesce(c.c, 0) + 5) // (g.n + 5 * l.v) AS BIGINT) AS p, CAST(1 + CAST(1000000000 AS HUGEINT) * (v.c + 5) // (l.n + 5 * l.v) AS BIGINT) AS q FROM g JOIN v USING (lang) JOIN l USING (lang) LEFT JOIN c ON c.lang = g.lang AND c.source = g.source AND c.term = v.term),
r AS (SELECT a.lang, a.source, 'pair' AS part, b.source AS item, coalesce(x.value, 0) AS value FROM g a JOIN g b ON a.lang = b.lang AND a.source <> b.source LEFT JOIN (SELECT a.lang, a.source AS s, b.source AS o, CAST(sum(abs(a.p - b.p)) AS BIGINT) AS value FROM p a JOIN p b ON a.lang = b.lang AND a.term = b.term GROUP BY ALL) x ON x.lang = a.lang AND x.s = a.source AND x.o = b.source
UNION ALL SELECT lang, source, 'term', term, p - q FROM p WHERE c > 0 AND p > q)
SELECT lang, source, part, item, value, CAST(row_number() OVER (PARTITION BY lang, source, part ORDER BY value DESC, item) AS INT) AS rank FROM r QUALIFY part = 'pair' OR rank <= 50""",
    "op13_lexical_search": r"""
WITH t AS (SELECT d, doc_id, unnest(regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')) AS term FROM (SELECT *, row_number() OVER () AS d FROM documents)),
f AS (SELECT d, doc_id, term, count(*) AS tf FROM t GROUP BY ALL), n AS (SELECT d, count(*) AS n FROM t GROUP BY d), a AS (SELECT count(DISTINCT d) AS n, count(*) AS l FROM t),
w AS (SELECT term, CAST(floor(1000 * ln((2 * a.n + 2) / (2 * count(*) + 1))) AS BIGINT) AS w FROM f, a GROUP BY term, a.n),
q AS (SELECT item_id, unnest(regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')) AS term FROM benchmark),
s AS (SELECT q.item_id, f.d, f.doc_id, CAST(sum(w.w * ((1000000000 * tf) // (1000 * tf + 12 * (75 + (25 * n.n * a.n) // a.l)))) AS BIGINT) AS score FROM q JOIN f USING (term) JOIN w USING (term) JOIN n USING (d), a GROUP BY ALL)
SELECT item_id, CAST(row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id) AS INT) AS rank, doc_id, score FROM s WHERE score > 0 QUALIFY rank <= 20""",
}
