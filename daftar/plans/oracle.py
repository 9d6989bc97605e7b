"""Oracle SQL (DuckDB) of the core queries."""

from __future__ import annotations

SQL: dict[str, str] = {}

_WS = r"\x{09}-\x{0d}\x{1c}-\x{20}\x{85}\x{a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}"


def _strip(x: str) -> str:
    return f"regexp_replace({x}, '^[{_WS}]+|[{_WS}]+$', '', 'g')"


def _clean(x: str, digits: bool) -> str:
    x = f"regexp_replace(regexp_replace({x}, 'Page number: \\p{{Nd}}+', '', 'g'), '- \\p{{Nd}}+ -', '', 'g')"
    if not digits:
        for _ in range(2):  # neighbours share a separator
            x = f"regexp_replace({x}, '(^|[^\\p{{L}}\\p{{N}}_])\\p{{Nd}}+($|[^\\p{{L}}\\p{{N}}_])', '\\1\\2', 'g')"
    x = f"regexp_replace({x}, '[^\\x{{0600}}-\\x{{06ff}}{'0-9' if digits else ''}{_WS}]', '', 'g')"
    return f"trim(regexp_replace({x}, '[{_WS}]+', ' ', 'g'), ' ')"


_DISTANCE = {
    "cosine": "1 - list_cosine_similarity(q.embedding::DOUBLE[], b.embedding::DOUBLE[])",
    "l2": "list_sum(list_transform(list_zip(q.embedding, b.embedding), lambda z: (z[1]::DOUBLE - z[2]::DOUBLE) * (z[1]::DOUBLE - z[2]::DOUBLE)))",
    "l2_half": "list_sum(list_transform(list_zip(q.embedding[1:32], b.embedding[1:32]), lambda z: (z[1]::DOUBLE - z[2]::DOUBLE) * (z[1]::DOUBLE - z[2]::DOUBLE)))",
}


def _knn(metric: str, k: int) -> str:
    return f"""SELECT * FROM (SELECT query_id, id, distance, row_number() OVER (PARTITION BY query_id ORDER BY distance, id)::INT AS rank FROM (
SELECT q.vec_id AS query_id, b.vec_id AS id, round({_DISTANCE[metric]}, 9) AS distance FROM embeddings q, embeddings b WHERE q.vec_id % 50 = 0 AND q.vec_id <> b.vec_id)) WHERE rank <= {k}"""


SQL["knn_cosine_topk"] = f"SELECT query_id, rank, id, round(distance, 6) AS distance FROM ({_knn('cosine', 10)})"
SQL["knn_l2_topk"] = f"SELECT query_id, rank, id, round(distance, 6) AS distance FROM ({_knn('l2', 10)})"
_LISTS = f"SELECT query_id, 0 AS list_id, rank - 1 AS rank, id AS doc FROM ({_knn('cosine', 6)}) UNION ALL SELECT query_id, 1, rank - 1, id FROM ({_knn('l2_half', 6)})"
SQL["rrf_fusion"] = f"""SELECT query_id, doc, round(score, 6) AS score, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, l, r)::INT AS fused_rank FROM (
SELECT query_id, doc, round(sum(1.0::DOUBLE / (rank + 60)), 9) AS score, min(list_id) AS l, arg_min(rank, list_id) AS r FROM ({_LISTS}) GROUP BY query_id, doc)"""
SQL["multi_query_union"] = f"""SELECT query_id, doc, row_number() OVER (PARTITION BY query_id ORDER BY l, r)::INT AS position FROM (
SELECT query_id, doc, min(list_id) AS l, arg_min(rank, list_id) AS r FROM ({_LISTS}) GROUP BY query_id, doc)"""
SQL["hit_rate_mrr"] = f"""WITH t AS (SELECT q.vec_id AS query_id, min(e.vec_id) AS doc FROM embeddings q JOIN embeddings e ON q.label = e.label AND q.vec_id <> e.vec_id WHERE q.vec_id % 50 = 0 GROUP BY 1),
h AS (SELECT t.query_id, min(k.rank) AS rank FROM t LEFT JOIN ({_knn('cosine', 10)}) k ON k.query_id = t.query_id AND k.id = t.doc GROUP BY 1)
SELECT round(avg(CASE WHEN rank IS NULL THEN 0.0::DOUBLE ELSE 1 END), 6) AS avg_hit_rate, round(avg(coalesce(1.0::DOUBLE / rank, 0)), 6) AS avg_reciprocal_rank FROM h"""
SQL["rag_prompt"] = """WITH v AS (SELECT vec_id, coalesce(document, '') AS document, embedding::DOUBLE[] AS e FROM vectors WHERE len(embedding) = 64 AND list_max(list_transform(embedding, lambda x: abs(x))) > 0),
k AS (SELECT q.vec_id AS query_id, q.document AS question, b.document, row_number() OVER (PARTITION BY q.vec_id ORDER BY round(1 - list_cosine_similarity(q.e, b.e), 9), b.vec_id) AS rank FROM v q, v b WHERE q.vec_id % 50 = 0 AND q.vec_id <> b.vec_id)
SELECT query_id, 'Answer the question from the context only. If it is not there, say ''NO ANSWER IS AVAILABLE.''' || chr(10) || '### Context' || chr(10) || string_agg(document, chr(10) || chr(10) ORDER BY rank) || chr(10) || '### Question' || chr(10) || any_value(question) || chr(10) || '### Answer:' AS prompt
FROM k WHERE rank <= 3 GROUP BY query_id"""
_FIRST = "SELECT *, row_number() OVER (PARTITION BY source ORDER BY vec_id) AS i FROM vectors WHERE source IS NOT NULL AND document IS NOT NULL"
SQL["display_frozen"] = f"SELECT source, string_agg('**Document ' || i || ':**' || chr(10) || document || chr(10) || '**Metadata:** ' || metadata, chr(10) ORDER BY i) AS display FROM ({_FIRST}) WHERE i <= 5 GROUP BY source"
SQL["display_hyde"] = f"SELECT source, string_agg('Document ' || i || ':' || chr(10) || document, chr(10) || chr(10) ORDER BY i) AS documents, string_agg('Metadata ' || i || ':' || chr(10) || metadata, chr(10) || chr(10) ORDER BY i) AS metadatas FROM ({_FIRST}) WHERE i <= 5 GROUP BY source"
SQL["lookup_ids"] = "SELECT id, vec_id, document FROM vectors WHERE id IN ('chunk_0', 'chunk_7', 'chunk_90')"
SQL["store_count"] = "SELECT count(*) AS n, count(embedding) AS embedded FROM vectors"
SQL["add_if_absent"] = "SELECT chunk_key AS id, source FROM chunks WHERE chunk_key NOT IN (SELECT chunk_key FROM vectors)"

SQL["clean_keep_digits"] = f"SELECT chunk_key, {_clean('page_content', True)} AS cleaned FROM chunks"
SQL["clean_drop_digits"] = f"SELECT row_id, {_clean('context', False)} AS context, {_clean('question', False)} AS question, {_clean('answer', False)} AS answer FROM qa_pairs"
SQL["marker_removal"] = "SELECT chunk_key, regexp_replace(page_content, 'Page number: \\p{Nd}+', '', 'g') AS cleaned FROM chunks"
SQL["source_labels"] = "SELECT chunk_key, replace(regexp_replace(list_last(string_split(source, '/')), '\\.txt$', ''), '_', ' ') AS label FROM chunks"
SQL["squad_answer"] = "SELECT row_id, answer FROM qa_pairs"
SQL["merge_columns"] = "SELECT row_id, 'السؤال: ' || coalesce(question, 'None') || chr(10) || 'الإجابة: ' || coalesce(answer, 'None') || chr(10) || 'السياق: ' || coalesce(context, 'None') AS merged FROM qa_pairs"
SQL["format_answer"] = "SELECT row_id, replace(replace(answer, ':', ':' || chr(10)), chr(10), chr(10) || chr(10)) AS formatted FROM qa_pairs"
SQL["build_prompt"] = "SELECT row_id, 'C: ' || context || chr(10) || 'Q: ' || question || chr(10) || 'A:' AS prompt FROM qa_pairs"
SQL["strip_join_lines"] = f"SELECT chunk_key, array_to_string(list_transform(string_split(regexp_replace(page_content, '\\n$', ''), chr(10)), lambda x: {_strip('x')}), ' ') || ' ' AS joined FROM chunks"
SQL["csv_documents"] = "SELECT 'qa.csv' AS source, row_id AS row, 'context: ' || coalesce(context, '') || chr(10) || 'question: ' || coalesce(question, '') || chr(10) || 'answer: ' || coalesce(answer, '') AS page_content FROM qa_pairs"
SQL["error_policy"] = "SELECT event_type, CASE event_type WHEN 'error' THEN 'rate_limit' WHEN 'view' THEN 'unavailable' WHEN 'click' THEN 'unknown' END AS policy, count(*) AS n FROM events GROUP BY 1, 2"
SQL["page_marked_text"] = """WITH c AS (SELECT source, chunk_id AS page_number, chunk_key AS row_no, ['', 'Page number: ' || chunk_id, ''] || string_split(page_content, chr(10)) AS l FROM chunks WHERE source IS NOT NULL AND page_content IS NOT NULL)
SELECT source, NULL::BIGINT AS page_number, NULL::BIGINT AS row_no, 0::INT AS line_no, 'Total pages: ' || count(*) AS line FROM c GROUP BY source
UNION ALL SELECT source, page_number, row_no, (generate_subscripts(l, 1) - 1)::INT, unnest(l) FROM c"""
SQL["page_marked_document"] = """WITH l AS (SELECT item_id, string_split(text, '.') AS l FROM eval_items WHERE text IS NOT NULL)
SELECT item_id, 'Total pages: ' || len(l) || chr(10) || array_to_string(list_transform(l, lambda x, i: chr(10) || 'Page number: ' || i || chr(10) || chr(10) || x), chr(10)) AS text FROM l"""
SQL["page_lines"] = "SELECT chunk_key AS source, generate_subscripts(l, 1)::INT AS line_no, unnest(l) AS line FROM (SELECT chunk_key, string_split(regexp_replace(page_content, '\\n$', ''), chr(10)) AS l FROM chunks)"

SQL["qa_parse"] = f"""WITH r AS (SELECT row_id, string_split('preamble Question : ' || question || ' | ' || answer || ' Question : a | b | c Question :  q2 | ' || chr(10) || ' a2 ', 'Question :') AS p FROM qa_pairs),
u AS (SELECT row_id, (generate_subscripts(p, 1) - 1)::INT AS pair_no, unnest(p) AS part FROM r),
s AS (SELECT row_id, pair_no, string_split(part, ' | ') AS two FROM u WHERE pair_no > 0)
SELECT row_id, pair_no, {_strip('two[1]')} AS question, {_strip('two[2]')} AS answer FROM s WHERE len(two) = 2"""
SQL["human_qa_islands"] = f"""SELECT (row_id // 20)::BIGINT AS file, row_number() OVER (PARTITION BY row_id // 20 ORDER BY row_id) AS pair_no, {_strip("'س ' || row_id || ') ' || replace(question, chr(10), ' ')")} AS question,
{_strip(_strip("replace(coalesce(answer, ''), chr(10), ' ')") + " || ' end'")} AS answer FROM qa_pairs WHERE question IS NOT NULL"""
SQL["append_frames"] = "SELECT doc_id AS id, text, lang, NULL::VARCHAR AS split FROM documents UNION ALL SELECT item_id, text, NULL, split FROM eval_items"


def _flat(x: str) -> str:
    return _strip(f"regexp_replace({x}, '[{_WS}|]', ' ', 'g')")


SQL["generated_pairs"] = f"SELECT chunk_key, {_flat('substr(page_content, 1, 60)')} AS question, {_flat('substr(page_content, 30, 80)')} AS answer FROM chunks WHERE page_content IS NOT NULL"


def _split(table: str, key: str, text: str, separator: str, size: int, overlap: int) -> str:
    """CTEs of the marker splitter: _chunks (key, position from 0, chunk); i is the next piece, s where the current chunk begins."""
    sep = "chr(10)" if separator == "\n" else f"'{separator}'"
    cur = _strip("array_to_string(l[s:i - 1], '')")
    had = "c[i] - c[s]"
    return f"""_parts AS (SELECT {key}, string_split({text}, {sep}) AS p FROM {table} WHERE {text} IS NOT NULL),
_pieces AS (SELECT {key}, list_filter([p[1]] || list_transform(p[2:], lambda x: {sep} || x), lambda x: x <> '') AS l FROM _parts),
_sums AS (SELECT {key}, l, [0] || list_transform(range(1, len(l) + 1), lambda k: list_sum(list_transform(l[1:k], lambda x: length(x)))::BIGINT) AS c FROM _pieces),
_steps AS (SELECT {key}, l, c, 1::BIGINT AS i, 1::BIGINT AS s, []::VARCHAR[] AS out FROM _sums UNION ALL
SELECT {key}, l, c, i + 1, CASE WHEN i > len(l) THEN s WHEN length(l[i]) >= {size} THEN i + 1
WHEN s < i AND {had} + length(l[i]) > {size} THEN coalesce(list_min(list_filter(range(s, i), lambda j: c[i] - c[j] <= {overlap} AND c[i] - c[j] + length(l[i]) <= {size})), i) ELSE s END,
list_filter(CASE WHEN i > len(l) THEN [{cur}] WHEN length(l[i]) >= {size} THEN [{cur}, l[i]] WHEN s < i AND {had} + length(l[i]) > {size} THEN [{cur}] ELSE [] END, lambda x: x <> '')
FROM _steps WHERE i <= len(l) + 1),
_out AS (SELECT {key}, i, generate_subscripts(out, 1) AS j, unnest(out) AS chunk FROM _steps),
_chunks AS (SELECT {key}, row_number() OVER (PARTITION BY {key} ORDER BY i, j) - 1 AS position, chunk FROM _out)"""


SQL["chunk_pages"] = f"WITH RECURSIVE {_split('documents', 'doc_id', 'text', chr(10), 400, 0)} SELECT doc_id, position::INT AS position, chunk FROM _chunks"
SQL["chunk_overlap"] = f"WITH RECURSIVE {_split('chunks', 'chunk_key', 'page_content', chr(10), 500, 200)} SELECT chunk_key, position::INT AS position, chunk FROM _chunks"
_LABEL = "replace(regexp_replace(list_last(string_split(source, '/')), '\\.txt$', ''), '_', ' ')"
_STORE = f"""{_split('chunks', 'chunk_key', 'page_content', 'Page number', 1000, 0)},
_store AS (SELECT 'chunk_' || (n - 1) AS id, document, CASE WHEN source IS NULL THEN '{{"chunk_id":' || n || '}}' ELSE '{{"source":"' || {_LABEL} || '","chunk_id":' || n || '}}' END AS metadata FROM (
SELECT c.chunk_key, source, {_clean('chunk', True)} AS document, row_number() OVER (ORDER BY c.chunk_key, position) AS n FROM _chunks c JOIN chunks USING (chunk_key)))"""
SQL["index_build"] = f"WITH RECURSIVE {_STORE} SELECT * FROM _store"


def _hashed(name: str, key: str, text: str, table: str, dim: int = 64) -> str:
    """CTEs of the stand-in embedder: name (k, v), scaled to length one in single precision."""
    return f"""_w{name} AS (SELECT {key} AS k, unnest(string_split_regex({text}, '[{_WS}]+')) AS w FROM {table}),
_n{name} AS (SELECT k, (('0x' || substr(md5(w), 2, 8))::BIGINT % {dim}) AS p, sum(CASE WHEN substr(md5(w), 1, 1) >= '8' THEN 1 ELSE -1 END)::DOUBLE AS x FROM _w{name} WHERE w <> '' GROUP BY 1, 2),
_l{name} AS (SELECT k, map_from_entries(list((p, x))) AS m, sqrt(sum(x * x)) AS n FROM _n{name} GROUP BY 1),
{name} AS (SELECT k, list_transform(range({dim}), lambda i: (coalesce(m[i], 0) / n)::FLOAT::DOUBLE) AS v FROM _l{name} WHERE n > 0)"""


_NEAR = "round(1 - list_sum(list_transform(list_zip(q.v, e.v), lambda z: z[1] * z[2])) / sqrt(list_sum(list_transform(q.v, lambda x: x * x)) * list_sum(list_transform(e.v, lambda x: x * x))), 9)"


def _hits(k: int) -> str:
    return f"""{_STORE}, {_hashed('_e', 'id', 'document', '_store')}, {_hashed('_q', 'item_id', 'question', '(SELECT * FROM eval_items WHERE item_id % 50 = 0)')},
_d AS (SELECT q.k AS query_id, e.k AS id, {_NEAR} AS d FROM _q q, _e e),
_hits AS (SELECT * FROM (SELECT query_id, id, row_number() OVER (PARTITION BY query_id ORDER BY d, id) AS rank FROM _d) WHERE rank <= {k}),
_shown AS (SELECT query_id, string_agg(document, chr(10) || chr(10) ORDER BY rank) AS context, string_agg('**Document ' || rank || ':**' || chr(10) || document || chr(10) || '**Metadata:** ' || metadata, chr(10) ORDER BY rank) AS both_shown,
string_agg('Document ' || rank || ':' || chr(10) || document, chr(10) || chr(10) ORDER BY rank) AS documents, string_agg('Metadata ' || rank || ':' || chr(10) || metadata, chr(10) || chr(10) ORDER BY rank) AS metadatas FROM _hits JOIN _store USING (id) GROUP BY query_id)"""


_PROMPT = "'Answer the question from the context only. If it is not there, say ''NO ANSWER IS AVAILABLE.''' || chr(10) || '### Context' || chr(10) || coalesce(context, '') || chr(10) || '### Question' || chr(10) || question || chr(10) || '### Answer:'"
_ASKED = "FROM eval_items LEFT JOIN _shown ON query_id = item_id WHERE item_id % 50 = 0"
for _name, _k in (("frozen_rag", 7), ("hyde_rag", 5)):
    SQL[_name] = f"WITH RECURSIVE {_hits(_k)} SELECT item_id AS query_id, {_PROMPT} AS prompt, '### Answer:' AS response, 1::INT AS attempts {_ASKED}"
SQL["serve_frozen"] = f"WITH RECURSIVE {_hits(7)} SELECT item_id AS query_id, '### Answer:' AS answer, coalesce(both_shown, '') AS documents {_ASKED}"
SQL["serve_hyde"] = f"WITH RECURSIVE {_hits(5)} SELECT item_id AS query_id, '### Answer:' AS answer, coalesce(documents, '') AS documents, coalesce(metadatas, '') AS metadatas {_ASKED}"
SQL["multi_query_rag"] = f"WITH RECURSIVE {_hits(4)} SELECT query_id, id AS doc, round(3.0::DOUBLE / (rank + 59), 6) AS score, rank::INT AS fused_rank FROM _hits"
SQL["embed_texts"] = f"""WITH w AS (SELECT item_id, unnest(string_split_regex(text, '[{_WS}]+')) AS w FROM eval_items WHERE text IS NOT NULL),
n AS (SELECT item_id, ('0x' || substr(md5(w), 2, 8))::BIGINT % 16 AS i, CASE WHEN substr(md5(w), 1, 1) >= '8' THEN 1 ELSE -1 END AS x FROM w WHERE w <> '')
SELECT e.item_id, r.i::INT AS i, coalesce(sum(n.x), 0)::FLOAT AS x FROM eval_items e CROSS JOIN range(16) r(i) LEFT JOIN n ON n.item_id = e.item_id AND n.i = r.i WHERE e.text IS NOT NULL GROUP BY 1, 2"""
SQL["retrieval_evaluation"] = f"""WITH p AS (SELECT row_id, question, context FROM qa_pairs WHERE question IS NOT NULL AND context IS NOT NULL),
{_hashed('_e', "'chunk_' || row_id", 'context', 'p')}, {_hashed('_q', 'row_id', 'question', '(SELECT * FROM p WHERE row_id % 50 = 0)')},
d AS (SELECT q.k AS query_id, e.k AS id, {_NEAR} AS d FROM _q q, _e e),
h AS (SELECT * FROM (SELECT query_id, id, row_number() OVER (PARTITION BY query_id ORDER BY d, id) AS rank FROM d) WHERE rank <= 10),
x AS (SELECT h.query_id, h.rank, p.context FROM h JOIN p ON h.id = 'chunk_' || p.row_id),
b AS (SELECT t.row_id, min(x.rank) AS rank FROM p t LEFT JOIN x ON x.query_id = t.row_id AND x.context = t.context WHERE t.row_id % 50 = 0 GROUP BY 1)
SELECT round(avg(CASE WHEN rank IS NULL THEN 0.0::DOUBLE ELSE 1 END), 6) AS avg_hit_rate, round(avg(coalesce(1.0::DOUBLE / rank, 0)), 6) AS avg_reciprocal_rank FROM b"""

_FILE = "title || chr(10) || chr(12) || kind || chr(10) || lang || chr(10)"
SQL["text_files"] = f"SELECT md5(source) AS file, {_FILE} AS page_content FROM sources"
SQL["split_files"] = f"WITH RECURSIVE t AS (SELECT md5(source) AS file, {_FILE} AS x FROM sources), {_split('t', 'file', 'x', chr(10), 30, 0)} SELECT file, position::INT AS position, chunk AS page_content FROM _chunks"
SQL["scan_lines"] = "SELECT md5(source) AS file, 1::INT AS page_number, 1::INT AS line_no, title AS line FROM sources UNION ALL SELECT md5(source), 2, 1, kind FROM sources UNION ALL SELECT md5(source), 2, 2, lang FROM sources"
SQL["csv_files"] = "SELECT nullif(context, '') AS context, nullif(question, '') AS question, nullif(answer, '') AS answer FROM qa_pairs"
SQL["named_splits"] = "SELECT row_id, question FROM qa_pairs WHERE split = 'validation'"
SQL["vector_store"] = "SELECT id, document, metadata FROM vectors WHERE len(embedding) = 64"
SQL["memory_store"] = "SELECT 'chunk_' || (row_number() OVER (ORDER BY item_id) - 1) AS id, text AS document, split AS metadata FROM eval_items WHERE text IS NOT NULL"
SQL["adapter_files"] = """SELECT (dense_rank() OVER (ORDER BY label) - 1)::INT AS i, j::INT AS j, round(avg(x), 6) AS w, label::DOUBLE AS b, 64::INT AS dim FROM (
SELECT label, unnest(embedding)::DOUBLE AS x, generate_subscripts(embedding, 1) - 1 AS j FROM embeddings) GROUP BY label, j"""

SQL["chunk_stats"] = "SELECT source, count(*) AS n, min(length(page_content))::INT AS shortest, max(length(page_content))::INT AS longest, round(avg(length(page_content)), 6) AS mean FROM chunks GROUP BY source"
_NUMBERS = "SELECT chunk_key, row_number() OVER (ORDER BY coalesce(source, ''), chunk_id, chunk_key) AS position FROM chunks"
SQL["chunk_numbers"] = f"SELECT chunk_key, position, 'chunk_' || (position - 1) AS id FROM ({_NUMBERS})"
SQL["positional_slice"] = f"SELECT * FROM ({_NUMBERS}) WHERE position BETWEEN 2 AND 278"
SQL["head_tail"] = "(SELECT row_id, question FROM qa_pairs ORDER BY row_id LIMIT 5) UNION ALL (SELECT row_id, question FROM qa_pairs ORDER BY row_id DESC LIMIT 5)"
SQL["cell_access"] = "SELECT row_id, context FROM qa_pairs WHERE row_id = 77"
SQL["stuff_context"] = "SELECT source, string_agg(page_content, chr(10) || chr(10) ORDER BY i) AS context FROM (SELECT *, row_number() OVER (PARTITION BY source ORDER BY chunk_id, chunk_key) AS i FROM chunks WHERE source IS NOT NULL AND page_content IS NOT NULL) WHERE i <= 3 GROUP BY source"

SQL["train_test_split"] = "SELECT doc_id, row_number() OVER (ORDER BY md5('42|' || doc_id), doc_id) <= ceil(0.2 * (SELECT count(*) FROM documents)) AS is_test FROM documents"
SQL["negative_sample"] = """WITH c AS (SELECT chunk_key AS negative, row_number() OVER (ORDER BY md5('0|' || chunk_key), chunk_key) - 1 AS p FROM chunks)
SELECT q.row_id, c.negative FROM qa_pairs q JOIN c ON c.p = ('0x' || substr(md5('0|0|' || q.row_id), 1, 15))::BIGINT % (SELECT count(*) FROM chunks)"""
SQL["shuffled_batches"] = "SELECT doc_id, ceil(row_number() OVER (ORDER BY md5('0|0|' || doc_id), doc_id) / 32.0)::BIGINT AS batch FROM documents"
_FAR = "sqrt(list_sum(list_transform(list_zip({a}, {b}), lambda z: (z[1]::DOUBLE - z[2]::DOUBLE + 1e-6) * (z[1]::DOUBLE - z[2]::DOUBLE + 1e-6))))"
SQL["triplet_loss"] = f"""WITH n AS (SELECT max(vec_id) + 1 AS n FROM embeddings)
SELECT a.vec_id, round(greatest({_FAR.format(a='a.embedding', b='p.embedding')} - {_FAR.format(a='a.embedding', b='m.embedding')} + 1, 0), 6) AS loss
FROM embeddings a, n, embeddings p, embeddings m WHERE p.vec_id = (a.vec_id + 1) % n.n AND m.vec_id = (a.vec_id * 7 + 3) % n.n"""
SQL["linear_adapter"] = """WITH e AS (SELECT vec_id, unnest(embedding)::DOUBLE AS x, generate_subscripts(embedding, 1) - 1 AS j FROM embeddings)
SELECT vec_id, i::INT AS i, round(sum(((i * 7 + j * 3) % 5 - 2) / 10.0::DOUBLE * x) + i / 100.0::DOUBLE, 5) AS y FROM e, range(64) r(i) GROUP BY vec_id, i"""
SQL["lr_schedule"] = "SELECT range AS step, round(CASE WHEN range < 100 THEN range / 100.0::DOUBLE ELSE greatest(0, (300 - range) / 200.0::DOUBLE) END, 6) AS factor FROM range(401)"

_TERMS = "SELECT {key}, term, count(*) AS tf FROM (SELECT {key}, unnest(regexp_split_to_array(lower({text}), '[ \\n\\t]+')) AS term FROM {table}) WHERE term <> '' GROUP BY 1, 2"
SQL["tf_idf"] = f"""WITH t AS ({_TERMS.format(key='item_id', text='text', table='eval_items')}), d AS (SELECT term, count(*) AS df FROM t GROUP BY 1), n AS (SELECT count(*) AS n FROM eval_items WHERE text IS NOT NULL),
w AS (SELECT item_id, t.term, tf * (ln((1.0::DOUBLE + n) / (1 + df)) + 1) AS w FROM t JOIN d ON t.term = d.term, n)
SELECT item_id, term, round(w / sqrt(sum(w * w) OVER (PARTITION BY item_id)), 6) AS weight FROM w"""
SQL["bm25_topk"] = f"""WITH t AS ({_TERMS.format(key='doc_id', text='text', table="documents WHERE text <> ''")}), z AS (SELECT doc_id, sum(tf)::DOUBLE AS size FROM t GROUP BY 1), m AS (SELECT count(*)::DOUBLE AS n, avg(size) AS a FROM z),
d AS (SELECT term, count(*)::DOUBLE AS df FROM t GROUP BY 1),
q AS (SELECT DISTINCT item_id AS query_id, unnest(regexp_split_to_array(lower(question), '[ \\n\\t]+')) AS term FROM eval_items WHERE item_id % 50 = 0),
s AS (SELECT query_id, t.doc_id, round(sum(ln(1 + (n - df + 0.5) / (df + 0.5)) * tf * 2.5 / (tf + 1.5 * (0.25 + 0.75 * size / a))), 6) AS score FROM q JOIN t ON q.term = t.term JOIN d ON d.term = t.term JOIN z ON z.doc_id = t.doc_id, m GROUP BY 1, 2)
SELECT query_id, doc_id, round(score, 4) AS score, rank FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, doc_id)::INT AS rank FROM s) WHERE rank <= 10"""
SQL["stream_windows"] = """SELECT time_bucket(INTERVAL 1 HOUR, ts) AS window_start, event_type, count(*) AS n, round(sum(value), 4) AS total FROM events
GROUP BY 1, 2 HAVING time_bucket(INTERVAL 1 HOUR, ts) + INTERVAL 1 HOUR <= (SELECT max(ts) - INTERVAL 10 MINUTE FROM events)"""
