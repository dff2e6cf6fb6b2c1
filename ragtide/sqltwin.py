"""DuckDB SQL twins of the registered queries (the correctness oracle).

Each string is an independent formulation of the same semantics over the
pre-registered views (documents, benchmark, embeddings, conversations,
labels, events): e.g. the kNN twin scores sparse hashed vectors joined on
bucket instead of multiplying dense blocks, and list lambdas replace Spark's
higher-order functions. Fixed strings and values are stated here again, so a wrong one in
``ragtide.config`` does not pass on both sides.
"""

from __future__ import annotations

import re

# Fixed values (must equal the original application's strings and parameters).
PASSAGE = "Luật: {law}\nĐiều {article}: {title}\nPhần {part}/{total}:\n{chunk}"
REWRITE_PROMPT = (
    "\n    ### Instruction:\n    Rewrite the given query into three different variations.\n\n"
    "    ### Input Query:\n    {query}\n\n    ### Rewritten Queries:\n    "
)
CONTEXT_BLOCK = "Document (Relevance Score: {score}):\n{doc}"
BETWEEN_DOCUMENTS = "\n\n=== Next Document ===\n\n"
ANSWER_PROMPT = (
    "Hãy trả lời câu hỏi dựa trên các thông tin pháp luật sau đây một cách rõ ràng và chính xác.\n\n"
    "        Thông tin pháp luật:\n        {context}\n\n        Câu hỏi: {query}\n\n"
    "        Trả lời dựa trên các điều luật trên:\n        "
)
ROUTES = "('1', 'gpt2', 1, 1), ('2', 'llama', 4, 4)"
# White space as Python's str.isspace() has it.
WS_CLASS = r"[\t\n\x0b\x0c\r\x1c-\x20\x85\xa0\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}]"


def lit(s: str) -> str:
    return "'" + s.replace("'", "''") + "'"


def dbl(x: float) -> str:
    return f"CAST({x!r} AS DOUBLE)"


def render(template: str, **fields: str) -> str:
    parts = []
    for i, p in enumerate(re.split(r"\{(\w+)\}", template)):
        if i % 2:
            parts.append(f"coalesce(CAST({fields[p]} AS VARCHAR), 'None')")
        elif p:
            parts.append(lit(p))
    return "(" + " || ".join(parts) + ")"


def strip(x: str) -> str:
    return f"regexp_replace({x}, '^{WS_CLASS}+|{WS_CLASS}+$', '', 'g')"


def tokens(x: str) -> str:
    return f"regexp_extract_all(lower({x}), '[\\p{{L}}\\p{{N}}]+')"


def bucket(tok: str) -> str:
    return f"CAST(CAST(('0x' || substr(md5({tok}), 1, 8)) AS BIGINT) % 384 AS INTEGER)"


def words(x: str) -> str:
    return f"list_filter(regexp_split_to_array({x}, '{WS_CLASS}+'), lambda w: length(w) > 0)"


def format_plain(law="law", article="article", title="title", content="chunk_content") -> str:
    return (f"('Luật: ' || coalesce({law}, 'None') || chr(10) || 'Điều ' || "
            f"coalesce({article}, 'None') || ': ' || coalesce({title}, 'None') || chr(10) || "
            f"'Nội dung: ' || coalesce({content}, ''))")


def format_rerank(law="law", article="article", title="title", content="chunk_content") -> str:
    c = f"coalesce({content}, '')"
    cut = (f"(CASE WHEN length({c}) > 800 THEN substr({c}, 1, 797) || "
           f"'...' ELSE {c} END)")
    return (f"(coalesce({law}, 'None') || chr(10) || coalesce({article}, '') || ': ' || coalesce({title}, '') || "
            f"chr(10) || 'Nội dung: ' || {cut})")


# ---------------------------------------------------------------------------
# shared CTEs
# ---------------------------------------------------------------------------

ARTICLES = """articles AS (
  SELECT doc_id AS doc_key, source AS law, CAST(doc_id AS VARCHAR) AS article, lang AS title, text AS content
  FROM documents)"""

CHUNKS = f"""lines AS (
  SELECT a.doc_key, a.law, a.article, a.title, CAST(len(a.parts) AS INTEGER) AS total_chunks,
         CAST(u.i - 1 AS INTEGER) AS chunk_index, a.parts[u.i] AS chunk_content
  FROM (SELECT *, string_split(content, chr(10)) AS parts FROM articles WHERE content IS NOT NULL) a,
       unnest(range(1, len(a.parts) + 1)) u(i)),
chunks AS (
  SELECT *, doc_key * 1048576 + chunk_index AS passage_id,
         sha256(concat_ws(chr(1), coalesce(CAST(doc_key AS VARCHAR), chr(2)), coalesce(law, chr(2)),
                          coalesce(article, chr(2)), coalesce(title, chr(2)), CAST(chunk_index AS VARCHAR),
                          CAST(total_chunks AS VARCHAR), coalesce(chunk_content, chr(2)))) AS content_key,
         {render(PASSAGE, law="law", article="article", title="title", part="chunk_index + 1",
                 total="total_chunks", chunk="chunk_content")} AS passage_text
  FROM lines)"""

PVEC = f"""ptok AS (SELECT passage_id, unnest({tokens('passage_text')}) AS tok FROM chunks),
pcnt AS (SELECT passage_id, {bucket('tok')} AS bucket, CAST(count(*) AS DOUBLE) AS cnt FROM ptok GROUP BY ALL),
pvec AS (SELECT passage_id, bucket,
                CAST(cnt / sqrt(sum(cnt * cnt) OVER (PARTITION BY passage_id)) AS FLOAT) AS w FROM pcnt),
pnorm AS (SELECT passage_id, sqrt(sum(CAST(w AS DOUBLE) * CAST(w AS DOUBLE))) AS n FROM pvec GROUP BY ALL)"""

QUESTIONS = "questions AS (SELECT item_id AS question_id, text AS question FROM benchmark)"


def queries_cte(src: str = "questions") -> str:
    half = "CAST(floor(len(w) / 2) AS BIGINT)"
    return f"""qw AS (SELECT question_id, question, {words('question')} AS w FROM {src}),
rw AS (SELECT question_id, question,
              array_to_string(list_filter(w, lambda x: length(x) > 3), ' ') AS v1,
              array_to_string(w[1:greatest({half}, 1)], ' ') AS v2,
              array_to_string(w[{half} + 1:len(w)], ' ') AS v3 FROM qw),
queries AS (
  SELECT question_id, 0 AS query_ord, question AS query_text FROM rw UNION ALL
  SELECT question_id, 1, v1 FROM rw UNION ALL
  SELECT question_id, 2, v2 FROM rw UNION ALL
  SELECT question_id, 3, v3 FROM rw)"""


QVEC = f"""qtok AS (SELECT question_id, query_ord, unnest({tokens('query_text')}) AS tok FROM queries),
qcnt AS (SELECT question_id, query_ord, {bucket('tok')} AS bucket, CAST(count(*) AS DOUBLE) AS cnt
         FROM qtok GROUP BY ALL),
qvec AS (SELECT question_id, query_ord, bucket,
                CAST(cnt / sqrt(sum(cnt * cnt) OVER (PARTITION BY question_id, query_ord)) AS FLOAT) AS w FROM qcnt),
qnorm AS (SELECT question_id, query_ord, sqrt(sum(CAST(w AS DOUBLE) * CAST(w AS DOUBLE))) AS n FROM qvec GROUP BY ALL),
dots AS (SELECT q.question_id, q.query_ord, p.passage_id, sum(CAST(q.w AS DOUBLE) * CAST(p.w AS DOUBLE)) AS dot
         FROM qvec q JOIN pvec p ON q.bucket = p.bucket GROUP BY ALL),
sims AS (SELECT d.question_id, d.query_ord, d.passage_id, d.dot / (qn.n * pn.n) AS sim
         FROM dots d JOIN qnorm qn USING (question_id, query_ord) JOIN pnorm pn USING (passage_id)),
ranked_hits AS (SELECT *, CAST(row_number() OVER (PARTITION BY question_id, query_ord
                                                  ORDER BY round(sim, 9) DESC, passage_id) AS INTEGER) AS rank
                FROM sims)"""


def pdocs_cte() -> str:
    return f"""pdocs AS (SELECT passage_id, law, article, title, chunk_content, {format_rerank()} AS doc,
                 substr({format_rerank()}, 1, 800) AS scorer_in FROM chunks),
stoks AS (SELECT passage_id, {tokens('scorer_in')} AS t FROM pdocs),
corpus AS (SELECT CAST(count(*) AS DOUBLE) AS n, avg(len(t)) AS avgdl FROM stoks),
vocab AS (SELECT tok AS token, count(*) AS df FROM (SELECT unnest(list_distinct(t)) AS tok FROM stoks) GROUP BY 1)"""


def bm25_cte(name: str, pairs: str, query_col: str) -> str:
    """``name``: pairs + score; pairs keyed by (question_id, query_ord, rank) with scorer_in."""
    k1, b = 1.2, 0.75
    norm = f"({dbl(1 - b)} + {dbl(b)} * dl / c.avgdl)"
    idf = f"ln({dbl(1.0)} + ((c.n - v.df) + {dbl(0.5)}) / (v.df + {dbl(0.5)}))"
    return f"""{name}_terms AS (
  SELECT question_id, query_ord, rank, dl, token, len(list_filter(dt, lambda x: x = token)) AS tf FROM (
    SELECT question_id, query_ord, rank, {tokens('scorer_in')} AS dt, len({tokens('scorer_in')}) AS dl,
           unnest(list_distinct({tokens(query_col)})) AS token FROM {pairs})),
{name}_contrib AS (
  SELECT t.question_id, t.query_ord, t.rank,
         {idf} * CAST(t.tf AS DOUBLE) * {dbl(k1 + 1)} / (CAST(t.tf AS DOUBLE) + {dbl(k1)} * {norm}) AS x
  FROM {name}_terms t JOIN vocab v USING (token), corpus c WHERE t.tf > 0),
{name} AS (
  SELECT p.*, coalesce(s.score, 0.0) AS score FROM {pairs} p LEFT JOIN (
    SELECT question_id, query_ord, rank, sum(x) AS score FROM {name}_contrib GROUP BY ALL) s
  USING (question_id, query_ord, rank))"""


def chain_ctes(depth: int = 10, top_k: int = 4, doc_limit: str = "4",
               questions_src: str = "questions", settings: str | None = None) -> str:
    """articles -> line chunks -> vectors -> hits -> BM25 -> rerank -> dedupe -> fused."""
    top = "top_k" if settings else str(top_k)
    lim = "doc_limit" if settings else doc_limit
    return f"""{ARTICLES},
{CHUNKS},
{PVEC},
{QUESTIONS},
{queries_cte(questions_src)},
{QVEC},
{pdocs_cte()},
hits AS (SELECT * FROM ranked_hits WHERE rank <= {depth}),
pairs AS (SELECT h.question_id, h.query_ord, h.rank, h.passage_id, h.sim, q.query_text, d.doc, d.scorer_in
          FROM hits h JOIN queries q USING (question_id, query_ord) JOIN pdocs d USING (passage_id)),
{bm25_cte('scored', 'pairs', 'query_text')},
reranked AS (SELECT s.*{', st.top_k, st.doc_limit, st.model_kind' if settings else ''},
                    CAST(row_number() OVER (PARTITION BY s.question_id, s.query_ord
                                            ORDER BY round(s.score, 9) DESC, s.rank) AS INTEGER)
                      AS rerank_pos
             FROM scored s{' JOIN ' + settings + ' st USING (question_id)' if settings else ''}),
topk AS (SELECT * FROM reranked WHERE rerank_pos <= {top}),
deduped AS (SELECT * FROM topk QUALIFY row_number() OVER (PARTITION BY question_id, doc
                                                           ORDER BY query_ord, rerank_pos) = 1),
fused_all AS (SELECT *, CAST(row_number() OVER (PARTITION BY question_id
                                                ORDER BY CAST(printf('%.4f', score) AS DOUBLE) DESC, query_ord, rerank_pos) AS INTEGER)
                          AS ctx_rank FROM deduped),
fused AS (SELECT * FROM fused_all WHERE ctx_rank <= {lim})"""




def _knn(filter_sql: str = "") -> str:
    return f"""WITH e AS (SELECT vec_id, label, CAST(embedding AS DOUBLE[]) AS v FROM embeddings),
ok AS (SELECT * FROM e WHERE list_dot_product(v, v) > 0),
s AS (SELECT a.vec_id AS query_id, b.vec_id AS passage_id, b.label, list_cosine_similarity(a.v, b.v) AS sim
      FROM ok a JOIN ok b ON a.vec_id <> b.vec_id {filter_sql}),
r AS (SELECT *, CAST(row_number() OVER (PARTITION BY query_id ORDER BY round(sim, 9) DESC, passage_id)
                     AS INTEGER) AS rank FROM s)"""


def _pairs_cte() -> str:
    return """u AS (SELECT conv_id, CAST(row_number() OVER (PARTITION BY conv_id ORDER BY turn) AS INTEGER) AS item_ord,
                  text AS candidate FROM conversations WHERE role = 'user'),
a AS (SELECT conv_id, CAST(row_number() OVER (PARTITION BY conv_id ORDER BY turn) AS INTEGER) AS item_ord,
             text AS reference FROM conversations WHERE role = 'assistant'),
pairs AS (SELECT u.conv_id, u.item_ord, u.candidate, a.reference FROM u JOIN a USING (conv_id, item_ord))"""


def _ngram_ctes(prefix: str, tok_ref: str, tok_hyp: str, ns: tuple[int, ...]) -> str:
    rng = f"range({min(ns)}, {max(ns) + 1})"
    grams = "list_transform(range(1, len({t}) - n + 2), lambda i: array_to_string({t}[i:i + n - 1], ' '))"
    return f"""{prefix}_tk AS (SELECT conv_id, item_ord, {tok_ref} AS r, {tok_hyp} AS h FROM pairs),
{prefix}_g AS (
  SELECT conv_id, item_ord, n, 1 AS side, unnest({grams.format(t='h')}) AS g FROM {prefix}_tk, {rng} t(n)
  UNION ALL
  SELECT conv_id, item_ord, n, 2 AS side, unnest({grams.format(t='r')}) AS g FROM {prefix}_tk, {rng} t(n)),
{prefix}_c AS (SELECT conv_id, item_ord, n, g, sum(CASE WHEN side = 1 THEN 1 ELSE 0 END) AS hc,
                      sum(CASE WHEN side = 2 THEN 1 ELSE 0 END) AS rc FROM {prefix}_g GROUP BY ALL),
{prefix}_n AS (SELECT conv_id, item_ord, n, sum(least(hc, rc)) AS clip, sum(hc) AS hyp_total, sum(rc) AS ref_total
               FROM {prefix}_c GROUP BY ALL),
{prefix}_p AS (SELECT t.conv_id, t.item_ord, len(t.h) AS hyp_len, len(t.r) AS ref_len,
  {", ".join(f"coalesce(max(CASE WHEN n = {n} THEN clip END), 0) AS clip{n}, "
             f"coalesce(max(CASE WHEN n = {n} THEN hyp_total END), 0) AS hyp_total{n}, "
             f"coalesce(max(CASE WHEN n = {n} THEN ref_total END), 0) AS ref_total{n}" for n in ns)}
  FROM {prefix}_tk t LEFT JOIN {prefix}_n USING (conv_id, item_ord) GROUP BY t.conv_id, t.item_ord, t.h, t.r)"""


def _bleu_ctes() -> str:
    ps = []
    for n in (1, 2, 3, 4):
        num = f"CAST(clip{n} AS DOUBLE)"
        ps.append(f"ln((CASE WHEN clip{n} = 0 THEN {dbl(0.1)} ELSE {num} END) / "
                  f"greatest({dbl(1.0)}, CAST(hyp_total{n} AS DOUBLE)))")
    c, r = "CAST(hyp_len AS DOUBLE)", "CAST(ref_len AS DOUBLE)"
    bp = f"(CASE WHEN {c} > {r} THEN 1.0 WHEN {c} = 0 THEN 0.0 ELSE exp({dbl(1.0)} - {r} / {c}) END)"
    return _ngram_ctes("b", words("reference"), words("candidate"), (1, 2, 3, 4)) + f""",
bleu AS (SELECT conv_id, item_ord,
                CASE WHEN clip1 = 0 THEN 0.0 ELSE {bp} * exp(((({ps[0]}) + ({ps[1]})) + ({ps[2]}) + ({ps[3]})) / 4.0)
                END AS bleu FROM b_p)"""


def rouge_tokens(x: str) -> str:
    return f"list_filter(string_split(regexp_replace(lower({x}), '[^a-z0-9]+', ' ', 'g'), ' '), lambda w: length(w) > 0)"


def _f1(o: str, h: str, r: str) -> str:
    p = f"(CAST({o} AS DOUBLE) / greatest(CAST({h} AS DOUBLE), 1))"
    rr = f"(CAST({o} AS DOUBLE) / greatest(CAST({r} AS DOUBLE), 1))"
    return f"(CASE WHEN {p} + {rr} > 0 THEN 2 * {p} * {rr} / ({p} + {rr}) ELSE 0.0 END)"


def _rouge_ctes() -> str:
    return _ngram_ctes("rg", rouge_tokens("reference"), rouge_tokens("candidate"), (1, 2)) + f""",
rouge AS (SELECT conv_id, item_ord, {_f1('clip1', 'hyp_total1', 'ref_total1')} AS rouge1,
                 {_f1('clip2', 'hyp_total2', 'ref_total2')} AS rouge2 FROM rg_p)"""


def _parse_sql(gen: str) -> str:
    after = f"split_part({gen}, '### Rewritten Queries:', 2)"
    lines = f"list_transform(string_split({strip(after)}, chr(10)), lambda x: {strip('x')})"
    starts = "starts_with(x, '1.') OR starts_with(x, '2.') OR starts_with(x, '3.')"
    kept = f"list_filter({lines}, lambda x: length(x) > 0 AND ({starts}))"
    return f"list_transform({kept}, lambda x: {strip('substr(x, instr(x, ' + lit('.') + ') + 1)')})[1:3]"


def _default_rewrite_text(q: str = "question") -> str:
    half = f"CAST(floor(len({words(q)}) / 2) AS BIGINT)"
    w = words(q)
    v1 = f"array_to_string(list_filter({w}, lambda x: length(x) > 3), ' ')"
    v2 = f"array_to_string(({w})[1:greatest({half}, 1)], ' ')"
    v3 = f"array_to_string(({w})[{half} + 1:len({w})], ' ')"
    return (f"({render(REWRITE_PROMPT, query=q)} || chr(10) || '1. ' || {v1} || chr(10) || '2. ' || {v2} "
            f"|| chr(10) || '3. ' || {v3})")


def _context_ctes() -> str:
    block = render(CONTEXT_BLOCK, score="printf('%.4f', score)", doc="doc")
    return f"""ctx AS (SELECT question_id, count(*) AS n_docs,
                 string_agg({block}, {lit(BETWEEN_DOCUMENTS)} ORDER BY ctx_rank) AS context
          FROM fused GROUP BY question_id),
ctxq AS (SELECT c.*, q.question FROM ctx c JOIN questions q USING (question_id)),
prompts AS (SELECT question_id, question, context,
                   {render(ANSWER_PROMPT, context='context', query='question')} AS prompt FROM ctxq)"""


def _answer_ctes() -> str:
    sents = f"list_filter(list_transform(regexp_split_to_array(context, '[.!?\\n]+'), lambda x: {strip('x')}), " \
            f"lambda x: length(x) > 0)"
    gen_gpt2 = "prompt || ' ' || coalesce(b.best, '')"
    marker = "'Trả lời dựa trên các điều luật trên:'"
    extract = (f"CASE WHEN contains(g.generated, {marker}) THEN {strip(f'split_part(g.generated, {marker}, 2)')} "
               f"ELSE g.generated END")
    return f"""sl AS (SELECT question_id, {sents} AS l FROM prompts),
sents AS (SELECT question_id, unnest(l) AS s, unnest(range(1, len(l) + 1)) AS i FROM sl),
ss AS (SELECT s.question_id, s.s, s.i,
              len(list_intersect(list_distinct({tokens('s.s')}), list_distinct({tokens('p.question')}))) AS hit
       FROM sents s JOIN prompts p USING (question_id)),
best AS (SELECT question_id, s AS best FROM ss QUALIFY row_number() OVER (PARTITION BY question_id
                                                                          ORDER BY hit DESC, i) = 1),
gens AS (SELECT p.question_id, 'gpt2' AS model_kind, {gen_gpt2} AS generated FROM prompts p
         LEFT JOIN best b USING (question_id)
         UNION ALL
         SELECT p.question_id, 'llama', coalesce(b.best, '') FROM prompts p LEFT JOIN best b USING (question_id)),
answers AS (SELECT g.question_id, g.model_kind,
                   CASE WHEN g.model_kind = 'gpt2' THEN {extract} ELSE g.generated END AS answer FROM gens g)"""


def oracle_sql() -> dict[str, str]:
    chain = chain_ctes()
    q: dict[str, str] = {}
    q["knn_exact"] = _knn() + "\nSELECT query_id, passage_id, rank, round(sim, 6) AS sim FROM r WHERE rank <= 10"
    q["knn_blocks"] = q["knn_exact"]
    q["knn_filtered"] = _knn("AND b.label = 3") + \
        "\nSELECT query_id, passage_id, rank, round(sim, 6) AS sim FROM r WHERE rank <= 10"
    q["knn_late_fetch"] = _knn() + \
        "\nSELECT query_id, rank, passage_id, label, round(sim, 6) AS sim FROM r WHERE rank <= 10"
    base = f"WITH {ARTICLES},\n{CHUNKS}\n"
    q["passage_text"] = base + "SELECT passage_id, chunk_index, total_chunks, passage_text FROM chunks"
    q["metadata_pack"] = base + ("SELECT passage_id, law, article, title, chunk_index, total_chunks, "
                                 "CAST(length(chunk_content) AS INTEGER) AS content_len FROM chunks")
    q["content_key"] = base + "SELECT passage_id, content_key FROM chunks"
    q["anti_append"] = base + """, existing AS (SELECT * FROM chunks WHERE doc_key IN (SELECT doc_id FROM labels))
SELECT passage_id, content_key FROM chunks c
WHERE NOT EXISTS (SELECT 1 FROM existing e WHERE e.content_key = c.content_key)
QUALIFY row_number() OVER (PARTITION BY content_key ORDER BY passage_id) = 1"""
    q["reindex_edit"] = base + """, stored AS (
  SELECT doc_key, passage_id, sha256(content_key) AS content_key FROM chunks
  WHERE doc_key IN (SELECT doc_id FROM labels WHERE toxic = 0)
  UNION ALL
  SELECT doc_key, passage_id, content_key FROM chunks WHERE doc_key IN (SELECT doc_id FROM labels WHERE toxic = 1)),
batch AS (SELECT * FROM chunks WHERE doc_key IN (SELECT doc_id FROM labels))
SELECT passage_id, content_key, 'replaced' AS change FROM stored s
WHERE doc_key IN (SELECT doc_key FROM batch) AND content_key NOT IN (SELECT content_key FROM batch)
UNION ALL
SELECT passage_id, content_key, 'added' FROM batch WHERE content_key NOT IN (SELECT content_key FROM stored)"""
    second = f"""WITH articles AS (
  SELECT d.doc_id AS doc_key, d.source AS law, CAST(d.doc_id AS VARCHAR) AS article,
         CASE WHEN l.quality = 1 THEN upper(d.lang) ELSE d.lang END AS title,
         CASE WHEN coalesce(l.quality, 1) <> 0 THEN d.text END AS content
  FROM documents d LEFT JOIN labels l USING (doc_id) WHERE coalesce(l.toxic, 0) <> 1),
{CHUNKS}"""
    q["merge_corpus"] = """SELECT 'documents/' || doc_id || '#0' AS doc_key, source AS law, CAST(doc_id AS VARCHAR) AS article,
       lang AS title, CAST(length(text) AS INTEGER) AS n_chars, '' AS reason FROM documents
UNION ALL
SELECT 'pages/' || page_id, NULL, NULL, NULL, NULL, 'malformed json' FROM pages"""
    q["reindex_removed"] = second + """
SELECT doc_key AS doc_id, title, count(*) AS n_passages, CAST(sum(length(chunk_content)) AS BIGINT) AS n_chars,
       count(*) AS n_ids FROM chunks GROUP BY doc_key, title"""
    q["store_vocab"] = second + f",\n{pdocs_cte()}\n" + \
        "SELECT token, df, n AS n_docs, round(avgdl, 6) AS avgdl FROM vocab, corpus"
    q["entity_count"] = base + "SELECT count(*) AS n_passages FROM chunks"
    q["hashed_embed"] = f"WITH {ARTICLES},\n{CHUNKS},\n{PVEC}\n" + \
        "SELECT passage_id, bucket, round(CAST(w AS DOUBLE), 6) AS weight FROM pvec"
    q["format_plain"] = base + f"SELECT passage_id, {format_plain()} AS doc FROM chunks"
    q["format_rerank"] = base + f"SELECT passage_id, {format_rerank()} AS doc FROM chunks"
    q["score_input"] = base + (f"SELECT passage_id, substr({format_rerank()}, 1, 800) AS scorer_input, "
                               f"CAST(length(substr({format_rerank()}, 1, 800)) AS INTEGER) "
                               f"AS input_len FROM chunks")
    numbered = ("('preamble' || chr(10) || '### Rewritten Queries:' || chr(10) || array_to_string(list_transform("
                "list_filter(string_split(question, ' '), lambda w: length(w) > 0), "
                "lambda w, i: CAST(i AS VARCHAR) || '. ' || w), chr(10)))")
    q["parse_rewrites"] = f"""WITH {QUESTIONS},
src AS (SELECT question_id, 'numbered' AS source, {_parse_sql(numbered)} AS r FROM questions
        UNION ALL
        SELECT question_id, 'default', {_parse_sql(_default_rewrite_text())} FROM questions)
SELECT question_id, source, CAST(unnest(range(0, len(r))) AS INTEGER) AS pos, unnest(r) AS rewrite FROM src"""
    q["expand_queries"] = f"WITH {QUESTIONS},\n{queries_cte()}\nSELECT question_id, query_ord, query_text FROM queries"
    q["bm25_score"] = f"WITH {chain}\nSELECT question_id, query_ord, rank, passage_id, round(score, 6) AS score " \
                      f"FROM scored"
    q["rerank_topk"] = f"WITH {chain}\nSELECT question_id, query_ord, rerank_pos, passage_id, " \
                       f"round(score, 6) AS score FROM topk"
    q["norerank_prefix"] = f"""WITH {chain}
SELECT h.question_id, h.query_ord, h.rank AS rerank_pos, h.passage_id, CAST(1.0 AS DOUBLE) AS score,
       {format_plain('d.law', 'd.article', 'd.title', 'd.chunk_content')} AS doc
FROM hits h JOIN pdocs d USING (passage_id) WHERE h.rank <= 4"""
    q["dedupe_first"] = f"WITH {chain}\nSELECT question_id, query_ord, rerank_pos, passage_id, " \
                        f"round(score, 6) AS score FROM deduped"
    settings = f"""settings AS (
  SELECT q.question_id, cfg.model_kind, cfg.top_k, cfg.doc_limit
  FROM questions q JOIN (VALUES {ROUTES}) cfg(route, model_kind, top_k, doc_limit)
    ON cfg.route = CASE WHEN contains(q.question, chr(10)) THEN '1' ELSE '2' END)"""
    routed = chain_ctes(settings="settings").replace("\nhits AS (", "\n" + settings + ",\nhits AS (", 1)
    q["fuse_limit"] = f"WITH {routed}\nSELECT question_id, model_kind, ctx_rank, passage_id, " \
                      f"round(score, 6) AS score FROM fused"
    ctx = f"WITH {chain},\n{_context_ctes()}\n"
    q["context_concat"] = ctx + "SELECT question_id, n_docs, context FROM ctx"
    q["prompt_build"] = ctx + "SELECT question_id, prompt FROM prompts"
    q["extract_answer"] = f"WITH {chain},\n{_context_ctes()},\n{_answer_ctes()}\n" \
                          "SELECT question_id, model_kind, answer FROM answers"
    q["answer_questions"] = f"WITH {chain},\n{_context_ctes()},\n{_answer_ctes()}\n" \
        "SELECT q.question_id, 'llama' AS model_kind, coalesce(c.n_docs, 0) AS n_docs, " \
        "coalesce(a.answer, '') AS answer FROM questions q LEFT JOIN ctx c USING (question_id) " \
        "LEFT JOIN (SELECT * FROM answers WHERE model_kind = 'llama') a USING (question_id)"
    q["route_requests"] = f"""WITH req AS (
  SELECT event_id, CASE event_type WHEN 'view' THEN '1' WHEN 'click' THEN '2' ELSE event_type END AS choice,
         props AS question FROM events),
st AS (SELECT *, CASE WHEN choice IS NULL OR choice NOT IN ('1', '2')
                      THEN 'rejected'
                      WHEN lower({strip('question')}) = 'exit' THEN 'ended'
                      ELSE 'accepted' END AS status FROM req)
SELECT st.event_id, st.status, coalesce(cfg.model_kind, '') AS model_kind, coalesce(cfg.top_k, 0) AS top_k,
       coalesce(cfg.doc_limit, 0) AS doc_limit
FROM st LEFT JOIN (VALUES {ROUTES}) cfg(route, model_kind, top_k, doc_limit)
  ON st.status = 'accepted' AND st.choice = cfg.route"""
    q["retrieve_fuse"] = f"WITH {chain}\nSELECT question_id, ctx_rank, query_ord, rerank_pos, passage_id, " \
                         f"round(score, 6) AS score, doc FROM fused"
    k = 5
    q["compare_modes"] = f"""WITH {chain},
plain AS (SELECT h.question_id, 'plain' AS method, h.rank AS pos, h.passage_id, round(h.sim, 6) AS score
          FROM ranked_hits h WHERE h.query_ord = 0 AND h.rank <= {k}),
ppairs AS (SELECT h.question_id, h.query_ord, h.rank, h.passage_id, qq.question, d.scorer_in
           FROM ranked_hits h JOIN questions qq USING (question_id) JOIN pdocs d USING (passage_id)
           WHERE h.query_ord > 0 AND h.rank <= {k}),
{bm25_cte('pscored', 'ppairs', 'question')},
pooled AS (SELECT question_id, 'rewrite_rerank' AS method,
                  CAST(row_number() OVER (PARTITION BY question_id ORDER BY round(score, 9) DESC,
                                          query_ord, rank) AS INTEGER) AS pos,
                  passage_id, round(score, 6) AS score FROM pscored QUALIFY pos <= {k})
SELECT * FROM plain UNION ALL SELECT * FROM pooled"""
    q["compare_rewrites"] = q["compare_modes"].replace("SELECT * FROM plain UNION ALL SELECT * FROM pooled", """,
said AS (SELECT question_id, string_agg(query_text, chr(10) ORDER BY query_ord) AS rewrites FROM queries
         WHERE query_ord > 0 GROUP BY question_id)
SELECT question_id, method, pos, passage_id, rewrites
FROM (SELECT * FROM plain UNION ALL SELECT * FROM pooled) JOIN said USING (question_id)""")
    # Requests are the turns of conversations; the routes are in the settings of each.
    asked = """req AS (SELECT row_number() OVER (ORDER BY conv_id, turn) AS question_id, conv_id, turn, text AS question,
               CASE role WHEN 'user' THEN '2' WHEN 'assistant' THEN '1' ELSE role END AS choice FROM conversations),
stat AS (SELECT *, CASE WHEN choice IS NULL OR choice NOT IN ('1', '2') THEN 'rejected'
                        WHEN lower(""" + strip("question") + """) = 'exit' THEN 'ended' ELSE 'accepted' END AS status FROM req),
questions AS (SELECT question_id, question FROM stat WHERE status = 'accepted')"""
    of_route = f"""settings AS (
  SELECT s.question_id, cfg.model_kind, cfg.top_k, cfg.doc_limit
  FROM stat s JOIN (VALUES {ROUTES}) cfg(route, model_kind, top_k, doc_limit) ON cfg.route = s.choice
  WHERE s.status = 'accepted')"""
    said = chain_ctes(settings="settings").replace("\nhits AS (", "\n" + of_route + ",\nhits AS (", 1).replace(
        QUESTIONS, asked)
    said = f"WITH {said},\n{_context_ctes()},\n{_answer_ctes()}\n"
    q["answer_status"] = said + """SELECT s.conv_id, s.turn, s.status, coalesce(st.model_kind, '') AS model_kind,
       coalesce(c.n_docs, 0) AS n_docs, coalesce(a.answer, '') AS answer
FROM stat s LEFT JOIN settings st USING (question_id) LEFT JOIN ctx c USING (question_id)
LEFT JOIN answers a ON a.question_id = s.question_id AND a.model_kind = st.model_kind"""
    # The state is the words of the session's question before, among those of the kind that keeps a state.
    q["answer_sessions"] = said.rstrip() + f""",
carried AS (SELECT s.question_id, lag({tokens('s.question')}) OVER (PARTITION BY s.conv_id ORDER BY s.turn) AS before
            FROM stat s JOIN settings st USING (question_id) WHERE st.model_kind <> 'gpt2'),
hits2 AS (SELECT x.question_id, x.s, x.i, len(list_intersect(list_distinct({tokens('x.s')}),
                 list_distinct(list_concat({tokens('p.question')}, coalesce(k.before, []))))) AS hit
          FROM sents x JOIN prompts p USING (question_id) JOIN carried k USING (question_id)),
best2 AS (SELECT question_id, s AS best FROM hits2 QUALIFY row_number() OVER (PARTITION BY question_id ORDER BY hit DESC, i) = 1)
SELECT s.conv_id, s.turn, s.status, coalesce(st.model_kind, '') AS model_kind,
       CASE WHEN st.model_kind = 'gpt2' THEN coalesce(a.answer, '') ELSE coalesce(b.best, '') END AS answer
FROM stat s LEFT JOIN settings st USING (question_id) LEFT JOIN best2 b USING (question_id)
LEFT JOIN answers a ON a.question_id = s.question_id AND a.model_kind = st.model_kind"""
    q["zip_pairs"] = f"WITH {_pairs_cte()}\nSELECT conv_id, item_ord, candidate, reference FROM pairs"
    q["bleu_pairs"] = f"WITH {_pairs_cte()},\n{_bleu_ctes()}\nSELECT conv_id, item_ord, round(bleu, 6) AS bleu FROM bleu"
    q["rouge_n"] = f"WITH {_pairs_cte()},\n{_rouge_ctes()}\n" \
                   "SELECT conv_id, item_ord, round(rouge1, 6) AS rouge1, round(rouge2, 6) AS rouge2 FROM rouge"
    # Longest common subsequence: row i of the table from row i - 1, then its running maximum.
    q["rouge_l"] = f"""WITH RECURSIVE {_pairs_cte()},
tk AS (SELECT conv_id, item_ord, {rouge_tokens('reference')} AS r, {rouge_tokens('candidate')} AS h FROM pairs),
lcs AS (
  SELECT conv_id, item_ord, r, h, 0 AS i, list_transform(range(len(r) + 1), lambda x: CAST(0 AS BIGINT)) AS best FROM tk
  UNION ALL
  SELECT conv_id, item_ord, r, h, i + 1, list_transform(range(1, len(c) + 1), lambda j: list_max(c[1:j]))
  FROM (SELECT *, list_transform(range(len(r) + 1), lambda j: greatest(best[j + 1],
                    CASE WHEN j > 0 AND r[j] = h[i + 1] THEN best[j] + 1 ELSE 0 END)) AS c
        FROM lcs WHERE i < len(h)))
SELECT conv_id, item_ord, round(CASE WHEN len(h) = 0 OR len(r) = 0 THEN 0.0
         ELSE {_f1('best[len(r) + 1]', 'len(h)', 'len(r)')} END, 6) AS "rougeL"
FROM lcs WHERE i = len(h)"""
    q["metrics_by_model"] = f"""WITH {_pairs_cte()},
{_bleu_ctes()},
{_rouge_ctes()},
models AS (SELECT conv_id, CASE WHEN bool_or(role = 'system') THEN 'with_system' ELSE 'no_system' END AS model
           FROM conversations GROUP BY conv_id),
m AS (SELECT * FROM bleu JOIN rouge USING (conv_id, item_ord) JOIN models USING (conv_id))
SELECT model, round(avg(bleu), 6) AS avg_bleu, round(avg(rouge1), 6) AS avg_rouge1,
       round(avg(rouge2), 6) AS avg_rouge2, count(*) AS n_pairs FROM m WHERE model IS NOT NULL GROUP BY model"""
    q["session_context"] = """WITH t AS (SELECT conv_id, turn, role, text,
                  row_number() OVER (PARTITION BY conv_id ORDER BY turn) AS rn FROM conversations)
SELECT a.conv_id, a.turn, CAST(count(b.rn) AS INTEGER) AS n_history,
       coalesce(string_agg(CASE WHEN b.rn IS NOT NULL THEN coalesce(b.role, '') || ': ' || coalesce(b.text, '') END,
                           chr(10) ORDER BY b.rn), '')
         AS history
FROM t a LEFT JOIN t b ON a.conv_id = b.conv_id AND b.rn < a.rn
GROUP BY a.conv_id, a.turn"""
    q["session_history"] = q["session_context"].replace("GROUP BY", "WHERE a.role = 'user' GROUP BY")
    return q
