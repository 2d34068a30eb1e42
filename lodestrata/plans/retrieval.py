"""Queries over rankings: lexical, dense, fused, explained, reranked, compared and scored."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lodestrata.functions.text import BELIEF, CROSS_MODAL_CUES, FIGURE, MEASURES, NOISE_WORDS, QUANTITY, REPORTED, STOPWORDS, WHY, analysts, jaccard, pair_key, report_words, route, text_key
from lodestrata.operators import metrics, retrieval, sections
from lodestrata.session import cut, spread, table


def _rounded(df: DataFrame, *columns: str) -> DataFrame:
    return df.withColumns({c: F.round(c, 6) for c in columns})


def _reports(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "reports").select(F.col("id").alias("doc_id"), F.col("description").alias("text"), F.col("text_embedding").alias("v"))


def _asked(corpus: DataFrame) -> DataFrame:
    """Every row whose id is divisible by 50 is a question to all rows."""
    return corpus.filter("doc_id % 50 = 0").withColumnRenamed("doc_id", "query_id")


def _lexical(spark: SparkSession, d: str, k: int = retrieval.CANDIDATES) -> DataFrame:
    corpus = _reports(spark, d).select("doc_id", "text")
    return retrieval.bm25(_asked(corpus), corpus, k)


def _dense(spark: SparkSession, d: str, k: int = retrieval.CANDIDATES) -> DataFrame:
    corpus = _reports(spark, d).select("doc_id", "v").filter("size(v) = 384 and exists(v, x -> x <> 0)")
    return retrieval.dense(_asked(corpus), corpus, k)


def bm25_captions(spark: SparkSession, d: str) -> DataFrame:
    """The ten chunks nearest in words to every fiftieth table's caption."""
    questions = table(spark, d, "fin_tables").filter("id % 50 = 0").select(F.col("id").alias("query_id"), F.col("caption").alias("text"))
    corpus = table(spark, d, "chunks").select(F.col("id").alias("doc_id"), F.col("content").alias("text"))
    return _rounded(retrieval.bm25(questions, corpus), "score")


def bm25_captions_scoped(spark: SparkSession, d: str) -> DataFrame:
    """The same within the caption's own issuer: both sides get it from their filing."""
    issuer = table(spark, d, "filings").select(F.col("id").alias("document_id"), "cik")
    questions = table(spark, d, "fin_tables").filter("id % 50 = 0").join(issuer, "document_id").select(F.col("id").alias("query_id"), F.col("caption").alias("text"), "cik")
    corpus = table(spark, d, "chunks").join(issuer, "document_id", "left").select(F.col("id").alias("doc_id"), F.col("content").alias("text"), "cik")
    return _rounded(retrieval.bm25(questions, corpus, scope="cik"), "score")


def dense_scoped(spark: SparkSession, d: str) -> DataFrame:
    """The ten reports of a report's own source that are nearest to it."""
    corpus = table(spark, d, "reports").select(F.col("id").alias("doc_id"), "source", F.col("text_embedding").alias("v")).filter("size(v) = 384")
    return _rounded(retrieval.dense(_asked(corpus), corpus, scope="source"), "score")


def indexed_only(spark: SparkSession, d: str) -> DataFrame:
    """The lexical ranking without reports that the dense index lacks."""
    return _rounded(retrieval.known_only(_lexical(spark, d, 10), _reports(spark, d).filter("size(v) = 384 and exists(v, x -> x <> 0)")), "score")


def texts_to_encode(spark: SparkSession, d: str) -> DataFrame:
    """Distinct texts of captions and chunks."""
    return retrieval.texts_to_encode(table(spark, d, "fin_tables").select(F.col("caption").alias("text")), table(spark, d, "chunks").select(F.col("content").alias("text")))


def dense_reports(spark: SparkSession, d: str) -> DataFrame:
    return _rounded(_dense(spark, d, 10), "score")


def hybrid_reports(spark: SparkSession, d: str) -> DataFrame:
    return _rounded(retrieval.hybrid(_lexical(spark, d), _dense(spark, d), 10), "score")


def hybrid_explained(spark: SparkSession, d: str) -> DataFrame:
    return _rounded(retrieval.explain_hybrid(_lexical(spark, d), _dense(spark, d)), "score")


def reranked_reports(spark: SparkSession, d: str) -> DataFrame:
    """The fused shortlist in the order of shared words."""
    return _rounded(_reranked(spark, d, _lexical(spark, d), _dense(spark, d)), "score")


def _reranked(spark: SparkSession, d: str, lexical: DataFrame, semantic: DataFrame) -> DataFrame:
    short = cut(retrieval.hybrid(lexical, semantic, retrieval.SHORTLIST))
    words = _reports(spark, d).select("doc_id", report_words(F.col("text")).alias("w"))
    pairs = short.join(words, "doc_id").join(words.withColumnsRenamed({"doc_id": "query_id", "w": "qw"}), "query_id")
    scores = pairs.select("query_id", "doc_id", jaccard(F.col("w"), F.col("qw")).alias("score"))
    return retrieval.rerank(short, scores)


def arm_parity(spark: SparkSession, d: str) -> DataFrame:
    return _rounded(retrieval.parity(_lexical(spark, d), _dense(spark, d)), "overlap", "displacement")


def retrieval_quality(spark: SparkSession, d: str) -> DataFrame:
    """How well fusion finds the reports that a matcher accepted as the question's own."""
    gold = _gold(spark, d)
    return _rounded(metrics.ranking_quality(gold, retrieval.hybrid(_lexical(spark, d), _dense(spark, d), 10)), "recall", "precision", "rr", "ndcg")


def _gold(spark: SparkSession, d: str) -> DataFrame:
    """Accepted matches of every fiftieth report, as its relevant documents."""
    key = lambda c: F.lower(F.trim(c))
    ids = table(spark, d, "reports").select(key("point_id").alias("p"), "id")
    m = table(spark, d, "report_matches").select(F.explode(F.array(*[F.struct(key(x).alias("p"), key(y).alias("q")) for x, y in (("point_a", "point_b"), ("point_b", "point_a"))])).alias("m")).select("m.*").distinct()
    return m.join(ids.filter("id % 50 = 0").withColumnRenamed("id", "query_id"), "p").select("query_id", F.col("q").alias("p")).join(ids.withColumnRenamed("id", "doc_id"), "p").filter("query_id <> doc_id").select("query_id", "doc_id")


def stage_diagnosis(spark: SparkSession, d: str) -> DataFrame:
    """What words, fusion and reranking do for each question."""
    lexical, semantic = cut(_lexical(spark, d)), cut(_dense(spark, d))
    out = metrics.stage_diagnosis(_gold(spark, d), {"bm25": lexical, "hybrid": retrieval.hybrid(lexical, semantic, 10), "reranked": _reranked(spark, d, lexical, semantic)})
    return _rounded(out, "bm25", "hybrid", "reranked", "delta")


def scored_arms(spark: SparkSession, d: str) -> DataFrame:
    """Quality of both arms and of their fusion over the same questions."""
    lexical, semantic = cut(_lexical(spark, d)), cut(_dense(spark, d))
    return _rounded(metrics.scored_comparison(_gold(spark, d), {"lexical": lexical, "dense": semantic, "fused": retrieval.hybrid(lexical, semantic, 10)}), "value")


def arm_report(spark: SparkSession, d: str) -> DataFrame:
    """How far each arm's ranking agrees with the fused one, over all questions."""
    lexical, semantic = cut(_lexical(spark, d)), cut(_dense(spark, d))
    fused, asked = cut(retrieval.hybrid(lexical, semantic, 10)), _asked(_reports(spark, d)).select("query_id")
    out = metrics.arm_report({"lexical": retrieval.parity(lexical, fused, questions=asked), "dense": retrieval.parity(semantic, fused, questions=asked)})
    return _rounded(out, "exact_order", "top1_agreement", "overlap", "displacement")


def routing_report(spark: SparkSession, d: str) -> DataFrame:
    """Routes of chunks against those that the kind of their filing implies."""
    kinds = F.create_map(F.lit("deck"), F.array(F.lit("numeric")), F.lit("filing"), F.array(F.lit("numeric"), F.lit("cross-modal")), F.lit("transcript"), F.array(F.lit("narrative")))
    filed = table(spark, d, "filings").select(F.col("id").alias("document_id"), metrics.expected_route(F.try_element_at(kinds, F.col("kind"))).alias("expected"))
    routed = table(spark, d, "chunks").filter("content is not null").select("document_id", route(F.col("content")).alias("route")).join(filed, "document_id")
    return _rounded(metrics.routing_report(routed), "value")


def routing_heldout(spark: SparkSession, d: str) -> DataFrame:
    """Routes of questions to tables, all of which are numeric."""
    asked = table(spark, d, "table_cells").filter("not is_header and row_label is not null").select(route(F.concat(F.lit("What was "), "row_label", F.lit("?"))).alias("route"))
    return _rounded(metrics.heldout_report(asked), "value")


def section_chunks(spark: SparkSession, d: str) -> DataFrame:
    return sections.chunk_texts(spread(table(spark, d, "documents").select("doc_id", "text")))


def question_routes(spark: SparkSession, d: str) -> DataFrame:
    """Route and analysts of every chunk read as a question."""
    routed = table(spark, d, "chunks").filter("content is not null").select("id", route(F.col("content")).alias("route"))
    return routed.withColumn("plan", F.array_join(analysts(F.col("route")), ","))


def text_keys(spark: SparkSession, d: str) -> DataFrame:
    """Content keys, and how many documents share each."""
    keyed = table(spark, d, "documents").filter("text is not null").select("doc_id", text_key(F.col("text")).alias("key"))
    return keyed.groupBy("key").agg(F.count("*").alias("documents"), F.min("doc_id").alias("first_id"))


def pair_keys(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "reports").filter("category is not null and description is not null").select("id", pair_key(F.col("category"), F.col("description")).alias("pair_key"))


def index_drift(spark: SparkSession, d: str) -> DataFrame:
    """Reports that the dense index lacks."""
    corpus = _reports(spark, d)
    return retrieval.drift(corpus, corpus.filter("size(v) = 384 and exists(v, x -> x <> 0)"))


QUERIES = {
    "bm25_captions": bm25_captions, "dense_reports": dense_reports, "hybrid_reports": hybrid_reports, "hybrid_explained": hybrid_explained, "reranked_reports": reranked_reports,
    "arm_parity": arm_parity, "retrieval_quality": retrieval_quality, "section_chunks": section_chunks, "question_routes": question_routes, "text_keys": text_keys, "pair_keys": pair_keys,
    "index_drift": index_drift, "bm25_captions_scoped": bm25_captions_scoped, "dense_scoped": dense_scoped, "indexed_only": indexed_only, "texts_to_encode": texts_to_encode,
    "stage_diagnosis": stage_diagnosis, "scored_arms": scored_arms, "arm_report": arm_report, "routing_report": routing_report, "routing_heldout": routing_heldout,
}

_STOP = f"({', '.join(f"'{w}'" for w in STOPWORDS)})"
_NOISE = f"({', '.join(f"'{w}'" for w in NOISE_WORDS)})"


def _bm25(questions: str, corpus: str, k: int, name: str = "lex", scope: str = "") -> str:
    """CTEs that end in `name` (query_id, doc_id, score, rank); `scope` names a column that both sides must share."""
    within, using = (f", {scope}", f"(term, {scope})") if scope else ("", "(term)")
    terms = r"list_filter(regexp_extract_all(lower(coalesce(text, '')), '[a-z0-9]+(?:[.,][0-9]+)*'), lambda t: t not in " + _STOP + ")"
    return f"""
q0 as ({questions}), c0 as ({corpus}),
qt as (select query_id{within}, term, count(*) as qtf from (select query_id{within}, unnest({terms}) as term from q0) group by all),
ct as (select doc_id{within}, {terms} as t from c0),
st as (select count(*)::double as n, avg(len(t)) as avgdl from ct),
po as (select doc_id{within}, term, dl, count(*) as tf from (select doc_id{within}, len(t) as dl, unnest(t) as term from ct) group by all),
df as (select term, count(*) as df from po group by term),
sc as (select query_id, doc_id, sum(qtf * ln(1 + (n - df + 0.5) / (df + 0.5)) * tf * 2.5 / (tf + 1.5 * (0.25 + 0.75 * dl / avgdl))) as score
       from qt join po using {using} join df using (term), st group by all),
{name} as (select * from (select query_id, doc_id, score, row_number() over (partition by query_id order by round(score, 9) desc, doc_id) as rank from sc) where rank <= {k})"""


_REPORTS_Q = "select id as query_id, description as text from reports where id % 50 = 0"
_REPORTS_C = "select id as doc_id, description as text from reports"


def _cosine(k: int) -> str:
    return f"""
vv as (select id as doc_id, text_embedding::double[] as v from reports where len(text_embedding) = 384 and len(list_filter(text_embedding, lambda x: x <> 0)) > 0),
den as (select * from (select query_id, doc_id, score, row_number() over (partition by query_id order by round(score, 9) desc, doc_id) as rank
  from (select q.doc_id as query_id, c.doc_id, list_cosine_similarity(q.v, c.v) as score from vv q, vv c where q.doc_id % 50 = 0)) where rank <= {k})"""


_ARMS = f"with {_bm25(_REPORTS_Q, _REPORTS_C, 40)}, {_cosine(40)}"


def _fused(k: int) -> str:
    return f"""
fu as (select * from (select query_id, doc_id, score, row_number() over (partition by query_id order by round(score, 9) desc, doc_id) as rank
  from (select query_id, doc_id, sum(1.0 / (60 + rank)) as score from (select query_id, doc_id, rank from lex union all select query_id, doc_id, rank from den) group by all)) where rank <= {k})"""


_SPACE = r"[\t-\r \x{85}\x{a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}]+"
_WORDS = "list_distinct(list_filter(regexp_extract_all(lower(coalesce(description, '')), '[a-z0-9]+'), lambda t: t not in " + _NOISE + "))"

def _route(text: str) -> str:
    """The route of a question, from the same cues and patterns as the column expression."""
    low = f"lower(trim({text}))"
    holds = lambda words: f"regexp_matches({low}, '{'|'.join(words)}')"
    match = lambda pattern: f"regexp_matches({text}, '{pattern}')"
    return f"""case when {match(BELIEF)} or {holds(CROSS_MODAL_CUES)} then 'cross_modal' when {match(WHY)} or {match(REPORTED)} then 'narrative' when {match(QUANTITY)} then 'numeric'
  when regexp_matches({low}, '^what\\b') and {holds(MEASURES)} then 'numeric' when {match(FIGURE)} then 'numeric' else 'narrative' end"""


_RERANKED = f"""w as (select id, {_WORDS} as w from reports),
ps as (select query_id, doc_id, rank as before, case when len(a.w) > 0 and len(b.w) > 0 then len(list_intersect(a.w, b.w)) / len(list_distinct(list_concat(a.w, b.w))) else 0.0 end as score
  from fu join w a on a.id = query_id join w b on b.id = doc_id),
rr as (select query_id, doc_id, before, score, row_number() over (partition by query_id order by round(score, 9) desc, doc_id) as rank from ps)"""
_GOLD = """
mm as (select lower(trim(point_a)) as p, lower(trim(point_b)) as q from report_matches union select lower(trim(point_b)), lower(trim(point_a)) from report_matches),
g as (select distinct x.id as query_id, y.id as doc_id from mm join reports x on lower(trim(x.point_id)) = p join reports y on lower(trim(y.point_id)) = q where x.id % 50 = 0 and x.id <> y.id),
ng as (select query_id, count(*) as n from g group by 1)"""


def _graded(name: str, ranking: str) -> str:
    """A CTE `name` (query_id, ndcg, recall) at 10 of a ranking against g."""
    ideal = "list_sum(list_transform(range(1, least(n, 10) + 1), lambda i: 1 / log2(i + 1)))"
    return f"""{name} as (select query_id, coalesce(sum(1 / log2(rank + 1)) filter (rank <= 10), 0) / max({ideal}) as ndcg, count(*) filter (rank <= 10) / max(n) as recall from g join ng using (query_id) left join {ranking} using (query_id, doc_id) group by 1)"""


def _agreement(arm: str, ranking: str) -> str:
    return f"""(select '{arm}' as arm, count(*) as queries, round(avg(exact::int), 6) as exact_order, round(avg(top1::int), 6) as top1_agreement, round(avg(overlap), 6) as overlap, round(avg(displacement), 6) as displacement, count(*) filter (one_empty) as asymmetric_empty
from (select q.id, coalesce(bool_and(coalesce(lr = fr, false)), true) as exact, coalesce(bool_or(coalesce(lr = 1 and fr = 1, false)), false) as top1, coalesce(count(*) filter (lr is not null and fr is not null) / nullif(count(both_id), 0), 1.0) as overlap,
  coalesce(avg(abs(lr - fr)), 0.0) as displacement, (count(lr) = 0) <> (count(fr) = 0) as one_empty
  from (select id from reports where id % 50 = 0) q left join (select coalesce(l.query_id, f.query_id) as qid, coalesce(l.doc_id, f.doc_id) as both_id, l.rank as lr, f.rank as fr from (select * from {ranking} where rank <= 10) l full join fu f on l.query_id = f.query_id and l.doc_id = f.doc_id) on qid = q.id group by 1))"""


SQL = {
    "bm25_captions": f"with {_bm25('select id as query_id, caption as text from fin_tables where id % 50 = 0', 'select id as doc_id, content as text from chunks', 10)} select query_id, doc_id, round(score, 6) as score, rank from lex",
    "bm25_captions_scoped": f"with {_bm25('select t.id as query_id, caption as text, cik from fin_tables t join filings f on f.id = document_id where t.id % 50 = 0', 'select c.id as doc_id, content as text, cik from chunks c left join filings f on f.id = document_id', 10, scope='cik')} select query_id, doc_id, round(score, 6) as score, rank from lex",
    "dense_scoped": """
with vv as (select id as doc_id, source, text_embedding::double[] as v from reports where len(text_embedding) = 384 and source is not null and len(list_filter(text_embedding, lambda x: x <> 0)) > 0 and len(list_filter(text_embedding, lambda x: not isfinite(x))) = 0),
s as (select q.doc_id as query_id, c.doc_id, list_cosine_similarity(q.v, c.v) as score from vv q join vv c using (source) where q.doc_id % 50 = 0),
r as (select *, row_number() over (partition by query_id order by round(score, 9) desc, doc_id) as rank from s)
select query_id, doc_id, round(score, 6) as score, rank from r where rank <= 10""",
    "indexed_only": f"""with {_bm25(_REPORTS_Q, _REPORTS_C, 10)} select query_id, doc_id, round(score, 6) as score, rank from lex
where doc_id in (select id from reports where len(text_embedding) = 384 and len(list_filter(text_embedding, lambda x: x <> 0)) > 0)""",
    "texts_to_encode": f"""select substr(sha256(trim(regexp_replace(text, '{_SPACE}', ' ', 'g'))), 1, 32) as key, min(text) as text
from (select caption as text from fin_tables union all select content from chunks) where text is not null group by 1""",
    "dense_reports": f"with {_cosine(10)} select query_id, doc_id, round(score, 6) as score, rank from den",
    "hybrid_reports": f"{_ARMS}, {_fused(10)} select query_id, doc_id, round(score, 6) as score, rank from fu",
    "hybrid_explained": f"""{_ARMS},
ex as (select coalesce(d.query_id, l.query_id) as query_id, coalesce(d.doc_id, l.doc_id) as doc_id, d.rank as dense_rank, l.rank as bm25_rank,
  coalesce(1.0 / (60 + d.rank), 0) + coalesce(1.0 / (60 + l.rank), 0) as score,
  case when l.rank is null then 'dense' when d.rank is null then 'bm25' end as found_only_by
  from den d full join lex l on d.query_id = l.query_id and d.doc_id = l.doc_id)
select * from (select query_id, doc_id, dense_rank, bm25_rank, round(score, 6) as score, found_only_by, row_number() over (partition by query_id order by round(score, 9) desc, doc_id) as rank from ex) where rank <= 10""",
    "reranked_reports": f"""{_ARMS}, {_fused(25)}, {_RERANKED}
select query_id, doc_id, before, round(score, 6) as score, rank, before - rank as moved from rr where rank <= 10""",
    "arm_parity": f"""{_ARMS}, l as (select * from lex where rank <= 10), r as (select * from den where rank <= 10),
b as (select coalesce(l.query_id, r.query_id) as query_id, l.rank as lr, r.rank as rr from l full join r on l.query_id = r.query_id and l.doc_id = r.doc_id)
select query_id, bool_and(coalesce(lr = rr, false)) as exact_order, bool_or(coalesce(lr = 1 and rr = 1, false)) as top1,
  round(count(*) filter (lr is not null and rr is not null) / count(*), 6) as overlap, round(coalesce(avg(abs(lr - rr)), 0.0), 6) as displacement,
  (count(lr) = 0) <> (count(rr) = 0) as one_empty from b group by query_id""",
    "retrieval_quality": f"""{_ARMS}, {_fused(10)},
mm as (select lower(trim(point_a)) as p, lower(trim(point_b)) as q from report_matches union select lower(trim(point_b)), lower(trim(point_a)) from report_matches),
g as (select x.id as query_id, y.id as doc_id, row_number() over (partition by x.id order by y.id) as place from mm join reports x on lower(trim(x.point_id)) = p join reports y on lower(trim(y.point_id)) = q where x.id % 50 = 0 and x.id <> y.id),
h as (select g.*, rank from g left join fu using (query_id, doc_id))
select query_id, round(count(rank) / count(*), 6) as recall, round(count(rank) / 10, 6) as precision, round(coalesce(1 / min(rank), 0.0), 6) as rr,
  round(coalesce(sum(1 / log2(rank + 1)), 0.0) / sum(case when place <= 10 then 1 / log2(place + 1) else 0 end), 6) as ndcg from h group by query_id""",
    "question_routes": f"""
select id, route, case route when 'numeric' then 'table_analyst' when 'cross_modal' then 'table_analyst,narrative_analyst' else 'narrative_analyst' end as plan
from (select id, {_route('content')} as route from chunks where content is not null)""",
    "routing_report": f"""
with r as (select {_route('content')} as route, case kind when 'filing' then 'cross_modal' when 'deck' then 'numeric' else 'narrative' end as expected from chunks c join filings f on f.id = c.document_id where content is not null),
t as (select count(*) as n, avg((route = expected)::int) as observed from r),
m as (select l, count(*) filter (s = 0) as na, count(*) filter (s = 1) as nb from (select route as l, 0 as s from r union all select expected, 1 from r) group by 1),
e as (select sum(na * nb) as x from m)
select 'accuracy' as metric, round(observed, 6) as value from t union all select 'kappa', round(case when x = n * n then 1.0 else (observed - x / (n * n)) / (1 - x / (n * n)) end, 6) from t, e
union all select 'recall.' || expected, round(avg((route = expected)::int), 6) from r group by expected""",
    "routing_heldout": f"""
with r as (select {_route("('What was ' || row_label || '?')")} as route from table_cells where not is_header and row_label is not null)
select 'accuracy' as metric, round(avg((route = 'numeric')::int), 6) as value from r union all select 'leaked_to_narrative', round(avg((route = 'narrative')::int), 6) from r""",
    "stage_diagnosis": f"""{_ARMS}, {_fused(25)}, {_RERANKED}, {_GOLD}, {_graded('gl', 'lex')}, {_graded('gh', 'fu')}, {_graded('gr', '(select query_id, doc_id, rank from rr where rank <= 10) rx')}
select query_id, round(gl.ndcg, 6) as bm25, round(gh.ndcg, 6) as hybrid, round(gr.ndcg, 6) as reranked, round(gr.ndcg - gl.ndcg, 6) as delta from gl join gh using (query_id) join gr using (query_id)""",
    "scored_arms": f"""{_ARMS}, {_fused(10)}, {_GOLD}, {_graded('gl', 'lex')}, {_graded('gd', 'den')}, {_graded('gh', 'fu')}
{' union all '.join(f"select '{n}.{m}@10' as metric, round(avg({m}), 6) as value from {g}" for n, g in (('lexical', 'gl'), ('dense', 'gd'), ('fused', 'gh')) for m in ('ndcg', 'recall'))}""",
    "arm_report": f"""{_ARMS}, {_fused(10)} {_agreement('lexical', 'lex')} union all {_agreement('dense', 'den')}""",
    "text_keys": f"select key, count(*) as documents, min(doc_id) as first_id from (select doc_id, substr(sha256(trim(regexp_replace(text, '{_SPACE}', ' ', 'g'))), 1, 32) as key from documents where text is not null) group by key",
    "pair_keys": f"select id, substr(sha256(trim(regexp_replace(category, '{_SPACE}', ' ', 'g')) || chr(0) || trim(regexp_replace(description, '{_SPACE}', ' ', 'g'))), 1, 32) as pair_key from reports where category is not null and description is not null",
    "index_drift": "select id as doc_id from reports where not coalesce(len(text_embedding) = 384 and len(list_filter(text_embedding, lambda x: x <> 0)) > 0, false)",
}
