"""Batch retrieval: lexical and dense rankings of a corpus for a set of questions, rank fusion, reranking and explanations.

Questions and corpus are DataFrames; a ranking is (query_id, doc_id, score, rank). Only postings of terms that some question holds
are kept. Blocks of questions meet blocks of documents in tasks of bounded size, each of which hands on its k best per question; the plan
is the same for any number of questions, and a term or an issuer that a third of all rows hold is split like any other. With a
`scope`, a column of both sides, a question is put only to the documents of its own scope.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window

from lodestrata.functions.text import terms, text_key

#: Saturation and length weight of BM25, the fusion constant, candidates per arm, and the shortlist for reranking.
K1, B = 1.5, 0.75
FUSION_K = 60
CANDIDATES = 40
SHORTLIST = 25
#: Questions and documents that meet in one task.
QUESTIONS, DOCUMENTS = 1024, 16_384


def ranked(scores: DataFrame, k: int, by: str = "query_id", score: str = "score", tie: str = "doc_id", decimals: int = 9) -> DataFrame:
    """The k best rows per query with their rank, score descending, ties to the smaller id. Scores are compared rounded, so that the
    order of a sum doesn't decide."""
    order = Window.partitionBy(by).orderBy(F.desc(F.round(score, decimals)), tie)
    return scores.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= k)


def postings(corpus: DataFrame) -> DataFrame:
    """doc_id, term, tf, dl: term frequencies and document length in terms. Null and termless texts give none."""
    each = corpus.select("doc_id", terms(F.col("text")).alias("t")).select("doc_id", F.size("t").alias("dl"), F.explode("t").alias("term"))
    return each.groupBy("doc_id", "term").agg(F.count("*").cast("int").alias("tf"), F.first("dl").alias("dl"))


def _meeting(asked: DataFrame, rows: DataFrame, questions: DataFrame, corpus: DataFrame, scope: str | None) -> tuple[DataFrame, DataFrame]:
    """Both sides with sb (scope), qb and db (blocks): every question's rows once per document block of its scope, every document's once
    per question block. questions and corpus tell the numbers, one row each per question and document."""
    qhash, dhash = F.xxhash64("query_id"), F.xxhash64("doc_id")
    if scope is None:
        nq, nd = (F.lit(max(1, -(-df.count() // size))) for df, size in ((questions, QUESTIONS), (corpus, DOCUMENTS)))
        q, d = asked.withColumn("sb", F.lit(0).cast("bigint")), rows.withColumn("sb", F.lit(0).cast("bigint"))
    else:
        # hashes of scopes may meet by chance: tasks compare the scopes themselves
        count = lambda df, size, n: df.filter(F.col(scope).isNotNull()).groupBy(F.xxhash64(scope).alias("sb")).agg(F.ceil(F.count("*") / size).cast("int").alias(n))
        grid = count(questions, QUESTIONS, "_nq").join(count(corpus, DOCUMENTS, "_nd"), "sb")  # one row a scope
        q, d = (df.withColumn("sb", F.xxhash64(scope)).filter(F.col(scope).isNotNull()).join(grid, "sb") for df in (asked, rows))
        nq, nd = F.col("_nq"), F.col("_nd")
    q = q.withColumns({"qb": F.pmod(qhash, nq).cast("int"), "db": F.explode(F.sequence(F.lit(0), nd.cast("int") - 1))})
    d = d.withColumns({"db": F.pmod(dhash, nd).cast("int"), "qb": F.explode(F.sequence(F.lit(0), nq.cast("int") - 1))})
    return q.drop("_nq", "_nd"), d.drop("_nq", "_nd")


def _best(scores: np.ndarray, names: np.ndarray, ids: np.ndarray, k: int) -> pd.DataFrame:
    """query_id, doc_id, score of the k best columns of every row, ties to the smaller id; -inf is no score."""
    n = scores.shape[1]
    least = np.partition(scores, n - k, axis=1)[:, n - k] if n > k else np.full(len(scores), -np.inf)
    i, j = np.nonzero((scores >= least[:, None]) & (scores > -np.inf))
    pdf = pd.DataFrame({"at": i, "query_id": names[i], "doc_id": ids[j], "score": scores[i, j]})
    pdf = pdf.sort_values(["at", "score", "doc_id"], ascending=[True, False, True], kind="stable")
    return pdf[pdf.groupby("at").cumcount() < k].drop(columns="at")


def _ranking_schema(questions: DataFrame, corpus: DataFrame) -> T.StructType:
    return T.StructType([T.StructField("query_id", questions.schema["query_id"].dataType), T.StructField("doc_id", corpus.schema["doc_id"].dataType), T.StructField("score", T.DoubleType())])


def bm25(questions: DataFrame, corpus: DataFrame, k: int = 10, k1: float = K1, b: float = B, scope: str | None = None) -> DataFrame:
    """query_id, doc_id, score, rank by BM25.

    A term counts as often as the question repeats it. Documents without a shared term are not ranked. Documents with null texts
    count in the number of documents with length 0; an empty corpus gives no rows. Term statistics are those of the whole corpus, also with
    a scope; a null scope matches nothing. Rows of one query_id are one question, rows of one doc_id one document.
    """
    within = [scope] if scope else []
    asked = questions.select("query_id", *within, F.explode(terms(F.col("text"))).alias("term")).groupBy("query_id", *within, "term").agg(F.count("*").alias("qtf"))
    wanted = asked.select("term").distinct()
    lengths = corpus.select(F.size(terms(F.col("text"))).alias("dl"))
    stats = lengths.agg(F.count("*").cast("double").alias("n"), F.avg("dl").alias("avgdl"))  # one row
    # terms nobody asks for are dropped before they are counted
    found = corpus.select("doc_id", *within, terms(F.col("text")).alias("t")).select("doc_id", *within, F.size("t").alias("dl"), F.explode("t").alias("term"))
    found = found.join(wanted, "term", "left_semi").groupBy("doc_id", *within, "term", "dl").agg(F.count("*").alias("tf"))
    df = found.groupBy("term").agg(F.count("*").alias("df"))
    weights = asked.join(df, "term").crossJoin(F.broadcast(stats))
    idf = F.log(1 + (F.col("n") - F.col("df") + 0.5) / (F.col("df") + 0.5))
    weights = weights.select("query_id", *within, "term", (idf * F.col("qtf")).alias("weight"))
    hits = found.crossJoin(F.broadcast(stats))
    saturation = F.col("tf") * (k1 + 1) / (F.col("tf") + k1 * (1 - b + b * F.when(F.col("avgdl") > 0, F.col("dl") / F.col("avgdl")).otherwise(1.0)))
    hits = hits.select("doc_id", *within, "term", saturation.alias("weight"))
    q, d = _meeting(weights, hits, questions, corpus, scope)
    sides = q.withColumn("side", F.lit(0)).unionByName(d.withColumn("side", F.lit(1)), allowMissingColumns=True)
    schema = _ranking_schema(questions, corpus)

    def meet(pdf: pd.DataFrame) -> pd.DataFrame:
        q, d = pdf[pdf.side == 0], pdf[pdf.side == 1]
        if q.empty or d.empty:
            return pd.DataFrame({"query_id": pdf.query_id.iloc[:0], "doc_id": pdf.doc_id.iloc[:0], "score": np.empty(0)})
        qi, names = pd.factorize(q.query_id)
        di, ids = pd.factorize(d.doc_id)
        scores = np.full((len(names), len(ids)), 0.0)
        seen = np.zeros(scores.shape, bool)
        qw, dw = q.weight.to_numpy(), d.weight.to_numpy()
        mine = q.groupby("term", sort=False).indices
        for term, there in d.groupby("term", sort=False).indices.items():
            if term in mine:
                here = np.ix_(qi[mine[term]], di[there])
                scores[here] += qw[mine[term]][:, None] * dw[there][None, :]
                seen[here] = True
        if scope:
            seen &= _of_rows(q[scope], qi)[:, None] == _of_rows(d[scope], di)[None, :]
        scores[~seen] = -np.inf
        return _best(np.round(scores, 9), np.asarray(names), np.asarray(ids), k)

    # sums of another order may differ in the last digits; candidates are cut as they are ranked, rounded
    return ranked(sides.groupBy("sb", "qb", "db").applyInPandas(meet, schema), k)


def _of_rows(values: pd.Series, codes: np.ndarray) -> np.ndarray:
    """The value of every code's first row."""
    return values.to_numpy()[np.unique(codes, return_index=True)[1]]


def dense(questions: DataFrame, corpus: DataFrame, k: int = 10, scope: str | None = None) -> DataFrame:
    """query_id, doc_id, score, rank by cosine, exact: every question against every row (of its scope).

    questions (query_id, v), corpus (doc_id, v). Null and zero vectors, those with a value that isn't finite and those of another width
    are not ranked, nor do they ask; a null scope matches nothing. Vectors travel as bytes of their own precision.
    """
    within = [scope] if scope else []
    single = all(isinstance(df.schema["v"].dataType.elementType, T.FloatType) for df in (questions, corpus))
    kind = np.float32 if single else np.float64

    def packed(df: DataFrame, name: str) -> DataFrame:
        def pack(batches):
            for pdf in batches:
                some = [np.asarray(v, kind) for v in pdf.v]
                good = np.array([np.isfinite(v).all() and v.any() for v in some], bool)
                yield pdf[good].assign(v=[v.tobytes() for v, g in zip(some, good, strict=True) if g])

        df = df.filter(F.col(name).isNotNull() & (F.size("v") > 0)).select(name, *within, "v")
        return df.mapInPandas(pack, T.StructType([f if f.name != "v" else T.StructField("v", T.BinaryType()) for f in df.schema.fields]))

    def units(vectors: pd.Series) -> np.ndarray:
        m = np.stack([np.frombuffer(v, kind) for v in vectors]).astype(np.float64)
        return m / np.linalg.norm(m, axis=1, keepdims=True)

    q, d = _meeting(packed(questions, "query_id"), packed(corpus, "doc_id"), questions, corpus, scope)
    sides = q.withColumn("side", F.lit(0)).unionByName(d.withColumn("side", F.lit(1)), allowMissingColumns=True)

    def meet(pdf: pd.DataFrame) -> pd.DataFrame:
        parts = []
        for _, own in pdf.groupby(pdf.v.map(len)):
            q, d = own[own.side == 0], own[own.side == 1]
            if len(q) and len(d):
                a, b = units(q.v), units(d.v)
                for start in range(0, len(d), 4096):
                    some = slice(start, start + 4096)
                    scores = np.round(a @ b[some].T, 9)
                    if scope:
                        scores[q[scope].to_numpy()[:, None] != d[scope].to_numpy()[some][None, :]] = -np.inf
                    parts.append(_best(scores, q.query_id.to_numpy(), d.doc_id.to_numpy()[some], k))
        if not parts:
            return pd.DataFrame({"query_id": pdf.query_id.iloc[:0], "doc_id": pdf.doc_id.iloc[:0], "score": np.empty(0)})
        best = pd.concat(parts).sort_values(["score", "doc_id"], ascending=[False, True], kind="stable")
        return best[best.groupby("query_id").cumcount() < k]

    return ranked(sides.groupBy("sb", "qb", "db").applyInPandas(meet, _ranking_schema(questions, corpus)), k)


def known_only(ranking: DataFrame, corpus: DataFrame) -> DataFrame:
    """A ranking without documents that the corpus lacks; ranks stay."""
    return ranking.join(corpus.select("doc_id").distinct(), "doc_id", "left_semi")


def texts_to_encode(questions: DataFrame, corpus: DataFrame) -> DataFrame:
    """key, text: every distinct text of questions and corpus, as a cache of vectors needs them; texts that differ in spacing alone are one."""
    texts = questions.select("text").unionByName(corpus.select("text")).filter("text is not null")
    return texts.groupBy(text_key(F.col("text")).alias("key")).agg(F.min("text").alias("text"))


def fuse(rankings: DataFrame, limit: int = 10, k: int = FUSION_K) -> DataFrame:
    """Reciprocal rank fusion of any number of rankings, unioned: query_id, doc_id, score, rank."""
    return ranked(rankings.groupBy("query_id", "doc_id").agg(F.sum(1.0 / (k + F.col("rank"))).alias("score")), limit)


def hybrid(lexical: DataFrame, semantic: DataFrame, limit: int = 50, candidates: int = CANDIDATES) -> DataFrame:
    """The first `candidates` of both arms, fused."""
    arms = lexical.select("query_id", "doc_id", "rank").unionByName(semantic.select("query_id", "doc_id", "rank"))
    return fuse(arms.filter(F.col("rank") <= candidates), limit)


def explain_hybrid(lexical: DataFrame, semantic: DataFrame, limit: int = 10, k: int = FUSION_K) -> DataFrame:
    """query_id, doc_id, score, rank, dense_rank, bm25_rank, found_only_by (dense, bm25 or null)."""
    both = semantic.select("query_id", "doc_id", F.col("rank").alias("dense_rank")).join(lexical.select("query_id", "doc_id", F.col("rank").alias("bm25_rank")), ["query_id", "doc_id"], "full_outer")
    part = lambda c: F.coalesce(1.0 / (k + F.col(c)), F.lit(0.0))
    only = F.when(F.col("bm25_rank").isNull(), "dense").when(F.col("dense_rank").isNull(), "bm25")
    return ranked(both.withColumn("score", part("dense_rank") + part("bm25_rank")).withColumn("found_only_by", only), limit)


def rerank(shortlist: DataFrame, pair_scores: DataFrame, k: int = 10, first: int = SHORTLIST) -> DataFrame:
    """query_id, doc_id, score, before, rank, moved: the first `first` of a ranking put in the order of another scorer.

    pair_scores (query_id, doc_id, score) must hold every shortlisted pair; a missing one raises.
    """
    short = shortlist.filter(F.col("rank") <= first).select("query_id", "doc_id", F.col("rank").alias("before"))
    scored = short.join(pair_scores.select("query_id", "doc_id", "score"), ["query_id", "doc_id"], "left")
    missing = F.raise_error(F.concat(F.lit("no score for pair "), F.col("query_id").cast("string"), F.lit(", "), F.col("doc_id").cast("string")))
    scored = scored.withColumn("score", F.when(F.col("score").isNull(), missing.cast("double")).otherwise(F.col("score")))
    return ranked(scored, k).withColumn("moved", F.col("before") - F.col("rank"))


def cached(wanted: DataFrame, cache: DataFrame, key: str = "key") -> DataFrame:
    """`wanted` with the cache's columns; a key that the cache lacks raises when its row is read."""
    known = cache.dropDuplicates([key]).withColumn("_hit", F.lit(True))
    missing = F.raise_error(F.concat(F.lit("not in the cache: "), F.coalesce(F.col(key).cast("string"), F.lit("null"))))
    return wanted.join(known, key, "left").filter(F.when(F.col("_hit").isNull(), missing.cast("boolean")).otherwise(F.lit(True))).drop("_hit")


def first_figure(ranking: DataFrame, corpus: DataFrame, pattern: str = r"\$\s?\d[\d,]*(?:\.\d+)?(?:\s*(?:million|billion|thousand))?") -> DataFrame:
    """query_id, doc_id, figure: the first amount printed in each question's best document, null if it has none."""
    best = ranking.filter("rank = 1").join(corpus.select("doc_id", "text"), "doc_id")
    return best.select("query_id", "doc_id", F.nullif(F.regexp_extract("text", pattern, 0), F.lit("")).alias("figure"))


def anchors(anchored: DataFrame, corpus: DataFrame, most: int = 3) -> DataFrame:
    """anchor_id, doc_id of the documents that hold an anchor's text verbatim, which at least one and at most `most` must.

    Candidates come from a join on the anchor's rarest term, so that no anchor is held against every document. Anchors with another
    number of hits raise.
    """
    a = anchored.select("anchor_id", "anchor", F.explode(F.array_distinct(terms(F.col("anchor")))).alias("term"))
    held = corpus.select("doc_id", "text", F.explode(F.array_distinct(terms(F.col("text")))).alias("term")).join(a.select("term").distinct(), "term", "left_semi")
    df = held.groupBy("term").agg(F.count("*").alias("df"))
    rarest = a.join(df, "term").groupBy("anchor_id", "anchor").agg(F.min_by("term", F.struct("df", "term")).alias("term"))
    hits = rarest.join(held, "term").filter(F.contains("text", "anchor")).select("anchor_id", "doc_id")
    counts = hits.groupBy("anchor_id").agg(F.count("*").alias("n"), F.collect_list("doc_id").alias("docs"))
    out = anchored.select("anchor_id").join(counts, "anchor_id", "left")
    wrong = F.raise_error(F.concat(F.lit(f"anchor without 1 to {most} hits: "), F.col("anchor_id").cast("string")))
    docs = F.when(F.coalesce(F.col("n"), F.lit(0)).between(1, most), F.col("docs")).otherwise(F.array(wrong.cast(corpus.schema["doc_id"].dataType)))
    return out.select("anchor_id", F.explode(docs).alias("doc_id"))


def anchored_documents(anchored: DataFrame, hits: DataFrame, corpus: DataFrame) -> DataFrame:
    """example_id, doc_id, place: the documents that an example's anchors name, each once, in the order of anchors and then of the corpus.

    anchored (example_id, anchor_id, pos), hits as of `anchors`, corpus (doc_id, pos). Places count from 0.
    """
    each = anchored.select("example_id", "anchor_id", F.col("pos").alias("_a")).join(hits, "anchor_id").join(corpus.select("doc_id", F.col("pos").alias("_c")), "doc_id")
    first = each.groupBy("example_id", "doc_id").agg(F.min(F.struct("_a", "_c")).alias("at"))
    place = F.row_number().over(Window.partitionBy("example_id").orderBy("at", "doc_id")) - 1
    return first.select("example_id", "doc_id", place.alias("place"))


def drift(corpus: DataFrame, indexed: DataFrame) -> DataFrame:
    """doc_id of the documents that the index lacks."""
    return corpus.select("doc_id").join(indexed.select("doc_id"), "doc_id", "left_anti")


def parity(left: DataFrame, right: DataFrame, k: int = 10, questions: DataFrame | None = None) -> DataFrame:
    """query_id, exact_order, top1, overlap, displacement, one_empty: how far two rankings agree per question.

    With `questions` (query_id), those that neither side answers are reported too: in the same order and with full overlap, but
    without a common first document.
    """
    sides = left.filter(F.col("rank") <= k).select("query_id", "doc_id", F.col("rank").alias("l")).join(
        right.filter(F.col("rank") <= k).select("query_id", "doc_id", F.col("rank").alias("r")), ["query_id", "doc_id"], "full_outer"
    )
    both = F.col("l").isNotNull() & F.col("r").isNotNull()
    out = sides.groupBy("query_id").agg(
        F.bool_and(both & (F.col("l") == F.col("r"))).alias("exact_order"),
        F.max(F.coalesce((F.col("l") == 1) & (F.col("r") == 1), F.lit(False))).alias("top1"),
        (F.count_if(both) / F.count("*")).alias("overlap"),
        F.coalesce(F.avg(F.when(both, F.abs(F.col("l") - F.col("r")))), F.lit(0.0)).alias("displacement"),
        F.count("l").alias("nl"), F.count("r").alias("nr"),
    )
    out = out.withColumn("one_empty", (F.col("nl") == 0) != (F.col("nr") == 0)).drop("nl", "nr")
    if questions is None:
        return out
    empty = {"exact_order": True, "top1": False, "overlap": 1.0, "displacement": 0.0, "one_empty": False}
    return questions.select("query_id").distinct().join(out, "query_id", "left").fillna(empty)


def any_of(text: Column) -> Column:
    """The question's terms as 'a | b', in order, each once; null if all are stopwords."""
    return F.nullif(F.array_join(F.array_sort(F.array_distinct(terms(text))), " | "), F.lit(""))
