"""TF-IDF postings, batch retrieval (sparse and dense), answers and prompts.

Sparse retrieval never forms the chunks x questions product: both sides are
posting rows ``(id, term, weight)`` and only chunks sharing a term with a
question meet, in an equi-join on ``term``. A hot term is a skewed join key,
which AQE's skew-join splits. Scores are summed with partial aggregation and
the top-k per question uses ``row_number() <= k``, which Spark plans with a
partial WindowGroupLimit before the shuffle (only k rows per question per
partition move).
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tessera.functions import text as tx
from tessera.operators.ordering import broadcast_if_small
from tessera.operators.skewjoin import split_join
from tessera.session import stored

SCORE_DIGITS = 9
#: Terms of a vocabulary that is sent to all tasks, and their bytes, at most.
SENT_TERMS, SENT_BYTES = 1_000_000, 32 << 20

# ---- fixed values: texts of answers and prompts ----
EXTRACTIVE_PREFIX = "(extractive answer, no generative model available — top match, score="
PROMPT_HEAD = "Answer the question using only the context below.\n\nContext:\n"
PROMPT_QUESTION = "\n\nQuestion: "
PROMPT_ANSWER = "\nAnswer:"
# -----------------------------------------------------


def term_rows(df: DataFrame, id_cols: Sequence[str], text_col: str = "text",
              stop_words: Sequence[str] | None = None) -> DataFrame:
    """(*ids, term, tf): raw counts of 2+-char lower-case word tokens minus stop words."""
    stops = list(tx.english_stop_words() if stop_words is None else stop_words)
    toks = df.select(*id_cols, F.explode(tx.word_tokens(text_col)).alias("term"))
    if stops:
        toks = toks.where(~F.col("term").isin(stops))
    return toks.groupBy(*id_cols, "term").agg(F.count(F.lit(1)).alias("tf"))


def _l2(df: DataFrame, id_cols: Sequence[str], w: Column) -> DataFrame:
    weighted = df.withColumn("__w", w)
    norm = F.sqrt(F.sum(F.col("__w") * F.col("__w")).over(Window.partitionBy(*id_cols)))
    return weighted.withColumn("weight", F.col("__w") / norm).drop("__w")


def tfidf_fit(docs: DataFrame, id_cols: Sequence[str], text_col: str = "text",
              stop_words: Sequence[str] | None = None, n: int | None = None) -> tuple[DataFrame, DataFrame]:
    """Fit smooth IDF on ``docs``; return (idf table, L2-normalised postings).

    idf = ln((1 + n) / (1 + df)) + 1 with n counting every document, empty
    ones included (MLlib's IDF lacks the +1, hence this formula). A vocabulary of bounded size is sent to the
    counts; a larger one meets them in a join by term (frequent terms without a shuffle). ``docs`` that are
    partitioned by one of ``id_cols`` are not exchanged for the counts and norms. ``n`` is their count, if known.
    """
    n = docs.count() if n is None else n
    tf = term_rows(docs, id_cols, text_col, stop_words)
    idf = stored(tf.groupBy("term").agg(F.count(F.lit(1)).alias("df")).withColumn(
        "idf", F.ln(F.lit(1.0 + n) / (F.col("df") + 1)) + 1), "idf", packed=True)
    known = idf.select("term", "idf")
    sent = broadcast_if_small(known, SENT_TERMS, SENT_BYTES)
    # a vocabulary that can be sent leaves the counts where they are; counting twice is less than writing them
    met = tf.join(sent, "term") if sent is not known else split_join(stored(tf, "term-counts", packed=True), known, "term")
    return idf, _l2(met, id_cols, F.col("tf") * F.col("idf")).select(*id_cols, "term", "tf", "weight")


def tfidf_transform(queries: DataFrame, idf: DataFrame, id_cols: Sequence[str], text_col: str = "text",
                    stop_words: Sequence[str] | None = None) -> DataFrame:
    """Query postings against a fitted IDF table; unseen terms are dropped."""
    tf = term_rows(queries, id_cols, text_col, stop_words)
    known = tf.join(idf.select("term", "idf"), "term")
    return _l2(known, id_cols, F.col("tf") * F.col("idf")).select(*id_cols, "term", "tf", "weight")


def sparse_scores(q_post: DataFrame, d_post: DataFrame, q_ids: Sequence[str],
                  d_ids: Sequence[str]) -> DataFrame:
    """Cosine scores (postings are unit length) for every (question, chunk) sharing a term."""
    q = q_post.select(*q_ids, "term", F.col("weight").alias("wq"))
    d = d_post.select(*d_ids, "term", F.col("weight").alias("wd"))
    return q.join(d, "term").groupBy(*q_ids, *d_ids).agg(
        F.round(F.sum(F.col("wq") * F.col("wd")), SCORE_DIGITS).alias("score"))


def with_unmatched(scores: DataFrame, questions: DataFrame, chunks: DataFrame, q_ids: Sequence[str],
                   d_ids: Sequence[str], k: int = 3) -> DataFrame:
    """``scores`` and, with score 0, enough chunks that every question has at least ``k``.

    A question matches fewer than ``k`` chunks or needs no filling, so the first ``2k - 1`` chunks by id
    hold the ``k`` smallest ids among those it does not match.
    """
    first = chunks.select(*d_ids).orderBy(*d_ids).limit(2 * k - 1).collect()
    if not first:
        return scores
    filler = F.explode(F.array(*[F.struct(*[F.lit(r[c]).cast(chunks.schema[c].dataType).alias(c) for c in d_ids])
                                 for r in first]))
    zero = questions.select(*q_ids, filler.alias("__d")).select(*q_ids, "__d.*", F.lit(0.0).alias("score"))
    every = scores.select(*q_ids, *d_ids, "score").unionByName(zero)
    return every.groupBy(*q_ids, *d_ids).agg(F.max("score").alias("score"))


def sources(ranked: DataFrame, chunks: DataFrame, d_ids: Sequence[str]) -> DataFrame:
    """The ranked chunks with their texts; a bounded ranking is sent to the chunks, whose texts stay where they are."""
    return broadcast_if_small(ranked).join(chunks.select(*d_ids, "chunk"), list(d_ids))


def top_k(scores: DataFrame, q_ids: Sequence[str], d_ids: Sequence[str], k: int = 3) -> DataFrame:
    """Best ``k`` per question, rank 1..k; ties broken by the chunk ids ascending."""
    w = Window.partitionBy(*q_ids).orderBy(F.desc("score"), *[F.asc(c) for c in d_ids])
    return scores.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k)


def answers(ranked: DataFrame, chunks: DataFrame, questions: DataFrame, q_id: str,
            d_ids: Sequence[str], question_col: str = "text") -> DataFrame:
    """Batch ``ask``: question, extractive answer from the rank-1 chunk, sources.

    ``sources`` is 'doc:chunk@score' strings in rank order (``sources()`` has them as rows, with
    texts). Only an empty index leaves a question without an answer.
    """
    hits = sources(ranked, chunks, d_ids)
    src = F.concat_ws(":", *[F.col(c).cast("string") for c in d_ids])
    per_q = hits.groupBy(q_id).agg(
        F.array_sort(F.collect_list(F.struct("rank", F.col("score"), F.col("chunk"),
                                             src.alias("key")))).alias("hits"))
    top = F.col("hits")[0]
    body = per_q.select(
        q_id,
        F.concat(F.lit(EXTRACTIVE_PREFIX), F.format_string("%.3f", top["score"]), F.lit(")\n"),
                 top["chunk"]).alias("answer"),
        F.array_join(F.transform("hits", lambda h: F.concat(h["key"], F.lit("@"),
                                                            F.format_string("%.3f", h["score"]))),
                     ", ").alias("sources"),
        F.size("hits").alias("n_sources"),
        F.array_join(F.transform("hits", lambda h: h["chunk"]), "\n").alias("context"),
    )
    return questions.select(q_id, F.col(question_col).alias("question")).join(body, q_id, "left")


def prompts(answered: DataFrame, q_id: str) -> DataFrame:
    """Fill the generation prompt with the retrieved context (input for an external model)."""
    return answered.select(
        q_id,
        F.concat(F.lit(PROMPT_HEAD), F.coalesce("context", F.lit("")), F.lit(PROMPT_QUESTION),
                 F.col("question"), F.lit(PROMPT_ANSWER)).alias("prompt"),
    )


def centroids(vectors: DataFrame, group_col: str, vec_col: str) -> DataFrame:
    """Element-wise mean vector per group (partial aggregation per (group, position))."""
    cells = vectors.select(group_col, F.posexplode(vec_col).alias("i", "x"))
    means = cells.groupBy(group_col, "i").agg(F.avg(F.col("x").cast("double")).alias("m"))
    return means.groupBy(group_col).agg(
        F.transform(F.array_sort(F.collect_list(F.struct("i", "m"))), lambda s: s["m"]).alias("centroid"))


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0),
                       lambda acc, v: acc + v)


def l2_norm(a: Column) -> Column:
    return F.sqrt(dot(a, a))


def cosine(a: Column, b: Column) -> Column:
    """a.b / ((|a| + 1e-10) (|b| + 1e-10)) -- a zero vector scores 0."""
    return dot(a, b) / ((l2_norm(a) + F.lit(1e-10)) * (l2_norm(b) + F.lit(1e-10)))


def dense_topk(vectors: DataFrame, queries: DataFrame, vec_id: str, vec_col: str, q_id: str,
               q_col: str, k: int = 3, block_rows: int = 4096) -> DataFrame:
    """Exact cosine top-k of ``vectors`` for each query vector.

    Queries are taken in blocks of about ``block_rows``, each a broadcast of bounded size and one pass
    over ``vectors``. A task scores its batches as matrix products and keeps ``k`` rows per query, so
    what is shuffled is k rows per query and task. Null vectors are no candidates.
    """
    import numpy as np
    import pyarrow as pa

    spark = vectors.sparkSession
    queries = queries.select(q_id, q_col).where(F.col(q_col).isNotNull())
    n_blocks = max(1, -(-queries.count() // block_rows))
    results = None
    for b in range(n_blocks):
        block = queries if n_blocks == 1 else queries.where(F.pmod(F.xxhash64(q_id), F.lit(n_blocks)) == b)
        rows = block.collect()  # about block_rows
        sent = spark.sparkContext.broadcast(([r[0] for r in rows], [list(map(float, r[1])) for r in rows]))

        def best(batches, sent=sent):
            ids, wanted = sent.value
            if not ids:
                return
            w = np.array(wanted)
            w = w / (np.linalg.norm(w, axis=1, keepdims=True) + 1e-10)
            held_id, held = None, None
            for batch in batches:
                if not len(batch):
                    continue
                x = batch.column(1).flatten().to_numpy(zero_copy_only=False).astype(float).reshape(len(batch), -1)
                score = np.round((x / (np.linalg.norm(x, axis=1, keepdims=True) + 1e-10)) @ w.T, SCORE_DIGITS).T
                own = np.broadcast_to(batch.column(0).to_numpy(zero_copy_only=False), score.shape)
                if held is not None:
                    score, own = np.concatenate([held, score], axis=1), np.concatenate([held_id, own], axis=1)
                order = np.lexsort((own, -score), axis=1)[:, :k]
                held, held_id = np.take_along_axis(score, order, 1), np.take_along_axis(own, order, 1)
            if held is not None:
                at = np.repeat(np.arange(len(ids)), held.shape[1])
                yield pa.RecordBatch.from_arrays(
                    [pa.array([str(ids[i]) for i in at]), pa.array(held_id.ravel(), batch.schema.field(0).type),
                     pa.array(held.ravel())], [q_id, vec_id, "score"])

        scored = vectors.select(vec_id, vec_col).where(F.col(vec_col).isNotNull()).mapInArrow(
            best, f"{q_id} string, {vec_id} {vectors.schema[vec_id].dataType.simpleString()}, score double")
        scored = scored.withColumn(q_id, F.col(q_id).cast(queries.schema[q_id].dataType))
        part = top_k(scored, [q_id], [vec_id], k)
        results = part if results is None else results.unionByName(part)
    return results
