"""Text, TF-IDF and retrieval queries (documents, conversations, benchmark questions)."""

from __future__ import annotations

from pyspark.sql import functions as F

from tessera.functions import text as tx
from tessera.operators import blockindex as bi
from tessera.operators import retrieval as rv
from tessera.operators import text as te
from tessera.operators.ordering import spread_texts
from tessera.plans.registry import register
from tessera.session import cut_lineage, stored
from tessera.sources.tables import Tables

WS = tx.PY_WHITESPACE_CLASS
KF = tx.KERAS_FILTER_CLASS
STOP_SQL = ", ".join("'" + w.replace("'", "''") + "'" for w in tx.english_stop_words())
SIZE, OVERLAP = 110, 25
STEP = SIZE - OVERLAP


def _chunk_sql() -> str:
    return f"""
w AS (SELECT doc_id, string_split(trim(regexp_replace(text, '{WS}+', ' ', 'g')), ' ') AS words
      FROM documents),
cm AS (SELECT doc_id, words, greatest(1, CAST(ceil((len(words) - {SIZE}) / {STEP}.0) AS BIGINT) + 1) AS m FROM w),
ce AS (SELECT doc_id, words, unnest(range(m)) AS i FROM cm),
ch AS (SELECT doc_id, CAST(i AS INTEGER) AS chunk_id,
              array_to_string(words[i * {STEP} + 1 : i * {STEP} + {SIZE}], ' ') AS chunk FROM ce)"""


@register("text_lines", sql="""
SELECT doc_id, CAST(unnest(range(len(string_split(text, chr(10))))) AS INTEGER) AS line_no,
       unnest(string_split(text, chr(10))) AS line
FROM documents
""")
def text_lines(spark, sf_dir):
    return te.text_lines(Tables(spark, sf_dir).documents, ["doc_id"])


@register("doc_assemble", sql="""
SELECT conv_id, count(*) AS n_parts, string_agg(coalesce(text, ''), chr(10) ORDER BY turn) AS text
FROM conversations GROUP BY conv_id
""")
def doc_assemble(spark, sf_dir):
    return te.assemble(Tables(spark, sf_dir).conversations, "conv_id", "turn")


@register("chunks", sql=f"""
WITH {_chunk_sql()}
SELECT doc_id, chunk_id, chunk,
       CAST(CASE WHEN chunk = '' THEN 0 ELSE len(string_split(chunk, ' ')) END AS INTEGER) AS n_words,
       CAST(length(chunk) AS INTEGER) AS n_chars, substring(chunk, 1, 90) AS preview
FROM ch
""")
def chunks(spark, sf_dir):
    return te.chunks(Tables(spark, sf_dir).documents, "doc_id", "text", SIZE, OVERLAP)


_TOKENS_SQL = f"""
k AS (SELECT doc_id, list_filter(string_split(regexp_replace(lower(text), '{KF}', ' ', 'g'), ' '), lambda t: t <> '') AS toks
      FROM documents),
tk AS (SELECT doc_id, CAST(unnest(range(len(toks))) AS INTEGER) AS pos, unnest(toks) AS token FROM k)"""


@register("tokens", sql=f"WITH {_TOKENS_SQL} SELECT doc_id, pos, token FROM tk")
def tokens(spark, sf_dir):
    return te.tokens(Tables(spark, sf_dir).documents, ["doc_id"])


@register("vocabulary", sql=f"""
WITH {_TOKENS_SQL},
c AS (SELECT token, count(*) AS n, first(doc_id ORDER BY doc_id, pos) AS fd, first(pos ORDER BY doc_id, pos) AS fp
      FROM tk GROUP BY token)
SELECT token, n, CAST(row_number() OVER (ORDER BY n DESC, fd, fp) AS INTEGER) AS token_id FROM c
""")
def vocabulary(spark, sf_dir):
    return te.vocabulary(te.tokens(Tables(spark, sf_dir).documents, ["doc_id"]), ["doc_id", "pos"])


@register("keywords", sql=f"""
SELECT doc_id, CASE WHEN len(list_distinct(regexp_extract_all(lower(text), '{tx.KEYWORD_PATTERN}'))) > 0
                    THEN array_to_string(list_sort(list_distinct(regexp_extract_all(lower(text), '{tx.KEYWORD_PATTERN}'))), ', ')
                    ELSE '{tx.NO_KEYWORDS}' END AS keywords
FROM documents
""")
def keywords(spark, sf_dir):
    return Tables(spark, sf_dir).documents.select("doc_id", tx.keywords("text").alias("keywords"))


def _conv_line_tokens(t):
    lines = te.text_lines(t.conversations, ["conv_id", "turn"])
    return lines.select("conv_id", "turn", "line_no", tx.keras_tokens("line").alias("toks"))


_CONV_TOKENS_SQL = f"""
cl AS (SELECT conv_id, turn, CAST(unnest(range(len(string_split(text, chr(10))))) AS INTEGER) AS line_no,
              unnest(string_split(text, chr(10))) AS line FROM conversations),
ct AS (SELECT conv_id, turn, line_no,
              list_filter(string_split(regexp_replace(lower(line), '{KF}', ' ', 'g'), ' '), lambda t: t <> '') AS toks
       FROM cl)"""


@register("prefix_ngrams", sql=f"""
WITH {_CONV_TOKENS_SQL},
p AS (SELECT conv_id, turn, line_no, toks, unnest(range(2, len(toks) + 1)) AS prefix_len FROM ct WHERE len(toks) >= 2)
SELECT conv_id, turn, line_no, CAST(prefix_len AS INTEGER) AS prefix_len,
       array_to_string(toks[1 : prefix_len], ' ') AS ngram FROM p
""")
def prefix_ngrams(spark, sf_dir):
    lines = _conv_line_tokens(Tables(spark, sf_dir))
    pre = te.prefixes(lines, "toks")
    return pre.select("conv_id", "turn", "line_no", "prefix_len",
                      F.array_join("prefix", " ").alias("ngram"))


@register("padded_sequences", sql=f"""
WITH {_CONV_TOKENS_SQL},
pt AS (SELECT conv_id, turn, line_no, CAST(unnest(range(len(toks))) AS INTEGER) AS pos, unnest(toks) AS token FROM ct),
v AS (SELECT token, CAST(row_number() OVER (ORDER BY count(*) DESC, first(conv_id ORDER BY conv_id, turn, line_no, pos),
                                                 first(turn ORDER BY conv_id, turn, line_no, pos),
                                                 first(line_no ORDER BY conv_id, turn, line_no, pos),
                                                 first(pos ORDER BY conv_id, turn, line_no, pos)) AS INTEGER) AS token_id
      FROM pt GROUP BY token),
s AS (SELECT conv_id, turn, line_no, list(token_id ORDER BY pos) AS seq FROM pt JOIN v USING (token)
      GROUP BY conv_id, turn, line_no),
p AS (SELECT conv_id, turn, line_no, seq, CAST(unnest(range(2, len(seq) + 1)) AS INTEGER) AS prefix_len FROM s
      WHERE len(seq) >= 2),
m AS (SELECT max(prefix_len) AS ml FROM p),
q AS (SELECT conv_id, turn, line_no, prefix_len,
             list_concat(list_transform(range(ml - prefix_len), lambda z: 0), seq[1 : prefix_len]) AS padded FROM p, m)
SELECT conv_id, turn, line_no, prefix_len, padded[1 : len(padded) - 1] AS x, padded[len(padded)] AS y FROM q
""")
def padded_sequences(spark, sf_dir):
    lines = stored(_conv_line_tokens(Tables(spark, sf_dir)), "line-tokens")
    tok_rows = lines.select("conv_id", "turn", "line_no", F.posexplode("toks").alias("pos", "token"))
    vocab = te.vocabulary(tok_rows, ["conv_id", "turn", "line_no", "pos"])
    seqs = stored(te.id_sequences(tok_rows, vocab, ["conv_id", "turn", "line_no"]), "id-sequences")  # read twice
    pre = te.prefixes(seqs, "seq")
    max_len = pre.agg(F.max("prefix_len")).first()[0] or 1
    return te.pad_and_cut(pre, max_len, "prefix").select("conv_id", "turn", "line_no", "prefix_len", "x", "y")


# ---- TF-IDF and retrieval over chunks of all documents ----------------------

TOP = 3


def _chunks(t):
    return te.chunks(t.documents, "doc_id", "text", SIZE, OVERLAP)


_TFIDF_SQL = f"""
{_chunk_sql()},
nc AS (SELECT count(*) AS n FROM ch),
tt AS (SELECT doc_id, chunk_id, unnest(regexp_extract_all(lower(chunk), '{tx.WORD2_PATTERN}')) AS term FROM ch),
tf AS (SELECT doc_id, chunk_id, term, count(*) AS tf FROM tt WHERE term NOT IN ({STOP_SQL}) GROUP BY ALL),
idf AS (SELECT term, count(*) AS df, ln((1.0 + (SELECT n FROM nc)) / (count(*) + 1)) + 1 AS idf FROM tf GROUP BY term),
dw AS (SELECT doc_id, chunk_id, term, tf, tf * idf AS w FROM tf JOIN idf USING (term)),
dp AS (SELECT doc_id, chunk_id, term, tf, w / sqrt(sum(w * w) OVER (PARTITION BY doc_id, chunk_id)) AS weight FROM dw),
qt AS (SELECT item_id, unnest(regexp_extract_all(lower(text), '{tx.WORD2_PATTERN}')) AS term FROM benchmark),
qf AS (SELECT item_id, term, count(*) AS tf FROM qt WHERE term NOT IN ({STOP_SQL}) GROUP BY ALL),
qw AS (SELECT item_id, term, tf, tf * idf AS w FROM qf JOIN idf USING (term)),
qp AS (SELECT item_id, term, tf, w / sqrt(sum(w * w) OVER (PARTITION BY item_id)) AS weight FROM qw),
sm AS (SELECT item_id, doc_id, chunk_id, round(sum(qp.weight * dp.weight), 9) AS score
       FROM qp JOIN dp USING (term) GROUP BY ALL),
fc AS (SELECT doc_id, chunk_id FROM ch ORDER BY doc_id, chunk_id LIMIT {2 * TOP - 1}),
sc AS (SELECT item_id, doc_id, chunk_id, max(score) AS score
       FROM (SELECT * FROM sm UNION ALL SELECT item_id, doc_id, chunk_id, 0.0 FROM benchmark, fc) GROUP BY ALL),
rk AS (SELECT *, row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id, chunk_id) AS rank FROM sc),
top AS (SELECT * FROM rk WHERE rank <= {TOP})"""


_INDEX: dict = {}


def _fit(t):
    """Build the retrieval index once per session and scale factor.

    Chunk table, IDF table and the posting blocks are written to the shared
    checkpoint folder; every retrieval query then reads these tables instead of
    re-chunking and re-fitting.
    """
    key = (t.sf_dir, t.spark.sparkContext.applicationId)
    if key not in _INDEX:
        # a file of few row groups is read by few tasks: texts are dealt out before they are chunked, by their id. The
        # counts are made from that layout (a stored table has none), so their rows are not exchanged again
        laid_out = te.chunks(spread_texts(t.documents.select("doc_id", "text"), "doc_id", "text"), "doc_id", "text", SIZE, OVERLAP)
        # stored by column and compressed: a checkpoint holds plain rows, and the previews that no one reads here
        ch = stored(laid_out.select("doc_id", "chunk_id", "chunk"), "chunks", packed=True)
        idf, post = rv.tfidf_fit(laid_out, ["doc_id", "chunk_id"], "chunk", n=ch.count())
        _INDEX[key] = (ch, idf, bi.build(post, ch.count()))
    return _INDEX[key]


@register("tfidf", sql=f"WITH {_TFIDF_SQL} SELECT doc_id, chunk_id, term, tf, round(weight, 9) AS weight FROM dp")
def tfidf(spark, sf_dir):
    _, _, index = _fit(Tables(spark, sf_dir))
    return bi.postings(index).withColumn("weight", F.round("weight", 9))


@register("tfidf_query", sql=f"WITH {_TFIDF_SQL} SELECT item_id, term, tf, round(weight, 9) AS weight FROM qp")
def tfidf_query(spark, sf_dir):
    t = Tables(spark, sf_dir)
    _, idf, _ = _fit(t)
    return rv.tfidf_transform(t.benchmark, idf, ["item_id"], "text").withColumn("weight", F.round("weight", 9))


@register("index_stats", sql=f"""
WITH {_TFIDF_SQL}
SELECT (SELECT n FROM nc) AS n_chunks, (SELECT count(*) FROM idf) AS n_terms, (SELECT count(*) FROM dp) AS n_postings,
       (SELECT max(df) FROM idf) AS max_df
""")
def index_stats(spark, sf_dir):
    ch, idf, index = _fit(Tables(spark, sf_dir))
    n_chunks = ch.count()
    terms = idf.agg(F.count(F.lit(1)).alias("n"), F.max("df").alias("m")).first()
    n_postings = index.terms.agg(F.sum("n")).first()[0] or 0
    return spark.createDataFrame(
        [(n_chunks, terms["n"], n_postings, terms["m"])],
        "n_chunks long, n_terms long, n_postings long, max_df long")


@register("index_lookup", sql=f"""
WITH {_TFIDF_SQL},
pt AS (SELECT term, count(*) AS n, max(weight) AS top FROM dp GROUP BY term)
SELECT item_id, count(*) AS n_terms, CAST(sum(n) AS BIGINT) AS n_postings, round(sum(qp.weight * top), 9) AS best_possible
FROM qp JOIN pt USING (term) GROUP BY item_id
""")
def index_lookup(spark, sf_dir):
    """What the stored index holds for each question: terms, postings, and the highest score a chunk could have."""
    t = Tables(spark, sf_dir)
    _, idf, index = _fit(t)
    asked = rv.tfidf_transform(t.benchmark, idf, ["item_id"], "text").select("item_id", "term", F.col("weight").alias("wq"))
    per_term = bi.lookup(asked, index).groupBy("item_id", "term", "wq").agg(F.sum("n").alias("n"), F.max("top").alias("top"))
    return per_term.groupBy("item_id").agg(
        F.count(F.lit(1)).alias("n_terms"), F.sum("n").alias("n_postings"),
        F.round(F.sum(F.col("wq") * F.col("top")), 9).alias("best_possible"))


def _ranked(t):
    """Top-3 chunks per benchmark question, computed once per session (answers,
    prompts and the ranking query all read the same retrieval)."""
    key = ("ranked", t.sf_dir, t.spark.sparkContext.applicationId)
    if key not in _INDEX:
        ch, idf, index = _fit(t)
        q = stored(rv.tfidf_transform(t.benchmark, idf, ["item_id"], "text"), "question-postings")
        scores = bi.retrieve(q, index, "item_id", ("doc_id", "chunk_id"), TOP)
        every = rv.with_unmatched(scores, t.benchmark, ch, ["item_id"], ["doc_id", "chunk_id"], TOP)
        _INDEX[key] = (ch, cut_lineage(rv.top_k(every, ["item_id"], ["doc_id", "chunk_id"], TOP)))
    return _INDEX[key]


@register("retrieve_topk", sql=f"""
WITH {_TFIDF_SQL} SELECT item_id, CAST(rank AS INTEGER) AS rank, doc_id, chunk_id, score FROM top""")
def retrieve_topk(spark, sf_dir):
    _, top = _ranked(Tables(spark, sf_dir))
    return top.select("item_id", "rank", "doc_id", "chunk_id", "score")


_ANSWER_SQL = f"""
{_TFIDF_SQL},
hits AS (SELECT top.*, ch.chunk FROM top JOIN ch USING (doc_id, chunk_id)),
agg AS (SELECT item_id,
               '{rv.EXTRACTIVE_PREFIX}' || printf('%.3f', first(score ORDER BY rank)) || ')' || chr(10)
                   || first(chunk ORDER BY rank) AS answer,
               string_agg(doc_id || ':' || chunk_id || '@' || printf('%.3f', score), ', ' ORDER BY rank) AS sources,
               CAST(count(*) AS INTEGER) AS n_sources,
               string_agg(chunk, chr(10) ORDER BY rank) AS context
        FROM hits GROUP BY item_id),
ans AS (SELECT b.item_id, b.text AS question, answer, sources, n_sources, context
        FROM benchmark b LEFT JOIN agg USING (item_id))"""


@register("rag_answers", sql=f"WITH {_ANSWER_SQL} SELECT item_id, question, answer, sources, n_sources FROM ans")
def rag_answers(spark, sf_dir):
    t = Tables(spark, sf_dir)
    ch, top = _ranked(t)
    return rv.answers(top, ch, t.benchmark, "item_id", ["doc_id", "chunk_id"]).drop("context")


@register("rag_sources", sql=f"""
WITH {_TFIDF_SQL}
SELECT item_id, CAST(rank AS INTEGER) AS rank, doc_id, chunk_id, score, chunk FROM top JOIN ch USING (doc_id, chunk_id)
""")
def rag_sources(spark, sf_dir):
    """The sources of each answer with their texts, one row per source."""
    ch, top = _ranked(Tables(spark, sf_dir))
    return rv.sources(top, ch, ["doc_id", "chunk_id"]).select("item_id", "rank", "doc_id", "chunk_id", "score", "chunk")


@register("rag_prompts", sql=f"""
WITH {_ANSWER_SQL}
SELECT item_id, '{rv.PROMPT_HEAD.replace(chr(10), "' || chr(10) || '")}' || coalesce(context, '')
       || chr(10) || chr(10) || 'Question: ' || question || chr(10) || 'Answer:' AS prompt FROM ans
""")
def rag_prompts(spark, sf_dir):
    t = Tables(spark, sf_dir)
    ch, top = _ranked(t)
    return rv.prompts(rv.answers(top, ch, t.benchmark, "item_id", ["doc_id", "chunk_id"]), "item_id")


# ---- next-word model and greedy generation -----------------------------------

from tessera.operators import ngram as ng  # noqa: E402

_NEXT_SQL = f"""
el AS (SELECT unnest(string_split(text, chr(10))) AS line FROM documents),
lt AS (SELECT list_filter(string_split(regexp_replace(lower(line), '{KF}', ' ', 'g'), ' '), lambda t: t <> '') AS toks
       FROM el),
cr AS (SELECT n, array_to_string(toks[pos - n : pos - 1], ' ') AS context, toks[pos] AS next_word
       FROM (SELECT toks, n, unnest(range(n + 1, len(toks) + 1)) AS pos FROM lt, range(1, 4) r(n) WHERE len(toks) > n)),
cc AS (SELECT n, context, next_word, count(*) AS cnt FROM cr GROUP BY ALL),
nb AS (SELECT CAST(n AS INTEGER) AS n, context, first(next_word ORDER BY cnt DESC, next_word) AS next_word,
              max(cnt) AS n_next, CAST(sum(cnt) AS BIGINT) AS n_context FROM cc GROUP BY n, context)"""


def _lines(t):
    lines = te.text_lines(t.documents, ["doc_id"])
    return lines.select(tx.keras_tokens("line").alias("toks"))


def _next_model(t):
    """The next-word count table, built once per session (read by generation too)."""
    key = ("next_word", t.sf_dir, t.spark.sparkContext.applicationId)
    if key not in _INDEX:
        _INDEX[key] = stored(ng.next_word_table(_lines(t), "toks", 3), "next-words", packed=True)
    return _INDEX[key]


@register("next_word", sql=f"WITH {_NEXT_SQL} SELECT * FROM nb")
def next_word(spark, sf_dir):
    return _next_model(Tables(spark, sf_dir))


def _ctx_sql(k: int) -> str:
    return (f"(SELECT next_word FROM nb WHERE n = {k} AND len(g.toks) >= {k} "
            f"AND context = array_to_string(g.toks[-{k}:], ' '))")


@register("generate_text", sql=f"""
WITH RECURSIVE {_NEXT_SQL},
sd AS (SELECT item_id,
              list_filter(string_split(regexp_replace(lower(text), '{KF}', ' ', 'g'), ' '), lambda t: t <> '') AS toks
       FROM benchmark),
g AS (SELECT item_id, 0 AS step, toks FROM sd
      UNION ALL
      SELECT item_id, step + 1, CASE WHEN w IS NULL THEN toks ELSE list_append(toks, w) END
      FROM (SELECT item_id, step, toks, coalesce({_ctx_sql(3)}, {_ctx_sql(2)}, {_ctx_sql(1)}) AS w
            FROM g WHERE step < 10))
SELECT item_id, array_to_string(toks, ' ') AS generated FROM g WHERE step = 10
""")
def generate_text(spark, sf_dir):
    t = Tables(spark, sf_dir)
    model = _next_model(t)
    seeds = t.benchmark.select("item_id", tx.keras_tokens("text").alias("toks"))
    out = ng.generate(seeds, "item_id", "toks", model, 10, 3)
    return out.select("item_id", F.array_join("toks", " ").alias("generated"))
