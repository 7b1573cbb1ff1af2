"""TF-IDF, BM25 and hybrid ranking as token joins with map-side aggregation."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from cliptide.functions import text as X
from cliptide.functions.arrays import let
from cliptide.functions.vectors import SCORE_DIGITS
from cliptide.operators import carry
from cliptide.session import broadcast_when_small, cut_lineage

#: Generous size of one (query, token, count) row when a broadcast is checked.
_TERM_BYTES = 128


def term_counts(df: DataFrame, keys: list[str], tokens: str) -> DataFrame:
    """Occurrences of every token per key, with the key's token total."""
    exploded = df.select(*keys, F.size(tokens).alias("total"), F.explode(tokens).alias("token"))
    return exploded.groupBy(*keys, "total", "token").agg(F.count("*").alias("tf"))


def tfidf_scores(docs: DataFrame, queries: DataFrame, scope: list[str], doc: str, tokens: str) -> DataFrame:
    """TF-IDF cosine of each scope's query with each of its documents: (scope, doc, score).

    Document frequencies and the corpus size are those of the scope. Documents sharing no token
    with the query score zero and stay in the result; a document without tokens has one posting
    with a null token. Postings and term weights are each read twice, so both are stored first:
    texts are tokenised and shuffled once.
    """
    counts = cut_lineage(
        docs.select(*scope, doc, F.size(tokens).alias("total"), F.explode_outer(tokens).alias("token"))
        .groupBy(*scope, doc, "total", "token")
        .agg(F.count("token").alias("tf"))
    )
    size = docs.groupBy(*scope).agg(F.count("*").alias("n"))
    frequency = counts.filter(F.col("token").isNotNull()).groupBy(*scope, "token").agg(F.count("*").alias("df"))
    asked = term_counts(queries, scope, tokens).withColumnsRenamed({"tf": "qtf", "total": "qtotal"})
    idf = F.log((F.col("n") + 1) / (F.coalesce("df", F.lit(0)) + 1)) + 1.0
    terms = cut_lineage(
        frequency.join(asked, [*scope, "token"], "full")
        .join(size, scope)
        .select(*scope, "token", idf.alias("idf"), (F.col("qtf") / F.col("qtotal") * idf).alias("qw"))
    )
    query_norm = terms.groupBy(*scope).agg(F.sqrt(F.sum(F.col("qw") * F.col("qw"))).alias("qn"))
    weight = F.col("tf") / F.greatest(F.col("total"), F.lit(1)) * F.col("idf")
    matched = (
        counts.join(terms, [*scope, "token"], "left")
        .groupBy(*scope, doc)
        .agg(F.sqrt(F.sum(weight * weight)).alias("dn"), F.sum(weight * F.col("qw")).alias("hit"))
    )
    usable = (F.col("dn") > 1e-12) & (F.col("qn") > 1e-12)
    score = F.coalesce(F.when(usable, F.col("hit") / F.col("dn") / F.col("qn")), F.lit(0.0))
    scored = matched.join(query_norm, scope, "left")
    return scored.select(*scope, doc, (F.round(score, SCORE_DIGITS) + F.lit(0.0)).alias("score"))


def ranked_all(scored: DataFrame, scope: list[str], start: Column, tie: str) -> DataFrame:
    """Every candidate with its place by score, then start (null counts as zero), then position.

    A hot scope is cut into bands of the score that are ranked by themselves.
    """
    ordered = scored.withColumns({"__neg": -F.col("score"), "__start": F.coalesce(start, F.lit(0.0))})
    chunk = carry.chunk_if_hot(scored, scope, F.floor(-F.col("score") * 256))
    return carry.position(ordered, scope, ["__neg", "__start", tie], chunk, "rank").drop("__neg", "__start")


def ranked_pool(scored: DataFrame, scope: list[str], start: Column, tie: str, size: int = 200) -> DataFrame:
    """The first ``size`` candidates by score, then start (null counts as zero), then position.

    The bound turns into a per-task limit before the shuffle, so a hot scope is never sorted whole.
    """
    order = [F.desc("score"), F.coalesce(start, F.lit(0.0)).asc(), F.asc(tie)]
    ranked = scored.withColumn("rank", F.row_number().over(Window.partitionBy(*scope).orderBy(*order)))
    return ranked.filter(F.col("rank") <= size)


#: Largest query-by-vocabulary matrix (cells) that is shipped to every task for BM25.
BLOCK_CELLS = 20_000_000
#: Documents that a task scores at once; a batch of Spark may hold ten thousand, with all their tokens.
SCORED_ROWS = 1024


def bm25_top(
    docs: DataFrame,
    queries: DataFrame,
    doc: str,
    query: str,
    tokens: str,
    k: int,
    k1: float = 1.5,
    b: float = 0.75,
) -> DataFrame:
    """Best ``k`` positive BM25 documents per query over one corpus; ties go to the later document.

    Repeated query tokens count repeatedly. The query terms are counted first: if their matrix is
    small it is shipped and every task scores its own documents, sending only its best ``k`` per
    query; otherwise postings of query tokens are joined with the terms.
    """
    terms = queries.select(query, F.explode(tokens).alias("token")).groupBy(query, "token").agg(
        F.count("*").alias("qtf")
    )
    sizes = terms.agg(F.count_distinct("token").alias("v"), F.count_distinct(query).alias("q")).first()
    if sizes["v"] * sizes["q"] <= BLOCK_CELLS:
        hits = _bm25_by_matrix(docs, terms, doc, query, tokens, k, k1, b)
    else:
        hits = _bm25_by_join(docs, terms, doc, query, tokens, k1, b)
    order = Window.partitionBy(query).orderBy(F.desc("score"), F.desc(doc))
    return hits.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= k)


def _bm25_by_join(
    docs: DataFrame, terms: DataFrame, doc: str, query: str, tokens: str, k1: float, b: float
) -> DataFrame:
    """Positive scores by joining postings and query terms on the token."""
    vocabulary = broadcast_when_small(terms.select("token").distinct(), _TERM_BYTES)
    lengths = docs.select(doc, F.size(tokens).alias("len"), tokens)
    corpus = lengths.agg(F.count("*").alias("n"), F.avg("len").alias("avg_len"))
    postings = (
        lengths.select(doc, "len", F.explode(tokens).alias("token"))
        .join(vocabulary, "token")
        .groupBy(doc, "len", "token")
        .agg(F.count("*").alias("tf"))
    )
    n, avg_len = corpus.select("n").scalar(), corpus.select("avg_len").scalar()
    frequency = postings.groupBy("token").agg(F.count("*").alias("df"))
    idf = frequency.select("token", F.log(1 + (n - F.col("df") + 0.5) / (F.col("df") + 0.5)).alias("idf"))
    share = F.col("tf") + k1 * (1 - b + b * F.col("len") / avg_len)
    weighted = postings.join(idf, "token").select(
        doc, "token", (F.col("idf") * F.col("tf") * (k1 + 1) / share).alias("w")
    )
    return (
        weighted.join(broadcast_when_small(terms, _TERM_BYTES), "token")
        .groupBy(query, doc)
        .agg(F.round(F.sum(F.col("w") * F.col("qtf")), SCORE_DIGITS).alias("score"))
        .filter(F.col("score") > 0)
    )


def _bm25_by_matrix(
    docs: DataFrame, terms: DataFrame, doc: str, query: str, tokens: str, k: int, k1: float, b: float
) -> DataFrame:
    """Best positive scores per task and query (ties at the cut kept) by block products."""
    spark = docs.sparkSession
    listed = terms.toArrow()  # at most BLOCK_CELLS entries, counted by the caller
    words = pc.unique(listed["token"].combine_chunks())
    askers = pc.unique(listed[query].combine_chunks())
    matrix = np.zeros((len(words), len(askers)))
    matrix[
        pc.index_in(listed["token"], value_set=words).to_numpy(), pc.index_in(listed[query], value_set=askers).to_numpy()
    ] = listed["qtf"].to_numpy()
    # one pass over the corpus: document frequencies, and under the empty token its size and length
    wanted = [*words.to_pylist(), ""]
    vocabulary = F.broadcast(spark.createDataFrame([(w,) for w in wanted], "token string"))
    marked = docs.select(
        F.size(tokens).alias("len"),
        F.explode(F.concat(F.array_distinct(tokens), F.array(F.lit("")))).alias("token"),
    )
    counted = marked.join(vocabulary, "token").groupBy("token").agg(
        F.count("*").alias("df"), F.sum(F.when(F.col("token") == "", F.col("len"))).alias("len")
    )
    rows = {r["token"]: r for r in counted.toLocalIterator()}  # at most one row per query token
    if "" not in rows:
        rows[""] = {"df": 0, "len": 0}
    size, total = rows[""]["df"], rows[""]["len"]
    seen = np.array([rows[w]["df"] if w in rows else 0 for w in words.to_pylist()], dtype=float)
    idf = np.log(1 + (size - seen + 0.5) / (seen + 0.5))
    shipped = spark.sparkContext.broadcast((words, askers, matrix, idf, (total / size if size else 0.0) or 1.0))
    types = dict(docs.dtypes)
    schema = f"{query} {dict(terms.dtypes)[query]}, {doc} {types[doc]}, score double"

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words, askers, matrix, idf, avg_len = shipped.value
        block = max(1, 4_000_000 // max(1, len(words)))
        for batch in (whole.slice(at, SCORED_ROWS) for whole in batches for at in range(0, whole.num_rows, SCORED_ROWS)):
            ids, listed_tokens = batch.column(0), batch.column(1)
            length = pc.list_value_length(listed_tokens).to_numpy(zero_copy_only=False)
            owner = np.repeat(np.arange(batch.num_rows), length)
            code = pc.index_in(listed_tokens.flatten(), value_set=words)
            known = code.is_valid().to_numpy(zero_copy_only=False)
            code = pc.fill_null(code, 0).to_numpy(zero_copy_only=False)[known].astype(np.int64)
            place, tf = np.unique(owner[known] * len(words) + code, return_counts=True)
            row, col = place // len(words), place % len(words)
            weight = idf[col] * tf * (k1 + 1) / (tf + k1 * (1 - b + b * length[row] / avg_len))
            scores = np.zeros((batch.num_rows, len(askers)))
            for begin in range(0, batch.num_rows, block):
                part = slice(*np.searchsorted(row, [begin, begin + block]))
                dense = np.zeros((min(block, batch.num_rows - begin), len(words)))
                dense[row[part] - begin, col[part]] = weight[part]
                scores[begin : begin + block] = dense @ matrix
            scores = np.round(scores, SCORE_DIGITS)
            least = np.partition(scores, -k, axis=0)[-k] if batch.num_rows > k else np.zeros(len(askers))
            hit, asker = np.nonzero((scores >= least) & (scores > 0))
            yield pa.RecordBatch.from_arrays(
                [askers.take(pa.array(asker)), ids.take(pa.array(hit)), pa.array(scores[hit, asker])],
                names=[query, doc, "score"],
            )

    return docs.select(doc, tokens).mapInArrow(score, schema)


def hybrid_scores(scored: DataFrame, scope: list[str], dense: str, sparse: str, weight: float = 0.7) -> DataFrame:
    """Blend of the scope-wise min-max scaled dense and sparse scores.

    The ranges are aggregated per scope (map-side) and joined back, so no scope is sorted whole.
    """
    weight = min(1.0, max(0.0, weight))
    ranges = scored.groupBy(*scope).agg(
        *[f(c).alias(f"__{n}_{c}") for c in (dense, sparse) for n, f in (("lo", F.min), ("hi", F.max))]
    )

    def unit(c: str) -> Column:
        low, high = F.col(f"__lo_{c}"), F.col(f"__hi_{c}")
        return (F.col(c) - low) / F.greatest(F.abs(high - low), F.lit(1e-12))

    blended = F.round(weight * unit(dense) + (1.0 - weight) * unit(sparse), SCORE_DIGITS) + F.lit(0.0)
    joined = scored.join(ranges, scope).withColumn("score", blended)
    return joined.drop(*[c for c in ranges.columns if c.startswith("__")])


def token_f1(df: DataFrame, keys: list[str], left: str, right: str) -> DataFrame:
    """Token F1 of two token arrays per row, by joining token counts."""
    def counts(name: str) -> DataFrame:
        return term_counts(df, keys, name).withColumnRenamed("tf", f"n_{name}").drop("total")

    shared = (
        counts(left)
        .join(counts(right), [*keys, "token"])
        .groupBy(*keys)
        .agg(F.sum(F.least(F.col(f"n_{left}"), F.col(f"n_{right}"))).alias("common"))
    )
    both = df.join(shared, keys, "left")
    common = F.coalesce("common", F.lit(0))
    precision, recall = common / F.size(left), common / F.size(right)
    f1 = F.when(common > 0, 2 * precision * recall / (precision + recall)).otherwise(F.lit(0.0))
    return both.withColumn("f1", f1).drop("common")


def _pair_f1(left: Column, right: Column) -> Column:
    """Token F1 of two short token arrays."""
    common = F.aggregate(
        F.array_distinct(left),
        F.lit(0),
        lambda acc, t: acc
        + F.least(F.size(F.filter(left, lambda x: x == t)), F.size(F.filter(right, lambda x: x == t))),
    )

    def score(c: Column) -> Column:
        precision, recall = c / F.size(left), c / F.size(right)
        return F.when(c > 0, 2 * precision * recall / (precision + recall)).otherwise(F.lit(0.0))

    return let(common, score)


def list_f1(prediction: Column, gold: Column) -> Column:
    """Comma-list F1: the best prediction part per gold part, averaged over the gold parts."""
    def parts(text: Column) -> Column:
        pieces = F.filter(F.transform(F.split(text, ","), X.squeeze), lambda p: p != "")
        return F.transform(pieces, X.answer_tokens)

    def score(p: Column) -> Column:
        best = F.transform(
            p["gold"], lambda g: F.array_max(F.transform(p["pred"], lambda t: _pair_f1(t, g)))
        )
        summed = F.aggregate(best, F.lit(0.0), lambda acc, x: acc + x)
        empty = (F.size(p["gold"]) == 0) | (F.size(p["pred"]) == 0)
        return F.when(empty, F.lit(0.0)).otherwise(summed / F.size(p["gold"]))

    return let(F.struct(parts(prediction).alias("pred"), parts(gold).alias("gold")), score)
