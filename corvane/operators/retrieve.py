"""Questions to ranked chunks: expansion, sparse, dense and path search, fusion, reranking, one corrective retry."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.text import dense_text, file_references, path_suffixes, slashed, sparse_text
from ..sources.shared import kept
from . import providers
from .dense import cosine_top
from .ranking import expansions, fuse, merge_prioritized, top
from .sparse import BROADCAST_ROWS, SparseIndex, bm25, small

# Results, candidates, candidates of each list, and what each retry adds.
TOP_K, POOL, LIST_K, MORE_K, MORE_POOL = 5, 20, 20, 3, 20
KEY = ["file_path", "start_line", "end_line"]
#: Chunks of the judge's preview.
PREVIEW = 4


def joined(results: DataFrame, texts: DataFrame, key: str = "chunk_no") -> DataFrame:
    """results with the columns of texts. The results are written once, and sent to all tasks if they are few, so that the texts stay where they are read."""
    return small(kept(results)).join(texts, key)


def path_search(questions: DataFrame, chunks: DataFrame, k: int = LIST_K) -> DataFrame:
    """(qid, chunk columns, rank) of files that a question names; by line, then path. Paths are found by their ends, an equi-join."""
    each = questions.select("qid", F.explode(file_references(F.col("question"))).alias("ref"))
    refs = F.broadcast(each.distinct()) if each.limit(BROADCAST_ROWS + 1).count() <= BROADCAST_ROWS else each.distinct()
    ends = chunks.select("*", F.explode(path_suffixes(F.col("file_path"))).alias("ref"))
    found = ends.join(refs, "ref").drop("ref").dropDuplicates(["qid", "chunk_no"])
    return top(found, ["qid"], [F.col("start_line"), slashed(F.col("file_path")), F.col("end_line"), F.col("chunk_no")], k)


@dataclass
class Stored:
    """What an index run keeps of chunks: their sparse index by chunk_no, and (chunk_no, vector)."""

    sparse: SparseIndex
    vectors: DataFrame


def vectors_of(chunks: DataFrame) -> DataFrame:
    """(chunk_no, vector) of chunks."""
    return providers.embed(chunks, "chunk_no", dense_text(F.col("context_prefix"), F.col("content")), "vector")


def sparse_texts(chunks: DataFrame) -> DataFrame:
    """(chunk_no, text): what is indexed of chunks for sparse search."""
    return chunks.select("chunk_no", sparse_text(F.col("context_prefix"), F.col("content")).alias("text"))


def candidates(questions: DataFrame, chunks: DataFrame, strategy: str = "fusion", list_k: int = LIST_K, stored: Stored | None = None) -> DataFrame:
    """Ranked lists (qid, list_no, rank, chunk_no) of every question: 0 path, then dense, then sparse ones by variant. With stored indexes chunks are read for paths alone."""
    generated = providers.expand(F.col("question")) if strategy != "single" else F.array().cast("array<string>")
    variants = expansions(questions.select("qid", "question", generated.alias("generated"))).withColumn("vq", F.xxhash64("qid", "variant"))
    queries = providers.embed(variants, "vq", F.col("query"), "vector")
    dense = cosine_top(queries, stored.vectors if stored else vectors_of(chunks), list_k, "vq", "chunk_no", "vector").where("score > 0")
    asked = variants.select("vq", "query")
    sparse = stored.sparse.search(asked, list_k, "vq") if stored else bm25(sparse_texts(chunks), asked, list_k, "chunk_no", "text", "vq", "query")
    both = dense.select("vq", F.lit(1).alias("first"), "rank", "chunk_no").unionByName(sparse.select("vq", F.lit(50).alias("first"), "rank", "chunk_no"))
    listed = both.join(variants.select("vq", "qid", "variant"), "vq").select("qid", (F.col("first") + F.col("variant")).cast("int").alias("list_no"), "rank", "chunk_no")
    named = path_search(questions, chunks, list_k).select("qid", F.lit(0).alias("list_no"), "rank", "chunk_no")
    return named.unionByName(listed)


def retrieve(questions: DataFrame, chunks: DataFrame, top_k: int = TOP_K, pool: int = POOL, rerank: bool = True, strategy: str = "fusion", attempt: int = 0, stored: Stored | None = None, reranker: Column | None = None) -> DataFrame:
    """(qid, rank, chunk_no, file_path, start_line, end_line, fused_score, rerank_score, src) of the chunks for each question.

    questions: (qid, question); chunks: (chunk_no, file_path, start_line, end_line, content,
    context_prefix), one row a chunk. Each attempt widens pool and top_k. Chunks of files that the
    question names (src 0) stand before the others, by line. Any strategy but ``single`` expands.
    reranker: a score of the columns question and content, such as providers.first_of; where it is
    null the fused order stays.
    """
    top_k, pool = top_k + MORE_K * attempt, pool + MORE_POOL * attempt
    fused = fuse(candidates(questions, chunks, strategy, stored=stored), ["qid"], ["chunk_no"])
    held = top(fused.drop("fused_rank"), ["qid"], [F.col("fused_score").desc(), F.col("chunk_no")], pool, "fused_rank")
    full = joined(held, chunks).join(questions, "qid")
    score = (providers.coverage(F.col("question"), F.col("content")) if reranker is None else reranker) if rerank else F.lit(None).cast("double")
    order = [F.round("rerank_score", 6).desc_nulls_last(), F.col("fused_rank")]
    ordinary = top(full.withColumn("rerank_score", score), ["qid"], order, top_k)
    keep = ["qid", "rank", "chunk_no", *KEY, "fused_score", "rerank_score"]
    named = path_search(questions, chunks).withColumn("fused_score", F.lit(None).cast("double")).withColumn("rerank_score", F.lit(None).cast("double"))
    return merge_prioritized(named.select(*keep), ordinary.select(*keep), ["qid"], ["chunk_no"], top_k).select(*keep, "src")


def judged(questions: DataFrame, results: DataFrame, chunks: DataFrame) -> DataFrame:
    """(qid, verdict) of every question on the preview of its results, which may be empty."""
    best = joined(results.where(F.col("rank") <= PREVIEW).select("qid", "rank", "chunk_no"), chunks.select("chunk_no", "content"))
    shown = best.groupBy("qid").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("rank", "content"))), lambda x: x["content"]), "\n").alias("preview"))
    return questions.join(shown, "qid", "left").select("qid", providers.judge(F.col("question"), F.coalesce("preview", F.lit(""))).alias("verdict"))


def corrective(questions: DataFrame, chunks: DataFrame, **settings) -> DataFrame:
    """retrieve with one retry: questions whose first results are judged exactly NO are asked again, wider. Adds attempt.

    The first results, top_k rows a question, are written once where the session has a shared
    folder (see sources.shared); they stay until that folder is cleaned.
    """
    first = kept(retrieve(questions, chunks, **settings))
    refused = kept(judged(questions, first, chunks).where(F.col("verdict") == "NO").select("qid"))
    second = retrieve(questions.join(refused, "qid", "left_semi"), chunks, **settings | {"attempt": 1})
    return first.join(refused, "qid", "left_anti").withColumn("attempt", F.lit(0)).unionByName(second.withColumn("attempt", F.lit(1)))


def context(results: DataFrame, chunks: DataFrame) -> DataFrame:
    """(qid, context): the prompt's excerpts in rank order, each under its file and line."""
    full = joined(results.select("qid", "rank", "chunk_no"), chunks)
    piece = F.concat(F.lit("File: "), "file_path", F.lit(" (line "), F.col("start_line").cast("string"), F.lit(")\n"), "content")
    return full.groupBy("qid").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("rank", piece.alias("p")))), lambda x: x["p"]), "\n\n---\n\n").alias("context"))


def messages(questions: DataFrame, contexts: DataFrame, system: str, history: DataFrame | None = None) -> DataFrame:
    """(qid, position, role, content): what a generator is asked. The system's prompt, the turns of history (qid, position, role, text) in order, then the question below its context."""
    asked = questions.join(contexts, "qid", "left").select("qid", F.concat(F.lit("Context chunks from the repository:\n"), F.coalesce("context", F.lit("")), F.lit("\n\nQuestion: "), "question").alias("content"))
    none = F.array().cast("array<struct<position:int,role:string,content:string>>")
    turn = F.struct(F.col("position").cast("int").alias("position"), "role", F.col("text").alias("content"))
    turns = asked.withColumn("turns", none) if history is None else asked.join(history.groupBy("qid").agg(F.array_sort(F.collect_list(turn)).alias("turns")), "qid", "left")
    one = lambda role, content: F.array(F.struct(F.lit(0).alias("position"), F.lit(role).alias("role"), content.alias("content")))
    whole = F.concat(one("system", F.lit(system)), F.coalesce("turns", none), one("user", F.col("content")))
    return turns.select("qid", F.posexplode(whole).alias("position", "m")).select("qid", "position", "m.role", "m.content")


def sources(results: DataFrame, chunks: DataFrame) -> DataFrame:
    """(qid, sources): of each result, in rank order, the five fields that a client is shown."""
    full = joined(results.select("qid", "rank", "chunk_no", F.coalesce("rerank_score", "fused_score").alias("relevance_score")), chunks)
    item = F.struct("rank", "file_path", F.col("start_line").cast("int").alias("start_line"), F.col("end_line").cast("int").alias("end_line"), "context_prefix", "relevance_score")
    return full.groupBy("qid").agg(F.transform(F.array_sort(F.collect_list(item)), lambda x: x.dropFields("rank")).alias("sources"))


def answers(questions: DataFrame, results: DataFrame, chunks: DataFrame) -> DataFrame:
    """(qid, answer, citations): an extractive answer, the best line of each chunk in rank order; lines count from 1. Without results: empty."""
    full = joined(results.select("qid", "rank", "chunk_no"), chunks).join(questions, "qid")
    line = providers.best_line(F.col("question"), F.col("content"))
    item = F.struct("rank", line.alias("snippet"), F.col("file_path").alias("file"), (F.col("start_line") + 1).alias("line"))
    made = full.groupBy("qid").agg(F.array_sort(F.collect_list(item)).alias("items"))
    return questions.select("qid").join(made, "qid", "left").select("qid", F.coalesce(F.array_join(F.transform("items", lambda x: x["snippet"]), "\n"), F.lit("")).alias("answer"), F.coalesce(F.transform("items", lambda x: F.struct(x["file"].alias("file"), x["line"].cast("int").alias("line"), x["snippet"].alias("snippet"))), F.array().cast("array<struct<file:string,line:int,snippet:string>>")).alias("citations"))


def response_events(asked: DataFrame) -> DataFrame:
    """(request_id, seq, event, payload): what a client sees of (request_id, session_id, answer, citations, sources): session, answer chunks by line, citations, sources, end."""
    lines = F.filter(F.split("answer", "\n"), lambda x: x != "")
    made = F.concat(
        F.array(F.struct(F.lit("session_id").alias("event"), F.to_json(F.struct("session_id")).alias("payload"))),
        F.transform(lines, lambda x: F.struct(F.lit("answer_chunk").alias("event"), F.to_json(F.struct(x.alias("text"))).alias("payload"))),
        F.array(F.struct(F.lit("citations").alias("event"), F.to_json(F.struct("citations")).alias("payload")), F.struct(F.lit("sources").alias("event"), F.to_json(F.struct("sources")).alias("payload")), F.struct(F.lit("done").alias("event"), F.lit("[DONE]").alias("payload"))),
    )
    return asked.select("request_id", F.posexplode(made).alias("seq", "e")).select("request_id", "seq", "e.event", "e.payload")
