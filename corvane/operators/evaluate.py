"""Retrieval quality: scores by token overlap, pass rule, averages, strategies side by side."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions.text import tokens

METRICS = ("faithfulness", "answer_relevancy", "context_recall")
# Fixed value: what every score has to exceed.
PASS = 0.75


def overlap(of: Column, within: Column) -> Column:
    """Share of the distinct tokens of one text that another holds; null if there are none."""
    own = F.array_distinct(tokens(of))
    return F.when(F.size(own) > 0, F.size(F.array_intersect(own, tokens(within))) / F.size(own))


def scored(samples: DataFrame) -> DataFrame:
    """Adds METRICS to (question, ground_truth, answer, contexts): lexical stand-ins for judged scores."""
    seen = F.array_join("contexts", "\n")
    return samples.withColumns({"faithfulness": overlap(F.col("answer"), seen), "answer_relevancy": overlap(F.col("question"), F.col("answer")), "context_recall": overlap(F.col("ground_truth"), seen)})


def mean(column: str) -> Column:
    """Mean without nulls and NaN."""
    return F.avg(F.when(~F.isnan(column), F.col(column)))


def averages(scores: DataFrame) -> DataFrame:
    return scores.agg(*[mean(m).alias(m) for m in METRICS])


def passed(scores: DataFrame) -> DataFrame:
    """Adds overall (mean of the three) and passed (each above PASS); missing scores count 0."""
    filled = scores.withColumns({m: F.coalesce(m, F.lit(0.0)) for m in METRICS})
    return filled.withColumn("overall", (F.col(METRICS[0]) + F.col(METRICS[1]) + F.col(METRICS[2])) / 3).withColumn("passed", (F.col(METRICS[0]) > PASS) & (F.col(METRICS[1]) > PASS) & (F.col(METRICS[2]) > PASS))


def by_strategy(scores: DataFrame, column: str = "context_recall") -> DataFrame:
    """(strategy, mean, scored, n): NaN and nulls aren't scored."""
    return scores.groupBy("strategy").agg(mean(column).alias("mean"), F.count(F.when(~F.isnan(column), F.col(column))).alias("scored"), F.count(F.lit(1)).alias("n"))


def results_view(tests: DataFrame, scores: DataFrame) -> DataFrame:
    """Test cases with their scores by ordinal case_no; tests without scores have zeros."""
    return passed(tests.join(scores, "case_no", "left"))


def percent(score: Column) -> Column:
    """A score as text, in percent with one decimal; missing ones are 0.0%."""
    return F.format_string("%.1f%%", F.round(F.coalesce(score, F.lit(0.0)) * 100, 1))


#: What a dashboard can be sorted by, the first six as columns of its table.
SORTS = ("question", "answer_length", *METRICS, "passed", "overall")


def dashboard(tests: DataFrame, order: list[tuple[str, bool]]) -> DataFrame:
    """Rows of passed(...) with answer_length, scores as percents, and place by ``order``: (one of SORTS, ascending), the first the most important. Ties go by question."""
    unknown = [k for k, _ in order if k not in SORTS]
    if unknown:
        raise ValueError(f"no such sort: {unknown}")
    rows = tests.withColumn("answer_length", F.length(F.coalesce("answer", F.lit(""))))
    keys = [F.col(k).asc_nulls_last() if up else F.col(k).desc_nulls_last() for k, up in order]
    placed = rows.withColumn("place", F.row_number().over(Window.orderBy(*keys, F.col("question"))))  # a dashboard's tests, as many as a person looks at
    return placed.withColumns({m: percent(F.col(m)) for m in (*METRICS, "overall")})


def samples(spark: SparkSession, pairs: list[tuple[str, str]]) -> DataFrame:
    """(case_no, question, ground_truth) of a list of questions with their expected answers."""
    return spark.createDataFrame([(i, q, t) for i, (q, t) in enumerate(pairs)], "case_no long, question string, ground_truth string")


def run(tests: DataFrame, chunks: DataFrame, **settings) -> DataFrame:
    """scored samples of (case_no, question, ground_truth): each question goes through retrieve, the contexts are its chunks by rank, the answer is the extractive one."""
    from .retrieve import answers, retrieve

    asked = tests.select(F.col("case_no").alias("qid"), "question")
    found = retrieve(asked, chunks, **settings)
    texts = found.select("qid", "rank", "chunk_no").join(chunks.select("chunk_no", "content"), "chunk_no").groupBy("qid").agg(F.transform(F.array_sort(F.collect_list(F.struct("rank", "content"))), lambda x: x["content"]).alias("contexts"))
    said = answers(asked, found, chunks).select("qid", "answer")
    joined = tests.join(texts.withColumnRenamed("qid", "case_no"), "case_no", "left").join(said.withColumnRenamed("qid", "case_no"), "case_no", "left")
    return scored(joined.withColumns({"contexts": F.coalesce("contexts", F.array().cast("array<string>")), "answer": F.coalesce("answer", F.lit(""))}))


def ablation(tests: DataFrame, chunks: DataFrame, strategies: tuple[str, ...] = ("single", "fusion"), **settings) -> DataFrame:
    """(strategy, metric, mean, scored, n) of run with each strategy, without reranking unless asked for."""
    out = None
    for name in strategies:
        rows = run(tests, chunks, **{"rerank": False} | settings | {"strategy": name})
        for m in ("faithfulness", "context_recall"):
            one = by_strategy(rows.withColumn("strategy", F.lit(name)), m).withColumn("metric", F.lit(m)).select("strategy", "metric", "mean", "scored", "n")
            out = one if out is None else out.unionByName(one)
    return out


def column_mean(df: DataFrame, names: list[str]) -> DataFrame:
    """(mean, scored) of the first of the columns that there is; NaN and 0 if there is none."""
    own = next((c for c in names if c in df.columns), None)
    if own is None:
        return df.sparkSession.createDataFrame([(float("nan"), 0)], "mean double, scored long")
    return df.agg(mean(own).alias("mean"), F.count(F.when(~F.isnan(own), F.col(own))).alias("scored"))


def next_run_state(state: str, event: str) -> str:
    """idle, running, completed or failed after an event; a start while running is an error."""
    if event == "start":
        if state == "running":
            raise RuntimeError("an evaluation is already running")
        return "running"
    return {"finish": "completed", "fail": "failed"}[event]
