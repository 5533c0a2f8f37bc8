"""Questions to answers: retrieval, first gate, prompt, generation, second gate."""

from __future__ import annotations

import math
import re
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from corpusloom.config import Config
from corpusloom.functions import generation as G
from corpusloom.functions.embed import HashedWords, embed_column
from corpusloom.functions.stream import Generator, generate
from corpusloom.functions.text import snippet
from corpusloom.operators import knn
from corpusloom.operators.store import Index


class Extractive:
    """A stand-in without a model: the context's sentence that shares most words with the question, cited. Its tokens are words
    with the white space before them."""

    def encode(self, prompt: str) -> list[str]:
        return re.findall(r"\s*\S+|\s+\Z", prompt)

    def stream(self, tokens: list[str]) -> Iterator[tuple[str, float]]:
        text, logprob = self._best("".join(tokens))
        for piece in self.encode(text):
            yield piece, logprob

    @staticmethod
    def _best(prompt: str) -> tuple[str, float]:
        context, _, question = prompt.partition("Context:\n")[2].rpartition(G.PROMPT_ASK)
        asked = set(re.findall(r"\w+", question.removesuffix(G.PROMPT_END).lower()))
        best, score = "", 0.0
        for block in re.finditer(r"\[(\d+)\] [^\n]*\n(.*?)\n\n(?=\[\d+\] |\Z)", context, re.S):
            for sentence in re.split(r"(?<=[.!?])\s+", block.group(2)):
                told = set(re.findall(r"\w+", sentence.lower()))
                if told and (s := len(told & asked) / math.sqrt(len(told))) > score:
                    best, score = f"{sentence.strip()} [{block.group(1)}]", s
        if not best:
            return G.INSUFFICIENT, 0.0
        return best, math.log(min(1.0, 0.5 + score / (2 * math.sqrt(len(asked) + 1))))


#: The generators that settings can name.
GENERATORS: dict[str, Callable[[], Generator]] = {"extractive": Extractive}


#: Hits up to which they are sent to the chunks, not the chunks to them.
BROADCAST_HITS = 100_000


def answers(
    hits: DataFrame, make: Callable[[], Generator] | None = Extractive, threshold: float = knn.SIMILARITY, confidence: float = G.CONFIDENCE, context: int = G.CONTEXT
) -> DataFrame:
    """(question_id, question, rank, path, content, similarity) to (question_id, is_refusal, reason, confidence, text).

    Questions whose best hit is under the threshold, or that have none (a row with a null rank), are refused before any
    generation; only the others reach the generator, with prompts cut to `context` less what is reserved for the answer. Without
    a generator, and where a prompt has no tokens, the answer is a refusal that says so.
    """
    asked = hits.groupBy("question_id", "question").agg(
        F.max("similarity").alias("top"),
        F.collect_list(F.when(F.col("rank").isNotNull(), F.struct("rank", "path", "content"))).alias("hits"),
    )
    best = F.coalesce(F.col("top"), F.lit(0.0)).cast("double")
    passes = F.coalesce(F.col("top") >= threshold, F.lit(False))
    refused = asked.filter(~passes).select(
        "question_id", F.lit(True).alias("is_refusal"),
        F.format_string("Stage 1 Refusal: Best similarity %.3f < threshold %.3f", best, F.lit(float(threshold))).alias("reason"),
        best.alias("confidence"), F.lit(G.NO_KNOWLEDGE).alias("text"),
    )

    if make is None:
        failed = asked.filter(passes).select(
            "question_id", F.lit(True).alias("is_refusal"), F.lit(G.REASON_NO_MODEL).alias("reason"), F.lit(0.0).alias("confidence"), F.lit(G.NO_MODEL).alias("text")
        )
        return refused.unionByName(failed)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        provider = make()
        for part in batches:
            made = [generate(provider, p, context) for p in part["prompt"]]
            yield pd.DataFrame({"question_id": part["question_id"], "raw": [m.text for m in made], "logprobs": [m.logprobs for m in made]})

    prompts = asked.filter(passes).select("question_id", G.prompt(F.col("hits"), F.col("question")).alias("prompt"))
    made = prompts.mapInPandas(run, f"question_id {dict(hits.dtypes)['question_id']}, raw string, logprobs array<double>")
    mean = F.aggregate("logprobs", F.lit(0.0), lambda s, x: s + x) / F.nullif(F.size("logprobs"), F.lit(0))
    told = made.withColumn("answer", G.answer_text(F.col("raw"))).withColumn("sure", G.confidence(mean))
    no, reason, text = G.stage2(F.col("answer"), F.col("sure"), confidence)
    unread = F.col("raw").isNull()
    return refused.unionByName(told.select(
        "question_id", (unread | no).alias("is_refusal"), F.when(unread, F.lit("")).otherwise(reason).alias("reason"), F.col("sure").alias("confidence"),
        F.when(unread, F.lit(G.NO_PROMPT)).otherwise(text).alias("text"),
    ))


def hits_for(spark: SparkSession, questions: list[str], config: Config, embedder=HashedWords) -> DataFrame:
    """Hits of each question in the index, with content and path; orphans of a deleted document drop out after the top k."""
    index = Index(spark, config.index_path, config.embed_dimension).open()
    asked = spark.createDataFrame(list(enumerate(questions)), "query_id long, question string")
    vectors = asked.withColumn("embedding", embed_column(F.col("question"), embedder, config.embed_dimension))
    chunks, documents = index.chunks(), index.documents()
    near = knn.search(vectors, chunks, config.top_k, vec_id="id")
    near = F.broadcast(near) if len(questions) * config.top_k <= BROADCAST_HITS else near
    return (
        near.join(chunks.select("id", "doc_id", "chunk_idx", "content"), near["vec_id"] == F.col("id")).drop("id")
        .join(documents.select(F.col("id").alias("doc_id"), "path"), "doc_id")
        .join(asked, "query_id", "right")
        .select(F.col("query_id").alias("question_id"), "question", "rank", "doc_id", "chunk_idx", "path", "content", "distance", "similarity")
    )


def ask(spark: SparkSession, questions: list[str], config: Config | None = None, embedder=HashedWords, generator: Callable[[], Generator] | None = None) -> DataFrame:
    """(question_id, is_refusal, reason, confidence, text) per question, by `generator` or the one that the settings name; where
    they name none that there is, questions with hits are refused for it."""
    config = config or Config()
    make = generator or GENERATORS.get(config.gen_model)
    return answers(hits_for(spark, questions, config, embedder), make, config.similarity_threshold, config.confidence_threshold, config.context_length)


def cited(hits: DataFrame, threshold: float = knn.SIMILARITY) -> DataFrame:
    """References to show: hits at or above the threshold, numbered per question, with a snippet."""
    found = knn.references(hits.withColumnRenamed("question_id", "query_id"), threshold)
    return found.select("query_id", "ref", "path", "chunk_idx", G.percent(F.col("similarity")).alias("similarity"), snippet(F.col("content")).alias("snippet"))
