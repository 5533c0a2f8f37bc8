"""What is computed about generated tokens: log-probabilities, confidence, truncation of the distribution, refusals."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from corpusloom.functions import text as X

TOP_K, TOP_P = 40, 0.9
TEMPERATURE, SAMPLE_SEED = 0.7, 1337
CONFIDENCE = 0.50
MAX_NEW_TOKENS = 256
CONTEXT = 4096
#: Tokens of the context that are kept free for the answer.
RESERVED = 128

# Texts of the contract between retrieval and generation.
INSUFFICIENT = "[INSUFFICIENT_DATA]"
PROMPT_HEAD = (
    "<|im_start|>system\n"
    "You are an accurate, honest, and direct AI knowledge assistant.\n"
    "Answer the user's question clearly and concisely using ONLY the verified context snippets below.\n"
    "Cite sources using bracketed references like [1], [2] when stating facts from them.\n"
    "If the context does not contain sufficient information to answer the question, or if you are unsure, "
    'you MUST respond ONLY with "[INSUFFICIENT_DATA]".<|im_end|>\n'
    "<|im_start|>user\n"
    "Context:\n"
)
PROMPT_ASK = "Question: "
PROMPT_END = "<|im_end|>\n<|im_start|>assistant\n<think>\n\n</think>\n\n"
NO_KNOWLEDGE = "I do not have sufficient information in my knowledge base to answer this question."
NO_ANSWER = "The retrieved knowledge does not contain sufficient verified data to answer this question."
REASON_NO_MODEL = "Model context uninitialized"
NO_MODEL = "Error: Model context is not initialized."
NO_PROMPT = "Error: Failed to tokenize input prompt."
REASON_INSUFFICIENT = "Stage 2 Refusal: Model identified insufficient data in context"
REASON_EMPTY = "Stage 2 Refusal: Model produced no grounded response from context"


def token_logprob(logits: Column, chosen: Column) -> Column:
    """Logarithm of the softmax of one logit, by its 0-based index, with the largest taken out first."""
    top = F.array_max(logits).cast("double")
    total = F.aggregate(logits, F.lit(0.0), lambda s, x: s + F.exp(x.cast("double") - top))
    return F.element_at(logits, (chosen + 1).cast("int")).cast("double") - top - F.log(total)


def confidence(mean_logprob: Column) -> Column:
    """exp of the mean, within 0 and 1; 0 without tokens."""
    return F.when(mean_logprob.isNull(), F.lit(0.0)).otherwise(F.greatest(F.lit(0.0), F.least(F.lit(1.0), F.exp(mean_logprob))))


def truncated_distribution(logits: DataFrame, key: str = "key", token: str = "token", logit: str = "logit", top_k: int = TOP_K, top_p: float = TOP_P) -> DataFrame:
    """(key, token, rank, logit, p) of the tokens that stay: the top_k by logit, then those before which less than top_p of the
    mass lies, the first in any case. p is over the top_k."""
    by = Window.partitionBy(key)
    ranked = logits.withColumn("rank", F.row_number().over(by.orderBy(F.desc(logit), token))).filter(F.col("rank") <= top_k)
    e = ranked.withColumn("e", F.exp(F.col(logit).cast("double") - F.max(F.col(logit).cast("double")).over(by)))
    p = e.withColumn("p", F.col("e") / F.sum("e").over(by))
    before = F.coalesce(F.sum("p").over(by.orderBy("rank").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0.0))
    return p.withColumn("before", before).filter((F.col("rank") == 1) | (F.col("before") < top_p)).select(key, token, "rank", F.col(logit).alias("logit"), "p")


def uniform(*parts: Column | str | int) -> Column:
    """A number from 0 up to 1 that the parts alone decide: the first 52 bits of the MD5 of their texts, joined by colons. Drawn
    anew, in any order and on any executor, it is the same."""
    texts = [p.cast("string") if isinstance(p, Column) else F.lit(str(p)) for p in parts]
    return F.conv(F.substring(F.md5(F.concat_ws(":", *texts)), 1, 13), 16, 10).cast("double") / F.lit(float(1 << 52))


def sampled_token(kept: DataFrame, key: str = "key", step: str | None = None, temperature: float = TEMPERATURE, seed: int = SAMPLE_SEED) -> DataFrame:
    """(key, token, rank, p, u): of each sequence's tokens that truncation kept (key, token, rank, logit), the one that a
    seeded draw takes, with its probability and the draw.

    Logits are divided by the temperature, and the token is the first in order of rank whose probabilities, added up, exceed
    the draw. The draw belongs to (seed, key, step), step being a column of `kept` or 0, so reruns agree.
    """
    by = Window.partitionBy(key)
    ranked = kept.withColumn("u", uniform(seed, F.col(key), 0 if step is None else F.col(step)))
    warm = F.col("logit").cast("double") / temperature
    whole = by.orderBy("rank").rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)  # one order of adding up, to the last digit
    p = ranked.withColumn("e", F.exp(warm - F.max(warm).over(by))).withColumn("p", F.col("e") / F.sum("e").over(whole))
    upto = p.withColumn("upto", F.sum("p").over(by.orderBy("rank").rowsBetween(Window.unboundedPreceding, 0)))
    # Rounding may leave the whole sum under a draw close to 1: then the last token is it.
    taken = upto.withColumn("last", F.max("rank").over(by)).filter(((F.col("upto") > F.col("u")) & (F.col("upto") - F.col("p") <= F.col("u"))) | ((F.col("rank") == F.col("last")) & (F.col("upto") <= F.col("u"))))
    return taken.select(key, "token", "rank", "p", "u")


def truncated_tokens(tokens: Column, context: int) -> Column:
    """The first tokens of a prompt that leave room for an answer."""
    return F.slice(tokens, F.lit(1), F.lit(max(0, context - RESERVED)))


def answer_text(generated: Column) -> Column:
    """Cut at the first stop sequence, thinking removed, trailing white space trimmed."""
    return X.think_strip(X.stop_cut(generated))


def stage2(answer: Column, sure: Column, threshold: float = CONFIDENCE) -> tuple[Column, Column, Column]:
    """(refused, reason, text): refused for the marker, then for an empty answer, then for too little confidence."""
    marked, empty, unsure = answer.contains(INSUFFICIENT), answer == "", sure < threshold
    unsure_reason = F.format_string("Stage 2 Refusal: Mean token confidence %.2f < threshold %.2f", sure.cast("double"), F.lit(float(threshold)))
    reason = F.when(marked, F.lit(REASON_INSUFFICIENT)).when(empty, F.lit(REASON_EMPTY)).when(unsure, unsure_reason)
    return marked | empty | unsure, reason, F.when(marked | empty | unsure, F.lit(NO_ANSWER)).otherwise(answer)


def prompt(hits: Column, question: Column) -> Column:
    """`hits`: array<struct(rank, path, content)>; all of them are numbered, in the order of rank."""
    parts = F.transform(
        F.array_sort(hits), lambda h, i: F.concat(F.lit("["), (i + 1).cast("string"), F.lit("] "), h["path"], F.lit("\n"), h["content"], F.lit("\n\n"))
    )
    return F.concat(F.lit(PROMPT_HEAD), F.array_join(parts, ""), F.lit(PROMPT_ASK), question, F.lit(PROMPT_END))


def percent(similarity: Column) -> Column:
    return F.format_string("%.1f%%", (similarity * 100).cast("double"))


def confidence_percent(sure: Column) -> Column:
    return F.greatest(F.lit(0), F.least(F.lit(100), (sure * 100).cast("int")))
