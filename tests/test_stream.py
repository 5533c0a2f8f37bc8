import random

import pytest

from corpusloom.config import Config
from corpusloom.functions import generation as G
from corpusloom.functions.stream import Stops, fitting, generate
from corpusloom.functions.text import STOPS
from corpusloom.plans.ask import Extractive, answers, ask
from corpusloom.plans.ingest import ingest


class Told:
    """Says given pieces, and remembers the prompt."""

    def __init__(self, pieces):
        self.pieces = pieces

    def encode(self, prompt):
        return prompt.split()

    def stream(self, tokens):
        self.prompt = tokens
        for k, p in enumerate(self.pieces):
            self.said = k + 1
            yield p, -float(k + 1)


def test_stops_across_pieces():
    draw = random.Random(4)
    for _ in range(400):
        text = "".join(draw.choice(["\n", "User", ":", "---", "<|im", "_end|>", "_start|>", "x", "Human", "\n-", "<", "|"]) for _ in range(12))
        pieces, at = [], 0
        while at < len(text):
            step = draw.randint(1, 5)
            pieces.append(text[at : at + step])
            at += step
        ends = [(text.find(s) + len(s), text.find(s)) for s in STOPS if s in text]
        found, stops = None, Stops()
        for p in pieces:
            found = stops.feed(p)
            if found is not None:
                break
        assert found == (min(ends)[1] if ends else None), text
    assert Stops([]).feed("anything") is None


def test_text_and_confidence_end_at_one_token():
    told = Told(["One ", "two<|im", "_end|> gone", "never"])
    assert generate(told, "p", 4096) == ("One two", [-1.0, -2.0, -3.0]) and told.said == 3
    told = Told(["a "] * 300)
    text, logprobs = generate(told, "p", 4096)
    assert len(logprobs) == G.MAX_NEW_TOKENS == text.count("a") and told.said == G.MAX_NEW_TOKENS
    assert generate(Told(["x"]), "", 4096) == (None, []) and generate(Told([]), "p", 4096) == ("", [])


def test_prompts_fit_the_context():
    told = Told(["x"])
    generate(told, " ".join(map(str, range(1000))), 500)
    assert told.prompt == list(map(str, range(500 - G.RESERVED))) and fitting([1, 2], 100) == []


HITS = "question_id long, question string, rank int, path string, content string, similarity double"


def test_no_model_and_no_tokens(spark):
    hits = spark.createDataFrame([(0, "q", 1, "p", "c", 0.9), (1, "q", 1, "p", "c", 0.1)], HITS)
    found = {r["question_id"]: r for r in answers(hits, None).collect()}
    assert (found[0]["is_refusal"], found[0]["reason"], found[0]["text"]) == (True, "Model context uninitialized", "Error: Model context is not initialized.")
    assert found[1]["reason"].startswith("Stage 1 Refusal")
    cut = {r["question_id"]: r for r in answers(hits, Extractive, context=G.RESERVED).collect()}
    assert cut[0]["is_refusal"] and cut[0]["text"] == "Error: Failed to tokenize input prompt." and cut[0]["confidence"] == 0.0


def test_context_length_and_model_name_reach_the_answer(spark, tmp_path):
    (tmp_path / "in").mkdir()
    (tmp_path / "in" / "a.txt").write_text("Apples grow on trees in the orchard.")
    c = dict(index_path=f"file://{tmp_path}/kb", embed_dimension=64, similarity_threshold=0.1, confidence_threshold=0.1)
    ingest(spark, str(tmp_path / "in"), Config(**c))
    one = lambda **more: ask(spark, ["Where do apples grow"], Config(**c, **more)).first()
    assert "Apples grow on trees" in one()["text"]
    # So short a context that the question is cut off: the stand-in finds nothing to answer.
    assert one(context_length=G.RESERVED + 60)["reason"] == G.REASON_INSUFFICIENT
    assert one(gen_model="models/none.gguf")["reason"] == "Model context uninitialized"


@pytest.mark.parametrize("text", ["", "a", " a  b\n", "\n"])
def test_stand_in_tokens_give_the_text_back(text):
    assert "".join(Extractive().encode(text)) == text
