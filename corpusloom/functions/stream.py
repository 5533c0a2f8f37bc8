"""Generation token by token: a prompt cut to the context, and a stream of tokens that a stop sequence or a limit ends."""

from __future__ import annotations

from collections import deque
from collections.abc import Iterable, Iterator
from itertools import islice
from typing import NamedTuple, Protocol

from corpusloom.functions.generation import MAX_NEW_TOKENS, RESERVED
from corpusloom.functions.text import STOPS


class Generator(Protocol):
    """Made in each worker."""

    def encode(self, prompt: str) -> list:
        """The tokens of a prompt."""

    def stream(self, tokens: list) -> Iterator[tuple[str, float]]:
        """The text and log-probability of one token after the other, up to but without the one that ends the text."""


class Stops:
    """Finds the first of several sequences in a text that comes in pieces, wherever pieces meet: one step a character."""

    def __init__(self, stops: Iterable[str] = STOPS) -> None:
        self.next: list[dict[str, int]] = [{}]
        self.size = [0]  # of the stop that ends in a state, 0 for none
        for stop in stops:
            at = 0
            for c in stop:
                if c not in self.next[at]:
                    self.next[at][c] = len(self.next)
                    self.next.append({})
                    self.size.append(0)
                at = self.next[at][c]
            self.size[at] = len(stop)
        self.back = [0] * len(self.next)  # the state of the longest end of a state's text that begins a stop too
        queue = deque(self.next[0].values())
        while queue:
            at = queue.popleft()
            for c, to in self.next[at].items():
                self.back[to] = self._step(self.back[at], c)
                self.size[to] = self.size[to] or self.size[self.back[to]]
                queue.append(to)
        self.state = self.read = 0

    def _step(self, at: int, c: str) -> int:
        while at and c not in self.next[at]:
            at = self.back[at]
        return self.next[at].get(c, 0)

    def feed(self, piece: str) -> int | None:
        """Where the first stop begins, counted from the first piece, once it is complete."""
        for c in piece:
            self.state, self.read = self._step(self.state, c), self.read + 1
            if self.size[self.state]:
                return self.read - self.size[self.state]
        return None


class Generated(NamedTuple):
    #: None where the prompt has no tokens.
    text: str | None
    logprobs: list[float]


def fitting(tokens: list, context: int) -> list:
    """The first tokens of a prompt, such that RESERVED of the context stay free for the answer."""
    return tokens[: max(0, context - RESERVED)]


def generate(generator: Generator, prompt: str, context: int, limit: int = MAX_NEW_TOKENS, stops: Iterable[str] = STOPS) -> Generated:
    """Text and log-probabilities of the same tokens: of those up to the one that completes a stop sequence, it included, or of
    `limit`. The text ends before the stop."""
    tokens = fitting(generator.encode(prompt), context)
    if not tokens:
        return Generated(None, [])
    found, pieces, logprobs = Stops(stops), [], []
    for piece, logprob in islice(generator.stream(tokens), limit):
        pieces.append(piece)
        logprobs.append(logprob)
        if (at := found.feed(piece)) is not None:
            return Generated("".join(pieces)[:at], logprobs)
    return Generated("".join(pieces), logprobs)
