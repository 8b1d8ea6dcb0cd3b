"""The interface of language models, a rule-based default, and an account of what each call costs."""

from __future__ import annotations

import math
import re
from collections.abc import Callable
from dataclasses import dataclass, field
from typing import Protocol

from .answer import CHARS_PER_TOKEN

# Tokens of a model's context by a part of its name, the first that fits; and of any other model.
CONTEXT_LIMITS = {"gpt-4.1-nano": 128_000, "gpt-4": 128_000, "gpt-3.5-turbo": 16_385}
DEFAULT_CONTEXT = 8_192
ERROR = "Error: "


def context_limit(model: str) -> int:
    return next((n for part, n in CONTEXT_LIMITS.items() if part in model), DEFAULT_CONTEXT)


def tokens(text: str) -> int:
    return math.ceil(len(text) / CHARS_PER_TOKEN)


class Model(Protocol):
    """Anything that answers a prompt with text. An answer that begins with ERROR is a failure; `ask` itself may raise."""

    name: str

    def ask(self, prompt: str, system: str = "", temperature: float = 0.7, max_tokens: int = 1024, stop: tuple[str, ...] = ()) -> str: ...


@dataclass(frozen=True)
class RuleModel:
    """Answers by the first rule whose pattern the prompt matches; a rule is a pattern and a text or a function of the match."""

    rules: tuple[tuple[str, str | Callable[[re.Match], str]], ...] = ()
    name: str = "rules"

    def ask(self, prompt: str, system: str = "", temperature: float = 0.7, max_tokens: int = 1024, stop: tuple[str, ...] = ()) -> str:
        for pattern, reply in self.rules:
            if m := re.search(pattern, prompt, re.S | re.I):
                text = reply(m) if callable(reply) else reply
                for mark in stop:
                    text = text.split(mark)[0]
                return text[: int(max_tokens * CHARS_PER_TOKEN)]
        return f"{ERROR}no rule answers this prompt"


@dataclass
class Tracked:
    """A model that never raises, with the tokens of every call: (sent, received)."""

    model: Model
    calls: list[tuple[int, int]] = field(default_factory=list)

    @property
    def name(self) -> str:
        return self.model.name

    @property
    def spent(self) -> int:
        return sum(a + b for a, b in self.calls)

    def ask(self, prompt: str, system: str = "", **options) -> str:
        try:
            told = self.model.ask(prompt, system, **options)
        except Exception as error:  # a model's failure is an answer
            told = f"{ERROR}{error}"
        self.calls.append((tokens(prompt) + tokens(system), tokens(told)))
        return told
