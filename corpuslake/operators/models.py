"""Protocols of the models that the engine can be given, and stand-ins that need no network."""

from __future__ import annotations

import hashlib
import re
import threading
import time
from collections.abc import Callable, Sequence
from typing import Protocol

import pandas as pd
from pyspark.sql import DataFrame


class Embedder(Protocol):
    dimensions: int

    def embed(self, texts: Sequence[str]) -> list[list[float] | None]: ...


class ChatModel(Protocol):
    def chat(self, prompt: str, system: str = "") -> str: ...


class HashingEmbedder:
    """Signed feature hashing of words: deterministic, offline, no claim to meaning."""

    def __init__(self, dimensions: int = 64):
        self.dimensions = dimensions

    def embed(self, texts: Sequence[str]) -> list[list[float] | None]:
        out = []
        for t in texts:
            v = [0.0] * self.dimensions
            for word in re.findall(r"\w+", (t or "").lower()):
                d = hashlib.blake2b(word.encode(), digest_size=8).digest()
                v[int.from_bytes(d[:4], "little") % self.dimensions] += 1.0 if d[4] & 1 else -1.0
            out.append(v)
        return out


class ScriptedChat:
    """Answers from a table of prompt patterns; the first that matches, else a default."""

    def __init__(self, answers: dict[str, str], default: str = ""):
        self.answers, self.default = answers, default

    def chat(self, prompt: str, system: str = "") -> str:
        return next((a for p, a in self.answers.items() if re.search(p, prompt)), self.default)


class Limiter:
    """A least interval between calls of one process."""

    def __init__(self, seconds: float = 0.2):
        self.seconds, self.last, self.lock = seconds, 0.0, threading.Lock()

    def wait(self) -> None:
        with self.lock:
            pause = self.last + self.seconds - time.monotonic()
            if pause > 0:
                time.sleep(pause)
            self.last = time.monotonic()


def with_retries(call: Callable[[], str], tries: int = 3, pause: float = 1.0) -> str:
    """Tries with pauses that double."""
    for i in range(tries):
        try:
            return call()
        except Exception:
            if i == tries - 1:
                raise
            time.sleep(pause * 2**i)
    raise AssertionError("unreachable")


def embed(chunks: DataFrame, model: Embedder, batch: int = 64) -> DataFrame:
    """chunks with embeddings, in batches; a batch that fails is tried text by text, a text that fails gets null."""

    def run(frames):
        for frame in frames:
            out: list = []
            texts = frame["chunk_text"].tolist()
            for i in range(0, len(texts), batch):
                part = texts[i : i + batch]
                try:
                    out += model.embed(part)
                except Exception:
                    for t in part:
                        try:
                            out += model.embed([t])
                        except Exception:
                            out.append(None)
            yield pd.DataFrame({"path": frame["path"], "chunk_index": frame["chunk_index"], "chunk_text": frame["chunk_text"], "embedding": out})

    return chunks.select("path", "chunk_index", "chunk_text").mapInPandas(run, "path string, chunk_index int, chunk_text string, embedding array<float>")


def classify(text: str, names: Sequence[str], model: ChatModel, most: int = 1500) -> list[str]:
    """Which of the known names the model's answer on the first characters contains, two at most."""
    answer = model.chat("Choose a category for this note from: " + ", ".join(names) + "\n\n" + text[:most])
    return [n for n in names if n in answer][:2]


def synthesis_prompt(theme: str, notes: Sequence[tuple[str, str]], wish: str = "") -> str:
    """Theme, wish and up to 30 notes of 1200 characters."""
    parts = [f"Theme: {theme}", *([f"Request: {wish}"] if wish else [])]
    return "\n\n".join(parts + [f"## {p}\n{c[:1200]}" for p, c in list(notes)[:30]])
