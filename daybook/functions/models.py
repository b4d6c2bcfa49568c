"""Deterministic stand-ins for models: what a test or a bench plugs in."""

from __future__ import annotations

import hashlib
import json

import numpy as np
import pandas as pd


def first_words_llm(requests: pd.DataFrame) -> pd.Series:
    """A digest whose summary is the prompt's first words and whose mood is what was asked for, with text around the JSON as models have it."""

    def one(system: str, prompt: str, max_tokens: int, temperature: float) -> str:
        d = {"summary": " ".join(prompt.split()[:6]), "events": [prompt.split("\n")[-1][:20]], "agreements": [], "tasks": [f"слов {len(prompt.split())}"], "ideas": [], "mood": f"{len(system)} {max_tokens} {temperature:.1f}"}
        return "Вот ответ: " + json.dumps(d, ensure_ascii=False) + " конец"

    return pd.Series([one(*r) for r in zip(requests["system"], requests["prompt"], requests["max_tokens"], requests["temperature"], strict=True)], dtype=object)


def hash_embedder(texts: pd.Series) -> pd.Series:
    """64 numbers from the hashes of the words: texts that share words are near."""

    def one(text: str) -> list[float]:
        v = np.zeros(64)
        for word in text.lower().split():
            h = hashlib.blake2b(word.encode(), digest_size=8).digest()
            v[h[0] % 64] += 1 if h[1] % 2 else -1
        return v.astype(float).tolist()

    return texts.map(one)


def length_embedder(texts: pd.Series) -> pd.Series:
    """16 numbers: how many words have a length of k, k + 16, ..: SQL can make them too."""
    return texts.map(lambda text: np.bincount([len(w) % 16 for w in text.split()], minlength=16).astype(float).tolist())


def citing_llm(requests: pd.DataFrame) -> pd.Series:
    """Answers that cite the first source, if there is one, and name what was asked for."""
    asked = requests["system"].map(len).astype(str) + " " + requests["max_tokens"].astype(str) + " " + requests["temperature"].map("{:.1f}".format)
    return requests["prompt"].map(lambda p: "Ответ [1]. " if "\n[1] (" in p else "В дневнике этого не нашлось. ") + asked
