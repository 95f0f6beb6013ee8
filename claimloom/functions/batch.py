"""Support scorers that work on batches of texts in Python, beside those that are Columns.

A batch scorer is a maker: called once by each worker it returns a function of three lists of texts, so what it loads (a model, a
vocabulary) is loaded once a task and texts come in Arrow batches. register_batch() puts it into the same registry as
the Column scorers; scorer(), its aliases and provided_or() take both alike.
"""

from __future__ import annotations

import math
import re
from collections import Counter
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

from .support import register

Score = Callable[[list[str], list[str], list[str]], list[float]]


def as_columns(make: Callable[[], Score]) -> Callable[[Column, Column, Column], Column]:
    def scored(batches: Iterator[tuple[pd.Series, pd.Series, pd.Series]]) -> Iterator[pd.Series]:
        score = make()
        for texts in batches:
            yield pd.Series(score(*(t.fillna("").tolist() for t in texts)), dtype="float64")

    def columns(question: Column, answer: Column, context: Column) -> Column:
        return F.pandas_udf(scored, "double")(*(F.coalesce(c, F.lit("")) for c in (question, answer, context)))

    return columns


def register_batch(name: str, make: Callable[[], Score]) -> None:
    register(name, as_columns(make))


def trigram_profile() -> Score:
    """Cosine of the counts of three characters in a row of answer and context, in lower case; 0 if either has none."""

    def profile(text: str) -> Counter:
        t = text.lower()
        return Counter(t[i : i + 3] for i in range(len(t) - 2))

    def one(answer: str, context: str) -> float:
        a, c = profile(answer), profile(context)
        norm = math.sqrt(sum(v * v for v in a.values())) * math.sqrt(sum(v * v for v in c.values()))
        return min(1.0, sum(v * c[k] for k, v in a.items()) / norm) if norm else 0.0

    return lambda questions, answers, contexts: list(map(one, answers, contexts))


#: grams of contexts that a worker keeps counted
MOST_GRAMS = 500_000


def ascii_ngrams(most: int = MOST_GRAMS) -> Score:
    """Cosine of the counts of words and pairs of words of answer and context, as support.ngram_cosine has it of texts in which all but
    ASCII letters, digits and underscores is a space. Contexts that come again are counted once, up to `most` grams of them."""
    word, held, size = re.compile("[A-Za-z0-9_]{2,}"), {}, 0

    def counted(text: str) -> tuple[Counter, float]:
        words = [w.lower() for w in word.findall(text)]
        found = Counter(words)
        found.update(map(" ".join, zip(words, words[1:])))
        return found, math.sqrt(sum(v * v for v in found.values()))

    def kept(text: str) -> tuple[Counter, float]:
        nonlocal size
        if text not in held:
            new = counted(text)
            if size + len(new[0]) > most:
                held.clear()
                size = 0
            held[text] = new
            size += len(new[0])
        return held[text]

    def one(answer: str, context: str) -> float:
        (a, own), (c, other) = counted(answer), kept(context)
        norm = own * other
        return min(1.0, sum(a[k] * c[k] for k in a.keys() & c.keys()) / norm) if norm else 0.0

    return lambda questions, answers, contexts: list(map(one, answers, contexts))


register_batch("trigram", trigram_profile)
register_batch("ascii_ngrams", ascii_ngrams)
