"""How well an answer is supported by its context: Column functions over texts, and their registry."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

from . import lexicon as L
from .spans import any_in


def _text(c: Column) -> Column:
    return F.coalesce(c, F.lit(""))


#: what a token is
TOKEN = r"[A-Za-z0-9.+-]+"


def token_list(text: Column) -> Column:
    return F.transform(F.regexp_extract_all(_text(text), F.lit(TOKEN), F.lit(0)), F.lower)


def tokens(text: Column) -> Column:
    """Distinct lower-cased runs of letters, digits, dots, plus and minus."""
    return F.array_distinct(token_list(text))


def share(a: Column, b: Column) -> Column:
    """Share of a's elements that are in b; 0 if a is empty."""
    return F.when(F.size(a) == 0, 0.0).otherwise(F.size(F.array_intersect(a, b)) / F.size(a))


def lexical(question: Column, answer: Column, context: Column) -> Column:
    return share(tokens(answer), tokens(context))


def let(value: Column, then: Callable[[Column], Column]) -> Column:
    """then(value) with the value worked out once, as a lambda's variable; written plainly, each use of it would be a copy."""
    return F.element_at(F.transform(F.array(value), then), 1)


def _grams(text: Column) -> Column:
    """Words of two or more letters, digits or underscores, and pairs of neighbours."""
    words = F.regexp_extract_all(F.lower(_text(text)), F.lit(r"\b[a-z0-9_][a-z0-9_]+\b"), F.lit(0))

    def with_pairs(w: Column) -> Column:
        n = F.greatest(F.size(w) - 1, F.lit(0))
        return F.concat(w, F.zip_with(F.slice(w, 1, n), F.slice(w, 2, n), lambda x, y: F.concat(x, F.lit(" "), y)))

    return let(words, with_pairs)


def ngram_cosine(question: Column, answer: Column, context: Column) -> Column:
    """Cosine of exact counts of words and pairs. The grams of both sides are sorted as one list and counted by runs, so the
    work grows with a text as a sort does."""

    def side(grams: Column, n: int) -> Column:
        return F.transform(grams, lambda g: F.struct(g.alias("g"), F.lit(n).alias("side")))

    both = F.sort_array(F.concat(side(_grams(answer), 0), side(_grams(context), 1)))

    def runs(s: Column) -> Column:
        new = F.filter(F.sequence(F.lit(1), F.size(s)), lambda i: (i == 1) | (F.get(s, i - 1) != F.get(s, i - 2)))
        counted = lambda starts: F.transform(starts, lambda i, k: F.struct(F.get(s, i - 1).alias("x"), (F.coalesce(F.get(starts, k + 1), F.size(s) + 1) - i).cast("double").alias("n")))
        return let(new, counted)

    def cosine(r: Column) -> Column:
        def square(n: int) -> Column:
            return F.sqrt(F.aggregate(r, F.lit(0.0), lambda t, x: t + F.when(x["x"]["side"] == n, x["n"] * x["n"]).otherwise(0.0)))

        # a gram of both sides is two runs, one after the other
        shared = F.transform(r, lambda x, k: F.when((x["x"]["side"] == 0) & (F.get(r, k + 1)["x"]["g"] == x["x"]["g"]), x["n"] * F.get(r, k + 1)["n"]))
        dot = F.aggregate(shared, F.lit(0.0), lambda t, v: t + F.coalesce(v, F.lit(0.0)))
        return let(square(0) * square(1), lambda norm: F.when(norm > 0, F.least(F.lit(1.0), dot / norm)).otherwise(0.0))

    none = F.array().cast("array<struct<x:struct<g:string,side:int>,n:double>>")
    return let(both, lambda s: F.when(F.size(s) == 0, 0.0).otherwise(let(F.when(F.size(s) > 0, runs(s)).otherwise(none), cosine)))


def dense_cosine(a: Column, b: Column) -> Column:
    """Of two vectors, held between 0 and 1; 0 if one has no length."""

    def dot(x: Column, y: Column) -> Column:
        return F.aggregate(F.zip_with(x, y, lambda p, q: p.cast("double") * q.cast("double")), F.lit(0.0), lambda s, v: s + v)

    norm = F.sqrt(dot(a, a)) * F.sqrt(dot(b, b))
    return F.when(norm > 0, F.greatest(F.lit(0.0), F.least(F.lit(1.0), dot(a, b) / norm))).otherwise(0.0)


def nli(question: Column, answer: Column, context: Column) -> Column:
    """Lexical support, capped where numbers are not in the context or polarity differs, in steps else."""
    lex = lexical(question, answer, context)

    def numbers(t: Column) -> Column:
        return F.regexp_extract_all(_text(t), F.lit(r"-?[0-9]+(?:\.[0-9]+)?"), F.lit(0))

    new = F.size(F.array_except(numbers(answer), numbers(context))) > 0
    turned = _text(answer).rlike(L.NEGATION) != _text(context).rlike(L.NEGATION)
    return (
        F.when(new, F.least(lex, F.lit(0.35)))
        .when(turned & (lex < 0.8), F.least(lex, F.lit(0.55)))
        .when(lex >= 0.8, 1.0).when(lex >= 0.55, 0.75).when(lex >= 0.3, 0.45).otherwise(lex)
    )


def word_overlap(a: Column, b: Column) -> Column:
    """Share of a's words of three or more characters that are in b; underscores part words."""

    def words(t: Column) -> Column:
        parts = F.split(F.trim(F.regexp_replace(F.lower(F.replace(_text(t), F.lit("_"), F.lit(" "))), r"\s+", " ")), " ")
        return F.array_distinct(F.filter(parts, lambda w: F.length(w) > 2))

    return share(words(a), words(b))


def proxy(question: Column, answer: Column, context: Column) -> Column:
    return F.greatest(lexical(question, answer, context), ngram_cosine(question, answer, context))


def pieces(answer: Column, how: str) -> Column:
    """whole, sentence or atomic parts of an answer, without empty ones."""
    whole = F.array(F.trim(_text(answer)))
    sentences = F.transform(F.split(F.trim(_text(answer)), r"(?<=[.!?])\s+", -1), lambda x: F.trim(x))
    atoms = F.flatten(F.transform(sentences, lambda s: F.transform(F.split(s, r"(?i)\s*;\s*|,\s+(?:and|but)\s+|\s+(?:and|but)\s+", -1), lambda x: F.trim(x))))
    return F.filter({"whole": whole, "sentence": sentences, "atomic": atoms}[how], lambda s: s != "")


def segmented(answer: Column, context: Column, how: str) -> Column:
    """Mean lexical support of the answer's parts; 0 without parts."""
    parts = pieces(answer, how)
    held = tokens(context)
    return F.when(F.size(parts) == 0, 0.0).otherwise(F.aggregate(parts, F.lit(0.0), lambda s, p: s + share(tokens(p), held)) / F.size(parts))


def context_supported(answer: Column, context: Column) -> Column:
    """All measured quantities are in the context, or, without any, enough of the words."""
    low, ctx = F.lower(_text(answer)), F.lower(_text(context))
    measured = F.transform(F.regexp_extract_all(_text(answer), F.lit(L.MEASURED), F.lit(0)), F.lower)

    def words(t: Column) -> Column:
        raw = F.transform(F.regexp_extract_all(t, F.lit(r"[a-z0-9.+-]+"), F.lit(0)), lambda w: F.regexp_replace(w, r"^[.+-]+|[.+-]+$", ""))
        return F.array_distinct(F.filter(raw, lambda w: F.length(w) > 2))

    return F.when(F.size(measured) > 0, F.forall(measured, lambda m: F.contains(ctx, m))).otherwise(share(words(low), words(ctx)) >= 0.35)


def usefulness(question: Column, answer: Column) -> Column:
    q, a = F.lower(_text(question)), F.lower(_text(answer))
    out = F.when(F.trim(_text(answer)) != "", 1.0).otherwise(0.0)
    for marker, words in reversed(L.USEFULNESS):
        out = F.when(F.contains(q, F.lit(marker)), F.when(any_in(a, words), 1.0).otherwise(0.0)).otherwise(out)
    return out


#: name -> f(question, answer, context); add scorers with register()
SCORERS: dict[str, Callable[[Column, Column, Column], Column]] = {"lexical": lexical, "embedding": ngram_cosine, "nli": nli, "proxy": proxy}
ALIASES = {"lexical_overlap": "lexical", "toy": "lexical", "embedding_similarity": "embedding", "nli_heuristic": "nli"}


def register(name: str, scorer: Callable[[Column, Column, Column], Column]) -> None:
    SCORERS[name] = scorer


def scorer(name: str) -> Callable[[Column, Column, Column], Column]:
    name = ALIASES.get(name, name)
    if name not in SCORERS:
        raise ValueError(f"no support scorer {name!r}; there are {sorted(SCORERS)}")
    return SCORERS[name]


def provided_or(name: str, provided: Column, question: Column, answer: Column, context: Column, strict: bool = False) -> tuple[Column, Column]:
    """Score and method: the provided score where there is one, else the named scorer's; strict: a missing one fails."""
    rest = F.raise_error(F.lit(f"no provided score, and {name} must not stand in")).cast("double") if strict else scorer(name)(question, answer, context)
    return F.coalesce(provided, rest), F.when(provided.isNotNull(), "provided_column").otherwise(name)
