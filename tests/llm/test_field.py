"""The chain field's marginals against all labellings of short chains, whole texts against one long chain."""

import itertools
import random
import tracemalloc

import numpy as np

from claimloom.llm import toxicity


def field(rng, transitions):
    words = [f"{a}{b}" for a in "abc" for b in "xyz"]
    return toxicity.Field({f"w:{w}": rng.uniform(-3, 3) for w in words}, 0.3, transitions, None), words


def test_marginals_are_those_of_all_labellings(monkeypatch):
    rng = random.Random(1)
    for chain in (64, 3, 2, 1):
        monkeypatch.setattr(toxicity, "CHAIN", chain)
        for t in (np.array([[0.5, -1.0], [0.2, 1.5]]), np.zeros((2, 2)), np.array([[2.0, -4.0], [-3.0, 2.0]])):
            f, words = field(rng, t)
            docs = [[rng.choice(words) for _ in range(n)] for n in (1, 2, 3, 5, 7, 0, 9)]
            for d, z in zip(docs, f.marginals(docs), strict=True):
                mass = np.zeros((len(d), 2))
                for y in itertools.product((0, 1), repeat=len(d)):
                    s = np.exp(sum(f.emission(w) * a for w, a in zip(d, y, strict=True)) + sum(t[a, b] for a, b in zip(y, y[1:], strict=False)))
                    mass[np.arange(len(d)), list(y)] += s
                assert np.allclose(z, np.log(mass[:, 1] / mass[:, 0])) if d else len(z) == 0


def test_long_texts_are_one_chain():
    rng = random.Random(2)
    t = np.array([[1.0, -2.0], [-2.0, 1.5]])
    f, words = field(rng, t)
    docs = [[rng.choice(words) for _ in range(n)] for n in (1000, 64, 65, 129, 20_000, 3)]
    for d, z in zip(docs, f.marginals(docs), strict=True):
        a, b = toxicity.odds(np.exp([[f.emission(w) for w in d]]), np.exp(t))
        assert np.allclose(z, np.log(a * b)[0])
    assert f.marginals([]) == [] and [len(z) for z in f.marginals([[], []])] == [0, 0]


def test_bounds_of_training():
    rng = random.Random(3)
    plain = [f"w{rng.randrange(300)}" for _ in range(400)]
    docs = [(" ".join(rng.sample(plain, 40) + (["vile"] * 30 if i % 2 else [])), i % 2) for i in range(60)]
    docs = [(t.replace("0", "a").replace("1", "b").translate(str.maketrans("23456789", "cdefghij")), y) for t, y in docs]
    for windows in (1, 6, 100):
        f = toxicity.fit(docs, toxic_windows=windows, clean_windows=windows)
        assert f.scores(f.marginals([["vile"] * 3, plain[:30]])).round().tolist() == [1, 0]


def test_training_holds_no_words_of_all_documents():
    rng = np.random.default_rng(3)
    words = ["".join(chr(97 + int(c)) for c in rng.integers(0, 26, rng.integers(3, 10))) for _ in range(800)]
    docs = []
    for i in range(400):
        said = [words[j] for j in rng.integers(0, len(words), 400)]
        if i % 2:
            said[::40] = ["scumbag"] * 10
        docs.append((" ".join(said), i % 2))
    tracemalloc.start()
    f = toxicity.fit(docs)
    most = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert most < 18 * sum(len(t) for t, _ in docs)
    assert not f.cache
    assert f.scores(f.marginals([["scumbag"] * 3, words[:30]])).round().tolist() == [1, 0]
