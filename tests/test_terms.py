import random
import re
import time

from parchment.constants import PRESERVED_TERMS
from parchment.operators import terms as k


def by_pattern(text, terms):
    return re.sub(r"(?<![A-Za-z])(?:" + "|".join(map(re.escape, terms)) + r")(?![A-Za-z])", " ", text, flags=re.IGNORECASE | re.ASCII)


def replaced(text, terms):
    spans = k.occurrences(text, k.index(terms))
    edges = [0, *(x for s in spans for x in s), len(text)]
    return " ".join(text[a:b] for a, b in zip(edges[::2], edges[1::2], strict=True))


def test_as_one_pattern_of_all_terms():
    rng = random.Random(6)
    odd = ["a", "a b", "b a", "a-b", "b", "a b c", "C++", "GPT-4", "(x)", "x", "é a", "a b", "b c a"]
    words = ["a", "b", "c", "A", "B", "ab", "-", " ", " ", " ", "C++", "c+", "+", "GPT-4", "gpt-40", "4", "(", "x", "X", ")", "é", "É", "\n", "."]
    for _ in range(6000):
        terms = rng.sample(odd, rng.randrange(1, 9))
        text = "".join(rng.choices(words, k=rng.randrange(14)))
        assert replaced(text, terms) == by_pattern(text, terms), (text, terms)
    some = [*PRESERVED_TERMS, "word", "other words", "."]
    for _ in range(300):
        text = " ".join(rng.choices([t.upper() if rng.random() < 0.3 else t for t in some], k=12))
        assert replaced(text, PRESERVED_TERMS) == by_pattern(text, PRESERVED_TERMS)


def test_very_many_terms(spark):
    rng = random.Random(1)
    letters = "abcdefghijklmnopqrstuvwxyz"
    vocabulary = ["".join(rng.choices(letters, k=rng.randrange(3, 9))) for _ in range(30_000)]
    terms = list({" ".join(rng.choices(vocabulary, k=rng.randrange(1, 4))) for _ in range(100_000)})
    text = " ".join(rng.choices(vocabulary, k=200)) + " " + " , ".join(rng.sample(terms, 50))
    df = spark.createDataFrame([(1, text, "x"), (2, None, "y"), (3, "", "z")], "k int, text string, clash string")
    began = time.time()
    got = {r["k"]: r["text"] for r in k.without_terms(df, terms).collect()}
    assert time.time() - began < 60
    few = [t for t in terms if t in text]
    assert got == {1: by_pattern(text, few), 2: None, 3: ""}
