"""Small document tables for the tests of the training-data operators."""

from __future__ import annotations

import random

DOCS = "doc_id bigint, text string, lang string, source string, n_chars bigint"


def documents(spark, texts, first=0, extra=""):
    """One row a text, ids counting up; a pair gives the id itself."""
    rows = []
    for i, t in enumerate(texts):
        doc_id, text = t if isinstance(t, tuple) else (first + i, t)
        rows.append((doc_id, text, "en", "s", len(text or "")))
    return spark.createDataFrame(rows, DOCS)


def word_soup(seed: int, docs: int, words: int = 60, vocabulary: int = 40) -> list[str]:
    """Random texts over few words, with copies, near copies and shared passages."""
    rng = random.Random(seed)
    pick = lambda n: [f"w{rng.randrange(vocabulary)}" for _ in range(n)]
    passage = pick(30)
    texts = []
    for i in range(docs):
        w = pick(rng.randrange(5, words))
        kind = i % 6
        if kind == 1 and texts:
            w = rng.choice(texts).split()
        elif kind == 2 and texts:
            w = rng.choice(texts).split()
            w[rng.randrange(len(w))] = "changed"
        elif kind == 3:
            w[3:3] = passage
        elif kind == 4:
            w = w[:8] * 6
        seps = [rng.choice([" ", "\n", "\t ", "  "]) for _ in w]
        texts.append("".join(a + b for a, b in zip(w, seps, strict=True)))
    return texts
