"""Texts for the tests: invented words, copies, passages, odd cases."""

from __future__ import annotations

import random


def prose(rng: random.Random, n: int) -> str:
    words = ["".join(rng.choice("abcdefghijklmnoprstuvw") for _ in range(rng.randint(2, 8))) for _ in range(n)]
    return " ".join(words)


def corpus(seed: int = 7) -> list[tuple]:
    """(doc_id, text, lang, source): exact and near copies, shared passages, repeated lines, odd rows."""
    rng = random.Random(seed)
    base = [prose(rng, rng.randint(60, 140)) for _ in range(12)]
    texts = list(base)
    for t in base[:6]:
        words = t.split()
        words[rng.randrange(len(words))] = "changed"
        texts += [t, " ".join(words)]
    passage = prose(rng, 90)
    texts += [f"{prose(rng, 40)} {passage} {prose(rng, 40)}" for _ in range(4)]
    block = "\n".join(prose(rng, 8) for _ in range(4))
    texts += [f"{prose(rng, 10)}\n{block}\n\n{prose(rng, 10)}" for _ in range(3)] + [f"{block}\n{block}"]
    texts += ["", None, " \t\n ", "one", "two words", "x" * 5000, "ab " * 3000, "ünï çödé 漢字 \U0001f600 end."]
    return [(i, t, ("en", "de")[i % 2], (None, "a", "b", "c")[i % 4]) for i, t in enumerate(texts)]


SCHEMA = "doc_id long, text string, lang string, source string"
