"""Words and prose for tests."""

import random


def vocabulary(seed=0, n=400):
    r = random.Random(seed)
    return ["".join(r.choice("abcdefghijklmnopqrstuvwxyzéß") for _ in range(r.randint(2, 9))) for _ in range(n)]


def prose(r, words, n):
    out = []
    for _ in range(n):
        out.append(r.choice(words) + (r.choice([".", ".", ",", ""]) if r.random() < 0.2 else ""))
    text = " ".join(out)
    return text.replace(". ", ".\n", 2)
