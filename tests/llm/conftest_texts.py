"""Random texts with near copies."""

import numpy as np


def words(rng, n):
    letters = np.array(list("abcdefghijklmnopqrstuvwxyz"))
    return ["".join(rng.choice(letters, rng.integers(2, 11))) for _ in range(n)]


def family_texts(families, copies, seed=0, size=120):
    """families * copies texts: each family's first text and copies with a few words changed, shuffled."""
    rng = np.random.default_rng(seed)
    vocabulary = words(rng, 3000)
    out = []
    for _ in range(families):
        base = [vocabulary[i] for i in rng.integers(0, 3000, size)]
        for k in range(copies):
            own = list(base)
            for i in rng.integers(0, size, k * 3):
                own[i] = vocabulary[rng.integers(0, 3000)]
            out.append(" ".join(own))
    rng.shuffle(out)
    return out
