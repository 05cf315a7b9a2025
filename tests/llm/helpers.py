"""Small tables and plain-Python counterparts for the operators' tests."""

from __future__ import annotations

import random

WORD = "the of and to in is that it was for on are as with his they at be this from".split()


def prose(seed: int, n: int, vocabulary: int = 400) -> str:
    rng = random.Random(seed)
    made = [f"w{rng.randrange(vocabulary)}" if rng.random() < 0.7 else rng.choice(WORD) for _ in range(n)]
    return "".join(w + (".\n" if i % 12 == 11 else " ") for i, w in enumerate(made)).strip() + "."


def changed(text: str, seed: int, share: float) -> str:
    rng = random.Random(seed)
    return " ".join(f"x{rng.randrange(10**6)}" if rng.random() < share else w for w in text.split(" "))
