import random

import pytest

@pytest.fixture(scope="session")
def odd_texts():
    """Null, empty, blank, repeated, very long and oddly spaced texts, with near copies."""
    rnd = random.Random(5)
    words = ["alpha", "Beta", "gamma,", "délta", "ÉPSILON", "zeta.", "it's", "e_f", "日本", "x1²", "\x1c", "\xa0n"]
    base = [" ".join(rnd.choice(words) + str(rnd.randrange(40)) for _ in range(80)) for _ in range(6)]
    near = []
    for b in base:
        for _ in range(4):
            w = b.split(" ")
            w[rnd.randrange(len(w))] = "changed"
            near.append(" ".join(w))
    return [None, "", " \n\t", None, "one", "one two three", "One  two\nthree", *base, *base[:2], *near, " ".join(base) * 30, "a " * 5000]
