import pytest

WORDS = "the of and a to in is was he for it with as his on be at by had not are but from or have an they which one you".split()


@pytest.fixture
def prose():
    """A function of (seed, n): n words of made-up prose."""
    import random

    def make(seed, n, vocabulary=3000):
        rng = random.Random(seed)
        return " ".join(rng.choice(WORDS) if rng.random() < 0.3 else f"w{rng.randrange(vocabulary)}" for _ in range(n))

    return make
