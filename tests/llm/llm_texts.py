"""Invented texts for the tests."""


def prose(rng, n, vocabulary=400):
    return " ".join(f"w{rng.randrange(vocabulary):x}{'abc'[rng.randrange(3)]}" for _ in range(n))
