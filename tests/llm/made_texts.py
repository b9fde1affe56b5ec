"""Seeded prose for the tests."""

import random

WORDS = "amber birch cedar delta ember flint grove harbor island jasper kernel lagoon meadow nectar orchid pebble quartz river saddle timber".split()


def prose(n: int, seed: int) -> str:
    rng = random.Random(seed)
    return " ".join(rng.choice(WORDS) + str(rng.randrange(50)) for _ in range(n))
