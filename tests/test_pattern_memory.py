"""What the broadcast patterns take of a worker's memory."""

import random
import tracemalloc

from loomshed.functions.patterns import EACH, Patterns


def test_patterns_take_the_memory_that_their_bound_assumes():
    r = random.Random(1)
    asked = [r.choice(["*{}", "{}*"]).format("".join(r.choices("abcdefghij", k=20))) for _ in range(20_000)]
    tracemalloc.start()
    held = Patterns.of(asked)
    taken = tracemalloc.get_traced_memory()[0]
    tracemalloc.stop()
    assert taken < 2 * sum(len(p) + EACH for p in asked) and held.match(asked[0].strip("*"))
