"""Evidence reaches every repeat and every misspelling, however many there are."""

import pytest

from loomshed.llm import pii


def leaning(other):
    """Weights with a unary log odds of ``other`` for the label other, and skip edges alone."""
    return pii.Weights(
        [[other if y == 0 and f == 0 else 0.0 for f in range(pii.N_FEATURES)] for y in range(5)],
        [[0.0] * 5 for _ in range(5)],
        5.0,
    )


@pytest.mark.parametrize("other", [0.0, 1.0])
@pytest.mark.parametrize("repeats", [1, 3, 50, 400])
def test_every_repeat_of_a_base_span_is_found(other, repeats):
    text = "call +1 (319) 555-5132 " + "then 555-5132 again " * repeats
    base, added = pii.find_spans(text, leaning(other))
    assert [b[0] for b in base] == ["phone"]
    assert [text[a:b] for _, a, b in added] == ["555-5132"] * repeats
    before = "then 555-5132 again " * repeats + "call +1 (319) 555-5132"
    assert len(pii.find_spans(before, leaning(other))[1]) == repeats


def test_messages_cross_a_path_longer_than_the_rounds():
    import numpy as np

    n = 40
    unary = np.zeros((n, 2))
    unary[0] = [-20.0, 0.0]
    edges = np.array([(i, i + 1) for i in range(n - 1)])
    got = pii.propagate(unary, np.zeros((2, 2)), edges, 6.0, np.ones(n - 1, dtype=int), pii.Field())
    flip = 1 / (1 + np.exp(6.0))
    assert np.allclose(got[:, 1], [0.5 + 0.5 * (1 - 2 * flip) ** i for i in range(n)], atol=0.01)
