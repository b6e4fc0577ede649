"""Every spelled-out address that the pattern accepts becomes a candidate."""

import pytest

from loomline.llm import pii


@pytest.mark.parametrize("at", ["[at]", "(at)", " at ", " [at] "])
@pytest.mark.parametrize("dot", ["[dot]", "(dot)", " dot ", " (dot) "])
def test_spelled_addresses(at, dot):
    text = f"jane.roe{at}example{dot}com"
    assert pii.loose_spans(text) == [(0, 0, len(text))]
