"""Words and letters that a shortcut once left out."""

import numpy as np

from tracemill.llm import pii, toxicity


def test_grams_reach_beyond_64_bytes(monkeypatch):
    long = b"".join(b"%03d" % i for i in range(100))
    assert len(toxicity.grams([long])[0]) == sum(302 - n + 1 for n in range(3, 7)) + 1
    whole = [sorted(x.tolist()) for x in toxicity.grams([long, b"ab"])]
    monkeypatch.setattr(toxicity, "PART_BYTES", 50)
    assert [sorted(x.tolist()) for x in toxicity.grams([long, b"ab"])] == whole
    assert toxicity.parts([long, b"ab", b"cd", b"e" * 60]) == [(0, 1), (1, 3), (3, 4)]
    assert np.bincount(toxicity.grams([long, b"ab"])[1]).tolist() == [sum(302 - n + 1 for n in range(3, 7)) + 1, 4]


def test_spelt_mail_in_capitals_is_proposed():
    for text in ("JOE AT CORP DOT COM", "Joe [AT] Corp [DOT] com"):
        assert ("email_spelt", 0, len(text)) in pii.candidates(text)
