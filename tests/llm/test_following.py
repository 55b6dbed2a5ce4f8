"""Fingerprints of texts that follow each other."""

import numpy as np

from sitewright.llm import iblt


def test_a_text_that_follows_another_is_digested_once(monkeypatch):
    rng = np.random.default_rng(5)
    texts = [" ".join(f"w{x}" for x in rng.integers(0, 900, n)) for n in (0, 1, 40, 700, 3, 5000, 40)]
    follow = [*texts[1:3], "a text of another block", *texts[4:], texts[0]]
    digested, digests = [], iblt.paragraph_digests
    monkeypatch.setattr(iblt, "paragraph_digests", lambda x: digested.extend(x) or digests(x))
    own, after = iblt.prints_of_following(texts, follow)
    assert len(digested) == len(texts) + 2
    for found, wanted in ((own, texts), (after, follow)):
        alone = iblt.Prints.of(*digests(wanted), len(wanted))
        assert found.texts() == alone.texts()
        assert iblt.likeness(found, alone).tolist() == [1.0] * len(wanted)
    assert iblt.likeness(own, after).tolist() == iblt.likeness(*(iblt.Prints.of(*digests(x), len(x)) for x in (texts, follow))).tolist()
