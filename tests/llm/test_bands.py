"""Bands of fingerprints join texts that are alike, and no others."""

import itertools
import random

from gridweave.llm import fingerprints


def _text(rng, n):
    return "".join(rng.choice("abcdefghijklmnop qrstuvwxyz") for _ in range(n))


def test_what_is_past_both_ends_joins_no_texts():
    """Walks that end early in an octave leave most of its samples empty; texts have no more in common by that."""
    rng = random.Random(3)
    found = fingerprints.fingerprints([_text(rng, rng.randint(140, 200)) for _ in range(200)])
    keys = [set(fingerprints.band_keys(f)) for f in found]
    assert sum(not a.isdisjoint(b) for a, b in itertools.combinations(keys, 2)) == 0


def test_alike_texts_share_a_band():
    rng = random.Random(5)
    missed = alike = 0
    for n in range(60, 1800, 3):
        text = _text(rng, n)
        cut, drop = rng.randrange(n), max(1, int(n * rng.choice((0.01, 0.03, 0.08))))
        a, b = fingerprints.fingerprints([text, text[:cut] + _text(rng, 2) + text[cut + drop :]])
        if fingerprints.likeness(a, b) >= fingerprints.NEAR:
            alike += 1
            missed += set(fingerprints.band_keys(a)).isdisjoint(fingerprints.band_keys(b))
    assert alike > 200 and missed == 0
