"""Plain versions that operators are compared with."""

from bisect import bisect_left
from collections import Counter
from itertools import pairwise

SHINGLE, SIMILAR = 5, 0.8


def text_shingles(text: str) -> list[tuple]:
    """A text's shingles with occurrence numbers, exact."""
    words = text.encode("utf-8", "replace").split()
    n = min(SHINGLE, len(words))
    seen: Counter = Counter()
    out = []
    for s in zip(*[words[k:] for k in range(n)], strict=False) if n else ():
        out.append((s, seen[s]))
        seen[s] += 1
    return out


def alignment(a: list, b: dict, n_b: int) -> float:
    """Similarity of two sequences of distinct items: matched in order within the band, over all.

    ``b`` maps items to places. A pair as similar as SIMILAR never leaves the
    band: at most a ninth of both lengths is unmatched.
    """
    if not a or not n_b:
        return 0.0
    band = (len(a) + n_b) * (1 - SIMILAR) / (1 + SIMILAR) + 1e-9
    places = [j for i, s in enumerate(a) if (j := b.get(s)) is not None and abs(i - j) <= band]
    if all(x < y for x, y in pairwise(places)):
        matched = len(places)
    else:  # longest increasing run of places
        tails: list[int] = []
        for j in places:
            k = bisect_left(tails, j)
            tails[k : k + 1] = [j]
        matched = len(tails)
    return matched / (len(a) + n_b - matched)
