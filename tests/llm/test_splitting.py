"""Pieces of oversized texts against what must hold of them."""

import random

from pagemill.llm import splitting as S


def test_pieces_fit_overlap_and_cover():
    rng = random.Random(5)
    for _ in range(300):
        text = "".join(rng.choice(["w" * rng.randint(1, 5)]) + rng.choice([" ", " ", " ", ". ", "; ", "\n", "\n\n", "\n\nArticle 5 "]) for _ in range(rng.randint(0, 120)))
        size = rng.randint(1, 30)
        overlap = rng.randint(0, size + 2)
        pieces, tokens, longest = S.split(text, size, overlap)
        spans, ranks = S.boundaries(text)
        starts, ends = {a: i for i, (a, _) in enumerate(spans)}, {b: i + 1 for i, (_, b) in enumerate(spans)}
        assert tokens == len(text.split())
        ranges = [(starts[a], ends[b]) for a, b, _ in pieces]
        assert all(b - a <= size for a, b in ranges) and all(n == b - a for (a, b), (_, _, n) in zip(ranges, pieces))
        assert not tokens or (ranges[0][0] == 0 and ranges[-1][1] == tokens)
        step = max(0, min(overlap, size - 1))
        assert all(b == d0 + step if d0 else True for (_, b), (d0, _) in zip(ranges, ranges[1:]) if b >= step)
        cuts = [k for k, r in enumerate(ranks) if r < S.WORD] + [tokens]
        run = max((b - a for a, b in zip(cuts, cuts[1:])), default=0)
        assert (longest > size) == (run > size)


def test_blank_texts_have_no_pieces():
    assert S.split(None, 5, 1) == ([], 0, 0) and S.split(" \n", 5, 1) == ([], 0, 0)
