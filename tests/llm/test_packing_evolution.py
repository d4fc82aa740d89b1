"""The genetic algorithm where best-fit decreasing falls short."""

import random

import pytest

from voluma.llm import packing


def triplets(rng):
    out = []
    for _ in range(100):  # three pieces fill a sequence exactly, which greedy packing misses
        a, b = rng.randint(780, 900), rng.randint(520, 680)
        out += [a, b, 2048 - a - b]
    return out


@pytest.mark.parametrize("lengths", [triplets, lambda rng: [rng.randint(500, 1100) for _ in range(400)]])
def test_evolution_saves_bins(lengths):
    greedy = evolved = 0
    for seed in range(4):
        sizes = lengths(random.Random(seed))
        order = sorted(range(len(sizes)), key=lambda i: -sizes[i])
        greedy += len(packing.best_fit(sizes, order, [], 2048))
        first = packing.evolve(sizes, [], 2048, seed)
        second = packing.evolve(sizes, [first, packing.evolve(sizes, [], 2048, seed + 50)], 2048, seed + 99)
        assert len(set(second)) <= len(set(first))  # elites that migrate are kept
        fill = {}
        for i, b in enumerate(second):
            fill[b] = fill.get(b, 0) + sizes[i]
        assert max(fill.values()) <= 2048
        evolved += len(set(second))
    assert evolved < 0.99 * greedy


def test_small_inputs_are_optimal():
    rng = random.Random(8)

    def fewest(sizes, rooms=()):
        if not sizes:
            return len(rooms)
        best, tried = fewest(sizes[1:], (*rooms, 2048 - sizes[0])) if len(rooms) < 4 else 9, set()
        for k, room in enumerate(rooms):
            if room >= sizes[0] and room not in tried:
                tried.add(room)
                best = min(best, fewest(sizes[1:], (*rooms[:k], room - sizes[0], *rooms[k + 1 :])))
        return best

    for _ in range(20):
        sizes = [rng.randint(400, 1000) for _ in range(8)]
        assert len(set(packing.evolve(sizes, [], 2048, 1))) == fewest(sorted(sizes, reverse=True))


def test_blocks_of_hard_lengths(spark, monkeypatch):
    monkeypatch.setattr(packing, "BLOCK", 150)
    sizes = [n for seed in range(3) for n in triplets(random.Random(seed))]
    rows = packing.pack(spark.createDataFrame(list(enumerate(sizes)), "item long, length int")).collect()
    greedy = packing.best_fit(sizes, sorted(range(len(sizes)), key=lambda i: -sizes[i]), [], 2048)
    assert sorted(r["item"] for r in rows) == list(range(len(sizes))) and len({r["sequence_id"] for r in rows}) < len(greedy)
