"""What the sampled walks find by themselves, and the exact option beside them."""

import random

import numpy as np
import pytest

from fleetstats.llm import decontaminate


def at_the_limit(n, count, seed):
    """Pairs of n words whose edits use the whole limit, as many words put in as taken out."""
    rnd, limit, pairs = random.Random(seed), decontaminate.edits(n, 0.8), []
    for _ in range(count):
        one = [rnd.randrange(1, 3000) for _ in range(n)]
        two = list(one)
        for k in rnd.sample(range(n), limit // 2):
            two[k] = None
        two = [w for w in two if w]
        for _ in range(limit // 2):
            two.insert(rnd.randrange(1, len(two) + 1), 5000 + rnd.randrange(1000))
        if limit % 2:
            two[rnd.randrange(n)] = 4000
        pairs.append((one, two))
    return tuple(np.array(x) for x in zip(*pairs))


@pytest.mark.parametrize("n", [5, 20, 40, 60, 100, 200, 400])
def test_walks_alone_find_windows_at_the_limit(n):
    one, two = at_the_limit(n, 300, n)
    sampled, repeats = decontaminate.plan(n, decontaminate.edits(n, 0.8))
    agree = decontaminate.sample_walks(one, repeats, sampled) == decontaminate.sample_walks(two, repeats, sampled)
    assert agree.any(axis=1).mean() >= 0.99


def test_counting_finds_what_the_search_by_walks_finds(monkeypatch):
    monkeypatch.setattr(decontaminate, "ITEM_BLOCK", 3)
    monkeypatch.setattr(decontaminate, "CELLS", 500)
    rnd = random.Random(8)
    words = [f"w{i}" for i in range(300)]
    items = [(i, rnd.choices(words, k=rnd.choice([3, 12, 12, 30]))) for i in range(30)]
    docs = []
    for _, item in items:
        changed = [w if rnd.random() > 0.15 else rnd.choice(words) for w in item]
        docs.append(" ".join(rnd.choices(words, k=20) + changed + rnd.choices(words, k=20)))
    exact = decontaminate.Items(items, 0.8, counting=True).leaks(docs)
    assert exact and set(decontaminate.Items(items, 0.8).leaks(docs)) <= set(exact)
    assert len(decontaminate.Items(items, 0.8).leaks(docs)) >= 0.99 * len(exact)


def test_a_length_without_a_plan_is_counted(monkeypatch):
    monkeypatch.setattr(decontaminate, "plan", lambda n, limit: None)
    items = [(7, [f"w{k}" for k in range(20)])]
    text = "x " + " ".join(w if k not in (3, 11) else "new" for k, w in enumerate(items[0][1])) + " y"
    assert [leak[:3] for leak in decontaminate.Items(items, 0.8).leaks([text])] == [(0, 0, 2)]
