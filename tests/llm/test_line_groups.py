"""Large candidate groups of lines: the same components at any size of block, few pairs looked at whole."""

import numpy as np
import pytest

from sentrymill.llm import kit, lines, links


def _mutants(rng):
    base = [kit.unique(rng.integers(0, 2**64, 60, dtype=np.uint64)) for _ in range(4)]
    return [kit.unique(np.concatenate([(b := base[i % 4])[rng.random(len(b)) < (0.85, 0.9, 0.97)[i % 3]], rng.integers(0, 2**64, i % 5, dtype=np.uint64)])) for i in range(70)]


@pytest.mark.parametrize("seed", range(20))
def test_search_by_size_gives_the_components_of_all_pairs(seed):
    rng = np.random.default_rng(seed)
    sets = _mutants(rng)
    for side in (None, rng.integers(0, 2, len(sets))):
        assert (links.linked_by_size(sets, 80, 100, side) == links._search(sets, 80, 100, side)).all()


def test_sizes_at_the_bound_lie_in_neighbouring_classes():
    n = np.arange(4, 400_000, 4)
    assert (links.size_class(n * 5 // 4, 80, 100) - links.size_class(n, 80, 100)).max() <= 1


def test_unlike_sets_are_not_looked_at_whole(monkeypatch):
    """Long lines of one language share a third of their shingles and are candidates by chance."""
    rng = np.random.default_rng(3)
    common = rng.integers(0, 2**64, 3000, dtype=np.uint64)
    rare = rng.integers(0, 2**64, 32_000, dtype=np.uint64)  # each is held by two sets or so
    sets = [kit.unique(np.concatenate([common[rng.random(3000) < 0.7], rng.choice(rare, 800, False)])) for _ in range(80)]
    seen, whole = [], links.overlap
    monkeypatch.setattr(links, "overlap", lambda a, b: seen.append(1) or whole(a, b))
    link = getattr(links, "linked_by_size", links.linked)
    assert (link(sets, 80, 100) == np.arange(80)).all()
    assert not seen


def test_components_do_not_depend_on_the_block(spark):
    rng = np.random.default_rng(8)
    words = ["".join(rng.choice(list("abcdefghij"), 6)) for _ in range(400)]
    made = []
    for i in range(5):
        base = list(rng.choice(words, 30 + 8 * i))
        for _ in range(25):
            some = list(base)
            for j in rng.integers(0, len(some), rng.integers(0, 4)):
                some[j] = words[rng.integers(400)]
            made.append(" ".join(some))
    docs = kit.keyed(spark.createDataFrame(list(enumerate(made)), "doc_id long, text string"))
    found = [{(r["id"], r["component"]) for r in lines.line_components(docs, block=b).collect()} for b in (8_000_000, 12_000)]
    assert found[0] and found[0] == found[1]


def test_a_large_forest_is_not_made_anew_for_every_few_edges(monkeypatch):
    made, forest = [], links._forest
    monkeypatch.setattr(links, "_forest", lambda u, v: made.append(len(u)) or forest(u, v))
    edges, n = links.Edges(), 450_000
    edges.add(np.column_stack([np.arange(1, n), np.zeros(n - 1, np.int64)]))
    for i in range(20):
        edges.add(np.array([[n + i, n + i - 1]]))
    got = edges.batch()
    assert len(made) <= 2 and got.num_rows == n + 19 and set(got.column(1).to_pylist()) == {0}
