"""Components of the n-gram Jaccard join against brute force."""

import random
import re

import pytest

from lakeloom.llm import jaccard_join


def shingles(text):
    words = re.findall(r"[^\x20\x09-\x0D]+", "".join(c.lower() if "A" <= c <= "Z" else c for c in text or ""))
    if not words:
        return frozenset()
    return frozenset(tuple(words[i : i + 5]) for i in range(len(words) - 4)) if len(words) >= 5 else frozenset([tuple(words)])


def brute(rows):
    sets = [(i, shingles(t)) for i, t in rows]
    parent = list(range(len(rows)))

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a in range(len(sets)):
        for b in range(a):
            x, y = sets[a][1], sets[b][1]
            if x and y and 100 * len(x & y) >= 80 * len(x | y):
                parent[find(a)] = find(b)
    least = {}
    for k, (i, _) in enumerate(sets):
        least[find(k)] = min(least.get(find(k), i), i)
    return sorted((i, len(s), least[find(k)]) for k, (i, s) in enumerate(sets))


def edited(rng, base, most):
    words = list(base)
    for _ in range(rng.randint(0, most)):
        words[rng.randrange(len(words))] = f"x{rng.randrange(50)}"
    return " ".join(words)


def corpus(rng):
    rows, common = [], [f"c{i}" for i in range(30)]
    for _ in range(6):
        base = [f"w{rng.randrange(400)}" for _ in range(rng.choice([8, 40, 120]))]
        if rng.random() < 0.5:
            base += common
        rows += [edited(rng, base, rng.choice([1, 3, 6])) for _ in range(rng.choice([2, 10, 60]))]
    rows += [" ".join(f"u{rng.randrange(10**6)}" for _ in range(rng.randint(0, 60))) for _ in range(30)]
    rows += ["", None, " \t\n", "one", "ONE", "one two three four", "a b c d e", "A B C D E", "É é"]
    rows += [rows[0]] * 5
    long = [f"l{i}" for i in range(30_000)]
    rows += [" ".join(long), " ".join(long[:-900]), " ".join(long[::2])]
    rng.shuffle(rows)
    return list(enumerate(rows, 100))


@pytest.mark.parametrize("seed, block", [(1, 256), (2, 4), (3, 8)])
def test_components_equal_brute_force(spark, monkeypatch, seed, block):
    monkeypatch.setattr(jaccard_join, "BLOCK", block)
    rows = corpus(random.Random(seed))
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    got = sorted(tuple(r) for r in jaccard_join.jaccard_components(docs).select("doc_id", "n_shingles", "component_id").collect())
    assert got == brute(rows)


def test_empty_table_null_ids_and_clashing_columns(spark):
    schema = "doc_id long, text string, class string, n int, component_id string"
    assert jaccard_join.jaccard_components(spark.createDataFrame([], schema)).collect() == []
    rows = [(None, "a b c d e f", "x", 1, "y"), (4, "a b c d e f", "x", 1, "y"), (4, "other words here now", "x", 1, "y")]
    got = jaccard_join.jaccard_components(spark.createDataFrame(rows, schema)).collect()
    assert sorted((str(r.doc_id), r.n_shingles, r.component_id) for r in got) == [("4", 1, 4), ("4", 2, 4), ("None", 2, 4)]


def test_prefix_length_covers_every_pair_at_the_threshold():
    for n in range(1, 200):
        for both in range(1, n + 1):
            if 100 * both >= 80 * n:
                assert n - both < jaccard_join.prefix_length(n)
