"""Pairs are judged many at a time: bounds lose no pair that a ratio or containment finds."""

import random

from tessera.operators import fuzzy


def _edits(a: str, b: str) -> int:
    """Least letters out and in until a is a part of b, by the whole table."""
    column = list(range(len(a) + 1))
    least = column[-1]
    for c in b:
        new = [0]
        for i, x in enumerate(a, 1):
            new.append(min(new[-1] + 1, column[i] + 1, column[i - 1] if x == c else len(a) + len(b)))
        column, least = new, min(least, new[-1])
    return least


def test_bounds_of_all_pairs_are_exact_over_words_of_bits():
    rng = random.Random(5)
    a = ["".join(rng.choice("abcdé ") for _ in range(rng.choice((1, 2, 9, 40, 63, 64, 65, 127, 128, 129, 200, 300)))) for _ in range(200)]
    b = ["".join(rng.choice("abcdé ") for _ in range(rng.randint(0, 150))) for _ in a]
    assert fuzzy.least_edits(a, b).tolist() == [_edits(x, y) for x, y in zip(a, b, strict=True)]
    assert fuzzy.most_common(a, b).tolist() == [fuzzy.lcs(x, y) for x, y in zip(a, b, strict=True)]


def _near(rng: random.Random, text: str) -> str:
    t = list(text)
    for _ in range(rng.randint(0, 1 + len(t) // 4)):
        if t and rng.random() < 0.5:
            t.pop(rng.randrange(len(t)))
        else:
            t.insert(rng.randint(0, len(t)), rng.choice("abc d中\U0001f600"))
    return "".join(t)


def test_no_pair_is_lost():
    rng, a, b = random.Random(6), ["", "a", "", "x" * 700], ["a", "", "", "y" + "x" * 700]
    words = ["".join(rng.choice("abcdefgh") for _ in range(rng.randint(1, 7))) for _ in range(60)]
    for _ in range(1500):
        said = [rng.choice(words) for _ in range(rng.choice((1, 2, 5, 12, 40)))]
        other = rng.sample(said, rng.randint(0, len(said))) + [rng.choice(words) for _ in range(rng.randint(0, 6))]
        near = _near(rng, " ".join(said))
        a.append(" ".join(said))
        b.append(rng.choice((" ".join(other), near, near + " " + " ".join(other), near[3:], " ".join(rng.choice(words) for _ in range(8)))))
    for partial, token_set in ((85, 80), (70, 95), (100, 60)):
        want = [x != "" != y and (x in y or y in x or fuzzy.best_window(x, y, partial) >= partial or fuzzy.set_ratio(x, y) >= token_set) for x, y in zip(a, b, strict=True)]
        assert fuzzy.alike(a, b, partial, token_set) == want and 200 < sum(want) < len(a) - 200


def test_only_pairs_that_may_be_alike_are_compared(monkeypatch):
    """Sentences of words of common syllables: runs of letters do not tell them apart, edits do."""
    rng, calls, best, sets = random.Random(7), [], fuzzy.best_window, fuzzy.set_ratio
    monkeypatch.setattr(fuzzy, "best_window", lambda *x: calls.append(1) or best(*x))
    monkeypatch.setattr(fuzzy, "set_ratio", lambda *x: calls.append(1) or sets(*x))
    word = lambda: "".join(rng.choice(("th", "er", "nd", "on", "ing", "ea", "st", "the")) for _ in range(rng.randint(1, 4)))
    a, b = ([" ".join(word() for _ in range(rng.randint(6, 20))) for _ in range(1000)] for _ in range(2))
    fuzzy.alike(a, b, 85, 80)
    assert len(calls) < 50


def test_quotes_are_filtered_as_by_every_pair(spark):
    rng = random.Random(8)
    words = ["".join(rng.choice("abcdefgh") for _ in range(rng.randint(1, 7))) for _ in range(80)]
    said = [(k, " ".join(rng.choice(words) for _ in range(rng.randint(1, 12)))) for k in range(40) for _ in range(5)]
    own = [(k, _near(rng, t) if rng.random() < 0.5 else " ".join(rng.choice(words) for _ in range(9))) for k, t in said] + [(0, "> x"), (0, "Q " + said[0][1].upper()), (0, "Q " + said[0][1].upper()), (99, "no review"), (99, "no review")]
    norm = lambda t: " ".join(t.split()).lower()
    alike = lambda x, y: x != "" != y and (x in y or y in x or fuzzy.best_window(x, y) >= 85 or fuzzy.set_ratio(x, y) >= 80)
    want = sorted((k, t) for k, t in own if not t.strip().startswith((">", "#")) and not any(j == k and alike(norm(t), norm(r)) for j, r in said))
    out = fuzzy.without_quotes(spark.createDataFrame(own, "k long, sentence string"), spark.createDataFrame(said, "k long, review_sentence string"), ["k"])
    assert sorted(map(tuple, out.collect())) == want and 40 < len(want) < len(own) - 40
