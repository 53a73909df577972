import random

import pytest

COLUMNS = "doc_id long, text string, lang string, source string, n_chars long"
WORDS = [a + b for a in ("ka", "lo", "mi", "nu", "re", "so", "tä") for b in ("ba", "de", "fi", "go", "hu", "ße", "x.", "Y,")]


def prose(rng, n):
    return " ".join(rng.choice(WORDS) + (rng.choice(WORDS) if rng.random() < 0.5 else "") for _ in range(n))


def texts(seed=7):
    """Prose, exact and near copies, shared passages, repeats, blanks, nulls, a very long text."""
    rng = random.Random(seed)
    out = [prose(rng, rng.randint(25, 120)) for _ in range(40)]
    passage = prose(rng, 70)
    out += [out[3], out[3], out[5].replace(" ", "\n", 3)]
    out += [f"{prose(rng, 15)} {passage} {prose(rng, 12)}" for _ in range(6)]
    words = out[7].split(" ")
    for k in range(4):
        out.append(" ".join([*words[:k], "changed", *words[k + 1 :]]))
    line = prose(rng, 9)
    out += ["", "   \n\t", None, "one", "a b c", "\n".join([line] * 8), " ".join(["x y z"] * 30), prose(rng, 6000), "é" * 5000, "a\x0bb\x0cc d " * 12]
    return out


@pytest.fixture(scope="session")
def rows():
    return [(i, t, "en", f"s{min(i % 7, 3)}", None if t is None else len(t)) for i, t in enumerate(texts())]


@pytest.fixture(scope="session")
def docs(spark, rows):
    """The rows, and an extra column with names that operators use inside, nulls and repeated rows."""
    return spark.createDataFrame([(*r, "x") for r in rows], COLUMNS + ", kept string").repartition(3)


@pytest.fixture(scope="session")
def no_docs(spark):
    return spark.createDataFrame([], COLUMNS)
