import random

import pytest

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"


@pytest.fixture(scope="session")
def docs(spark):
    """A documents table of (doc_id, text) pairs, over several partitions; ``more`` adds columns with clashing names."""

    def build(pairs, more=(), parts=3):
        names = ("en", "de", None)
        rows = [(i, t, names[k % 3], f"src{k % 4}" if k % 5 else None, None if t is None else len(t), *["x"] * len(more)) for k, (i, t) in enumerate(pairs)]
        return spark.createDataFrame(rows, SCHEMA + "".join(f", {c} string" for c in more)).repartition(parts)

    return build


def prose(n, seed=0, words=("the", "of", "and", "river", "stone", "quiet", "morning", "walked", "under", "Bridge", "light,", "slowly.", "é", "漢字", "x1")):
    rng = random.Random(seed)
    return " ".join(rng.choice(words) + str(rng.randint(0, 30)) * (rng.random() < 0.3) for _ in range(n))


@pytest.fixture(scope="session")
def edge_pairs():
    """Null and empty texts, null ids, ties, repeated rows, white space only, a very long text, a text without white space."""
    a = prose(120, 1)
    return [(5, a), (5, a), (7, a), (3, None), (4, ""), (None, prose(40, 2)), (None, None), (9, " \n\t "), (8, "one"), (10, "two words"),
            (11, prose(30000, 3)), (12, "z" * 30000), (13, prose(80, 4)), (13, prose(80, 5)), (14, a.replace("river", "rivers", 1)), (-2, "é" * 17), (2**40, prose(60, 6))]
