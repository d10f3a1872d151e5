"""The alias table of any size against trying every alias, with a run of characters that half of all names share."""

import random

from marquee.operators import venues


def test_equals_trying_every_alias(spark):
    rng = random.Random(4)
    words = ["the", "old", "barn", "hall", "cat", "red", "inn", "a", "on", "lake"]

    def text():
        return " ".join(rng.choice(words) for _ in range(rng.randint(1, 4)))

    names = [("the " if i % 2 else "") + text() + (str(i) if i % 3 == 0 else "") for i in range(150)] + ["", "th", "x", None, " The Old Barn "]
    aliases = [(i, text(), f"C{i}") for i in range(60)] + [(60, "th", "C60"), (61, "zzz", "C61")]
    got = {r.name: r.venue for r in venues.resolve_with_table(spark.createDataFrame([(n,) for n in names], "name string"),
                                                              spark.createDataFrame(aliases, "alias_rank int, alias string, canonical string"), "name", "venue").collect()}
    for n in names:
        if n is None:
            continue
        key = n.lower().strip()
        same = {c for _, a, c in aliases if a == key}
        near = next((c for _, a, c in aliases if a in key or key in a), n.strip())
        assert got[n] in same if same else got[n] == near, n
