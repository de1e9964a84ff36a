import random

import pytest

WORDS = "the of and stone river light garden winter paper bridge window morning letter silver engine market".split()


def prose(seed: int, n: int) -> str:
    rng = random.Random(seed)
    return " ".join(rng.choice(WORDS) + rng.choice(["", "ing", "ed", "er", "s"]) for _ in range(n))


@pytest.fixture(scope="session")
def awkward(spark):
    """Nulls, empty, blank and very long texts, repeated rows, and columns operators might add."""
    rows = [
        (1, prose(1, 60)), (2, prose(1, 60)), (2, prose(1, 60)), (3, None), (4, ""), (5, " \t\n "), (6, "12 34"),
        (7, prose(7, 30_000)), (8, "a" * 20_000), (None, prose(9, 40)), (None, None), (10, "💥 é ñ ﬁ \u0000 x"),
        (11, prose(11, 2)),
    ]
    extra = ["score", "lang", "fp", "h", "k", "component_id", "label", "text2", "n_chars", "rank", "bucket"]
    return spark.createDataFrame(
        [(*r, *map(str, range(len(extra)))) for r in rows],
        "doc_id long, text string, " + ", ".join(f"{c} string" for c in extra),
    )


@pytest.fixture(scope="session")
def none(awkward):
    return awkward.limit(0)
