import pytest
from pyspark.sql import functions as F

WORDS = "ever some light under stone river cloud winter paper green house north quiet field amber glass".split()


def prose(seed: int, n: int) -> str:
    out, x = [], seed * 7919 + 17
    for _ in range(n):
        x = (x * 6364136223846793005 + 1442695040888963407) % (1 << 64)
        out.append(WORDS[(x >> 33) % len(WORDS)] + str((x >> 40) % 97))
    return " ".join(out) + "."


SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"


@pytest.fixture(scope="session")
def awkward_rows():
    long = prose(5, 30_000)
    return [
        (1, prose(1, 60), "en", "a", 5),
        (2, prose(1, 60), "en", "a", None),
        (2, prose(1, 60), "en", "a", None),
        (3, None, None, None, None),
        (4, "", "en", None, 0),
        (5, " \n\t ", None, "b", 4),
        (6, long, "de", "b", 1),
        (7, long + " tail", "de", "b", 1),
        (None, prose(2, 30), "en", "a", 1),
        (None, None, None, None, None),
        (8, "a" * 50_000, "en", "a", 1),
        (9, "日本語 текст é\x00\x01 😀", "en", "a", 1),
        (10, prose(1, 59) + " changed", "en", "a", 5),
        (10, prose(9, 40), "en", "b", 5),
        (-4, "one", "en", "b", 3),
    ]


@pytest.fixture(scope="session")
def awkward(spark, awkward_rows):
    """Nulls, empty, long and repeated texts, ties, and columns with the names that operators use inside."""
    docs = spark.createDataFrame(awkward_rows, SCHEMA)
    clashing = (
        "id row own digest load kept keep_id root cls sig key n p host path features rows share _b _ghost "
        "sketch whole spans near term terms vslot place slot shard size law any_kept rep unit side step"
    ).split()
    return docs.select("*", *[F.lit(f"own {name}").alias(name) for name in clashing])


@pytest.fixture(scope="session")
def empty(awkward):
    return awkward.where("false")
