import pytest

# Columns whose names clash with working columns of the operators, and one that is NULL throughout.
EXTRA = ("row", "bucket", "u", "v", "fingerprint", "start", "n", "batch", "label", "score", "node")


@pytest.fixture
def writeups(spark):
    """Writeup entries from ``(entry_id, body)`` pairs, with clashing extra columns."""

    def make(rows, kind="bigint", extra=True):
        names = EXTRA if extra else ()
        data = [(i, b, *[None if k % 2 else "x" for k in range(len(names))]) for i, b in rows]
        schema = f"entry_id {kind}, body string" + "".join(f", `{c}` string" for c in names)
        return spark.createDataFrame(data, schema).repartition(3)

    return make


@pytest.fixture(scope="session")
def awkward():
    """Texts that break naive code: NULL, empty, blank, very long, repeated, non-ASCII, control characters."""
    return [
        None, "", " \t\n", "word", "a b c d", "a b c d", "Ärger ünd Öl   x", "x" * 50_000, "lorem ipsum " * 5_000,
        "\x1cfoo\x1dbar", "1.2.3.4.5", "@", "++", "((((", "http://", "😀 emoji 😀", "tab\tsep\x0bvt\x0cff", "MIT LICENSE mit-license",
    ]
