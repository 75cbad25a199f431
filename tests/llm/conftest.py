import pytest

DOCS = "doc_id long, text string, lang string, source string, n_chars long"
#: Columns named like those that the operators use inside.
CLASH = ["key", "h", "s", "line", "node", "sig", "class", "total", "group", "keep", "lost", "site", "bucket", "fine", "kind", "index", "word", "v", "component"]


@pytest.fixture(scope="session")
def make(spark):
    def docs(rows, clash=False):
        """Rows of (doc_id, text[, lang[, source]])."""
        full = [(r[0], r[1], r[2] if len(r) > 2 else "en", r[3] if len(r) > 3 else "src0", None if r[1] is None else len(r[1])) for r in rows]
        df = spark.createDataFrame(full, DOCS)
        if clash:
            from pyspark.sql import functions as F

            df = df.withColumns({c: F.lit(f"own {c}") for c in CLASH})
        return df

    return docs


WORDS = "alpha beta gamma delta epsilon zeta eta theta iota kappa lambda mu nu xi omicron pi rho sigma tau upsilon phi chi psi omega".split()


@pytest.fixture(scope="session")
def prose():
    import random

    def text(seed, n=60):
        rng = random.Random(seed)
        return " ".join(rng.choice(WORDS) + rng.choice(["", "", "s", "ed", "ing"]) + (rng.choice(".,") if rng.random() < 0.1 else "") for _ in range(n))

    return text


@pytest.fixture(scope="session")
def messy(make, prose):
    """Nulls, empty and long texts, ties, repeated rows, clashing columns."""
    base = prose(1)
    rows = [(1, base), (1, base), (2, base), (None, base), (3, None), (4, ""), (5, "   "), (6, "x"), (None, None), (7, prose(7, 40000), None, None), (8, base + " more", "en", None),
            (9, "\n\n###"), (8, "of another text with the same id")]
    return make(rows, clash=True)
