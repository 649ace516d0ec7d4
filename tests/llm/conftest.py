import random

import pytest


@pytest.fixture(scope="session")
def edge_docs(spark):
    """Nulls, empty and long texts, ties, repeated rows, and columns whose names
    operators use themselves."""
    rng = random.Random(5)
    words = [f"{a}{b}" for a in ("ba", "ko", "ri", "tu", "Ze", "5", "x|") for b in ("n", "st", "ou", "lé", ".", ",")]
    say = lambda n: " ".join(rng.choice(words) for _ in range(n))
    lines = [say(rng.randint(3, 12)) for _ in range(60)]
    texts = [None, "", " \n\t\n ", "a", "a b", "one two three", "\n".join(lines[:9]), "\n".join(lines[3:12]), "\n\n".join(lines[3:12]), say(30_000), "x" * 1500, "ab" * 900, "éßЖ" * 300, "a  b   c\x0bd\x0ce\rf"]
    base = say(160)
    texts += [base, base, base + " end", "Start " + base, say(80) + base[:500] + say(60), base[100:700]]
    texts += ["\n".join(rng.choice(lines) for _ in range(rng.randint(1, 25))) for _ in range(60)]
    rows = [(i, t, rng.choice(["en", "fr", None]), rng.choice(["s1", "s2", None]), None if t is None else len(t)) for i, t in enumerate(texts)]
    rows += [rows[6], rows[6], rows[15], (None, texts[14], None, None, 3), (None, None, None, None, None), (None, texts[7], "en", "s1", 1)]
    clash = ["_id", "_text", "fp", "n", "row", "words", "spans", "queue", "kept", "place", "gram", "removed_lines", "_row", "source_", "h"]
    df = spark.createDataFrame([r + tuple("clash" for _ in clash) for r in rows], "doc_id long, text string, lang string, source string, n_chars long, " + ", ".join(f"`{c}` string" for c in clash)).repartition(5)
    df.rows = rows
    return df


@pytest.fixture(scope="session")
def no_docs(spark):
    return spark.createDataFrame([], "doc_id long, text string, lang string, source string, n_chars long")


@pytest.fixture(scope="session")
def documents(spark, sf):
    df = spark.read.parquet(f"{sf}/documents.parquet").repartition(6)
    df.rows = [tuple(r) for r in spark.read.parquet(f"{sf}/documents.parquet").collect()]
    return df
