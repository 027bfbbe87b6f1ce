import random

import pytest

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, fp string, Score double, kept_id long, n_words string"


def documents(seed=1, n=60):
    """Documents with copies, near copies, shared passages, nulls, empty and odd texts, repeated rows, and columns with clashing names."""
    rnd = random.Random(seed)
    words = ["".join(rnd.choice("abcdeiéou") for _ in range(rnd.randint(1, 7))) for _ in range(150)]
    sentence = lambda k: " ".join(rnd.choice(words) for _ in range(k))
    passage = sentence(30)
    texts = [sentence(rnd.randint(1, 80)) for _ in range(n)]
    texts += [texts[0], texts[1] + " x", texts[2].upper(), texts[3] + "\n" + passage, passage + "\t" + texts[4], passage, passage * 2]
    texts += ["", " \n ", None, "a", "The  \t double  space ", "x\x1cy z w", "🎉 emoji <|endoftext|> and ▁", "w " * 3000 + passage, "zzz" * 400, None]
    rows = [(3 * k, t, "en", "src1", len(t or ""), "y", 0.5, 7, None) for k, t in enumerate(texts)]
    return rows + [rows[5], rows[5], (None, texts[6], None, None, None, None, None, None, None)]


@pytest.fixture(scope="session")
def docs(spark):
    return spark.createDataFrame(documents(), SCHEMA).repartition(3).cache()


@pytest.fixture(scope="session")
def nothing(spark):
    return spark.createDataFrame([], SCHEMA)
