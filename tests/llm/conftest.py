import random

import pytest

#: Columns whose names clash with what operators use inside; they must have no effect.
EXTRA = {"slot": 1, "body": "x", "row": 2, "key": "k", "text_key": 3, "_id": 4, "print": "p", "score": 0.5, "w": "w"}


@pytest.fixture(scope="session")
def docs(spark):
    """A DataFrame of (doc_id, text, lang, source) with clashing extra columns."""

    def make(rows, parts=3):
        full = [(i, t, lang, source, *EXTRA.values()) for i, t, lang, source in ((*r, None, None, None)[:4] for r in rows)]
        kinds = "slot int, body string, row int, key string, text_key int, _id int, print string, score double, w string"
        return spark.createDataFrame(full, f"doc_id long, text string, lang string, source string, {kinds}").repartition(parts)

    return make


@pytest.fixture(scope="session")
def prose():
    """Random texts with copies, near copies, shared passages, and every edge that operators must stand."""
    rng = random.Random(11)
    words = [f"w{k}" for k in range(300)] + ["Été", "naïve", "ß", "|", "a.b"]
    passage = " ".join(rng.choice(words) for _ in range(60))
    out = []
    for k in range(60):
        text = " ".join(rng.choice(words) for _ in range(rng.choice([1, 4, 13, 40, 120])))
        if k % 4 == 0:
            text = f"{text}\n{passage}\t {text[:50]}"
        if k % 7 == 0 and out:
            text = out[-1][1]
        if k % 9 == 0 and out:
            text = f"{out[-1][1]} tail{k}"
        out.append((k, text))
    out += [(60, None), (61, ""), (62, " \n\t "), (63, "x" * 3000), (64, "again and " * 2000), (65, passage), (65, passage), (None, passage), (None, None)]
    return out
