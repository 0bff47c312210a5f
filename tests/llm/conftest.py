"""Frames of odd rows: null and empty values, ties, repeats, and extra columns whose names clash with ours."""

import random
import sys
from pathlib import Path

import pytest

sys.path.insert(0, str(Path(__file__).resolve().parent.parent))
CHECK = "/root/testdata/sf0.001"


@pytest.fixture
def documents(spark):
    """Makes documents from (doc_id, text); `key`, `fp`, `_row` and others are columns of the table here."""

    def make(rows):
        full = [(i, t, "en", "s", len(t or ""), 7, 8, 9, "x") for i, t in rows]
        return spark.createDataFrame(full, "doc_id long, text string, lang string, source string, n_chars long, key long, fp long, _row long, _sha string").repartition(3)

    return make


def odd_texts():
    """Texts with every oddity, some equal but for blanks."""
    rng = random.Random(11)
    words = ["alpha", "Beta", "gamma", "délta", "　", "e.", "zz\x0bq", "ß", "12", "!!", "</s>", "<|end|>"]
    long = " ".join(rng.choice(words) for _ in range(9000))
    base = " ".join(f"w{rng.randint(0, 400)}" for _ in range(120))
    near = base.replace("w1", "v1", 1)
    return [
        (1, None), (2, ""), (3, "  \n"), (4, "one"), (5, "one two"), (6, base), (7, base), (7, base), (8, base.replace(" ", "  ")), (9, near), (10, long), (None, base), (None, None), (11, "a a a " * 30), (12, base + " " + long[:3000]), (13, "\x1c x y"),
    ]
