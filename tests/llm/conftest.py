import random
import sys
from pathlib import Path

import pytest

sys.path.insert(0, str(Path(__file__).resolve().parent))

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, score double, run int, stat_words int, component_id string"


def edge_texts() -> list[str | None]:
    """Nulls, empty texts, ties, repeats, one-word and long texts, signs and scripts."""
    rng = random.Random(5)
    words = ["".join(rng.choices("abcdefgh", k=rng.randint(1, 5))) for _ in range(300)]
    prose = lambda n: " ".join(rng.choices(words, k=n))
    base, passage = prose(120), prose(70)
    near = base.split()
    near[60] = "changed"
    return [
        None, "", "   ", "\n\n\n", "one", "ONE", "two words", "\t two\x0bwords ", base, base, base.upper(), " ".join(near),
        "x" * 1000, "ab" * 300, "é" * 250, "日本語 テスト " * 40, passage + " tail one", "head two " + passage, passage + " " + passage,
        prose(20_000), "line a\nline b\nline c\n" * 5, "line a\nline b\nline c", "All rights reserved. CC-BY cc by",
        "GNU General Public License version 3; licensed under the MIT License", "!!! ??? ...", "12 34 56", "\x00 nul \x1c sep",
        "don't 'S we'RE", "<|endoftext|> text ★ sign", "naïve café" + chr(0x301), prose(5), prose(4),
    ]


@pytest.fixture(scope="session")
def edge_rows() -> list[tuple[int, str | None]]:
    texts = edge_texts()
    order = list(range(len(texts)))
    random.Random(1).shuffle(order)
    return [(3 * i + 7, texts[k]) for i, k in enumerate(order)]


@pytest.fixture(scope="session")
def edge_docs(spark, edge_rows):
    """The rows with columns whose names the operators use themselves."""
    rows = [(d, t, None, None, None, 0.5, 1, 2, "c") for d, t in edge_rows]
    return spark.createDataFrame(rows, SCHEMA).repartition(4)


@pytest.fixture(scope="session")
def no_docs(spark):
    return spark.createDataFrame([], SCHEMA)


@pytest.fixture(scope="session")
def repeated_docs(spark):
    """Rows that repeat id and text, and a row without an id."""
    text = " ".join(f"w{i}" for i in range(80))
    rows = [(4, text), (4, text), (9, text), (None, text), (None, None), (11, None)]
    return spark.createDataFrame(rows, "doc_id long, text string")
