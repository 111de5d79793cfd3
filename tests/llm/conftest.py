import random
import sys
from pathlib import Path

import pytest

sys.path.insert(0, str(Path(__file__).parent))

DOCS = "doc_id long, text string, lang string, source string, n_chars long, row string, doc string, digest string, size long, fp string"


def odd_texts():
    rng = random.Random(5)
    syllables = ["ther", "ou", "éa", "ñi", "ung", "Wor", "Σa", "ko", "é", "mm", "日本", "😀x"]
    word = lambda: "".join(rng.choice(syllables) for _ in range(rng.randint(1, 4)))
    long = " ".join(word() + rng.choice(["", "", ",", ".\n", "!!", "…"]) for _ in range(60_000))
    plain = [" ".join(word() for _ in range(rng.randint(1, 300))) for _ in range(30)]
    near = [plain[3] + " extra", plain[3], plain[3].upper(), plain[4] + "\n" + plain[4]]
    return [None, "", " ", "\n\t \r\n", "one", "two words", "Don't they've we'll I'm 'tis 's", "a  b   c\n\n d \n e\t\tf \u00a0 g\u3000 h \x1c i\x85 j", "É\u0301 i\u0307 İ Σ ΑΣ H\u0331x",
            "<|endoftext|> x<|endoftext|> y", "<|startoftext|>z </s>[INST]", "line\nline\nline\nother\nline", "a b c d e " * 30, "# * $ % & | < > " * 8,
            "WORDS IN CAPITALS ONLY " * 9, "x" * 5000, "3.14 1,000 ½ ² ٣ v2.0", "\x00 \x7f", "ﬁ ﬂ Å Å", long, *plain, *near, *plain[:3]]


def odd_rows():
    texts = odd_texts()
    rows = [(n if n != 12 else None, t, "xx", None if n % 7 == 3 else f"src{n % 4}", len(t or ""), "r", "d", "g", 1, "f") for n, t in enumerate(texts)]
    return rows + rows[20:24] + rows[:2]  # repeated rows


@pytest.fixture(scope="session")
def odd(spark):
    return spark.createDataFrame(odd_rows(), DOCS).repartition(5)


@pytest.fixture(scope="session")
def none(spark):
    return spark.createDataFrame([], DOCS)


@pytest.fixture
def folder(tmp_path):
    return f"file://{tmp_path}"
