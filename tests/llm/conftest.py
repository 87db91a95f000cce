import random

import pytest

DOCS = "doc_id long, text string, lang string, source string, n_chars long"
#: Extra columns whose names operators might use inside.
EXTRA = ", key string, text_key string, spans string, _pii_key string, row string, host string"


def messy_texts() -> list[str | None]:
    """Prose with copies, ties, repeated rows, nulls, blanks and one long text."""
    rng = random.Random(7)
    syllables = ["an", "the", "er", "ou", "ing", "é", "ß", "st", "re", "ti"]
    word = lambda: "".join(rng.choice(syllables) for _ in range(rng.randint(1, 4)))
    line = lambda n: " ".join(word() for _ in range(n))
    texts: list[str | None] = ["\n".join(line(rng.randint(3, 12)) for _ in range(rng.randint(1, 6)))
                               for _ in range(40)]
    base = "\n".join(line(30) for _ in range(6))
    changed = base.split(" ")
    for k in range(12):
        changed[20 + 9 * k % 150] = word()
        texts.append(" ".join(changed))
    texts += [base, base, base, None, None, "", " \t\n\x0b ", "one", "One", "two words",
              "a b c d", "A b\nc  d", "\x1c\x85\xa0 odd space", "<|endoftext|> and |<|im_end|>",
              "x" * 3000, "ab " * 4000, "1.2.3.4 me@a.b +1 (262) 555-3752 4703443633947811",
              "\U0001f600 \U0001f600 a.b@c.d\U0001f600 256.1.1.1 0.0.0.0.0 +12-34 5"]
    return texts


@pytest.fixture(scope="session")
def messy(spark):
    texts = messy_texts()
    rows = [(i, t, "en", None if i % 7 == 3 else f"s{i % 3}", None if t is None else len(t))
            for i, t in enumerate(texts)]
    rows += [rows[4], rows[4], rows[45], (None, texts[5], None, None, None),
             (None, "only null key", None, "s1", 3)]
    clash = [(*r, "k", "t", "s", "p", "r", "h") for r in rows]
    return spark.createDataFrame(clash, DOCS + EXTRA)


@pytest.fixture(scope="session")
def nothing(spark):
    return spark.createDataFrame([], DOCS + EXTRA)
