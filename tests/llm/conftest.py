import hashlib
import random
import re

import pytest

WORD = re.compile(rb"[^\x20\x09-\x0D]+")


def words(text, lower=False):
    raw = (text or "").encode()
    return WORD.findall(raw.lower() if lower else raw)


def sha(data):
    return hashlib.sha256(data).hexdigest()


#: Texts that break careless code: nothing, separators alone, controls, odd white space, joined scripts, one long text.
ODD = [None, "", " \t\n", "a", "one two three four five", "A\x00B \x1c\x85  nbsp", "Éte straße İI ΣΑΣ don't 12,5 ½ <|endoftext|> x\x01y", "日本語 한글 😀 ​", "w " * 5000]


@pytest.fixture(scope="session")
def odd_docs(spark):
    """Odd texts with null and repeated ids, repeated rows and columns whose names clash with inner ones."""
    rows = [(i, t, f"s{i % 3}" if i % 4 else None, "en") for i, t in enumerate(ODD)]
    rows += [(None, "no id here at all", "s1", None), (3, "another text of id three", "s1", "fr"), rows[4], rows[4]]
    return spark.createDataFrame([(*r, 1, "x", b"y", 2.0, True, 7) for r in rows], "doc_id long, text string, source string, lang string, n int, class string, media binary, key double, keep boolean, size int")


@pytest.fixture(scope="session")
def no_docs(odd_docs):
    return odd_docs.where("false")


def prose(rng: random.Random, n: int, vocabulary: int = 400) -> list[str]:
    return [f"w{rng.randrange(vocabulary)}" for _ in range(n)]
