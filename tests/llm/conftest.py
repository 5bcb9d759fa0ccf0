import sys
from pathlib import Path

import pytest

sys.path.insert(0, str(Path(__file__).parent))

TEXTS = [
    None, "", "   \n\t ", "one", "Two words", "Mail a.b@c.de or +49 (30) 1234567, card 4111 1111 1111 1111, host 10.0.0.255!",
    "x@y.z_w@v.u +1 1.2.3.4.5.6.7.8 999.1.1.1 5500005555555559", "ÄRGER Straße naïve \U0001f600 a@b.co   tail 0001.2.3.4", "DE89 3704 0044 0532 0130 00 account iban",
    "the quick brown fox jumps over the lazy dog and runs far away from here today", "the quick brown fox jumps over the lazy dog and runs far away from here today",
    "The Quick brown fox jumps over the lazy dog and runs far away from here now", "word " * 30_000, "a" * 60_000, "1" * 40_000, "a.b@" * 20_000, "9 " * 20_000,
]


@pytest.fixture(scope="module")
def docs(spark):
    """Nulls, empty, odd, repeated and very long texts; repeated and null ids; a column with a clashing name."""
    rows = [(k, t, "en", "s", len(t or ""), 1.5) for k, t in enumerate(TEXTS)]
    rows += [(3, "one", "en", "s", 3, 0.5), (None, "without an id", None, None, None, None)]
    return spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long, score double").repartition(3)


@pytest.fixture(scope="module")
def none(docs):
    return docs.where("false")
