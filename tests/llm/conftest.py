import random

import pytest

SCHEMA = ("doc_id long, text string, lang string, source string, n_chars long, "
          "id string, size string, h string, fp string, blob string, node int, score string, key string, found string")


def rows_of(docs):
    """Rows with the extra columns that clash with the operators' own names."""
    return [(i, t, "en", s, len(t or ""), "x", "y", "z", "fp", "blob", 1, "score", "key", "found") for i, t, s in docs]


@pytest.fixture(scope="session")
def awkward():
    """(doc_id, text, source): nulls, empties, repeats, ties, a very long text, a hot group."""
    r = random.Random(3)
    words = ["the", "data", "token=abcdef123", "Überweisung", "<|endoftext|>", "don't", "naïve", "\n\n", "x" * 90,
             "AKIA" + "Q" * 18, "deadbeef" * 4, "中文", "😀", "  ", "we'll", "1234", "!?", "password: 'hunter22'"]
    long = " ".join(r.choice(words) for _ in range(30_000))
    docs = [(1, None, "a"), (2, "", "b"), (3, " \t\n", None), (4, "one", "a"), (None, "two words", "b"), (None, None, None),
            (5, "same text here again and again", "a"), (5, "same text here again and again", "a"), (6, long, "c"),
            (7, "a" * 3000, "c"), (8, "secret:token:abcdefgh", "a"), (9, "TOKEN = abc", "a")]
    docs += [(100 + i, "a group of copies that is hot and holds many rows", "hot") for i in range(60)]
    docs += [(200 + i, " ".join(r.choice(words) for _ in range(r.randrange(1, 80))), r.choice("abcde")) for i in range(60)]
    return docs


@pytest.fixture(scope="session")
def awkward_df(spark, awkward):
    return spark.createDataFrame(rows_of(awkward), SCHEMA).repartition(5)


@pytest.fixture(scope="session")
def empty_df(spark):
    return spark.createDataFrame([], SCHEMA)


@pytest.fixture(scope="session")
def tokenizer():
    import public_tokenizers
    return public_tokenizers.path("byte_bpe_50k.json")


@pytest.fixture(scope="session")
def library(tokenizer):
    from tokenizers import Tokenizer
    return Tokenizer.from_file(tokenizer)
