import pytest

LONG = " ".join(f"Word{i * 7919 % 4999} über" for i in range(6000))
REPEATED = "the quick brown fox jumps over the lazy dog while nine more words follow here to make a passage that is well over fifty bytes"


@pytest.fixture(scope="session")
def odd(spark):
    """Nulls, empty and very long texts, ties, repeated rows, and columns whose names operators use themselves."""
    rows = [
        (1, None), (2, ""), (3, " \t\n"), (4, "a"), (5, "A b c"), (6, LONG), (7, LONG), (8, "x" * 120_000), (None, "no id here but some words all the same"), (None, None),
        (9, "same words in two rows with one id"), (9, "same words in two rows with one id"), (10, "sameWords"), (11, " same Words"), (12, " sameWords"), (13, REPEATED), (14, "before " + REPEATED + " after"), (15, "ééé <|endoftext|> 中文 \x1f İstanbul ﬁ don't"), (-3, "a"),
    ]
    names = "doc_id long, text string, shard int, n int, sha string, fp long, class string, score double, lang string, source string, n_chars long"
    return spark.createDataFrame([(i, t, 1, 2, "s", 3, "c", 0.5, None, None, len(t or "")) for i, t in rows], names)


@pytest.fixture(scope="session")
def none(odd):
    return odd.filter("doc_id > 1000")


@pytest.fixture(scope="session")
def tokenizer():
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")
