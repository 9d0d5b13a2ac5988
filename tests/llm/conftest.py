import pytest


@pytest.fixture(scope="session")
def corpus(spark):
    """Documents with every awkward case: NULLs, empty and long texts, copies, repeated rows, clashing columns."""
    words = "der fuchs rennt durch den wald und findet ein altes haus mit einer roten tuer am see".split()
    passage = " ".join(f"p{i}" for i in range(40))
    rows = [
        (1, "The quick brown Fox jumps over the lazy dog near the river bank today", "en"),
        (2, "the quick brown fox jumps over the lazy dog near the river bank today", "en"),
        (3, None, None), (4, "", "en"), (5, "   \n\t ", "en"), (6, " ".join(words), "de"),
        (7, " ".join(words * 400), "de"), (8, "one", None), (None, "text without an id", "en"), (None, None, None),
        (9, passage, "en"), (10, "start " + passage + " end", "en"),
        (11, "a\nb\nc\nd\ne", "en"), (12, "x\na\nb\nc\ny", "en"), (13, "q\na\nb\nc\nd\nz", "en"),
        (14, "Élan été 　 naïve ÉÈ words", "fr"), (15, "stupid idiot. a fine day.", "en"),
        (1, "The quick brown Fox jumps over the lazy dog near the river bank today", "en"),
        (16, "\n\n\n\n", "en"), (17, "\n\n\n\n", "en"),
    ]
    return spark.createDataFrame(
        [(i, t, lang, "clash", 0.5, 7) for i, t, lang in rows],
        "doc_id LONG, text STRING, lang STRING, key STRING, rate DOUBLE, shard INT")


@pytest.fixture(scope="session")
def no_documents(corpus):
    return corpus.limit(0)
