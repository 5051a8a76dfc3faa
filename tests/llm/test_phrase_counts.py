"""What the exact count of the phrases is asked for."""

from tickloom.llm import collocations


def test_words_outside_frequent_pairs_are_not_counted(spark):
    """``z`` is frequent but in no frequent pair; ``a b`` is one, and all occurrences of its words count."""
    texts = [f"a b x{i} z y{i} a" for i in range(30)]
    docs = spark.createDataFrame([(i, t, "en") for i, t in enumerate(texts)], "doc_id long, text string, lang string").repartition(4)
    phrases, _ = collocations.frequent_phrases(docs, support=20)
    assert {(r["phrase"], r["a"]) for r in phrases.collect()} == {("a", 60), ("b", 30), ("a b", 30)}
