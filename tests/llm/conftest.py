import pytest

DOCS = "doc_id long, text string, lang string, source string, n_chars long"


@pytest.fixture(scope="session")
def corpus():
    """Small corpora with the awkward cases: nulls, empty, blank and long texts, ties, copies, near copies."""
    import random

    rnd = random.Random(11)
    vocab = [f"w{k}" for k in range(60)] + ["été", "Über.", "don't", "x,"]
    words = lambda n: [rnd.choice(vocab) for _ in range(n)]
    passage = words(70)
    base = words(200)
    texts = [None, "", " \n\t ", "one", "one two three four", "One TWO three four"]
    texts += [" ".join(base), " ".join(base), " ".join(base[:-2]), " ".join(base[:150] + words(60)), "  ".join(base).upper()]
    texts += [" ".join(words(30) + passage + words(30)) for _ in range(6)] + [" ".join(passage[:55] + words(20)), " ".join(words(5) + passage[10:])]
    texts += [" ".join(["same"] * 300), " ".join(["same"] * 120), "line a b\n" * 40, " ".join(words(8000)), "\n".join(" ".join(words(12)) for _ in range(20))]
    texts += [" ".join(words(rnd.randint(1, 120))) for _ in range(60)]
    rows = [(k * 3 % 1009, t, rnd.choice(["en", "fr", None]), rnd.choice(["s0", "s0", "s1", None]), len(t or "")) for k, t in enumerate(texts)]
    rnd.shuffle(rows)
    return rows


@pytest.fixture(scope="session")
def docs(spark, corpus):
    return spark.createDataFrame(corpus, DOCS).repartition(3).cache()


@pytest.fixture(scope="session")
def odd(spark):
    """Null ids, repeated rows, and columns with names that operators use inside."""
    text = " ".join(f"w{k}" for k in range(120))
    rows = [(None, text, "en", "s", 1, "a", 1), (None, None, None, None, None, None, None), (5, text, "en", "s", 1, "a", 1), (5, text, "en", "s", 1, "a", 1), (2, "", "en", "s", 1, "b", 2)]
    return spark.createDataFrame(rows, DOCS + ", block string, label long").withColumnsRenamed({"block": "node"})


@pytest.fixture(scope="session")
def none(spark):
    return spark.createDataFrame([], DOCS)
