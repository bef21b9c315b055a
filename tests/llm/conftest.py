import pytest
from pyspark.sql import functions as F

#: Short, empty, blank, null, repeated and long texts, null ids and metadata, and columns named like results.
WORDS = "the a of and to in is on by it at be as or an no we he so do go up my".split()


def prose(n, seed):
    import random

    rng = random.Random(seed)
    return " ".join(rng.choice(WORDS) + rng.choice(["", "s", "ing", "er", "ed", "ly"]) for _ in range(n))


def rows():
    texts = [
        None, "", "   \n\t ", "one", "two words", "a b c a b c a b c", "same line\nsame line\nother\n\n \nsame line",
        prose(80, 1), prose(80, 1), prose(400, 2), prose(60, 3) + "\n" + prose(60, 3), "LOUD!! " * 80, "x $$$ y *** z %%% " * 40,
        "été " * 60 + "\U0001d54f\x0b\x0cend stays", "a" * 5000, prose(3000, 4), "tab\tsep\rcr " * 30,
    ]
    out = [(i, t, ["en", "fr", None][i % 3], ["s0", "s0", "s1", None][i % 4], len(t or "")) for i, t in enumerate(texts)]
    out += [(None, prose(70, 5), "en", "s0", 1), (None, None, None, None, None), out[9], out[9]]
    out += [(100 + i, prose(55 + i % 20, 10 + i), ["en", "fr"][i % 2], "s0", 7) for i in range(60)]
    return out


@pytest.fixture(scope="session")
def docs(spark):
    schema = "doc_id long, text string, lang string, source string, n_chars long"
    return spark.createDataFrame(rows(), schema).repartition(3)


@pytest.fixture(scope="session")
def clashing(docs):
    """The same rows with columns named like what operators add."""
    names = ("kept n_words pii shard slot curve copy shuffle_key component_id fingerprint score sequence_id length stratum "
             "rule value verdict host path line_no _t _w _key").split()
    return docs.withColumns({n: F.lit("own") for n in names})


@pytest.fixture(scope="session")
def empty(docs):
    return docs.limit(0)
