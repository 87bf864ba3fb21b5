import pytest

DOCS = "doc_id long, text string, lang string, source string, n_chars long"


@pytest.fixture(scope="session")
def make_docs(spark):
    def make(rows):
        return spark.createDataFrame([(i, t, "en", "s", None if t is None else len(t)) for i, t in rows], DOCS)

    return make


@pytest.fixture(scope="session")
def prose():
    """Texts with copies, near copies, shared passages and edge rows."""
    import random

    rng = random.Random(5)
    words = [f"w{i}" for i in range(400)]
    shared = " ".join(rng.choices(words, k=40))
    out = []
    for i in range(40):
        own = rng.choices(words, k=rng.choice([1, 2, 5, 9, 20, 60, 150]))
        out.append((i, " ".join(own)))
        if i % 4 == 0:
            out.append((100 + i, out[-1][1]))
            near = list(own)
            near[len(near) // 2] = "changed"
            out.append((200 + i, " ".join(near)))
        if i % 5 == 0:
            out.append((300 + i, out[-1][1] + "\n" + shared + " éà " + out[-1][1][:30]))
    out += [(900, ""), (901, None), (902, "one"), (903, "ONE"), (904, "two words"), (905, "x" * 400), (906, "x" * 399 + "y"), (907, " \n\t ")]
    return out
