import random

import pytest


@pytest.fixture(scope="session")
def texts():
    """Texts with copies, near copies, shared passages, blanks, nulls and a very long one."""
    rng = random.Random(5)
    word = lambda: "".join(rng.choice("abcdeé") for _ in range(rng.randint(1, 5)))
    vocabulary = [word() for _ in range(400)]
    passage = [rng.choice(vocabulary) for _ in range(60)]
    out = [None, "", " \n\t", "One", "one", "Two words", "a b c d", "A b c d"]
    for i in range(60):
        words = [rng.choice(vocabulary) for _ in range(rng.randint(5, 120))]
        if i % 5 == 0:
            words[3:3] = passage[: rng.randint(30, 60)]
        out.append(" ".join(words))
        if i % 4 == 0:
            near = list(words)
            for _ in range(rng.randint(0, 4)):
                near[rng.randrange(len(near))] = rng.choice(vocabulary)
            out += [" ".join(near), "  ".join(near), " ".join(words).upper()]
    out.append(" ".join(rng.choice(vocabulary) for _ in range(15_000)))
    out += ["x y z " * 30, "line\nline\n\nline # $\n" + "w " * 25]
    return out


@pytest.fixture(scope="session")
def docs(spark, texts):
    """doc_id, text and other columns, some of whose names results also use; one row twice."""
    rows = [(i, t, "en", f"s{i % 3}", len(t or ""), i) for i, t in enumerate(texts)]
    rows.append(rows[9])
    return spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long, vertex long").cache()


@pytest.fixture(scope="session")
def none(docs):
    return docs.where("false")
