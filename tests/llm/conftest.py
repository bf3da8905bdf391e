import random

import pytest

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"


def sentence(r, n, stems):
    return " ".join("".join(r.choices(stems, k=r.randint(1, 3))) for _ in range(n))


@pytest.fixture(scope="session")
def small():
    """(doc_id, text) with copies, near copies, shared passages, short, empty and long texts."""
    r = random.Random(5)
    stems = ["ta", "ri", "mo", "len", "us", "ék", "dor", "fi"]
    out, texts = [], []
    shared = sentence(r, 60, stems)
    hot = sentence(r, 30, stems)
    for i in range(70):
        kind = i % 10
        if kind == 0 and texts:
            t = r.choice(texts)
        elif kind in (1, 2) and texts:
            w = r.choice(texts).split(" ")
            if len(w) > 3:
                w[r.randrange(len(w))] = "ändert"
            t = " ".join(w)
        elif kind == 3:
            t = sentence(r, r.randint(5, 60), stems) + " " + shared + "\n" + sentence(r, 20, stems)
        elif kind == 4:
            t = hot + " " + sentence(r, r.randint(1, 4), stems)
        elif kind == 5:
            t = sentence(r, r.randint(1, 6), stems)
        else:
            t = sentence(r, r.randint(30, 250), stems) + ("\nUnder the MIT License. " if kind == 6 else "")
        texts.append(t)
        out.append((100 + (i * 37) % 71, t))
    out += [(1, ""), (2, " \n\t "), (3, "x"), (4, "| ## $ %%"), (5, None), (6, "ab " * 3000), (7, "ab " * 2000), (8, "\x00 a\x00b   c\x85d")]
    return out


@pytest.fixture(scope="session")
def docs(spark, small):
    return spark.createDataFrame([(i, t, ("en", "de", "fr", None)[i % 4], f"s{i % 3}", len(t or "")) for i, t in small], SCHEMA).repartition(3)
