import random

import pytest

WORDS = [a + b + c for a in ("th", "er", "on", "an", "re", "he") for b in ("in", "ed", "nd", "ha", "at") for c in ("", "en", "es", "of")]
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"


def sentence(rnd, n):
    w = [rnd.choice(WORDS) for _ in range(n)]
    return " ".join([w[0].title(), *w[1:]]) + "."


def text(rnd, sentences):
    return "".join(sentence(rnd, rnd.randrange(4, 14)) + rnd.choice(" \n") for _ in range(sentences)).strip()


def make_rows(seed=1, n=40):
    """(id, text): plain, exact and near copies, shared passages, nulls, empties, blanks, long and repeated rows."""
    rnd = random.Random(seed)
    base = [text(rnd, rnd.randrange(3, 30)) for _ in range(n)]
    rows = list(enumerate(base))
    passage = " ".join(sentence(rnd, 9) for _ in range(8))
    for k in range(6):
        w = base[k].split(" ")
        w[rnd.randrange(len(w))] = "changed"
        rows.append((100 + k, " ".join(w)))
        rows.append((200 + k, base[k]))
        rows.append((300 + k, text(rnd, 5) + " " + passage + " " + text(rnd, 3)))
    rows += [(400, None), (401, ""), (402, "  \n\t "), (403, "one"), (404, "One"), (405, "two words"), (None, base[0]), (None, None), (406, text(rnd, 3000)), (1, base[1]), (1, base[1]), (1, base[2] + " other")]
    rows += [(407, "Ünï cödé “quoted” text with wide spaces　and 中文字 and emoji 😀.\r\n\r\nEnd"), (408, "x" * 5000), (409, "!!! ??? ...")]
    rnd.shuffle(rows)
    return rows


@pytest.fixture(scope="session")
def rows():
    return make_rows()


@pytest.fixture(scope="session")
def docs(spark, rows):
    return spark.createDataFrame([(i, t, None, None if i is None else f"s{i % 3}", None) for i, t in rows], SCHEMA).repartition(5).cache()


@pytest.fixture(scope="session")
def empty(spark):
    return spark.createDataFrame([], SCHEMA)
