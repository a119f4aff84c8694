import random

import pytest

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, kept string, n_words long, score double, host string, n_lines long, __id long, __hash long, __of string, __drop string, __kept string, __gone long, __row long"
WORDS = "ae bo ci du el fa go hi jo ku la me no op qi ru sa ti us vo wy xu yo za".split()


def prose(seed: int, n: int) -> str:
    rng = random.Random(seed)
    return "".join(rng.choice(WORDS) + rng.choice(WORDS) + (rng.choice([" ", " ", " ", "\n", ". "]) if i < n - 1 else "") for i in range(n))


def rows():
    """Nulls, empties, blanks, repeats, case variants, near copies, shared lines, one very long text."""
    base, passage = prose(1, 120), prose(2, 60)
    near = base.split(" ")
    near[len(near) // 2] = "zzz"
    texts = [
        base, base, base.upper(), " ".join(near), passage, f"{prose(3, 40)} {passage} {prose(4, 40)}", f"{prose(5, 30)} {passage}", None, "", " \n\t ", "one", "One", "a b c", "é Ünï code 日本 <|endoftext|> it's we'll 12½",
        prose(6, 20_000), "x" * 5000, f"{passage}\n{passage}", prose(7, 80), "same line\nother", "same line\nelse",
    ]
    out = [(i, t, "en" if i % 3 else "de", "s" if i % 2 else "t", len(t or ""), "clash", 7, 0.5, "h", 3, 1, 2, "of", "drop", "kept", 5, 6) for i, t in enumerate(texts)]
    out.append(out[0])  # a repeated row
    out.append((None, "a text without an id", *[None] * 15))
    return out


@pytest.fixture(scope="session")
def docs(spark):
    return spark.createDataFrame(rows(), SCHEMA).repartition(3).cache()


@pytest.fixture(scope="session")
def empty(spark):
    return spark.createDataFrame([], SCHEMA)


@pytest.fixture(scope="session")
def bench(spark):
    passage = prose(2, 60)
    items = [(1, passage), (2, " ".join(passage.split()[:12])), (3, "a b c"), (4, None), (5, "..."), (5, "a b c"), (None, "one"), (7, prose(99, 30))]
    return spark.createDataFrame(items, "item_id long, text string")
