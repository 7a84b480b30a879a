"""Documents for the tests of this folder."""

import random

SCHEMA = "doc_id bigint, text string, lang string, source string, n_chars bigint"
CLASHING = ["score", "shard", "n", "key", "spans", "items", "_gone", "_doc", "_lines", "grp", "part", "component_id"]


def sentence(rng, n, size=400):
    return " ".join(f"w{rng.randrange(size)}" for _ in range(n))


def corpus(seed=1, n=60):
    """Texts with exact and near copies, shared passages and lines, empty and very short ones."""
    rng = random.Random(seed)
    passage, line = sentence(rng, 40), sentence(rng, 12)
    texts = []
    for k in range(n):
        kind = k % 6
        if kind == 0 or not texts:
            t = "\n".join(sentence(rng, rng.randrange(5, 40)) for _ in range(rng.randrange(1, 5)))
        elif kind == 1:
            t = rng.choice(texts)
        elif kind == 2:
            w = rng.choice(texts).split(" ")
            for _ in range(rng.randrange(1, 3)):
                w[rng.randrange(len(w))] = f"x{rng.randrange(99)}"
            t = " ".join(w)
        elif kind == 3:
            t = sentence(rng, 10) + "\n" + passage + "\n" + sentence(rng, 8)
        elif kind == 4:
            t = line + "\n" + sentence(rng, 15)
        else:
            t = sentence(rng, rng.randrange(0, 7), 9) + rng.choice(["", "é", "\n\n", " ß\t"])
        texts.append(t)
    return texts


def documents(spark, texts, first=0):
    rows = [(first + k, t, "en", f"s{k % 3}", None if t is None else len(t)) for k, t in enumerate(texts)]
    return spark.createDataFrame(rows, SCHEMA)


def odd(spark):
    """Nulls in any column, an empty and a very long text, rows that come again, a null id, columns with names that clash."""
    rng = random.Random(2)
    long = "\n".join(sentence(rng, 50) for _ in range(4000))
    rows = [(0, None, None, None, None), (1, "", "en", "s", 0), (2, long, "en", "s", len(long)), (3, "one two three four five six", "en", None, 9), (3, "one two three four five six", "en", None, 9), (None, "one two three four five six", "de", "s", 1), (5, "  \n \n", "en", "s", 5), (6, long, None, "s", None)]
    df = spark.createDataFrame(rows, SCHEMA)
    for c in CLASHING:
        df = df.selectExpr("*", f"'{c}' as `{c}`")
    return df


def empty(spark):
    return spark.createDataFrame([], SCHEMA)
