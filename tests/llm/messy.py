"""Small tables with everything that may go wrong in them."""

import random

SCHEMA = ("doc_id long, text string, lang string, source string, n_chars long, id long, tag string, seed string, "
          "n_words int, row string, c double, batch string")
SYLLABLES = "ka lo mi ne ru ta sho wen dor bla".split()


def words(rng, n, size=400):
    return ["".join(rng.choice(SYLLABLES) for _ in range(1 + rng.randrange(size) % 4)) for _ in range(n)]


def rows(seed=0, copies=6):
    """(doc_id, text): originals, exact and near copies, shared passages, repeated rows, nulls, empty and long texts."""
    rng = random.Random(seed)
    out, base = [], words(rng, 90)
    shared = words(rng, 60)
    for k in range(copies):
        out.append((k, " ".join(base)))
    for k in range(copies):
        near = list(base)
        for _ in range(1 + 2 * k):
            near[rng.randrange(len(near))] = words(rng, 1)[0] + "x"
        out.append((100 + k, " ".join(near)))
    for k in range(8):
        out.append((200 + k, " ".join(words(rng, 30) + shared[k:] + words(rng, 10)) + "\nsame line here\nsame line here"))
    out += [(300, None), (301, ""), (302, " \t\n "), (303, "one"), (304, "ONE"), (305, "Été, ça — naïve ß x 日本 🙂"),
            (306, " ".join(words(rng, 30_000, 10_000))), (307, "a b c d"), (308, "a b c d")]
    out += [(0, " ".join(base)), (300, None), (200, "another text of a repeated id, long enough to have a shingle or two")]
    out += [(None, " ".join(base)), (None, None), (None, "nobody knows my id at all today")]
    return out


def table(spark, data=None):
    data = rows() if data is None else data
    return spark.createDataFrame([(i, t, "en", None if i == 303 else "src", None, i, "x", "y", 1, "z", 1.0, "b") for i, t in data],
                                 SCHEMA)


def empty(spark):
    return spark.createDataFrame([], SCHEMA)
