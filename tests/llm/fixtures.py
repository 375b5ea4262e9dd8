"""Small tables for the operators: nulls, empty and long texts, ties, repeated rows and clashing column names."""

import random

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, size long, row string, kept boolean"


def texts(seed=1, n=60):
    rnd = random.Random(seed)
    words = ["".join(rnd.choice("abcdeé") for _ in range(rnd.randint(1, 6))) for _ in range(300)]
    prose = lambda k: " ".join(rnd.choice(words) for _ in range(k))
    out = []
    for i in range(n):
        t = "\n".join(prose(rnd.randint(3, 40)) for _ in range(rnd.randint(1, 8)))
        if i % 5 == 4:  # a near copy
            w = out[rnd.randrange(len(out))].split(" ")
            w[rnd.randrange(len(w))] = "changed"
            t = " ".join(w)
        if i % 7 == 6:  # an exact copy
            t = out[rnd.randrange(len(out))]
        out.append(t)
    passage = prose(60)
    out[3] += "\n" + passage
    out[8] = passage + " " + out[8]
    return out + ["", " \n\t ", "one", "one", "Two words.", prose(20_000), "a " * 400, "ÀÉß İ Ω　x\x1cy <|endoftext|>"]


def rows(seed=1, n=60):
    out = [(i, t, ["en", "fr", None][i % 3], ["a", "b", None, "c"][i % 4], len(t), 7, "row", True) for i, t in enumerate(texts(seed, n))]
    return [*out, (500, None, None, None, None, None, None, None), (None, out[2][1], "en", "a", 1, 1, "x", False), out[5], out[5]]


def frame(spark, tmp_path, seed=1, n=60):
    path = f"{tmp_path}/documents.parquet"
    spark.createDataFrame(rows(seed, n), SCHEMA).repartition(3, "doc_id").write.parquet(path)
    return spark.read.parquet(path)


def empty(spark):
    return spark.createDataFrame([], SCHEMA)
