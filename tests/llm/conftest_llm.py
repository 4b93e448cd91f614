import random
import re

import pytest

LOW = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
SF = "/root/testdata/sf0.001"


def words(text, lower=True):
    text = text or ""
    return re.findall(r"[^\x20\x09-\x0D]+", text.translate(LOW) if lower else text)


@pytest.fixture(scope="session")
def docs(spark):
    """The smallest documents table, its edge cases and an extra column of a name that operators use themselves."""
    base = [(r.doc_id, r.text) for r in spark.read.parquet(f"{SF}/documents.parquet").collect()]
    rng = random.Random(3)
    long = " ".join(rng.choice("alpha beta gamma delta eta theta iota kappa".split()) + str(rng.randrange(3000)) for _ in range(6000))
    odd = [
        (900001, None), (900002, ""), (900003, " \n\t "), (900004, "One"), (900005, "one two three\none two three"),
        (900006, long), (900007, long + " end"), (900008, "a" * 5000), (900009, "Été là  ça va 😀 x"), (900010, "One"),
        (None, "no id"), (900011, "\n".join(["same line here again"] * 40)), (900012, "<|endoftext|> then  two   spaces \n\n x"),
    ]
    return spark.createDataFrame([(i, t, 1.0, "x") for i, t in base + odd], "doc_id long, text string, score double, part string")


@pytest.fixture(scope="session")
def texts(docs):
    return {r.doc_id: r.text for r in docs.collect() if r.doc_id is not None}
