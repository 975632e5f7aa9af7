import random

import pytest
from pyspark.sql import types as T

SCHEMA = T.StructType([T.StructField("doc_id", T.LongType()), T.StructField("text", T.StringType()), T.StructField("lang", T.StringType()), T.StructField("source", T.StringType()), T.StructField("n_chars", T.LongType()), T.StructField("start", T.StringType()), T.StructField("fingerprint", T.StringType()), T.StructField("group", T.StringType()), *(T.StructField(c, T.StringType()) for c in ("id", "doc", "terms", "copies"))])


def hard_rows() -> list[tuple]:
    """Nulls in every column, empty and long texts, ties, repeated rows; the last three columns clash with operators' names."""
    rng = random.Random(5)
    words = ["alpha", "beta", "gamma", "été", "ñandú", "delta.", "it's", "42", "x9", "señor", "日本", "ЖУК", "ΣΑΣ", "e\u0301", "<|endoftext|>", "\u00a0"]
    passage = "this passage of well over fifty bytes repeats across several documents here"
    rows = []
    for k in range(60):
        text = " ".join(rng.choice(words) for _ in range(rng.randrange(1, 200)))
        if k % 7 == 0:
            text += f"\n{passage}\n" + text[:20]
        rows.append((k, text, ["en", "de", None][k % 3], ["src0", "src1", "web", None][k % 4], len(text), "s", "f", "g"))
    rows += [(100, None, "en", "src0", None, None, None, None), (101, "", None, None, 0, "", "", ""), (None, "no id here at all", "en", "src0", 17, None, None, None), (None, "no id here at all", "en", "src0", 17, None, None, None)]
    rows += [rows[3], rows[3]] + [(200 + k, rows[5][1], "en", "src0", 1, "s", "f", "g") for k in range(5)]
    rows += [(300, "word " * 9000, "en", "src2", 45000, None, None, None), (301, "z" * 30000, "en", "src2", 30000, None, None, None)]
    rows += [(400 + k, "a " + passage + " b" * k, "en", "src1", 1, None, None, None) for k in range(6)]
    rows += [(500 + k, " ".join(f"unique{k}word{j}" for j in range(30)) + f" ask ann.smithson@mail{0}.example.org now zweibrueckenhaus", "en", "src1", 1, None, None, None) for k in range(5)]
    return rows


@pytest.fixture(scope="session")
def hard(spark):
    return spark.createDataFrame([(*r, "x", None, "y", "z") for r in hard_rows()], SCHEMA)


@pytest.fixture(scope="session")
def empty(spark):
    return spark.createDataFrame([], SCHEMA)


@pytest.fixture(scope="session")
def documents(spark):
    from tests.conftest import SF

    return spark.read.parquet(f"{SF}/documents.parquet")
