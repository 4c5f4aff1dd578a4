"""Small tables that hold what may go wrong: nulls, empty and long texts, ties, repeated rows, clashing columns."""

import random

import pytest

R = random.Random(5)
WORDS = ["the", "of", "and", "to", "in", "that", "is", "was", "for", "on", "with", "as", "by", "ander", "ouble", "thing", "ères", "straße", "niño"]


def prose(n, seed):
    r = random.Random(seed)
    return " ".join(r.choice(WORDS) + r.choice(["", "", "ing", "ed", "."]) for _ in range(n))


PASSAGE = prose(90, 99)


def rows():
    out = [(i, prose(40 + 7 * i, i), "en", f"src{i % 3}") for i in range(24)]
    out += [(100, None, "en", "src0"), (101, "", "en", None), (102, "  \n\t ", None, "src1"), (103, "one", "en", "src1")]
    out += [(104, out[3][1], "en", "src2"), (105, out[3][1], "en", "src2"), (106, out[4][1] + " end", "en", "src0")]
    out += [(110 + i, prose(30, 200 + i) + " " + PASSAGE + " " + prose(30, 300 + i), "en", "src1") for i in range(4)]
    out += [(120, "ab" * 3000, "en", "src0"), (121, prose(6000, 7), "en", "src2"), (122, "日本語 \U0001f600 ▁ <s> <unk> \x00 é " * 30, "ja", "src1")]
    out += [(7, out[7][1], "en", "src1"), (None, prose(50, 400), "en", "src1"), (123, "The  of   and\r\n\r\nto", "en", "src0")]
    return out


SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, score double, key string, hash long, fp long, host string, lines string, n long"


@pytest.fixture(scope="session")
def documents(spark):
    return spark.createDataFrame([(*r, None if r[1] is None else len(r[1]), 0.5, "k", 1, 2, "h", "l", 3) for r in rows()], SCHEMA).repartition(3).cache()


@pytest.fixture(scope="session")
def texts_by_row():
    return [(r[0], r[1] or "") for r in rows()]


@pytest.fixture(scope="session")
def empty(spark):
    return spark.createDataFrame([], SCHEMA)


@pytest.fixture(scope="session")
def labels(spark):
    return spark.createDataFrame([(i, i % 5 > 0, 0) for i in range(0, 24)] + [(3, None, 0), (4, True, 1)], "doc_id long, quality boolean, toxic int").selectExpr("doc_id", "cast(quality as int) quality", "toxic")
