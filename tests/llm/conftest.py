import re

import pytest

from tests.conftest import SF

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def words(text):
    return WORD.findall(text or "")


@pytest.fixture(scope="session")
def docs(spark):
    """All documents of the smallest table, and rows with nulls, blanks, repeats and clashing columns."""
    table = spark.read.parquet(f"{SF}/documents.parquet").selectExpr("doc_id", "text", "lang", "source", "n_chars")
    odd = [
        (9000, None, "en", "src0", None), (None, "", None, None, 0), (9001, "a b c", "en", "src1", 5), (9002, "a b  c", None, "src1", 6), (9003, " \n\t ", "fr", None, 4),
        (9004, "word " * 8000, "en", "src0", 40000), (9005, "zz", "de", "new", 2), (None, "zz", "de", "new", 2), (9006, "q r s t u v w " * 9, "en", "src0", 126),
        (9006, "q r s t u v w " * 9, "en", "src0", 126), (9007, "▁ 日本語 😀 é\x00", "en", "src2", 10), (9008, "12 34 %$", "en", "src2", 8),
    ]
    return table.union(spark.createDataFrame(odd, "doc_id long, text string, lang string, source string, n_chars long")).cache()


@pytest.fixture(scope="session")
def empty(docs):
    return docs.where("false")


class Union:
    def __init__(self, n):
        self.up = list(range(n))

    def find(self, x):
        while self.up[x] != x:
            self.up[x] = x = self.up[self.up[x]]
        return x

    def join(self, a, b):
        self.up[self.find(a)] = self.find(b)
