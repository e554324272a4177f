import sys
from pathlib import Path

import pytest

sys.path[:0] = [str(Path(__file__).parents[1]), str(Path(__file__).parents[2])]

SMALL = "/root/testdata/sf0.001"


@pytest.fixture(scope="session")
def spark(tmp_path_factory):
    from mediaquarry.session import local_session

    session = local_session()
    session.sparkContext.setLogLevel("ERROR")
    if session.sparkContext.getCheckpointDir() is None:
        session.sparkContext.setCheckpointDir(str(tmp_path_factory.mktemp("shared")))
    return session


@pytest.fixture(scope="session")
def odd_docs(spark):
    """Nulls, empty and long texts, repeated rows, and columns whose names operators use inside."""
    long = " ".join(f"word{i % 700}" for i in range(40_000))
    rows = [
        (1, "The cat sat on the mat and looked at the quiet grey sea.\nA second line of ordinary length follows here."),
        (2, None), (3, ""), (4, " \n\t\n"), (5, long), (6, long + " end"),
        (7, "The cat sat on the mat and looked at the quiet grey sea!\nSomething wholly different stands here instead."),
        (7, "The cat sat on the mat and looked at the quiet grey sea!\nSomething wholly different stands here instead."),
        (None, "The cat sat on the mat and looked at the quiet grey sea."), (None, None), (8, "x" * 5000), (9, "né 日本語 😀 \x1c 12 <|endoftext|>"),
    ]
    return spark.createDataFrame([(i, t, None, "s", 1, 5, "w", 0, 0.5, "l") for i, t in rows],
                                 "doc_id long, text string, lang string, source string, fp long, component_id long, word string, n int, score double, line string")


@pytest.fixture(scope="session")
def no_docs(odd_docs):
    return odd_docs.where("false")
