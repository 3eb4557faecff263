import pytest

from spindrift.operators import index
from spindrift.plans import query_language as Q

CASES = [
    ("python", Q.Term("python")),
    ("python java", Q.And((Q.Term("python"), Q.Term("java")))),
    ("python OR java", Q.Or((Q.Term("python"), Q.Term("java")))),
    ("NOT java", Q.Not(Q.Term("java"))),
    ("NOT NOT java", Q.Term("java")),
    ("(python OR java) AND web", Q.And((Q.Or((Q.Term("python"), Q.Term("java"))), Q.Term("web")))),
    ("python java OR web", Q.Or((Q.And((Q.Term("python"), Q.Term("java"))), Q.Term("web")))),
    ('"machine learning"', Q.Phrase(("machine", "learning"))),
    ('"python"', Q.Term("python")),
    ('"open quote here', Q.Phrase(("open", "quote", "here"))),
    ("title:python", Q.Term("python", "title")),
    ("py*", Q.Prefix("py")),
    ("machine-learning", Q.And((Q.Term("machine"), Q.Term("learning")))),
    ("", None),
    ("the of", None),
    ("(", None),
    (")", None),
]


@pytest.mark.parametrize("text,tree", CASES)
def test_trees(text, tree):
    assert Q.parse(text) == tree


def test_ranking_terms_leave_negated_ones_out():
    assert Q.positive_terms(Q.parse("python NOT java title:web source:x py*")) == ["python", "web"]


@pytest.fixture(scope="module")
def find(spark, corpus4):
    ix = index.Index.build(corpus4)
    return lambda q: sorted(r[0] for r in Q.evaluate(Q.parse(q), ix).collect())


def test_results(find):
    assert find("python") == [1, 3]
    assert find("python AND programming") == [1]
    assert find("python OR java") == [1, 2, 3]
    assert find("programming NOT python") == [2, 4]
    assert find("NOT python") == [2, 4]
    assert find("java*") == [2, 3]
    assert find("title:python") == [1]
    assert find("source:test4") == [4]
    assert find("nothing") == [] and find("") == []
    assert find('"machine learning"') == [1, 4]
    assert find('title:"data science"') == [4]
    assert find('"science data"') == []
    assert set(find("python AND web")) <= set(find("python OR web"))


def test_phrase_needs_adjacency_in_one_field(spark):
    d = spark.createDataFrame(
        [
            (1, "x", "machine learning is powerful", "s"), (2, "x", "machine is used for deep learning", "s"),
            (3, "learning", "machine vision applications machine", "s"), (4, "x", "go go go", "s")
        ],
        "doc_id long, title string, body string, source string"
    )
    ix = index.Index.build(d)
    run = lambda q: sorted(r[0] for r in Q.evaluate(Q.parse(q), ix).collect())
    assert run('"machine learning"') == [1]
    assert run('"go go go"') == [4] and run('"go go go go"') == []


def test_left_fold(spark, corpus4):
    ix = index.Index.build(corpus4)
    run = lambda q: sorted(r[0] for r in Q.left_fold(q, ix).collect())
    assert run("python programming") == [1] and run("NOT python OR web") == [2, 3, 4] and run("programming NOT java") == [1, 4] and run("") == []
