"""Rows without an id, and rows that share one, are documents of their own."""

from collections import Counter

from keyloom.llm import lines, spans


def test_lines_of_rows_without_an_id(docs):
    got = lines.drop_repeated_lines(docs(["a\nb", "b\na", "c"], [None, 3, None])).collect()
    assert sorted((str(r.doc_id), r.text, r._n_lines, r._n_removed) for r in got) == [("3", "", 2, 2), ("None", "a\nb", 2, 0), ("None", "c", 1, 0)]


def test_repeated_lines_of_such_rows_go(docs):
    line = "one line of some length that repeats"
    got = lines.drop_repeated_lines(docs([line, line, line + "\nz", line + "!\ny", "y\nx"], [None, None, 5, 5, 5])).collect()
    left = Counter(x for r in got for x in r.text.split("\n") if x)
    assert left == {line: 1, "x": 1, "y": 1, "z": 1} and sum(r._n_removed for r in got) == 4


def test_spans_of_such_rows(docs):
    long = "a b c d e f g h i. j k l m n o p q r. "
    got = spans.drop_repeated_spans(docs([long, long, long, long + "More."], [None, None, 1, 1])).collect()
    assert sorted(r.text for r in got) == ["", "", "More.", long]
