"""The lines of a text are cut, hashed and counted once."""

from pairwave.llm import linededup
from pairwave.llm.common import numbered


def test_lines_are_made_once(spark, monkeypatch):
    plans, real = [], linededup.cut
    monkeypatch.setattr(linededup, "cut", lambda df, *more: plans.append(df._jdf.queryExecution().optimizedPlan().toString()) or real(df, *more))
    docs = spark.createDataFrame([(1, "a b\n \nc"), (2, None), (3, ""), (4, " \n"), (5, "a b")], "doc_id long, text string")
    seq = linededup._sequence(numbered(docs), 5)
    assert sorted((r.line, r.n, r.left) for r in seq.collect()) == [(0, 2, 1), (0, 2, 2), (2, 1, 1)]
    assert plans[0].count("split(") == 1
