import pytest

from quillgraph.operators import evaluation as ev
from quillgraph.operators import search as s
from quillgraph.operators import stats
from quillgraph.plans.report import report

RUN = "question_id string, arm string, input_tokens long, output_tokens long, tool_call_count int, file_read_count int, wall_clock_millis long, cost_usd double, accuracy double, contaminated boolean, hit_ceiling boolean"


def test_report(spark):
    questions = spark.createDataFrame([("q1", "r1", "GRAPH_HEAVY"), ("q2", "r2", "NEUTRAL"), ("q3", "r1", "NEGATIVE_CONTROL")], "id string, repo_id string, category string")
    runs = spark.createDataFrame(
        [
            ("q1", "WITH", 100, 10, 3, 1, 2000, 0.1, 1.0, False, False),
            ("q2", "WITH", 300, 10, 5, 1, 4000, 0.3, 0.5, False, False),
            ("q1", "WITHOUT", 500, 10, 9, 4, 8000, 0.4, 1.0, False, False),
            ("q2", "WITHOUT", 10**9, 10, 9, 4, 8000, 9.0, None, True, False),
            ("q3", "WITH", 7, 0, 0, 0, 1000, 0.0, None, None, None),
        ],
        RUN,
    )
    kappa = stats.kappa(spark.createDataFrame([(True, True), (False, True)], "a boolean, b boolean"), "a", "b")
    retrieval = stats.retrieval_summary(spark.createDataFrame([("r1", "NEUTRAL", "graph", 0.5, 1.0)], "repo string, category string, ranker string, p5 double, mrr double"), ["p5", "mrr"])
    text = report(runs, questions, synthetic=True, judged=False, ingest_cost=2.0, kappa=kappa, retrieval=retrieval)
    assert "SYNTHETIC RESULT" in text and "UNSCORED RESULT" in text
    assert "| Total tokens | 210 (110 to 310, n=2) | 510 (510 to 510, n=1) |" in text
    assert "| WITHOUT | 2 | 1 | 0 |" in text and "## Repository r2" in text and "pays after 10.0000 questions" in text
    assert "| headline | graph | 1 | 0.500 | 1.000 |" in text and "kappa 0.000 over 2 pairs" in text
    assert "| Accuracy | 75.0% (50.0% to 100.0%, n=2) | 100.0%" in text and "| Accuracy | no data | no data |" in text
    plain = report(runs, questions, synthetic=False, judged=True)
    assert "SYNTHETIC" not in plain and "Not validated." in plain and "Not enough data." in plain


def test_modules_by_meaning_or_by_words(spark):
    nodes = spark.createDataFrame([("module:a", "CodeModule", "auth", 1.0), ("module:b", "CodeModule", "billing", 1.0), ("x", "Class", "auth", 1.0)], "id string, type string, label string, confidence double")
    similar = spark.createDataFrame([("module:b", 0.9), ("module:a", 0.1), ("x", 0.99)], "id string, score double")
    assert [(r.id, r.method) for r in s.modules_by_meaning(nodes, "auth", similar).collect()] == [("module:b", "embedding")]
    for none in (None, similar.where("score < 0.2")):
        assert [(r.id, r.method) for r in s.modules_by_meaning(nodes, "auth", none).collect()] == [("module:a", "keyword")]


def test_questions_of_yaml_or_a_clear_error(spark, tmp_path):
    (tmp_path / "q.yaml").write_text("questions:\n- {id: a, repo_id: r, text: t, category: NEUTRAL, expected_set: ['a.java:1']}\n")
    try:
        import yaml  # noqa: F401
    except ModuleNotFoundError:
        with pytest.raises(ValueError, match="yaml"):
            ev.load_questions(spark, str(tmp_path / "q.yaml"))
    else:
        assert ev.load_questions(spark, str(tmp_path / "q.yaml")).first().expected_set == ["a.java:1"]
