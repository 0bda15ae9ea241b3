"""The gate's branches, search without vectors, datasets and their thresholds."""

import json

import pytest
from pyspark.sql import functions as F

from heddle.functions.vectors import Histogram
from heddle.operators import evaluate, gate, published

CHUNKS = "chunk_id string, path string, file_name string, extension string, start_line int, end_line int, source_location string, content string"
STATES = "kb string, epoch long, seq long, generation long, state string, reason string"
CONTROL = "kb string, status string, published long, source_revision long"


def test_every_refusal(spark):
    control = spark.createDataFrame([("a", "READY", 3, 3), ("b", "BUILDING", 2, 3), ("c", "READY", 2, 3), ("d", "READY", 3, 3), ("e", "READY", 3, 3), ("f", "READY", 3, 3), ("g", "READY", 3, 3)], CONTROL)
    states = [(kb, 3, k, k, state, why) for kb, k, state, why in (("a", 1, "CHANGED", "old news"), ("a", 2, "VERIFIED", "verified"), ("b", 1, "VERIFIED", ""), ("c", 1, "VERIFIED", ""), ("d", 1, "VERIFIED", ""), ("d", 2, "CHANGED", "a file was changed"), ("g", 1, "UNAVAILABLE", None))]
    states += [("e", 2, 9, 9, "VERIFIED", "of an older revision"), ("d", 3, None, 1, "VERIFIED", "a late timer")]
    asked = [(1, " A ", 3, "q"), (2, "b", 3, "q"), (3, "c", 3, "q"), (4, "d", 3, "q"), (5, "e", 3, "q"), (6, "f", 3, "q"), (7, "g", 3, "q"), (8, "a", 2, "q"), (9, "none", 3, "q"), (10, None, 3, "q")]
    got = {r["qid"]: (r["admitted"], r["refusal"]) for r in gate.admitted(spark.createDataFrame(asked, "qid long, kb string, revision long, query string"), control, spark.createDataFrame(states, STATES)).collect()}
    unknown, unchecked = (False, "no such knowledge base"), (False, "the sources haven't been checked")
    assert got == {1: (True, None), 2: (False, "the index is BUILDING"), 3: (False, "the index is READY"), 4: (False, "a file was changed"), 5: unchecked, 6: unchecked, 7: (False, "unavailable"), 8: (False, "the question is of another revision"), 9: unknown, 10: unknown}


def model(kind):
    class Model(Histogram):
        """Defined here, so that it travels to the tasks by value."""

        def __init__(self):
            self.signature = "other" if kind == "other" else Histogram().signature

        def embed(self, texts):
            if kind == "away":
                raise OSError("the model is away")
            return super().embed(texts)

    return Model()


def test_search_goes_on_without_vectors(spark, tmp_path):
    kb = published.Knowledge(spark, str(tmp_path / "kb"))
    questions = spark.createDataFrame([(1, "kb", "number three", True, None), (2, "kb", "number four", False, "token=abc is stale")], "qid long, kb string, query string, admitted boolean, refusal string")
    found, notes = gate.answered(kb, questions)
    assert found.count() == 0 and {r["kind"] for r in notes.collect()} == {"refused", "missing"}
    kb.update(spark.createDataFrame([(f"c{k}", f"/p/{k}.md", f"{k}.md", "md", 1, 1, "L1-1", f"text number {name}") for k, name in enumerate(("one", "two", "three", "four"))], CHUNKS))
    for kind, usable, messages in (("same", True, []), ("away", False, ["PythonException"]), ("other", False, ["the vectors are of another model"])):
        kb.embedder = model(kind)
        found, notes = gate.answered(kb, questions)
        rows, notes = found.orderBy("rank").collect(), [tuple(r) for r in notes.collect()]
        assert {r["qid"] for r in rows} == {1} and rows[0]["file_name"] == "2.md" and all(r["semantic_available"] == usable for r in rows)
        assert ("refused", "gate", "kb: token=[REDACTED] is stale") in notes and [m for kind, _, m in notes if kind == "vector fallback"] == messages
        assert kb.store.state()["status"] == ("INCOMPATIBLE" if kind == "other" else "READY")


def dataset(path, **changes):
    case = {"id": "one", "query": "number three", "category": "plain", "split": "dev", "expectedDocuments": ["2.md"], "expectedPassages": ["number three"], "mustNotReturn": ["9.md"], "hardNegatives": [], "answerable": True}
    value = {"name": "small", "version": 1, "minimumRecallAt5": 0.9, "minimumMrrAt10": 0.8, "minimumNdcgAt10": 0.7, "cases": [case, {**case, "id": "two", "expectedDocuments": ["1.md"], "expectedPassages": [], "hardNegatives": ["8.md"]}, {**case, "id": "none", "expectedDocuments": [], "answerable": False}], **changes}
    path.write_text(json.dumps(value))
    return str(path)


def test_dataset_and_gate(spark, tmp_path):
    cases, least = evaluate.dataset(spark, dataset(tmp_path / "d.json"))
    assert least == {"recall5": 0.9, "recall20": 0.9, "hit5": 0.9, "mrr10": 0.8, "ndcg10": 0.7} and cases.count() == 3
    for wrong in ({"name": " "}, {"version": 0}, {"minimumMrrAt10": 1.5}, {"cases": []}):
        with pytest.raises(ValueError, match="dataset needs"):
            evaluate.dataset(spark, dataset(tmp_path / "w.json", **wrong))
    hit = "qid long, rank int, file_name string, passage_hit boolean"
    good = evaluate.per_case(spark.createDataFrame([(0, 1, "2.md", True), (1, 1, "1.md", False), (1, 2, "8.md", False)], hit), cases)
    assert evaluate.failures(good, {**least, "mrr10": 0.6}) == []
    assert evaluate.failures(good, least) == ["mrr10"]  # a case without an answer has no reciprocal rank
    got = {r["qid"]: r.asDict() for r in good.collect()}
    assert got[0]["ndcg10"] == 1 and got[2]["recall20"] == 1
    bad = evaluate.per_case(spark.createDataFrame([(0, 1, "9.md", False), *[(0, k, f"x{k}", False) for k in range(2, 7)], (0, 7, "2.md", False), (1, 1, "8.md", False), (1, 2, "1.md", False), (2, 1, "2.md", False)], hit), cases)
    got = {r["qid"]: r.asDict() for r in bad.collect()}
    assert (got[0]["recall5"], got[0]["recall20"], got[0]["forbidden_hit"], got[1]["outranked"], got[2]["recall5"]) == (0, 1, True, True, 0)
    assert set(evaluate.failures(bad, least)) == {"recall5", "recall20", "hit5", "mrr10", "ndcg10", "forbidden", "outranked"}
    evaluate.report(bad, "small", "BM25", least).write.json(str(tmp_path / "report"))
    read = spark.read.json(str(tmp_path / "report")).first()
    assert read["cases"] == 3 and len(read["results"]) == 3 and "outranked" in read["failures"]


def test_grades(spark):
    docs = spark.createDataFrame([("a", "Before: one two three four five, six seven eight NINE ten! After"), ("b", "one two three four five six seven eight and no more"), ("c", "two words"), ("d", None), ("e", "one two three four five six seven eightfold nine")], "file_name string, content string")
    items = spark.createDataFrame([(1, "One two three four five six seven eight nine ten"), (2, "two words"), (3, ""), (4, None)], "qid long, passage string")
    assert sorted(map(tuple, evaluate.grades(docs, items).collect())) == [(1, "a", 2), (1, "b", 1), (2, "c", 2)]
    assert evaluate.grades(docs, items.where("qid > 2")).count() == 0
