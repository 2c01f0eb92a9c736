"""One pass over statements, and the metadata job that goes on from earlier runs."""

import pytest
from pyspark.sql import functions as F

from paperweave.operators import triples as T
from paperweave.plans import metadata

STATEMENT = "subject string, predicate string, object string, object_is_literal boolean"
RECORD = metadata.RECORD


def paper(n, title, doi=""):
    rows = [(f"P{n}", "p/P30", "F1", False), (f"P{n}", "x/rdf-schema#label", title, True), (f"P{n}", "p/P27", "Ann Berg", True)]
    return rows + ([(f"P{n}", "p/P26", doi, True)] if doi else [])


def record(n, title, doi="", abstract="found"):
    return (title, ["Ann Berg"], doi, ["Physics"], "Venue", "http://r/1", f"{abstract} {n} " + "x" * 60, n)


def test_store_answers_without_the_source(spark):
    # a node that half of the statements name, literals of nodes nobody asks for, nulls in every column
    rows = [(f"s{n}", "p/P30", "hot" if n % 2 else f"f{n}", False) for n in range(400)]
    rows += [("hot", "l", "Hot", True), ("hot", "l", "Also", True), ("f0", "l", "Zero", True)]
    rows += [(f"other{n}", "l", "unasked", True) for n in range(50)]
    rows += [(None, "p/P30", "x", True), ("n1", None, "x", True), ("n2", "p/P30", None, True), ("n3", "p/P30", "x", None)]
    store = T.land_statements(spark.createDataFrame(rows, STATEMENT), ["P30"])
    plan = store.by_predicate("P30")._jdf.queryExecution().toString()
    assert "LocalTableScan" not in plan and "LocalRelation" not in plan
    got = {(r.paper, r.label) for r in store.by_predicate("P30").collect()}
    first = {"hot": "Also", "f0": "Zero"}
    want = {(s, o if lit else first.get(o)) for s, p, o, lit in rows if p == "p/P30"}
    assert got == {(s, label if s != "n3" else None) for s, label in want}
    with pytest.raises(ValueError, match="P26"):
        store.by_predicate("P26")


def test_literals_of_unasked_subjects_are_not_aggregated(spark):
    literals = spark.createDataFrame([("a", "1"), ("a", "0"), ("b", "2")], "subject string, object string")
    statements = spark.createDataFrame([("s", "p", "a", False), ("t", "p", "own", True)], STATEMENT)
    resolved = T.resolve_objects(statements, literals)
    assert {r.subject: r.value for r in resolved.collect()} == {"s": "0", "t": "own"}
    plan = resolved._jdf.queryExecution().optimizedPlan().toString()
    assert "LeftSemi" in plan


def test_empty_statements(spark):
    empty = spark.createDataFrame([], STATEMENT)
    assert T.papers_from(spark, lambda s: empty, "P30").count() == 0


def test_a_later_run_asks_only_for_open_papers(spark, tmp_path, monkeypatch):
    calls = []
    real = metadata.enrich

    def counting(papers, first, second, pages=None):
        calls.append((sorted(r.paper_id for r in papers.select("paper_id").collect()), first.count() > 0, pages is not None))
        return real(papers, first, second, pages)

    monkeypatch.setattr(metadata, "enrich", counting)
    title = {1: "Spectral theory of random graphs", 2: "Deep networks and their limits", 3: "Cells under pressure in water"}
    rows = [("F1", "l", "Science", True), *paper(1, title[1]), *paper(2, title[2]), *paper(3, title[3], "10.1/3")]
    first = spark.createDataFrame([record(1, title[1])], RECORD)
    second = spark.createDataFrame([record(2, "Deep networks and their limits", "10.1/2"), record(3, "else", "10.9/9")], RECORD)
    html = f'<h1>{title[2]}</h1><a class="doi__link" href="#">10.1/2</a><span data-selenium-selector="author-list">Ann Berg</span>'
    pages = spark.createDataFrame([(7, html)], "page_id long, html string")
    taxonomy = spark.createDataFrame([("Physics", "Physics")], "name string, ord string")
    reviewed = {c: spark.createDataFrame([("Physics", "Natural Science")], "src string, dst string") for c in ("crossref_field", "semantic_field")}

    def run(rows, pages, path):
        calls.clear()
        source = spark.createDataFrame(rows, STATEMENT)
        done = metadata.run_metadata(spark, lambda s: source, first, second, pages, taxonomy, path, reviewed)
        found = {r.paper_id: (r.abstract[:7], r.doi, r.label, list(r.crossref_field), list(r.semantic_field)) for r in done.papers.collect()}
        return found, sorted(calls)

    path = str(tmp_path / "job")
    found, asked = run(rows, None, path)
    assert asked == [(["P1", "P2"], True, False), (["P3"], True, False)]
    assert found["P1"] == ("found 1", "", "Natural Science", ["Physics"], []) and found["P2"][0] == found["P3"][0] == ""
    # the pages are new, the rest has been asked; P1 is settled though it has no doi
    found, asked = run(rows, pages, path)
    assert asked == [(["P2"], False, True)]
    assert found["P1"][0] == "found 1" and found["P2"] == ("found 2", "10.1/2", "Natural Science", [], ["Physics"])
    # nothing is left, and another doi in the statements makes a paper new
    assert run(rows, pages, path) == (found, [])
    changed = [(s, p, "10.1/33" if o == "10.1/3" else o, lit) for s, p, o, lit in rows]
    again, asked = run([*changed, *paper(4, "A title nobody has")], pages, path)
    assert asked == [(["P3"], True, False), (["P4"], True, True)] and again["P2"] == found["P2"]
    assert metadata.last_run(spark, path) == 4
    # one run over everything gives the same
    whole, _ = run([*changed, *paper(4, "A title nobody has")], pages, str(tmp_path / "whole"))
    assert whole == again


def test_a_run_that_broke_off_is_repeated(spark, tmp_path, monkeypatch):
    path = str(tmp_path / "job")
    source = spark.createDataFrame([("F1", "l", "Science", True), *paper(1, "Spectral theory of random graphs")], STATEMENT)
    first = spark.createDataFrame([record(1, "Spectral theory of random graphs")], RECORD)
    taxonomy = spark.createDataFrame([("Physics", "Physics")], "name string, ord string")
    reviewed = {c: spark.createDataFrame([], "src string, dst string") for c in ("crossref_field", "semantic_field")}
    args = (spark, lambda s: source, first, None, None, taxonomy, path, reviewed)
    with monkeypatch.context() as m:
        m.setattr(metadata, "ASKED", "paper_id string")  # the run fails on its way
        with pytest.raises(Exception):  # noqa: B017
            metadata.run_metadata(*args)
    assert metadata.last_run(spark, path) == 0
    assert metadata.run_metadata(*args).papers.filter(F.col("abstract") != "").count() == 1
