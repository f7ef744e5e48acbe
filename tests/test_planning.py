from pyspark.sql import functions as F

from weftline.functions import normalize, patterns
from weftline.operators import lineage, merge, operations, planning, score
from weftline.plans.projection import Config, project
from weftline.sources import files


def test_merge_plan(spark):
    kind = "group_ix long, rank int, candidate_ix long, name string, tags array<string>, place struct<id:string,city:string>"
    rows = [(1, 1, 5, "Ann", ["x"], ("a", "Pune")), (1, 0, 6, "Ann B", [], ("b", "Pune")), (1, 0, 7, " ", None, (None, None)), (2, 0, 8, None, None, None)]
    p = planning.merge_plan(spark.createDataFrame(rows, kind), {"fullName": "name", "tags": "tags", "location": "place"})
    got = {(r["group_ix"], r["field"]): (r["strategy"], r["candidates"], r["missing"], r["has_conflict"]) for r in p.collect()}
    assert got[1, "fullName"] == ("scalar", [6, 5], [7], True) and got[1, "tags"] == ("array", [5], [6, 7], False)
    assert got[1, "location"] == ("scalar", [6, 5], [7], False) and got[2, "fullName"] == ("scalar", [], [8], False)
    assert {r["group_ix"]: r["conflicts"] for r in planning.conflict_counts(p).collect()} == {1: 1, 2: 0}
    assert planning.merge_plan(spark.createDataFrame([], kind), {"fullName": "name"}).count() == 0


def test_operation_log(spark):
    d = spark.createDataFrame([(1, " A@B.c ", ["js", "Go", None]), (2, "none", None), (3, None, []), (4, "a@b.c", ["Go"])], "k int, mail string, skills array<string>")
    out = operations.logged(d, [("mail", "contactInfo.email", "email", normalize.email), ("skills", "skill.name", "skill", normalize.skill)])
    assert {r["k"]: (r["mail"], r["skills"]) for r in out.collect()} == {1: ("a@b.c", ["JavaScript", "Go", None]), 2: ("none", None), 3: (None, []), 4: ("a@b.c", ["Go"])}
    assert sorted(tuple(r) for r in operations.as_rows(out, ["k"]).collect()) == [(1, 0, "contactInfo.email", "email", " A@B.c ", "a@b.c"), (1, 1, "skill.name", "skill", "js", "JavaScript")]


def test_scores_and_attached_histories(spark):
    d = spark.sql("SELECT 1 AS k, array('Go', 'Kubernetes') AS skills")
    s = score.entity_scores(F.col("skills"), "skills", F.col("k"), F.lit(0.9), merge.text_completeness, lambda x: F.lit(1.0))
    rows = d.select(F.inline(s)).collect()
    assert [(r["field"], r["value"], r["weight"], r["low"]) for r in rows] == [("skills.0", 0.063, 0.85, True), ("skills.1", 0.135, 0.85, True)]
    assert rows[0]["reason"] == "source=0.90, agreement=1.00, completeness=0.07, validation=1.00" and rows[0]["id"] != rows[1]["id"]
    history = lineage.source_history(spark.createDataFrame([(1, "s1", "resume")], "group_ix long, source_record_id string, source_type string"))
    got = lineage.attached(spark.createDataFrame([(1, "sourceRecords.s1"), (1, "skills.0")], "group_ix long, path string"), history).collect()
    assert {r["path"]: [p["source_record_id"] for p in r["provenance"]] for r in got} == {"sourceRecords.s1": ["s1"], "skills.0": []}


def test_projection_with_scores_and_sources(spark):
    d = spark.sql("""SELECT 'A' AS full_name, 'x' AS headline, array(named_struct('field','headline','value',0.5D), named_struct('field','headlines','value',0.1D), named_struct('field','headline.a','value',0.2D)) AS confidence,
      array(named_struct('id','s1')) AS source_records""")
    r = project(d, Config(fields=("headline", "overall_confidence"), rename={"headline": "title"}, include_confidence=True, include_source_records=True)).first().asDict(recursive=True)
    assert r["title"] == "x" and r["overall_confidence"] == 0.2667 and r["source_records"] == [{"id": "s1"}]
    assert [s["field"] for s in r["confidence"]["title"]] == ["headline", "headline.a"] and r["confidence"]["overall_confidence"] == []


def test_urls_and_descriptors(spark):
    d = spark.createDataFrame([(0, "see github.com/a, https://X.org/b", "cv.pdf"), (1, None, "notes.v2.txt"), (2, "no.where", "b")], "ord long, t string, name string")
    assert [r[0] for r in d.orderBy("ord").select(patterns.urls(F.col("t"))).collect()] == [["https://github.com/a", "https://X.org/b"], [], []]
    said = spark.createDataFrame([(0, "q", "First", None), (9, "b", "Named", "ats"), (10, "b", "Later", "ats")], "ord long, file_name string, source_name string, source_type string")
    got = {r["ord"]: (r["source_name"], r["source_type"]) for r in files.described(d, said).collect()}
    assert got == {0: ("First", "resume"), 1: ("notes.v2", "manual"), 2: ("Named", "ats")}
