from pyspark.sql import functions as F

from weftline.operators import lineage, merge
from weftline.plans.projection import Config, project


def test_additional_data_and_education(spark):
    rows = [(1, 0, 0, {"a": "x", "b": "y"}), (1, 1, 1, {"a": "x and more", "c": "z"}), (2, 0, 2, {})]
    d = spark.createDataFrame(rows, "g int, rank int, candidate_ix long, data map<string,string>")
    assert [tuple(r) for r in merge.merge_additional(d, "g", "data").collect()] == [(1, {"a": "x and more", "b": "y", "c": "z"})]
    e = [(1, 0, 0, "MIT", "BS", None, "2019-01", 1), (1, 0, 1, "mit", "bs", "2015-01", None, 1), (1, 1, 2, "MIT", "BS", "2014-01", "2019-06", 1), (1, 1, 3, "MIT", "BS", None, "2021-01", 1), (1, 1, 4, "MIT", None, None, None, 1)]
    s = spark.createDataFrame(e, "g int, rank int, candidate_ix long, institution string, degree string, start string, end string, weight long")
    got = sorted(tuple(r) for r in merge.merge_education(s, "g").fillna("").collect())
    assert got == [(1, "mit", "", "", "", 1), (1, "mit", "bs", "", "2021-01", 1), (1, "mit", "bs", "2014-01", "2019-06", 3)]


def test_lineage(spark):
    values = spark.createDataFrame([(7, 1, "s1", "resume", "contactInfo", "A@b.c"), (7, 1, "s1", "resume", "skills", "js"), (7, 2, "s2", "odd", "skills", "go")], "group_ix long, candidate_ix long, source_record_id string, source_type string, field string, value string")
    ops = spark.createDataFrame([(1, "contactInfo.email", "email", "A@b.c", "a@b.c"), (1, "contactInfo.email", "email", "X@b.c", "x@b.c"), (1, "skill.name", "skill", "js", "JavaScript")], "candidate_ix long, op_field string, normalizer string, original string, normalized string")
    chosen = spark.createDataFrame([(7, "skills", "JavaScript", "union")], "group_ix long, field string, selected string, strategy string")
    h = lineage.field_history(values, ops, chosen)
    assert h.count() == 4
    p = lineage.provenance(h, lineage.source_history(values.select("group_ix", "source_record_id", "source_type").distinct()))
    got = sorted((r["field"], r["source_record_id"], r["source_priority"], r["normalizer"], r["normalized"], r["selected"]) for r in p.collect())
    assert got == [("contactInfo", "s1", 0, "email", "a@b.c", None), ("skills", "s1", 0, None, None, "JavaScript"), ("skills", "s2", None, None, None, "JavaScript"), ("sourceRecords.s1", "s1", 0, None, None, None), ("sourceRecords.s2", "s2", None, None, None, None)]


def test_virtual_fields_and_formats(spark):
    df = spark.sql("""SELECT array(named_struct('platform','other','url','o'), named_struct('platform','github','url','g1'), named_struct('platform','github','url','g2')) AS links,
      array(named_struct('employer','A','title','T','start','2015-03','end','2018-01','is_current',false,'description','d'), named_struct('employer','B','title',null,'start','Jun 2020','end',null,'is_current',true,'description',null), named_struct('employer','C','title',null,'start',null,'end','2001','is_current',false,'description',null)) AS experiences,
      array(named_struct('institution','I','degree','D','field',null,'end','2019-01')) AS education,
      array(named_struct('name','Go','confidence',array(0.5D),'provenance',array(named_struct('source_name',cast(null as string),'source_record_id','s1'))), named_struct('name','Py','confidence',cast(array() as array<double>),'provenance',cast(array() as array<struct<source_name:string,source_record_id:string>>))) AS skill_details,
      array(named_struct('field','fullName','source_name','N','source_record_id','s1','normalizer',cast(null as string),'strategy','scalar','extractor','X')) AS provenance,
      array(named_struct('id','s1','name','CV'), named_struct('id','s2','name','ATS')) AS source_records,
      named_struct('city','Pune','region','','country','IN') AS location, '2024-05' AS d1, 'Spring 2024' AS d2""")
    names = ("links", "years_experience", "ats_skills", "ats_experience", "ats_education", "ats_provenance", "location", {"path": "where", "from": "location"}, "d1", "d2", {"path": "month", "from": "d1"}, {"path": "at", "from": "d1"}, {"path": "urls", "from": "links[].url"})
    formats = {"where": {"location": "readable"}, "d1": {"date": "yyyy"}, "d2": {"date": "yyyy"}, "month": {"date": "mm/yyyy"}, "at": {"date": "iso"}}
    r = project(df, Config(fields=names, formats=formats, as_of_year=2024)).first().asDict(recursive=True)
    assert r["links"] == {"linkedin": None, "github": "g1", "portfolio": None, "other": ["o"]} and r["years_experience"] == 7.0
    assert r["urls"] == ["o", "g1", "g2"]
    assert r["ats_skills"] == [{"name": "Go", "confidence": 0.5, "sources": ["CV"]}, {"name": "Py", "confidence": None, "sources": ["CV", "ATS"]}]
    assert [(x["company"], x["end"]) for x in r["ats_experience"]] == [("A", "2018-01"), ("B", None), ("C", "2001")] and r["ats_education"][0]["end_year"] == "2019"
    assert r["ats_provenance"] == [{"field": "full_name", "source": "N", "method": "scalar"}]
    assert (r["where"], r["d1"], r["d2"], r["month"], r["at"]) == ("Pune, IN", "2024", "Spring 2024", "05/2024", "2024-05-01T00:00:00.000Z")
    assert project(df, Config(fields=({"path": "c", "from": "location"},), formats={"c": {"location": "iso-country"}})).first()["c"] == "IN"


def test_formats_by_type(spark):
    df = spark.sql("""SELECT array('js', 'machine  LEARNING', 'java script', null) AS names, array(named_struct('name', '', 'title', 'T', 'n', 1), named_struct('name', 'N', 'title', 'T', 'n', 2), named_struct('name', null, 'title', null, 'n', 3), null) AS things,
      array(1.0D, 2.5D) AS numbers, array(true, false) AS flags, '+1 (555) 11' AS phone, array('+1 (5)', 'x') AS lines, 7 AS n, named_struct('city', 'Pune', 'country', 'IN') AS place, '2024-05' AS d, cast(null as string) AS none, cast(null as array<string>) AS nothing""")
    joined = {"array": "comma-separated"}
    cases = {
        "names": ({"normalize": "canonical", **joined}, ["JavaScript", "Machine Learning", "Java Script", None]),  # the first that applies is the only one
        "things": (joined, 'T, N, {"n":3}, null'), "numbers": ({**joined, "joinWith": "; "}, "1; 2.5"), "flags": (joined, "true, false"),
        "phone": ({"phone": "e164", "date": "yyyy"}, "+155511"), "lines": ({"normalize": "e164"}, ["+15", ""]), "n": ({"normalize": "canonical", "date": "yyyy"}, 7),
        "place": ({"normalize": "canonical", "location": "readable"}, "Pune, IN"), "d": ({"phone": "display", "date": "yyyy"}, "2024-05"), "none": ({"normalize": "canonical"}, None), "nothing": (joined, None),
    }
    out = project(df, Config(fields=tuple(cases), formats={f: how for f, (how, _) in cases.items()})).first().asDict(recursive=True)
    assert out == {f: wanted for f, (_, wanted) in cases.items()}
    listed = project(df, Config(fields=("lines",), formats={"lines": {"phone": "e164"}})).first()["lines"]
    assert listed == ["+1 (5)", "x"]  # a phone's form is for text alone


def test_selected_values_list_no_sources(spark):
    """Each source has a history with the selected value, which must not list all of them again."""
    job = "struct<employer:string{}>"
    rows = spark.createDataFrame([(1, i, f"s{i}", "ats", [], [("Acme",)]) for i in range(3)], f"group_ix long, candidate_ix long, source_id string, source_type string, operations array<struct<field:string,normalizer:string,original:string,normalized:string>>, experiences array<{job.format('')}>")
    merged = spark.createDataFrame([(1, "c1", [("Acme", ["s0", "s1", "s2"])], [("p", "experiences", "s0", "Acme", "experience")])], f"group_ix long, id string, experiences array<{job.format(',sources:array<string>')}>, provenance array<struct<id:string,field:string,source:string,value:string,strategy:string>>")
    told = lineage.of_records(merged, rows, {"experiences": "experiences"}).filter("field = 'experiences' and id != 'p'").collect()
    assert [(r["extracted"], r["selected"]) for r in told] == [('{"value":[{"employer":"Acme"}]}',) * 2] * 3


def test_scores_of_a_group_of_very_many_sources(spark):
    """The source of a field is looked up once in the group's sources, not once for each of them."""
    import time

    from weftline.operators import confidence

    rows = spark.range(12000).selectExpr("1L as group_ix", "id as candidate_ix", "concat('s', id) as source_id", "if(id = 0, 'ats', 'other') as source_type", "'n' as source_name", "array('Go') as skills")
    merged = spark.createDataFrame([(1, "c1", ["Go"], [], "2024")], "group_ix long, id string, skills array<string>, provenance array<struct<field:string,source:string,winners:array<string>>>, updated_at string")
    began = time.time()
    scores = {s["field"]: s["value"] for s in confidence.scored(merged, rows).select("confidence").first()["confidence"]}
    assert scores["skills"] == round(0.95 * 0.17, 4) and time.time() - began < 45


def test_provenance_apart_is_the_list_of_a_record(spark, tmp_path):
    """Entries as rows of their own are those of the whole lineage and of the list in a record's row; the record keeps one entry per field and name for its skills, however many its sources."""
    import json

    from weftline import engine
    from weftline.operators import confidence
    from weftline.plans.projection import listed

    person = {"fullName": "jane doe", "email": "jane@x.example", "skills": ["js"]}
    (tmp_path / "a.csv").write_text("name,email,city\nJane Doe,JANE@x.example,bangalore\nJane,jane@x.example,Pune\nBob,bob@x.example,\n")  # two records of one source, one of them with operations
    for i in range(12):
        (tmp_path / f"b{i}.json").write_text(json.dumps([person, {**person, "email": "JANE@x.example", "phone": "+1 (555) 0001111"}]))
    out = engine.transform(spark, str(tmp_path))
    rows, merged = out.records, out.canonical
    fields = {c: f for c, f in confidence.FIELDS.items() if c in rows.columns and c in merged.columns}
    history = lineage.entries(merged, rows, fields)
    shown = ("group_ix", "id", "field", "source_record_id", "normalizer", "strategy")
    told = lambda df: sorted(df.select(*shown).collect(), key=str)
    assert told(history) == told(out.lineage) and {r["normalizer"] for r in told(history)} >= {None, "EmailNormalizer", "PhoneNormalizer"}
    apart = {}
    for r in listed(engine.entries(merged, history)).orderBy("id", "place").collect():
        apart.setdefault(r["id"], []).append((r["field"], r["source"], r["method"]))
    inside = {r["candidate_id"]: [tuple(p) for p in r["provenance"]] for r in out.profiles.collect()}
    assert apart == inside and max(map(len, inside.values())) > 150 and {s for p in inside.values() for _, s, _ in p} == {"a", *[f"b{i}" for i in range(12)]}
    light = engine.profiles(merged, history, apart=True)
    assert sorted(project(light, Config(exclude=("provenance",))).collect(), key=str) == sorted(out.profiles.drop("provenance").collect(), key=str)
    for r in light.collect():
        kept = [(p["field"], name) for p, name in zip(r["provenance"], r["provenance_names"])]
        assert len(kept) == len(set(kept)) and {f for f, _ in kept} == {"skills"}
