from pyspark.sql import functions as F

from weftline.sources import files, structured


def test_csv_files_with_differing_headers(spark, tmp_path):
    (tmp_path / "a.csv").write_text("﻿full_name,Email,phone,skills\n\nJohn Smith,john@example.com,+1 555 333 4444,\"JavaScript;React\"\n")
    (tmp_path / "b.csv").write_text("Name, company ,title,city,country,school,grad_year\nAda,Acme,Engineer,Pune,India,MIT,2019\n")
    (tmp_path / "dup.csv").write_text("name,name\nJane,Doe")
    (tmp_path / "ragged.csv").write_text("name,x\nJane")
    (tmp_path / "blank.csv").write_text("name,,x\na,b,c")
    rows = structured.csv_rows(files.read(spark, str(tmp_path)))
    errors = {r["path"].rsplit("/", 1)[1]: r["error"] for r in rows.filter("error is not null").collect()}
    assert set(errors) == {"dup.csv", "ragged.csv", "blank.csv"} and "duplicate headers" in errors["dup.csv"]
    got = {r["full_name"]: r for r in structured.csv_records(rows.filter("error is null")).collect()}
    john, ada = got["John Smith"], got["Ada"]
    assert john["skills"] == ["JavaScript", "React"] and [tuple(c) for c in john["contacts"]] == [("email", "john@example.com", True), ("phone", "+1 555 333 4444", False)]
    assert john["location"] is None and john["experiences"] == [] and john["education"] == []
    assert ada["location"]["formatted"] == "Pune, India" and ada["headline"] == "Engineer"
    assert [tuple(e) for e in ada["experiences"]] == [("Acme", "Engineer", None, None, None, True, [])] and [tuple(e) for e in ada["education"]] == [("MIT", None, None, "2019")]


def test_json_candidates(spark):
    rows = [
        (1, '{"firstName":"Ava","lastName":"Patel","email":"ava@example.com","skills":["Python","SQL",3," "],"location":{"city":"Pune","state":"MH"},"links":{"github":"https://github.com/a"},"experience":[{"employer":"X","current":1},{"role":"Dev","end":"2020","isCurrent":false},7],"schools":[{"endYear":2019}]}'),
        (2, '{"full_name":"Bo","emails":"a@b.c; d@e.f","phone":null,"phones":["+1"],"location":"Oslo, NO","headline":" ","title":"T"}'),
        (3, "{}"),
    ]
    d = spark.createDataFrame(rows, "i int, j string").select("i", F.parse_json("j").alias("record"))
    got = {r["i"]: r for r in structured.json_candidates(d).collect()}
    a, b, c = got[1], got[2], got[3]
    assert a["full_name"] == "Ava Patel" and a["skills"] == ["Python", "SQL"] and a["location"]["region"] == "MH" and a["links"][0]["platform"] == "github"
    assert [(e["employer"], e["title"], e["end"], e["is_current"]) for e in a["experiences"]] == [("X", None, None, True), ("Unknown Employer", "Dev", "2020", False)]
    assert [tuple(e) for e in a["education"]] == [("Unknown Institution", None, None, None)]  # a numeric year is no string
    assert [(x["kind"], x["value"], x["is_primary"]) for x in b["contacts"]] == [("email", "a@b.c", True), ("email", "d@e.f", False), ("phone", "+1", False)]
    assert b["headline"] is None and b["location"]["raw"] == "Oslo, NO" and b["location"]["city"] is None
    assert c["full_name"] is None and c["location"] is None and c["contacts"] == [] and c["skills"] == []
