import random

import pytest
from pyspark.sql import functions as F

from weftline.functions import normalize, patterns
from weftline.operators import identity, merge, score
from weftline.operators.components import connected_components
from weftline.plans.projection import Config, ProjectionError, compile_plan, project
from weftline.plans.projection import best_degree
from weftline.queries import jobs
from weftline.sources import files


def values(spark, fn, inputs):
    rows = spark.createDataFrame([(i, x) for i, x in enumerate(inputs)], "i int, x string")
    return [r[0] for r in rows.orderBy("i").select(fn(F.col("x"))).collect()]


def test_scalar_normalizers(spark):
    assert values(spark, normalize.date_ym, ["January 2024", "01/2024", "2024", "2024-01", "Spring 2024", "Present", None]) == ["2024-01"] * 4 + [None] * 3
    assert values(spark, normalize.email, ["  John@GMAIL.Com  ", "not-an-email", None]) == ["john@gmail.com", None, None]
    assert values(spark, normalize.phone_e164, ["+91 98765-43210", "00919876543210", "(987)6543210"]) == ["+919876543210", "+919876543210", None]
    assert values(spark, normalize.skill, ["Java Script", "distributed systems", "SQL"]) == ["JavaScript", "Distributed Systems", "Sql"]
    assert values(spark, normalize.city, ["Bangalore"]) == ["Bengaluru"] and values(spark, normalize.country, ["India"]) == ["IN"]
    assert values(spark, normalize.url, ["GitHub.com/JaneDoe/", "http://x.com:80", "https://x.com:443/a"]) == ["https://github.com/JaneDoe", "http://x.com", "https://x.com/a"]
    assert values(spark, normalize.free_text, ["a\nb  c ", "  "]) == ["ab c", None]
    assert values(spark, lambda c: normalize.safely(normalize.phone_e164, c), ["9876543210"]) == ["9876543210"]


def test_notes_and_names(spark):
    note = "Name: Maria Chen\nEmail: maria@example.com\nSkills: Go;Kubernetes\nNotes: Strong systems background"
    assert values(spark, lambda c: patterns.labeled(c, "name"), [note]) == ["Maria Chen"]
    assert values(spark, lambda c: F.array_join(normalize.split_values(patterns.labeled(c, "skills")), ","), [note]) == ["Go,Kubernetes"]
    assert values(spark, patterns.first_name_line, ["\n Jane Doe\nx@y.z", "1\n2"]) == ["Jane Doe", None]


def test_jobs_from_lines(spark):
    text = "orphan\nAcme Jun 2020 - Present\nEngineer\n- built x\nOther Corp 2018 to 2019\n- y"
    got = sorted(tuple(r) for r in jobs(spark.createDataFrame([(1, text)], "doc int, text string"), ["doc"]).collect())
    assert got == [(1, "Acme", "Jun 2020", "Present", "Engineer built x"), (1, "Other Corp", "2018", "2019", "y")]


def test_transitive_groups_and_fallback(spark):
    rows = [(0, ["email:a"]), (1, ["email:a", "github:x"]), (2, ["github:x"]), (3, ["linkedin:o"]), (4, []), (5, None)]
    got = identity.resolve(spark.createDataFrame(rows, "candidate_ix long, keys array<string>"))
    assert {r["candidate_ix"]: r["group_ix"] for r in got.collect()} == {0: 0, 1: 0, 2: 0, 3: 3, 4: 4, 5: 5}
    key = spark.range(1).select(identity.fallback_key(F.lit("Jordan Lee "), F.lit("OpenAI"), F.lit("bengaluru|in"))).first()[0]
    assert key == "fallback:jordan lee|openai|bengaluru|in"


def test_components_of_random_graphs(spark):
    rng = random.Random(8)
    edges = [(i, i + 1) for i in range(100, 160)] + [(200, 200 + i) for i in range(40)] + [(rng.randint(300, 400), rng.randint(300, 400)) for _ in range(60)]
    parent = {}

    def root(x):
        while parent.setdefault(x, x) != x:
            x = parent[x]
        return x

    for a, b in edges:
        x, y = sorted((root(a), root(b)))
        parent[y] = x
    got = {r["node"]: r["component"] for r in connected_components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert got == {x: root(x) for x in parent}


def test_preferred_name(spark):
    rows = [(1, "John", 0, 0), (1, "John Alexander Smith", 1, 1), (1, "John Smith", 3, 2), (2, " ", 0, 3), (2, "B", 1, 4), (2, "C", 0, 5)]
    got = {r["g"]: r for r in merge.merge_scalar(spark.createDataFrame(rows, "g int, full_name string, rank int, candidate_ix long"), "g", "full_name").collect()}
    assert got[1]["full_name"] == "John Alexander Smith" and got[1]["has_conflict"] and set(got[1]["discarded"]) == {"John", "John Smith"}
    assert got[2]["full_name"] == "C"


def plain_intervals(items):
    until = lambda x: "9999-12-31" if x["current"] or x["end"] is None else x["end"]
    buckets = []
    for x in sorted(items, key=lambda x: (x["rank"], x["ix"])):
        for b in buckets:
            r = b["rep"]
            if r["start"] is None or x["start"] is None or r["start"] == x["start"] or (r["start"] <= until(x) and x["start"] <= until(r)):
                if x["rank"] == r["rank"] and x["weight"] > r["weight"]:
                    b["rep"] = x
                b["items"].append(x)
                break
        else:
            buckets.append({"rep": x, "items": [x]})
    low = lambda xs, f: f([v for v in xs if v is not None], default=None)
    return sorted(repr((low([x["start"] for x in b["items"]], min), None if any(x["current"] for x in b["items"]) else low([x["end"] for x in b["items"]], max), any(x["current"] for x in b["items"]), len(b["items"]))) for b in buckets)


def test_interval_merge_equals_a_plain_fold(spark):
    rng = random.Random(9)
    rows, want = [], {}
    for g in range(60):
        items = []
        for i in range(rng.randint(1, 8)):
            a = rng.choice([None, *(f"20{y:02d}-0{rng.randint(1, 9)}" for y in range(10, 20))])
            items.append({"rank": rng.randint(0, 2), "ix": i, "start": a, "end": rng.choice([None, f"20{rng.randint(10, 22)}-05"]), "current": rng.random() < 0.1, "weight": rng.randint(0, 5)})
        rows += [(g, x["rank"], x["ix"], x["start"], x["end"], x["current"], x["weight"]) for x in items]
        want[g] = plain_intervals(items)
    out = merge.merge_intervals(spark.createDataFrame(rows, "g int, rank int, candidate_ix long, start string, end string, is_current boolean, weight long"), ["g"]).collect()
    got = {}
    for r in out:
        got.setdefault(r["g"], []).append(repr((r["start"], r["end"], r["is_current"], r["size"])))
    assert {g: sorted(v) for g, v in got.items()} == want


def test_scores(spark):
    one = spark.range(1)
    assert one.select(score.source_weight(F.lit("resume")), score.source_weight(F.lit("x")), score.source_weight(F.lit(None).cast("string"))).first()[0:3] == (1.0, 0.7, 0.5)
    assert one.select(merge.text_completeness(F.lit("Jane Doe"))).first()[0] == 18
    assert one.select(best_degree(F.array(F.lit("Diploma"), F.lit("PhD")))).first()[0] == "PhD"


def test_projection(spark):
    df = spark.createDataFrame([(1, "Jane", [("email", "j@x.y", True), ("phone", "+1 555 111 2222", False)], ["js"])], "candidate_id int, full_name string, contacts array<struct<kind:string,value:string,is_primary:boolean>>, skills array<string>")
    config = Config(fields=("full_name", {"path": "first", "from": "emails[0]"}, "phones", {"path": "kinds", "from": "contacts[].kind"}, "emails[5]"), rename={"full_name": "person.name"}, computed=("skills_count",), formats={"phones": {"normalize": "E164", "array": True}}, exclude=("skills",))
    r = project(df, config).first().asDict(recursive=True)
    assert r == {"person": {"name": "Jane"}, "first": "j@x.y", "phones": ["+15551112222"], "kinds": ["email", "phone"], "emails_5_": None, "skills_count": 1}
    with pytest.raises(ProjectionError):
        compile_plan(Config(computed=("nope",)))
    with pytest.raises(ProjectionError):
        compile_plan(Config(fields=("a",), rename={"a": "__proto__.x"}))


def test_files(spark, tmp_path):
    import zipfile

    (tmp_path / "notes.txt").write_bytes("Name: Jane Doe".encode("utf-16"))
    (tmp_path / "cv.txt").write_text("plain é")
    (tmp_path / "resume.pdf.exe").write_text("x")
    (tmp_path / "empty.txt").write_text("")
    (tmp_path / "a.json").write_text('{"candidates":[{"firstName":"Ava"},{"firstName":"Bo"}]}')
    (tmp_path / "bad.json").write_text("{broken")
    with zipfile.ZipFile(tmp_path / "d.docx", "w") as z:
        z.writestr("word/document.xml", '<w:document xmlns:w="http://schemas.openxmlformats.org/wordprocessingml/2006/main"><w:body><w:p><w:r><w:t>Hello</w:t></w:r></w:p></w:body></w:document>')
    f = files.read(spark, str(tmp_path))
    reasons = {r["name"]: r["reject_reason"] for r in f.collect()}
    assert reasons["resume.pdf.exe"] == "hidden extension" and reasons["cv.txt"] is None
    assert "empty.txt" not in reasons  # the reader skips files without bytes
    assert spark.range(1).select(files.reject_reason(F.lit("empty.txt"), F.lit(0))).first()[0] == "empty input"
    texts = {r["path"].rsplit("/", 1)[1]: r["text"] for r in files.texts(f).collect()}
    assert texts == {"notes.txt": "Name: Jane Doe", "cv.txt": "plain é", "d.docx": "Hello"}
    assert files.json_records(f).count() == 2
