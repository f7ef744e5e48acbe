import json

import pytest
from pyspark.sql import functions as F
from weftline import engine
from weftline.config import SOURCE_WEIGHTS, overridden
from weftline.errors import ConfigurationError, ExtractionError, quarantine_code
from weftline.functions import normalize
from weftline.operators import canonical, generic, identity, records
from weftline.plans import contract
from weftline.plans.projection import Config, as_json, compile_plan
from weftline.sources import extract, files

RESUME = """Jane Doe
Backend Engineer
Oslo, Norway ⋄ jane@x.example
SKILLS
Go, Rust
EXPERIENCE
Acme Labs Jan 2019 - Present
Lead Engineer Pune, India
- built things
EDUCATION
B. Tech in Physics, College 2011
"""


@pytest.fixture
def folder(tmp_path):
    (tmp_path / "rows.csv").write_text("name,email,skills,company\nJane Doe,JANE@x.example,go;Kafka,Acme Labs\nBob Ray,bob@y.example,,\n")
    (tmp_path / "export.json").write_text(json.dumps({"candidates": [{"fullName": "Jane A. Doe", "email": "jane@x.example", "phone": "+1 555 111 2222", "location": {"city": "bangalore", "country": "india"}}]}))
    (tmp_path / "jane resume.txt").write_text(RESUME)
    (tmp_path / "recruiter notes.txt").write_text("Name: Bob Ray\nEmail: bob@y.example\nLocation: Pune, MH, India\nCurrent company: Beta\nSkills: SQL, Go\n")
    (tmp_path / "broken.json").write_text("{oops")
    (tmp_path / "twice.csv").write_text("a,a\n1,2\n")
    (tmp_path / "x.exe").write_text("z")
    return str(tmp_path)


def test_files_to_profiles(spark, folder):
    out = engine.transform(spark, folder)
    people = {r["full_name"]: r for r in out.profiles.collect()}
    assert len(people) == 2 and len(out.profiles.columns) == 13
    jane = next(r for n, r in people.items() if n.startswith("Jane"))
    assert jane["emails"] == ["jane@x.example"] and jane["phones"] == ["+15551112222"]
    assert [s["name"].lower() for s in jane["skills"]] == ["go", "rust", "kafka"]
    assert {x["company"] for x in jane["experience"]} == {"Acme Labs"} and jane["headline"] == "Backend Engineer"
    bob = people["Bob Ray"]
    assert bob["location"]["region"] == "Mh" and [x["company"] for x in bob["experience"]] == ["Beta"] and bob["education"] == []
    rejects = {r["path"].rsplit("/", 1)[1]: r["reason"] for r in out.rejects.collect()}
    assert set(rejects) == {"broken.json", "twice.csv", "x.exe"} and rejects["x.exe"] == "unsupported source" and out.warnings.count() == 0
    assert contract.domain_violations(out.canonical, "id").count() == 0
    with pytest.raises(ExtractionError):
        engine.transform(spark, folder, strict=True)


def test_order_of_files_does_not_matter(spark, folder):
    found, _ = extract.extracted(files.read(spark, folder))
    rows = engine.resolved(found).withColumn("received_at", F.lit("t"))
    a, b = (sorted(map(str, canonical.canonical(x).drop("provenance").collect())) for x in (rows, rows.repartition(7, "full_name")))
    assert a == b


def test_recruiter_note(spark):
    note = "Name: Maria Chen\nEmail: maria@example.com\nLocation: San Francisco, CA, USA\nCompany: Northstar\nSkills: Go;Kubernetes\nNotes: Strong systems background"
    r = extract.note_records(spark.createDataFrame([(1, note), (2, None)], "k int, text string")).orderBy("k").collect()
    assert r[0]["full_name"] == "Maria Chen" and r[0]["location"]["country"] == "USA" and r[0]["experiences"][0]["is_current"] and r[0]["skills"] == ["Go", "Kubernetes"]
    assert r[1]["full_name"] is None and r[1]["contacts"] == [] and r[1]["location"] is None


def test_dates_and_unique_values(spark):
    d = spark.createDataFrame([(i, x) for i, x in enumerate(["Sept 2024", "sep 2024", "Jan. 2024", "Jan, 2024", "may 2020", "Present"])], "i int, x string")
    assert [r[0] for r in d.orderBy("i").select(normalize.date_ym(F.col("x"))).collect()] == ["2024-09", "2024-09", None, None, "2020-05", None]
    u = spark.range(1).select(normalize.unique_ci(F.array(*[F.lit(x) for x in ("b", "A", "B", "a", "c")])).alias("x"), records.unique_by(F.array(*[F.lit(x) for x in ("b", None, "A", "B", None)]), F.lower).alias("y")).first()
    assert u["x"] == ["b", "A", "c"] and u["y"] == ["b", None, "A"]


def test_identity_by_address(spark):
    kinds = "contacts array<struct<kind:string,value:string>>, links array<struct<platform:string,url:string>>"
    rows = [([("email", " A@x "), ("email", "a@X"), ("website", "w"), ("phone", " ")], [("portfolio", "https://GitHub.com/u"), ("linkedin", "https://l/x")]), (None, None)]
    got = [r[0] for r in spark.createDataFrame(rows, kinds).select(identity.identity_keys(F.col("contacts"), F.col("links"), F.lit("fallback:x"))).collect()]
    assert got == [["email:a@x", "github:https://github.com/u", "linkedin:https://l/x", "fallback:x"], ["fallback:x"]]


def python_fold(entries):
    leaves = lambda v: {k: x for k, x in v.items() if x is not None}
    size = lambda v: sum(len(x.strip()) + 5 * len(x.split()) for x in leaves(v).values())
    more = lambda a, b: all(leaves(a).get(k) == x for k, x in leaves(b).items()) and len(leaves(a)) > len(leaves(b))
    best = entries[0]
    for x in entries[1:]:
        if x[0] == best[0]:
            best = x if size(x[2]) > size(best[2]) else best
        else:  # entries come by rank, so the new one's is worse
            best = x if more(x[2], best[2]) else best
    return best[2]


def test_whole_places_fold_like_the_rule(spark):
    import random

    rng = random.Random(30)
    pick = lambda *v: rng.choice([None, *v])
    groups = {}
    rows = []
    for g in range(80):
        own = sorted(((rng.randint(0, 3), i, {"city": rng.choice(["a", "bb"]), "region": pick("r", "rr"), "country": pick("c")}) for i in range(rng.randint(1, 5))), key=lambda e: e[:2])
        groups[g] = own
        rows += [(g, r, i, (p["city"], p["region"], p["country"])) for r, i, p in own]
    d = spark.createDataFrame(rows, "group_ix long, rank int, candidate_ix long, place struct<city:string,region:string,country:string>").repartition(5)
    got = {r["group_ix"]: r["place"].asDict() for r in generic.merge_value(d, "group_ix", "place").collect()}
    assert got == {g: python_fold(own) for g, own in groups.items()}


def test_configurations(spark):
    assert contract.parsed_config({"fields": ["a"], "includeNullishFields": True}).missing == "null"
    assert contract.parsed_config({"fields": ["a"], "on_missing": "error", "includeNullishFields": True}).missing == "error"
    assert contract.parsed_config({"nonsense": 1}) == Config() == contract.parsed_config(None)
    for bad in ({"nonsense": 1}, {"fields": ["a"], "on_missing": "maybe"}, {"computedFields": ["nope"]}):
        with pytest.raises(ConfigurationError):
            contract.parsed_config(bad, strict=True)
    assert len(compile_plan(Config())) == 13
    assert overridden(SOURCE_WEIGHTS, "ATS:0.5, csv:x,other:2,github:0")["ats"] == 0.5 and overridden(SOURCE_WEIGHTS, "github:0")["github"] == 0
    got = [r[0] for r in spark.createDataFrame([("too large",), ("missing extension",), ("malformed",), (None,)], "r string").select(quarantine_code(F.col("r"))).collect()]
    assert got == ["UPLOAD_TOO_LARGE", "UNSUPPORTED_MEDIA_TYPE", "PIPELINE_ERROR", None]
    rows = spark.createDataFrame([(1, None)], "a int, b string")
    assert [as_json(rows, Config(fields=("a", "b"), missing=m)).first()[0] for m in ("omit", "null")] == ['{"a":1}', '{"a":1,"b":null}']


def test_domain_rules(spark):
    kinds = "id string, contacts array<struct<kind:string,value:string>>, links array<struct<platform:string,url:string>>, experiences array<struct<employer:string>>, education array<struct<institution:string>>, skills array<string>, created_at string, updated_at string"
    good = ("0123abcd-0000-5000-8000-000000000000", [("email", "a@b")], [("github", "https://x")], [("E",)], [], ["Go"], "1", "2")
    bad = ("x", [("fax", " ")], [("x", "y")], [(None,)], [(" ",)], [""], "2", "1")
    found = contract.domain_violations(spark.createDataFrame([good, bad], kinds).withColumn("k", F.monotonically_increasing_id()), "k").collect()
    assert len({r["k"] for r in found}) == 1 and len(found) == 9


def test_remapped_provenance(spark):
    p = [("i1", "f", "old", "v", ["old", "new"]), ("i2", "f", "new", "v", []), ("i3", "g", "z", "v", ["z"])]
    d = spark.createDataFrame([(p, {"old": "new"})], "p array<struct<id:string,field:string,source:string,value:string,winners:array<string>>>, ids map<string,string>")
    got = d.select(canonical.remapped(F.col("p"), F.col("ids"), F.lit("c"))).first()[0]
    assert [(x["field"], x["source"], x["winners"]) for x in got] == [("f", "new", ["new"]), ("g", "z", ["z"])]


def test_hooks_change_nothing_by_default(spark):
    from weftline import hooks

    rows = spark.createDataFrame([(1, "x" * 10, None), (2, "y", "z")], "k int, a string, b string")
    doubled = {"merge": lambda d: d.unionByName(d)}
    assert hooks.Hooks(doubled).applied("merge", rows).count() == 2 and hooks.Hooks(doubled, "assist").applied("merge", rows).count() == 4
    got = rows.orderBy("k").select(hooks.only_missing(F.col("b"), F.col("a")), hooks.evidence(F.col("a"), 4), hooks.aliased(F.col("a"), F.create_map(F.lit("y"), F.lit("why")))).collect()
    assert [tuple(r) for r in got] == [("x" * 10, "xxxx...", "x" * 10), ("z", "y", "why")]
    kept = hooks.decisions(rows.select("k", "a"), spark.createDataFrame([(2, "take z")], "k int, advice string"), "k").orderBy("k").collect()
    assert [(r["a"][0], r["advice"], r["applied"]) for r in kept] == [("x", None, False), ("y", "take z", False)]
    with pytest.raises(ValueError):
        hooks.Hooks().applied("cooking", rows)
