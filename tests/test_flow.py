import json
import random

import pytest
from pyspark.sql import functions as F
from weftline import engine
from weftline.errors import IdentityError, MergeConflictError
from weftline.operators import buckets, canonical, generic
from weftline.operators.order import numbered
from weftline.sources import extract, files

from .test_pdf import RESUME, one_page, stream


def put(folder, **contents):
    for name, data in contents.items():
        (folder / name.replace("__", ".").replace("_", " ")).write_bytes(data if isinstance(data, bytes) else json.dumps(data).encode() if isinstance(data, (list, dict)) else data.encode())
    return str(folder)


def reasons(out):
    return {r["path"].rsplit("/", 1)[1].replace("%20", " "): r["reason"] for r in out.rejects.collect()}


def test_equal_and_alike_records_stay_apart(spark, tmp_path):
    school = lambda d: [{"institution": d, "degree": "BS"}]
    same = {"name": "x", "fullName": "Ann Lee", "education": school("A")}
    out = engine.transform(spark, put(tmp_path, export__json=[same, same, {"fullName": "Ann Lee", "education": school("B")}, 7, "no record"]))
    got = sorted((r["full_name"], [e["institution"] for e in r["education"]]) for r in out.canonical.collect())
    assert got == [("Ann Lee", ["A"]), ("Ann Lee", ["A"]), ("Ann Lee", ["B"])] and out.rejects.count() == 0


def test_each_stint_keeps_its_text(spark, tmp_path):
    job = lambda a, z, text: {"company": "Acme", "title": "Eng", "start": a, "end": z, "summary": text, "skills": ["Go", "SQL"]}
    people = [{"email": "a@b.example", "experience": [job("2001", "2003", "first"), job("2010", "2012", "second stay")]}, {"email": "a@b.example", "experience": [{**job("2002", "2004", "first, longer told"), "skills": ["go", "Rust"]}]}]
    jobs = engine.transform(spark, put(tmp_path, export__json=people)).canonical.first()["experiences"]
    assert [(j["start"], j["end"], j["description"], j["skills"], j["size"]) for j in jobs] == [("2001-01", "2004-01", "first, longer told", ["Go", "Sql", "Rust"], 2), ("2010-01", "2012-01", "second stay", ["Go", "Sql"], 1)]
    assert len({j["id"] for j in jobs}) == 2 and len(jobs[0]["discarded"]) == 1


def test_one_bad_file_costs_no_other(spark, tmp_path):
    folder = put(
        tmp_path,
        good__csv="name,email\nBob Ray,bob@y.example\n",
        latin_notes__txt="Name: José Núñez “x”\nEmail: jose@x.example\n".encode("cp1252"),
        wide_notes__txt=b"\xff\xfe" + "Name: Łukasz Żak\nEmail: l@x.example\n".encode("utf-16-le"),
        big_notes__txt=b"\xfe\xff" + "Name: Eva Big\nEmail: e@x.example\n".encode("utf-16-be"),
        torn_notes__txt=b"\xff\xfe" + "Name: Torn Pair\nEmail: t@x.example\n".encode("utf-16-le") + b"\x00\xd8\x41",
        resume__pdf=one_page(stream(RESUME, pack=True)),
        locked_resume__pdf=one_page(stream(RESUME), trailer="/Encrypt<</V 1>>"),
        torn_resume__pdf=one_page(stream(RESUME))[:300],
        resume__docx=b"PK\x03\x04 no archive",
        ragged__csv="a,b\n1\n",
        huge_field__csv='name,notes\nAnn,"' + "x" * 200_000 + '"\n',
        export__json="{oops",
        nobody__json=[],
        blank__txt=" \n ",
        x__exe="z",
    )
    out = engine.transform(spark, folder)
    names = {r["full_name"] for r in out.canonical.collect()}
    assert names >= {"Bob Ray", "José Núñez “x”", "Łukasz Żak", "Eva Big", "Torn Pair", "Ann"} and len(names) == 7
    assert any("jane@x.example" in [c["value"] for c in r["contacts"]] for r in out.canonical.collect())
    assert reasons(out) == {
        "locked resume.pdf": "malformed: encrypted", "torn resume.pdf": "malformed: no cross-reference", "resume.docx": "malformed: no word-processor file", "ragged.csv": "malformed: rows of differing lengths",
        "export.json": "malformed or empty", "nobody.json": "malformed or empty", "blank.txt": "empty input", "x.exe": "unsupported source",
    }


def test_a_record_needs_a_source(spark):
    found = spark.createDataFrame([(None, 0)], "path string, row_no long")
    with pytest.raises(IdentityError):
        engine.resolved(found)


def test_ties_go_to_the_earlier_record(spark, tmp_path):
    rows = "name,email,title\n" + "".join(f"Person {x},tie@x.example,Head {x}\n" for x in "CABD")
    for _ in range(2):
        r = engine.transform(spark, put(tmp_path, rows__csv=rows)).canonical.first()
        assert (r["full_name"], r["headline"]) == ("Person C", "Head C")


def test_numbers_in_one_order(spark):
    rng = random.Random(3)
    rows = [(rng.choice("abc") if rng.random() < 0.5 else "hot", rng.randint(0, 40), i) for i in range(3000)]
    d = spark.createDataFrame(rows, "g string, k int, i int").repartition(11)
    got = numbered(d, ["g", "k"], "no").collect()
    assert sorted(r["no"] for r in got) == list(range(3000))
    by = sorted(got, key=lambda r: r["no"])
    assert [(r["g"], r["k"]) for r in by] == sorted((g, k) for g, k, _ in rows)
    for g in {r[0] for r in rows}:
        own = sorted((r for r in numbered(d, ["g", "k"], "no", within="g").filter(F.col("g") == g).collect()), key=lambda r: r["no"])
        assert [r["no"] for r in own] == list(range(len(own))) and [r["k"] for r in own] == sorted(r["k"] for r in own)
    assert numbered(d.limit(0), ["g"], "no").count() == 0


JOB = "array<struct<employer:string,title:string,start:string,end:string,is_current:boolean,skills:array<string>>>"


def plain_buckets(entries):
    """The rule for one group: entries of (rank, ix, pos, source, entry)."""
    told = lambda x: sum(len(v) + 5 * len(v.split()) for v in x[:4] if v) + (x[4] is not None) + sum(10 + len(s) + 5 for s in x[5])
    leaves = lambda x: [v if v is None or not isinstance(v, list) else json.dumps(v) for v in x]
    more = lambda a, b: all(q is None or q == p for p, q in zip(leaves(a), leaves(b))) and sum(p is not None for p in leaves(a)) > sum(p is not None for p in leaves(b))
    until = lambda x: "9999-12-31" if x[4] or x[3] is None else x[3]
    out = []
    for rank, _, _, source, x in sorted(entries, key=lambda e: e[:3]):
        for b in out:
            r = b["rep"]
            if b["key"] == (x[0].lower(), (x[1] or "").lower()) and (r[2] is None or x[2] is None or r[2] == x[2] or (r[2] <= until(x) and x[2] <= until(r))):
                if told(x) > told(r) if rank == b["rank"] else more(x, r):
                    b["rep"], b["rank"], b["source"] = x, rank, source
                break
        else:
            b = {"key": (x[0].lower(), (x[1] or "").lower()), "rep": x, "rank": rank, "source": source, "starts": [], "ends": [], "cur": False, "skills": [], "sources": [], "n": 0}
            out.append(b)
        b["starts"] += [x[2]] if x[2] else []
        b["ends"] += [x[3]] if x[3] else []
        b["cur"] |= bool(x[4])
        b["n"] += 1
        b["sources"] += [source] if source not in b["sources"] else []
        b["skills"] += [s for i, s in enumerate(x[5]) if s.lower() not in {t.lower() for t in b["skills"] + x[5][:i]}]
    return [(b["rep"][0], b["rep"][1], min(b["starts"], default=None), None if b["cur"] else max(b["ends"], default=None), b["cur"], b["skills"], b["source"], b["sources"], b["n"]) for b in out]


def test_buckets_of_few_and_many_fold_like_the_rule(spark):
    rng = random.Random(5)
    pick = lambda *v: rng.choice([None, *v])
    rows, groups = [], {}
    for g in range(30):
        for i in range(rng.choice([1, 3, 40])):
            entries = [(rng.choice(["Acme", "ACME", "Beta"]), pick("Eng", "eng "), pick("2001-01", "2003-05", "2010-01"), pick("2004-01", "2012-02"), rng.choice([False, False, True, None]), rng.sample(["Go", "go", "SQL"], rng.randint(0, 2))) for _ in range(rng.randint(0, 3))]
            rank = rng.randint(0, 2)
            rows.append((g, rank, i, f"s{i % 5}", entries))
            groups.setdefault(g, []).extend((rank, i, pos, f"s{i % 5}", list(x)) for pos, x in enumerate(entries))
    d = spark.createDataFrame(rows, f"group_ix long, rank int, candidate_ix long, source_id string, jobs {JOB}").repartition(5)
    key = lambda x: F.concat_ws("|", F.lower(x["employer"]), F.coalesce(F.lower(x["title"]), F.lit("")))
    want = {g: plain_buckets(e) for g, e in groups.items() if e}
    for chunk in (None, 7):
        got = buckets.united(d, "group_ix", "jobs", key, buckets.dated(), lists=("skills",), chunk=chunk).collect()
        fields = ("employer", "title", "start", "end", "is_current", "skills", "source", "sources", "size")
        assert {r["group_ix"]: [tuple(x[f] for f in fields) for x in r["jobs"]] for r in got} == want


def test_values_of_large_groups_are_found_by_rank(spark):
    rng = random.Random(6)
    words = ["Ann", "Ann Lee", "ann lee smith", "Bo", "Bo Ann Lee Smith", " ", None]
    rows = [(rng.choice([1, 1, 1, 2, 3]), rng.randint(0, 4), i, f"s{i % 7}", rng.choice(words), (rng.choice(["x", None]), rng.choice(["y", None]))) for i in range(900)]
    d = spark.createDataFrame(rows, "group_ix long, rank int, candidate_ix long, source_id string, name string, place struct<city:string,region:string>").repartition(6)
    plain, rounds = (sorted(map(str, generic.merge_values(d, "group_ix", ["name", "place"], gathered=n).collect())) for n in (None, 100))
    assert plain == rounds and len(plain) == 3


def test_extraction_reads_each_object(spark, tmp_path):
    put(tmp_path, export__json={"candidates": [{"fullName": "A"}, 3, {"fullName": "B"}]})
    found, rejects = extract.extracted(files.read(spark, str(tmp_path)))
    assert sorted((r["row_no"], r["full_name"]) for r in found.collect()) == [(0, "A"), (2, "B")] and rejects.count() == 0


def test_scores_and_lineage_reach_the_profiles(spark, tmp_path):
    put(tmp_path, a__csv="name,email,city\nJane Doe,JANE@x.example,bangalore\n", b__json=[{"fullName": "jane doe", "email": "jane@x.example", "skills": ["js"]}])
    out = engine.transform(spark, str(tmp_path), {"fields": ["full_name", "emails", "skill_details", "overall_confidence"], "includeProvenance": True, "includeConfidence": True, "includeSourceRecords": True})
    r = out.canonical.first()
    scores = {s["field"]: s for s in r["confidence"]}
    assert len(scores) == 15 and scores["fullName"]["value"] == pytest.approx(0.95 * 1.0 * 0.18) and scores["fullName"]["low"]
    assert scores["location"]["value"] == pytest.approx(round(0.8 * 1.0 * 0.28, 4)) and scores["links" if "links" in scores else "socialLinks"]["value"] == 0
    assert scores["contactInfo"]["value"] == pytest.approx(0.95 * 1.0 * 0.4) and scores["skills"]["value"] == pytest.approx(0.1188)
    weights = {"fullName": 1.0, "location": 0.7, "contactInfo": 1.0, "skills": 0.85}
    assert scores["overall"]["value"] == pytest.approx(sum(scores[f]["value"] * w for f, w in weights.items()) / 9.3, abs=1e-4)
    assert {s["field"] for s in r["entry_scores"]} == {"contactInfo.0", "skills.0"} and r["metadata"]["total_sources"] == 2
    told = {(h["field"], h["normalizer"]): h for h in out.lineage.filter("normalizer is not null").collect()}
    assert set(told) == {("contactInfo", "EmailNormalizer"), ("location", "LocationNormalizer")}
    mail = told["contactInfo", "EmailNormalizer"]
    assert (mail["original"], mail["normalized"], mail["extracted"]) == ("JANE@x.example", "jane@x.example", "jane@x.example")
    p = out.profiles.first()
    assert p["overall_confidence"] == scores["overall"]["value"] and p["skill_details"][0]["confidence"] == [pytest.approx(0.8 * 0.15)]
    assert [x["field"] for x in p["provenance"]["full_name"]] == ["fullName"] * 3 and {x["field"] for x in p["provenance"]["emails"]} == {"contactInfo"}
    assert p["confidence"]["full_name"][0]["value"] == scores["fullName"]["value"]
    assert {s["name"] for s in p["source_records"]} == {"a", "b"}
    assert {h["field"] for h in out.lineage.collect()} >= {"fullName", "contactInfo", "experiences"}
    engine.save(out, f"file://{tmp_path}/out")
    told = {m["measure"]: m["value"] for m in spark.read.json(f"file://{tmp_path}/out/summary").collect()}
    assert (told["candidates"], told["sources"], told["warnings"], told["rejects"]) == (1, 2, 0, 0) and told["histories"] == out.lineage.count() and told["mean_confidence"] == scores["overall"]["value"]
    assert spark.read.json(f"file://{tmp_path}/out/profiles").first()["full_name"] == p["full_name"]


def test_hooks_take_part_in_every_stage(spark, tmp_path):
    from weftline.hooks import Hooks

    asked = []

    def answers(stage, answer):
        def call(requests):
            rows = requests.collect()
            asked.extend((stage, json.loads(r["request"])) for r in rows)
            return spark.createDataFrame([(r["request_id"], answer if isinstance(answer, str) else json.dumps(answer)) for r in rows], "request_id string, answer string")

        return call

    folder = tmp_path / "in"
    folder.mkdir()
    note = "Name: Jane Doe\nEmail: jane@x.example\nCompany: ACME Labs\n"
    put(folder, a_notes__txt=note, b_notes__txt=note, rows__csv="name,email,title,company\nJane D. Doe,jane@x.example,Lead,Acme Laboratories\n")
    calls = {
        "extraction": answers("extraction", {"summary": "Told by the hook", "full_name": "Never taken", "skills": ["js"]}),
        "normalization": answers("normalization", {"headline": "Principal", "employerAliases": {"ACME Labs": "Acme", "Acme Laboratories": "Acme"}, "skillAliases": {"JavaScript": "ECMAScript"}}),
        "merge": answers("merge", {"advice": "keep both"}),
        "confidence": answers("confidence", {"assessments": [{"fieldPath": "headline", "score": 1.0}, {"fieldPath": "skills.0", "score": 0.5, "grounded": False}, {"fieldPath": "summary", "score": 7}]}),
        "validation": answers("validation", {"warnings": [{"code": "ODD", "message": "a hook says so"}]}),
    }
    plain = engine.transform(spark, str(folder)).canonical.first()
    out = engine.transform(spark, str(folder), hooks=Hooks(calls, "assist", str(tmp_path / "cache")))
    r = out.canonical.first()
    assert (r["summary"], r["headline"], r["skills"], r["full_name"]) == ("Told by the hook", "Principal", ["ECMAScript"], plain["full_name"]) and [j["employer"] for j in r["experiences"]] == ["Acme", "Acme"]
    values = {s["field"]: s["value"] for s in r["confidence"]}
    own = {s["field"]: s["value"] for s in plain["confidence"]}
    assert values["headline"] > 0.8 and values["fullName"] == own["fullName"] and values["overall"] > own["overall"]
    assert {(h["field"], h["normalizer"]) for h in out.lineage.filter("normalizer = 'LLMSemanticNormalizer'").collect()} == {("headline", "LLMSemanticNormalizer")}
    assert [(w["code"], w["severity"]) for w in out.warnings.collect()] == [("ODD", "warn")]
    assert {(c["field"], c["advice"], c["applied"]) for c in out.conflicts.collect()} >= {("fullName", "keep both", False)}
    stages = [s for s, _ in asked]
    assert stages.count("extraction") == 1 and stages.count("normalization") == 2  # two equal notes are one request
    before = len(asked)
    again = engine.transform(spark, str(folder), hooks=Hooks(calls, "assist", str(tmp_path / "cache"))).canonical.first()
    assert len(asked) == before and again["summary"] == r["summary"]  # every answer is in the cache
    broken = engine.transform(spark, str(folder), hooks=Hooks({s: answers(s, "{oops") for s in calls}, "assist"))
    b = broken.canonical.first()
    assert (b["summary"], b["headline"], b["confidence"]) == (plain["summary"], plain["headline"], plain["confidence"]) and broken.warnings.count() == 0


def test_descriptors_name_sources_and_choose_extractors(spark, tmp_path):
    (tmp_path / "a.txt").write_text("Name: Ann Lee\nEmail: ann@x.org\nSkills: js, go\n")
    (tmp_path / "b.csv").write_text("name,email\nAnn Lee,ann@x.org\nBo,bo@x.org\n")
    (tmp_path / "c.exe").write_bytes(b"MZ")
    (tmp_path / "d.json").write_text('{"fullName": "Cy"}')
    said = spark.createDataFrame([(0, None, "Called on Monday", None), (3, None, None, "manual"), (9, "b.csv", "Sheet", "csv")], "ord int, file_name string, source_name string, source_type string")
    out = engine.transform(spark, str(tmp_path), {"fields": ["full_name"], "includeSourceRecords": True}, descriptors=said)
    got = {r["full_name"]: {x["name"] for x in r["source_records"]} for r in out.profiles.collect()}
    assert got == {"Ann Lee": {"Called on Monday", "Sheet"}, "Bo": {"Sheet"}}
    assert {r["path"].rsplit("/", 1)[1]: r["reason"] for r in out.rejects.collect()}["d.json"] == "no extractor"  # its place makes it notes, which no reader of JSON takes
    answer = json.loads(engine.response(out, "r-1", 12).first()["response"])
    assert answer == {"success": True, "requestId": "r-1", "duration": 12, "data": {"summary": {"sourceCount": 4, "partialCandidateCount": 3, "normalizedCandidateCount": 3, "canonicalCandidateCount": 2, "projectedCandidateCount": 2}}}


def test_a_conflict_without_a_winner_is_found(spark):
    rows = [("g", [("headline", [], ["x"])]), ("h", [("headline", ["s1"], ["x"]), ("summary", [], [])]), ("i", [("summary", [None], ["y"])])]
    merged = spark.createDataFrame(rows, "group_id string, provenance array<struct<field:string,winners:array<string>,discarded:array<string>>>")
    assert sorted(tuple(r) for r in canonical.undecided(merged).collect()) == [("g", "headline"), ("i", "summary")]
    error = MergeConflictError("no winner", group_id="g")
    assert engine.failure(error, "r-2") == {"success": False, "requestId": "r-2", "error": {"code": "MERGE_CONFLICT", "status": 409, "message": "no winner", "details": {"group_id": "g"}}}


def test_an_entry_is_held_against_its_keys_buckets_alone():
    """The fold's state is a key's representatives: an entry costs no more where thousands came before it."""
    import pyarrow as pa

    calls = []

    def rule(r, x):
        calls.append(1)
        return r[0] == x[0]

    n = 6000
    told = [{"rank": 1, "weight": i % 3, "full": True, "said": f"t{i}", "leaves": ["a"], "parts": [str(i % 2)]} for i in range(n)]
    batch = pa.RecordBatch.from_pydict({"at": [{"group": i // (n // 2), "key": "k"} for i in range(n)], "told": told})
    out = pa.Table.from_batches(list(buckets._fold(rule, 1000)([batch.slice(0, 2500), batch.slice(2500)])))
    assert out["bucket"].to_pylist() == [i % 2 for i in range(n)] and len(calls) < 2 * n
    took = sum(out["took"].to_pylist())
    assert out["lost"].null_count == n - (took - 4)  # all that take over put one aside, but the first of each bucket
