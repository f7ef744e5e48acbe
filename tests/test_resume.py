from weftline.operators import resume

TEXT = """Jane Doe
Senior Backend Engineer
+1 555 111 2222 ⋄ Chennai, India
jane@example.com ⋄ linkedin.com/in/janedoe ⋄ github.com/janedoe
SUMMARY
Builds things.
EDUCATION
B. Tech in Computer Science, State College, Expected 2027
GPA: 9.1
SKILLS
Languages: Go, Python
TypeScript; go | Kubernetes
WORK EXPERIENCE
orphan line
Acme Corp Jan 2024 - Present
SDE Intern Pune, India
- Built the ledger.
• Optimized  queries
Beta Labs 2021 to 2022
Engineer Remote
Other Ltd Mar 2020
Analyst
did this and that
PROJECTS
x
"""


def test_resume_fields(spark):
    docs = spark.createDataFrame([(1, TEXT), (2, None), (3, "location: Oslo, NO\nwords"), (4, "EXPERIENCE\nEngineer at Acme\nmade it\nLead | Beta")], "id int, text string")
    f = resume.fields(docs)
    got = {r["id"]: r for r in f.collect()}
    a = got[1]
    assert (a["full_name"], a["headline"], a["summary"]) == ("Jane Doe", "Senior Backend Engineer", "Builds things.")
    assert a["location"]["city"] == "Chennai" and [x["platform"] for x in a["links"]] == ["linkedin", "github"]
    assert a["skills"] == ["Go", "Python", "TypeScript", "Kubernetes"]
    assert [tuple(s) for s in a["schools"]] == [("State College", "B. Tech", "Computer Science", "2027-01")]
    assert got[2]["headline"] is None and got[2]["location"] is None and got[2]["schools"] == [] and got[3]["location"]["region"] == "NO"
    jobs = {}
    for r in resume.experiences(f, ["id"]).orderBy("id", "job").collect():
        jobs.setdefault(r["id"], []).append((r["employer"], r["title"], r["place"] and r["place"]["city"], r["start"], r["end"], r["is_current"], r["description"]))
    assert jobs[1] == [
        ("Acme Corp", "SDE Intern", "Pune", "Jan 2024", None, True, "Built the ledger. Optimized queries"),
        ("Beta Labs", "Engineer", None, "2021", "2022", False, None),
        ("Other Ltd", "Analyst", None, "Mar 2020", "Mar 2020", False, "did this and that"),
    ]
    assert jobs[4] == [("Acme", "Engineer", None, None, None, False, "made it"), ("Beta", "Lead", None, None, None, False, None)]
    assert set(jobs) == {1, 4}


def test_job_headers_in_all_forms(spark):
    lines = [
        "Acme Labs 1850 - 1860 (on leave)", "Beta, Jan 2019 – Now, remote", "Gamma Inc December 2001 to Sept 2004 Berlin", "Delta Works 3021", "worked on it 2001 - 2002", "Ends. 2001 - 2002", "- Bullet Co 2001 - 2002", "Eps Feb 2020", "2001 - 2002", "No date",
    ]
    docs = spark.createDataFrame([(i, x) for i, x in enumerate(lines)], "id int, part string")
    got = {r["id"]: (r["employer"], r["start"], r["end"], r["is_current"]) for r in resume.jobs(docs, ["id"], "part").collect()}
    assert got == {
        0: ("Acme Labs", "1850", "1860", False), 1: ("Beta,", "Jan 2019", None, True), 2: ("Gamma Inc", "December 2001", "Sept 2004", False), 3: ("Delta Works", "3021", "3021", False), 7: ("Eps", "Feb 2020", "Feb 2020", False),
    }


def test_numbers_of_schools_are_no_years_of_graduation(spark):
    lines = ["BS, College 1999 2011", "BS, College 20112 2011", "BS, College 12011 2011", "BS, College 2011 2011", "BS, State College 2007 - 2011", "BS, College 1999", "BS, College"]
    docs = spark.createDataFrame([(i, f"EDUCATION\n{x}\n") for i, x in enumerate(lines)], "id int, text string")
    got = {r["id"]: [(s["institution"], s["end"]) for s in r["schools"]] for r in resume.fields(docs).collect()}
    assert got == {
        0: [("College 1999", "2011-01")], 1: [("College 20112", "2011-01")], 2: [("College 12011", "2011-01")], 3: [("College  2011", "2011-01")], 4: [("State College 2007", "2011-01")], 5: [("College", "1999-01")], 6: [("College", None)],
    }
