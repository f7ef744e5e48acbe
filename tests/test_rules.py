import json

import pytest
from weftline.plans import rules

ID, AT = "0123abcd-0000-5000-8000-000000000000", "2024-01-02T03:04:05+02:00"
SCORE = {"id": ID, "fieldPath": "x", "value": 0.5}
HISTORY = {"id": ID, "sourceRecordId": ID, "fieldPath": "x", "winningSourceRecordIds": [ID]}
SKILL = {"id": ID, "name": "Go", "level": "expert", "yearsOfExperience": 1.5, "confidence": [SCORE], "provenance": [HISTORY]}
PLACE = {"id": ID, "city": "Oslo"}
CONTACT = {"id": ID, "kind": "email", "value": "a@b", "isPrimary": True}
LINK = {"id": ID, "platform": "github", "url": "https://x.example/y"}
JOB = {"id": ID, "employer": "Acme", "skills": [SKILL], "location": PLACE}
SCHOOL = {"id": ID, "institution": "MIT"}
SOURCE = {"id": ID, "sourceId": "s", "sourceType": "ats", "sourceName": "n", "fileName": "f", "mimeType": "m", "receivedAt": "2024-01-02T03:04Z", "parser": "p", "extractor": "e", "metadata": {"any": 1}}
OPERATION = {"field": "f", "normalizer": "n", "originalValue": "", "normalizedValue": "x", "timestamp": AT}
ABOUT = {"candidateId": ID, "pipelineVersion": "1", "engineVersion": "1", "mergeStrategyVersion": "1", "processingStartedAt": AT, "processingCompletedAt": AT, "processingDurationMs": 0, "mergedSources": ["a"], "totalSources": 1, "totalFields": 14}
PARTIAL = {"fullName": "Ann", "location": PLACE, "contactInfo": [CONTACT], "socialLinks": [LINK], "experiences": [JOB], "education": [SCHOOL], "skills": [SKILL], "sourceRecords": [SOURCE], "tags": ["t"], "additionalData": {}}
WHOLE = {**PARTIAL, "id": ID, "createdAt": AT, "updatedAt": AT, "provenance": [HISTORY], "confidence": [SCORE], "candidateMetadata": ABOUT, "unknown": 1}

# type, a good document, changes and the breaches they are
CASES = [
    ("Provenance", HISTORY, {"sourceRecordId": "x", "sourcePriority": 1.5, "discardedValues": ["a", ""]}, {("sourceRecordId", "no id"), ("sourcePriority", "out of range"), ("discardedValues[1]", "empty")}),
    ("ConfidenceScore", SCORE, {"value": 1.01, "calculatedAt": "yesterday", "reason": None}, {("value", "out of range"), ("calculatedAt", "no instant"), ("reason", "no text")}),
    ("Location", PLACE, {"city": "", "confidence": [{**SCORE, "value": "x"}]}, {("city", "empty"), ("confidence[0].value", "no number")}),
    ("Skill", SKILL, {"name": "", "level": "guru", "yearsOfExperience": -1}, {("name", "empty"), ("level", "not one of the known"), ("yearsOfExperience", "out of range")}),
    ("ContactInfo", CONTACT, {"kind": "fax", "isPrimary": "yes"}, {("kind", "not one of the known"), ("isPrimary", "no truth value")}),
    ("SocialLink", LINK, {"url": "no address", "platform": "x"}, {("url", "no address"), ("platform", "not one of the known")}),
    ("Experience", JOB, {"employer": 7, "skills": [{**SKILL, "id": 1}], "location": []}, {("employer", "no text"), ("skills[0].id", "no text"), ("location", "no object")}),
    ("Education", SCHOOL, {"institution": "", "grade": ""}, {("institution", "empty"), ("grade", "empty")}),
    ("SourceRecord", SOURCE, {"receivedAt": "2024-13-01T00:00Z", "metadata": [], "sourceType": "csv"}, {("receivedAt", "no instant"), ("metadata", "no object"), ("sourceType", "not one of the known")}),
    ("NormalizationOperation", OPERATION, {"normalizedValue": 1}, {("normalizedValue", "no text")}),
    ("CandidateMetadata", ABOUT, {"totalSources": 1.5, "mergedSources": "a"}, {("totalSources", "out of range"), ("mergedSources", "no list")}),
    ("PartialCandidate", PARTIAL, {"tags": ["a", 3], "experiences": [JOB, {**JOB, "employer": ""}]}, {("tags[1]", "no text"), ("experiences[1].employer", "empty")}),
    ("NormalizedPartialCandidate", PARTIAL, {"normalizationOperations": [{**OPERATION, "field": ""}]}, {("normalizationOperations[0].field", "empty")}),
    ("CanonicalCandidate", WHOLE, {"updatedAt": None, "skills": [{**SKILL, "provenance": [{**HISTORY, "id": "?"}]}]}, {("updatedAt", "no text"), ("skills[0].provenance[0].id", "no id")}),
]


@pytest.mark.parametrize("name,good,changes,want", CASES, ids=[c[0] for c in CASES])
def test_each_type(spark, name, good, changes, want):
    required = next(iter(good)) if name not in ("PartialCandidate", "NormalizedPartialCandidate") else None
    documents = [good, {**good, **changes}, {k: v for k, v in good.items() if k != required}]
    d = spark.createDataFrame([(i, json.dumps(x)) for i, x in enumerate(documents)], "k int, document string")
    found = {}
    for r in rules.breaches(d, "k", name).collect():
        found.setdefault(r["k"], set()).add((r["path"], r["problem"]))
    if name == "CanonicalCandidate":
        required = None
    assert found == {1: want} | ({2: {(required, "missing")}} if required else {})


def test_what_is_no_document(spark):
    d = spark.createDataFrame([(1, None), (2, "{oops"), (3, "[]"), (4, "null")], "k int, document string")
    assert {(r["k"], r["path"], r["problem"]) for r in rules.breaches(d, "k", "Skill").collect()} == {(1, "", "no document"), (2, "", "no document"), (3, "", "no object"), (4, "", "no object")}
