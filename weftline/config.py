"""Fixed values of record fusion: priorities, weights, aliases."""

# Source labels in order of trust, and what a source's description must contain for each.
SOURCE_PRIORITY = ("resume", "ats", "csv", "github", "linkedin", "recruiter-notes", "job-board", "social-profile", "manual", "other")
SOURCE_MATCHERS = {
    "resume": ("resume", "resumeextractor"),
    "ats": ("ats", "atsjsonextractor"),
    "csv": ("csv", "csvparser"),
    "github": ("github",),
    "linkedin": ("linkedin",),
    "recruiter-notes": ("recruiter notes", "recruiter-notes", "recruiter"),
    "job-board": ("job-board", "job board"),
    "social-profile": ("social-profile", "social profile"),
    "manual": ("manual",),
    "other": ("other",),
}
# Confidence weights by source type and by field.
SOURCE_WEIGHTS = {"resume": 1.0, "ats": 0.95, "csv": 0.9, "github": 0.85, "linkedin": 0.85, "recruiter-notes": 0.7, "job-board": 0.8, "social-profile": 0.8, "manual": 0.75, "other": 0.7}
FIELD_WEIGHTS = {
    "firstName": 0.8, "middleName": 0.4, "lastName": 0.8, "fullName": 1.0, "headline": 0.5, "summary": 0.35, "location": 0.7,
    "contactInfo": 1.0, "socialLinks": 0.7, "experiences": 0.9, "education": 0.75, "skills": 0.85, "tags": 0.25, "additionalData": 0.3,
}
DEFAULT_SOURCE_WEIGHT, MISSING_SOURCE_WEIGHT, DEFAULT_FIELD_WEIGHT = 0.7, 0.5, 0.5
# Normalization aliases.
SKILLS = {
    "js": "JavaScript", "javascript": "JavaScript", "java script": "JavaScript", "ecmascript": "JavaScript", "ts": "TypeScript", "typescript": "TypeScript",
    "node": "Node.js", "nodejs": "Node.js", "node.js": "Node.js", "reactjs": "React", "react.js": "React", "react": "React", "postgres": "PostgreSQL",
    "postgresql": "PostgreSQL", "golang": "Go", "k8s": "Kubernetes", "py": "Python",
}
CITIES = {"bangalore": "Bengaluru", "bengaluru": "Bengaluru", "bombay": "Mumbai"}
COUNTRIES = {"in": "IN", "india": "IN", "us": "US", "usa": "US", "united states": "US", "uk": "GB", "united kingdom": "GB"}
DEGREES = {
    "b.tech": "Bachelor of Technology", "btech": "Bachelor of Technology", "bachelor of technology": "Bachelor of Technology", "b.sc": "Bachelor of Science",
    "bsc": "Bachelor of Science", "m.tech": "Master of Technology", "mtech": "Master of Technology",
}
MONTHS = ("january", "february", "march", "april", "may", "june", "july", "august", "september", "october", "november", "december")
# Short month names other than the first three letters.
MONTH_SHORT = {"september": ("sep", "sept"), "may": ("may",)}
DEGREE_RANKS = ("phd", "doctor", "doctorate", "master", "mba", "bachelor", "b.tech", "ba", "bs", "associate", "diploma")
OPEN_END = "9999-12-31"
# How each field is merged.
MERGE_STRATEGIES = {
    "firstName": "scalar", "middleName": "scalar", "lastName": "scalar", "fullName": "scalar", "headline": "scalar", "summary": "scalar", "location": "scalar",
    "contactInfo": "contact", "socialLinks": "social", "experiences": "experience", "education": "education", "skills": "array", "tags": "array", "additionalData": "scalar",
}
LOW_CONFIDENCE = 0.6


def overridden(defaults: dict[str, float], text: str | None) -> dict[str, float]:
    """Weights with those of ``name:number,name:number`` put in. Names are lower-cased, as those of sources are, so
    names in mixed case cannot be overridden; what is no number in [0, 1] is left out."""
    out = dict(defaults)
    for part in (text or "").split(","):
        name, _, value = part.partition(":")
        try:
            number = float(value)
        except ValueError:
            continue
        if name.strip() and 0 <= number <= 1:
            out[name.strip().lower()] = number
    return out
