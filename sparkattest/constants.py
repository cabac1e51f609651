"""Fixed values of the document-trust contract.

Every word list, pattern, threshold and weight below is a fixed value: results
depend on it literally, so it is stated as plain text in its natural order.
"""

from __future__ import annotations

# --- Fixed values: identifiers -------------------------------------------------
STANDARD_CERT_ID = r"^CERT-(\d{4})-(\d{6})$"
CERT_ID_IN_TEXT = r"(?<![A-Za-z0-9])CERT-\d{4}-\d{6}(?![A-Za-z0-9])"
MIN_ISSUE_YEAR = 1990
MAX_ISSUE_YEAR = 2026

# --- Fixed values: recognized issuers ------------------------------------------
KNOWN_ACADEMIC_ISSUERS = [
    "University of Cambridge", "University of Oxford", "Stanford University",
    "Massachusetts Institute of Technology", "Harvard University", "ETH Zurich",
    "University of Toronto", "University of Melbourne", "National University of Singapore",
    "TU Munich", "Indian Institute of Technology Delhi", "IIT Bombay", "Anna University",
    "Delhi University", "University of Washington", "KAIST", "Imperial College London",
]
KNOWN_OTHER_ISSUERS = [
    "NovaSkills", "SecurEdge Labs", "CloudForge Academy", "CogniTech Solutions", "EduStream",
    "LearnSphere", "Peak Performance Academy", "TechEdge Training", "Lumina Professional",
    "CloudForge", "CyberShield Institute", "NimbusCloud Academy", "DataPulse Labs",
    "SecureTech Institute", "DevStack Training", "AIForge Labs", "NetWave Academy",
    "CodeCraft Institute", "Innovate Academy", "QuantumWorks Training", "StellarEdge Academy",
    "Meridian Skills Institute",
]
KNOWN_ISSUERS = KNOWN_ACADEMIC_ISSUERS + KNOWN_OTHER_ISSUERS
LOW_TRUST_ISSUER_WORDS = [
    "emporium", "sale", "fast", "instant", "online degree", "grade 4 sale", "diploma",
]

# --- Fixed values: wording -----------------------------------------------------
SUSPICIOUS_KEYWORDS = [
    "buy", "purchase", "no exam", "instant", "get certificate", "verified certificate",
    "free certificate", "fast track", "unaccredited", "whatsapp", "pay now", "click here",
]
URL_MARKERS = ["www.", "http://", "https://", ".com", "@mail", "contact us"]
LINK_MARKERS = ["www.", "http://", "https://", ".com", "@mail"]
TITLE_WORDS = [
    "certificate", "certification", "diploma", "credential", "certificate of achievement",
    "certificate of completion", "certificate of training",
]
RECIPIENT_PHRASES = [
    "certify that", "certifies that", "awarded to", "presented to", "completed by",
    "this certificate is awarded to",
]

# --- Fixed values: certificate types -------------------------------------------
ACADEMIC_WORDS = [
    "university", "college", "polytechnic", "degree", "academic", "baccalaureate", "bachelor",
    "doctorate", "graduation", "graduated", "faculty of", "semester", "thesis", "dissertation",
    "merit",
]
ACADEMIC_CONTEXT_WORDS = ["marks", "grade", "cgpa", "gpa"]
COMPLETION_WORDS = ["completion"]
TRAINING_WORDS = ["training", "professional", "development", "workshop", "course"]
TECHNICAL_CONTEXT_WORDS = [
    "certification", "certified by", "certification code", "technical certification",
    "technology certification", "professional certification", "developer certification",
    "cloud certification", "cybersecurity certification", "software certification",
    "engineering certification", "it certification", "data science certification",
    "machine learning certification", "programming certification", "technical course",
    "demonstrated proficiency", "proficiency in", "competency",
]
TECHNICAL_DOMAIN_WORDS = [
    "cloud", "cybersecurity", "security", "network", "networking", "software", "developer",
    "programming", "coding", "devops", "aws", "web development", "data science",
    "machine learning", "deep learning", "artificial intelligence", "information technology",
    "kubernetes", "docker", "python", "java", "javascript", "sql", "engineering", "robotics",
    "internet of things", "data analytics", "big data",
]
WORKSHOP_WORDS = [
    "workshop", "seminar", "attendance", "attended", "participation", "participated",
    "participant",
]
ONLINE_WORDS = ["online", "e-learning", "elearning"]
TYPE_PRECEDENCE = ["academic", "technical", "training", "completion", "online", "workshop"]

# --- Fixed values: field extraction patterns -----------------------------------
NAME_AFTER_PHRASE = (
    r"(?i:certif(?:y|ies)[ \t]+that|awarded[ \t]+to|presented[ \t]+to|"
    r"present[ \t]+this[ \t]+certificate[ \t]+to|completed[ \t]+by|"
    r"this[ \t]+certificate[ \t]+is[ \t]+awarded[ \t]+to|we[ \t]+thank)"
    r"\s*?([A-Z][a-zA-Z.'\-]*(?:[ \t]+[A-Z][a-zA-Z.'\-]*){1,3})"
)
NAME_BEFORE_VERB = (
    r"(?i)([A-Z][a-zA-Z.'\-]*(?:[ \t]+[A-Z][a-zA-Z.'\-]*){1,3})"
    r"[ \t]+(?:has[ \t]+(?:successfully[ \t]+)?completed|has[ \t]+completed[ \t]+practical|"
    r"successfully[ \t]+completed|completed[ \t]+the[ \t]+(?:course|program|module|task))"
)
NAME_LINE = r"^[A-Z][A-Za-z.'\-]*(?:[ \t]+[A-Z][A-Za-z.'\-]*){1,4}$"
MONTH_WORDS = (
    "january|february|march|april|may|june|july|august|september|october|november|december|"
    "jan|feb|mar|apr|jun|jul|aug|sept|sep|oct|nov|dec"
)
DATE_ISO_PART = r"((?:19|20)\d{2})[-/.]((?:0?[1-9]|1[0-2]))[-/.]((?:0?[1-9]|[12]\d|3[01]))"
DATE_DMY_PART = r"((?:0?[1-9]|[12]\d|3[01]))[-/.]((?:0?[1-9]|1[0-2]))[-/.]((?:19|20)\d{2})"
DATE_MONTH_FIRST_PART = rf"({MONTH_WORDS})[.,]?\s+(\d{{1,2}})(?:st|nd|rd|th)?,?\s+((?:19|20)\d{{2}})"
DATE_DAY_FIRST_PART = rf"(\d{{1,2}})(?:st|nd|rd|th)?\s+({MONTH_WORDS}),?\s+((?:19|20)\d{{2}})"
DATE_IN_TEXT = (
    rf"(?i)\b(?:{DATE_ISO_PART}|{DATE_DMY_PART}|{DATE_MONTH_FIRST_PART}|{DATE_DAY_FIRST_PART})\b"
)
MARKS_IN_TEXT = (
    r"(?i)(?:marks?|score|percentage|percent|obtained|total)"
    r"(?:[ \t]+(?:obtained|scored|achieved))?[ \t]*[:.]?[ \t]*"
    r"(\d+(?:\.\d+)?)[ \t]*(?:out[ \t]+of|/|of)[ \t]*(\d+(?:\.\d+)?)"
)
GRADE_IN_TEXT = r"(?i)grade\s*[:.]?\s*([A-F])"
GRADE_IN_TEXT_STRICT = r"(?i)\bgrade\b\s*[:.]?\s*([A-F])\b"
ISSUER_LABEL = (
    r"(?i)\b(?:organization|institution|university|college|institute|academy)"
    r"[ \t]*[:.][ \t]*([^\r\n]+)"
)
ISSUER_MARKER = (
    r"(?i)(?:issued by|presented by|awarded by|provided by|conducted by|training provider|"
    r"instructor|offered by|certified by|organized by)[ \t]*:?[ \t]*([^\n]+)"
)
ISSUER_CLAUSE_BREAK = (
    r"\s+and\s+(?=[a-z])|\s*,\s*|\s+which\b|\s+who\b|\s+upon\b|"
    r"\s+in\s+(?:collaboration|partnership|association|cooperation|conjunction)\s+with\b"
)
ISSUER_DANGLING = r"\s+(?:in|by|with|at|for|from|the|and)\s*$"
ORG_WORDS = ["university", "institute", "college", "academy", "school", "polytechnic"]
GENERIC_ISSUERS = [
    "the course faculty", "course faculty", "the faculty", "faculty", "the committee",
    "committee", "the organizers", "organizers", "the management", "management",
    "the coordinator", "coordinator", "the participants", "participants", "the participant",
    "participant", "verified", "the department", "department", "the staff", "staff",
    "the organizers and coordinators",
]
BARE_ORG_NOUNS = [
    "academy", "university", "institute", "college", "school", "polytechnic", "academia",
]
ORG_LINE_REJECT = [
    "certify that", "certifies that", "awarded to", "presented to",
    "present this certificate to", "completed by", "we thank", "this certificate is awarded to",
    "issued by", "certified by", "organized by", "awarded by", "presented by", "offered by",
    "provided by", "conducted by", "training provider", "instructor",
]
NAME_REJECT_WORDS = [
    "academy", "university", "college", "institute", "school", "polytechnic", "training",
    "certification", "certificate", "accreditation", "authority", "corporation", "incorporated",
    "inc", "ltd", "llc", "company", "limited", "services", "solutions", "technologies", "empire",
    "emporium", "platform", "network", "director", "manager", "president", "chairman", "founder",
    "professor", "dr.", "sir", "participant", "department", "faculty", "committee", "organizer",
    "coordinator", "instruction", "curriculum", "registry", "office", "department of", "grade",
    "signature", "seal",
]
ORG_SUFFIXES = [" ltd", " llc", " inc", " gmbh", " pvt", " corp", " plc", " sa"]
LABELED_LINE = (
    r"(?i)^\s*(?:course|program|title|topic|subject|cert[ \t]+id|certificate[ \t]+id"
    r"|candidate[ \t]+id|roll[ \t]+no|issu(?:ed|ance)[ \t]+date|date[ \t]+of|"
    r"completion[ \t]+date|grade|marks|score|credits?|duration|hours)[ \t]*[:.]"
)
LABELED_ID = (
    r"(?i)(?:candidate[ \t]+id|certificate[ \t]+id|cert[ \t]+no|certification[ \t]+code)"
    r"[ \t]*[:.][ \t]*([^\r\n]+)"
)
COURSE_KEYWORDS = [
    "computer science", "electrical engineering", "mechanical engineering",
    "business administration", "data science", "artificial intelligence", "civil engineering",
    "biotechnology", "economics", "information technology", "robotics", "mba",
    "machine learning", "deep learning", "cloud computing", "internet of things",
    "cybersecurity", "web development", "devops", "project management", "digital marketing",
    "leadership", "aws", "communication skills", "network security", "software engineering",
    "data engineering", "cloud architecture", "kubernetes",
]
COURSE_LABEL = (
    r"(?i)\b(?:course(?:\s+title)?|programme?|subject|module|track|pathway|area\s+of\s+study|"
    r"specialization|specialisation|certification\s+name)\s*[:.\-]\s*([^\n]{3,120})"
)
COURSE_PHRASE = (
    r"(?i)\b(?:for\s+successfully\s+completing|for\s+completing|completing\s+the|completing|"
    r"completed\s+the|completed|completion\s+of|for\s+successful\s+completion\s+of)[:.]?[ \t]*\n?[ \t]*"
    r"((?-i:[A-Z])[A-Za-z0-9'’ /&+:.\-]{2,120})"
)
COURSE_STOP_LINES = [
    "awarded to", "presented to", "present this certificate to", "for successfully completing",
    "for completing", "completing the", "has completed", "successfully completed",
    "this certificate is awarded to", "this certifies that", "we hereby certify that",
    "we certify that",
]
CODE_LABELS = [
    "enrolment verification code", "enrollment verification code", "user verification code",
    "verification code", "verification url", "enrolment code", "enrollment code",
    "verification id", "verification number", "candidate code", "credential id",
    "credential code", "certificate id", "certificate no", "certification code",
    "reference number", "reference no", "serial number", "serial no", "certificate number",
]
CODE_TOKEN = r"[A-Za-z0-9][A-Za-z0-9._\-]{3,63}"
CODE_SHAPES = [r"^[0-9a-fA-F]{16,64}$", r"^[A-Za-z0-9]{6,64}$", r"^[A-Za-z0-9._\-]{6,64}$"]
CORE_FIELDS = ["candidate_name", "organization", "course", "issue_date", "cert_id"]

# --- Fixed values: semantic roles ----------------------------------------------
ROLE_PHRASES = {
    "completion": [
        "successfully completed", "has completed", "completed the course", "course completion",
        "completion of", "for successfully completing", "has successfully completed",
        "completing the",
    ],
    "achievement": [
        "has achieved", "has earned", "achieved", "earned", "accomplished", "has demonstrated",
        "has acquired",
    ],
    "certification": [
        "certifies that", "certification", "is certified", "professional certification",
        "certified professional", "has been certified",
    ],
    "training": ["training", "trained", "training program", "course of training"],
    "participation": ["participation", "participated", "attended", "was awarded for participation"],
    "award": ["awarded", "is awarded", "award", "presented to", "is hereby awarded"],
    "credential": [
        "credential", "credentials", "badge", "micro-credential", "certificate of",
        "student level credential", "credential of",
    ],
}
VERIFICATION_PHRASES = [
    "verify", "verification", "scan to verify", "verification code", "verification url",
    "verify at", "check authenticity",
]
LEVEL_PATTERNS = [
    ("student_level", r"student[- ]level"),
    ("professional", r"professional"),
    ("associate", r"associate(?! level)"),
    ("advanced", r"advanced"),
    ("expert", r"expert"),
    ("fundamentals", r"fundamentals"),
    ("essentials", r"essentials"),
]
SNIPPET_RADIUS = 120
SNIPPETS_PER_ROLE = 3

# --- Fixed values: domains -----------------------------------------------------
BARE_DOMAIN = r"(?i)^(?:https?://)?([a-z0-9][a-z0-9.-]+\.[a-z]{2,})(?:[/?#].*)?$"
VERIFICATION_PATH_WORDS = ["verif", "check", "certif", "credential"]
VERIFICATION_DOMAIN_WORDS = ["verify", "verif", "credential"]
ISSUER_FILLER_WORDS = [
    "university", "academy", "institute", "college", "school", "training", "certification",
    "certifications", "education", "center", "centre", "council", "association", "foundation",
    "the", "of", "for", "and",
]
CANDIDATE_TLDS = [".com", ".edu", ".org"]

# --- Fixed values: the feature contract, in order ------------------------------
FEATURE_SCHEMA_VERSION = "v3"
FEATURE_COLUMNS = [
    "cert_id_format_valid", "cert_id_checksum_valid", "issuer_known", "issue_year_valid",
    "date_consistency_valid", "candidate_name_present", "course_present",
    "organization_present", "text_field_completeness", "marks_pattern_valid",
    "grade_consistency_valid", "suspicious_keyword_count", "suspicious_url_present",
    "signature_present", "seal_present", "qr_present", "visual_blank_ratio",
    "visual_sharpness", "visual_noise", "visual_color_anomaly", "text_duplicate_similarity",
    "issuer_domain_trust", "certificate_type_academic", "certificate_type_completion",
    "certificate_type_training", "certificate_type_technical", "recipient_present",
    "completion_date_present", "issuer_present", "completion_title_present",
    "certificate_structure_completeness",
]
DOUBLE_FEATURES = [
    "text_field_completeness", "visual_blank_ratio", "visual_sharpness", "visual_noise",
    "text_duplicate_similarity", "issuer_domain_trust", "certificate_structure_completeness",
]

# --- Fixed values: thresholds --------------------------------------------------
HIGH_RISK = 0.5
ELEVATED_RISK = 0.3
MIN_METRIC_SAMPLES = 10
MIN_GROUP_SAMPLES = 5
MIN_DECISIVE_SAMPLES = 5
UNDERREPRESENTED_BELOW = 5
JSD_ALERT = 0.25
RISK_SHIFT_ALERT = 0.10
MIN_TEXT_CHARS = 40
HYBRID_TEXT_CHARS = 150
MIN_TEXT_COMPLETENESS = 0.4
MAX_FILE_BYTES = 10 * 1024 * 1024
TEST_FRACTION = 0.20

# --- Fixed values: vocabularies ------------------------------------------------
REVIEWER_LABELS = ["confirmed_genuine", "confirmed_suspicious", "uncertain"]
DECISIVE_LABELS = ["confirmed_genuine", "confirmed_suspicious"]
SPLITS = ["train", "test"]
LINK_COLUMNS = ["file_fingerprint", "cert_id_fingerprint", "identity_fingerprint", "certificate_id"]
FINGERPRINT_COLUMNS = ["file_fingerprint", "cert_id_fingerprint", "identity_fingerprint"]
SENSITIVE_KEYS = [
    "code", "identifier", "token", "verification_code", "cert_id", "credential_id",
    "verification_codes", "checked_identifier", "checked_identifiers",
]
SEVERITY_WEIGHT = {"low": 1, "medium": 2, "high": 3}
STATUS_DIRECTION = {
    "PASS": "positive", "WARNING": "neutral", "FAIL": "negative", "UNKNOWN": "unknown",
}
STATUS_CLASS = {
    "PASS": "POSITIVE_EVIDENCE", "WARNING": "WARNING", "FAIL": "NEGATIVE_EVIDENCE",
    "UNKNOWN": "UNKNOWN",
}
ASSESSMENT_OF_DECISION = {
    "VERIFIED": "LIKELY_GENUINE", "REQUIRES_VERIFICATION": "REQUIRES_VERIFICATION",
    "SUSPICIOUS": "LIKELY_SUSPICIOUS", "INSUFFICIENT_EVIDENCE": "INSUFFICIENT_EVIDENCE",
}
ACTION_OF_DECISION = {
    "VERIFIED": "accept", "REQUIRES_VERIFICATION": "manual_verification",
    "SUSPICIOUS": "investigate", "INSUFFICIENT_EVIDENCE": "manual_verification",
}
ACTION_OF_REVIEW_STATUS = {
    "low_risk": "accept", "manual_review": "manual_review", "high_risk": "investigate",
}
SEVERITY_OF_STATUS = {
    "completed": "success", "failed": "error", "recorded": "info", "unavailable": "warning",
    "skipped": "unknown",
}
HIGH_PRIORITY_KEYS = [
    "marks_exceed_total", "invalid_date", "invalid_cert_id", "grade_marks_mismatch",
    "suspicious_wording", "suspicious_url",
]
MEDIUM_PRIORITY_KEYS = [
    "missing_recipient", "low_structure", "unknown_issuer", "cert_id_issuer_mismatch",
    "invalid_marks", "missing_text", "visual_quality",
]
TEMPLATE_SALT = "phase12-label-group-v1"
ACCEPTED_EXTENSIONS = ["pdf", "png", "jpg", "jpeg"]
MAGIC_BYTES = {"pdf": b"%PDF", "png": b"\x89PNG\r\n\x1a\n", "jpg": b"\xff\xd8\xff", "jpeg": b"\xff\xd8\xff"}
END_OF_FILE_MARK = b"%%EOF"
