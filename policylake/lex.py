"""Vocabularies: fixed values of the domain, and a profile for test data.

Keyword operators take a profile, because a corpus has the vocabulary of its domain. The lists below are fixed values,
stated as they have to be for equal results; nothing in them is logic.
"""

from __future__ import annotations

# Patterns of relevant links.
RELEVANT = [
    r"\bschemes?\b",
    r"\byojanas?\b",
    r"\byojanes?\b",
    r"\bguidelines?\b",
    r"\borders?\b",
    r"\bnotifications?\b",
    r"\bcirculars?\b",
    r"\bpolic(?:y|ies)\b",
    r"\beligibility\b",
    r"\bcriteria\b",
    r"\bbenefits?\b",
    r"\brules?\b",
    r"\bg\.?o\.?\b",
    r"\bg\.?r\.?\b",
    "ಯೋಜನೆ",
    "ಮಾರ್ಗಸೂಚಿ",
    "ಆದೇಶ",
    "ಅಧಿಸೂಚನೆ",
    "ಸುತ್ತೋಲೆ",
    "ಅರ್ಹತೆ",
    "ನಿಯಮ",
]

# Patterns of documents that are no scheme documents.
EXCLUDED = [
    r"\bholidays?\b",
    r"\btenders?\b",
    r"\bcontacts?\b",
    r"\bdirector(?:y|ies)\b",
    r"\bcug\b",
    r"\btransfers?\b",
    r"\brecruitments?\b",
    r"\bseniority\b",
    "ರಜೆ",
    "ಟೆಂಡರ್",
    "ಸಂಪರ್ಕ",
    "ದೂರವಾಣಿ",
    "ವರ್ಗಾವಣೆ",
    "ನೇಮಕಾತಿ",
    r"ಜಿಲ್ಲಾ\s+ಕಛೇರಿ",
]

# Common words of reliable text.
COMMON_WORDS = [
    "the",
    "of",
    "and",
    "to",
    "in",
    "is",
    "for",
    "government",
    "karnataka",
    "department",
    "state",
    "order",
    "scheme",
    "directorate",
    "agriculture",
    "under",
    "proceedings",
    "date",
    "dated",
    "secretary",
    "commissioner",
    "subject",
    "read",
    "preamble",
    "bengaluru",
    "finance",
    "development",
    "central",
    "share",
    "allocation",
    "annual",
    "total",
    "general",
    "component",
    "plan",
    "guidelines",
    "rules",
    "district",
    "meeting",
    "officer",
    "public",
]

# Administrative or status text.
ADMIN_STATUS = [
    "submitted to",
    "submit to",
    "submitted through",
    "submit through",
    "taluk office",
    "office of",
    "karyalaya",
    "assistant director",
    "forwarded to",
    "dispatch",
    "preservation",
    "keep the document",
    "guard file",
    "spare copies",
    "internal memo",
    "there is no change in this notification",
    "no change in notification",
    "amended notification",
    "order remains in force",
    "notification status",
    "online portal",
    "portal",
    "applications shall be",
    "application shall be",
    "mode of application",
    "submission of application",
    "ಬದಲಾವಣೆ ಇರುವುದಿಲ್ಲ",
    "ಉಳಿದಂತೆ ಸದರಿ",
    "ಅಧಿಸೂಚನೆ",
    "ತಿದ್ದುಪಡಿ",
    "ಕಛೇರಿಗೆ",
    "ಕಚೇರಿಗೆ",
    "ಕಳುಹಿಸಲಾಗುವುದು",
    "ರವಾನಿಸಲಾಗಿದೆ",
    "ಸಂರಕ್ಷಿಸಲು",
    "ರಕ್ಷಾ ಕಡತ",
]

# Phrases that name a candidate's attribute.
ATTRIBUTE_PHRASES = [
    "annual income",
    "government servant",
    "government employee",
    "psu employee",
    "institutional landholder",
    "income tax payee",
    "small farmer",
    "marginal farmer",
    "cultivable land",
    "dry land",
    "wet land",
    "general category",
    "family income",
    "ಸರ್ಕಾರಿ ನೌಕರ",
    "ಸಣ್ಣ ರೈತ",
    "ಅತಿ ಸಣ್ಣ ರೈತ",
    "ಕರ್ನಾಟಕದ ನಿವಾಸಿ",
    "ಹಿಂದುಳಿದ ವರ್ಗ",
    "ಪರಿಶಿಷ್ಟ ಜಾತಿ",
    "ಪರಿಶಿಷ್ಟ ಪಂಗಡ",
]

# Words that name a candidate's attribute.
ATTRIBUTE_WORDS = [
    "income",
    "salary",
    "tax",
    "taxpayer",
    "age",
    "land",
    "landholding",
    "hectare",
    "acre",
    "farmer",
    "cultivator",
    "resident",
    "residency",
    "domicile",
    "caste",
    "pension",
    "disqualified",
    "excluded",
    "exclusion",
    "eligible",
    "eligibility",
    "qualifies",
    "qualification",
    "ರೈತ",
    "ಕೃಷಿಕ",
    "ಹಿಡುವಳಿ",
    "ಹಿಡುವಳಿದಾರ",
    "ಭೂಮಿ",
    "ಜಮೀನು",
    "ಹೆಕ್ಟೇರ್",
    "ಎಕರೆ",
    "ಗುಂಟೆ",
    "ಖುಷ್ಕಿ",
    "ತರಿ",
    "ಬಾಗಾಯ್ತು",
    "ಆದಾಯ",
    "ಆದಾಯತೆರಿಗೆ",
    "ತೆರಿಗೆ",
    "ರೂಪಾಯಿ",
    "ವಯಸ್ಸು",
    "ವರ್ಷ",
    "ಪರಿಶಿಷ್ಟ",
    "ನಿವಾಸಿ",
    "ಸಾಂಸ್ಥಿಕ",
    "ಪಿಂಚಣಿ",
    "ಅನರ್ಹ",
    "ಅರ್ಹತೆ",
]

# Parts of words that name a candidate's attribute.
ATTRIBUTE_PARTS = [
    "ರೈತ",
    "ಕೃಷಿಕ",
    "ಭೂಮಿ",
    "ಜಮೀನು",
    "ಹೆಕ್ಟೇರ್",
    "ಎಕರೆ",
    "ಆದಾಯ",
    "ತೆರಿಗೆ",
    "ವಯಸ್ಸು",
    "ಪರಿಶಿಷ್ಟ",
    "ನಿವಾಸಿ",
    "ಸರ್ಕಾರಿ ನೌಕರ",
    "ಅನರ್ಹ",
    "ಅರ್ಹತೆ",
]

# Statements that there are no rules.
ABSENCE = [
    "no specific exclusion",
    "no exclusion rule",
    "no exclusions mentioned",
    "no specific exclusion criteria",
    "no exclusion criteria",
    "no exclusion rules provided",
    "no exclusions provided",
    "no exclusion provided",
    "no exclusions found",
    "no exclusion stated",
    "no specific eligibility",
    "no eligibility rule",
    "no eligibility criteria",
    "no eligibility rules provided",
    "no eligibility provided",
    "no specific rules",
    "none mentioned",
    "none provided",
    "none stated",
    "not mentioned in document",
    "not specified in document",
    "not provided in document",
    "not available in document",
    "ಯಾವುದೇ ಅನರ್ಹತೆ ನಿಯಮಗಳಿಲ್ಲ",
    "ಯಾವುದೇ ಅರ್ಹತಾ ನಿಯಮಗಳಿಲ್ಲ",
]

# Funding and allocation.
FUNDING = [
    "state-wise allocation",
    "state wise allocation",
    "district-wise allocation",
    "district wise allocation",
    "state/ut allocation",
    "state and ut allocation",
    "allocation to state",
    "allocation to states",
    "allocation under",
    "allocations under",
    "allocation for the year",
    "allocation table",
    "fund allocation",
    "allocation of fund",
    "allocation of funds",
    "district-wise physical and financial",
    "district-wise financial",
    "budget allocation",
    "financial outlay",
    "budget outlay",
    "annual outlay",
    "budget provision",
    "central share",
    "state share",
    "funding share",
    "funding pattern",
    "department funding",
    "scheme implementation funding",
    "grant-in-aid",
    "grants-in-aid",
    "utilization certificate",
    "utilization certificates",
    "fund distribution",
    "expenditure ceiling",
    "department-level expenditure",
    "expenditure statement",
    "release of funds",
    "funds released",
    "ಅನುದಾನ ಹಂಚಿಕೆ",
    "ಅನುದಾನ ಬಿಡುಗಡೆ",
    "ಜಿಲ್ಲಾವಾರು ಹಂಚಿಕೆ",
    "ರಾಜ್ಯವಾರು ಹಂಚಿಕೆ",
    "ಆಯವ್ಯಯ ಹಂಚಿಕೆ",
    "ಬಜೆಟ್ ಹಂಚಿಕೆ",
    "ಕೇಂದ್ರದ ಪಾಲು",
    "ರಾಜ್ಯದ ಪಾಲು",
    "ಬಳಕೆ ಪ್ರಮಾಣಪತ್ರ",
    "ವೆಚ್ಚದ ವಿವರ",
]

# Individuals.
ENTITIES = [
    "beneficiary",
    "beneficiaries",
    "applicant",
    "applicants",
    "farmer",
    "farmers",
    "person",
    "persons",
    "citizen",
    "citizens",
    "candidate",
    "candidates",
    "individual",
    "individuals",
    "student",
    "students",
    "family",
    "families",
    "household",
    "households",
    "ಫಲಾನುಭವಿ",
    "ಫಲಾನುಭವಿಗಳು",
    "ಅರ್ಜಿದಾರ",
    "ಅರ್ಜಿದಾರರು",
    "ರೈತ",
    "ರೈತರು",
    "ವ್ಯಕ್ತಿ",
    "ವ್ಯಕ್ತಿಗಳು",
    "ಕುಟುಂಬ",
    "ವಿದ್ಯಾರ್ಥಿ",
    "ವಿದ್ಯಾರ್ಥಿಗಳು",
]

# Conditions of individuals.
QUALIFYING = [
    "eligible",
    "eligibility",
    "qualifies",
    "qualify",
    "qualification",
    "must reside",
    "residing in",
    "resident of",
    "domiciled in",
    "must possess",
    "must own",
    "shall be eligible",
    "entitled to receive",
    "can apply",
    "restricted to",
    "ಅರ್ಹ",
    "ಅರ್ಹರು",
    "ಅರ್ಹತೆ",
    "ವಾಸವಾಗಿರುವ",
    "ನಿವಾಸಿ",
    "ಪಡೆಯಲು ಅರ್ಹರು",
    "ಅರ್ಜಿ ಸಲ್ಲಿಸಲು",
]

# Amendments and document status.
AMENDMENT = [
    "ಬದಲಾವಣೆ ಇರುವುದಿಲ್ಲ",
    "ಬದಲಾವಣೆಯಿಲ್ಲ",
    "ಬದಲಾವಣೆ ಇಲ್ಲ",
    "ಯಾವುದೇ ಬದಲಾವಣೆ",
    "ಉಳಿದಂತೆ ಸದರಿ",
    "ಅಧಿಸೂಚನೆಯಲ್ಲಿ ಯಾವುದೇ",
    "ತಿದ್ದುಪಡಿ",
    "ಜಾರಿಯಲ್ಲಿರುತ್ತದೆ",
    "ಜಾರಿಗೆ ಬರುತ್ತದೆ",
    "ಹಿಂಪಡೆಯಲಾಗಿದೆ",
    "ಪ್ರಕಟಿಸಲಾಗಿದೆ",
    "no change in",
    "remains unchanged",
    "remains in force",
    "amendment",
    "amended",
    "notification status",
    "supersedes",
    "clarification issued",
    "published in gazette",
    "effective immediately",
    "effective from",
]

# Administrative handling.
HANDLING = [
    "ಕಳುಹಿಸಲಾಗುವುದು",
    "ರವಾನಿಸಲಾಗಿದೆ",
    "ರವಾನೆ",
    "ಸಂರಕ್ಷಿಸಲು",
    "ಪರಿಶೀಲಿಸಲು ಮತ್ತು ಸಂರಕ್ಷಿಸಲು",
    "ಕಛೇರಿಗೆ",
    "ಕಚೇರಿಗೆ",
    "ಕಛೇರಿ",
    "ಕಚೇರಿ",
    "ನಿಯತಕಾಲಿಕವಾಗಿ",
    "ರಕ್ಷಾ ಕಡತ",
    "ಹೆಚ್ಚುವರಿ ಪ್ರತಿಗಳು",
    "ಸಹಾಯಕ ಕೃಷಿ ನಿರ್ದೇಶಕರ",
    "ಅಧೀನ ಕಾರ್ಯದರ್ಶಿ",
    "ಪ್ರಧಾನ ಮಹಾಲೇಖಪಾಲರು",
    "ಆಂತರಿಕ ಆರ್ಥಿಕ ಸಲಹೆಗಾರರು",
    "ಆಯುಕ್ತರ ಮುಖಾಂತರ",
    "ಆಜ್ಞಾನುಸಾರ",
    "ರಾಜ್ಯಪಾಲರ",
    "ನಿಧಿ ಬಿಡುಗಡೆ",
    "ಅನುದಾನ ಬಿಡುಗಡೆ",
    "forwarded to",
    "submitted to",
    "office of",
    "karyalaya",
    "coordinator",
    "periodically",
    "dispatch",
    "preservation",
    "guard file",
    "spare copies",
    "under secretary",
    "governor of karnataka",
    "accountant general",
    "internal financial advisor",
    "verification committee",
    "nodal officer",
    "administrative handling",
    "procedural change",
]

# Committees.
COMMITTEE = [
    "to be nominated by",
    "nominated by the government",
    "nominated by government",
    "committee member",
    "members of the committee",
    "composition of the committee",
    "representatives to be nominated",
    "directorate comprising",
    "consisting of the following officers",
    "professor in the subject of",
    "joint director of",
    "chief conservator of",
    "ಸಮಿತಿಯ ರಚನೆ",
    "ಸರ್ಕಾರದಿಂದ ನಾಮನಿರ್ದೇಶನ",
    "ನಾಮನಿರ್ದೇಶನ ಮಾಡಲು",
    "ಸದಸ್ಯರಾಗಿ",
    "ಅಧ್ಯಕ್ಷರಾಗಿ",
    "ತಾಂತ್ರಿಕ ಅಧಿಕಾರಿ",
    "ನಿರ್ದೇಶಕರು ಸದಸ್ಯರು",
]

# A candidate's qualification.
CANDIDATE = [
    "ರೈತ",
    "ಕೃಷಿಕ",
    "ಹಿಡುವಳಿ",
    "ಹಿಡುವಳಿದಾರ",
    "ಭೂಮಿ",
    "ಜಮೀನು",
    "ಹೆಕ್ಟೇರ್",
    "ಎಕರೆ",
    "ಗುಂಟೆ",
    "ಖುಷ್ಕಿ",
    "ತರಿ",
    "ಬಾಗಾಯ್ತು",
    "ಕ್ಷೇತ್ರ",
    "ವಿಸ್ತೀರ್ಣ",
    "ಆದಾಯ",
    "ಆದಾಯತೆರಿಗೆ",
    "ತೆರಿಗೆ",
    "ಬಿಪಿಎಲ್",
    "ಎಪಿಎಲ್",
    "ರೂಪಾಯಿ",
    "ರೂ.",
    "ವಯಸ್ಸು",
    "ವರ್ಷ",
    "ಪರಿಶಿಷ್ಟ ಜಾತಿ",
    "ಪರಿಶಿಷ್ಟ ಪಂಗಡ",
    "ಹಿಂದುಳಿದ ವರ್ಗ",
    "ಜಾತಿ",
    "ಪ್ರವರ್ಗ",
    "ಮಹಿಳೆ",
    "ಕುಟುಂಬ",
    "ಪತಿ",
    "ಪತ್ನಿ",
    "ಮಕ್ಕಳು",
    "ಅಪ್ರಾಪ್ತ",
    "ಯಜಮಾನಿ",
    "ವಿದ್ಯಾರ್ಥಿ",
    "ವಿದ್ಯಾರ್ಥಿನಿ",
    "ವಿದ್ಯಾರ್ಥಿವೇತನ",
    "ಶಿಕ್ಷಣ",
    "ಕಾಲೇಜು",
    "ವಿಶ್ವವಿದ್ಯಾಲಯ",
    "ಪರೀಕ್ಷೆ",
    "ಅನುತ್ತೀರ್ಣ",
    "ಪದವಿ",
    "ಸ್ನಾತಕೋತ್ತರ",
    "ನಿವಾಸಿ",
    "ವಾಸವಾಗಿರುವ",
    "ಕರ್ನಾಟಕದ ನಿವಾಸಿ",
    "ಸರ್ಕಾರಿ ನೌಕರ",
    "ನೌಕರರಾಗಿ",
    "ಅಧಿಕಾರಿ",
    "ಸಾಂಸ್ಥಿಕ",
    "ಸಂಸ್ಥೆ",
    "ಪಿಂಚಣಿ",
    "ವೈದ್ಯ",
    "ಇಂಜಿನಿಯರ್",
    "ವಕೀಲ",
    "ಸಚಿವ",
    "ಸಂಸದ",
    "ಶಾಸಕ",
    "ತೆರಿಗೆ ಪಾವತಿದಾರ",
    "ಅನರ್ಹ",
    "ಅರ್ಹತೆ",
    "ಅರ್ಹ",
    "ಫಲಾನುಭವಿ",
    "ಆಧಾರ್",
    "ಫ್ರೂಟ್ಸ್",
    "ಜಿಎಸ್‌ಟಿ",
    "farmer",
    "cultivator",
    "landholder",
    "agriculturalist",
    "land",
    "landholding",
    "hectare",
    "acre",
    "ha",
    "gunta",
    "cultivable",
    "dry land",
    "wet land",
    "irrigated",
    "income",
    "annual income",
    "tax",
    "taxpayer",
    "payee",
    "bpl",
    "apl",
    "salary",
    "rupees",
    "rs.",
    "age",
    "years of age",
    "years old",
    "caste",
    "sc",
    "st",
    "obc",
    "general category",
    "minority",
    "women",
    "female",
    "male",
    "gender",
    "family",
    "household",
    "spouse",
    "children",
    "minor",
    "head of family",
    "student",
    "education",
    "course",
    "degree",
    "post-matric",
    "scholarship",
    "vidyanidhi",
    "exam",
    "failed",
    "repeat",
    "post graduate",
    "resident",
    "residency",
    "domicile",
    "karnataka",
    "government servant",
    "government employee",
    "psu employee",
    "institutional landholder",
    "pension",
    "income tax payee",
    "doctor",
    "engineer",
    "lawyer",
    "chartered accountant",
    "minister",
    "mp",
    "mla",
    "constitutional post",
    "disqualified",
    "excluded",
    "exclusion",
    "eligible",
    "eligibility",
    "qualifies",
    "qualification",
    "must own",
    "must possess",
    "beneficiary",
    "aadhaar",
    "fruits",
    "gst",
]

# Criteria in evidence.
CRITERIA = [
    "income",
    "tax",
    "rs",
    "rupee",
    "lakh",
    "0",
    "1",
    "2",
    "3",
    "4",
    "5",
    "6",
    "7",
    "8",
    "9",
    "ಆದಾಯ",
    "ತೆರಿಗೆ",
    "ರೂ",
    "ಬಿಪಿಎಲ್",
    "ಎಪಿಎಲ್",
    "ಹೆಕ್ಟೇರ್",
    "ಎಕರೆ",
    "ವರ್ಷ",
    "ವಯಸ್ಸು",
]

# Limits per household.
HOUSEHOLD_LIMITS = [
    "ಒಂದೇ ಕುಟುಂಬದಲ್ಲಿ",
    "ಒಂದು ಕುಟುಂಬದಲ್ಲಿ",
    "ಒಂದು ಮಹಿಳೆಗೆ ಮಾತ್ರ",
    "ಒಬ್ಬರಿಗೆ ಮಾತ್ರ",
    "ಕುಟುಂಬಕ್ಕೆ ಒಂದು",
    "ಗರಿಷ್ಠ ಒಂದು",
    "one woman per household",
    "one per family",
    "only one per household",
    "single beneficiary per family",
    "one person per household",
    "household limit",
]

# Replacements of rule texts, in order.
REPLACEMENTS = [
    ("shall not exceed", "must not exceed"),
    ("should not exceed", "must not exceed"),
    ("cannot exceed", "must not exceed"),
    ("shall be", "must be"),
    ("should be", "must be"),
    ("is excluded", "not eligible"),
    ("are excluded", "not eligible"),
    ("are not eligible", "not eligible"),
    ("karnataka resident", "resident of karnataka"),
    ("permanent resident of karnataka", "resident of karnataka"),
    ("belong to karnataka", "resident of karnataka"),
    ("₹", "rs "),
    ("rupees", "rs"),
    ("lakhs", "lakh"),
    ("hectares", "hectare"),
    ("acres", "acre"),
    ("years of age", "years"),
    ("years old", "years"),
]

# Form labels and their patterns.
FORM_LABELS = [
    ('Applicant Name', r"(?:ಹೆಸರು|ಅರ್ಜಿದಾರರ\s*ಹೆಸರು|name\s*of\s*the\s*applicant|applicant\s*name)\s*[:\.\_\-]*"),
    ('Father / Husband Name', r"(?:ತಂದೆ|ಗಂಡ|ಪತಿ|ತಾಯಿ)ಯ?\s*ಹೆಸರು|father['\s]*s?\s*name|husband['\s]*s?\s*name"),
    ('Age / DOB', r"(?:ವಯಸ್ಸು|ಹುಟ್ಟಿದ\s*ದಿನಾಂಕ|age|date\s*of\s*birth|dob)\s*[:\.\_\-]*"),
    ('Gender', r"(?:ಲಿಂಗ|ಪುರುಷ|ಮಹಿಳೆ|gender|sex)\s*[:\.\_\-]*"),
    ('Address', r"(?:ವಿಳಾಸ|ವಾಸ್ತವ್ಯ\s*ವಿಳಾಸ|address|residential\s*address)\s*[:\.\_\-]*"),
    ('Mobile Number', r"(?:ಮೊಬೈಲ್‌?\s*ಸಂಖ್ಯೆ|ದೂರವಾಣಿ\s*ಸಂಖ್ಯೆ|mobile\s*no|phone\s*no)\s*[:\.\_\-]*"),
    ('Aadhaar Number', r"(?:ಆಧಾರ್\s*ಸಂಖ್ಯೆ|ಆಧಾರ್\s*ಕಾರ್ಡ್|aadhaar\s*no|aadhaar\s*number)\s*[:\.\_\-]*"),
    ('Caste / Category', r"(?:ಜಾತಿ|ವರ್ಗ|ಪ್ರವರ್ಗ|caste|category)\s*[:\.\_\-]*"),
    ('Annual Income', r"(?:ವಾರ್ಷಿಕ\s*ಆದಾಯ|ಕುಟುಂಬದ\s*ಆದಾಯ|annual\s*income|family\s*income)\s*[:\.\_\-]*"),
    ('Ration Card Number', r"(?:ಪಡಿತರ\s*ಚೀಟಿ|ರೇಷನ್\s*ಕಾರ್ಡ್|ration\s*card\s*no)\s*[:\.\_\-]*"),
    ('Survey Number / Land Extent', r"(?:ಸರ್ವೆ\s*ಸಂಖ್ಯೆ|ಸರ್ವೇ\s*ನಂ|survey\s*no|land\s*extent|ಖಾತೆ\s*ಸಂಖ್ಯೆ)\s*[:\.\_\-]*"),
    ('Bank Account Number', r"(?:ಬ್ಯಾಂಕ್\s*ಖಾತೆ\s*ಸಂಖ್ಯೆ|bank\s*account\s*no|a/c\s*no)\s*[:\.\_\-]*"),
    ('Bank / Branch / IFSC', r"(?:ಬ್ಯಾಂಕ್\s*ಹೆಸರು|ಶಾಖೆ|bank\s*name|branch|ifsc\s*code)\s*[:\.\_\-]*"),
    ('Applicant Signature', r"(?:ಅರ್ಜಿದಾರರ\s*ಸಹಿ|ಹೆಬ್ಬೆಟ್ಟಿನ\s*ಗುರುತು|signature\s*of\s*applicant|applicant\s*signature)\s*[:\.\_\-]*"),
    ('Date / Place', r"(?:ದಿನಾಂಕ|ಸ್ಥಳ|date|place)\s*[:\.\_\-]*"),
]

# Markers in a rule and the evidence that contradicts them.
CONTRADICTIONS = [
    ('landowner_vs_landless', None, ['landless', 'without land', 'no land', 'landless farmer'], ['ಜಮೀನಿನ ಒಡೆಯ', 'ಒಡೆಯ', 'ಜಮೀನು ಹೊಂದಿ', 'ಭೂಮಾಲೀಕ', 'ಹಿಡುವಳಿದಾರ', 'ಹಿಡುವಳಿ ಹೊಂದಿ', 'ಕೃಷಿ ಭೂಮಿ ಹೊಂದಿ']),
    ('landless_vs_landowner', None, ['landowner', 'land owner', 'owns land', 'owning land'], ['ಭೂಹೀನ', 'ಜಮೀನು ರಹಿತ', 'ಭೂ ರಹಿತ']),
    ('eligibility_polarity_inversion', 'eligibility', ['eligible', 'qualifies', 'entitled', 'benefit is given'], ['ಅನರ್ಹ', 'ಅರ್ಹರಾಗಿರುವುದಿಲ್ಲ', 'ಅನ್ವಯಿಸುವುದಿಲ್ಲ', 'ಅರ್ಹವಲ್ಲ', 'ಪಡೆಯಲು ಸಾಧ್ಯವಿಲ್ಲ']),
    ('exclusion_polarity_inversion', 'exclusion', ['excluded', 'disqualified', 'ineligible', 'not eligible'], ['ಅರ್ಹರು', 'ಅರ್ಹರಾಗಿರುತ್ತಾರೆ', 'ಅರ್ಹ ಫಲಾನುಭವಿ', 'ಪಡೆಯಲು ಅರ್ಹ']),
    ('husband_vs_woman_head', None, ['husband is eligible', 'husband receives', 'male head'], ['ಕುಟುಂಬದ ಯಜಮಾನಿ ಮಹಿಳೆ', 'ಮಹಿಳೆಗೆ ಮಾತ್ರ']),
    ('farmer_vs_child', None, ['farmer receives scholarship', 'farmers qualify for scholarship'], ['ರೈತರ ಮಕ್ಕಳು', 'ರೈತರ ಮಕ್ಕಳಿಗೆ']),
]

# Concepts of rules and the evidence that supports them.
CONCEPTS = {
    'student': ['ವಿದ್ಯಾರ್ಥಿ', 'ವಿದ್ಯಾರ್ಥಿನಿ', 'ಶಿಕ್ಷಣ', 'ಕೋರ್ಸ್', 'ಪದವಿ', 'ಶಾಲೆ', 'ಕಾಲೇಜು'],
    'scholarship': ['ವಿದ್ಯಾರ್ಥಿವೇತನ', 'ಶಿಷ್ಯವೇತನ'],
    'fail': ['ಅನುತ್ತೀರ್ಣ', 'ಫೇಲ್'],
    'repeat': ['ಪುನರಾವರ್ತನೆ', 'ಪುನಃ'],
    'woman': ['ಮಹಿಳೆ', 'ಯಜಮಾನಿ', 'ಸ್ತ್ರೀ'],
    'head': ['ಯಜಮಾನಿ', 'ಮುಖಂಡ'],
    'ration': ['ಪಡಿತರ', 'ಚೀಟಿ', 'ಬಿಪಿಎಲ್', 'ಎಪಿಎಲ್', 'ಅಂತ್ಯೋದಯ'],
    'farmer': ['ರೈತ', 'ಕೃಷಿಕ', 'ಹಿಡುವಳಿ'],
}

# Document types and their patterns, in order.
TYPES = [
    ("guideline", r"\bguidelines?\b|ಮಾರ್ಗಸೂಚಿ"),
    ("order", r"\borders?\b|\bg\.?o\.?\b|ಆದೇಶ"),
    ("circular", r"\bcirculars?\b|ಸುತ್ತೋಲೆ"),
    ("notification", r"\bnotifications?\b|ಅಧಿಸೂಚನೆ"),
    ("application_form", r"\bforms?\b|\bapplications?\b|ಅರ್ಜಿ"),
]

# Rule categories that pass as they are.
CATEGORIES = [
    "income", "age", "landholding", "residency", "farmer_category", "occupation", "government_employee", "beneficiary_category",
    "caste_category", "gender", "institutional_landholder", "family_status", "disability", "employment_status",
]

# Tests for a rule's category, in order; a pattern each.
CATEGORY_TESTS = [
    ("institutional_landholder", r"institutional|ಸಾಂಸ್ಥಿಕ"),
    ("government_employee", r"government employee|government servant|psu employee|constitutional post|pension|ಸರ್ಕಾರಿ ನೌಕರ|ಪಿಂಚಣಿ"),
    ("age", r"\b(age|aged|years?\s+old|minimum\s+age|maximum\s+age)\b|ವಯಸ್ಸು|ವರ್ಷ"),
    ("income", r"\b(income|annual\s+income|salary|lakh|lac|rupees|rs|tax|taxpayer)\b|₹|ಆದಾಯ|ತೆರಿಗೆ"),
    ("landholding", r"land|hectare|acre|ha|gunta|cultivable|ceiling|ಭೂಮಿ|ಜಮೀನು|ಹೆಕ್ಟೇರ್|ಎಕರೆ"),
    ("residency", r"resident|residency|domicile|karnataka|resided|ನಿವಾಸಿ|ವಾಸವಾಗಿರುವ"),
    ("farmer_category", r"cultivator|farmer|ರೈತ|ಕೃಷಿಕ"),
    ("caste_category", r"caste|sc|st|obc|category|minority|ಪರಿಶಿಷ್ಟ|ಹಿಂದುಳಿದ"),
    ("gender", r"woman|women|female|male|gender|ಮಹಿಳೆ"),
    ("family_status", r"family|household|spouse|minor children|ಕುಟುಂಬ"),
    ("disability", r"disabled|disability|handicapped|ಅಂಗವಿಕಲ"),
    ("employment_status", r"unemployed|employed|employment"),
    ("occupation", r"doctor|engineer|lawyer|chartered accountant|architect"),
]
# Link texts that say nothing of a document.
GENERIC_LINKS = ["ವೀಕ್ಷಣೆ", "view", "download", "pdf", "click here", "click", "ಇಲ್ಲಿ ಕ್ಲಿಕ್ ಮಾಡಿ"]
# File and name of schemes whose files are not named after them.
SCHEME_FILES = [
    ("gruha-lakshmi", "30af3c4d_GruhaLaxmiGO_rules.json", "Gruha Lakshmi Scheme"),
    ("cm-raitha-vidyanidhi", "668bfe88_cmsclorship_rules.json", "CM Raitha Vidyanidhi Scholarship"),
    ("secondary-agriculture", "02a9ac3f_SecondaryAgriculturedirectorateGO_rules.json", "Secondary Agriculture Directorate"),
    ("rkvy", "1333e107_Allocation2021-22_rules.json", "Rashtriya Krishi Vikas Yojana (RKVY)"),
    ("pm-kisan-karnataka", "e116e94b_PMKISANKarnatakaGO_rules.json", "PM-KISAN Karnataka Top-Up"),
]
# Reasons of decisions.
REASONS = {
    "income_unknown": "Annual income is unknown (not specified in citizen profile).",
    "income_limit": "Could not parse numerical income threshold from scheme rule.",
    "income_excluded": "Annual income ₹%s triggers income exclusion threshold ₹%s.",
    "income_not_excluded": "Annual income ₹%s does not trigger income exclusion threshold ₹%s.",
    "income_fits": "Annual income ₹%s satisfies required income limit ₹%s.",
    "income_exceeds": "Annual income ₹%s exceeds required income limit ₹%s.",
    "land_unknown": "Agricultural land ownership information is unknown.",
    "land_owns": "Citizen owns agricultural land as required.",
    "land_owns_not": "Citizen does not own agricultural land as required.",
    "landless": "Citizen is landless.",
    "landowner": "Citizen is a landowner (fails landless requirement).",
    "failure_unknown": "Academic pass/fail or course repetition status is unknown.",
    "failure": "Citizen triggers exclusion: %s.",
    "failure_none": "Citizen has not failed or repeated semester; exclusion does not apply.",
    "completed_unknown": "Previous higher education course completion status is unknown.",
    "completed": "Citizen has already completed an equivalent or higher course.",
    "completed_not": "Citizen has not completed an equivalent/higher course.",
    "gst_unknown": "GST return filing status for self or spouse is unknown.",
    "tax_unknown": "Income tax payer status is unknown.",
    "tax": "Citizen triggers tax/GST disqualification condition.",
    "tax_none": "Citizen does not trigger tax/GST disqualification condition.",
    "residency_unknown": "Karnataka residency / state information is unknown.",
    "resident": "Citizen is a resident of Karnataka.",
    "resident_not": "Citizen is not a resident of Karnataka.",
    "limit_unknown": "Household member details not provided; cannot verify whether another household member has already claimed the benefit.",
    "limit_reached": "Beneficiary limit reached: %s other member(s) in household already received benefit.",
    "limit_free": "Beneficiary quota available in household (no other member has claimed the benefit).",
    "woman_gender": "Citizen gender is '%s', scheme requires woman head of household.",
    "woman_unknown": "Required information unknown: %s.",
    "woman": "Citizen is confirmed as woman head of family listed in ration card.",
    "woman_not": "Citizen does not satisfy criteria: %s.",
    "generic": "No automated deterministic predicate evaluator available for rule: '%s'.",
}
# Attributes that a change of a document affects, in order, and the words that tell.
AFFECTED = [
    ("income", ["income", "ಆದಾಯ", "rupees", "rs.", "tax", "ತೆರಿಗೆ"]),
    ("age", ["age", "ವಯಸ್ಸು", "years old"]),
    ("landholding", ["land", "hectare", "acre", "ಭೂಮಿ", "ಜಮೀನು", "ಹೆಕ್ಟೇರ್", "ಎಕರೆ"]),
    ("residency", ["resident", "residency", "ನಿವಾಸಿ"]),
    ("farmer_category", ["farmer", "small farmer", "marginal farmer", "ರೈತ"]),
    ("government_employee", ["government employee", "government servant", "ಸರ್ಕಾರಿ ನೌಕರ", "pension"]),
]
# Words of a document's status.
STATUS_WORDS = ["notification", "amendment", "ಅಧಿಸೂಚನೆ", "ತಿದ್ದುಪಡಿ"]

# What free text says of a citizen; patterns of amounts and words.
CITIZEN_AMOUNTS = {
    "thousands": r"(\d+(?:\.\d+)?)\s*k\s*(?:a\s*month|per\s*month|monthly)",
    "monthly": r"(?:earn|salary|income\s*is)?\s*(?:rs\.?|₹)?\s*(\d{4,6})\s*(?:a\s*month|per\s*month|monthly)",
    "lakhs": r"(\d+(?:\.\d+)?)\s*(?:lakh|lac)\s*(?:per\s*year|annually|annual|a\s*year)?",
    "acres": r"(\d+(?:\.\d+)?)\s*acres?",
}
CITIZEN_WORDS = {
    "female": ["woman", "female", "ಮಹಿಳೆ"],
    "male": ["man", "male", "ಪುರುಷ"],
    "head": ["head of family", "household head", "woman head", "ಯಜಮಾನಿ"],
    "landless": ["landless", "no land"],
    "listed": ["head in ration card", "listed as head", "ration card head"],
    "gst": ["gst registered", "gst return"],
    "tax": ["taxpayer", "income tax payer"],
}
RATION_CARDS = [("bpl", "BPL"), ("apl", "APL"), ("antyodaya", "ANTYODAYA"), ("aay", "AAY")]
# Words that tell a rule's handling, committee, scope and evidence.
BENEFICIARIES = ["ಯಜಮಾನಿ", "ಫಲಾನುಭವಿ", "ಅರ್ಹ", "ವಿದ್ಯಾರ್ಥಿ", "ರೈತರ ಮಕ್ಕಳು"]
APPLICANTS = ["applicant must", "beneficiary shall", "ಅರ್ಜಿದಾರರು", "ಫಲಾನುಭವಿಯು"]
HOUSEHOLD_INCOME = ["family income", "household income", "ಕುಟುಂಬದ ಆದಾಯ"]
OFFICE_WORDS = ["ಕಚೇರಿ", "ಅರ್ಜಿ ಸಲ್ಲಿಸಲು", "documents required", "portal", "application"]
NEGATIONS = ["ಅರ್ಹರಾಗಿರುವುದಿಲ್ಲ", "ಅನ್ವಯಿಸುವುದಿಲ್ಲ", "ಅನರ್ಹ", "ಅರ್ಹವಾಗುವುದಿಲ್ಲ", "ಅರ್ಹರಲ್ಲ", "ಸಾಧ್ಯವಿಲ್ಲ", "ಅರ್ಹವಲ್ಲ"]
EITHER, BOTH = ["ಅಥವಾ", "ಯಾವುದಾದರೂ"], "ಇಬ್ಬರೂ"
TAXPAYERS, INCOME_TAX, SALES_TAX = ["taxpayer", "income tax"], "ಆದಾಯ ತೆರಿಗೆ", ["ಜಿಎಸ್‌ಟಿ", "gst"]
TORN_WORDS = r"[;~`_]{2,}|[a-zA-Z]{1,3}[;~`^]{1,3}[a-zA-Z]{1,3}"
# Schemes by words of their name, and the words of the departments and sources that serve them.
SOURCE_GROUPS = [
    (["kisan", "pm-kisan", "raitha", "farmer", "agriculture"], "agri", "raitha"),
    (["lakshmi", "wcd", "women"], "wcd", "lakshmi"),
    (["jyothi", "energy", "bescom"], "energy", "jyothi"),
    (["bhagya", "ahara", "food", "ration"], "food", "ahara"),
]
