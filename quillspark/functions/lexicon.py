"""Word lists and patterns. The lists marked as fixed values decide results and are kept as plain text."""

from __future__ import annotations

# Glyphs that open a bullet line.
BULLET_GLYPHS = "•‣▪●◦⁃∙·‐‒–—"

# Tokens without signal for similarity and keywords.
STOPWORDS = tuple("""
    a an and are as at be been being but by for from had has have he her his i if in into is
    it its me my of on or our ours she that the their them there these they this those to
    was we were what when where which who will with you your about across after all also am
    any because before both can could do does doing during each few had how more most no nor
    not only other over own same so some such than then through too under up very via while
    would should may might must shall
""".split())

# Phrases that describe a duty or assert a trait.
FILLER_PHRASES = (
    "responsible for", "duties included", "duties involved", "tasked with", "worked on", "helped with",
    "involved in", "in charge of", "assisted with", "participated in", "hard worker", "team player",
    "detail oriented", "detail-oriented", "go-getter", "results-driven", "self-starter",
    "think outside the box", "proven track record", "excellent communication skills", "familiar with",
    "exposure to",
)

# Self-praise without evidence.
BUZZWORDS = (
    "synergy", "synergistic", "world-class", "best-in-class", "cutting-edge", "thought leader", "guru",
    "ninja", "rockstar", "wizard", "visionary", "dynamic", "passionate", "motivated", "hardworking",
    "hard-working", "seasoned", "results-oriented", "value-add", "leverage synergies",
)

# Openings that describe a role, not an achievement.
WEAK_OPENERS = (
    "responsible", "worked", "helped", "assisted", "participated", "involved", "tasked", "handled",
    "dealt", "attended",
)

# Strong openers follow a rule: a past tense in -ed, or one of these irregular ones.
IRREGULAR_PAST = (
    "built", "cut", "drove", "grew", "led", "made", "won", "wrote", "taught", "oversaw", "rebuilt",
    "sold", "ran", "brought", "sought", "troubleshot",
)

# Past tenses in -ed that assert no achievement.
IDLE_PAST = ("used", "needed", "wanted", "tried", "liked", "hoped", "seemed", "looked", "asked", "learned", "joined")

# Section headings by kind, in the order that decides ties.
HEADINGS = {
    "summary": ("professional summary", "career summary", "executive summary", "summary of qualifications",
                "profile summary", "about me", "objective", "career objective", "summary", "profile", "overview", "highlights"),
    "experience": ("professional experience", "work experience", "employment history", "relevant experience",
                   "industry experience", "career history", "work history", "experience", "employment", "professional background"),
    "education": ("education and training", "academic background", "education", "academics", "academic qualifications", "qualifications"),
    "skills": ("technical skills", "core competencies", "key skills", "skills and abilities", "areas of expertise",
               "technologies", "technical proficiencies", "tech stack", "competencies", "skills", "expertise", "tools"),
    "projects": ("personal projects", "selected projects", "side projects", "key projects", "projects", "portfolio"),
    "certifications": ("certifications and licenses", "licenses and certifications", "certifications", "certificates", "licenses", "accreditations"),
    "publications": ("publications", "papers", "research", "patents"),
    "awards": ("awards and honors", "honors and awards", "awards", "achievements", "honors"),
    "volunteer": ("volunteer experience", "community involvement", "volunteering", "volunteer"),
    "languages": ("languages",),
    "interests": ("interests", "hobbies", "activities"),
    "references": ("references",),
    "contact": ("contact", "contact information", "personal details", "personal information"),
}
SECTION_KINDS = ("contact", *[k for k in HEADINGS if k != "contact"], "other")
# Sections that every document should have.
CORE_SECTIONS = ("education", "experience", "skills")

# Which context a section's text is for skills, and how much the context counts.
SECTION_CONTEXTS = {"experience": "experience", "projects": "projects", "summary": "summary",
                    "certifications": "certifications", "skills": "skills", "education": "education"}
CONTEXT_WEIGHTS = {"experience": 1.0, "projects": 0.9, "summary": 0.8, "certifications": 0.8,
                   "skills": 0.7, "education": 0.6, "other": 0.5}

# Headings of postings by bucket, in the order in which they are tried.
JOB_HEADINGS = (
    ("preferred", ("preferred", "preferred qualifications", "nice to have", "nice-to-have", "bonus", "bonus points", "plus",
                   "desired", "desirable", "good to have", "additionally", "even better", "pluses", "preferred skills")),
    ("responsibilities", ("responsibilities", "what you'll do", "what you will do", "the role", "about the role", "your impact",
                          "day to day", "duties", "key responsibilities")),
    ("required", ("requirements", "required", "basic qualifications", "minimum qualifications", "must have", "must-have",
                  "what you need", "what you'll need", "qualifications", "who you are", "essential", "required skills",
                  "required qualifications", "we're looking for", "we are looking for", "you have")),
    ("other", ("benefits", "perks", "compensation", "salary", "equal opportunity", "eeo", "about us", "about the company",
               "our mission", "how to apply", "why join")),
)

# Words of every posting.
POSTING_BOILERPLATE = tuple("""
    experience experiences year years strong solid proven demonstrated deep hands excellent good great ability able
    skills skill knowledge understanding background familiarity exposure equivalent practical relevant related degree
    bachelor bachelors master masters preferred required must plus role position job candidate candidates applicant
    team teams company work working works opportunity opportunities including etc
""".split())

# Seniority patterns in the order tried, and ranks.
SENIORITY = (
    ("executive", r"\b(chief|c[toei]o|vp|vice president|head of)\b"), ("director", r"\bdirector\b"),
    ("manager", r"\b(manager|engineering manager|em)\b"), ("principal", r"\b(principal|distinguished|fellow)\b"),
    ("staff", r"\b(staff|architect)\b"), ("senior", r"\b(senior|sr\.?|lead|iii|iv)\b"),
    ("intern", r"\b(intern|internship|co-?op|trainee)\b"), ("junior", r"\b(junior|jr\.?|entry[- ]level|graduate|associate|i{1,2}\b)"),
)
SENIORITY_RANK = {"intern": 0, "junior": 1, "mid": 2, "senior": 3, "staff": 4, "principal": 5, "manager": 5,
                  "director": 6, "executive": 7, "unspecified": -1}

# Words that tell a title from an employer.
TITLE_HINTS = (
    "engineer", "developer", "manager", "analyst", "scientist", "designer", "architect", "consultant", "director",
    "lead", "head", "intern", "specialist", "administrator", "officer", "associate", "coordinator", "president",
    "founder", "owner", "researcher", "programmer", "technician", "supervisor", "strategist", "recruiter",
    "accountant", "nurse", "teacher", "professor", "attorney", "advisor", "principal", "producer",
)
ORG_HINTS = (
    "inc", "inc.", "llc", "ltd", "ltd.", "corp", "corp.", "corporation", "company", "technologies", "solutions",
    "systems", "labs", "group", "gmbh", "plc", "pvt", "consulting", "partners", "holdings", "bank", "university",
    "hospital", "agency",
)
# Names of months.
MONTHS = {
    "jan": 1, "january": 1, "feb": 2, "february": 2, "mar": 3, "march": 3, "apr": 4, "april": 4, "may": 5, "jun": 6, "june": 6,
    "jul": 7, "july": 7, "aug": 8, "august": 8, "sep": 9, "sept": 9, "september": 9, "oct": 10, "october": 10, "nov": 11,
    "november": 11, "dec": 12, "december": 12,
}

# Patterns of dates.
MONTH = "|".join(sorted(MONTHS, key=len, reverse=True))
DATE_POINT = rf"(?:(?:{MONTH})\.?\s*,?\s*\d{{4}}|\d{{1,2}}[/.\-]\d{{4}}|\d{{4}})"
PRESENT = r"present|current|now|to date|ongoing|till date"
DATE_RANGE = rf"(?i)\b({DATE_POINT})(?:\s*(?:-|–|—|to|until|through)\s*)({DATE_POINT}|{PRESENT})\b"

# Patterns of a document's head.
CONTACT_LABEL = r"(?i)^\s*(phone|tel|telephone|mobile|cell|e-?mail|mail|address|location|linkedin|github|portfolio|website|web)\s*[:\-|]\s*"
CONTACT_PHONE = r"((?<![\d\-])(?:\+?\d{1,3}[\s.\-]?)?(?:\(\d{2,4}\)[\s.\-]?)?\d{3,5}[\s.\-]?\d{3,4}(?:[\s.\-]?\d{2,4})?(?![\d\-]))"
PLACE = r"\b([A-Z][\w'’\-]+(?:[ ][A-Z][\w'’\-]+){0,2}),\s*([A-Z]{2}|[A-Z][a-z]+(?:[ ][A-Z][a-z]+)?)\b(?:\s+\d{5}(?:-\d{4})?)?"
URL = r"((?:https?://)?(?:www\.)?[A-Za-z0-9\-]+\.[A-Za-z]{2,}(?:/[^\s,;)]*)?)"
PERSON_NAME = r"^[A-Z][A-Za-z'’.\-]+(?:\s+[A-Z][A-Za-z'’.\-]+){1,3}$"

# Patterns of entries of experience and education.
HEADER_SEPARATOR = r"(?i)\s*(?:\||•|·|—|–|\s-\s|,\s|\bat\b|\bfor\b)\s*"
EDGE = r"^[ ,|\-–—•·]+|[ ,|\-–—•·]+$"
DEGREE = (r"(?i)\b(ph\.?\s?d|doctorate|d\.?phil|m\.?b\.?a|m\.?sc?|master(?:'s)?(?:\s+of\s+\w+)?|b\.?sc?|b\.?a|b\.?e|b\.?tech|m\.?tech|"
          r"bachelor(?:'s)?(?:\s+of\s+\w+)?|associate(?:'s)?|a\.?a\.?s|diploma|high school|secondary school)\b")
INSTITUTION = r"(?i)\b([\w.'&\- ]*?(?:university|college|institute|institution|academy|school|polytechnic)[\w.'&\- ]*)\b"
FIELD_OF_STUDY = r"(?i)\b(?:in|of)\s+([A-Z][\w&\-]*(?:\s+(?:and\s+)?[A-Z&][\w&\-]*){0,4})"
GRADE = r"(?i)\b(?:gpa|cgpa|grade point average)\b[^0-9]{0,12}(\d\.\d{1,2})(?:\s*/\s*(\d\.?\d?))?"

# Patterns of postings.
YEARS_ASKED = r"(?i)(\d{1,2})\s*(?:\+|plus)?\s*(?:-|–|to)?\s*(\d{1,2})?\s*\+?\s*years?\b[^.]{0,40}?\b(?:experience|exp\b|working)"
DEGREE_ASKED = r"(?i)\b(bachelor(?:'s)?|b\.?s\.?|b\.?a\.?|master(?:'s)?|m\.?s\.?|m\.?b\.?a\.?|ph\.?d|doctorate|associate(?:'s)?)\b"
ACRONYM = r"(\b[A-Z]{2,6}(?:\d{1,2})?\b)"

# Texts that try to steer a model, by kind.
INJECTION_PATTERNS = (
    ("instruction_override", r"ignore\s+(?:all\s+|any\s+|the\s+)?(?:previous|prior|above|earlier)\s+(?:instructions?|prompts?|rules?)"),
    ("instruction_override", r"disregard\s+(?:all\s+|the\s+)?(?:previous|prior|above)\s+\w+"),
    ("role_hijack", r"\byou\s+are\s+now\s+(?:a|an|the)\b"),
    ("role_hijack", r"^\s*(?:system|assistant|human)\s*:\s*"),
    ("fake_delimiter", r"</?(?:system|instructions?|prompt|resume_document|job_posting)[^>]*>"),
    ("scoring_manipulation", r"(?:rate|score|grade)\s+(?:this|the)\s+\w*\s*(?:as\s+)?(?:100|10/10|perfect|maximum|highest)"),
    ("scoring_manipulation", r"\b(?:must|always)\s+(?:recommend|approve|hire|pass)\s+(?:this|the)\s+candidate"),
    ("exfiltration", r"(?:reveal|print|repeat|output)\s+(?:your\s+)?(?:system\s+)?(?:prompt|instructions)"),
    ("new_instructions", r"\bnew\s+instructions?\s*:"),
    ("new_instructions", r"\bimportant\s*:\s*(?:you|the\s+assistant)\s+must\b"),
)

# Generic personal data.
EMAIL = r"[A-Za-z0-9._%+\-]+@[A-Za-z0-9.\-]+\.[A-Za-z]{2,24}"
LINK = r"https?://\S+|(?:www\.)\S+"
STREET = (r"(?i)\b\d{1,5}\s+[A-Z][A-Za-z]*(?:\s+[A-Z][A-Za-z]*){0,3}\s+"
          r"(?:street|st|avenue|ave|road|rd|boulevard|blvd|lane|ln|drive|dr|court|ct|way|place|pl)\b\.?")
PHONE = r"(?:\+?\d{1,3}[\s.\-]?)?(?:\(\d{2,4}\)[\s.\-]?)?\d{3,5}[\s.\-]?\d{3,4}(?:[\s.\-]?\d{2,4})?"
NUMBER = r"(?i)(\d[\d,.]*\s*(?:%|k\b|m\b|bn\b|x\b)?)"
# A number that says something.
METRIC = (r"(?i)(?:\$\s?\d[\d,.]*\s*(?:k|m|b|bn|mm)?|\d[\d,.]*\s*%|\b\d[\d,.]*\s*(?:x|times)\b|"
          r"\b\d[\d,.]*\s*(?:k|m|bn|million|billion|thousand)\b|"
          r"\b\d[\d,.]*\s*(?:users?|customers?|clients?|people|engineers?|reports?|hours?|days?|weeks?|months?|requests?|"
          r"transactions?|records?|tickets?|accounts?|projects?|countries|stores?|units?|ms|seconds?|qps|rps)\b|\b\d{2,}\b)")

# Dimensions, their labels, order and weights with and without a posting.
DIMENSIONS = (("match", "Job match"), ("ats", "ATS compatibility"), ("content", "Content quality"), ("structure", "Structure & completeness"))
WEIGHTS_WITH_JOB = {"match": 0.35, "ats": 0.25, "content": 0.25, "structure": 0.15}
WEIGHTS_WITHOUT_JOB = {"content": 0.40, "ats": 0.35, "structure": 0.25}
SEVERITY_RANK = {"critical": 0, "warning": 1, "info": 2, "ok": 3}
HISTOGRAM_BOUNDS = (0.01, 0.05, 0.1, 0.25, 0.5, 1.0, 2.5, 5.0, 10.0, 30.0)
