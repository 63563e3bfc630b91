"""Fixed values of the profile format.

Everything here must equal the established document format for results to match, so it
is stated as plain text: word lists, labels, enums, URLs and message texts.
"""

# --- fixed values: section headings (lower case, no trailing colon) -> section ---------
SECTION_HEADINGS = {
    "summary": "professional_summary",
    "professional summary": "professional_summary",
    "skills": "skills",
    "languages": "languages",
    "experience": "experience",
    "work experience": "experience",
    "employment history": "experience",
    "education": "education",
    "certifications": "certifications",
    "certification": "certifications",
    "projects": "projects",
    "achievements": "achievements",
}

# --- fixed values: `Label: value` lines that are read ----------------------------------
LABELS = (
    "Location",
    "Address",
    "Skills",
    "Languages",
    "Salary expectation",
    "Notice period",
    "Work authorization",
    "Interview availability",
)

# --- fixed values: fields a recruiter needs, in report order ---------------------------
REQUIRED_FIELDS = {
    "salary_expectation": "Salary expectation",
    "notice_period": "Notice period",
    "work_authorization": "Work authorization",
    "location": "Current location",
    "interview_availability": "Availability for interviews",
}
MISSING_REASON = "Not clearly present in the source resume."

# --- fixed values: disclosure rules and what they show ---------------------------------
SHOW = "show"
HIDE = "hide"
PENDING_CONFIRMATION = "pending_confirmation"
AVAILABLE_UPON_REQUEST = "available_upon_request"
DISPLAY_RULES = (SHOW, HIDE, PENDING_CONFIRMATION, AVAILABLE_UPON_REQUEST)
PENDING_TEXT = "To be confirmed"
ON_REQUEST_TEXT = "Available upon request"
BLIND_HEADING = "Candidate A"
NAMELESS_HEADING = "Candidate"

DETAIL_LABELS = {
    "salary_expectation": "Salary expectation",
    "notice_period": "Notice period",
    "work_authorization": "Work authorization",
    "interview_availability": "Interview availability",
}
CONTACT_LABELS = {
    "email": "Email",
    "phone": "Phone",
    "linkedin_url": "LinkedIn",
    "portfolio_url": "Portfolio",
}

# --- fixed values: messages to the candidate and the recruiter -------------------------
FOLLOWUP_COMPLETE = (
    "Thanks for sharing your CV. I have everything I need for now "
    "and will be in touch with next steps."
)
FOLLOWUP_MISSING = (
    "Thanks for sharing your CV. Could you please confirm the following details "
    "so I can prepare your profile accurately?"
)
SYSTEM_PROMPT = (
    "You extract recruiter candidate profiles from resumes.\n"
    "Return only valid JSON that matches the provided schema.\n"
    "Do not invent facts. If a fact is not clearly present, use null or an empty list.\n"
    "Missing recruiter follow-up fields should remain null; "
    "downstream validation will flag them.\n"
)
PROMPT_TASK = "Convert this resume into CandidateProfile JSON."
PROMPT_TEXT_MARK = "Resume text:"

# --- fixed values: templates and target formats ----------------------------------------
DEFAULT_TEMPLATE = "apex_standard"
RENDERER_KEYS = ("apex_standard", "classic_10554236")
CLASSIC_RENDERER = "classic_10554236"
SOURCE_TYPES = ("built_in", "docx", "pdf_reference")
BLUEPRINT_SECTIONS = (
    "header",
    "contact",
    "summary",
    "highlights",
    "languages",
    "experience",
    "education",
    "certifications",
    "additional_details",
    "skills",
)
TYPOGRAPHY_ROLES = ("normal", "title", "section", "entry_heading")

ACCEPTED_SUFFIXES = (".docx", ".pdf")
DOWNLOADABLE_FILES = (
    "candidate_profile.docx",
    "candidate_profile.pdf",
    "original_resume_preview.pdf",
    "target_format_reference.pdf",
    "target_format_template.docx",
)
STORED_FILE_BY_ROLE = {
    "docx_template": "target_format_template.docx",
    "pdf_reference": "target_format_reference.pdf",
}
NOTE_DOCX = (
    "DOCX target format stored. This upload does not match a registered MVP blueprint, "
    "so generation uses the selected controlled template."
)
NOTE_PDF = (
    "PDF target format stored as a visual reference only. "
    "The MVP does not reverse-engineer PDF templates."
)
NOTE_MATCH_HEAD = "Target format matched registered blueprint "
NOTE_MATCH_TAIL = ". Generation uses its manually encoded controlled DOCX renderer."

# --- fixed values: rejections of a target-format reference, in checking order ----------
REF_ID_MISMATCH = "target_format.artifact_id must match artifact_id."
REF_INVALID = "Invalid target format reference."
REF_NOT_UPLOADED = "The target format reference has not been uploaded for this artifact."
REF_METADATA_MISSING = "Target format metadata is missing for this artifact."
REF_METADATA_INVALID = "Target format metadata is invalid."
REF_METADATA_DIFFERS = "Target format metadata does not match the uploaded artifact."

# --- fixed values: file rejections ------------------------------------------------------
NOT_DOCX = "Only .docx files are supported in this milestone."
DOCX_CORRUPT = "The DOCX file appears to be corrupted or invalid."
DOCX_NO_CONTENT_TYPES = "The DOCX package is missing required metadata."

# --- fixed values: listing size ---------------------------------------------------------
LIST_DEFAULT = 50
LIST_MAX = 200

# --- fixed values: character classes (Unicode, as Python's str and re understand them) --
# Characters that `str.strip` removes.
WHITESPACE = (
    "\t\n\x0b\x0c\r\x1c\x1d\x1e\x1f \x85\xa0 "
    "           "
    "    　"
)
# The same set, digits and word characters as the inside of a regex class; Java and RE2
# both read these. Latin-1 characters stand one by one, which Java tests with one bit set.
SPACE = (
    r"\t\n\x0b\x0c\r\x1c\x1d\x1e\x1f\x20\x{85}\x{a0}\x{1680}\x{2000}-\x{200a}"
    r"\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}"
)
DIGIT = r"\p{Nd}"
WORD = r"\p{L}\p{N}_"
# Characters at which `str.splitlines` ends a line ("\r\n" counts as one end), those of
# them other than "\n", and the white space within a line.
LINE_END = r"\n\x0b\x0c\r\x1c\x1d\x1e\x{85}\x{2028}\x{2029}"
OTHER_LINE_ENDS = "\r\x0b\x0c\x1c\x1d\x1e\x85\u2028\u2029"
INLINE_SPACE = (
    r"\t\x1f\x20\x{a0}\x{1680}\x{2000}-\x{200a}\x{202f}\x{205f}\x{3000}"
)

# --- fixed values: first-match patterns -------------------------------------------------
EMAIL_PATTERN = rf"[{WORD}.+-]+@[{WORD}.-]+\.[A-Za-z]{{2,}}"
PHONE_PATTERN = rf"(?:\+?{DIGIT}[{DIGIT}{SPACE}().-]{{7,}}{DIGIT})"
LINKEDIN_PATTERN = rf"https?://(?:www\.)?linkedin\.com/[^{SPACE})]+"
PORTFOLIO_PATTERN = (
    rf"https?://(?:github\.com|[{WORD}.-]+\.[A-Za-z]{{2,}})/[^{SPACE})]+"
)
