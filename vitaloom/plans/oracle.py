"""Checking SQL for the registered queries, written for DuckDB.

Written apart from the Spark expressions: segmentation is a window over exploded lines
here, and sections, entries and maps are put together again by grouping.
"""

from __future__ import annotations

from vitaloom import constants as C
from vitaloom.plans import inputs as I
from vitaloom.plans.queries import prompt_schema_text

SQL: dict[str, str] = {}

SPACE, ENDS = C.SPACE, C.LINE_END
NL = "chr(10)"


def quote(text: str) -> str:
    return "'" + text.replace("'", "''") + "'"


WS = quote(C.WHITESPACE)


def strip(x: str) -> str:
    return f"trim({x}, {WS})"


def clean(x: str) -> str:
    return strip(f"regexp_replace({strip(x)}, '^[-•*][{SPACE}]*', '')")


def shown(x: str) -> str:
    """Trimmed, null when blank."""
    return f"nullif({strip(x)}, '')"


def txt(*values: str) -> str:
    parts = ", ".join(f"coalesce(CAST({v} AS VARCHAR), '-')" for v in values)
    return f"concat_ws('|', {parts})"


def joined(sep: str, *values: str) -> str:
    parts = ", ".join(shown(v) for v in values)
    return f"nullif(concat_ws('{sep}', {parts}), '')"


def lst(x: str) -> str:
    return f"coalesce(array_to_string({x}, ' ~ '), '')"


def cases(expr: str, table: dict[str, str]) -> str:
    whens = " ".join(f"WHEN {quote(k)} THEN {quote(v)}" for k, v in table.items())
    return f"CASE {expr} {whens} END"


def label(name: str) -> str:
    pattern = f"(?im)^{name}[{SPACE}]*:[{SPACE}]*(.+)$"
    hit = f"regexp_matches(text, '(?im)^{name}[{SPACE}]*:[{SPACE}]*.+$')"
    return f"CASE WHEN {hit} THEN {strip(f'regexp_extract(text, {quote(pattern)}, 1)')} END"


def first(pattern: str, column: str = "text") -> str:
    return f"nullif({strip(f'regexp_extract({column}, {quote("(?i)" + pattern)}, 0)')}, '')"


# --- common table expressions, in order; each may use the ones before it ------------------
CUSTOMERS = (
    f"SELECT {I.RESUME_KEY} AS doc_id,"
    f" concat_ws({I.RESUME_END}, {', '.join(I.RESUME_LINES)}) AS text"
    " FROM customer JOIN nation ON c_nationkey = n_nationkey"
)
DOCUMENTS = (
    f"SELECT {I.DOCUMENT_KEY} AS doc_id,"
    f" concat_ws(chr(10), {', '.join(I.DOCUMENT_LINES)}) AS text FROM documents"
)

def items_sql(section: str) -> str:
    """(doc_id, n, k, item): list items of a section."""
    return f"""
  SELECT doc_id, n, k, {clean('part')} AS item FROM (
    SELECT doc_id, n, unnest(regexp_split_to_array(line, '[,;|]')) AS part,
      generate_subscripts(regexp_split_to_array(line, '[,;|]'), 1) AS k
    FROM placed WHERE section = '{section}') WHERE {clean('part')} <> ''"""


POS = f"(?i)^(.+?)[{SPACE}]+at[{SPACE}]+(.+?)(?:[{SPACE}]*\\(([^)]+)\\))?$"
DASH = f"[{SPACE}]+(?:-|–|—|to)[{SPACE}]+"
EDU_DASH = f"[{SPACE}]+[–—-][{SPACE}]+"


def cut(x: str, pattern: str) -> tuple[str, str]:
    """Text before and after the first match of a separator; null after without one."""
    sep = f"regexp_extract({x}, {quote(pattern)}, 0)"
    has = f"regexp_matches({x}, {quote(pattern)})"
    at = f"strpos({x}, {sep})"
    head = f"CASE WHEN {has} THEN substr({x}, 1, {at} - 1) ELSE {x} END"
    tail = f"CASE WHEN {has} THEN substr({x}, {at} + length({sep})) END"
    return strip(head), strip(tail)


START, END = cut("dates", DASH)
DEGREE, SCHOOL = cut("undated", EDU_DASH)
COMMA = (
    "list_filter(list_transform(string_split({v}, ','), lambda x: " + strip("x") + "),"
    " lambda x: x <> '')"
)


def listed(value: str, items: str) -> str:
    own = COMMA.format(v=value)
    return f"CASE WHEN len({own}) > 0 THEN {own} ELSE coalesce({items}, []) END"


REQUIRED = list(C.REQUIRED_FIELDS.items())


def missing_list(value) -> str:
    """List of names of the missing fields, in order."""
    parts = ", ".join(
        f"CASE WHEN coalesce({strip(value(n))}, '') = '' THEN '{n}' END" for n, _ in REQUIRED
    )
    return f"list_filter([{parts}], lambda x: x IS NOT NULL)"


LABEL_OF = cases("x", C.REQUIRED_FIELDS)
RULE_FIELDS = sorted({*I.RULE_EXPRS, *C.REQUIRED_FIELDS})


def rule_pairs(rule) -> str:
    parts = ", ".join(
        f"CASE WHEN {rule(f)} IS NOT NULL THEN '{f}=' || {rule(f)} END" for f in RULE_FIELDS
    )
    return lst(f"list_sort(list_filter([{parts}], lambda x: x IS NOT NULL))")


def display(rule: str, value: str) -> str:
    return (
        f"CASE {rule} WHEN 'hide' THEN NULL WHEN 'pending_confirmation' THEN '{C.PENDING_TEXT}'"
        f" WHEN 'available_upon_request' THEN '{C.ON_REQUEST_TEXT}' ELSE {shown(value)} END"
    )


SHOWN_FIELDS = ("location", *C.CONTACT_LABELS, *C.DETAIL_LABELS)


def rule_of(field: str) -> str:
    return f"rule_{field}" if field in RULE_FIELDS else "CAST(NULL AS VARCHAR)"


def labelled(label_: str, value: str) -> str:
    return f"CASE WHEN {value} IS NOT NULL THEN '{label_}: ' || {value} END"


def contact_list(blind: str) -> str:
    lines = [labelled("Location", "d_location")]
    for field, label_ in C.CONTACT_LABELS.items():
        open_ = f"NOT {blind}"
        if field == "portfolio_url":
            open_ = f"(NOT {blind} OR coalesce(rule_portfolio_url = 'show', false))"
        lines.append(f"CASE WHEN {open_} THEN {labelled(label_, 'd_' + field)} END")
    return f"list_filter([{', '.join(lines)}], lambda x: x IS NOT NULL)"


def leaf(x: str) -> str:
    return f"CASE WHEN coalesce({strip(x)}, '') <> '' THEN 1 ELSE 0 END"


def leaf_list(x: str) -> str:
    return f"len(list_filter({x}, lambda x: {strip('x')} <> ''))"


SCALARS = (
    "full_name", "email", "phone", "location", "linkedin_url", "portfolio_url",
    "professional_summary", "salary_expectation", "notice_period", "work_authorization",
    "interview_availability",
)
EXP_TEXT = (
    "CASE WHEN x_title IS NULL AND x_description IS NULL THEN '' ELSE "
    + txt("x_company", "x_title", "NULL", "x_start", "x_end",
          "array_to_string(x_description, ' / ')")
    + " END"
)

CTES: dict[str, str] = {
    "src": f"{CUSTOMERS} UNION ALL {DOCUMENTS}",
    "raw": f"""
  SELECT doc_id, unnest(l) AS line, generate_subscripts(l, 1) AS n
  FROM (SELECT doc_id, regexp_split_to_array(text, '\\r\\n|[{ENDS}]') AS l FROM src)""",
    "lines": f"""
  SELECT doc_id, n, row_number() OVER (PARTITION BY doc_id ORDER BY n) - 1 AS line_no,
    {strip('line')} AS line FROM raw WHERE {strip('line')} <> ''""",
    "headed": f"""
  SELECT *, {cases("lower(rtrim(line, ':'))", C.SECTION_HEADINGS)} AS heading FROM lines""",
    "tagged": """
  SELECT *, last_value(heading IGNORE NULLS) OVER w AS section,
    count(heading) OVER w - 1 AS block_no
  FROM headed WINDOW w AS (PARTITION BY doc_id ORDER BY n ROWS UNBOUNDED PRECEDING)""",
    "placed": """
  SELECT doc_id, n, line, section, block_no,
    row_number() OVER (PARTITION BY doc_id, block_no ORDER BY n) - 1 AS pos,
    row_number() OVER (PARTITION BY doc_id, section ORDER BY n) - 1 AS section_pos
  FROM tagged WHERE heading IS NULL AND section IS NOT NULL""",
    "below_first": f"""
  SELECT doc_id, below AS line_below FROM (
    SELECT doc_id, n, below, row_number() OVER (PARTITION BY doc_id ORDER BY n) AS r FROM (
      SELECT doc_id, n, line, {shown('lead(line) OVER (PARTITION BY doc_id ORDER BY n)')} AS below
      FROM raw) WHERE lower({strip('line')}) = 'summary') WHERE r = 1""",
    "summaries": f"""
  SELECT doc_id, nullif(string_agg(item, ' ' ORDER BY n), '') AS summary FROM (
    SELECT doc_id, n, {clean('line')} AS item FROM placed
    WHERE section = 'professional_summary') WHERE item <> '' GROUP BY doc_id""",
    **{
        f"i_{s}": f"SELECT doc_id, list(item ORDER BY n, k) AS items FROM ({items_sql(s)})"
        " GROUP BY doc_id"
        for s in ("skills", "languages", "projects", "achievements")
    },
    "exp_lines": f"""
  SELECT doc_id, section_pos, n, {clean('line')} AS line FROM placed WHERE section = 'experience'""",
    "exp_head": f"""
  SELECT doc_id, line, regexp_matches(line, {quote(POS)}) AS shaped,
    CASE WHEN regexp_matches(line, {quote(POS)}) THEN
      nullif(regexp_extract(line, {quote(POS)}, 3), '') END AS dates
  FROM exp_lines WHERE section_pos = 0""",
    "exp_rest": """
  SELECT doc_id, list(line ORDER BY n) AS lines FROM exp_lines
  WHERE section_pos > 0 AND line <> '' GROUP BY doc_id""",
    "exp": f"""
  SELECT h.doc_id,
    CASE WHEN shaped THEN {strip(f'regexp_extract(line, {quote(POS)}, 1)')}
      ELSE nullif(line, '') END AS x_title,
    CASE WHEN shaped THEN {strip(f'regexp_extract(line, {quote(POS)}, 2)')} END AS x_company,
    CASE WHEN dates IS NULL THEN NULL WHEN NOT regexp_matches(dates, {quote(DASH)})
      THEN {START} ELSE nullif({START}, '') END AS x_start,
    nullif({END}, '') AS x_end,
    list_concat(list_concat(coalesce(r.lines, []),
      list_transform(coalesce(p.items, []), lambda x: 'Project: ' || x)),
      list_transform(coalesce(a.items, []), lambda x: 'Achievement: ' || x)) AS x_description
  FROM exp_head h LEFT JOIN exp_rest r USING (doc_id) LEFT JOIN i_projects p USING (doc_id)
    LEFT JOIN i_achievements a USING (doc_id)""",
    "edu_lines": f"""
  SELECT doc_id, n, value,
    {strip(f"regexp_replace(value, '[{SPACE}]*\\([^)]+\\)[{SPACE}]*$', '')")} AS undated,
    {strip(f"regexp_extract(value, '\\(([^)]+)\\)[{SPACE}]*$', 1)")} AS inner_date,
    regexp_matches(value, '\\(([^)]+)\\)[{SPACE}]*$') AS dated
  FROM (SELECT doc_id, n, {clean('line')} AS value FROM placed WHERE section = 'education')
  WHERE value <> ''""",
    "edu": f"""
  SELECT doc_id, n, row_number() OVER (PARTITION BY doc_id ORDER BY n) - 1 AS pos,
    {SCHOOL} AS institution, nullif({DEGREE}, '') AS degree,
    CASE WHEN dated THEN inner_date END AS end_date
  FROM edu_lines""",
    "edu_list": f"""
  SELECT doc_id, list({txt('institution', 'degree', 'NULL', 'NULL', 'end_date')} ORDER BY n) AS l,
    list({txt('nullif(institution, chr(0))', 'degree', 'NULL', shown('end_date'))} ORDER BY n) AS r,
    sum({leaf('institution')} + {leaf('degree')} + {leaf('end_date')}) AS leaves
  FROM edu GROUP BY doc_id""",
    "certs": f"""
  SELECT doc_id, n, row_number() OVER (PARTITION BY doc_id ORDER BY n) - 1 AS pos, name
  FROM (SELECT doc_id, n, {clean('line')} AS name FROM placed WHERE section = 'certifications')
  WHERE name <> ''""",
    "cert_list": "SELECT doc_id, list(name ORDER BY n) AS l FROM certs GROUP BY doc_id",
    "firsts": "SELECT doc_id, line AS full_name FROM lines WHERE line_no = 0",
    "labels_of": f"""
  SELECT doc_id, text, {', '.join(
        f"{label(n)} AS l_{n.lower().replace(' ', '_')}" for n in C.LABELS
    )} FROM src""",
    "prof": f"""
  SELECT t.doc_id, f.full_name, {first(C.EMAIL_PATTERN)} AS email,
    {first(C.PHONE_PATTERN)} AS phone,
    CASE WHEN l_location <> '' THEN l_location ELSE l_address END AS location,
    {first(C.LINKEDIN_PATTERN)} AS linkedin_url, {first(C.PORTFOLIO_PATTERN)} AS portfolio_url,
    coalesce(s.summary, b.line_below) AS professional_summary,
    {listed('l_skills', 'sk.items')} AS skills,
    {listed('l_languages', 'la.items')} AS languages,
    l_salary_expectation AS salary_expectation, l_notice_period AS notice_period,
    l_work_authorization AS work_authorization,
    l_interview_availability AS interview_availability,
    e.x_title, e.x_company, e.x_start, e.x_end, e.x_description,
    coalesce(ed.l, []) AS education, coalesce(ed.r, []) AS education_shown,
    coalesce(ed.leaves, 0) AS education_leaves, coalesce(c.l, []) AS certifications
  FROM labels_of t LEFT JOIN firsts f USING (doc_id) LEFT JOIN summaries s USING (doc_id)
    LEFT JOIN below_first b USING (doc_id) LEFT JOIN i_skills sk USING (doc_id)
    LEFT JOIN i_languages la USING (doc_id) LEFT JOIN exp e USING (doc_id)
    LEFT JOIN edu_list ed USING (doc_id) LEFT JOIN cert_list c USING (doc_id)""",
    "prof_m": f"SELECT *, {missing_list(lambda n: n)} AS missing FROM prof",
    "seeded": f"SELECT *, {I.RULE_SEED} AS h FROM prof_m",
    "ruled": "SELECT *, h % 2 = 1 AS blind, "
    + ", ".join(
        (f"coalesce({I.RULE_EXPRS[f]}, " if f in I.RULE_EXPRS else "coalesce(NULL, ")
        + f"CASE WHEN list_contains(missing, '{f}') THEN 'pending_confirmation' END) AS rule_{f}"
        for f in RULE_FIELDS
    )
    + " FROM seeded",
    "displayed": "SELECT *, "
    + ", ".join(f"{display(rule_of(f), f)} AS d_{f}" for f in SHOWN_FIELDS)
    + " FROM ruled",
    "ctx": f"""
  SELECT *, CASE WHEN blind THEN '{C.BLIND_HEADING}'
      ELSE coalesce({shown('full_name')}, '{C.NAMELESS_HEADING}') END AS candidate_heading,
    {joined(' | ', 'x_title', 'd_location')} AS candidate_subheading,
    {contact_list('blind')} AS contact_lines,
    {shown('professional_summary')} AS summary_shown,
    list_filter(skills, lambda x: {strip('x')} <> '') AS skills_shown,
    {joined(' - ', 'x_start', 'x_end')} AS x_dates,
    list_filter(coalesce(x_description, []), lambda x: {strip('x')} <> '') AS x_bullets,
    list_filter([{', '.join(
        labelled(v, 'd_' + k) for k, v in C.DETAIL_LABELS.items()
    )}], lambda x: x IS NOT NULL) AS details
  FROM displayed""",
}


def with_ctes(body: str, upto: str = "prof", extra: dict[str, str] | None = None) -> str:
    parts = []
    for name, sql in CTES.items():
        parts.append(f"{name} AS ({sql})")
        if name == upto:
            break
    parts += [f"{name} AS ({sql})" for name, sql in (extra or {}).items()]
    return "WITH " + ",\n".join(parts) + "\n" + body


MISSING_TEXT = lst(
    "list_transform(missing, lambda x: x || '|' || " + LABEL_OF + f" || '|{C.MISSING_REASON}')"
)
PENDING_TEXT = lst(
    "list_transform(list_sort(missing), lambda x: x || '=pending_confirmation')"
)
FLAT_PROFILE = f"""full_name, email, phone, location, linkedin_url, portfolio_url,
  professional_summary, {lst('skills')} AS skills,
  {lst("list_transform(languages, lambda x: x || '|-')")} AS languages,
  {EXP_TEXT} AS work_experience, {lst('education')} AS education,
  {lst("list_transform(certifications, lambda x: x || '|-|-')")} AS certifications,
  salary_expectation, notice_period, work_authorization, interview_availability,
  {MISSING_TEXT} AS missing_fields"""

# --- sources and validation ----------------------------------------------------------------
SQL["scan_documents"] = "SELECT doc_id, lang, source, text FROM documents"
SQL["profile_json"] = with_ctes(
    f"SELECT doc_id, CAST(18 AS BIGINT) AS keys_written, {FLAT_PROFILE},"
    f" {PENDING_TEXT} AS client_display_rules FROM prof_m",
    "prof_m",
)
BLANKED = (
    "SELECT doc_id, lang, text FROM documents UNION ALL SELECT -1 - doc_id, lang,"
    " concat(' ', chr(10), '　') FROM documents WHERE doc_id % 9 = 4"
)
SQL["quarantine_empty"] = (
    f"SELECT doc_id, 'no extractable text' AS reason FROM ({BLANKED}) WHERE {strip('text')} = ''"
)
PAYLOADS = (
    f"SELECT {I.RESUME_KEY} AS doc_id, c_custkey, {I.PAYLOAD_TEXT} AS raw FROM customer"
    " JOIN nation ON c_nationkey = n_nationkey"
)
PARSED = """SELECT *, CASE WHEN json_valid(raw) THEN raw WHEN json_valid(span) THEN span END AS j
  FROM (SELECT *, regexp_extract(raw, '(?s)\\{.*\\}', 0) AS span FROM payloads)"""
PARSE_REASON = """CASE WHEN j IS NOT NULL THEN NULL WHEN span = ''
  THEN 'response did not contain JSON' ELSE 'response held malformed JSON' END"""
SQL["parse_llm_json"] = f"""WITH payloads AS ({PAYLOADS}), parsed AS ({PARSED})
SELECT doc_id, json_extract_string(j, '$.full_name') AS full_name,
  json_extract_string(j, '$.location') AS location, {PARSE_REASON} AS reason FROM parsed"""

PROFILE_KEYS = (
    *SCALARS, "skills", "languages", "work_experience", "education", "certifications",
    "missing_fields", "client_display_rules",
)


def extra_keys(path: str, allowed: tuple[str, ...], prefix: str) -> str:
    keys = f"coalesce(json_keys(j, '{path}'), [])"
    names = ", ".join(quote(k) for k in allowed)
    return (
        f"list_transform(list_sort(list_filter({keys}, lambda x: x NOT IN ({names}))),"
        f" lambda x: '{prefix}' || x || ': unknown key')"
    )


def when(condition: str, reason: str) -> str:
    return f"CASE WHEN {condition} THEN ['{reason}'] ELSE [] END"


def jtype(path: str) -> str:
    return f"json_type(j, '{path}')"


VIOLATIONS = [
    extra_keys("$", PROFILE_KEYS, ""),
    when(f"{jtype('$.email')} NOT IN ('VARCHAR', 'NULL')", "email: not a string"),
    when(
        f"{jtype('$.portfolio_url')} = 'VARCHAR' AND NOT"
        " regexp_matches(json_extract_string(j, '$.portfolio_url'), '^https?://[^/]+')",
        "portfolio_url: not an http(s) URL",
    ),
    when(f"{jtype('$.skills')} <> 'ARRAY'", "skills: not a list"),
    when(f"{jtype('$.skills[1]')} = 'NULL'", "skills.1: not a string"),
    extra_keys("$.languages[0]", ("name", "proficiency"), "languages.0."),
    extra_keys("$.languages[1]", ("name", "proficiency"), "languages.1."),
    when(
        f"{jtype('$.languages[1]')} = 'OBJECT' AND {jtype('$.languages[1].name')} IS NULL",
        "languages.1.name: required",
    ),
    extra_keys(
        "$.work_experience[0]",
        ("company", "title", "location", "start_date", "end_date", "description"),
        "work_experience.0.",
    ),
    when(
        "json_extract_string(j, '$.client_display_rules.email') NOT IN ("
        + ", ".join(quote(r) for r in C.DISPLAY_RULES) + ")",
        "client_display_rules.email: not an allowed value",
    ),
]


def json_list(path: str) -> str:
    return f"CAST(json_extract(j, '{path}') AS VARCHAR[])"


SQL["strict_validate"] = f"""WITH payloads AS ({PAYLOADS}), parsed AS ({PARSED}),
checked AS (SELECT *, CASE WHEN j IS NULL THEN {PARSE_REASON}
  WHEN json_type(j) <> 'OBJECT' THEN 'payload: not an object'
  ELSE nullif(array_to_string(flatten([{', '.join(VIOLATIONS)}]), '; '), '') END AS reason
  FROM parsed),
fine AS (SELECT doc_id, reason, CASE WHEN reason IS NULL THEN j END AS j FROM checked)
SELECT doc_id, reason, {strip("json_extract_string(j, '$.full_name')")} AS full_name,
  {strip("json_extract_string(j, '$.email')")} AS email,
  {strip("json_extract_string(j, '$.portfolio_url')")} AS portfolio_url,
  array_to_string(list_transform({json_list('$.skills')}, lambda x: {strip('x')}), ' ~ ') AS skills,
  CASE WHEN j IS NOT NULL THEN array_to_string(list_transform(
    json_extract_string(j, '$.languages[*].name'), lambda x: x || '|-'), ' ~ ') END AS languages,
  CASE WHEN j IS NOT NULL THEN concat('Acme|-|-|-|-|', 'Built / ') END AS work_experience,
  CASE WHEN j IS NOT NULL THEN array_to_string(list_sort(list_concat(
    ['email=' || json_extract_string(j, '$.client_display_rules.email')],
    ['interview_availability=pending_confirmation', 'notice_period=pending_confirmation',
     'salary_expectation=pending_confirmation', 'work_authorization=pending_confirmation'])),
    ' ~ ') END AS client_display_rules
FROM fine"""
SQL["safe_artifact_id"] = """
SELECT page_id, regexp_full_match(CASE page_id % 6 WHEN 0 THEN url
  WHEN 1 THEN concat('artifact_', page_id) WHEN 2 THEN concat('Größe-', page_id) WHEN 3 THEN ''
  WHEN 4 THEN concat('a', page_id, chr(10)) ELSE concat('a b', page_id) END,
  '[\\p{L}\\p{N}_-]+') AS is_safe FROM pages"""
FILE_NAMES = """SELECT o_orderkey, CASE o_orderkey % 8 WHEN 0 THEN 'candidate_profile.docx'
  WHEN 1 THEN 'candidate_profile.pdf' WHEN 2 THEN concat('cv ', o_custkey, '.PDF')
  WHEN 3 THEN 'candidate_profile.json' WHEN 4 THEN 'target_format_reference.pdf'
  WHEN 5 THEN concat('cv.', o_custkey, '.DocX') WHEN 6 THEN '.docx'
  ELSE concat('notes', o_custkey) END AS filename FROM orders"""
SQL["downloadable_filter"] = (
    f"SELECT * FROM ({FILE_NAMES}) WHERE filename IN ("
    + ", ".join(quote(f) for f in C.DOWNLOADABLE_FILES) + ")"
)
SQL["accepted_upload"] = f"""SELECT o_orderkey, suffix, suffix IN ('.docx', '.pdf') AS is_accepted
FROM (SELECT o_orderkey, CASE WHEN strpos(filename, '.') > 1
  THEN lower('.' || list_last(string_split(filename, '.'))) ELSE '' END AS suffix
  FROM ({FILE_NAMES}))"""

# --- segmentation and fields -----------------------------------------------------------------
ON_DOCUMENTS = {
    "docs_raw": f"""
  SELECT doc_id, unnest(l) AS line, generate_subscripts(l, 1) AS n
  FROM (SELECT doc_id, regexp_split_to_array(text, '\\r\\n|[{ENDS}]') AS l FROM documents)""",
    "docs_lines": f"""
  SELECT doc_id, row_number() OVER (PARTITION BY doc_id ORDER BY n) - 1 AS line_no,
    {strip('line')} AS line FROM docs_raw WHERE {strip('line')} <> ''""",
}
DOCS_WITH = "WITH " + ", ".join(f"{n} AS ({s})" for n, s in ON_DOCUMENTS.items())
SQL["doc_lines"] = f"{DOCS_WITH} SELECT * FROM docs_lines"
SQL["first_line"] = f"""{DOCS_WITH} SELECT d.doc_id, l.line AS full_name
FROM documents d LEFT JOIN docs_lines l ON d.doc_id = l.doc_id AND line_no = 0"""
SQL["contact_email"] = f"SELECT doc_id, {first(C.EMAIL_PATTERN)} AS email FROM documents"
SQL["contact_phone"] = f"SELECT doc_id, {first(C.PHONE_PATTERN)} AS phone FROM documents"
SQL["heading_lines"] = with_ctes(
    "SELECT doc_id, line_no, line, heading FROM headed WHERE heading IS NOT NULL", "headed"
)
SQL["doc_sections"] = with_ctes(
    "SELECT doc_id, block_no, section, pos, line FROM placed", "placed"
)
SQL["contact_urls"] = with_ctes(
    f"""SELECT doc_id, {first(C.EMAIL_PATTERN)} AS email, {first(C.PHONE_PATTERN)} AS phone,
  {first(C.LINKEDIN_PATTERN)} AS linkedin_url, {first(C.PORTFOLIO_PATTERN)} AS portfolio_url
FROM src""",
    "src",
)
SQL["label_values"] = with_ctes(
    "SELECT doc_id, location, salary_expectation, notice_period, work_authorization,"
    " interview_availability FROM prof"
)
SQL["summary_fallback"] = with_ctes(
    "SELECT doc_id, line_below FROM src LEFT JOIN below_first USING (doc_id)", "below_first"
)
SQL["summary_text"] = with_ctes("SELECT doc_id, professional_summary FROM prof")
SQL["skills_list"] = with_ctes(
    "SELECT doc_id, generate_subscripts(skills, 1) - 1 AS pos, unnest(skills) AS skill FROM prof"
)
SQL["clean_items"] = with_ctes(
    f"SELECT doc_id, line_no, {clean('line')} AS item FROM lines", "lines"
)
SQL["experience_entries"] = with_ctes(
    f"""SELECT doc_id, x_company AS company, x_title AS title, CAST(NULL AS VARCHAR) AS location,
  x_start AS start_date, x_end AS end_date, {lst('x_description')} AS description FROM exp""",
    "exp",
)
SQL["date_ranges"] = with_ctes(
    f"""SELECT doc_id, line_no,
  CASE WHEN regexp_matches(dates, {quote(DASH)}) THEN nullif({START}, '') ELSE {START} END
    AS start_date, nullif({END}, '') AS end_date
FROM (SELECT doc_id, line_no, unnest(regexp_extract_all(line, '\\(([^)]+)\\)', 1)) AS dates
  FROM lines)""",
    "lines",
)
SQL["education_entries"] = with_ctes(
    """SELECT doc_id, pos, institution, degree, CAST(NULL AS VARCHAR) AS field_of_study,
  CAST(NULL AS VARCHAR) AS start_date, end_date FROM edu""",
    "edu",
)
SQL["certification_entries"] = with_ctes(
    """SELECT doc_id, pos, name, CAST(NULL AS VARCHAR) AS issuer, CAST(NULL AS VARCHAR) AS date
FROM certs""",
    "certs",
)
SQL["language_entries"] = with_ctes(
    """SELECT doc_id, generate_subscripts(languages, 1) - 1 AS pos, unnest(languages) AS name,
  CAST(NULL AS VARCHAR) AS proficiency FROM prof"""
)
SQL["profiles"] = with_ctes(
    f"SELECT doc_id, {FLAT_PROFILE}, {PENDING_TEXT} AS client_display_rules FROM prof_m",
    "prof_m",
)
SQL["prompts"] = f"""
SELECT doc_id, concat('{C.PROMPT_TASK}', {NL}, 'Schema:', {NL}, {quote(prompt_schema_text())}, {NL},
  CASE WHEN lang = 'en' THEN concat({NL}, 'Optional job description:', {NL}, 'Writer for ', source,
    {NL}) ELSE '' END, {NL}, '{C.PROMPT_TEXT_MARK}', {NL}, text) AS prompt,
  concat({NL}, text) AS text_part FROM documents"""

# --- profile operators -----------------------------------------------------------------------
SQL["missing_fields"] = with_ctes(
    f"""SELECT doc_id, pos, x AS field_name, {LABEL_OF} AS label,
  '{C.MISSING_REASON}' AS reason FROM (
  SELECT doc_id, generate_subscripts(missing, 1) - 1 AS pos, unnest(missing) AS x FROM prof_m)""",
    "prof_m",
)
SQL["default_rules"] = with_ctes(f"SELECT doc_id, {PENDING_TEXT} AS rules FROM prof_m", "prof_m")
SQL["merged_rules"] = with_ctes(
    f"SELECT doc_id, {rule_pairs(lambda f: 'rule_' + f)} AS rules FROM ruled", "ruled"
)
SQL["dedup_skills"] = with_ctes(
    f"""SELECT doc_id, {lst('''list_filter(skills,
  lambda x, i: x <> '' AND list_position(skills, x) = i)''')} AS skills FROM prof"""
)
SQL["ledger"] = with_ctes(
    f"""SELECT doc_id, CAST(n AS BIGINT) AS extracted, CAST(n AS BIGINT) AS placed,
  CAST(len(missing) AS BIGINT) AS needs_review FROM (SELECT *,
  {' + '.join(leaf(s) for s in SCALARS)} + {leaf_list('skills')} + {leaf_list('languages')}
  + {leaf('x_title')} + {leaf('x_company')} + {leaf('x_start')} + {leaf('x_end')}
  + {leaf_list('coalesce(x_description, [])')} + education_leaves
  + {leaf_list('certifications')} AS n FROM prof_m)""",
    "prof_m",
)
DASHED = f"array_to_string(list_transform(missing, lambda x: '- ' || {LABEL_OF}), {NL})"
SQL["followup_messages"] = with_ctes(
    f"""SELECT doc_id, concat('Hi ', coalesce(nullif(full_name, ''), 'there'), ',', {NL}, {NL},
  CASE WHEN len(missing) = 0 THEN {quote(C.FOLLOWUP_COMPLETE)}
  ELSE concat({quote(C.FOLLOWUP_MISSING)}, {NL}, {NL}, {DASHED}) END,
  {NL}, {NL}, 'Best,', {NL}) AS message FROM prof_m""",
    "prof_m",
)
SQL["internal_summary"] = with_ctes(
    f"""SELECT doc_id, concat('Candidate: ', coalesce(nullif(full_name, ''), 'Unknown'), {NL}, {NL},
  'Missing information:', {NL}, CASE WHEN len(missing) = 0 THEN '- None' ELSE {DASHED} END,
  {NL}) AS summary FROM prof_m""",
    "prof_m",
)
SQL["missing_labels"] = with_ctes(
    f"""SELECT doc_id, CAST(to_json(l) AS VARCHAR) AS json, {lst('l')} AS labels,
  CAST(len(l) AS BIGINT) AS needs_review_count
FROM (SELECT doc_id, list_transform(missing, lambda x: {LABEL_OF}) AS l FROM prof_m)""",
    "prof_m",
)
EDITS = f"""SELECT concat('c', o_custkey) AS artifact_id, {I.EDIT_PATH} AS path,
  {I.EDIT_VALUE} AS value, o_orderkey AS seq FROM orders"""
BUFFER = {
    "edits": EDITS,
    "since": """SELECT *, max(CASE WHEN value = '' THEN seq END)
    OVER (PARTITION BY artifact_id, path) AS cleared FROM edits""",
    "buffer": """SELECT artifact_id, path, arg_max(value, seq) AS value, min(seq) AS position
    FROM since WHERE cleared IS NULL OR seq > cleared GROUP BY artifact_id, path""",
}
BUFFER_WITH = ", ".join(f"{n} AS ({s})" for n, s in BUFFER.items())
SQL["edit_buffer"] = f"WITH {BUFFER_WITH} SELECT artifact_id, path, value, position FROM buffer"
CUSTOMER_ROWS = {**BUFFER, "mine": "SELECT * FROM ruled WHERE doc_id LIKE 'c%'"}
OPEN = f"""SELECT m.artifact_id, m.field_name, {LABEL_OF.replace('CASE x', 'CASE field_name')} AS label
  FROM (SELECT doc_id AS artifact_id, unnest(missing) AS field_name FROM mine) m
  WHERE NOT EXISTS (SELECT 1 FROM buffer b WHERE b.artifact_id = m.artifact_id
    AND b.path = m.field_name AND {strip('b.value')} <> '')"""
SQL["unresolved_missing"] = with_ctes(OPEN, "ruled", CUSTOMER_ROWS)
SQL["export_gate"] = with_ctes(
    """SELECT doc_id AS artifact_id, count(o.field_name) AS remaining,
  count(o.field_name) > 0 AS needs_confirmation
FROM mine LEFT JOIN open o ON o.artifact_id = doc_id GROUP BY doc_id""",
    "ruled",
    {**CUSTOMER_ROWS, "open": OPEN},
)
APPLIES = """CASE WHEN path IN ('location', 'salary_expectation', 'notice_period', 'skills',
    'work_authorization', 'interview_availability', 'email') THEN true
  WHEN path IN ('current_title', 'work_experience.0.title') THEN x_description IS NOT NULL
  WHEN path = 'skills.1' THEN len(skills) > 1
  WHEN path = 'work_experience.0.description.1' THEN coalesce(len(x_description), 0) > 1
  WHEN path LIKE 'education.0.%' THEN len(education) > 0
  WHEN path = 'languages.0.name' THEN len(languages) > 0
  WHEN path = 'languages.7.name' THEN len(languages) > 7
  WHEN path = 'certifications.0.issuer' THEN len(certifications) > 0 ELSE false END"""
SQL["unapplied_edits"] = with_ctes(
    f"""SELECT b.artifact_id, b.path, b.value FROM buffer b JOIN mine m ON m.doc_id = b.artifact_id
WHERE NOT ({APPLIES})""",
    "ruled",
    CUSTOMER_ROWS,
)
EDITED_PATHS = {
    "e_location": "location",
    "e_salary": "salary_expectation",
    "e_notice": "notice_period",
    "e_skills": "skills",
    "e_skill1": "skills.1",
    "e_current": "current_title",
    "e_title": "work_experience.0.title",
    "e_bullet": "work_experience.0.description.1",
    "e_degree": "education.0.degree",
    "e_language": "languages.0.name",
    "e_issuer": "certifications.0.issuer",
    "e_permit": "work_authorization",
    "e_interview": "interview_availability",
    "e_email": "email",
    "e_school_end": "education.0.end_date",
}
PIVOT = "SELECT artifact_id, " + ", ".join(
    f"max(value) FILTER (WHERE path = '{p}') AS {a},"
    f" max(position) FILTER (WHERE path = '{p}') AS {a}_at"
    for a, p in EDITED_PATHS.items()
) + " FROM buffer GROUP BY artifact_id"
NEW_SKILLS = COMMA.format(v="replace(e_skills, chr(10), ',')")
EDITED_RULES = {
    "location": "e_location",
    "salary_expectation": "e_salary",
    "notice_period": "e_notice",
    "work_authorization": "e_permit",
    "interview_availability": "e_interview",
    "email": "e_email",
}


def edited_rule(field: str) -> str:
    if field == "skills":
        touched = "(e_skills IS NOT NULL OR e_skill1 IS NOT NULL)"
    elif field in EDITED_RULES:
        touched = f"{EDITED_RULES[field]} IS NOT NULL"
    else:
        touched = "false"
    return f"CASE WHEN rule_{field} = 'pending_confirmation' AND {touched} THEN NULL ELSE rule_{field} END"


EDU_FIRST = "string_split(education[1], '|')"
EDITED_EDU = f"""CASE WHEN len(education) = 0 THEN '' ELSE array_to_string(list_concat([concat_ws('|',
    {EDU_FIRST}[1], coalesce(e_degree, {EDU_FIRST}[2]), {EDU_FIRST}[3], {EDU_FIRST}[4],
    coalesce(e_school_end, {EDU_FIRST}[5]))], education[2:]), ' ~ ') END"""
NEW_TITLE = """CASE WHEN e_current IS NULL THEN coalesce(e_title, x_title)
    WHEN e_title IS NULL OR e_current_at > e_title_at THEN e_current ELSE e_title END"""
SQL["apply_edits"] = with_ctes(
    f"""SELECT doc_id AS artifact_id, full_name, coalesce(e_email, email) AS email, phone,
  coalesce(e_location, location) AS location, linkedin_url, portfolio_url, professional_summary,
  {lst('''list_transform(base, lambda x, i: CASE WHEN i = 2 AND e_skill1 IS NOT NULL
    AND len(skills) > 1 AND (e_skills IS NULL OR e_skill1_at > e_skills_at)
    THEN e_skill1 ELSE x END)''')} AS skills,
  {lst('''list_transform(languages, lambda x, i:
    CASE WHEN i = 1 THEN coalesce(e_language, x) ELSE x END || '|-')''')} AS languages,
  CASE WHEN x_description IS NULL THEN '' ELSE {txt('x_company', NEW_TITLE, 'NULL', 'x_start',
    'x_end', '''array_to_string(list_transform(x_description, lambda x, i:
      CASE WHEN i = 2 THEN coalesce(e_bullet, x) ELSE x END), ' / ')''')} END AS work_experience,
  {EDITED_EDU} AS education,
  {lst('''list_transform(certifications, lambda x, i: x || '|' ||
    CASE WHEN i = 1 THEN coalesce(e_issuer, '-') ELSE '-' END || '|-')''')} AS certifications,
  coalesce(e_salary, salary_expectation) AS salary_expectation,
  coalesce(e_notice, notice_period) AS notice_period,
  coalesce(e_permit, work_authorization) AS work_authorization,
  coalesce(e_interview, interview_availability) AS interview_availability,
  {MISSING_TEXT} AS missing_fields,
  {rule_pairs(edited_rule)} AS client_display_rules
FROM (SELECT *, CASE WHEN e_skills IS NULL THEN skills ELSE {NEW_SKILLS} END AS base
  FROM mine LEFT JOIN pivoted ON artifact_id = doc_id)""",
    "ruled",
    {**CUSTOMER_ROWS, "pivoted": PIVOT},
)

# --- rendering -------------------------------------------------------------------------------
SQL["field_display"] = with_ctes(
    "SELECT doc_id, " + ", ".join(f"d_{f} AS {f}" for f in SHOWN_FIELDS) + " FROM displayed",
    "displayed",
)
SQL["headings"] = with_ctes("SELECT doc_id, candidate_heading, candidate_subheading FROM ctx", "ctx")
SQL["contact_lines"] = with_ctes(
    f"SELECT doc_id, {lst(contact_list('false'))} AS lines FROM displayed", "displayed"
)
SQL["blind_contact"] = with_ctes(
    f"SELECT doc_id, {lst(contact_list('true'))} AS lines FROM displayed", "displayed"
)
SQL["language_lines"] = with_ctes(f"SELECT doc_id, {lst('languages')} AS languages FROM ctx", "ctx")
SQL["render_experience"] = with_ctes(
    f"""SELECT doc_id, {shown('x_company')} AS company, {shown('x_title')} AS title,
  CAST(NULL AS VARCHAR) AS location, x_dates AS date_range, {lst('x_bullets')} AS description
FROM ctx WHERE x_description IS NOT NULL""",
    "ctx",
)
SQL["render_education"] = with_ctes(
    f"""SELECT doc_id, pos, {shown('institution')} AS institution, {shown('degree')} AS degree,
  CAST(NULL AS VARCHAR) AS field_of_study, {shown('end_date')} AS date_range FROM edu""",
    "edu",
)
SQL["render_certs"] = with_ctes(
    f"SELECT doc_id, {lst('certifications')} AS certifications FROM ctx", "ctx"
)
SQL["additional_details"] = with_ctes(
    """SELECT doc_id, pos, substr(d, 1, strpos(d, ': ') - 1) AS label,
  substr(d, strpos(d, ': ') + 2) AS value FROM (
  SELECT doc_id, generate_subscripts(details, 1) - 1 AS pos, unnest(details) AS d FROM ctx)""",
    "ctx",
)
RENDERED_EXP = (
    "CASE WHEN x_description IS NULL THEN '' ELSE "
    + txt("x_company", "x_title", "NULL", "x_dates", "array_to_string(x_bullets, ' / ')")
    + " END"
)
SQL["render_context"] = with_ctes(
    f"""SELECT doc_id, '{C.DEFAULT_TEMPLATE}' AS template_name, candidate_heading,
  candidate_subheading, {lst('contact_lines')} AS contact_lines,
  summary_shown AS professional_summary, {lst('skills_shown')} AS skills,
  {lst('languages')} AS languages, {RENDERED_EXP} AS work_experience,
  {lst('education_shown')} AS education, {lst('certifications')} AS certifications,
  {lst("list_transform(details, lambda x: replace(x, ': ', '|'))")} AS additional_details,
  blind AS blind_profile FROM ctx""",
    "ctx",
)

# --- layout ----------------------------------------------------------------------------------
EDU_ROWS = """SELECT doc_id, list(struct_pack(institution := institution, degree := degree,
  end_date := end_date) ORDER BY n) AS schools FROM edu GROUP BY doc_id"""


def block(order: int | str, section: str, parts: list[tuple[str, str, str]], gate: str = "") -> str:
    """Rows (doc_id, sec, part, i, section, kind, text) of one section; texts is a list."""
    where = f" WHERE {gate}" if gate else ""
    selects = [
        f"SELECT doc_id, CAST({order} AS BIGINT) AS sec, {i} AS part,"
        f" generate_subscripts({texts}, 1) AS i, '{section}' AS section, '{kind}' AS kind,"
        f" unnest({texts}) AS text FROM laid{where}"
        for i, (kind, texts, _) in enumerate(parts)
    ]
    return " UNION ALL ".join(selects)


def one(text: str) -> str:
    return f"CASE WHEN {text} IS NULL THEN [] ELSE [{text}] END"


def section_blocks(
    exp_title: str, edu_text: str, bullets: str, titles: dict[str, str], order: list[str],
    header: list[tuple[str, str, str]], cells: str, asked: bool = False,
) -> str:
    """Blocks of the sections in this order or, if `asked`, in that of each row's section_order."""
    kinds = {"skills": bullets, "languages": bullets, "certifications": bullets}
    contents = {
        "contact": [("paragraph", "contact_lines", "")],
        "summary": [("paragraph", one("summary_shown"), "")],
        "skills": [(kinds["skills"], "skills_shown" if bullets == "bullet" else
                    "CASE WHEN len(skills_shown) > 0"
                    " THEN [array_to_string(skills_shown, '; ') || '.'] ELSE [] END", "")],
        "highlights": [("cell", cells, "")],
        "languages": [(kinds["languages"], "languages", "")],
        "experience": [
            ("entry_heading", one(exp_title), ""),
            ("bullet", "x_bullets", ""),
        ],
        "education": [("paragraph", edu_text, "")],
        "certifications": [(kinds["certifications"], "certifications", "")],
        "additional_details": [("paragraph", "details", "")],
    }
    gates = {
        "contact": "len(contact_lines) > 0",
        "summary": "summary_shown IS NOT NULL",
        "skills": "len(skills_shown) > 0",
        "highlights": "len(skills_shown) > 0",
        "languages": "len(languages) > 0",
        "experience": "x_description IS NOT NULL",
        "education": "len(schools) > 0",
        "certifications": "len(certifications) > 0",
        "additional_details": "len(details) > 0",
    }
    out = []
    for i, section in enumerate(order):
        at, gate = i, gates.get(section, "true")
        if asked:
            at = f"list_position(section_order, '{section}')"
            gate = f"classic AND list_contains(section_order, '{section}') AND {gate}"
        if section == "header":
            out.append(block(at, "header", header, gate))
        else:
            head = ("section_heading", f"['{titles[section]}']", "")
            out.append(block(at, section, [head, *contents[section]], gate))
    return " UNION ALL ".join(out)


LAID = {
    "edu_rows": EDU_ROWS,
    "laid": "SELECT c.*, coalesce(schools, []) AS schools FROM ctx c LEFT JOIN edu_rows USING (doc_id)",
}


def school_texts(sep: str, *fields: str) -> str:
    parts = ", ".join(shown(f"x.{f}") for f in fields)
    return (
        f"list_filter(list_transform(schools, lambda x: nullif(concat_ws('{sep}', {parts}), '')),"
        " lambda x: x IS NOT NULL)"
    )


APEX_TITLES = {
    "contact": "Contact",
    "summary": "Professional Summary",
    "skills": "Skills",
    "languages": "Languages",
    "experience": "Work Experience",
    "education": "Education",
    "certifications": "Certifications",
    "additional_details": "Additional Details",
}
APEX_BLOCKS = section_blocks(
    joined(" | ", "x_title", "x_company", "x_dates"),
    school_texts(" | ", "institution", "degree", "end_date"),
    "bullet",
    APEX_TITLES,
    ["header", *APEX_TITLES],
    [
        ("title", "['Candidate Profile']", ""),
        ("heading", "[candidate_heading]", ""),
        ("paragraph", one("candidate_subheading"), ""),
    ],
    "",
)
CLASSIC_ORDER = [
    "header", "summary", "highlights", "languages", "experience", "education",
    "certifications", "additional_details", "skills",
]
CLASSIC_TITLES = {
    **APEX_TITLES,
    "summary": "Summary",
    "highlights": "Highlights",
    "experience": "Experience",
    "additional_details": "Additional Information",
}
# Two columns: the first holds the first half (rounded up); reading row by row.
HALF = "CAST(ceil(len(skills_shown) / 2.0) AS BIGINT)"
GRID_CELLS = (
    "CASE WHEN len(skills_shown) < 2 THEN skills_shown ELSE"
    f" list_filter(list_transform(range(0, 2 * {HALF}), lambda i: CASE WHEN i % 2 = 0"
    f" THEN skills_shown[CAST(i // 2 + 1 AS BIGINT)]"
    f" ELSE skills_shown[CAST({HALF} + i // 2 + 1 AS BIGINT)] END),"
    " lambda x: x IS NOT NULL) END"
)
CLASSIC_HEADER = (
    "upper(string_split(coalesce(candidate_subheading, candidate_heading), ' | ')[1])"
)
CLASSIC_BLOCKS = section_blocks(
    joined(" ", "x_company", "replace(x_dates, ' - ', ' to ')", "x_title"),
    school_texts(" ", "institution", "end_date", "degree"),
    "paragraph",
    CLASSIC_TITLES,
    CLASSIC_ORDER,
    [("title", f"[{CLASSIC_HEADER}]", "")],
    GRID_CELLS,
)
NUMBERED = """SELECT doc_id, row_number() OVER (PARTITION BY doc_id ORDER BY sec, part, i) - 1
  AS line_no, section, kind, text FROM"""
SQL["layout_apex"] = with_ctes(f"{NUMBERED} ({APEX_BLOCKS})", "ctx", LAID)
SQL["layout_classic"] = with_ctes(f"{NUMBERED} ({CLASSIC_BLOCKS})", "ctx", LAID)
SQL["layout_lines"] = with_ctes(
    f"{NUMBERED} (SELECT * FROM ({APEX_BLOCKS}) WHERE {I.RULE_SEED} % 3 <> 1"
    f" AND {I.RULE_SEED} % 7 <> 0 UNION ALL SELECT * FROM ({CLASSIC_BLOCKS})"
    f" WHERE {I.RULE_SEED} % 3 = 1 AND {I.RULE_SEED} % 7 <> 0) UNION ALL SELECT doc_id, NULL, NULL,"
    " 'refused', 'Unknown target format blueprint: unknown' FROM ctx"
    f" WHERE {I.RULE_SEED} % 7 = 0",
    "ctx",
    LAID,
)
SQL["highlights_grid"] = with_ctes(
    """SELECT doc_id, (i - 1) % grid_rows AS grid_row, (i - 1) // grid_rows AS grid_column, text
FROM (SELECT doc_id, unnest(skills_shown) AS text, generate_subscripts(skills_shown, 1) AS i,
  CAST(ceil(len(skills_shown) / CAST(least(1 + h % 4, greatest(1, len(skills_shown))) AS DOUBLE))
    AS BIGINT) AS grid_rows FROM ctx)""",
    "ctx",
)

# --- templates -------------------------------------------------------------------------------
PAYLOAD_PAGES = f"""SELECT n.page_id, s.sha,
    concat(CASE WHEN n.page_id % 6 = 0 THEN 'alt_' ELSE 'page_' END, n.page_id) AS path
  FROM (SELECT page_id, {I.BLUEPRINT_SOURCE} AS source_id FROM pages) n
  JOIN (SELECT page_id AS source_id, sha256(html) AS sha FROM pages) s USING (source_id)"""
BP_PAYLOADS = f"SELECT *, concat({', '.join(I.BLUEPRINT_PARTS)}) AS payload FROM sourced"
# The rules each derived payload breaks, from the parsed payload itself.
BP_TESTS = {
    "template_id: not a template id": "NOT regexp_full_match(payload ->> '$.template_id', '[a-z0-9][a-z0-9_-]+')",
    "version: not a whole number": "json_type(payload, '$.version') NOT IN ('UBIGINT', 'BIGINT')",
    "version: must be at least 1": "json_type(payload, '$.version') IN ('UBIGINT', 'BIGINT')"
    " AND CAST(payload ->> '$.version' AS DOUBLE) < 1",
    "source_reference_type: not an allowed value": "payload ->> '$.source_reference_type'"
    " NOT IN ('built_in', 'docx', 'pdf_reference')",
    "source_sha256.1: not a lower-case SHA-256": "NOT regexp_full_match(payload ->> '$.source_sha256[1]', '[0-9a-f]{64}')",
    "page.width_inches: not a number": "json_type(payload, '$.page.width_inches') = 'VARCHAR'",
    "page.width_inches: must be positive": "json_type(payload, '$.page.width_inches') <> 'VARCHAR'"
    " AND CAST(payload ->> '$.page.width_inches' AS DOUBLE) <= 0",
    "typography.section: required": "NOT json_exists(payload, '$.typography.section')",
    "section_order.2: not an allowed value": "payload ->> '$.section_order[2]' = 'footer'",
    "section_order.3: not an allowed value": "payload ->> '$.section_order[3]' = 'footer'",
    "skills_columns: must be between 1 and 4": "CAST(payload ->> '$.skills_columns' AS BIGINT) NOT BETWEEN 1 AND 4",
    "overflow.surprise: unknown key": "json_exists(payload, '$.overflow.surprise')",
}
BP_LIST = "[" + ", ".join(
    f"CASE WHEN {test} THEN {quote(reason)} END" for reason, test in BP_TESTS.items()
) + "]"
REGISTRY = {
    "sourced": PAYLOAD_PAGES,
    "blueprint_files": BP_PAYLOADS,
    "checked": f"""SELECT page_id, path, payload, CASE WHEN NOT json_valid(payload)
    THEN ['payload: not JSON'] ELSE list_sort(list_filter({BP_LIST}, lambda x: x IS NOT NULL)) END
    AS violations FROM blueprint_files""",
    "registered": """SELECT path, payload ->> '$.template_id' AS template_id,
    CAST(payload ->> '$.version' AS BIGINT) AS version,
    payload ->> '$.source_reference_type' AS source_reference_type,
    CAST(payload -> '$.source_sha256' AS VARCHAR[]) AS source_sha256,
    payload ->> '$.renderer_key' AS renderer_key,
    CAST(payload -> '$.section_order' AS VARCHAR[]) AS section_order,
    CAST(payload ->> '$.skills_columns' AS BIGINT) AS skills_columns,
    CAST(payload ->> '$.page.width_inches' AS DOUBLE) AS width_inches,
    upper(replace(payload ->> '$.typography.normal.color_hex', '#', '')) AS normal_color
    FROM checked WHERE len(violations) = 0""",
    "prints": """SELECT sha256, source_reference_type, arg_min(template_id, path) AS matched_template_id,
    arg_min(version, path) AS blueprint_version
    FROM (SELECT *, unnest(source_sha256) AS sha256 FROM registered) GROUP BY ALL""",
    "matched": f"""SELECT u.artifact_id, u.input_filename, u.sha256, u.kind, p.matched_template_id,
    p.blueprint_version FROM (SELECT {I.UPLOAD_COLUMNS['artifact_id']} AS artifact_id,
      {I.UPLOAD_COLUMNS['input_filename']} AS input_filename, sha256(html) AS sha256,
      CASE WHEN page_id % 2 = 0 THEN 'docx' ELSE 'pdf_reference' END AS kind FROM pages) u
    LEFT JOIN prints p ON u.sha256 = p.sha256 AND u.kind = p.source_reference_type""",
    "formats": f"""SELECT artifact_id, input_filename, stored_filename, input_type, role,
    CASE WHEN m THEN 'registered_target_format_blueprint' ELSE 'controlled_docx_renderer' END
      AS generation_strategy, true AS accepted_for_generation,
    kind = 'docx' AND m AS used_as_template_source,
    concat('/api/artifacts/', artifact_id, '/', stored_filename) AS download_url,
    CASE WHEN m THEN concat({quote(C.NOTE_MATCH_HEAD)}, matched_template_id, ' version ',
      blueprint_version, {quote(C.NOTE_MATCH_TAIL)}) WHEN kind = 'docx' THEN {quote(C.NOTE_DOCX)}
      ELSE {quote(C.NOTE_PDF)} END AS note, matched_template_id, blueprint_version,
    CASE WHEN m THEN 'manual_blueprint' ELSE 'reference_only' END AS format_support
    FROM (SELECT *, matched_template_id IS NOT NULL AS m,
      CASE WHEN kind = 'docx' THEN 'docx_template' ELSE 'pdf_reference' END AS role,
      CASE WHEN kind = 'docx' THEN 'docx' ELSE 'pdf' END AS input_type,
      CASE WHEN kind = 'docx' THEN 'target_format_template.docx'
        ELSE 'target_format_reference.pdf' END AS stored_filename FROM matched)""",
}


def with_registry(body: str, extra: dict[str, str] | None = None) -> str:
    parts = {**REGISTRY, **(extra or {})}
    return "WITH " + ",\n".join(f"{n} AS ({s})" for n, s in parts.items()) + "\n" + body


SQL["blueprint_checks"] = with_registry(
    """SELECT path, len(violations) = 0 AS accepted,
  coalesce(array_to_string(violations, '; '), '') AS violations FROM checked"""
)
SQL["blueprint_registry"] = with_registry(
    f"""SELECT path, template_id, version, source_reference_type,
  {lst('source_sha256')} AS source_sha256, renderer_key, {lst('section_order')} AS section_order,
  skills_columns, width_inches, normal_color,
  count(*) OVER (PARTITION BY template_id) AS registrations FROM registered"""
)
SQL["blueprint_match"] = with_registry(
    "SELECT artifact_id, sha256, matched_template_id, blueprint_version FROM matched"
)
SQL["target_format_meta"] = with_registry("SELECT * FROM formats")
SEED = "CAST(substring(artifact_id, 11, 18) AS BIGINT)"
KNOWN = f"""SELECT template_id, arg_min(renderer_key, path) AS renderer_key,
    arg_min(section_order, path) AS section_order, arg_min(skills_columns, path) AS skills_columns
    FROM (SELECT template_id, path, renderer_key, section_order, skills_columns FROM registered
      UNION ALL SELECT 'apex_standard', 'apex_standard/blueprint.json', 'apex_standard',
        ['header', 'contact', 'summary', 'highlights', 'languages', 'experience', 'education',
         'certifications', 'additional_details'], 1
      UNION ALL SELECT 'client_10554236_v1', 'client_10554236_v1/blueprint.json',
        '{C.CLASSIC_RENDERER}', {CLASSIC_ORDER}, 2) GROUP BY template_id"""
SQL["effective_template"] = with_registry(
    f"""SELECT artifact_id, r.template_id, k.renderer_key,
  array_to_string(k.section_order, ' ~ ') AS section_order, k.skills_columns,
  CASE WHEN k.template_id IS NULL
    THEN concat('Unknown target format blueprint: ', r.template_id) END AS reason
FROM requests r LEFT JOIN known k ON r.template_id = k.template_id""",
    {
        "requests": f"""SELECT artifact_id, coalesce(matched_template_id,
      CASE WHEN {SEED} % 7 = 3 THEN 'unknown' WHEN {SEED} % 7 = 4 THEN 'page_1' END,
      'apex_standard') AS template_id FROM matched""",
        "known": KNOWN,
    },
)
SQL["target_ref_check"] = with_registry(
    f"""SELECT artifact_id, CASE {SEED} % 11
  WHEN 1 THEN {quote(C.REF_ID_MISMATCH)} WHEN 2 THEN {quote(C.REF_INVALID)}
  WHEN 3 THEN {quote(C.REF_INVALID)} WHEN 4 THEN {quote(C.REF_METADATA_DIFFERS)}
  WHEN 5 THEN {quote(C.REF_NOT_UPLOADED)} WHEN 6 THEN {quote(C.REF_METADATA_INVALID)}
  WHEN 7 THEN {quote(C.REF_METADATA_MISSING)}
  WHEN 8 THEN CASE WHEN matched_template_id IS DISTINCT FROM 'page_0'
    THEN {quote(C.REF_METADATA_DIFFERS)} END END AS reason FROM matched"""
)

# --- from request to export ----------------------------------------------------------------------
# Profiles as edited; the sections below `prof` are those of the other queries.
EDITED_PROF = f"""SELECT doc_id, full_name, coalesce(e_email, email) AS email, phone,
  coalesce(e_location, location) AS location, linkedin_url, portfolio_url, professional_summary,
  list_transform(base, lambda x, i: CASE WHEN i = 2 AND e_skill1 IS NOT NULL AND len(skills) > 1
    AND (e_skills IS NULL OR e_skill1_at > e_skills_at) THEN e_skill1 ELSE x END) AS skills,
  list_filter(list_transform(languages, lambda x, i: CASE WHEN i = 1 THEN coalesce(e_language, x) ELSE x END),
    lambda x: {shown('x')} IS NOT NULL) AS languages,
  coalesce(e_salary, salary_expectation) AS salary_expectation,
  coalesce(e_notice, notice_period) AS notice_period,
  coalesce(e_permit, work_authorization) AS work_authorization,
  coalesce(e_interview, interview_availability) AS interview_availability,
  CASE WHEN x_description IS NOT NULL THEN {NEW_TITLE} END AS x_title, x_company, x_start, x_end,
  list_transform(x_description, lambda x, i: CASE WHEN i = 2 THEN coalesce(e_bullet, x) ELSE x END)
    AS x_description,
  list_filter(list_transform(certifications, lambda x, i: CASE WHEN i = 1 THEN {joined(' | ', 'x', 'e_issuer')}
    ELSE {shown('x')} END), lambda x: x IS NOT NULL) AS certifications
FROM (SELECT *, CASE WHEN e_skills IS NULL THEN skills ELSE {NEW_SKILLS} END AS base
  FROM before LEFT JOIN pivoted ON artifact_id = doc_id WHERE doc_id LIKE 'c%')"""
REQUESTED = {
    **{("before" if n == "prof" else n): s for n, s in CTES.items() if n in list(CTES)[: list(CTES).index("prof") + 1]},
    "before_m": f"SELECT doc_id, {missing_list(lambda n: n)} AS missing_before FROM before",
    **BUFFER,
    "pivoted": PIVOT,
    "prof": EDITED_PROF,
    **{n: CTES[n] for n in ("prof_m", "seeded", "ruled", "displayed", "ctx")},
    **REGISTRY,
    "known": KNOWN,
    "uploaded": "SELECT concat('c', substring(artifact_id, 11)) AS doc_id, matched_template_id FROM matched",
    "asked": f"""SELECT doc_id, h, u.doc_id IS NOT NULL AS has_format, matched_template_id AS kept,
    CASE WHEN u.doc_id IS NULL OR h % 11 = 9 THEN NULL WHEN h % 11 = 8 THEN 'page_0'
      ELSE matched_template_id END AS sent, {I.REQUEST_TEMPLATE} AS template_name,
    len(list_intersect(missing_before, missing)) AS open_fields
    FROM ruled JOIN before_m USING (doc_id) LEFT JOIN uploaded u USING (doc_id)""",
    "chosen": f"""SELECT doc_id, a.template_id, open_fields, k.section_order, k.skills_columns,
    k.renderer_key = '{C.CLASSIC_RENDERER}' AS classic, CASE
    WHEN has_format AND h % 11 = 1 THEN {quote(C.REF_ID_MISMATCH)}
    WHEN k.template_id IS NULL THEN concat('Unknown target format blueprint: ', a.template_id)
    WHEN has_format THEN CASE h % 11 WHEN 2 THEN {quote(C.REF_INVALID)}
      WHEN 3 THEN {quote(C.REF_INVALID)} WHEN 4 THEN {quote(C.REF_METADATA_DIFFERS)}
      WHEN 5 THEN {quote(C.REF_NOT_UPLOADED)} WHEN 6 THEN {quote(C.REF_METADATA_INVALID)}
      WHEN 7 THEN {quote(C.REF_METADATA_MISSING)}
      WHEN 8 THEN CASE WHEN kept IS DISTINCT FROM 'page_0' THEN {quote(C.REF_METADATA_DIFFERS)} END
      END END AS reason
    FROM (SELECT *, coalesce(sent, template_name, '{C.DEFAULT_TEMPLATE}') AS template_id FROM asked) a
    LEFT JOIN known k ON k.template_id = a.template_id""",
    "edu_rows": f"""SELECT doc_id, list(struct_pack(institution := institution,
    degree := CASE WHEN pos = 0 THEN coalesce(e_degree, degree) ELSE degree END,
    end_date := CASE WHEN pos = 0 THEN coalesce(e_school_end, end_date) ELSE end_date END) ORDER BY n)
    AS schools FROM edu LEFT JOIN pivoted ON artifact_id = doc_id GROUP BY doc_id""",
    "laid": """SELECT c.*, coalesce(schools, []) AS schools, template_id, section_order,
    skills_columns, classic FROM ctx c JOIN chosen USING (doc_id) LEFT JOIN edu_rows USING (doc_id)
    WHERE reason IS NULL""",
}
ANY_ROWS = "CAST(ceil(len(skills_shown) / least(skills_columns, greatest(1, len(skills_shown)))) AS BIGINT)"
ANY_COLUMNS = "least(skills_columns, greatest(1, len(skills_shown)))"
ANY_CELLS = (
    f"list_filter(list_transform(range(0, {ANY_ROWS} * {ANY_COLUMNS}), lambda i:"
    f" skills_shown[CAST((i % {ANY_COLUMNS}) * {ANY_ROWS} + i // {ANY_COLUMNS} + 1 AS BIGINT)]),"
    " lambda x: x IS NOT NULL)"
)
ASKED_BLOCKS = section_blocks(
    joined(" ", "x_company", "replace(x_dates, ' - ', ' to ')", "x_title"),
    school_texts(" ", "institution", "end_date", "degree"),
    "paragraph",
    CLASSIC_TITLES,
    ["contact", *CLASSIC_ORDER],
    [("title", f"[{CLASSIC_HEADER}]", "")],
    ANY_CELLS,
    asked=True,
)
SQL["generate_exports"] = (
    "WITH " + ",\n".join(f"{n} AS ({s})" for n, s in REQUESTED.items()) + f"""
SELECT doc_id AS request_id, template_id, open_fields, line_no, section, kind, text
FROM ({NUMBERED} (SELECT * FROM ({APEX_BLOCKS}) WHERE doc_id IN (SELECT doc_id FROM laid WHERE NOT classic)
  UNION ALL SELECT * FROM ({ASKED_BLOCKS}))) JOIN chosen USING (doc_id)
UNION ALL SELECT doc_id, template_id, open_fields, NULL, NULL, 'refused', reason FROM chosen
WHERE reason IS NOT NULL"""
)

# --- artifact state ----------------------------------------------------------------------------
EVENT_BASE = (
    "SELECT *, CAST(json_extract(props, '$.k') AS INTEGER) AS k FROM events"
)
EVENTS = (
    "SELECT k, " + ", ".join(f"{e} AS {n}" for n, e in I.EVENT_COLUMNS.items())
    + f", list_filter([{', '.join(I.EVENT_LABELS)}], lambda x: x IS NOT NULL)"
    f" AS missing_field_labels FROM ({EVENT_BASE})"
)


def newest(column: str, *writers: str) -> str:
    """Newest value among the writers; a null counts, so it is wrapped before arg_max."""
    names = ", ".join(quote(w) for w in writers)
    return (
        f"(arg_max(struct_pack(v := {column}), (ts, seq))"
        f" FILTER (WHERE event_type IN ({names}))).v"
    )


ALL = ("processed", "target_format_uploaded", "generated")
WRITERS = {
    **{c: ("processed",) for c in (
        "source_filename", "source_file_type", "original_pdf_preview_url",
        "original_preview_error")},
    **{c: ("target_format_uploaded",) for c in (
        "target_format_role", "target_format_filename", "target_format_download_url")},
    **{c: ("generated",) for c in (
        "template_name", "blind_profile", "docx_download_url", "pdf_download_url",
        "pdf_preview_url")},
}
STATE = f"""SELECT artifact_id, min(ts) AS created_at, max(ts) AS updated_at,
  {newest('event_type', *ALL)} AS status,
  {', '.join(f'{newest(c, *w)} AS {c}' for c, w in WRITERS.items())},
  {newest('artifact_dir', *ALL)} AS artifact_dir,
  CAST(len({newest('missing_field_labels', 'processed', 'generated')}) AS BIGINT)
    AS needs_review_count,
  {lst(newest('missing_field_labels', 'processed', 'generated'))} AS missing_field_labels
FROM ev GROUP BY artifact_id"""
SQL["artifact_state"] = f"WITH ev AS ({EVENTS}) {STATE}"
DEBUG_ROWS = " UNION ALL ".join(
    f"SELECT artifact_id, ts, seq, '{role}' AS name,"
    f" {I.DEBUG_LOCATION.format(role=role)} AS location FROM ev WHERE {condition}"
    for role, condition in I.DEBUG_ROLES.items()
)
RECORD_FILES = f"""latest AS (SELECT artifact_id, name, arg_max(location, (ts, seq)) AS location
  FROM ({DEBUG_ROWS}) GROUP BY artifact_id, name),
maps AS (SELECT artifact_id, string_agg(name || '=' || location, ' ~ ' ORDER BY name) AS files
  FROM latest GROUP BY artifact_id)"""
RECORD = f"""WITH ev AS ({EVENTS}), {RECORD_FILES}
SELECT s.*, coalesce(files, '') AS debug_artifacts FROM ({STATE}) s
  LEFT JOIN maps USING (artifact_id)"""
SQL["artifact_jobs"] = RECORD
SQL["artifact_lookup"] = f"{RECORD} WHERE artifact_id = 'artifact_7'"
SQL["recent_artifacts"] = f"{RECORD} ORDER BY updated_at DESC, artifact_id LIMIT 50"
SQL["debug_artifact_map"] = f"""WITH ev AS ({EVENTS}), files AS ({DEBUG_ROWS}),
latest AS (SELECT artifact_id, name, arg_max(location, (ts, seq)) AS location FROM files
  GROUP BY artifact_id, name)
SELECT artifact_id, string_agg(name || '=' || location, ' ~ ' ORDER BY name) AS debug_artifacts
FROM latest GROUP BY artifact_id"""
SQL["artifact_urls"] = """
SELECT a AS artifact_id, concat('/api/artifacts/', a, '/candidate_profile.docx?download=1') AS docx_download_url,
  concat('/api/artifacts/', a, '/candidate_profile.pdf?download=1') AS pdf_download_url,
  concat('/api/artifacts/', a, '/candidate_profile.pdf') AS pdf_preview_url,
  concat('/api/artifacts/', a, '/metadata') AS metadata_url
FROM (SELECT DISTINCT concat('artifact_', user_id) AS a FROM events)"""
SQL["immutable_originals"] = f"""WITH ev AS ({EVENTS}), stored AS (
  SELECT artifact_id, arg_min(source_filename, (ts, seq)) AS source_filename FROM ev
  WHERE event_type = 'processed' GROUP BY artifact_id)
SELECT * FROM stored UNION ALL
SELECT concat('artifact_', o_custkey), concat('order_', min(o_orderkey), '.docx') FROM orders
WHERE NOT EXISTS (SELECT 1 FROM stored WHERE artifact_id = concat('artifact_', o_custkey))
GROUP BY o_custkey"""

# --- corpus --------------------------------------------------------------------------------------
# The same sections over whole documents; all are blind and no rule is asked for.
CORPUS = {
    **CTES,
    "src": "SELECT CAST(doc_id AS VARCHAR) AS doc_id, text FROM documents",
    "seeded": "SELECT * FROM prof_m",
    "ruled": "SELECT *, true AS blind, "
    + ", ".join(
        f"CASE WHEN list_contains(missing, '{f}') THEN 'pending_confirmation' END AS rule_{f}"
        for f in RULE_FIELDS
    )
    + " FROM seeded",
    "edu_rows": EDU_ROWS,
    "wanted": f"""SELECT CAST(doc_id AS VARCHAR) AS doc_id, lang, {I.CORPUS_TEMPLATE} AS wanted,
    {I.CORPUS_FILE} LIKE '%.odt' AS unread FROM documents""",
    "laid": f"""SELECT c.*, coalesce(schools, []) AS schools, lang, wanted = 'client_10554236_v1' AS classic,
    {CLASSIC_ORDER} AS section_order, 2 AS skills_columns,
    CASE WHEN unread THEN {quote(C.NOT_DOCX)} WHEN wanted = 'unknown'
      THEN 'Unknown target format blueprint: unknown' END AS reason
    FROM ctx c JOIN wanted USING (doc_id) LEFT JOIN edu_rows USING (doc_id)""",
    "laid_lines": f"""SELECT doc_id, count(*) AS n FROM (SELECT * FROM ({APEX_BLOCKS}) WHERE doc_id IN
    (SELECT doc_id FROM laid WHERE NOT classic) UNION ALL SELECT * FROM ({ASKED_BLOCKS})) GROUP BY doc_id""",
}
SQL["corpus_failures"] = (
    "WITH " + ",\n".join(f"{n} AS ({s})" for n, s in CORPUS.items()) + """
SELECT lang, reason, count(*) AS documents,
  CAST(coalesce(sum(CASE WHEN reason IS NULL THEN n END), 0) AS BIGINT) AS lines
FROM laid LEFT JOIN laid_lines USING (doc_id) GROUP BY lang, reason
UNION ALL SELECT lang, 'no extractable text', count(*), 0 FROM documents WHERE doc_id % 9 = 4 GROUP BY lang"""
)
DOC_LABELS = (
    "SELECT lang, text, CASE WHEN l <> '' THEN l ELSE a END AS location, " + ", ".join(
        f"{label(C.DETAIL_LABELS[n])} AS {n}" for n, _ in REQUIRED if n != "location"
    ) + f" FROM (SELECT *, {label('Location')} AS l, {label('Address')} AS a FROM documents)"
)
SQL["missing_rate"] = f"""
SELECT lang, count(*) AS documents, count({first(C.EMAIL_PATTERN)}) AS with_email,
  count({first(C.PHONE_PATTERN)}) AS with_phone, {', '.join(
    f"count(*) FILTER (WHERE coalesce({n}, '') = '') AS missing_{n}" for n, _ in REQUIRED
)} FROM ({DOC_LABELS}) GROUP BY lang"""
SQL["review_histogram"] = (
    "SELECT needs_review, count(*) AS documents, round(avg(extracted), 6) AS mean_extracted"
    f" FROM ({SQL['ledger']}) GROUP BY needs_review"
)
