"""Fixed values of the data model: source contract columns, enums, weights and limits."""

from __future__ import annotations

from pyspark.sql import types as T

# --- fixed values: source contract -------------------------------------------------
CONTRACT = {
    "employees": ["emp_id", "name", "hire_date", "education_level", "school", "school_tier",
                  "overseas_educated", "recruitment"],
    "assignments": ["emp_id", "start_date", "end_date", "department", "department_path", "title", "level",
                    "seq_l1", "seq_l2", "seq_l3", "segment_key"],
    "external": ["emp_id", "start_date", "end_date", "company", "title", "description", "company_tag",
                 "nature", "unemployed"],
    "levels": ["level", "band", "rank"],
    "streams": ["stream", "kind", "label", "period", "notes"],
    "scales": ["stream", "value", "rank"],
    "records": ["emp_id", "stream", "period_start", "period_end", "value", "recorded_at"],
    "industries": ["name", "parent"],
    "companies": ["name", "group_name"],
    "company_industries": ["company", "industry", "main"],
    "company_circles": ["company", "circle"],
    "company_aliases": ["raw_name", "company"],
}
REQUIRED_TABLES = ("employees", "assignments", "external", "levels")
FLAG_COLUMNS = {"employees": "overseas_educated", "external": "unemployed", "company_industries": "main"}
FLAGS_KEPT_NULL = {"overseas_educated"}

# --- fixed values: enums ------------------------------------------------------------
EDUCATION_LADDER = ("高中及以下", "大专", "本科", "硕士", "博士")
ENGAGEMENTS = ("主导", "做过", "提到")
SHORT_ROUTES = ("title", "skill")
ROUTES = ("role", "title", "description", "skill")
UNEMPLOYED_TITLE = "待业"
NOT_A_VALUE = ("", "未知")
LEVEL_STREAM, EDUCATION_STREAM = "level", "education"
RECORD_KINDS = ("rating", "status")

# --- fixed values: weights and limits ---------------------------------------------------
ENGAGEMENT_FACTOR = {"主导": 1.0, "做过": 0.85, "提到": 0.7}
UNKNOWN_ENGAGEMENT_FACTOR = 0.85
TENURE_HALF = 48.0
RECENCY_HALF = 36.0
BOOST_WEIGHT = 0.5
RESULT_PAGE = 50
MIN_MONTHS_BUCKETS = (6, 12, 24, 36)
CONDITION_MAX, PATTERNS_MAX, PATTERN_MAX, CRITERION_MAX, MONTHS_MAX = 12, 24, 120, 600, 600
TAG_MAX, TAGS_PER_SEGMENT = 16, 30
NEIGHBOURS = 8
READ_BATCH = 160
DAYS_PER_MONTH = 30.44

ORG_SEPARATOR = ">"

S, I, D, B = T.StringType(), T.IntegerType(), T.DateType(), T.BooleanType()


def struct(**fields) -> T.StructType:
    return T.StructType([T.StructField(name, kind) for name, kind in fields.items()])


# --- stored tables -----------------------------------------------------------------------
EMPLOYEE = struct(emp_id=S, name=S, cur_dept=S, cur_dept_path=S, cur_title=S, cur_seq_l1=S, cur_seq_l2=S,
                  cur_seq_l3=S, cur_level=S, cur_level_band=S, cur_level_rank=I, hire_date=D, education_level=S,
                  education_rank=I, school=S, school_tier=S, overseas_educated=B, recruitment=S)
COMPANY_META = struct(company_tag=S, nature=S)
EXPERIENCE = struct(id=S, emp_id=S, kind=S, unemployed=B, start_date=D, end_date=D, company=S, department=S,
                    department_path=S, company_meta=COMPANY_META, title=S, seq_l1=S, seq_l2=S, seq_l3=S,
                    seq_inferred_l1=S, seq_inferred_l2=S, level=S, description=S, months=I, content_key=S,
                    derived_identity=S, unanswered=B)
RECORD_STREAM = struct(stream=S, kind=S, label=S, period=S, notes=S)
SCALE = struct(stream=S, value=S, rank=I)
EMPLOYEE_RECORD = struct(emp_id=S, stream=S, period_start=D, period_end=D, value=S)
INDUSTRY = struct(name=S, parent=S)
COMPANY = struct(name=S, group_name=S, industries=T.ArrayType(S), main_industries=T.ArrayType(S),
                 circles=T.ArrayType(S))
COMPANY_ALIAS = struct(raw_name=S, company=S)
PHRASE = struct(id=S, text=S)
EXPERIENCE_PHRASE = struct(experience_id=S, route=S, phrase_id=S, engagement=S)
#: Results of a standard that searches do not read yet.
EXPERIENCE_NEXT = struct(experience_id=S, seq_inferred_l1=S, seq_inferred_l2=S, derived_identity=S, unanswered=B)
EXPERIENCE_PHRASE_NEXT = struct(experience_id=S, route=S, phrase_id=S, engagement=S, derived_identity=S)
TERM = struct(word=S, canonical=S, alias_sent_back=B, parent=S, excluded=B, reviewed_at=T.TimestampType())
NEAR = T.ArrayType(struct(word=S, people=T.LongType()))
REVIEW_WORD = struct(id=T.LongType(), guide_identity=S, word=S, people=T.LongType(), near=NEAR,
                     collected_at=T.TimestampType(), judge=S, judgment=S)
EXPERIENCE_VERDICT = struct(root=S, criterion_key=S, content=S, fits=B)
ACCOUNT_SCOPE = struct(user_id=S, org_path=S)

STORED = {
    "employee": EMPLOYEE, "experience": EXPERIENCE, "record_stream": RECORD_STREAM, "scale": SCALE,
    "employee_record": EMPLOYEE_RECORD, "industry": INDUSTRY, "company": COMPANY, "company_alias": COMPANY_ALIAS,
    "phrase": PHRASE, "experience_phrase": EXPERIENCE_PHRASE,
    "experience_next": EXPERIENCE_NEXT, "experience_phrase_next": EXPERIENCE_PHRASE_NEXT, "term": TERM, "review_word": REVIEW_WORD,
    "experience_verdict": EXPERIENCE_VERDICT, "account_scope": ACCOUNT_SCOPE,
}
