"""What is asked: conditions, the roles they play, and the filters a result is looked at through."""

from __future__ import annotations

import re
from dataclasses import dataclass, field

from ..functions.text import literal_pattern
from ..schema import CONDITION_MAX, CRITERION_MAX, MONTHS_MAX, PATTERN_MAX, PATTERNS_MAX

MODES = ("must", "boost", "exclude")
_ID = re.compile(r"[\w-]{1,64}")


class QueryError(ValueError):
    """A condition is not well formed."""


@dataclass(frozen=True)
class Seek:
    """What was done: patterns over phrases, or nothing but a criterion; a criterion is judged per segment."""

    patterns: tuple[str, ...] = ()
    criterion: str | None = None

    def __post_init__(self):
        if not self.patterns and not self.criterion:
            raise QueryError("a seek needs patterns or a criterion")
        if len(self.patterns) > PATTERNS_MAX or any(not p or len(p) > PATTERN_MAX for p in self.patterns):
            raise QueryError(f"at most {PATTERNS_MAX} patterns of at most {PATTERN_MAX} characters")
        if self.criterion and len(self.criterion) > CRITERION_MAX:
            raise QueryError(f"a criterion has at most {CRITERION_MAX} characters")

    @classmethod
    def words(cls, *words: str, criterion: str | None = None) -> Seek:
        return cls(tuple(literal_pattern(word) for word in words), criterion)


@dataclass(frozen=True)
class Condition:
    """`where` is a Spark SQL predicate over `e` (segment) and `h` (hit), or over `p` (person)."""

    id: str
    label: str
    mode: str
    source: str  # "experience" or "person"
    where: str = "true"
    params: dict = field(default_factory=dict)
    seek: Seek | None = None
    min_months: int | None = None
    off: bool = False

    def __post_init__(self):
        if not _ID.fullmatch(self.id):
            raise QueryError(f"condition id {self.id!r}")
        if self.mode not in MODES or self.source not in ("experience", "person"):
            raise QueryError(f"{self.id}: mode {self.mode!r} on {self.source!r}")
        if not self.label or not self.where:
            raise QueryError(f"{self.id}: label and predicate are needed")
        if self.source == "person" and (self.mode == "exclude" or self.seek or self.min_months):
            raise QueryError(f"{self.id}: a person is required or preferred, without seek or months")
        if self.min_months is not None and (self.mode == "exclude" or not 0 < self.min_months <= MONTHS_MAX):
            raise QueryError(f"{self.id}: months from 1 to {MONTHS_MAX}, and not on an exclusion")

    @property
    def claims(self) -> bool:
        return self.source == "experience" and self.mode != "exclude" and self.seek is not None

    def content(self) -> tuple:
        """What the condition says, apart from its id, label and switch."""
        seek = (self.seek.patterns, self.seek.criterion) if self.seek else None
        return (self.mode, self.source, seek, self.where, tuple(sorted(self.params.items())), self.min_months)


@dataclass(frozen=True)
class Query:
    conditions: tuple[Condition, ...] = ()

    def __post_init__(self):
        if len(self.conditions) > CONDITION_MAX:
            raise QueryError(f"at most {CONDITION_MAX} conditions")
        ids = [c.id for c in self.conditions]
        if len(set(ids)) != len(ids):
            raise QueryError("condition ids repeat")

    def roles(self) -> dict[str, list[int]]:
        """Positions of the enabled conditions by role: claims, gates, prefer, excludes."""
        out = {"claims": [], "gates": [], "prefer": [], "excludes": []}
        for at, c in enumerate(self.conditions):
            if c.off:
                continue
            role = ("excludes" if c.mode == "exclude" else "claims" if c.claims
                    else "gates" if c.mode == "must" else "prefer")
            out[role].append(at)
        return out


@dataclass(frozen=True)
class Filters:
    """How one result is looked at. Lists mean "one of"; different dimensions must all hold on the same segment."""

    seq: tuple[tuple[str, str], ...] = ()
    level: tuple[str, ...] = ()
    kind: str | None = None
    min_months: int | None = None
    company_tag: tuple[str, ...] = ()
    industry: tuple[str, ...] = ()
    skill: tuple[str, ...] = ()
    recruitment: tuple[str, ...] = ()
    education: tuple[str, ...] = ()
    school_tier: tuple[str, ...] = ()
    overseas: tuple[str, ...] = ()
    company: tuple[str, ...] = ()
    department: tuple[str, ...] = ()
    school: tuple[str, ...] = ()

    @property
    def narrows(self) -> bool:
        return any(getattr(self, name) for name in self.__dataclass_fields__)


# --- predicate builders ------------------------------------------------------------------------
def _like_any(columns, names, params, key) -> str:
    parts = []
    for at, name in enumerate(names):
        params[f"{key}{at}"] = name
        parts += [f"contains(lower({column}), lower(:{key}{at}))" for column in columns]
    return "(" + " or ".join(parts) + ")"


def segment_where(kind=None, company=(), department=(), company_tag=(), at_least_months=None) -> tuple[str, dict]:
    """Predicate and parameters for a segment `e`."""
    parts, params = [], {}
    if kind:
        params["kind"] = kind
        parts.append("e.kind = :kind")
    if company:
        parts.append(_like_any(["e.company"], company, params, "company"))
    if department:
        parts.append(_like_any(["e.department", "e.department_path"], department, params, "dept"))
    if company_tag:
        for at, value in enumerate(company_tag):
            params[f"tag{at}"] = value
        parts.append("e.company_tag in (" + ", ".join(f":tag{at}" for at in range(len(company_tag))) + ")")
    if at_least_months:
        params["months"] = at_least_months
        parts.append("e.months >= :months")
    return " and ".join(parts) or "true", params


# --- fixed values: person columns with an order, and the stream their steps are in ----------------
ORDINALS = {"level_band": ("level_rank", "level"), "education": ("education_rank", "education")}


def person_where(column: str, values=(), at_least: str | None = None) -> tuple[str, dict]:
    """Predicate and parameters for a person `p`: one of the values, at least a step, or a school by name."""
    if at_least is not None:
        rank, stream = ORDINALS[column]
        return (f"p.{rank} >= (select max(s.rank) from scale s where s.stream = '{stream}' and s.value = :least)",
                {"least": at_least})
    if column == "school":
        params: dict = {}
        return _like_any(["p.school"], values, params, "school"), params
    params = {f"v{at}": value for at, value in enumerate(values)}
    return f"p.{column} in (" + ", ".join(f":{key}" for key in params) + ")", params
