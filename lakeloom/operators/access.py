"""Access rules as Column predicates: who sees, edits and searches what.

Every rule is one boolean Column over (dept, access_level, audience, owner,
doc_type), never null, so it is pushed into the scan like any other filter.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Levels, the common department and staff roles.
PUBLIC, DEPT, OWNER = "public", "dept", "owner"
LEVELS = (PUBLIC, DEPT, OWNER)
COMMON_DEPT = "공통"
STAFF_ROLES = ("staff", "professor", "head")
ADMIN_ROLE, STUDENT_ROLE = "dev", "student"


@dataclass(frozen=True)
class Viewer:
    """also: further departments of the account. lent: departments that opened their documents to the viewer's."""

    role: str
    dept: str | None = None
    user: str | None = None
    also: tuple[str, ...] = ()
    lent: tuple[str, ...] = ()

    @property
    def own_depts(self) -> tuple[str, ...]:
        return tuple(dict.fromkeys(x for x in (self.dept, *self.also) if x))


def _level() -> Column:
    return F.coalesce(F.col("access_level"), F.lit(PUBLIC))


def _dept() -> Column:
    return F.coalesce(F.col("dept"), F.lit(COMMON_DEPT))


def _owned(v: Viewer) -> Column:
    return F.coalesce(F.col("owner") == v.user, F.lit(False)) if v.user else F.lit(False)


def visible(v: Viewer) -> Column:
    """Admins see all; students the public rules meant for them; others what is public, theirs, or of a department open to them."""
    if v.role == ADMIN_ROLE:
        return F.lit(True)
    if v.role == STUDENT_ROLE:
        return (_level() == PUBLIC) & F.coalesce(F.col("doc_type") == "regulation", F.lit(False)) & (F.coalesce("audience", F.lit("staff")) == STUDENT_ROLE)
    depts = [COMMON_DEPT, *v.own_depts, *v.lent]
    return (_level() == PUBLIC) | _owned(v) | ((_level() == DEPT) & _dept().isin(depts))


def can_edit(v: Viewer) -> Column:
    """Stricter: lent departments don't count, the common one only for owners and admins."""
    if v.role == ADMIN_ROLE:
        return F.lit(True)
    if v.role not in STAFF_ROLES:
        return _owned(v)
    own = [d for d in v.own_depts if d != COMMON_DEPT]
    inside = F.trim(_dept()).isin(own) if own else F.lit(False)
    return _owned(v) | ((F.coalesce("access_level", F.lit("")) != OWNER) & inside)


def search_filter(depts: Sequence[str] | None, user: str | None = None, excluded_kinds: Sequence[str] = ()) -> Column:
    """Scope of a search: None means every department, an empty list none at all."""
    kind = ~F.coalesce(F.col("kind"), F.lit("")).isin(list(excluded_kinds)) if excluded_kinds else F.lit(True)
    if depts is None:
        return kind
    if not depts:
        return F.lit(False)
    own = F.coalesce(F.col("owner") == user, F.lit(False)) if user else F.lit(False)
    return kind & ((_level() == PUBLIC) | own | ((_level() == DEPT) & _dept().isin(list(depts))))


def classify_intake(doc: DataFrame, wanted_dept: str = "wanted_dept", wanted_level: str = "wanted_level") -> DataFrame:
    """(dept, access_level) given at intake: a chosen department restricts to it unless a known level says otherwise; else common."""
    d = F.trim(F.coalesce(F.col(wanted_dept), F.lit("")))
    chosen = (d != "") & (d != COMMON_DEPT)
    level = F.col(wanted_level)
    known = F.coalesce(level.isin(*LEVELS), F.lit(False))
    return doc.withColumns(
        {
            "dept": F.when(chosen, d).otherwise(COMMON_DEPT),
            "access_level": F.when(chosen, F.when(known, level).otherwise(DEPT)).otherwise(F.when(F.coalesce(level == OWNER, F.lit(False)), OWNER).otherwise(PUBLIC)),
        }
    )


def scopes(accounts: DataFrame, grants: DataFrame, min_grades: DataFrame) -> DataFrame:
    """Departments each account may search: own and further ones, those lent to any of them, minus those above its grade.

    accounts (user, dept, also array, grade int), grants (owner_dept, to_dept), min_grades (dept, min_grade).
    """
    mine = accounts.select("user", "grade", F.explode(F.array_distinct(F.concat(F.array("dept", F.lit(COMMON_DEPT)), F.coalesce("also", F.array().cast("array<string>"))))).alias("dept"))
    lent = mine.join(grants, mine.dept == grants.to_dept).select("user", "grade", F.col("owner_dept").alias("dept"))
    every = mine.unionByName(lent).distinct()
    held = every.join(min_grades, "dept", "left").where(F.col("min_grade").isNull() | (F.col("grade") >= F.col("min_grade")))
    return held.groupBy("user").agg(F.array_sort(F.collect_set("dept")).alias("depts"))
