"""Open-access status: consistent pairs, flags from text, repository statements."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Access vocabularies.
OPEN_STATUSES = ["diamond", "gold", "hybrid", "green", "bronze", "open"]
TRUE_WORDS = ["1", "true", "yes", "y", "t"]
FALSE_WORDS = ["0", "false", "no", "n", "f"]
ITEM_OPEN_MARKS = ["cc-by", "cc by", "creative commons", "openaccess", "open access"]
ITEM_CLOSED_MARKS = ["closedaccess", "closed access"]
OAI_OPEN_MARKS = ["openaccess", "open access", "creativecommons.org/licenses/", "creativecommons.org/publicdomain/"]
OAI_CLOSED_MARKS = ["closedaccess", "closed access", "restrictedaccess"]
OAI_OPEN_SET = "open_access"
STATUS_ORDER = ["diamond", "gold", "hybrid", "green", "bronze", "open", "closed", "unknown"]
# End of the fixed values.


def reconciled(is_oa: Column, status: Column) -> Column:
    """struct(is_oa, oa_status) that agree: the flag decides, the status refines it."""
    s = F.lower(F.trim(F.coalesce(status, F.lit(""))))
    flag = F.when(is_oa.isNotNull(), is_oa).when(s.isin(OPEN_STATUSES), True).when(s == "closed", False)
    word = F.when(flag, F.when(s.isin(OPEN_STATUSES), s).otherwise("open")).when(~flag, "closed").otherwise("unknown")
    return F.struct(flag.alias("is_oa"), word.alias("oa_status"))


def flag_label(c: Column) -> Column:
    """Open access, Closed or Unknown from any spelling of a flag."""
    s = F.lower(F.trim(F.coalesce(c.cast("string"), F.lit(""))))
    return F.when(s.isin(TRUE_WORDS), "Open access").when(s.isin(FALSE_WORDS), "Closed").otherwise("Unknown")


def _holds(c: Column, marks: list[str]) -> Column:
    return F.exists(F.array(*[F.lit(m) for m in marks]), lambda m: F.contains(c, m))


def item_rights(rights: Column) -> Column:
    """true, false or null from a repository item's rights; a closed mark wins a mixed statement."""
    s = F.lower(F.coalesce(rights, F.lit("")))
    return F.when(_holds(s, ITEM_CLOSED_MARKS), False).when(_holds(s, ITEM_OPEN_MARKS), True)


def oai_rights(rights: Column, sets: Column) -> Column:
    """true, false or null from a harvested record's rights and sets; an open mark wins."""
    s = F.lower(F.coalesce(rights, F.lit("")))
    return F.when(F.array_contains(sets, OAI_OPEN_SET) | _holds(s, OAI_OPEN_MARKS), True).when(_holds(s, OAI_CLOSED_MARKS), False)


def status_rank(status: Column) -> Column:
    return F.array_position(F.array(*[F.lit(s) for s in STATUS_ORDER]), status)
