"""The chapter planner in SQL, walked group by group, as the other side of its queries.

Each step names a table of units (book_id, unit_no, group_no, reason, promoted and what the
units bring); group numbers run from 1 without gaps.
"""

from __future__ import annotations

FLEXIBLE = "role IN ('CANTO','POEM','STORY','ESSAY','UNKNOWN','APPENDIX')"
FIRST = "arg_min({0}, unit_no) FILTER (trim({0}) <> '') AS {0}"
ROLE = "CASE WHEN reason = 'PROMOTE_SCENE_TO_ACT' THEN 'ACT' WHEN canto THEN 'CANTO' ELSE role END"
MORE_THAN_20 = "book_id IN (SELECT book_id FROM {0} GROUP BY 1 HAVING max(group_no) > 20)"


def groups(units: str) -> str:
    named = ", ".join(FIRST.format(c) for c in ("parent", "direct", "act_key", "book_key"))
    return f"""SELECT book_id, group_no, CAST(sum(size) AS BIGINT) AS size, count(*) AS n_units, bool_or({FLEXIBLE}) AS flexible,
        bool_or(role = 'CANTO') AS canto, arg_min(role, unit_no) AS role, any_value(reason) AS reason, any_value(promoted) AS promoted, {named}
      FROM {units} GROUP BY 1, 2"""


def regrouped(units: str, moved: str) -> str:
    """``units`` under the groups of ``moved`` (book_id, group_no, leader, reason, promoted)."""
    return f"""SELECT u.* EXCLUDE (group_no, reason, promoted), m.reason, m.promoted,
        dense_rank() OVER (PARTITION BY u.book_id ORDER BY m.leader) AS group_no
      FROM {units} u JOIN {moved} m USING (book_id, group_no)"""


def pair(name: str, units: str, where: str = "true") -> dict[str, str]:
    """Short groups of a run of such take turns: the first, third, … takes its neighbour."""
    by_book = "PARTITION BY book_id ORDER BY group_no"
    return {
        f"{name}_group": groups(units),
        f"{name}_may": f"""SELECT *, coalesce({where} AND size < 3000 AND size + lead(size) OVER w <= 45000
            AND (coalesce(parent = lead(parent) OVER w, false) OR flexible OR lead(flexible) OVER w), false) AS may
          FROM {name}_group WINDOW w AS ({by_book})""",
        f"{name}_turn": f"""SELECT *, may AND row_number() OVER (PARTITION BY book_id, may, run ORDER BY group_no) % 2 = 1 AS takes
          FROM (SELECT *, group_no - row_number() OVER (PARTITION BY book_id, may ORDER BY group_no) AS run FROM {name}_may)""",
        f"{name}_moved": f"""SELECT book_id, group_no, CASE WHEN taken THEN group_no - 1 ELSE group_no END AS leader,
            CASE WHEN NOT takes AND NOT taken THEN reason
              WHEN reason = 'KEEP_AS_IS' AND other_reason = 'KEEP_AS_IS' THEN 'MERGE_SHORT_SIBLINGS' ELSE 'GROUP_SMALL_UNITS' END AS reason,
            CASE WHEN takes THEN coalesce(promoted, other) WHEN taken THEN coalesce(other, promoted) ELSE promoted END AS promoted
          FROM (SELECT *, coalesce(lag(takes) OVER w, false) AS taken,
              CASE WHEN takes THEN lead(reason) OVER w ELSE lag(reason) OVER w END AS other_reason,
              CASE WHEN takes THEN lead(promoted) OVER w ELSE lag(promoted) OVER w END AS other
            FROM {name}_turn WINDOW w AS ({by_book}))""",
        name: regrouped(units, f"{name}_moved"),
    }


def bundle(name: str, units: str, key: str) -> dict[str, str]:
    """Books of more than 20 groups: a bundle takes the next group until it is large enough and the key changes."""
    own = "g.reason, g.promoted, g.canto, g.size, g.key"
    return {
        f"{name}_group": f"SELECT *, {key} AS key FROM (SELECT * REPLACE ({ROLE} AS role) FROM ({groups(units)}))",
        f"{name}_walk": f"""WITH RECURSIVE step AS (
            SELECT book_id, group_no, group_no AS leader, {own} FROM {name}_group g WHERE group_no = 1
            UNION ALL
            SELECT g.book_id, g.group_no, CASE WHEN closed THEN g.group_no ELSE leader END,
              CASE WHEN closed THEN g.reason WHEN held_canto OR g.canto THEN 'GROUP_CANTOS' ELSE 'PROMOTE_TO_PARENT' END,
              CASE WHEN closed THEN g.promoted ELSE coalesce(held_promoted, g.promoted) END,
              g.canto OR (held_canto AND NOT closed), CASE WHEN closed THEN g.size ELSE held_size + g.size END, g.key
            FROM (SELECT g.*, s.leader, s.promoted AS held_promoted, s.canto AS held_canto, s.size AS held_size,
                NOT many OR (s.size >= 8000 AND (g.key <> s.key OR s.size >= 30000)) AS closed
              FROM step s JOIN (SELECT *, {MORE_THAN_20.format(name + '_group')} AS many FROM {name}_group) g
                ON g.book_id = s.book_id AND g.group_no = s.group_no + 1) g)
          SELECT * FROM step""",
        # A bundle is what its last group left.
        f"{name}_moved": f"""SELECT book_id, group_no, leader, last_value(reason) OVER w AS reason, last_value(promoted) OVER w AS promoted
          FROM {name}_walk WINDOW w AS (PARTITION BY book_id, leader ORDER BY group_no ROWS BETWEEN UNBOUNDED PRECEDING AND UNBOUNDED FOLLOWING)""",
        name: regrouped(units, f"{name}_moved"),
    }


def split(name: str, units: str) -> dict[str, str]:
    """Groups above 45000 close a part before the unit at which it has 30000."""
    return {
        f"{name}_unit": f"""SELECT *, row_number() OVER g AS k, sum(size) OVER (PARTITION BY book_id, group_no) > 45000
            AND count(*) OVER (PARTITION BY book_id, group_no) > 1 AS large
          FROM {units} WINDOW g AS (PARTITION BY book_id, group_no ORDER BY unit_no)""",
        f"{name}_walk": f"""WITH RECURSIVE step AS (
            SELECT book_id, group_no, k, unit_no, unit_no AS first_unit, CAST(size AS BIGINT) AS held FROM {name}_unit WHERE large AND k = 1
            UNION ALL
            SELECT u.book_id, u.group_no, u.k, u.unit_no, CASE WHEN held >= 30000 THEN u.unit_no ELSE first_unit END,
              CASE WHEN held >= 30000 THEN u.size ELSE held + u.size END
            FROM step s JOIN {name}_unit u ON u.book_id = s.book_id AND u.group_no = s.group_no AND u.k = s.k + 1)
          SELECT * FROM step""",
        name: f"""SELECT u.* EXCLUDE (group_no, reason, k, large), CASE WHEN large THEN 'GROUP_SMALL_UNITS' ELSE reason END AS reason,
            dense_rank() OVER (PARTITION BY u.book_id ORDER BY u.group_no, w.first_unit) AS group_no
          FROM {name}_unit u LEFT JOIN {name}_walk w USING (book_id, group_no, unit_no)""",
    }


CLOSE = """CASE WHEN trim(named) <> '' THEN role || chr(9) || named ELSE role || chr(9) || coalesce(parent, 'ROOT') END"""
CLOSE = CLOSE.replace("named", "(CASE WHEN role = 'CANTO' THEN book_key WHEN role IN ('SCENE', 'ACT') THEN act_key ELSE direct END)")
BROAD = "role || chr(9) || coalesce(parent, 'ROOT')"


def steps(start: str) -> dict[str, str]:
    """The tables ``bundled`` and ``planned`` from units in their first groups."""
    return {
        **pair("paired", start),
        **bundle("close", "paired", CLOSE),
        **pair("close_paired", "close", MORE_THAN_20.format("paired")),
        **bundle("broad", "close_paired", BROAD),
        **pair("bundled", "broad", MORE_THAN_20.format("close_paired")),
        **split("planned", "bundled"),
    }


#: Chapters of planned units: at most 20 a book, each with title and role.
CHAPTER = """SELECT book_id, chapter_idx, units, size, reason,
    CASE WHEN reason = 'PROMOTE_SCENE_TO_ACT' THEN 'ACT' WHEN canto THEN 'CANTO' ELSE role END AS role,
    CASE WHEN reason = 'PROMOTE_SCENE_TO_ACT' AND promoted IS NOT NULL THEN promoted WHEN units = 1 THEN first_title
      WHEN reason = 'GROUP_CANTOS' AND cantos IS NOT NULL THEN cantos WHEN trim(parent) <> '' THEN parent
      WHEN first_title = last_title THEN first_title ELSE first_title || ' - ' || last_title END AS title
  FROM (SELECT *, CASE WHEN first_number IS NULL OR last_number IS NULL THEN parent
        WHEN coalesce(trim(parent), '') = '' THEN 'Cantos ' || first_number || '-' || last_number
        ELSE parent || ' (Cantos ' || first_number || '-' || last_number || ')' END AS cantos
    FROM (SELECT *, nullif(regexp_extract(trim(first_title), '(?i)(\\d+|[IVXLCDM]+)$', 1), '') AS first_number,
        nullif(regexp_extract(trim(last_title), '(?i)(\\d+|[IVXLCDM]+)$', 1), '') AS last_number
      FROM (SELECT book_id, chapter_idx, CAST(count(*) AS INT) AS units, CAST(sum(size) AS INT) AS size,
          CASE WHEN min(group_no) < max(group_no) THEN 'PROMOTE_TO_PARENT' ELSE any_value(reason) END AS reason,
          arg_min(promoted, unit_no) FILTER (promoted IS NOT NULL) AS promoted, bool_or(role = 'CANTO') AS canto,
          arg_min(role, unit_no) AS role, arg_min(parent, unit_no) FILTER (parent IS NOT NULL) AS parent,
          arg_min(title, unit_no) AS first_title, arg_max(title, unit_no) AS last_title
        FROM (SELECT *, CAST((group_no - 1) // CAST(greatest(ceil(max(group_no) OVER (PARTITION BY book_id) / 20.0), 1) AS INT) + 1 AS INT) AS chapter_idx
          FROM planned) GROUP BY 1, 2)))"""
