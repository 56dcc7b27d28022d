"""Query registry, and the shared common table expressions of the check SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from ..functions.tokens import BARLINE_SETS
from ..functions.vocab import values_sql, vocabulary
from ..sources.fixtures import EVENT_TOKENS_SQL
from ..sources.jobs import JOBS_SQL

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLES: dict[str, str] = {}


def register(name: str, sql: str | None = None, ctes: tuple[str, ...] = ()):
    """Decorator: adds a query, optionally with its check SQL and the CTEs that SQL needs."""
    def add(fn: Query) -> Query:
        QUERIES[name] = fn
        if sql is not None:
            ORACLES[name] = with_ctes(sql, *ctes)
        return fn
    return add


def sql_list(items) -> str:
    return ", ".join(f"'{i}'" for i in items)


def measure_sql(src: str, barlines: str = "eval") -> str:
    return (f"SELECT *, CAST(coalesce(sum(CASE WHEN token IN ({sql_list(BARLINE_SETS[barlines])}) "
            "THEN 1 ELSE 0 END) OVER (PARTITION BY score_id ORDER BY pos ROWS BETWEEN UNBOUNDED "
            f"PRECEDING AND 1 PRECEDING), 0) AS INT) AS measure_idx FROM {src}")


def voice_sql(src: str, barlines: str = "eval") -> str:
    return ("SELECT *, CASE WHEN max(CASE WHEN token = 'staff-bass' THEN 1 ELSE 0 END) OVER "
            "(PARTITION BY score_id, measure_idx ORDER BY pos) = 1 THEN 'bass' ELSE 'treble' END "
            f"AS voice FROM ({measure_sql(src, barlines)})")


def beats_sql(src: str) -> str:
    """Measure lengths from a table with voice and measure_idx."""
    return f"""
SELECT score_id, voice, measure_idx, CAST(coalesce(sum(CASE WHEN tup = 'tuplet-3-start'
    THEN t * 2 // 3 ELSE t END), 0) AS BIGINT) AS ticks,
  bool_or(token IN ({sql_list(BARLINE_SETS['eval'])})) AS closed,
  count(*) FILTER (token = 'dur-1/8') AS n_eighth, count(*) FILTER (token = 'dur-1/4') AS n_quarter
FROM (SELECT *, {ticks_sql('token')} AS t,
    last_value(CASE WHEN token LIKE 'tuplet-3-%' THEN token END IGNORE NULLS) OVER
      (PARTITION BY score_id, voice, measure_idx ORDER BY pos) AS tup
  FROM {src} WHERE token <> 'staff-bass') GROUP BY ALL"""


def ticks_sql(c: str) -> str:
    return (f"CASE WHEN regexp_matches({c}, '^(dur|rest)-[0-9]+/[1-9][0-9]*$') THEN "
            f"CAST(96 * CAST(split_part(split_part({c}, '-', 2), '/', 1) AS INT) // "
            f"CAST(split_part({c}, '/', 2) AS INT) AS INT) END")


SHARP_SQL = ("CASE left({0}, length({0}) - 1) WHEN 'Db' THEN 'C#' WHEN 'Eb' THEN 'D#' WHEN 'Gb' "
             "THEN 'F#' WHEN 'Ab' THEN 'G#' WHEN 'Bb' THEN 'A#' ELSE left({0}, length({0}) - 1) "
             "END || right({0}, 1)")


def midi_sql(p: str) -> str:
    """MIDI of a sharp spelling, NULL for other names."""
    names = "['C','C#','D','D#','E','F','F#','G','G#','A','A#','B']"
    return (f"CASE WHEN list_contains({names}, left({p}, length({p}) - 1)) THEN "
            f"CAST((TRY_CAST(right({p}, 1) AS INT) + 1) * 12 + "
            f"list_position({names}, left({p}, length({p}) - 1)) - 1 AS INT) END")


# CTE name -> (dependencies, SQL).
CTES: dict[str, tuple[tuple[str, ...], str]] = {
    "ev": ((), EVENT_TOKENS_SQL.format(events="events")),
    "tok": (("ev",), """
SELECT score_id, CAST(row_number() OVER (PARTITION BY score_id ORDER BY event_id, j) - 1 AS INT)
  AS pos, token
FROM (SELECT score_id, event_id, unnest(string_split(toks, ' ')) AS token,
        unnest(range(len(string_split(toks, ' ')))) AS j FROM ev)"""),
    "raw": (("tok",), """
SELECT score_id, pos + 1 AS pos, token FROM tok
UNION ALL SELECT score_id, 0, '<SOS>' FROM tok GROUP BY 1
UNION ALL SELECT score_id, max(pos) + 2, '<EOS>' FROM tok GROUP BY 1"""),
    "mv": (("tok",), voice_sql("tok")),
    "beats": (("mv",), beats_sql("mv")),
    "vocab": ((), values_sql(["token", "id"], [(t, i) for i, t in enumerate(vocabulary())])),
    "grand": (("tok",), "SELECT score_id, bool_or(token = 'staff-bass') AS is_grand FROM tok "
                        "GROUP BY 1"),
    "pred": (("tok",), """
SELECT score_id, CAST(row_number() OVER (PARTITION BY score_id ORDER BY pos, j) - 1 AS INT) AS pos,
  token
FROM (SELECT score_id, pos, j,
  CASE WHEN score_id % 9 = 0 THEN token
       WHEN token LIKE 'note-%' AND code % 19 = 3 THEN 'note-A4'
       WHEN token LIKE 'dur-%' AND code % 23 = 5 THEN 'dur-1/8' ELSE token END AS token
  FROM (SELECT *, (pos * 7 + score_id) % 160 AS code FROM tok WHERE score_id % 17 <> 5),
    (VALUES (0), (1)) AS d(j)
  WHERE (j = 0 AND (score_id % 9 = 0 OR code <> 11))
     OR (j = 1 AND score_id % 9 <> 0 AND code = 47))"""),
    "jobs": ((), JOBS_SQL.format(events="events")),
    "meta": (("tok",), """
SELECT *, CAST(CASE WHEN score_id % 3 = 0 THEN score_id % 4 + 1 ELSE (score_id % 3) * 2
    + CASE WHEN score_id % 7 = 1 THEN 1 ELSE 0 END END AS INT) AS n_staves,
  CASE WHEN score_id % 2 = 0 THEN 1 WHEN score_id % 5 = 0 THEN 900 END AS brk
FROM (SELECT score_id FROM tok GROUP BY 1)"""),
}


def add_cte(name: str, sql: str, *deps: str) -> None:
    CTES[name] = (deps, sql)


def with_ctes(sql: str, *names: str) -> str:
    ordered: list[str] = []

    def visit(n: str) -> None:
        if n in ordered:
            return
        for d in CTES[n][0]:
            visit(d)
        ordered.append(n)

    for n in names:
        visit(n)
    if not ordered:
        return sql
    body = ",\n".join(f"{n} AS {'' if n.endswith('fold') else 'MATERIALIZED '}({CTES[n][1]})"
                      for n in ordered)
    recursive = "RECURSIVE " if any(n.endswith("fold") for n in ordered) else ""
    return f"WITH {recursive}{body}\n{sql}"


