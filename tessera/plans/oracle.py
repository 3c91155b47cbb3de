"""DuckDB SQL for the registered queries (the correctness oracle).

Built from small SQL fragments so the Strassen stages read as the same
steps as the DataFrame plans: quadrant split, join to a VALUES coefficient
table, signed sum; leaf join; combine. DuckDB's ``sum(BIGINT)`` is HUGEINT,
so every sum is cast back to BIGINT.
"""

from __future__ import annotations

from tessera.functions.coefficients import combine_terms, left_terms, right_terms
from tessera.sources.generate import FORMULA_A, FORMULA_B, FORMULA_MOD

E = ("SELECT CAST(vec_id AS BIGINT) AS i, CAST(j AS BIGINT) AS j, "
     "CAST(floor(CAST(x AS DOUBLE) * 10000) AS BIGINT) AS v "
     "FROM (SELECT vec_id, unnest(range(len(embedding))) AS j, unnest(embedding) AS x FROM embeddings)")
SP = ("SELECT CAST(l_suppkey AS BIGINT) AS i, CAST(l_partkey AS BIGINT) AS j, "
      "CAST(sum(l_quantity) AS BIGINT) AS v FROM lineitem GROUP BY 1, 2")
UE = ("SELECT CAST(user_id AS BIGINT) AS i, t.j AS j, count(*) AS v FROM events JOIN "
      "(SELECT event_type, CAST(row_number() OVER (ORDER BY event_type) - 1 AS BIGINT) AS j "
      " FROM (SELECT DISTINCT event_type FROM events WHERE event_type IS NOT NULL)) t "
      "USING (event_type) GROUP BY 1, 2")


def t(x: str) -> str:
    return f"SELECT j AS i, i AS j, v FROM ({x})"


def formula(src: str, seed: int, modulus: int = FORMULA_MOD) -> str:
    return f"SELECT i, j, ({FORMULA_A} * i + {FORMULA_B} * j + {seed}) % {modulus} AS v FROM ({src})"


def nonzero(x: str) -> str:
    return f"SELECT i, j, v FROM ({x}) WHERE v <> 0"


def product(a: str, b: str) -> str:
    return (f"SELECT a.i AS i, b.j AS j, CAST(sum(a.v * b.v) AS BIGINT) AS v "
            f"FROM ({a}) a JOIN ({b}) b ON a.j = b.i GROUP BY a.i, b.j HAVING sum(a.v * b.v) <> 0")


def signed_sum(parts: list[tuple[str, int]]) -> str:
    u = " UNION ALL ".join(f"SELECT i, j, {s} * v AS v FROM ({p})" for p, s in parts)
    return f"SELECT i, j, CAST(sum(v) AS BIGINT) AS v FROM ({u}) GROUP BY i, j HAVING sum(v) <> 0"


def values(rows, cols: str) -> str:
    body = ", ".join("(" + ", ".join(str(x) for x in r) + ")" for r in rows)
    return f"(VALUES {body}) AS c({cols})"


def _q(hr: int, hc: int) -> str:
    return (f"CAST((CASE WHEN i >= {hr} THEN 2 ELSE 0 END) + "
            f"(CASE WHEN j >= {hc} THEN 1 ELSE 0 END) AS INTEGER)")


def quadrants(src: str, hr: int, hc: int, side: str) -> str:
    q = _q(hr, hc)
    return (f"SELECT *, '{side}' || CAST(q // 2 + 1 AS VARCHAR) || CAST(q % 2 + 1 AS VARCHAR) AS quadrant, "
            f"CASE WHEN i >= {hr} THEN i - {hr} ELSE i END AS li, "
            f"CASE WHEN j >= {hc} THEN j - {hc} ELSE j END AS lj, "
            f"CAST((q // 2) * {hr} AS BIGINT) AS row_index, CAST((q % 2) * {hc} AS BIGINT) AS col_index "
            f"FROM (SELECT *, {q} AS q FROM ({src}))")


def with_path(src: str) -> str:
    return f"SELECT CAST(0 AS BIGINT) AS path, i, j, v FROM ({src})"


def replicate(src: str, side: str, hr: int, hc: int) -> str:
    terms = left_terms() if side == "A" else right_terms()
    return (f"SELECT CAST(s.path * 7 + c.m AS BIGINT) AS path, c.m AS m, s.q AS q, c.sgn AS sgn, "
            f"s.li AS i, s.lj AS j, s.v AS v, c.m AS m_index, s.row_index, s.col_index, "
            f"s.quadrant || ', M' || CAST(c.m AS VARCHAR) AS matrix_name "
            f"FROM ({quadrants(src, hr, hc, side)}) s JOIN {values(terms, 'q, m, sgn')} ON s.q = c.q")


def divide(src: str, side: str, hr: int, hc: int) -> str:
    terms = left_terms() if side == "A" else right_terms()
    q = _q(hr, hc)
    return (f"SELECT CAST(s.path * 7 + c.m AS BIGINT) AS path, s.li AS i, s.lj AS j, "
            f"CAST(sum(c.sgn * s.v) AS BIGINT) AS v FROM "
            f"(SELECT path, {q} AS q, CASE WHEN i >= {hr} THEN i - {hr} ELSE i END AS li, "
            f"CASE WHEN j >= {hc} THEN j - {hc} ELSE j END AS lj, v FROM ({src})) s "
            f"JOIN {values(terms, 'q, m, sgn')} ON s.q = c.q "
            f"GROUP BY 1, 2, 3 HAVING sum(c.sgn * s.v) <> 0")


def leaf(left: str, right: str) -> str:
    return (f"SELECT l.path AS path, l.i AS i, r.j AS j, CAST(sum(l.v * r.v) AS BIGINT) AS v "
            f"FROM ({left}) l JOIN ({right}) r ON l.path = r.path AND l.j = r.i "
            f"GROUP BY 1, 2, 3 HAVING sum(l.v * r.v) <> 0")


def combine(src: str, hr: int, hc: int, by_quadrant: bool = False) -> str:
    w = values(combine_terms(), "m, q, sgn")
    base = (f"SELECT CAST((p.path - 1) // 7 AS BIGINT) AS path, c.q AS q, p.i AS i, p.j AS j, "
            f"c.sgn * p.v AS v FROM ({src}) p JOIN {w} ON CAST((p.path - 1) % 7 + 1 AS INTEGER) = c.m")
    if by_quadrant:
        return (f"SELECT path, q, i, j, CAST(sum(v) AS BIGINT) AS v FROM ({base}) "
                f"GROUP BY 1, 2, 3, 4 HAVING sum(v) <> 0")
    return (f"SELECT path, i + CAST((q // 2) * {hr} AS BIGINT) AS i, j + CAST((q % 2) * {hc} AS BIGINT) AS j, "
            f"CAST(sum(v) AS BIGINT) AS v FROM ({base}) GROUP BY 1, 2, 3 HAVING sum(v) <> 0")
