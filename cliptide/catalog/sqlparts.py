"""SQL building blocks shared by the checks (DuckDB dialect)."""

from __future__ import annotations

UNIT = (
    "CASE WHEN sqrt(list_dot_product({v}, {v})) <= 1e-12 THEN {v} "
    "ELSE list_transform({v}, lambda q: q / sqrt(list_dot_product({v}, {v}))) END"
)


def unit(vector: str) -> str:
    return UNIT.format(v=vector)


#: Each label is one scope; its query is the label's mean vector, its memory all its rows.
SCORED = f"""
emb AS (SELECT label, vec_id, embedding::DOUBLE[] AS v FROM embeddings),
unitv AS (SELECT label, vec_id, {unit('v')} AS v FROM emb),
cells AS (SELECT label, p, avg(v[p]) AS x
          FROM (SELECT label, v, unnest(range(1, len(v) + 1)) AS p FROM emb) GROUP BY label, p),
centre AS (SELECT label, list(x ORDER BY p) AS c FROM cells GROUP BY label),
centreu AS (SELECT label, {unit('c')} AS c FROM centre),
scored AS (SELECT u.label, u.vec_id, CAST(u.vec_id AS VARCHAR) AS clip_id, u.v,
                  CAST(30.0 AS DOUBLE) * u.vec_id AS st,
                  round(list_dot_product(u.v, q.c), 9) + 0.0 AS rel
           FROM unitv u JOIN centreu q USING (label)),
pool AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY label
                ORDER BY rel DESC, st ASC NULLS LAST, clip_id ASC) AS ix FROM scored) WHERE ix <= 200)
"""


def mmr_ctes(
    steps: int,
    lam: float,
    pool: str = "pool",
    key: str = "label",
    scaling: str = "minmax_zero",
    tie_first: bool = False,
    distance: bool = False,
) -> str:
    """Greedy steps unrolled into one pair of CTEs per step; the result is ``trace``."""
    scale = {
        "minmax_zero": "(rel - lo) / greatest(hi - lo, 1e-12)",
        "minmax_one": "CASE WHEN hi > lo THEN (rel - lo) / (hi - lo) ELSE 1.0 END",
        "raw": "rel",
    }[scaling]
    tie = "ix" if tie_first else "r DESC, ix"
    parts = [
        f"st0 AS (SELECT {key}, clip_id, v, ix, round({scale}, 9) AS r, -1e300 AS red FROM "
        f"(SELECT *, min(rel) OVER (PARTITION BY {key}) AS lo, max(rel) OVER (PARTITION BY {key}) AS hi FROM {pool}))",
    ]
    for i in range(1, steps + 1):
        if i == 1:
            parts.append("st1 AS (SELECT *, r AS sc FROM st0)")
        elif distance:
            parts.append(
                f"st{i} AS (SELECT {key}, clip_id, v, ix, r, red, round({lam} * r + {round(1 - lam, 10)} * red, 9) AS sc FROM "
                f"(SELECT p.{key}, p.clip_id, p.v, p.ix, p.r, round(sqrt(list_sum(list_transform("
                f"list_zip(p.v, s.mu), lambda z: (z[1] - z[2]) * (z[1] - z[2])))) / 2.0, 9) AS red "
                f"FROM st{i - 1} p JOIN mean{i - 1} s USING ({key}) WHERE p.ix <> s.ix))"
            )
        else:
            parts.append(
                f"st{i} AS (SELECT {key}, clip_id, v, ix, r, red, round({lam} * r - {round(1 - lam, 10)} * red, 9) AS sc FROM "
                f"(SELECT p.{key}, p.clip_id, p.v, p.ix, p.r, greatest(p.red, round(list_dot_product(p.v, s.v), 9)) AS red "
                f"FROM st{i - 1} p JOIN pick{i - 1} s USING ({key}) WHERE p.ix <> s.ix))"
            )
        parts.append(
            f"pick{i} AS MATERIALIZED (SELECT * FROM st{i} QUALIFY row_number() OVER "
            f"(PARTITION BY {key} ORDER BY sc DESC, {tie}) = 1)"
        )
        if distance:
            total = (
                f"SELECT {key}, ix, v AS tot FROM pick1"
                if i == 1
                else f"SELECT a.{key}, a.ix, list_transform(list_zip(a.v, b.tot), lambda z: z[1] + z[2]) AS tot "
                f"FROM pick{i} a JOIN mean{i - 1} b USING ({key})"
            )
            parts.append(f"mean{i} AS (SELECT {key}, ix, tot, {unit('tot')} AS mu FROM ({total}))")
    union = " UNION ALL ".join(
        f"SELECT {key}, {i} AS rank, clip_id, r AS relevance, "
        f"{'0.0' if i == 1 else 'red'} AS redundancy, sc AS marginal FROM pick{i}"
        for i in range(1, steps + 1)
    )
    parts.append(f"trace AS ({union})")
    return ",\n".join(parts)
