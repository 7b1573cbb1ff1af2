"""Greedy selectors that reward new evidence: saturation and role coverage.

Both fold a bounded pool per query (cut in Catalyst beforehand), one step depending on the last. A pool becomes
matrices of items by features; each kind of evidence is an array over all items that a choice updates.
"""

from __future__ import annotations

from collections.abc import Callable, Iterable
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Evidence roles a clip can play.
ROLES = [
    "entity_identity",
    "action_event",
    "state_attribute",
    "count_instance",
    "temporal_order",
    "spatial_location",
]

# Question patterns and the role weights they raise.
ROLE_PATTERNS = [
    (r"\b(who|whose|person|people|character|name|wearing|holding)\b", {"entity_identity": 1.0}),
    (r"\b(where|location|located|room|place|area|near|on the|in the)\b", {"spatial_location": 1.0}),
    (r"\b(how many|number of|count|total|several|times|multiple)\b", {"count_instance": 1.0, "action_event": 0.6}),
    (
        r"\b(before|after|first|last|then|next|previous|later|earlier|when|order|sequence)\b",
        {"temporal_order": 1.0, "action_event": 0.6},
    ),
    (
        r"\b(color|colour|state|condition|appearance|look like|status|open|closed|empty|full)\b",
        {"state_attribute": 1.0},
    ),
    (
        r"\b(what did|doing|do |does |happen|happened|action|activity|pick|put|take|move|open|close)\b",
        {"action_event": 1.0},
    ),
]
DEFAULT_ROLES = {"action_event": 0.8, "entity_identity": 0.5, "state_attribute": 0.5}

# Words that mark no evidence, and words that mark an action or a state.
EVIDENCE_STOP_WORDS = (
    "the and for with that this from are was were has have had his her their its into onto there here "
    "then than they them him she you who what when where which clip person people someone something"
).split()
ACTION_WORDS = (
    "add added adjust apply arrive ask begin carry change clean close come continue cook cut drink drive "
    "eat enter finish give go grab hold leave look make move open pick place play pour put read remove "
    "ride say sit stand start stop take talk turn use walk wash wear worn empty full closed visible"
).split()


def question_roles(question: Column) -> Column:
    """Weight of every role for a question (zero if it does not matter)."""
    lowered = F.lower(F.coalesce(question, F.lit("")))
    weights = []
    anything = F.lit(False)
    for role in ROLES:
        value = F.lit(0.0)
        for pattern, raised in ROLE_PATTERNS:
            if role in raised:
                value = F.greatest(value, F.when(lowered.rlike(pattern), F.lit(raised[role])).otherwise(0.0))
        weights.append(value)
    for pattern, _ in ROLE_PATTERNS:
        anything = anything | lowered.rlike(pattern)
    chosen = [
        F.when(anything, w).otherwise(F.lit(DEFAULT_ROLES.get(role, 0.0))) for role, w in zip(ROLES, weights)
    ]
    return F.map_from_arrays(F.array(*[F.lit(r) for r in ROLES]), F.array(*chosen))


def evidence_tokens(text: Column) -> Column:
    """Entity tags, stemmed content words and action or state words of a text.

    A word is stemmed and looked up once per text, however often it stands there.
    """
    from cliptide.functions.arrays import let
    from cliptide.functions.text import stem

    lowered = F.lower(F.coalesce(text, F.lit("")))
    raw = F.array_distinct(F.regexp_extract_all(lowered, F.lit("[a-z][a-z0-9_\\-']{2,}"), F.lit(0)))
    stops = F.array(*[F.lit(w) for w in EVIDENCE_STOP_WORDS])
    actions = F.array(*[F.lit(w) for w in ACTION_WORDS])
    pairs = F.transform(raw, lambda t: F.struct(t.alias("raw"), stem(F.btrim(t, F.lit("'_-"))).alias("stem")))
    kept = F.filter(pairs, lambda p: ~F.array_contains(stops, p["stem"]) & (F.length(p["stem"]) >= 3))
    entities = F.array_distinct(
        F.regexp_extract_all(lowered, F.lit("<(?:character|face|voice|object|scene)_[0-9]+>"), F.lit(0))
    )

    def told(words: Column) -> Column:
        acting = F.filter(
            words,
            lambda p: F.array_contains(actions, p["stem"]) | p["raw"].endswith("ing") | p["raw"].endswith("ed"),
        )
        return F.struct(
            entities.alias("entities"),
            F.array_distinct(F.transform(words, lambda p: p["stem"])).alias("words"),
            F.array_distinct(F.transform(acting, lambda p: p["stem"])).alias("actions"),
        )

    return let(kept, told)


@dataclass(frozen=True)
class SaturationWeights:
    relevance: float = 0.75
    semantic: float = 0.10
    temporal: float = 0.08
    entity: float = 0.06
    action: float = 0.06
    redundancy: float = 0.15
    temporal_redundancy: float = 0.0
    bucket: int = 4
    near: int = 2
    stop: float = 0.02
    novelty: float = 0.86


class Open:
    """Weight of an item's features that no chosen item has."""

    def __init__(self, touches: np.ndarray, weights: np.ndarray):
        self.touches, self.weights = touches, weights
        self.left = np.ones(touches.shape[1], bool)

    def worth(self) -> np.ndarray:
        return self.weights @ self.left

    def take(self, item: int) -> None:
        self.left &= ~self.touches[item]

    @classmethod
    def shares(cls, items: list[Iterable]) -> Open:
        """Every feature of an item weighs as much, all of them one."""
        touches, _ = incidence(items)
        return cls(touches, touches / np.maximum(touches.sum(1, keepdims=True), 1))


class Closest:
    """Largest value of an item against the chosen ones; zero before the first choice."""

    def __init__(self, between: np.ndarray):
        self.between, self.most = between, None

    def worth(self) -> np.ndarray:
        return np.zeros(len(self.between)) if self.most is None else self.most

    def take(self, item: int) -> None:
        self.most = self.between[item] if self.most is None else np.maximum(self.most, self.between[item])


class Novel:
    """Share of an item's parts whose cosine to every chosen part stays below a limit; zero without parts."""

    def __init__(self, parts: list[list], limit: float):
        self.owner = np.repeat(np.arange(len(parts)), [len(p) for p in parts])
        self.sizes = np.maximum(np.bincount(self.owner, minlength=len(parts)), 1)
        flat = np.array([v for p in parts for v in p], float).reshape(len(self.owner), -1)
        self.between, self.limit = np.round(flat @ flat.T, 9), limit
        self.most = np.full(len(self.owner), -np.inf)

    def worth(self) -> np.ndarray:
        return np.bincount(self.owner, self.most < self.limit, len(self.sizes)) / self.sizes

    def take(self, item: int) -> None:
        for part in np.flatnonzero(self.owner == item):
            self.most = np.maximum(self.most, self.between[part])


def incidence(items: list[Iterable]) -> tuple[np.ndarray, dict]:
    """Which item has which feature, and the column of each feature."""
    columns: dict = {}
    places = [(row, columns.setdefault(f, len(columns))) for row, features in enumerate(items) for f in features]
    out = np.zeros((len(items), max(len(columns), 1)), bool)
    if places:
        out[tuple(np.array(places).T)] = True
    return out, columns


def overlap(touches: np.ndarray) -> np.ndarray:
    """Jaccard index of every two items, zero beside an empty one."""
    t = touches.astype(float)
    both = t @ t.T
    sizes = t.sum(1)
    return both / np.maximum(sizes[:, None] + sizes - both, 1)


def unit_range(scores: np.ndarray) -> np.ndarray:
    low, high = scores.min(), scores.max()
    return np.ones_like(scores) if high <= low else (scores - low) / (high - low)


def chosen(
    value: Callable[[], np.ndarray], evidence: list, steps: int, enough: Callable[[int, int], bool] | None = None, first: int | None = None
) -> list[tuple[int, float]]:
    """(item, value) of each step: the highest value, ties to the earlier item; ``enough(taken, item)`` ends before an item."""
    out: list[tuple[int, float]] = []
    free = None
    while len(out) < steps:
        values = value()
        free = np.ones(len(values), bool) if free is None else free
        if not free.any():
            break
        open_ = np.where(free, np.round(values, 9), -np.inf)
        item = int(open_.argmax()) if first is None or out else first
        if enough is not None and enough(len(out), item):
            break
        out.append((item, float(values[item])))
        free[item] = False
        for kind in evidence:
            kind.take(item)
    return out


def _fold(pool: DataFrame, key: list[str], used: list[str], names: list[tuple[str, str, pa.DataType]], walk: Callable) -> DataFrame:
    """Fold each pool in the order of ``pos``; ``walk(rows)`` returns a tuple per chosen row, its rank is put in front."""
    types = dict(pool.dtypes)
    schema = ", ".join([*(f"{k} {types[k]}" for k in key), "rank int", *(f"{n} {sql}" for n, sql, _ in names)])

    def fold(table: pa.Table) -> pa.Table:
        out = walk(table.sort_by("pos").to_pylist())
        columns = {k: pa.array([table[k][0].as_py()] * len(out), table.schema.field(k).type) for k in key}
        columns["rank"] = pa.array(range(1, len(out) + 1), pa.int32())
        for at, (name, _, kind) in enumerate(names):
            columns[name] = pa.array([o[at] for o in out], kind)
        return pa.table(columns)

    return pool.select(*key, "pos", *used).groupBy(*key).applyInArrow(fold, schema)


def saturation_prefix(
    pool: DataFrame, key: list[str], min_clips: int = 1, max_clips: int = 5, w: SaturationWeights | None = None
) -> DataFrame:
    """Order by relevance plus new evidence until a step adds too little.

    ``pool``: clip_id (integer), pos, relevance, vector, centroids (array of arrays), entities,
    words, actions.
    """
    w = w or SaturationWeights()
    least = max(1, min_clips)

    def walk(rows: list[dict]) -> list[tuple]:
        clip = np.array([r["clip_id"] for r in rows])
        base = w.relevance * unit_range(np.array([r["relevance"] for r in rows], float))
        vectors = np.array([r["vector"] for r in rows], float)
        gap = np.abs(clip[:, None] - clip)
        decay = np.maximum(w.near + 1 - gap, 0) / (w.near + 1)
        alike = 0.5 + 0.5 * overlap(incidence([r["words"] or [] for r in rows])[0])
        weighed = [
            (w.semantic, Novel([r["centroids"] for r in rows], w.novelty)),
            (w.temporal, Open.shares([[b] for b in (clip // w.bucket).tolist()])),
            (w.entity, Open.shares([r["entities"] or [] for r in rows])),
            (w.action, Open.shares([r["actions"] or [] for r in rows])),
            (-w.redundancy, Closest(vectors @ vectors.T)),
            (-w.temporal_redundancy, Closest(decay * alike)),
        ]
        gains: list[np.ndarray] = []

        def value() -> np.ndarray:
            gains.append(sum(weight * kind.worth() for weight, kind in weighed))
            return base + gains[-1]

        def enough(taken: int, item: int) -> bool:
            return taken >= least and round(float(gains[-1][item]), 9) < w.stop

        path = chosen(value, [kind for _, kind in weighed], max(min_clips, max_clips), enough)
        return [(int(clip[i]), v, float(gains[step][i])) for step, (i, v) in enumerate(path)]

    used = ["clip_id", "relevance", "vector", "centroids", "entities", "words", "actions"]
    names = [("clip_id", "bigint", pa.int64()), ("objective", "double", pa.float64()), ("gain", "double", pa.float64())]
    return _fold(pool, key, used, names, walk)


@dataclass(frozen=True)
class RoleWeights:
    relevance: float = 0.55
    match: float = 0.0
    coverage: float = 0.30
    instance: float = 0.25
    redundancy: float = 0.10
    query_coverage: float = 0.0
    secondary: float = 0.0
    soft_prior: bool = False
    gate_redundancy: bool = False
    fix_first: bool = False


def role_prefix(pool: DataFrame, key: list[str], k: int, w: RoleWeights | None = None) -> DataFrame:
    """Order by relevance plus newly covered roles and evidence units.

    ``pool``: clip_id (string), pos, relevance, vector, weights (map role to weight of the
    question), units (array of struct<unit, role>). By default a role weighs what the question gives it, the others
    ``secondary``. With ``soft_prior`` all roles weigh alike and the question counts in ``match`` and ``query_coverage`` only.
    """
    w = w or RoleWeights()

    def walk(rows: list[dict]) -> list[tuple]:
        base = unit_range(np.array([r["relevance"] for r in rows], float))
        vectors = np.array([r["vector"] for r in rows], float)
        units = [{u["unit"]: u["role"] for u in r["units"] or []} for r in rows]
        has_role, role_at = incidence([u.values() for u in units])
        has_unit, unit_at = incidence(units)
        asked = {r: v for r, v in dict(rows[0]["weights"]).items() if v > 0}
        usual = dict.fromkeys(ROLES, w.secondary) if w.secondary > 0 else {}

        def per_role(weights: dict) -> np.ndarray:
            return np.array([weights.get(r, 0.0) for r in role_at] or [0.0])

        flat = per_role(dict.fromkeys(ROLES, 1.0))
        query = per_role(asked)
        whole = max(sum((asked if w.soft_prior else usual | asked).values()), 1e-6)
        own = flat if w.soft_prior else per_role(usual | asked)
        unit_worth = np.zeros(has_unit.shape)
        for row, held in enumerate(units):
            for unit, role in held.items():
                unit_worth[row, unit_at[unit]] = own[role_at[role]]
        most = max(unit_worth.sum(1).max(), 1.0 if w.soft_prior else 1e-6)
        counted = has_role & (flat > 0) if w.soft_prior else has_role
        roles = Open(has_role, counted * (own / (len(ROLES) if w.soft_prior else whole)))
        wanted = Open(has_role, counted * query / whole if w.soft_prior else np.zeros(has_role.shape))
        instances = Open(has_unit, unit_worth)
        close = Closest(vectors @ vectors.T)
        match = np.minimum(1.0, counted @ (query if w.soft_prior else own) / whole)

        def value() -> np.ndarray:
            instance = np.minimum(1.0, instances.worth() / most)
            near = close.worth() * (np.maximum(0.0, 1.0 - instance) if w.gate_redundancy else 1.0)
            new = w.coverage * roles.worth() + w.instance * instance + w.query_coverage * np.minimum(1.0, wanted.worth())
            return w.relevance * base + w.match * match + new - w.redundancy * near

        if len(rows) <= k:  # nothing to choose
            return [(r["clip_id"], float(b)) for r, b in zip(rows, base, strict=True)]
        first = int(base.argmax()) if w.fix_first else None
        path = chosen(value, [roles, wanted, instances, close], k, first=first)
        return [
            (rows[i]["clip_id"], float(base[i]) if step == 0 and w.fix_first else round(v, 9)) for step, (i, v) in enumerate(path)
        ]

    used = ["clip_id", "relevance", "vector", "weights", "units"]
    return _fold(pool, key, used, [("clip_id", "string", pa.string()), ("objective", "double", pa.float64())], walk)
