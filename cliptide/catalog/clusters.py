"""Speaker and character clusterings. A label of the embeddings is a recording, its vectors are chunks."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from cliptide.catalog.registry import big, query, table
from cliptide.catalog.sqlparts import unit
from cliptide.operators import carry
from cliptide.operators import clustering as C

UNITS = f"""emb AS (SELECT label, vec_id, embedding::DOUBLE[] AS v FROM embeddings),
unitv AS (SELECT label, vec_id, {unit('v')} AS v FROM emb)"""

_SUM = "list_transform(list_zip(sums[i], sums[j]), lambda z: z[1] + z[2])"


def _merging(start: str, score: str, floor: float) -> str:
    """Merge the best pair of lists until none reaches ``floor``; ``done`` holds the members of every cluster that is left."""
    return f"""start AS ({start}),
st(label, step, sums, ns, members) AS (SELECT label, 0, sums, ns, members FROM start UNION ALL
SELECT label, step + 1, [CASE WHEN k = i THEN {_SUM} ELSE sums[k] END FOR k IN range(1, len(ns) + 1) IF k <> j],
[CASE WHEN k = i THEN ns[i] + ns[j] ELSE ns[k] END FOR k IN range(1, len(ns) + 1) IF k <> j],
[CASE WHEN k = i THEN list_concat(members[i], members[j]) ELSE members[k] END FOR k IN range(1, len(ns) + 1) IF k <> j]
FROM st, LATERAL (SELECT i, j FROM (SELECT i, j, round({score}, 9) AS s FROM (SELECT unnest(range(1, len(st.ns) + 1)) AS i) a,
(SELECT unnest(range(1, len(st.ns) + 1)) AS j) b WHERE i < j) x WHERE s >= {floor} ORDER BY s DESC, i, j LIMIT 1) p),
done AS (SELECT label, unnest(members) AS m FROM (SELECT * FROM st QUALIFY row_number() OVER (PARTITION BY label ORDER BY step DESC) = 1))"""


_DOT = "list_dot_product(st.sums[i], st.sums[j])"
_LINKED = _merging(
    "SELECT label, list(v ORDER BY vec_id) AS sums, list(1.0::DOUBLE ORDER BY vec_id) AS ns, list([vec_id] ORDER BY vec_id) AS members FROM unitv GROUP BY label",
    f"{_DOT} / (st.ns[i] * st.ns[j])",
    0.2,
)


@query(
    "average_linkage",
    f"""WITH RECURSIVE {UNITS}, {_LINKED}, lk AS (SELECT label, list_min(m) AS root, unnest(m) AS vec_id FROM done)
SELECT CAST(label AS BIGINT) AS label, CAST(vec_id AS BIGINT) AS vec_id, CAST(dense_rank() OVER (PARTITION BY label ORDER BY root) - 1 AS BIGINT) AS speaker FROM lk""",
)
def average_linkage(spark: SparkSession, folder: str) -> DataFrame:
    chunks = table(spark, folder, "embeddings").select("label", "vec_id", "embedding")
    out = C.average_linkage(chunks, ["label"], "vec_id", "embedding", 0.2)
    return out.select(big("label"), big("vec_id"), big("speaker"))


def _dealt(chunks: DataFrame, parts: int) -> DataFrame:
    return chunks.select("label", "vec_id", (F.col("vec_id") * F.col("vec_id") % parts).alias("speaker"))


@query(
    "minor_speakers",
    f"""WITH {UNITS}, lb AS (SELECT label, vec_id, vec_id * vec_id % 23 AS speaker FROM emb),
sz AS (SELECT label, speaker, count(*) > 4 AS major FROM lb GROUP BY label, speaker),
cells AS (SELECT label, speaker, p, avg(v[p]) AS x FROM (SELECT emb.label, lb.speaker, v, unnest(range(1, len(v) + 1)) AS p FROM emb JOIN lb USING (label, vec_id)) GROUP BY ALL),
mid AS (SELECT label, speaker, list(x ORDER BY p) AS c FROM cells JOIN sz USING (label, speaker) WHERE major GROUP BY label, speaker),
midu AS (SELECT label, speaker, {unit('c')} AS c FROM mid),
far AS (SELECT u.label, u.vec_id, arg_min(m.speaker, (-round(list_dot_product(u.v, m.c), 9), m.speaker)) AS nearest FROM unitv u JOIN midu m USING (label) GROUP BY u.label, u.vec_id),
fst AS (SELECT label, min(speaker) AS f FROM lb GROUP BY label)
SELECT CAST(lb.label AS BIGINT) AS label, CAST(lb.vec_id AS BIGINT) AS vec_id, CAST(CASE WHEN major THEN lb.speaker ELSE coalesce(nearest, f) END AS BIGINT) AS speaker
FROM lb JOIN sz USING (label, speaker) JOIN fst USING (label) LEFT JOIN far USING (label, vec_id)""",
)
def minor_speakers(spark: SparkSession, folder: str) -> DataFrame:
    chunks = table(spark, folder, "embeddings").select("label", "vec_id", "embedding")
    out = C.without_minor(chunks, _dealt(chunks, 23), ["label"], "vec_id", "embedding", "speaker")
    return out.select(big("label"), big("vec_id"), big("speaker"))


_CENTRES = _merging(
    """SELECT label, list(total ORDER BY speaker) AS sums, list(1.0::DOUBLE ORDER BY speaker) AS ns, list([speaker] ORDER BY speaker) AS members FROM
(SELECT label, speaker, list(x ORDER BY p) AS total FROM (SELECT label, speaker, p, sum(v[p]) AS x FROM
(SELECT label, vec_id * vec_id % 29 AS speaker, v, unnest(range(1, len(v) + 1)) AS p FROM emb) GROUP BY ALL) GROUP BY label, speaker) GROUP BY label""",
    f"{_DOT} / greatest(sqrt(list_dot_product(st.sums[i], st.sums[i])) * sqrt(list_dot_product(st.sums[j], st.sums[j])), 1e-24)",
    0.15,
)


@query(
    "merged_speakers",
    f"""WITH RECURSIVE {UNITS}, {_CENTRES}, mp AS (SELECT label, list_min(m) AS root, unnest(m) AS speaker FROM done)
SELECT CAST(label AS BIGINT) AS label, CAST(vec_id AS BIGINT) AS vec_id, CAST(root AS BIGINT) AS speaker FROM
(SELECT label, vec_id, vec_id * vec_id % 29 AS speaker FROM emb) JOIN mp USING (label, speaker)""",
)
def merged_speakers(spark: SparkSession, folder: str) -> DataFrame:
    chunks = table(spark, folder, "embeddings").select("label", "vec_id", "embedding")
    out = C.merged_centres(chunks, _dealt(chunks, 29), ["label"], "vec_id", "embedding", "speaker", 0.15)
    return out.select(big("label"), big("vec_id"), big("speaker"))


@query(
    "careful_merges",
    f"""WITH RECURSIVE {UNITS}, ps AS (SELECT label, vec_id, v, row_number() OVER (PARTITION BY label ORDER BY vec_id) AS pos FROM unitv),
pr AS (SELECT a.label, a.pos AS a, b.pos AS b, round(list_dot_product(a.v, b.v), 9) AS s FROM ps a JOIN ps b ON a.label = b.label AND a.pos < b.pos),
cand AS (SELECT label, a, b, row_number() OVER (PARTITION BY label ORDER BY s DESC, a, b) AS k FROM pr WHERE s >= 0.2),
bad AS (SELECT label, list([a, b]) AS bad FROM pr WHERE s < 0.18 GROUP BY label),
st(label, k, g) AS (SELECT label, 0::BIGINT, list(pos ORDER BY pos) FROM ps GROUP BY label UNION ALL
SELECT label, k, CASE WHEN x <> y AND len(list_filter(bad, lambda p: (g[p[1]] = x AND g[p[2]] = y) OR (g[p[1]] = y AND g[p[2]] = x))) = 0
THEN list_transform(g, lambda q: CASE WHEN q = greatest(x, y) THEN least(x, y) ELSE q END) ELSE g END
FROM (SELECT st.label, cand.k, st.g, bad.bad, st.g[cand.a] AS x, st.g[cand.b] AS y FROM st JOIN cand ON cand.label = st.label AND cand.k = st.k + 1 JOIN bad ON bad.label = st.label)),
fin AS (SELECT label, g FROM st QUALIFY row_number() OVER (PARTITION BY label ORDER BY k DESC) = 1)
SELECT CAST(ps.label AS BIGINT) AS label, CAST(ps.vec_id AS BIGINT) AS vec_id, CAST(dense_rank() OVER (PARTITION BY ps.label ORDER BY g[pos]) - 1 AS BIGINT) AS "group" FROM ps JOIN fin USING (label)""",
)
def careful_merges(spark: SparkSession, folder: str) -> DataFrame:
    rows = table(spark, folder, "embeddings").select("label", "vec_id", "embedding")
    out = C.careful_merges(rows, ["label"], "vec_id", "embedding", 0.2)
    return out.select(big("label"), big("vec_id"), big("group"))


def audio_chunks(spark: SparkSession, folder: str) -> DataFrame:
    """Vectors of a label as chunks of three seconds, two seconds apart, dealt among seven speakers."""
    rows = table(spark, folder, "embeddings").select("label", "vec_id", "embedding")
    placed = carry.position(rows, ["label"], ["vec_id"], carry.chunk_if_hot(rows, ["label"], F.floor(F.col("vec_id") / 4096)), "n")
    start = (F.col("n") - 1) * 2.0
    return placed.select("label", "vec_id", "embedding", (F.col("vec_id") * F.col("vec_id") % 7).alias("speaker"), start.alias("start"), (start + 3).alias("end"))


@query(
    "joint_speakers",
    f"""WITH {UNITS}, ev AS (SELECT event_id, user_id, CAST(json_extract_string(props, '$.k') AS BIGINT) AS k FROM events),
fr AS (SELECT user_id % 10 AS label, (event_id % 480) / 4.0::DOUBLE AS t, min((event_id % 480) // 24 % 3 + CASE WHEN k % 17 = 0 THEN 1 ELSE 0 END) AS face FROM ev GROUP BY 1, 2),
pv AS (SELECT *, lag(face) OVER (PARTITION BY label ORDER BY t) AS pf, lag(t) OVER (PARTITION BY label ORDER BY t) AS pt FROM fr),
rn AS (SELECT *, sum(CASE WHEN pf = face AND t - pt <= 0.6 THEN 0 ELSE 1 END) OVER (PARTITION BY label ORDER BY t) AS run FROM pv),
iv AS (SELECT label, face, min(t) AS st, max(t) AS en FROM rn GROUP BY label, run, face HAVING max(t) - min(t) >= 1e-4),
au AS (SELECT e.label, e.vec_id, e.v AS raw, u.v, e.vec_id * e.vec_id % 7 AS speaker, (row_number() OVER (PARTITION BY e.label ORDER BY e.vec_id) - 1) * 2.0::DOUBLE AS st FROM emb e JOIN unitv u USING (label, vec_id)),
hd AS (SELECT au.label, iv.face, raw FROM au JOIN iv ON iv.label = au.label AND least(au.st + 3, iv.en) - greatest(au.st, iv.st) > 1),
ce AS (SELECT label, face, p, avg(raw[p]) AS x FROM (SELECT label, face, raw, unnest(range(1, len(raw) + 1)) AS p FROM hd) GROUP BY label, face, p),
so AS (SELECT label, face, list(x ORDER BY p) AS c FROM ce GROUP BY label, face), sn AS (SELECT label, face, {unit('c')} AS c FROM so),
kn AS (SELECT iv.* FROM iv JOIN sn USING (label, face)), hf AS (SELECT label, face, sum(en - st) * 0.5 AS half FROM kn GROUP BY label, face),
op AS (SELECT *, max(st + 3) OVER (PARTITION BY label, speaker ORDER BY st, vec_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS reach FROM au),
il AS (SELECT *, sum(CASE WHEN reach IS NULL OR st - reach > 0 THEN 1 ELSE 0 END) OVER (PARTITION BY label, speaker ORDER BY st, vec_id) AS island FROM op),
me AS (SELECT label, speaker, min(st) AS st, max(st + 3) AS en FROM il GROUP BY label, speaker, island),
sh AS (SELECT me.label, me.speaker, kn.face, sum(least(me.en, kn.en) - greatest(me.st, kn.st)) AS shared FROM me JOIN kn ON kn.label = me.label AND me.st < kn.en AND kn.st < me.en GROUP BY ALL),
tc AS (SELECT sh.* FROM sh JOIN hf USING (label, face) WHERE shared > least(half, 0.5)),
be AS (SELECT au.label, au.vec_id, arg_min(tc.face, (-round(list_dot_product(au.v, sn.c), 9), tc.face)) AS face FROM au JOIN tc ON tc.label = au.label AND tc.speaker = au.speaker
JOIN sn ON sn.label = au.label AND sn.face = tc.face GROUP BY au.label, au.vec_id),
lb AS (SELECT au.label, au.vec_id, CASE WHEN be.face IS NULL THEN 'voice ' || au.speaker ELSE 'face ' || be.face END AS s FROM au LEFT JOIN be USING (label, vec_id)),
fs AS (SELECT label, s, min(vec_id) AS f FROM lb GROUP BY label, s), nu AS (SELECT label, s, row_number() OVER (PARTITION BY label ORDER BY f) - 1 AS n FROM fs)
SELECT CAST(label AS BIGINT) AS label, CAST(vec_id AS BIGINT) AS vec_id, CAST(n AS BIGINT) AS speaker FROM lb JOIN nu USING (label, s)""",
)
def joint_speakers(spark: SparkSession, folder: str) -> DataFrame:
    """Faces of the events, four frames a second, correct the speakers of the chunks."""
    slot = F.col("event_id") % 480
    face = F.floor(slot / 24) % 3 + F.when(F.get_json_object("props", "$.k").cast("bigint") % 17 == 0, 1).otherwise(0)
    frames = table(spark, folder, "events").groupBy((F.col("user_id") % 10).alias("label"), (slot / 4.0).alias("time")).agg(F.min(face).alias("face"))
    faces = C.face_intervals(frames, ["label"], "time", "face", 0.6, F.floor(F.col("time") / 600))
    out = C.joint_speakers(audio_chunks(spark, folder), faces, ["label"], "vec_id", "embedding", "speaker", "face")
    return out.select(big("label"), big("vec_id"), big("speaker"))
