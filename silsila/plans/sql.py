"""Pieces of the SQL oracles."""

from ..functions.text import ENGLISH_STOP_WORDS
from ..sources.corpus import SQL as CORPUS

_STOPS = "[" + ", ".join(f"'{w}'" for w in ENGLISH_STOP_WORDS) + "]"

#: doc_id, slug, words, pairs, ordinal for each document; documents hold no Arabic.
TOKENS = rf"""w AS (SELECT doc_id, source AS slug, row_number() OVER (ORDER BY source, doc_id) - 1 AS ordinal,
  list_filter(list_transform(list_filter(string_split_regex(text, '[^\p{{L}}\p{{N}}]+'), lambda x: regexp_matches(x, '\p{{L}}')), lambda x: lower(x)),
    lambda x: length(x) >= 3 AND NOT list_contains({_STOPS}, x)) AS words FROM documents),
tok AS (SELECT *, CASE WHEN len(words) < 2 THEN [] ELSE list_transform(range(1, len(words)), lambda i: words[i] || ' ' || words[i + 1]) END AS pairs FROM w)"""

POSTINGS = TOKENS + """,
td AS (SELECT DISTINCT ordinal, unnest(list_concat(words, pairs)) AS term FROM tok),
df AS (SELECT term, count(*) AS df FROM td GROUP BY term),
kept AS (SELECT term, df FROM df WHERE df <= greatest(200, floor((SELECT count(*) FROM documents) * CAST(0.12 AS DOUBLE))) AND (NOT contains(term, ' ') OR df >= 3)),
post AS (SELECT term, df, ordinal FROM td JOIN kept USING (term))"""


def fnv(term: str, shards: int) -> str:
    h = f"list_reduce(list_prepend(2166136261::BIGINT, list_transform(string_split({term}, ''), lambda c: unicode(c)::BIGINT)), lambda h, c: (xor(h, c) * 16777619) & 4294967295)"
    return f"(abs(CASE WHEN {h} >= 2147483648 THEN {h} - 4294967296 ELSE {h} END) % {shards})::INT"


def pct(value: str, q: float) -> str:
    return f"list_sort(list({value}))[floor(count(*) * CAST({q} AS DOUBLE))::BIGINT + 1]"


def _sweep(k: int) -> str:
    g = f"g{k - 1}"
    return f"""g{k} AS (SELECT * FROM {g} UNION ALL SELECT id, greatest(1, {pct('v', 0.5)}) AS gen, 'inferred' AS src FROM (
  SELECT later AS id, gen + 1 AS v FROM nb JOIN {g} ON {g}.id = earlier UNION ALL SELECT earlier, gen - 1 FROM nb JOIN {g} ON {g}.id = later) WHERE id NOT IN (SELECT id FROM {g}) GROUP BY id)"""


#: What follows the tables r (reports), k (links) and s (transmitters).
GENERATION_STEPS = (
    f""",
d AS (SELECT id AS report, 'prophet' AS id, 0 AS depth, to_apex AS anchored FROM r WHERE id IN (SELECT id FROM k)
  UNION ALL SELECT k.id, nar, pos + 1, to_apex FROM k JOIN r USING (id)
  UNION ALL SELECT k.id, 'collector:' || slug, n + 1, to_apex FROM k JOIN r USING (id) WHERE pos = n - 1),
gc AS (SELECT id, {pct('depth', 0.1)} AS gen FROM d WHERE anchored GROUP BY id HAVING count(*) >= 3),
cv AS (SELECT tabaqa, {pct('gen', 0.5)} AS v FROM gc JOIN s USING (id) WHERE tabaqa IS NOT NULL GROUP BY tabaqa HAVING count(*) >= 5),
cal AS (SELECT tabaqa, greatest(1, coalesce(max(v) OVER (ORDER BY tabaqa ROWS UNBOUNDED PRECEDING), 1)) AS cal FROM (SELECT unnest(range(1, 13)) AS tabaqa) LEFT JOIN cv USING (tabaqa)),
tv AS (SELECT id, greatest(cal, CASE WHEN tabaqa = 1 THEN 1 ELSE 2 END) AS value FROM s JOIN cal USING (tabaqa)),
g0 AS (SELECT coalesce(gc.id, tv.id) AS id, CASE WHEN value IS NOT NULL AND (gen IS NULL OR value > gen) THEN value ELSE gen END AS gen,
  CASE WHEN value IS NOT NULL AND (gen IS NULL OR value > gen) THEN 'tabaqa' ELSE 'chains' END AS src FROM gc FULL JOIN tv ON gc.id = tv.id),
nb AS (SELECT DISTINCT a.id AS earlier, b.id AS later FROM d a JOIN d b ON a.report = b.report AND b.depth = a.depth + 1 WHERE a.id <> b.id),
"""
    + ",\n".join(_sweep(k) for k in (1, 2, 3, 4))
    + f""",
gp AS (SELECT * FROM g4 UNION ALL SELECT id, greatest(1, {pct('depth', 0.1)}), 'position' FROM d WHERE id NOT IN (SELECT id FROM g4) GROUP BY id),
lm0 AS (SELECT gen, {pct('died', 0.9)} AS late FROM gp JOIN s USING (id) WHERE src = 'chains' AND died IS NOT NULL GROUP BY gen HAVING count(*) >= 20),
lm AS (SELECT gen, max(late) OVER (ORDER BY gen) AS closes FROM lm0),
sp AS (SELECT coalesce({pct('gap', 0.5)}, 0) AS span FROM (SELECT closes - lag(closes) OVER (ORDER BY gen) AS gap FROM lm) WHERE gap IS NOT NULL),
lb AS (SELECT max(gen) + 1 AS late FROM gp),
fl AS (SELECT gp.id, min(lm.gen) AS floor FROM gp JOIN s USING (id) JOIN lm ON died <= closes + (SELECT span FROM sp) GROUP BY gp.id),
gd AS (SELECT gp.id, CASE WHEN mv THEN fl ELSE gen END AS gen, CASE WHEN mv THEN 'dates' ELSE src END AS src FROM (
  SELECT gp.*, coalesce(floor, (SELECT late FROM lb)) AS fl, died IS NOT NULL AND (SELECT span FROM sp) > 0 AND coalesce(floor, (SELECT late FROM lb)) > gp.gen AS mv
  FROM gp LEFT JOIN s USING (id) LEFT JOIN fl USING (id)) gp),
gs AS (SELECT gd.id, gd.gen, gd.src, coalesce(q.sub, 0.5::DOUBLE) AS sub FROM gd LEFT JOIN (
  SELECT id, CASE WHEN count(*) OVER (PARTITION BY gen) = 1 THEN 0.5::DOUBLE ELSE (row_number() OVER (PARTITION BY gen ORDER BY died, id) - 1)::DOUBLE / (count(*) OVER (PARTITION BY gen) - 1) END AS sub
  FROM gd JOIN s USING (id) WHERE died IS NOT NULL) q USING (id)),
reg AS (SELECT gs.id, CASE WHEN gs.id = 'prophet' THEN 0 ELSE gen END AS gen, CASE WHEN gs.id = 'prophet' THEN 'chains' ELSE src END AS src, sub, coalesce(woman, false) AS woman FROM gs LEFT JOIN s USING (id))"""
)

GENERATIONS = CORPUS + GENERATION_STEPS

KINDS = (
    GENERATIONS
    + """,
wk AS (SELECT st.id, b.gen + CAST(0.66 AS DOUBLE) * b.sub - (a.gen + CAST(0.66 AS DOUBLE) * a.sub) AS diff FROM steps st JOIN reg a ON a.id = st.src JOIN reg b ON b.id = st.dst),
sh AS (SELECT id, bool_or(abs(diff) > CAST(0.02 AS DOUBLE) AND diff < 0) AS backward, bool_or(abs(diff) <= CAST(0.02 AS DOUBLE)) AS peer FROM wk GROUP BY id),
wo AS (SELECT DISTINCT k.id FROM k JOIN s ON k.nar = s.id WHERE woman),
sz AS (SELECT id, max(n) AS n FROM k GROUP BY id),
kd AS (SELECT r.id, r.slug, list_concat(
    CASE WHEN grade IS NULL THEN [] WHEN contains(lower(grade), 'munkar') THEN ['munkar'] ELSE
      list_concat(CASE WHEN contains(lower(grade), 'da''if') THEN ['daif'] ELSE [] END, CASE WHEN contains(lower(grade), 'hasan') THEN ['hasan'] ELSE [] END, CASE WHEN contains(lower(grade), 'sahih') THEN ['sahih'] ELSE [] END) END,
    CASE WHEN NOT to_apex THEN ['unreached'] ELSE [] END, CASE WHEN wo.id IS NOT NULL THEN ['women'] ELSE [] END,
    CASE WHEN sz.n <= 3 THEN ['high'] ELSE [] END, CASE WHEN backward THEN ['backward'] ELSE [] END, CASE WHEN peer THEN ['peer'] ELSE [] END) AS kinds,
    coalesce(sz.n, 0) AS n
  FROM r LEFT JOIN sh USING (id) LEFT JOIN wo USING (id) LEFT JOIN sz USING (id))"""
)


def matches(chosen: list[str], column: str = "kinds") -> str:
    from ..operators.chains import KIND_GROUPS

    groups = [[k for k in g if k in chosen] for g in KIND_GROUPS.values()]
    return " AND ".join(f"list_has_any({column}, [{', '.join(repr(k) for k in g)}])" for g in groups if g) or "true"
