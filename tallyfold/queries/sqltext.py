"""SQL that says what the column builders say, for the checks against another engine."""

from ..functions import fixed
from ..sources.views import ASOF, AWARDS_SQL, LIVE_SQL, SIGNALS_SQL

DAY = f"DATE '{ASOF}'"


def sq(x: str, half: float) -> str:
    return f"(CASE WHEN ({x}) > 0 THEN ({x}) / (({x}) + {half}) ELSE 0.0 END)"


def over(x: str, floor: float, half: float) -> str:
    return sq(f"greatest(coalesce({x}, 0) - {floor}, 0)", half)


def half_life(family: str = "family") -> str:
    return f"(CASE {family} {' '.join(f"WHEN '{k}' THEN {v}" for k, v in fixed.HALF_LIFE.items())} ELSE {fixed.OTHER_HALF_LIFE} END)"


def live(asof: str = DAY, strength: str = "strength", day: str = "occurred_at") -> str:
    age = f"date_diff('day', {day}, {asof})"
    return f"(CASE WHEN {age} < -1 THEN 0.0 ELSE {strength} * pow(0.5, greatest({age}, 0) / {half_life()}) END)"


def families(asof: str = DAY, name: str = "fam") -> str:
    """CTEs: signals, and a row per entity with each family's strength as of the date."""
    cells = ", ".join(f"round(1 - product(CASE WHEN family = '{f}' AND live > {fixed.LIVE} THEN 1 - least(greatest(live, 0), 1) ELSE 1 END), 4) AS {f}" for f in fixed.FAMILIES)
    return f"{name}_live AS (SELECT *, {live(asof)} AS live FROM signals), {name} AS (SELECT entity_id, {cells} FROM {name}_live GROUP BY entity_id)"


MOMENTUM = "round(1 - " + " * ".join(f"(1 - least(greatest(least({fixed.FAMILY_CAP}, {fixed.WEIGHT[f]} * {fixed.FAMILY_GAIN} * {f}), 0), 1))" for f in fixed.FAMILIES) + ", 4)"
CONVERGENCE = "(" + " + ".join(f"CAST({f} >= {fixed.FIRING} AS INTEGER)" for f in fixed.FAMILIES) + ")"
EDGE = f"round(100.0 * momentum * (CASE WHEN convergence < 2 THEN {fixed.UNCORROBORATED} ELSE 1.0 END), 2)"


def scored(asof: str = DAY, name: str = "scored") -> str:
    return f"{families(asof, name + '_fam')}, {name}_m AS (SELECT *, {MOMENTUM} AS momentum, {CONVERGENCE} AS convergence FROM {name}_fam), {name} AS (SELECT *, {EDGE} AS edge FROM {name}_m)"


SIG, AW = f"WITH {SIGNALS_SQL}", f"WITH {AWARDS_SQL}"


def measured(weeks: int, known: str = "", factors: str = "1.0 AS fit, 1.0 AS earliness, 1.0 AS team") -> str:
    """CTEs up to `edges`: entity_id, d, momentum, convergence, edge of each of the last weeks, from all signals. `known` are CTEs of its own, the last of which is `k`, to be joined."""
    cells = ", ".join(f"round(1 - product(CASE WHEN family = '{f}' AND live > {fixed.LIVE} THEN 1 - least(greatest(live, 0), 1) ELSE 1 END), 4) AS {f}" for f in fixed.FAMILIES)
    join = "LEFT JOIN k USING (entity_id)" if known else ""
    return f"""WITH asofs AS (SELECT {DAY} - CAST(7 * k AS INTEGER) AS d FROM (SELECT unnest(range({weeks})) AS k)), {LIVE_SQL.format(half=half_life())},
fam AS (SELECT entity_id, d, {cells} FROM counted GROUP BY entity_id, d),
every AS (SELECT e.entity_id, a.d, {', '.join(f'coalesce({f}, 0) AS {f}' for f in fixed.FAMILIES)} FROM (SELECT DISTINCT entity_id FROM (SELECT entity_id FROM signals UNION ALL SELECT entity_id FROM weekly)) e CROSS JOIN asofs a LEFT JOIN fam USING (entity_id, d)){', ' + known if known else ''},
edges AS (SELECT entity_id, d, momentum, convergence, fit, earliness, team, round(100.0 * momentum * (0.25 + 0.75 * fit) * (0.4 + 0.6 * earliness) * (0.85 + 0.15 * team) * (CASE WHEN convergence < 2 THEN {fixed.UNCORROBORATED} ELSE 1.0 END), 2) AS edge
  FROM (SELECT entity_id, d, {MOMENTUM} AS momentum, {CONVERGENCE} AS convergence, {factors} FROM every {join}))"""


def cohorts(name: str, source: str, k: str, r: str, q: str) -> str:
    """CTEs: name_p, rows in order of rank (k, r, q, i) and name_e, with the places low to high - 1 of each row's cohort."""
    return f"""{name}_o AS (SELECT {k} AS k, {r} AS r, {q} AS q FROM {source}), {name}_p AS (SELECT *, row_number() OVER (ORDER BY r, q, k) - 1 AS i, rank() OVER (ORDER BY r) - 1 AS mid FROM {name}_o),
{name}_a AS (SELECT p.k, count(b.k) AS low FROM {name}_p p LEFT JOIN {name}_o b ON b.r * 1.5 < p.r GROUP BY 1), {name}_z AS (SELECT p.k, count(*) AS high FROM {name}_p p JOIN {name}_o b ON b.r <= p.r * 1.5 GROUP BY 1),
{name}_e AS (SELECT p.*, greatest(low, mid - 2000) AS low, least(high, mid + 2000) AS high FROM {name}_p p JOIN {name}_a USING (k) JOIN {name}_z USING (k))"""
