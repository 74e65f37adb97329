"""The registered queries as SQL for DuckDB, over the same tables.

``tus`` is a time in microseconds.
"""

from __future__ import annotations

from veilcount.constants import BUDGET_TEXT, BUILDERS, CATEGORIES, COUNT_LADDER, DOMINANCE_TEXT, NO_CONSENT_TEXT, UNKNOWN_METRIC_TEXT
from veilcount.functions.identity import padded
from veilcount.sources.fixtures import BUILDER_CYCLE, HOSTS, JURISDICTIONS, NONCE, ROOT, SECRET, VERTICALS, ZONES

DAY = 86_400_000_000
ORACLES: dict[str, str] = {}


def cycle(values: tuple[str, ...], number: str) -> str:
    return f"[{', '.join(repr(v) for v in values)}][({number}) % {len(values)} + 1]"


APP = f"""ev AS (SELECT 'ws_' || (user_id % 12) AS workspace_id, 'e' || event_id AS event_id, event_id AS seq, user_id, user_id::VARCHAR AS subject_key, event_type AS name, epoch_us(ts) AS tus,
  {cycle(BUILDER_CYCLE, "user_id % 12")} AS builder, user_id % 10 <> 0 AND NOT (user_id % 15 = 0 AND epoch_us(ts) >= 1704931200000000) AS shares, {cycle(JURISDICTIONS, "user_id")} AS jurisdiction FROM events),
config AS (SELECT 'ws_' || i AS workspace_id, {cycle(VERTICALS, "i")} AS vertical FROM range(12) t(i))"""

SHOP = f"""ev AS (SELECT 'n_' || c_nationkey AS workspace_id, o_custkey::VARCHAR AS subject_key, lower(o_orderpriority) AS name, epoch_us(o_orderdate) AS tus,
  {cycle(BUILDER_CYCLE, "c_nationkey")} AS builder, o_custkey % 10 <> 0 AND NOT (o_custkey % 15 = 0 AND epoch_us(o_orderdate) >= 883612800000000) AS shares FROM orders JOIN customer ON o_custkey = c_custkey),
config AS (SELECT 'n_' || n_nationkey AS workspace_id, lower(replace(r_name, ' ', '_')) AS vertical FROM nation JOIN region ON n_regionkey = r_regionkey)"""

MARKET = f"""ev AS (SELECT 'm_' || (l_partkey % 60) AS workspace_id, l_orderkey::VARCHAR AS subject_key, lower(l_returnflag) AS name, epoch_us(l_shipdate) AS tus, {cycle(BUILDER_CYCLE, "l_partkey % 60")} AS builder, l_orderkey % 10 <> 0 AS shares FROM lineitem),
config AS (SELECT 'm_' || no AS workspace_id, {cycle(VERTICALS, "no")} AS vertical, coalesce(CASE WHEN version % 11 <> 0 THEN no % 6 <> 5 END, false) AND no % 20 <> 7 AS member FROM (SELECT p_partkey % 60 AS no, max(p_partkey) AS version FROM part GROUP BY 1))"""

WEEK, MONTH = "%G-W%V", "%Y-%m"


def act(event: str, days: int) -> tuple[int, str, str]:
    return days, "true", f"coalesce(min(tus) FILTER (WHERE name = '{event}') - min(first_at) <= {days * DAY}, false)"


def ret(a: int, b: int) -> tuple[int, str, str]:
    return b + 1, "true", f"bool_or((tus - first_at) // {DAY} BETWEEN {a} AND {b})"


def conv(start: str, to: str, days: int | None) -> tuple[int, str, str]:
    begin = f"start_at['{start}']"
    end = f"min(tus) FILTER (WHERE name = '{to}' AND tus >= {begin})"
    done = f"{end} IS NOT NULL" if days is None else f"coalesce({end} - min({begin}) <= {days * DAY}, false)"
    return days or 0, f"min({begin}) IS NOT NULL", done


def facts(metrics: list[tuple[str, tuple[int, str, str]]], starts: tuple[str, ...]) -> str:
    """CTEs facts (one row a subject) from ev."""
    begin = ", ".join(f"'{s}': min(tus) FILTER (WHERE name = '{s}') OVER w" for s in starts) or "'-': NULL::BIGINT"
    flags = ", ".join(f"{q} AS q{i}, {s} AS s{i}" for i, (_, (_, q, s)) in enumerate(metrics))
    return f"""timed AS (SELECT *, min(tus) OVER w AS first_at, MAP {{{begin}}} AS start_at FROM ev WINDOW w AS (PARTITION BY workspace_id, subject_key)),
subject AS (SELECT workspace_id, subject_key, min(tus) AS first_at, max(tus) AS last_at, bool_and(shares) AS consented, {flags} FROM timed GROUP BY ALL),
facts AS (SELECT *, max(last_at) OVER (PARTITION BY workspace_id) AS now_at FROM subject)"""


def rows(metrics: list[tuple[str, tuple[int, str, str]]], label: str) -> str:
    """CTE long from facts."""
    each = [
        f"SELECT workspace_id, period, (SELECT count(*) FROM placed p WHERE p.workspace_id = f.workspace_id AND p.period = f.period) AS subjects, '{name}' AS metric, (count(*) FILTER (WHERE s{i}))::DOUBLE / count(*) AS value, count(*) AS subject_count FROM placed f WHERE q{i} AND now_at - first_at >= {days * DAY} GROUP BY workspace_id, period"
        for i, (name, (days, _, _)) in enumerate(metrics)
    ]
    return f"placed AS (SELECT *, strftime(make_timestamp(first_at), '{label}') AS period FROM facts WHERE consented),\nlong AS ({' UNION ALL '.join(each)})"


OBSERVED = """ranked AS (SELECT workspace_id, period, builder, row_number() OVER (PARTITION BY workspace_id, period ORDER BY n DESC, builder) AS k
  FROM (SELECT workspace_id, period, builder, count(*) AS n FROM ev JOIN placed USING (workspace_id, subject_key) WHERE builder <> 'unknown' GROUP BY ALL)),
obs AS (SELECT l.workspace_id, coalesce(r.builder, 'unknown') AS builder, vertical, CASE WHEN subjects <= 100 THEN '1-100' WHEN subjects <= 1000 THEN '100-1k' WHEN subjects <= 10000 THEN '1k-10k' WHEN subjects <= 100000 THEN '10k-100k' ELSE '100k+' END AS size_bucket, l.period, metric, value, subject_count
  FROM long l JOIN config USING (workspace_id) LEFT JOIN ranked r ON r.workspace_id = l.workspace_id AND r.period = l.period AND k = 1)"""

APP_METRICS = [("activation_rate", act("purchase", 1)), ("d7_retention", ret(5, 9)), ("view_to_purchase_conversion", conv("view", "purchase", 7))]
SHOP_METRICS = [("activation_rate", act("1-urgent", 90)), ("d180_retention", ret(30, 180)), ("1-urgent_to_2-high_conversion", conv("1-urgent", "2-high", None))]
APP_OBS = f"WITH {APP}, {facts(APP_METRICS, ('view',))}, {rows(APP_METRICS, WEEK)}, {OBSERVED}"
MARKET_METRICS = [("return_rate", act("r", 30)), ("activation_rate", act("n", 30))]
MARKET_OBS = f"WITH {MARKET}, {facts(MARKET_METRICS, ())}, {rows(MARKET_METRICS, MONTH)}, {OBSERVED}"
SHOP_OBS = f"WITH {SHOP}, {facts(SHOP_METRICS, ('1-urgent',))}, {rows(SHOP_METRICS, MONTH)}, {OBSERVED}"


def one(events: str, metric: tuple[str, tuple[int, str, str]], starts: tuple[str, ...], label: str) -> str:
    return f"WITH {events}, {facts([metric], starts)}, {rows([metric], label)} SELECT workspace_id, period, metric, value, subject_count FROM long"


ORACLES["insights_event_counts"] = f"WITH {APP} SELECT workspace_id, name, count(*) AS events FROM ev GROUP BY ALL"
ORACLES["insights_subjects"] = f"WITH {APP} SELECT workspace_id, count(DISTINCT subject_key) AS distinct_subjects, count(*) AS total_events FROM ev GROUP BY ALL"
ORACLES["insights_sketched"] = f"""WITH {SHOP}, p AS (SELECT workspace_id, subject_key, unnest(['all', strftime(make_timestamp(tus), '{WEEK}')]) AS period FROM ev)
SELECT workspace_id, period, count(DISTINCT subject_key) AS exact, count(*) AS total_events, true AS near FROM p GROUP BY ALL"""
ORACLES["period_labels"] = f"WITH {SHOP} SELECT strftime(make_timestamp(tus), '{WEEK}') AS week, strftime(make_timestamp(tus), '{MONTH}') AS month, count(*) AS events FROM ev GROUP BY ALL"
ORACLES["subject_timelines"] = f"WITH {APP} SELECT workspace_id, subject_key, min(tus) AS first_at, max(tus) AS last_at, count(*) AS events, arg_min(name, (tus, name)) AS first_name FROM ev GROUP BY ALL"
ORACLES["unanimous_consent"] = f"WITH {APP}, s AS (SELECT workspace_id, subject_key, bool_and(shares) AS consented FROM ev GROUP BY ALL) SELECT workspace_id, consented, count(*) AS subjects FROM s GROUP BY ALL"
ORACLES["activation_weekly"] = one(APP, APP_METRICS[0], (), WEEK)
ORACLES["retention_d7"] = one(APP, APP_METRICS[1], (), WEEK)
ORACLES["conversion_funnel"] = one(APP, APP_METRICS[2], ("view",), WEEK)
ORACLES["custom_metric_power_users"] = one(APP, ("power_users", (0, "min(start_at['click']) IS NOT NULL", "count(*) >= 10")), ("click",), WEEK)
ORACLES["rollup_observations"] = f"{APP_OBS} SELECT *, concat_ws('|', builder, vertical, size_bucket, period) AS cohort_key FROM obs"
ORACLES["rollup_incremental"] = f"{APP_OBS} SELECT * FROM obs"
ORACLES["rollup_shop_observations"] = f"{SHOP_OBS} SELECT * FROM obs"
ORACLES["rollup_counters"] = f"""WITH {APP}, s AS (SELECT workspace_id, subject_key, bool_and(shares) AS ok, count(*) AS n FROM ev GROUP BY ALL)
SELECT workspace_id, CASE WHEN own THEN seen ELSE 0 END AS subjects_seen, CASE WHEN own THEN missing ELSE 0 END AS subjects_without_consent, CASE WHEN own THEN 0 ELSE n END AS foreign_events_dropped
FROM (SELECT workspace_id, workspace_id NOT IN ('ws_3', 'ws_7') AS own, count(*) AS seen, count(*) FILTER (WHERE NOT ok) AS missing, sum(n)::BIGINT AS n FROM s GROUP BY ALL)"""
ORACLES["latest_values"] = f"{SHOP_OBS} SELECT workspace_id, metric, max(period) AS period, arg_max(value, period) AS value FROM obs GROUP BY ALL"

BREADTHS = ("exact", "all_builders", "all_builders_all_sizes", "all_ai_built_apps")
_EXACT_LABEL = "builder || '-built ' || replace(vertical, '_', ' ') || ' apps at ' || size_bucket || ' users'"
_LABELS = (_EXACT_LABEL, "'all AI-built ' || replace(vertical, '_', ' ') || ' apps at ' || size_bucket || ' users'", "'all AI-built ' || replace(vertical, '_', ' ') || ' apps of any size'", "'all AI-built apps of any size'")


def rungs(source: str, rest: str) -> str:
    """Every row of ``source`` tus its four rungs."""
    out = []
    for depth, label in enumerate(_LABELS):
        b, z, v = ("'any'" if depth > i else c for i, c in enumerate(("builder", "size_bucket", "vertical")))
        out.append(f"SELECT {rest}builder AS exact_builder, vertical AS exact_vertical, size_bucket AS exact_size_bucket, period AS exact_period, {depth} AS depth, '{BREADTHS[depth]}' AS breadth, {label} AS label, {b} AS builder, {v} AS vertical, {z} AS size_bucket, period FROM {source}")
    return " UNION ALL ".join(out)


def verdicts(source: str, keys: str, n: int, s: int, share: float) -> str:
    return f"""SELECT {keys}, contributor_count, subject_count, reason IS NULL AS ok, reason, coalesce(CASE reason WHEN 'too_few_contributors' THEN {n} - contributor_count WHEN 'too_few_subjects' THEN {s} - subject_count WHEN 'contributor_dominance' THEN ceil(largest / {share}::DOUBLE)::BIGINT - subject_count END, 0)::BIGINT AS shortfall
FROM (SELECT *, CASE WHEN contributor_count < {n} THEN 'too_few_contributors' WHEN subject_count < {s} THEN 'too_few_subjects' WHEN subject_count > 0 AND largest::DOUBLE / subject_count > {share}::DOUBLE THEN 'contributor_dominance' END AS reason
  FROM (SELECT {keys}, count(*) AS contributor_count, sum(x)::BIGINT AS subject_count, max(x)::BIGINT AS largest FROM (SELECT {keys}, workspace_id, sum(subject_count) AS x FROM {source} GROUP BY ALL) GROUP BY ALL))"""


_WHY = f"CASE reason WHEN 'too_few_contributors' THEN 'Waiting for ' || shortfall || ' more comparable app(s).' WHEN 'too_few_subjects' THEN 'Waiting for ' || shortfall || ' more users in this group.' WHEN 'contributor_dominance' THEN '{DOMINANCE_TEXT}' END"
_COHORT = "builder, vertical, size_bucket, period"
ORACLES["cohort_ladder"] = f"{SHOP_OBS}, c AS (SELECT DISTINCT {_COHORT} FROM obs) {rungs('c', '')}"
ORACLES["k_anonymity"] = f"{SHOP_OBS}, r AS ({rungs('obs', 'workspace_id, metric, subject_count, ')}), v AS ({verdicts('r', _COHORT + ', metric', 10, 100, 0.34)}) SELECT *, {_WHY} AS explanation FROM v"


def _attempts(n: int, s: int, share: float) -> str:
    return f"""{SHOP_OBS}, r AS ({rungs("obs", "workspace_id, metric, subject_count, ")}), v AS ({verdicts("r", _COHORT + ", metric", n, s, share)}),
c AS (SELECT DISTINCT {_COHORT}, metric FROM obs), asked AS ({rungs("c", "metric, ")}),
tried AS (SELECT * FROM (SELECT *, min(depth) FILTER (WHERE ok) OVER (PARTITION BY exact_builder, exact_vertical, exact_size_bucket, exact_period, metric) AS chosen FROM asked JOIN v USING ({_COHORT}, metric)) WHERE depth <= coalesce(chosen, 3))"""


def _narrowest(n: int, s: int, share: float) -> str:
    exact = "exact_builder || '-built ' || replace(exact_vertical, '_', ' ') || ' apps at ' || exact_size_bucket || ' users'"
    sentence = f"CASE WHEN NOT ok THEN {_WHY} WHEN depth > 0 THEN 'Shown for ' || label || ', since your own group (' || {exact} || ') is too small to stay anonymous.' ELSE 'Shown for ' || label || '.' END"
    return f"{_attempts(n, s, share)} SELECT exact_builder, exact_vertical, exact_size_bucket, exact_period, metric, ok AS resolved, {_COHORT}, breadth, label, contributor_count, subject_count, ok AND depth > 0 AS widened, {sentence} AS sentence FROM tried WHERE depth = coalesce(chosen, 3)"


ORACLES["narrowest_cohort"] = _narrowest(10, 100, 0.34)
ORACLES["narrowest_cohort_defaults"] = _narrowest(10, 500, 0.34)
ORACLES["narrowest_cohort_low"] = _narrowest(4, 20, 0.5)
ORACLES["cohort_attempts"] = f"{_attempts(4, 20, 0.5)} SELECT breadth, ok, reason, count(*) AS attempts, sum(shortfall)::BIGINT AS shortfall FROM tried GROUP BY ALL"
_LADDER = f"coalesce(list_max(list_filter([{', '.join(map(str, COUNT_LADDER))}]::BIGINT[], lambda s: s <= {{n}})), 0)"
ORACLES["generalised_counts"] = f"WITH {SHOP} SELECT workspace_id, name, {_LADDER.format(n='n')} AS events FROM (SELECT workspace_id, name, count(*) AS n FROM ev GROUP BY ALL)"


def uniform(*what: str) -> str:
    return f"((('0x' || substr(sha256('{SECRET}|{NONCE}|' || concat_ws('|', {', '.join(what)})), 1, 12))::BIGINT + 0.5) / 281474976710656.0::DOUBLE)"


def laplace(scale: str, u: str) -> str:
    return f"(-({scale}) * sign({u} - 0.5) * ln(1 - 2 * abs({u} - 0.5)))"


def means(source: str, keys: str, epsilon: float) -> str:
    u = uniform(*[k.strip() + "::VARCHAR" for k in keys.split(",")], "'mean'")
    return f"SELECT {keys}, n, least(1.0::DOUBLE, greatest(0.0::DOUBLE, t / n + {laplace(f'1.0::DOUBLE / n / {epsilon!r}::DOUBLE', u)})) AS mean FROM (SELECT {keys}, count(*) AS n, sum(least(1.0, greatest(0.0, value))::DECIMAL(28,12))::DOUBLE AS t FROM {source} GROUP BY ALL)"


def quantiles(source: str, keys: str, epsilon: float) -> str:
    k = [x.strip() + "::VARCHAR" for x in keys.split(",")]
    return f"""SELECT {keys}, list_sort(list(least(1.0::DOUBLE, greatest(0.0::DOUBLE, a + {uniform(*k, "'place'", "q::VARCHAR")} * (b - a))))) AS ladder FROM (
  SELECT *, row_number() OVER (PARTITION BY {keys}, q ORDER BY ln(b - a) - {epsilon!r}::DOUBLE * abs(i - q * n) / 2 - ln(-ln({uniform(*k, "'gap'", "q::VARCHAR", "i::VARCHAR")})) DESC) AS best FROM (
    SELECT {keys}, n, i, a, b FROM (
      SELECT {keys}, count(*) OVER g AS n, row_number() OVER o AS i, z AS a, coalesce(lead(z) OVER o, 1.0) AS b FROM (SELECT {keys}, workspace_id, least(1.0, greatest(0.0, value)) AS z FROM {source}) WINDOW o AS (PARTITION BY {keys} ORDER BY z, workspace_id), g AS (PARTITION BY {keys})
      UNION ALL SELECT {keys}, count(*) AS n, 0 AS i, 0.0 AS a, min(least(1.0, greatest(0.0, value))) AS b FROM {source} GROUP BY {keys}
    ) WHERE b > a
  ) CROSS JOIN (VALUES (0.1::DOUBLE), (0.25), (0.5), (0.75), (0.9)) t(q)
) WHERE best = 1 GROUP BY {keys}"""


_POINTS = ", ".join(f"round(ladder[{i + 1}], 6) AS p{q}" for i, q in enumerate((10, 25, 50, 75, 90)))
ORACLES["noisy_mean"] = f"{SHOP_OBS}, m AS ({means('obs', 'period, metric', 0.5)}) SELECT period, metric, n, round(mean, 6) AS mean FROM m"
ORACLES["noisy_count"] = f"WITH {APP}, c AS (SELECT workspace_id, name, count(*) AS n FROM ev GROUP BY ALL) SELECT workspace_id, name, greatest(0, floor(n + {laplace('10.0::DOUBLE', uniform('workspace_id', 'name', chr(39) + 'count' + chr(39)))} + 0.5))::BIGINT AS noisy_count FROM c"
ORACLES["dp_quantiles"] = f"{SHOP_OBS}, q AS ({quantiles('obs', 'period, metric', 0.5)}) SELECT period, metric, {_POINTS} FROM q"
ORACLES["privacy_budget"] = """WITH RECURSIVE r AS (SELECT o_custkey::VARCHAR AS k, o_orderkey AS request, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderkey) AS i, ((o_orderkey % 7 + 1) * 0.05::DOUBLE)::DECIMAL(18,9) AS e FROM orders),
f AS (SELECT DISTINCT k, 0::BIGINT AS i, 0::DECIMAL(18,9) AS used, true AS ok, 0::BIGINT AS request FROM r
  UNION ALL SELECT r.k, r.i, (CASE WHEN used + e <= 1 THEN used + e ELSE used END)::DECIMAL(18,9), used + e <= 1, r.request FROM f JOIN r ON r.k = f.k AND r.i = f.i + 1)
SELECT k AS budget_key, request, ok AS granted FROM f WHERE i > 0"""

CANONICAL = "concat_ws('|', subject_key, purpose, state, source, tus::VARCHAR, jurisdiction, notice_version)"
RECORDS = f"""rec AS (SELECT workspace_id, seq, subject_key, ['product_analytics', 'benchmark_contribution', 'coop_licensing'][seq % 3 + 1] AS purpose, CASE WHEN seq % 7 = 0 THEN 'withdrawn' WHEN seq % 5 = 0 THEN 'denied' ELSE 'granted' END AS state,
  CASE WHEN seq % 11 = 0 THEN 'workspace_default' WHEN seq % 13 = 0 THEN 'gpc' ELSE 'explicit_ui' END AS source, tus, jurisdiction, 'v1' AS notice_version FROM ev WHERE name = 'signup')"""
CHAIN = f"""{RECORDS}, lane AS (SELECT *, row_number() OVER (PARTITION BY workspace_id ORDER BY tus, seq) - 1 AS place FROM rec),
chain AS (SELECT workspace_id, -1::BIGINT AS place, 0::BIGINT AS seq, repeat('0', 64) AS hash FROM lane GROUP BY workspace_id
  UNION ALL SELECT l.workspace_id, l.place, l.seq, sha256(c.hash || '|' || {CANONICAL}) FROM chain c JOIN lane l ON l.workspace_id = c.workspace_id AND l.place = c.place + 1)"""
_TREE = "lanes AS (SELECT workspace_id, arg_max(hash, place) AS hash FROM chain GROUP BY 1), l4 AS (SELECT substr(sha256(workspace_id), 1, 4) AS prefix, string_agg(workspace_id || ':' || hash, '|' ORDER BY workspace_id || ':' || hash) AS children FROM lanes GROUP BY 1), " + ", ".join(
    f"l{n} AS (SELECT substr(prefix, 1, {n}) AS prefix, string_agg(prefix || ':' || sha256(children), '|' ORDER BY prefix || ':' || sha256(children)) AS children FROM l{n + 1} GROUP BY 1)" for n in (3, 2, 1, 0)
)
HEAD = f"{_TREE}, head AS (SELECT coalesce((SELECT sha256(children) FROM l0), sha256('')) AS head)"
ORACLES["consent_chain"] = f"WITH RECURSIVE {APP}, {CHAIN} SELECT workspace_id, place, seq, hash FROM chain WHERE place >= 0"
ORACLES["consent_head"] = f"WITH RECURSIVE {APP}, {CHAIN}, {HEAD} SELECT head FROM head"
ORACLES["consent_proofs"] = f"""WITH RECURSIVE {APP}, {CHAIN}, {HEAD}
SELECT workspace_id, level, prefix, children, workspace_id <> 'ws_5' AS included FROM lanes CROSS JOIN range(5) t(level) JOIN ({" UNION ALL ".join(f"SELECT {n} AS level, prefix, children FROM l{n}" for n in range(5))}) USING (level) WHERE prefix = substr(sha256(workspace_id), 1, level::INT)"""
ORACLES["stream_ledger"] = ORACLES["consent_chain"]
ORACLES["consent_differences"] = f"WITH {APP}, {RECORDS} SELECT DISTINCT workspace_id FROM rec WHERE workspace_id = 'ws_1'"
ORACLES["consent_verify"] = f"WITH {APP}, {RECORDS} SELECT workspace_id, CASE WHEN workspace_id = 'ws_1' AND count(*) > 3 THEN 3 END::BIGINT AS broken_at FROM rec GROUP BY workspace_id"
DECIDED = f"""{RECORDS}, own AS (SELECT *, source NOT IN ('workspace_default', 'regulatory_default') AS o FROM rec),
mark AS (SELECT *, bool_or(o) OVER w AS chose, max(CASE WHEN o AND state = 'withdrawn' THEN (tus, seq) END) OVER w AS no FROM own WINDOW w AS (PARTITION BY workspace_id, subject_key, purpose)),
decided AS (SELECT workspace_id, subject_key, purpose, arg_max(state, (tus, seq)) AS state FROM mark WHERE (o OR NOT chose) AND NOT (no IS NOT NULL AND (tus, seq) > no AND state = 'granted' AND source <> 'explicit_ui') GROUP BY ALL),
people AS (SELECT DISTINCT workspace_id, subject_key, jurisdiction FROM ev),
asked AS (SELECT *, CASE WHEN purpose = 'coop_licensing' THEN 'denied' WHEN jurisdiction IN ('US', 'US-CA') THEN 'granted' WHEN purpose = 'product_analytics' THEN 'unknown' ELSE 'denied' END AS posture FROM people CROSS JOIN (VALUES ('product_analytics', 1), ('benchmark_contribution', 2), ('coop_licensing', 3)) t(purpose, rank)),
resolved AS (SELECT workspace_id, subject_key, purpose, rank, jurisdiction, coalesce(state, posture) AS state FROM asked LEFT JOIN decided USING (workspace_id, subject_key, purpose))"""
ORACLES["consent_resolve"] = f"WITH {APP}, {DECIDED} SELECT workspace_id, subject_key, purpose, jurisdiction, state FROM resolved"
ORACLES["permitted_purposes"] = f"WITH {APP}, {DECIDED} SELECT workspace_id, subject_key, coalesce(string_agg(purpose, ',' ORDER BY rank) FILTER (WHERE state = 'granted'), '') AS purposes FROM resolved GROUP BY ALL"
ORACLES["withdraw_all"] = f"WITH {APP} SELECT 0 AS purposes, count(DISTINCT (workspace_id, subject_key)) AS subjects FROM ev WHERE user_id % 20 = 3"


def gate() -> str:
    """CTEs passed (releases without a stamp) and held, from the market's observations."""
    keys = f"{_COHORT}, metric, request"
    return f"""{MARKET_OBS.replace("WITH ", "WITH RECURSIVE ", 1)}, r AS ({rungs("obs", "workspace_id, metric, value, subject_count, ")}),
asked AS (SELECT DISTINCT {_COHORT}, metric, 1 AS request FROM r WHERE builder = 'any' AND size_bucket = 'any'),
pool AS (SELECT r.*, 1 AS request FROM r WHERE workspace_id IN (SELECT workspace_id FROM config WHERE member)),
v AS ({verdicts("pool", _COHORT + ", metric", 10, 15, 0.34)}),
judged AS (SELECT asked.*, contributor_count, subject_count, shortfall, CASE WHEN ok IS NULL THEN 'no_consented_observations' ELSE reason END AS reason FROM asked LEFT JOIN v USING ({_COHORT}, metric)),
rows_ AS (SELECT pool.* FROM pool JOIN judged USING ({keys}) WHERE judged.reason IS NULL),
q AS ({quantiles("rows_", keys, 0.6 / 6)}), m AS ({means("rows_", keys, 0.6 / 6)}),
passed AS (SELECT {keys}, {_LADDER.format(n="contributor_count")} AS contributor_count, {_LADDER.format(n="subject_count")} AS subject_count, {_POINTS}, round(mean, 6) AS mean, 0.6::DOUBLE AS epsilon_spent FROM judged JOIN q USING ({keys}) JOIN m USING ({keys}) WHERE reason IS NULL)"""


ORACLES["gate_releases"] = f"{gate()} SELECT * FROM passed"
ORACLES["gate_spends"] = f"{gate()} SELECT concat_ws('|', {_COHORT}) || '::' || metric AS budget_key, epsilon_spent AS epsilon FROM passed"
ORACLES["gate_second_run"] = f"{gate()} SELECT {_COHORT}, metric, coalesce(reason, 'privacy_budget_exhausted') AS reason FROM judged"
ORACLES["provenance_check"] = f"{gate()} SELECT {_COHORT}, metric FROM passed WHERE metric = 'return_rate'"
ORACLES["release_sink"] = f"{gate()} SELECT CASE WHEN reason IS NULL THEN 'releases' ELSE 'suppressions' END AS kind, metric, count(*) AS cohorts FROM judged GROUP BY ALL"
ORACLES["observation_sink"] = f"{SHOP_OBS} SELECT period, count(*) AS observations, sum(subject_count)::BIGINT AS subjects FROM obs WHERE metric = 'activation_rate' GROUP BY ALL"
ORACLES["gate_suppressions"] = f"{gate()} SELECT {_COHORT}, metric, request, reason, CASE WHEN reason = 'no_consented_observations' THEN '{NO_CONSENT_TEXT}' ELSE {_WHY} END AS explanation FROM judged WHERE reason IS NOT NULL"


def hardened() -> str:
    """CTEs granted and held: by vertical first, each metric in turn, then all verticals together, as far as every member has 0.4 of 1 left."""
    key = f"{_COHORT}, metric"
    return f"""{MARKET_OBS.replace("WITH ", "WITH RECURSIVE ", 1)}, r0 AS ({rungs("obs", "workspace_id, metric, value, subject_count, ")}), r AS (SELECT * FROM r0 WHERE depth >= 2),
asked0 AS (SELECT DISTINCT {key} FROM r UNION ALL SELECT DISTINCT {_COHORT}, 'return_rate ' FROM r WHERE vertical = 'any'),
asked AS (SELECT *, replace(period, '-', '')::BIGINT * 1000 + rank() OVER (PARTITION BY period ORDER BY vertical = 'any', metric, vertical) AS request FROM asked0),
pool AS (SELECT {key}, workspace_id, sum(greatest(0, least(1, value))::DECIMAL(20,12)::DECIMAL(38,12) * subject_count)::DOUBLE / sum(subject_count) AS value, sum(subject_count) AS subject_count FROM r WHERE workspace_id IN (SELECT workspace_id FROM config WHERE member) GROUP BY ALL),
v AS ({verdicts("pool", key, 10, 15, 0.34)}),
fit AS (SELECT asked.*, shortfall, CASE WHEN metric = 'return_rate ' THEN 'unknown_metric' WHEN ok IS NULL THEN 'no_consented_observations' ELSE reason END AS reason FROM asked LEFT JOIN v USING ({key})),
who AS (SELECT workspace_id, {key}, request FROM pool JOIN fit USING ({key}) WHERE reason IS NULL),
s2 AS (SELECT workspace_id, period, 400 * count(*) AS used FROM who WHERE vertical <> 'any' GROUP BY ALL),
a3 AS (SELECT w.period, max(coalesce(used, 0)) + 400 <= 1000 AS yes FROM who w LEFT JOIN s2 USING (workspace_id, period) WHERE vertical = 'any' AND metric = 'activation_rate' GROUP BY 1),
s3 AS (SELECT workspace_id, period, sum(used) AS used FROM (SELECT * FROM s2 UNION ALL SELECT w.workspace_id, w.period, 400 FROM who w JOIN a3 USING (period) WHERE vertical = 'any' AND metric = 'activation_rate' AND yes) GROUP BY ALL),
b3 AS (SELECT w.period, max(coalesce(used, 0)) + 400 <= 1000 AS yes FROM who w LEFT JOIN s3 USING (workspace_id, period) WHERE vertical = 'any' AND metric = 'return_rate' GROUP BY 1),
judged AS (SELECT f.* REPLACE (CASE WHEN f.reason IS NULL AND vertical = 'any' AND NOT coalesce(CASE metric WHEN 'activation_rate' THEN a3.yes ELSE b3.yes END, false) THEN 'privacy_budget_exhausted' ELSE f.reason END AS reason) FROM fit f LEFT JOIN a3 USING (period) LEFT JOIN b3 USING (period)),
rows_ AS (SELECT pool.*, judged.request FROM pool JOIN judged USING ({key}) WHERE judged.reason IS NULL)"""


_HKEYS = f"{_COHORT}, metric, request"
_NOISED = f"floor(n + {laplace('20.0::DOUBLE', uniform('builder', 'vertical', 'size_bucket', 'period', 'metric', 'request', chr(39) + 'contributors' + chr(39)))} + 0.5)"
ORACLES["hardened_releases"] = f"""{hardened()}, q AS ({quantiles("rows_", _HKEYS, 0.05)}), m AS ({means("rows_", _HKEYS, 0.05)})
SELECT {_HKEYS}, {_LADDER.format(n=_NOISED)} AS contributor_count, round(ladder[1], 6) AS p10, round(ladder[3], 6) AS p50, round(ladder[5], 6) AS p90, round(mean, 6) AS mean FROM q JOIN m USING ({_HKEYS})"""
_BAND = _LADDER.format(n="shortfall")
ORACLES["hardened_suppressions"] = f"""{hardened()} SELECT {_HKEYS}, reason, CASE reason WHEN 'unknown_metric' THEN '{UNKNOWN_METRIC_TEXT}' WHEN 'no_consented_observations' THEN '{NO_CONSENT_TEXT}' WHEN 'privacy_budget_exhausted' THEN '{BUDGET_TEXT}' WHEN 'contributor_dominance' THEN '{DOMINANCE_TEXT}'
  ELSE CASE WHEN {_BAND} > 0 THEN ({_BAND})::VARCHAR || ' or more' ELSE 'Fewer than 10' END || CASE reason WHEN 'too_few_contributors' THEN ' comparable apps are missing.' ELSE ' users are missing.' END END AS explanation FROM judged WHERE reason IS NOT NULL"""
ORACLES["hardened_spends"] = f"{hardened()} SELECT workspace_id, period, count(*) * 0.4::DOUBLE AS epsilon FROM rows_ GROUP BY ALL"


def number(c: str) -> str:
    return f"((round({c} * 1000000)::BIGINT // 1000000)::VARCHAR || '.' || lpad((round({c} * 1000000)::BIGINT % 1000000)::VARCHAR, 6, '0'))"


_STAMP = f"sha256(concat_ws(' ', head, concat_ws('|', {_COHORT}), metric, '0.000000', '1.000000', contributor_count::VARCHAR, subject_count::VARCHAR, {', '.join(number(c) for c in ('p10', 'p25', 'p50', 'p75', 'p90', 'mean', 'epsilon_spent'))}))"
ORACLES["release_provenance"] = gate() + f", head_ AS (SELECT head FROM (WITH RECURSIVE {APP}, {CHAIN}, {HEAD} SELECT head FROM head)) SELECT {_COHORT}, metric, {_STAMP} AS provenance_hash FROM passed CROSS JOIN head_"

_CONT = ", ".join(f"round(quantile_cont(value, {q}), 6) AS p{int(q * 100)}" for q in (0.1, 0.25, 0.5, 0.75, 0.9))
ORACLES["exact_quantiles"] = f"{SHOP_OBS} SELECT period, metric, {_CONT} FROM obs GROUP BY ALL"
_COMPARED = f"""{SHOP_OBS}, six AS (SELECT * REPLACE (round(value, 6) AS value) FROM obs), points AS (SELECT period, metric, {_CONT}, count(DISTINCT workspace_id) AS contributor_count FROM six GROUP BY ALL),
ranked_ AS (SELECT *, value - p50 AS delta_, CASE WHEN value <= p10 THEN 10.0 WHEN value >= p90 THEN 90.0
  WHEN value BETWEEN p10 AND p25 THEN CASE WHEN p10 = p25 THEN 25.0 ELSE 10 + (value - p10) / (p25 - p10) * 15.0 END
  WHEN value BETWEEN p25 AND p50 THEN CASE WHEN p25 = p50 THEN 50.0 ELSE 25 + (value - p25) / (p50 - p25) * 25.0 END
  WHEN value BETWEEN p50 AND p75 THEN CASE WHEN p50 = p75 THEN 75.0 ELSE 50 + (value - p50) / (p75 - p50) * 25.0 END
  WHEN value BETWEEN p75 AND p90 THEN CASE WHEN p75 = p90 THEN 90.0 ELSE 75 + (value - p75) / (p90 - p75) * 15.0 END ELSE 50.0 END::DOUBLE AS rank_ FROM six JOIN points USING (period, metric))"""


def fixed2(c: str) -> str:
    u = f"floor({c} * 100 + 0.5)::BIGINT"
    return f"(({u} // 100)::VARCHAR || '.' || lpad(({u} % 100)::VARCHAR, 2, '0'))"


ORACLES["benchmark_rank"] = f"{_COMPARED} SELECT workspace_id, period, metric, round(rank_, 6) AS rank FROM ranked_"
_RANKED = _COMPARED[_COMPARED.index("ranked_ AS"):].replace("FROM six JOIN points USING (period, metric)", f"FROM six JOIN passed USING ({_COHORT}, metric)")
_GATED = f"""{gate()}, six AS (SELECT workspace_id, metric, round(value, 6) AS value, {_COHORT} FROM r WHERE depth = 2), {_RANKED}"""
_DIRECTION = "CASE WHEN abs(delta_) < 1e-9 THEN 'at_median' WHEN delta_ > 0 THEN 'ahead' ELSE 'behind' END"
ORACLES["benchmark_compare"] = f"""{_GATED} SELECT workspace_id, period, metric, p50 AS cohort_median, round(rank_, 6) AS rank, round(delta_, 6) AS delta, {_DIRECTION} AS direction,
  'rate ' || {fixed2("value")} || ', median of ' || concat_ws(' / ', builder, vertical, size_bucket) || ' ' || {fixed2("p50")} || ', percentile ' || floor(rank_ + 0.5)::BIGINT || '.'
  || CASE WHEN abs(delta_) < 1e-9 THEN ' Level with the median.' WHEN delta_ > 0 THEN ' Ahead by ' || {fixed2("abs(delta_)")} || '.' ELSE ' Behind by ' || {fixed2("abs(delta_)")} || ', ' || format('{{:,}}', floor(abs(delta_) * 12345 + 0.5)::BIGINT) || ' a month.' END
  || ' Apps compared: ' || contributor_count || '.' AS narrative FROM ranked_"""
_VALUES = "(SELECT workspace_id, metric, round(arg_max(value, period), 6) AS value FROM obs GROUP BY ALL)"
ORACLES["benchmark_request"] = f"""{gate()}, who AS (SELECT workspace_id, vertical FROM config UNION ALL SELECT 'm_9999', NULL),
asks AS (SELECT *, CASE WHEN no % 2 = 1 THEN printf('%d-%02d', 1996 + no % 4, 1 + no % 12) ELSE '1998-06' END AS period FROM (SELECT *, substr(workspace_id, 3)::INT AS no FROM who) CROSS JOIN (VALUES ('return_rate'), ('activation_rate')) t(metric)),
six AS (SELECT asks.workspace_id, metric, period, CASE WHEN vertical IS NOT NULL THEN 'any' END AS builder, vertical, CASE WHEN vertical IS NOT NULL THEN 'any' END AS size_bucket, value FROM asks LEFT JOIN {_VALUES} USING (workspace_id, metric)), {_RANKED}
SELECT six.workspace_id, period, metric, p.p50 IS NOT NULL AS available, p.p50 AS cohort_median, CASE WHEN six.value IS NOT NULL THEN round(rank_, 6) END AS rank, CASE WHEN k.value IS NOT NULL THEN {_DIRECTION} END AS direction,
  CASE WHEN six.vertical IS NULL THEN 'workspace_not_profiled' ELSE j.reason END AS reason, CASE WHEN j.reason = 'no_consented_observations' THEN '{NO_CONSENT_TEXT}' ELSE {_WHY.replace("reason", "j.reason").replace("shortfall", "j.shortfall")} END AS explanation
FROM six LEFT JOIN judged j USING ({_COHORT}, metric) LEFT JOIN passed p USING ({_COHORT}, metric) LEFT JOIN ranked_ k ON k.workspace_id = six.workspace_id AND k.metric = six.metric"""

_KEY = "concat_ws('|', builder, vertical, size_bucket, period)"
_SETTLE = f"""{SHOP_OBS}, given AS (SELECT workspace_id, {_KEY} AS cohort_key, sum(subject_count)::BIGINT AS subject_count FROM obs WHERE metric = 'activation_rate' GROUP BY ALL),
deal AS (SELECT 'deal_' || r_regionkey AS deal_id, lower(replace(r_name, ' ', '_')) AS vertical, greatest(0, 1000001 + 7919 * r_regionkey::BIGINT - r_regionkey * 100000) AS net FROM region),
covered AS (SELECT DISTINCT deal_id, {_KEY} AS cohort_key FROM deal JOIN obs USING (vertical)),
own AS (SELECT deal_id, workspace_id, sum(subject_count)::BIGINT AS subjects FROM given JOIN covered USING (cohort_key) WHERE subject_count > 0 GROUP BY ALL),
part AS (SELECT *, floor(net * 0.3::DOUBLE)::BIGINT AS pool, sum(subjects) OVER (PARTITION BY deal_id)::BIGINT AS total FROM own JOIN deal USING (deal_id)),
split AS (SELECT *, (pool::HUGEINT * subjects // total)::BIGINT AS base, pool::HUGEINT * subjects % total AS rest FROM part WHERE pool > 0),
paid AS (SELECT *, base + CASE WHEN row_number() OVER (PARTITION BY deal_id ORDER BY rest DESC, workspace_id) <= pool - sum(base) OVER (PARTITION BY deal_id) THEN 1 ELSE 0 END AS amount FROM split)"""
ORACLES["coop_contributions"] = f"{SHOP_OBS} SELECT workspace_id, {_KEY} AS cohort_key, sum(subject_count)::BIGINT AS subject_count FROM obs WHERE metric = 'activation_rate' GROUP BY ALL"
ORACLES["coop_payouts"] = f"{_SETTLE} SELECT deal_id, workspace_id, amount::BIGINT AS amount_cents, CASE WHEN amount >= 5000 THEN 'cash' ELSE 'credit' END AS method, subjects::DOUBLE / total AS share, subjects AS subject_count FROM paid WHERE amount > 0"
ORACLES["coop_settlements"] = f"""{_SETTLE}, sums AS (SELECT deal_id, sum(amount)::BIGINT AS paid FROM paid GROUP BY 1), done AS (SELECT deal_id, net, coalesce(paid, 0) AS paid, CASE WHEN coalesce(paid, 0) > 0 THEN floor(net * 0.3::DOUBLE)::BIGINT ELSE 0 END AS pool FROM deal LEFT JOIN sums USING (deal_id))
SELECT deal_id, net::BIGINT AS net_cents, pool AS pool_cents, (net - paid)::BIGINT AS platform_cents, pool - paid AS rounding_remainder_cents FROM done"""
ORACLES["dataset_export"] = f"{gate()} SELECT 'deal_' || vertical AS deal_id, {_COHORT}, metric, p50, epsilon_spent FROM passed WHERE vertical IN ('{VERTICALS[1]}', '{VERTICALS[2]}')"

RAW = f"""raw AS (SELECT event_id AS i, CASE WHEN event_id % 101 = 0 THEN '' ELSE 'ws_' || (user_id % 12) END AS workspace_id, CASE WHEN event_id % 103 = 0 THEN '' ELSE 'e' || event_id END AS event_id,
  CASE WHEN event_id % 107 = 0 THEN 'has spaces' WHEN event_id % 109 = 0 THEN upper(event_type) ELSE event_type END AS name, event_id % 113 <> 0 AS timed, event_id % 127 <> 0 AS known,
  CASE WHEN event_id % 3 = 0 THEN 'unknown' ELSE {cycle(JURISDICTIONS, "user_id")} END AS jurisdiction, CASE WHEN event_id % 5 = 0 THEN 'evil-injected' ELSE {cycle(BUILDER_CYCLE, "user_id")} END AS builder, event_id % 200 AS octet, event_id % 131 <> 0 AND event_id % 137 <> 0 AS authorised, user_id, epoch_us(ts) // 1000000 * 1000000 AS tus FROM events),
checked AS (SELECT *, CASE WHEN workspace_id = '' THEN 'missing_workspace' WHEN event_id = '' THEN 'missing_event_id' WHEN NOT regexp_full_match(name, '[A-Za-z0-9][A-Za-z0-9_.:-]{{0,63}}') THEN 'invalid_event_name' WHEN NOT timed THEN 'invalid_timestamp' WHEN NOT known THEN 'missing_identifier' END AS reason,
  CASE WHEN builder IN ({", ".join(repr(b) for b in BUILDERS)}) THEN builder ELSE 'unknown' END AS clean FROM raw)"""
ORACLES["validate_events"] = f"WITH {RAW} SELECT event_id, lower(name) AS name, tus AS at, jurisdiction, clean AS builder FROM checked WHERE reason IS NULL"
ORACLES["reject_tally"] = f"WITH {RAW} SELECT workspace_id, coalesce(reason, 'accepted') AS outcome, count(*) AS events FROM checked GROUP BY ALL"
ORACLES["dominant_builder"] = f"WITH {RAW}, n AS (SELECT workspace_id, clean AS builder, count(*) AS n FROM checked WHERE workspace_id <> '' GROUP BY ALL) SELECT workspace_id, coalesce(first(builder ORDER BY n DESC, builder) FILTER (WHERE builder <> 'unknown'), 'unknown') AS builder FROM n GROUP BY workspace_id"
_COUNTRY = "CASE WHEN {o} < 64 THEN 'US' WHEN {o} < 128 THEN 'DE' WHEN {o} < 150 THEN 'FR' END"
ORACLES["ip_country"] = f"WITH {RAW} SELECT workspace_id, nullif(event_id, '') AS event_id, {_COUNTRY.format(o='octet')} AS country FROM raw UNION ALL SELECT 'other', nullif(event_id, ''), {_COUNTRY.format(o='((octet + 70) % 200)')} FROM raw"
ORACLES["ip_ranges"] = """WITH r AS (SELECT c_custkey % 2 = 1 AS six, 167772160 + (c_custkey * 7919 % 200) * 65536 + c_custkey * 31 % 65536 AS low, (2 ** (c_custkey % 21))::BIGINT AS size, 'C' || c_nationkey AS country FROM customer),
e AS (SELECT event_id, event_id % 3 = 0 AS six, 167772160 + (event_id * 13 % 200) * 65536 + event_id * 977 % 65536 AS n FROM events)
SELECT event_id, arg_max(country, (low, -size, -k)) AS country FROM e LEFT JOIN (SELECT *, rank() OVER (ORDER BY country) AS k FROM r) r ON r.six = e.six AND n BETWEEN low AND low + size - 1 GROUP BY event_id"""
ORACLES["authorised_events"] = f"WITH {APP} SELECT CASE WHEN vertical = 'marketplace' THEN 'unauthorized' ELSE workspace_id END AS outcome, count(*) AS events FROM ev JOIN config USING (workspace_id) GROUP BY ALL"
ORACLES["dedupe_events"] = f"WITH {RAW} SELECT name, count(DISTINCT (workspace_id, event_id)) AS events FROM raw WHERE event_id <> '' GROUP BY ALL"
ORACLES["builder_from_host"] = f"""WITH h AS (SELECT page_id, regexp_extract(url, '^[a-z]+://([^/?#]*)', 1) || {cycle(HOSTS, "page_id")} AS h FROM pages)
SELECT page_id, CASE WHEN ends_with(h, '.lovable.app') THEN 'lovable' WHEN ends_with(h, '.bolt.host') OR ends_with(h, '.stackblitz.io') THEN 'bolt' WHEN ends_with(h, '.vercel.app') THEN 'v0' WHEN ends_with(h, '.replit.app') OR ends_with(h, '.repl.co') THEN 'replit' WHEN ends_with(h, '.base44.app') THEN 'base44' ELSE 'unknown' END AS builder FROM h"""
ORACLES["jurisdiction_from_tz"] = f"""WITH z AS (SELECT {cycle(ZONES, "event_id")} AS z FROM events)
SELECT CASE WHEN starts_with(z, 'Europe/London') THEN 'UK' WHEN starts_with(z, 'Europe/') THEN 'EU' WHEN z = 'America/Los_Angeles' THEN 'US-CA' WHEN starts_with(z, 'America/') THEN 'US' ELSE 'unknown' END AS jurisdiction, count(*) AS events FROM z GROUP BY ALL"""
ORACLES["optout_restrict"] = f"WITH {APP} SELECT event_id, CASE WHEN NOT shares OR seq % 11 = 0 THEN 'product_analytics' ELSE 'product_analytics,benchmark_contribution,coop_licensing' END AS purposes FROM ev"

_WORDS = {c: f"(^|[^a-z0-9])({p.replace(chr(39), chr(39) * 2)})($|[^a-z0-9])" for c, p in CATEGORIES}


def categories(texts: str) -> str:
    """Sorted list of the categories that any of a list of texts reveals."""
    each = ", ".join(f"CASE WHEN len(list_filter({texts}, lambda x: regexp_matches(lower(x), '{p}'))) > 0 THEN '{c}' END" for c, p in _WORDS.items())
    return f"list_sort(list_filter([{each}], lambda c: c IS NOT NULL))"


_NAMES = ("hiv_refill_tapped", "health_check", "voted_on_poll", "therapeutic_ui_theme", "kids_mode", "race_started", "racetrack_view", "/therapy/session-notes", "page_view", "mental_health_log")
ORACLES["screen_events"] = f"WITH c AS (SELECT event_id::VARCHAR AS event_id, {categories('[' + cycle(_NAMES, 'event_id') + ']')} AS c FROM events) SELECT event_id, array_to_string(c, ',') AS categories FROM c WHERE len(c) > 0"
ORACLES["screen_workspaces"] = f"""WITH c AS (SELECT c_custkey::VARCHAR AS workspace_id, {categories("[c_name, " + cycle(("an app for kids", "invoices", "prayer times", "a racetrack game"), "c_custkey") + ", c_mktsegment, " + cycle(("a.app", "dating-preference.app", "b.app"), "c_custkey") + "]")} AS c FROM customer)
SELECT workspace_id, 'Possibly sensitive (' || array_to_string(c, ', ') || '): kept in your own figures, left out of shared ones. Another name clears a false alarm.' AS explanation FROM c WHERE len(c) > 0"""

#: The redaction rules in the syntax of RE2, whose \\b and \\w are ASCII.
_REDACT = (
    ("email", r"[\w.+-]+@[\w-]+\.[\w.-]{2,}"),
    ("jwt", r"\beyJ[A-Za-z0-9_-]{8,}\.[A-Za-z0-9_-]{8,}\.[A-Za-z0-9_-]{8,}\b"),
    ("api_key", r"\b(?:sk|pk|rk)[-_][A-Za-z0-9]{16,}\b"),
    ("github_token", r"\bgh[pousr]_[A-Za-z0-9]{16,}\b"),
    ("slack_token", r"\bxox[baprs]-[A-Za-z0-9-]{10,}\b"),
    ("aws_key", r"\bAKIA[0-9A-Z]{16}\b"),
    ("phone", r"\b\+?[0-9][0-9\s().-]{8,17}[0-9]\b"),
    ("ipv4", r"\b(?:\d{1,3}\.){3}\d{1,3}\b"),
    ("iban", r"\b[A-Z]{2}\d{2}[A-Z0-9]{10,30}\b"),
    ("card", r"\b(?:\d[ -]?){13,19}\b"),
)


def redacted(text: str, rules: int = len(_REDACT)) -> str:
    for name, pattern in _REDACT[:rules]:
        text = f"regexp_replace({text}, '{pattern}', '[redacted:{name}]', 'g')"
    return text


def found(table: str, text: str) -> str:
    """(source, rule, n) of one table: each rule looks at what the rules before it left."""
    steps = [f"SELECT '{name}' AS rule FROM {table} WHERE regexp_matches({redacted(text, i)}, '{pattern}')" for i, (name, pattern) in enumerate(_REDACT)]
    steps.append(f"SELECT 'truncated' AS rule FROM {table} WHERE length({redacted(text)}) > 256")
    return f"SELECT '{table}' AS source, rule, count(*) AS n FROM ({' UNION ALL '.join(steps)}) GROUP BY rule"


ORACLES["redact_documents"] = f"SELECT doc_id, substr({redacted('text')}, 1, 256) AS text FROM documents"
ORACLES["redaction_findings"] = " UNION ALL ".join(found(t, c) for t, c in (("documents", "text"), ("conversations", "text"), ("pages", "html")))
ORACLES["redact_properties"] = f"SELECT conv_id, turn, 'cart_n,items_count,note' AS keys, substr({redacted('text')}, 1, 256) AS note, '2' AS items_count, turn::VARCHAR AS cart_n FROM conversations"

_EPOCH = 30 * DAY
ORACLES["epochs"] = f"WITH {SHOP} SELECT tus // {_EPOCH} AS epoch, count(*) AS events FROM ev GROUP BY ALL"


def hmac(inner: str, outer: str, message: str) -> str:
    return f"sha256({outer} || from_hex(sha256({inner} || encode({message}))))"


def pad(key: str, byte: int) -> str:
    return f"from_hex(array_to_string(list_transform(range(0, 32), lambda i: format('{{:02x}}', xor(('0x' || substr({key}, 2 * i + 1, 2))::INTEGER, {byte}))), '') || repeat('{byte:02x}', 32))"


_IN, _OUT = (f"from_hex('{padded(ROOT.encode(), b).hex()}')" for b in (0x36, 0x5C))
PEOPLE = f"""person AS (SELECT 'ws_' || (user_id % 12) AS workspace_id, 'user-' || user_id AS identifier, user_id, epoch_us(ts) AS tus FROM events),
scoped AS (SELECT workspace_id, {hmac(_IN, _OUT, "'workspace:' || workspace_id")} AS s, {hmac(_IN, _OUT, "'consent-anchor:' || workspace_id")} AS a FROM (SELECT DISTINCT workspace_id FROM person)),
pads AS (SELECT workspace_id, {pad("s", 0x36)} AS si, {pad("s", 0x5C)} AS so, {pad("a", 0x36)} AS ai, {pad("a", 0x5C)} AS ao FROM scoped)"""
_SUBJECT = f"substr({hmac('si', 'so', chr(39).join(['identifier || ', '|epoch:', ' || epoch']))}, 1, 32)"
ORACLES["subject_keys"] = f"WITH {PEOPLE} SELECT DISTINCT workspace_id, identifier, epoch, {_SUBJECT} AS subject_key FROM (SELECT *, tus // {_EPOCH} AS epoch FROM person) JOIN pads USING (workspace_id)"
ORACLES["consent_anchors"] = f"WITH {PEOPLE} SELECT DISTINCT workspace_id, identifier, substr({hmac('ai', 'ao', 'identifier')}, 1, 32) AS anchor FROM person JOIN pads USING (workspace_id)"
KEPT = f"""{PEOPLE}, asks AS (SELECT workspace_id, identifier, max(tus) AS now FROM person WHERE user_id % 20 = 3 GROUP BY ALL),
keys AS (SELECT DISTINCT workspace_id, identifier, epoch, {_SUBJECT} AS subject_key FROM (SELECT workspace_id, identifier, (now - i * {_EPOCH}) // {_EPOCH} AS epoch FROM asks CROSS JOIN range(15) t(i)) JOIN pads USING (workspace_id)),
keyed AS (SELECT workspace_id, {_SUBJECT} AS subject_key FROM (SELECT *, tus // {_EPOCH} AS epoch FROM person) JOIN pads USING (workspace_id))"""
ORACLES["retention_keys"] = f"WITH {KEPT} SELECT workspace_id, identifier, epoch, subject_key FROM keys"
ORACLES["erasure_remaining"] = f"WITH {KEPT} SELECT workspace_id, count(*) AS events FROM keyed WHERE (workspace_id, subject_key) NOT IN (SELECT workspace_id, subject_key FROM keys) GROUP BY ALL"
ORACLES["erasure_report"] = f"WITH {KEPT} SELECT workspace_id, identifier, count(DISTINCT epoch) AS epochs_swept, (SELECT count(*) FROM keyed e JOIN keys k2 USING (workspace_id, subject_key) WHERE k2.workspace_id = k.workspace_id AND k2.identifier = k.identifier) AS events_deleted FROM keys k GROUP BY ALL"
ORACLES["ttl_expire"] = f"WITH {APP} SELECT workspace_id, count(*) AS events FROM ev JOIN config USING (workspace_id) WHERE tus >= 1706659200000000 - CASE WHEN vertical = 'b2b_saas' THEN 5 ELSE 20 END * {DAY} GROUP BY ALL"
ORACLES["latest_profiles"] = "SELECT o_custkey AS workspace_id, max(o_orderkey) AS version, arg_max(o_orderstatus, o_orderkey) AS status, arg_max(o_orderpriority, o_orderkey) AS tier FROM orders GROUP BY ALL"
_LINES = "ev AS (SELECT 's_' || (l_suppkey % 50) AS workspace_id, l_orderkey::VARCHAR AS subject_key, l_returnflag AS name, epoch_us(l_shipdate) AS tus, true AS shares FROM lineitem)"
ORACLES["wide_timelines"] = one(_LINES, ("activation_rate", act("R", 30)), (), MONTH)

ORACLES["insights_long"] = f"""WITH {APP} SELECT workspace_id, 'event' AS kind, name, count(*) AS n FROM ev GROUP BY ALL
UNION ALL SELECT workspace_id, 'total', 'distinct_subjects', count(DISTINCT subject_key) FROM ev GROUP BY ALL UNION ALL SELECT workspace_id, 'total', 'total_events', count(*) FROM ev GROUP BY ALL"""
_CONV = found("conversations", "text").replace("'conversations' AS source", "'ws_0' AS workspace_id, 'note' AS key")
ORACLES["findings_report"] = f"{_CONV} UNION ALL SELECT 'ws_0', 'user_email', 'blocked_key', count(*) FROM conversations UNION ALL SELECT 'ws_0', 'items', 'array_collapsed', count(*) FROM conversations"

_ANCHOR = "substr({}, 1, 32)".format(hmac("ai", "ao", "identifier"))
_SAID = f"""said AS (SELECT 'ws_' || (user_id % 12) AS workspace_id, 'user-' || user_id AS identifier, user_id, event_id AS seq, epoch_us(ts) AS tus, unnest(['product_analytics', 'benchmark_contribution']) AS purpose, unnest([event_id % 7 <> 0, event_id % 5 <> 0]) AS yes,
  CASE WHEN event_id % 3 = 0 THEN 'unknown' ELSE {cycle(JURISDICTIONS, "user_id")} END AS jurisdiction, CASE WHEN event_id % 4 = 0 THEN 'unversioned' ELSE 'v2' END AS notice_version FROM events WHERE event_type = 'signup'),
held AS (SELECT workspace_id, identifier, purpose, arg_max(yes, (tus, seq)) AS yes FROM said GROUP BY ALL)"""
ORACLES["consent_decisions"] = f"WITH {PEOPLE}, {_SAID} SELECT workspace_id, seq, {_ANCHOR} AS subject_key, purpose, CASE WHEN yes THEN 'granted' ELSE 'denied' END AS state, jurisdiction, notice_version FROM said JOIN pads USING (workspace_id)"
ORACLES["erasure_withdrawals"] = f"""WITH {_SAID}, s AS (SELECT workspace_id, identifier, any_value(user_id) AS u, bool_or(yes) FILTER (WHERE purpose = 'product_analytics') AS a, bool_or(yes) FILTER (WHERE purpose = 'benchmark_contribution') AS b FROM held JOIN (SELECT DISTINCT identifier, user_id FROM said) USING (identifier) GROUP BY ALL)
SELECT workspace_id, CASE WHEN u % 20 = 3 THEN '' ELSE concat_ws(',', CASE WHEN a THEN 'product_analytics' END, CASE WHEN b THEN 'benchmark_contribution' END) END AS purposes, count(*) AS subjects FROM s GROUP BY ALL"""
_POSTURE = "CASE WHEN jurisdiction IN ('US', 'US-CA') THEN true ELSE false END"
_OWN = "own_raw AS (SELECT * REPLACE (CASE WHEN authorised THEN 'ws_' || (user_id % 12) END AS workspace_id) FROM raw)"
_CHECKED = RAW[RAW.index("checked AS"):].replace("WHEN workspace_id = '' THEN 'missing_workspace'", "WHEN NOT authorised THEN 'unauthorized'").replace("FROM raw)", "FROM own_raw)")
_JUDGED = f"""{RAW[:RAW.index("checked AS")]}{_OWN}, {_CHECKED}, {_SAID}, whole AS (SELECT c.*, coalesce(a.yes, {_POSTURE.replace("jurisdiction", "c.jurisdiction")}) AS analytics, coalesce(b.yes, {_POSTURE.replace("jurisdiction", "c.jurisdiction")}) AS benchmark FROM checked c
  LEFT JOIN held a ON a.workspace_id = c.workspace_id AND a.identifier = 'user-' || c.user_id AND a.purpose = 'product_analytics' AND c.known LEFT JOIN held b ON b.workspace_id = c.workspace_id AND b.identifier = 'user-' || c.user_id AND b.purpose = 'benchmark_contribution' AND c.known)"""
ORACLES["ingest_outcomes"] = f"WITH {_JUDGED} SELECT workspace_id, coalesce(reason, CASE WHEN NOT analytics THEN 'no_analytics_consent' ELSE 'accepted' END) AS outcome, count(*) AS events FROM whole GROUP BY ALL"
ORACLES["stream_ingest"] = f"""WITH {PEOPLE}, {_JUDGED}, kept AS (SELECT *, 'user-' || user_id AS identifier, tus // {_EPOCH} AS epoch FROM whole WHERE reason IS NULL AND analytics)
SELECT workspace_id, event_id, {_SUBJECT} AS subject_key, lower(name) AS name, tus AS at, jurisdiction, clean AS builder, {_COUNTRY.format(o="octet")} AS country, CASE WHEN benchmark AND i % 11 <> 0 THEN 'product_analytics,benchmark_contribution' ELSE 'product_analytics' END AS purposes, 0 AS findings FROM kept JOIN pads USING (workspace_id)"""
ORACLES["stream_findings"] = f"""WITH {_JUDGED}, kept AS (SELECT * FROM whole WHERE reason IS NULL AND analytics), at_ AS (SELECT workspace_id, make_timestamp((1704067200 + i) // 3600 * 3600 * 1000000)::TIMESTAMP AS hour FROM kept)
SELECT hour, workspace_id, key, rule, count(*) AS n FROM at_ CROSS JOIN (VALUES ('note', 'email'), ('user_email', 'blocked_key')) t(key, rule) GROUP BY ALL"""

_EARLY = 1_705_276_800_000_000 // (30 * DAY)
ORACLES["erasure_stored"] = f"""WITH e AS (SELECT strftime(make_timestamp(epoch_us(ts)), '%Y-%m-%d') AS day, user_id % 20 = 3 AND epoch_us(ts) // {_EPOCH} <= {_EARLY} AS gone FROM events)
SELECT day, count(*) FILTER (WHERE NOT gone) AS events, bool_or(gone) AS rewritten FROM e GROUP BY day HAVING events > 0"""
#: What each subject had said of a purpose by then: the last word at each moment.
_WORDS_BY = "SELECT workspace_id, identifier, tus, arg_max(yes, seq) AS yes FROM {0} WHERE purpose = '{1}' GROUP BY ALL"
_HALF = 1_705_363_200_000_000
_ASKS = "asks AS (SELECT DISTINCT 'ws_' || (user_id % 12) AS workspace_id, 'user-' || user_id AS identifier FROM events WHERE user_id % 20 = 3)"
_AS_OF = f"""said2 AS (SELECT workspace_id, identifier, purpose, tus, seq, yes FROM said UNION ALL SELECT workspace_id, identifier, purpose, {_HALF}, 1099511627776, false FROM asks CROSS JOIN (VALUES ('product_analytics'), ('benchmark_contribution')) t(purpose)),
wa AS ({_WORDS_BY.format("said2", "product_analytics")}), wb AS ({_WORDS_BY.format("said2", "benchmark_contribution")})"""
ORACLES["stream_store"] = f"""WITH {PEOPLE}, {RAW[: RAW.index("checked AS")]}{_OWN}, {_CHECKED}, {_SAID}, {_ASKS}, {_AS_OF},
tries AS (SELECT *, 'user-' || user_id AS identifier, 0 AS again, tus AS arrived, reason IS NULL AS good FROM checked
  UNION ALL SELECT * REPLACE ('late_copy' AS name), 'user-' || user_id, 1, tus + 30 * {DAY}, authorised AND event_id <> '' AND timed AND known FROM checked WHERE i % 3 = 0),
granted AS (SELECT t.*, coalesce(a.yes, {_POSTURE.replace("jurisdiction", "t.jurisdiction")}) AS analytics, coalesce(b.yes, {_POSTURE.replace("jurisdiction", "t.jurisdiction")}) AS benchmark FROM tries t
  ASOF LEFT JOIN wa a ON a.workspace_id = t.workspace_id AND a.identifier = t.identifier AND t.arrived >= a.tus ASOF LEFT JOIN wb b ON b.workspace_id = t.workspace_id AND b.identifier = t.identifier AND t.arrived >= b.tus),
kept AS (SELECT *, tus // {_EPOCH} AS epoch FROM granted WHERE good AND analytics QUALIFY row_number() OVER (PARTITION BY workspace_id, event_id ORDER BY again) = 1)
SELECT workspace_id, event_id, {_SUBJECT} AS subject_key, lower(name) AS name, CASE WHEN benchmark AND i % 11 <> 0 THEN 'product_analytics,benchmark_contribution' ELSE 'product_analytics' END AS purposes, strftime(make_timestamp(arrived), '%Y-%m-%d') AS day FROM kept JOIN pads USING (workspace_id)"""
ORACLES["consent_as_of"] = f"""WITH {_SAID}, wa AS ({_WORDS_BY.format("said", "product_analytics")}), wb AS ({_WORDS_BY.format("said", "benchmark_contribution")}),
e AS (SELECT event_id, 'ws_' || (user_id % 12) AS workspace_id, 'user-' || user_id AS identifier, epoch_us(ts) AS tus FROM events)
SELECT event_id, concat_ws(',', CASE WHEN coalesce(a.yes, true) THEN 'product_analytics' END, CASE WHEN coalesce(b.yes, true) THEN 'benchmark_contribution' END) AS purposes FROM e
  ASOF LEFT JOIN wa a ON a.workspace_id = e.workspace_id AND a.identifier = e.identifier AND e.tus >= a.tus ASOF LEFT JOIN wb b ON b.workspace_id = e.workspace_id AND b.identifier = e.identifier AND e.tus >= b.tus"""

ORACLES["raw_requests"] = """WITH e AS (SELECT *, day(ts) AS d, user_id + day(ts) AS m FROM events), b AS (SELECT DISTINCT user_id, d, m FROM e),
kind AS (SELECT *, CASE WHEN m % 17 = 0 THEN 'malformed_json' WHEN m % 19 = 0 THEN 'not_an_object' WHEN m % 23 = 0 THEN 'no_events' WHEN m % 29 = 0 THEN 'event_not_an_object' END AS reason FROM b),
used AS (SELECT 'user-' || user_id AS what, user_id % 11 = 0 AS opt_out, count(*) AS n, sum(event_id)::BIGINT AS total FROM e JOIN kind USING (user_id, d) WHERE reason IS NULL OR reason = 'event_not_an_object' GROUP BY ALL),
gone AS (SELECT reason AS what, sum(CASE reason WHEN 'event_not_an_object' THEN 2 ELSE 1 END)::BIGINT AS n FROM kind WHERE reason IS NOT NULL GROUP BY 1
  UNION ALL SELECT 'batch_too_large', count(*) FROM b WHERE d = 1 AND user_id % 3 = 0 HAVING count(*) > 0)
SELECT way, what, opt_out, n, total FROM (SELECT what, opt_out, n, total FROM used UNION ALL SELECT what, NULL, n, NULL FROM gone) CROSS JOIN (VALUES ('batch'), ('stream')) t(way)"""

_LINE_REASON = "CASE WHEN event_id % 37 = 0 THEN 'malformed_json' WHEN event_id % 31 = 0 THEN 'unauthorized' WHEN event_id % 29 = 0 THEN 'missing_identifier' {0} END"
ORACLES["raw_consent"] = f"""WITH l AS (SELECT *, 'ws_' || (user_id % 12) AS workspace_id, {_LINE_REASON.format("WHEN event_id % 23 = 0 THEN 'no_purposes'")} AS reason FROM events WHERE event_type = 'signup'),
said AS (SELECT workspace_id, 'product_analytics' AS purpose, event_id % 7 <> 0 AS yes FROM l WHERE reason IS NULL UNION ALL SELECT workspace_id, 'benchmark_contribution', event_id % 5 <> 0 FROM l WHERE reason IS NULL AND event_id % 3 <> 0)
SELECT workspace_id, purpose, CASE WHEN yes THEN 'granted' ELSE 'denied' END AS state, count(*) AS n FROM said GROUP BY ALL UNION ALL SELECT NULL, NULL, reason, count(*) FROM l WHERE reason IS NOT NULL GROUP BY reason"""
ORACLES["raw_erasures"] = f"""WITH l AS (SELECT *, 'ws_' || (user_id % 12) AS workspace_id, {_LINE_REASON.format("")} AS reason FROM events WHERE event_type = 'signup')
SELECT workspace_id, count(DISTINCT user_id) AS subjects, count(DISTINCT user_id) * 15 AS n FROM l WHERE reason IS NULL GROUP BY 1 UNION ALL SELECT reason, NULL, count(*) FROM l WHERE reason IS NOT NULL GROUP BY reason"""
ORACLES["raw_deals"] = f"""{MARKET_OBS} SELECT 'deal_' || vertical AS deal_id, floor(1000001 * 0.3::DOUBLE)::BIGINT AS pool_cents, NULL::VARCHAR AS reason FROM obs GROUP BY vertical
UNION ALL SELECT 'x', NULL, unnest(['bad_amount', 'bad_amount', 'no_cohorts'])"""
