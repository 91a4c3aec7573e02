"""Independent SQL oracle for every registered query (run by DuckDB).

Each statement re-derives the household table as the CTE ``hh`` from the
pre-registered ``lineitem`` and ``part`` views, then answers the query in
plain SQL. Row filters are written out per query, not derived from the
Spark-side guard composition, so a wrong guard declaration shows up as a
mismatch. Sums are cast to BIGINT (DuckDB would return HUGEINT) and ratios
are divided as DOUBLE on both sides.
"""

from __future__ import annotations

from .sources.fixture import fixture_cte_sql
from .sources.schema import DEMOGRAPHIC_PULL_COLUMNS, HOME_VALUE_COLUMNS

SNAPS = "DAILY_TIME_KEY IN (DATE '2025-03-31', DATE '2024-03-31')"

# --- fixed values: bucket labels and cut points of the analysed workbench, in SQL ---
LABEL_SQL = {
    "kids_bucket": (
        "CASE WHEN CHILDREN_PER_HH < 1 THEN 'no_kids' WHEN CHILDREN_PER_HH < 2 THEN 'low_kids' "
        "WHEN CHILDREN_PER_HH < 3 THEN 'med_kids' ELSE 'high_kids' END"
    ),
    "ownership_bucket": (
        "CASE WHEN PERC_OWNER_OCCUPIED < 0.25 THEN 'low_ownership' "
        "WHEN PERC_OWNER_OCCUPIED < 0.5 THEN 'mid_low_ownership' "
        "WHEN PERC_OWNER_OCCUPIED < 0.75 THEN 'mid_high_ownership' ELSE 'high_ownership' END"
    ),
    "household_mix": (
        "CASE WHEN CAST(TOTAL_FAMILIES AS DOUBLE) / NULLIF(TOTAL_HOUSEHOLDS, 0) >= 0.6 THEN 'family_dominant' "
        "WHEN CAST(TOTAL_FAMILIES AS DOUBLE) / NULLIF(TOTAL_HOUSEHOLDS, 0) <= 0.4 THEN 'non_family_dominant' "
        "ELSE 'even_split' END"
    ),
    "kids_group": (
        "CASE WHEN TOTAL_FAMILIES_WO_CHILDREN > TOTAL_FAMILIES_W_CHILDREN THEN 'Less Kids' "
        "WHEN TOTAL_FAMILIES_WO_CHILDREN <= TOTAL_FAMILIES_W_CHILDREN THEN 'More Kids' ELSE 'Equal' END"
    ),
    "labor_group": (
        "CASE WHEN TOTAL_IN_LABOR_FORCE > TOTAL_NOT_IN_LABOR_FORCE THEN 'Labor Majority' "
        "WHEN TOTAL_IN_LABOR_FORCE < TOTAL_NOT_IN_LABOR_FORCE THEN 'Labor Minority' ELSE 'Equal' END"
    ),
    "transport_group": (
        "CASE WHEN TRANSPORTATION_DRIVE_ALONE > TRANSPORTATION_CARPOOL "
        "AND TRANSPORTATION_DRIVE_ALONE > TRANSPORTATION_WORK_FROM_HOME THEN 'Drive Alone Majority' "
        "WHEN TRANSPORTATION_CARPOOL > TRANSPORTATION_DRIVE_ALONE "
        "AND TRANSPORTATION_CARPOOL > TRANSPORTATION_WORK_FROM_HOME THEN 'Carpool Majority' "
        "WHEN TRANSPORTATION_WORK_FROM_HOME > TRANSPORTATION_DRIVE_ALONE "
        "AND TRANSPORTATION_WORK_FROM_HOME > TRANSPORTATION_CARPOOL THEN 'WFH Majority' ELSE 'Other' END"
    ),
    "DWELLING_SEGMENT": "DWELLING_SEGMENT",
    "BULK_FLG": "BULK_FLG",
}
# --- end of fixed values ---

# Row filters, by the columns they test (combined per query below).
DWELL = "DWELLING_SEGMENT IS NOT NULL"
KIDS = "CHILDREN_PER_HH IS NOT NULL"
OWN = "PERC_OWNER_OCCUPIED IS NOT NULL"
HH0 = "TOTAL_HOUSEHOLDS <> 0"
FAM = "TOTAL_FAMILIES IS NOT NULL"
KG = "TOTAL_FAMILIES_WO_CHILDREN IS NOT NULL AND TOTAL_FAMILIES_W_CHILDREN IS NOT NULL"
LAB = "TOTAL_IN_LABOR_FORCE IS NOT NULL AND TOTAL_NOT_IN_LABOR_FORCE IS NOT NULL"
TRN = (
    "TRANSPORTATION_DRIVE_ALONE IS NOT NULL AND TRANSPORTATION_CARPOOL IS NOT NULL "
    "AND TRANSPORTATION_WORK_FROM_HOME IS NOT NULL"
)

HH_COUNT = "COUNT(*)"
CUST = "CAST(SUM(CASE WHEN CUSTOMER_FLAG = 1 THEN 1 ELSE 0 END) AS BIGINT)"
RATE = f"CAST({CUST} AS DOUBLE) / CAST(COUNT(*) AS DOUBLE)"


def with_hh(body: str) -> str:
    return f"WITH hh AS (\n{fixture_cte_sql()}\n)\n{body}"


def _cut(out: list[tuple[str, str]], labels: list[str], where: list[str], source: str = "hh") -> str:
    """SELECT ``out`` FROM labelled rows of ``source`` filtered by ``where``."""
    inner = ", ".join(f"{LABEL_SQL[c]} AS {c}" for c in labels)
    conds = " AND ".join([SNAPS, *where])
    keys = ", ".join(labels + ["DAILY_TIME_KEY"])
    select = ",\n    ".join(e if e == n else f"{e} AS {n}" for n, e in out)
    return (
        f"SELECT\n    {select}\nFROM (SELECT DAILY_TIME_KEY, CUSTOMER_FLAG, {inner} FROM {source} WHERE {conds}) t\n"
        f"GROUP BY {keys}"
    )


def _measures(hh: str, cc: str, customers_first: bool) -> list[tuple[str, str]]:
    m = [(cc, CUST), (hh, HH_COUNT)] if customers_first else [(hh, HH_COUNT), (cc, CUST)]
    return m + [("penetration_rate", RATE)]


def _single(label: str, date_first: bool, hh: str, cc: str, customers_first: bool, where: list[str]) -> str:
    keys = [("DAILY_TIME_KEY", "DAILY_TIME_KEY"), (label, label)]
    if not date_first:
        keys.reverse()
    return _cut(keys + _measures(hh, cc, customers_first), [label], where)


def _xtab(a: str, b: str, where: list[str]) -> str:
    keys = [(a, a), (b, b), ("DAILY_TIME_KEY", "DAILY_TIME_KEY")]
    return _cut(keys + _measures("household_count", "customer_count", False), [a, b], where)


BLOCK_GROUP_SUMMARY = (
    "SELECT DAILY_TIME_KEY, CENSUS_BLOCK_GROUP, hhs, num_customers, PERC_HH_W_CHILDREN,\n"
    "    1 - PERC_HH_W_CHILDREN AS perc_hh_wo_children, bulk_hhs,\n"
    "    CAST(num_customers AS DOUBLE) / CAST(NULLIF(hhs, 0) AS DOUBLE) AS penetration,\n"
    "    CAST(bulk_hhs AS DOUBLE) / CAST(NULLIF(hhs, 0) AS DOUBLE) AS bulk_pct,\n"
    f"    apartment_count, house_count, {', '.join(HOME_VALUE_COLUMNS)}\n"
    "FROM (\n"
    f"  SELECT DAILY_TIME_KEY, CENSUS_BLOCK_GROUP, PERC_HH_W_CHILDREN, {', '.join(HOME_VALUE_COLUMNS)},\n"
    "    COUNT(*) FILTER (WHERE DWELLING_SEGMENT = 'APARTMENT') AS apartment_count,\n"
    "    COUNT(*) FILTER (WHERE DWELLING_SEGMENT = 'HOUSE') AS house_count,\n"
    "    COUNT(*) AS hhs,\n"
    "    COUNT(*) FILTER (WHERE CUSTOMER_KEY > 0) AS num_customers,\n"
    "    COUNT(*) FILTER (WHERE BULK_FLG = 1) AS bulk_hhs\n"
    f"  FROM hh WHERE {SNAPS}\n"
    f"  GROUP BY DAILY_TIME_KEY, CENSUS_BLOCK_GROUP, PERC_HH_W_CHILDREN, {', '.join(HOME_VALUE_COLUMNS)}\n"
    ") s"
)

CUT_BLOCK_BULK = (
    "SELECT CASE WHEN blk.mx = 1 THEN 'has_bulk' ELSE 'no_bulk' END AS block_bulk_status,\n"
    "    h.DAILY_TIME_KEY,\n"
    f"    {CUST.replace('CUSTOMER_FLAG', 'h.CUSTOMER_FLAG')} AS customer_count,\n"
    "    COUNT(*) AS total_households,\n"
    f"    CAST({CUST.replace('CUSTOMER_FLAG', 'h.CUSTOMER_FLAG')} AS DOUBLE) / CAST(COUNT(*) AS DOUBLE)"
    " AS penetration_rate\n"
    "FROM hh h\n"
    "JOIN (SELECT CENSUS_BLOCK_GROUP, MAX(BULK_FLG) AS mx FROM hh GROUP BY CENSUS_BLOCK_GROUP) blk\n"
    "  ON h.CENSUS_BLOCK_GROUP = blk.CENSUS_BLOCK_GROUP\n"
    f"WHERE h.{SNAPS}\n"
    "GROUP BY 1, 2"
)

DEMOGRAPHIC_PULL = (
    f"SELECT {', '.join(DEMOGRAPHIC_PULL_COLUMNS)},\n"
    "    COUNT(*) AS hhs,\n"
    "    COUNT(*) FILTER (WHERE CUSTOMER_KEY > 0) AS num_customers,\n"
    "    CAST(COUNT(*) FILTER (WHERE CUSTOMER_KEY > 0) AS DOUBLE) / CAST(COUNT(*) AS DOUBLE) AS penetration\n"
    f"FROM hh WHERE {SNAPS}\n"
    f"GROUP BY {', '.join(DEMOGRAPHIC_PULL_COLUMNS)}"
)

WORKBENCH_BODIES: dict[str, str] = {
    "block_group_summary": BLOCK_GROUP_SUMMARY,
    "cut_dwelling": _single("DWELLING_SEGMENT", False, "total_households", "customer_count", True, [DWELL]),
    "cut_bulk": _single("BULK_FLG", True, "total_households", "customer_count", True, []),
    "cut_block_bulk": CUT_BLOCK_BULK,
    "cut_kids": _single("kids_bucket", True, "total_households", "customer_count", True, [KIDS]),
    "cut_family_mix": _single("household_mix", False, "total_households", "customers", False, [HH0]),
    "cut_ownership": _single("ownership_bucket", True, "total_hhs", "customer_count", False, [OWN]),
    "cut_kids_group": _single("kids_group", False, "total_households", "customers", False, [HH0, KG]),
    "cut_labor": _single("labor_group", False, "total_households", "customers", False, [HH0, LAB]),
    "cut_transport": _single("transport_group", False, "total_households", "customers", False, [HH0, TRN]),
    "xtab_dwelling_kids": _cut(
        [("DAILY_TIME_KEY", "DAILY_TIME_KEY"), ("DWELLING_SEGMENT", "DWELLING_SEGMENT"),
         ("kids_bucket", "kids_bucket")] + _measures("total_households", "customer_count", True),
        ["DWELLING_SEGMENT", "kids_bucket"],
        [KIDS],
    ),
    "xtab_dwelling_ownership": _xtab("DWELLING_SEGMENT", "ownership_bucket", [DWELL, OWN]),
    "xtab_dwelling_family": _xtab("DWELLING_SEGMENT", "household_mix", [DWELL, FAM, HH0]),
    "xtab_kids_ownership": _xtab("kids_bucket", "ownership_bucket", [KIDS, OWN]),
    "xtab_kids_family": _xtab("kids_bucket", "household_mix", [KIDS, FAM, HH0]),
    "xtab_ownership_family": _xtab("ownership_bucket", "household_mix", [HH0, OWN, FAM]),
    "xtab_dwelling_kids_group": _xtab("DWELLING_SEGMENT", "kids_group", [HH0, KG, DWELL]),
    "xtab_ownership_kids_group": _xtab("ownership_bucket", "kids_group", [HH0, OWN, KG]),
    "xtab_dwelling_labor": _xtab("DWELLING_SEGMENT", "labor_group", [HH0, LAB, DWELL]),
    "xtab_kids_labor": _xtab("kids_bucket", "labor_group", [KIDS, LAB, HH0]),
    "xtab_ownership_labor": _xtab("ownership_bucket", "labor_group", [HH0, OWN, LAB]),
    "xtab_labor_family": _xtab("labor_group", "household_mix", [HH0, LAB, FAM]),
    "xtab_labor_kids_group": _xtab("labor_group", "kids_group", [HH0, LAB, KG]),
    "xtab_dwelling_transport": _xtab("DWELLING_SEGMENT", "transport_group", [HH0, TRN, DWELL]),
    "xtab_kids_transport": _xtab("kids_bucket", "transport_group", [HH0, TRN, KIDS]),
    "xtab_ownership_transport": _xtab("ownership_bucket", "transport_group", [HH0, TRN, OWN]),
    "xtab_family_transport": _xtab("household_mix", "transport_group", [HH0, TRN, FAM]),
    "xtab_kids_group_transport": _xtab("kids_group", "transport_group", [HH0, TRN, KG]),
    "demographic_pull": DEMOGRAPHIC_PULL,
}

WORKBENCH_SQL: dict[str, str] = {k: with_hh(v) for k, v in WORKBENCH_BODIES.items()}


# --- follow-up analyses ---------------------------------------------------------

# The nine single cuts: (dimension name, body, label column, households, customers).
_SINGLES = [
    ("dwelling", "cut_dwelling", "DWELLING_SEGMENT", "total_households", "customer_count"),
    ("bulk", "cut_bulk", "BULK_FLG", "total_households", "customer_count"),
    ("block_bulk", "cut_block_bulk", "block_bulk_status", "total_households", "customer_count"),
    ("kids", "cut_kids", "kids_bucket", "total_households", "customer_count"),
    ("family_mix", "cut_family_mix", "household_mix", "total_households", "customers"),
    ("ownership", "cut_ownership", "ownership_bucket", "total_hhs", "customer_count"),
    ("kids_group", "cut_kids_group", "kids_group", "total_households", "customers"),
    ("labor", "cut_labor", "labor_group", "total_households", "customers"),
    ("transport", "cut_transport", "transport_group", "total_households", "customers"),
]

ALL_CUTS_LONG = "\nUNION ALL\n".join(
    f"SELECT '{name}' AS dimension, CAST({label} AS VARCHAR) AS bucket, DAILY_TIME_KEY, "
    f"{hh} AS households, {cc} AS customers, penetration_rate FROM ({WORKBENCH_BODIES[key]}) c_{name}"
    for name, key, label, hh, cc in _SINGLES
)


def _on(day: str, col: str) -> str:
    return f"MAX(CASE WHEN DAILY_TIME_KEY = DATE '{day}' THEN {col} END)"


YOY_CHANGE = (
    "SELECT dimension, bucket,\n"
    f"    {_on('2025-03-31', 'households')} AS households_current,\n"
    f"    {_on('2025-03-31', 'customers')} AS customers_current,\n"
    f"    {_on('2025-03-31', 'penetration_rate')} AS penetration_current,\n"
    f"    {_on('2024-03-31', 'households')} AS households_prior,\n"
    f"    {_on('2024-03-31', 'customers')} AS customers_prior,\n"
    f"    {_on('2024-03-31', 'penetration_rate')} AS penetration_prior,\n"
    f"    {_on('2025-03-31', 'penetration_rate')} - {_on('2024-03-31', 'penetration_rate')} AS penetration_change\n"
    f"FROM ({ALL_CUTS_LONG}) long\nGROUP BY dimension, bucket"
)

SPREAD_RANKING = (
    "SELECT dimension, DAILY_TIME_KEY, n_buckets, max_penetration, min_penetration, spread,\n"
    "    CAST(RANK() OVER (PARTITION BY DAILY_TIME_KEY ORDER BY spread DESC) AS INTEGER) AS spread_rank\n"
    "FROM (SELECT dimension, DAILY_TIME_KEY, COUNT(*) AS n_buckets, MAX(penetration_rate) AS max_penetration,\n"
    "        MIN(penetration_rate) AS min_penetration, MAX(penetration_rate) - MIN(penetration_rate) AS spread\n"
    f"      FROM ({ALL_CUTS_LONG}) long GROUP BY dimension, DAILY_TIME_KEY) s"
)


def _interaction(key: str, a: str, b: str, hh: str, cc: str) -> str:
    def margin(*part: str) -> str:
        over = f"OVER (PARTITION BY {', '.join(part)})"
        return f"CAST(SUM({cc}) {over} AS DOUBLE) / CAST(SUM({hh}) {over} AS DOUBLE)"

    pa, pb, pall = margin("DAILY_TIME_KEY", a), margin("DAILY_TIME_KEY", b), margin("DAILY_TIME_KEY")
    return (
        f"SELECT {a}, {b}, DAILY_TIME_KEY, {hh}, {cc}, penetration_rate,\n"
        f"    {pa} AS penetration_a, {pb} AS penetration_b, {pall} AS penetration_all,\n"
        f"    penetration_rate - ({pa} + {pb} - {pall}) AS interaction\n"
        f"FROM ({WORKBENCH_BODIES[key]}) x"
    )


_XTABS = [
    (key, a, b, "total_households" if key == "xtab_dwelling_kids" else "household_count")
    for key, a, b in [
        ("xtab_dwelling_kids", "DWELLING_SEGMENT", "kids_bucket"),
        ("xtab_dwelling_ownership", "DWELLING_SEGMENT", "ownership_bucket"),
        ("xtab_dwelling_family", "DWELLING_SEGMENT", "household_mix"),
        ("xtab_kids_ownership", "kids_bucket", "ownership_bucket"),
        ("xtab_kids_family", "kids_bucket", "household_mix"),
        ("xtab_ownership_family", "ownership_bucket", "household_mix"),
        ("xtab_dwelling_kids_group", "DWELLING_SEGMENT", "kids_group"),
        ("xtab_ownership_kids_group", "ownership_bucket", "kids_group"),
        ("xtab_dwelling_labor", "DWELLING_SEGMENT", "labor_group"),
        ("xtab_kids_labor", "kids_bucket", "labor_group"),
        ("xtab_ownership_labor", "ownership_bucket", "labor_group"),
        ("xtab_labor_family", "labor_group", "household_mix"),
        ("xtab_labor_kids_group", "labor_group", "kids_group"),
        ("xtab_dwelling_transport", "DWELLING_SEGMENT", "transport_group"),
        ("xtab_kids_transport", "kids_bucket", "transport_group"),
        ("xtab_ownership_transport", "ownership_bucket", "transport_group"),
        ("xtab_family_transport", "household_mix", "transport_group"),
        ("xtab_kids_group_transport", "kids_group", "transport_group"),
    ]
]
XTABS_LONG = "\nUNION ALL\n".join(
    f"SELECT '{key}' AS cross_tab, CAST({a} AS VARCHAR) AS bucket_a, CAST({b} AS VARCHAR) AS bucket_b, "
    f"DAILY_TIME_KEY, {hh} AS households, customer_count AS customers, penetration_rate "
    f"FROM ({WORKBENCH_BODIES[key]}) x_{i}"
    for i, (key, a, b, hh) in enumerate(_XTABS)
)


def _margin(*part: str) -> str:
    over = f"OVER (PARTITION BY cross_tab, {', '.join(part)})"
    return f"CAST(SUM(customers) {over} AS DOUBLE) / CAST(SUM(households) {over} AS DOUBLE)"


_MA, _MB, _MALL = _margin("DAILY_TIME_KEY", "bucket_a"), _margin("DAILY_TIME_KEY", "bucket_b"), _margin("DAILY_TIME_KEY")
ALL_INTERACTIONS = (
    "SELECT cross_tab, bucket_a, bucket_b, DAILY_TIME_KEY, households, customers, penetration_rate,\n"
    f"    {_MA} AS penetration_a, {_MB} AS penetration_b, {_MALL} AS penetration_all,\n"
    f"    penetration_rate - ({_MA} + {_MB} - {_MALL}) AS interaction\n"
    f"FROM ({XTABS_LONG}) long"
)

MIN_SAMPLE = (
    "SELECT *, household_count < 1500 AS small_sample\n"
    f"FROM ({WORKBENCH_BODIES['xtab_kids_transport']}) x"
)

MIN_SAMPLE_FILTER = f"SELECT * FROM ({WORKBENCH_BODIES['xtab_kids_transport']}) x WHERE household_count >= 1500"

AS_PERCENT = (
    "SELECT DAILY_TIME_KEY, kids_bucket, customer_count, total_households, penetration_rate * 100 AS penetration_rate\n"
    f"FROM ({WORKBENCH_BODIES['cut_kids']}) k"
)

# Correlations: a pull row is a list of 55 values; it is unnested to its column
# pairs, and one GROUP BY takes the statistics of each pair over the rows where both are known.
_STAT_COLUMNS = [*DEMOGRAPHIC_PULL_COLUMNS[1:], "penetration"]


def _with_stats(body: str, pairs: list[tuple[int, int]]) -> str:
    values = ", ".join(f"CAST({c} AS DOUBLE)" for c in _STAT_COLUMNS)
    first, second = ([p[side] + 1 for p in pairs] for side in (0, 1))
    names = "[" + ", ".join(f"'{c}'" for c in _STAT_COLUMNS) + "]"
    both = "x IS NOT NULL AND y IS NOT NULL"
    x_varies, y_varies = (f"MIN({c}) FILTER (WHERE {both}) < MAX({c}) FILTER (WHERE {both})" for c in "xy")
    return (
        f"WITH hh AS (\n{fixture_cte_sql()}\n),\n"
        f"pull AS MATERIALIZED (SELECT [{values}] AS v FROM ({DEMOGRAPHIC_PULL}) p),\n"
        f"numbered AS (SELECT v, UNNEST(range({len(pairs)})) AS k FROM pull),\n"
        f"placed AS (SELECT v, CAST({first} AS INTEGER[])[k + 1] AS a, CAST({second} AS INTEGER[])[k + 1] AS b FROM numbered),\n"
        "xy AS (SELECT a, b, v[a] AS x, v[b] AS y FROM placed),\n"
        f"pairs AS (SELECT {names}[a] AS col_a, {names}[b] AS col_b, COUNT(*) FILTER (WHERE {both}) AS n,\n"
        f"    CASE WHEN {x_varies} AND {y_varies} THEN ROUND(COVAR_POP(y, x) / SQRT(VAR_POP(x) FILTER (WHERE {both}) * VAR_POP(y) FILTER (WHERE {both})), 9) END AS r,\n"
        f"    CASE WHEN {x_varies} THEN ROUND(REGR_SLOPE(y, x), 9) END AS slope,\n"
        f"    CASE WHEN {x_varies} THEN ROUND(REGR_INTERCEPT(y, x), 9) END AS intercept\n"
        f"  FROM xy GROUP BY a, b)\n{body}"
    )


_LAST = len(_STAT_COLUMNS) - 1
_AGAINST_TARGET = [(i, _LAST) for i in range(_LAST)]
DEMOGRAPHIC_CORRELATION = _with_stats(
    "SELECT col_a, col_b, n, r FROM pairs", [(i, j) for i in range(_LAST) for j in range(i + 1, _LAST + 1)]
)
PREDICTOR_RANKING = _with_stats(
    "SELECT CAST(ROW_NUMBER() OVER (ORDER BY r_squared DESC NULLS LAST, col_a ASC) AS INTEGER) AS rank,\n"
    "    col_a AS column, n, r, r_squared\n"
    "FROM (SELECT col_a, n, r, ROUND(r * r, 9) AS r_squared FROM pairs) t",
    _AGAINST_TARGET,
)
UNIVARIATE_REGRESSION = _with_stats(
    "SELECT col_a AS column, n, slope, intercept, ROUND(r * r, 9) AS r_squared FROM pairs", _AGAINST_TARGET
)

_ACS_COLUMNS = ", ".join(DEMOGRAPHIC_PULL_COLUMNS)
ENRICHED = (
    "(SELECT h.DAILY_TIME_KEY, h.CUSTOMER_FLAG, a.* EXCLUDE (CENSUS_BLOCK_GROUP)\n"
    " FROM (SELECT DAILY_TIME_KEY, CENSUS_BLOCK_GROUP, CUSTOMER_FLAG FROM hh) h\n"
    f" LEFT JOIN (SELECT {_ACS_COLUMNS} FROM hh\n"
    f"            WHERE {SNAPS} AND CENSUS_BLOCK_GROUP IS NOT NULL\n"
    "            QUALIFY ROW_NUMBER() OVER (PARTITION BY CENSUS_BLOCK_GROUP ORDER BY DAILY_TIME_KEY DESC) = 1) a\n"
    " ON h.CENSUS_BLOCK_GROUP = a.CENSUS_BLOCK_GROUP) e"
)
ENRICH_WITH_CENSUS = _single("labor_group", False, "total_households", "customers", False, [HH0, LAB]).replace(
    "FROM hh WHERE", f"FROM {ENRICHED} WHERE"
)

_STATUS = (
    "(SELECT CENSUS_BLOCK_GROUP, CASE WHEN MAX(BULK_FLG) = 1 THEN 'has_bulk' ELSE 'no_bulk' END AS block_bulk_status\n"
    " FROM hh GROUP BY CENSUS_BLOCK_GROUP)"
)
_ENRICHED_STATUS = ENRICHED.replace("SELECT h.DAILY_TIME_KEY", "SELECT s.block_bulk_status, h.DAILY_TIME_KEY").replace(
    " ON h.CENSUS_BLOCK_GROUP = a.CENSUS_BLOCK_GROUP) e",
    f" ON h.CENSUS_BLOCK_GROUP = a.CENSUS_BLOCK_GROUP LEFT JOIN {_STATUS} s ON h.CENSUS_BLOCK_GROUP = s.CENSUS_BLOCK_GROUP) e",
)
BUCKETED_LABOR_BY_STATUS = (
    f"SELECT block_bulk_status, labor_group, DAILY_TIME_KEY, {HH_COUNT} AS household_count, {CUST} AS customer_count, {RATE} AS penetration_rate\n"
    f"FROM (SELECT block_bulk_status, DAILY_TIME_KEY, CUSTOMER_FLAG, {LABEL_SQL['labor_group']} AS labor_group\n"
    f"      FROM {_ENRICHED_STATUS} WHERE {SNAPS} AND {HH0} AND {LAB} AND block_bulk_status IS NOT NULL) t\n"
    "GROUP BY block_bulk_status, labor_group, DAILY_TIME_KEY"
)
DAILY_CUBE_CUTS = "\nUNION ALL\n".join(
    [
        f"SELECT '{key}' AS cut, CAST({label} AS VARCHAR) AS bucket_a, CAST(NULL AS VARCHAR) AS bucket_b, DAILY_TIME_KEY, "
        f"{hh} AS households, {cc} AS customers, penetration_rate FROM ({WORKBENCH_BODIES[key]}) c_{key}"
        for _, key, label, hh, cc in _SINGLES
    ]
    + [f"SELECT cross_tab AS cut, bucket_a, bucket_b, DAILY_TIME_KEY, households, customers, penetration_rate FROM ({XTABS_LONG}) x"]
)

CUSTOM_DIMENSION = (
    "SELECT age_decade, DAILY_TIME_KEY, COUNT(*) AS household_count,\n"
    "    COUNT(*) FILTER (WHERE CUSTOMER_KEY > 0) AS customer_count,\n"
    "    CAST(COUNT(*) FILTER (WHERE CUSTOMER_KEY > 0) AS DOUBLE) / CAST(COUNT(*) AS DOUBLE) AS penetration_rate\n"
    "FROM (SELECT DAILY_TIME_KEY, CUSTOMER_KEY, CAST(FLOOR(MEDIAN_HH_AGE / 10) * 10 AS INTEGER) AS age_decade\n"
    f"      FROM hh WHERE {SNAPS} AND MEDIAN_HH_AGE IS NOT NULL) t\n"
    "GROUP BY age_decade, DAILY_TIME_KEY"
)

# The user's own dimension through the long form, the comparison, the ranking and the interactions.
_DECADE = "CAST(FLOOR(MEDIAN_HH_AGE / 10) * 10 AS INTEGER)"
_DECADE_ROWS = "MEDIAN_HH_AGE IS NOT NULL"


def _labelled(name: str, label: str, where: list[str], customer: str) -> str:
    conds = " AND ".join([SNAPS, *where])
    return (
        f"SELECT '{name}' AS dimension, CAST(b AS VARCHAR) AS bucket, DAILY_TIME_KEY, COUNT(*) AS households,\n"
        "    COUNT(*) FILTER (WHERE c) AS customers,\n"
        "    CAST(COUNT(*) FILTER (WHERE c) AS DOUBLE) / CAST(COUNT(*) AS DOUBLE) AS penetration_rate\n"
        f"FROM (SELECT DAILY_TIME_KEY, {label} AS b, {customer} AS c FROM hh WHERE {conds}) s_{name} GROUP BY b, DAILY_TIME_KEY"
    )


CUSTOM_LONG = "\nUNION ALL\n".join(
    _labelled(name, label, where, "CUSTOMER_KEY > 0")
    for name, label, where in [
        ("age_decade", _DECADE, [_DECADE_ROWS]),
        ("kids", LABEL_SQL["kids_bucket"], [KIDS]),
        ("ownership", LABEL_SQL["ownership_bucket"], [OWN]),
        ("transport", LABEL_SQL["transport_group"], [HH0, TRN]),
    ]
)


def _paired(tag: str, a: str, b: str, source: str, where: list[str]) -> str:
    conds = " AND ".join([SNAPS, *where])
    return (
        f"SELECT '{tag}' AS cross_tab, CAST(a AS VARCHAR) AS bucket_a, CAST(b AS VARCHAR) AS bucket_b, DAILY_TIME_KEY,\n"
        "    COUNT(*) AS households, COUNT(*) FILTER (WHERE c) AS customers,\n"
        "    CAST(COUNT(*) FILTER (WHERE c) AS DOUBLE) / CAST(COUNT(*) AS DOUBLE) AS penetration_rate\n"
        f"FROM (SELECT DAILY_TIME_KEY, {a} AS a, {b} AS b, CUSTOMER_FLAG = 1 AS c FROM {source} WHERE {conds}) p_{tag} GROUP BY a, b, DAILY_TIME_KEY"
    )


_WITH_STATUS = (
    "(SELECT h.*, CASE WHEN blk.mx = 1 THEN 'has_bulk' ELSE 'no_bulk' END AS block_bulk_status FROM hh h\n"
    " JOIN (SELECT CENSUS_BLOCK_GROUP, MAX(BULK_FLG) AS mx FROM hh GROUP BY CENSUS_BLOCK_GROUP) blk\n"
    "   ON h.CENSUS_BLOCK_GROUP = blk.CENSUS_BLOCK_GROUP) hs"
)
CUSTOM_PAIRS = "\nUNION ALL\n".join(
    [
        _paired("age_decade_kids", _DECADE, LABEL_SQL["kids_bucket"], "hh", [_DECADE_ROWS, KIDS]),
        _paired("dwelling_age_decade", "DWELLING_SEGMENT", _DECADE, "hh", [DWELL, _DECADE_ROWS]),
        _paired("block_bulk_age_decade", "block_bulk_status", _DECADE, _WITH_STATUS, [_DECADE_ROWS]),
    ]
)
XTAB_BLOCK_BULK_DWELLING = (
    "SELECT bucket_a AS block_bulk_status, bucket_b AS DWELLING_SEGMENT, DAILY_TIME_KEY,\n"
    "    households AS household_count, customers AS customer_count, penetration_rate\n"
    f"FROM ({_paired('x', 'block_bulk_status', 'DWELLING_SEGMENT', _WITH_STATUS, [DWELL])}) x"
)

# Bounds and tests of a difference; z and erfc as in operators.significance.
_Z = 1.959963984540054
_FIT = (-1.26551223, 1.00002368, 0.37409196, 0.09678418, -0.18628806, 0.27886807, -1.13520398, 1.48851587, -0.82215223, 0.17087277)


def _wilson(c: str, n: str) -> tuple[str, str]:
    p, n = f"(CAST({c} AS DOUBLE) / {n})", f"CAST({n} AS DOUBLE)"
    z2 = f"CAST({_Z * _Z!r} AS DOUBLE)"
    middle = f"({p} + {z2} / (2 * {n}))"
    half = f"CAST({_Z!r} AS DOUBLE) * SQRT({p} * (1 - {p}) / {n} + {z2} / (4 * {n} * {n}))"
    return (f"ROUND(GREATEST(0.0::DOUBLE, ({middle} - {half}) / (1 + {z2} / {n})), 9)", f"ROUND(LEAST(1.0::DOUBLE, ({middle} + {half}) / (1 + {z2} / {n})), 9)")


def _erfc() -> str:
    fit = "0.0::DOUBLE"
    for a in reversed(_FIT[1:]):
        fit = f"t * ({a}::DOUBLE + {fit})"
    return f"LEAST(1.0::DOUBLE, t * EXP(-x * x + ({_FIT[0]}::DOUBLE) + {fit}))"


_LOW_C, _HIGH_C = _wilson("customers_current", "households_current")
_LOW_P, _HIGH_P = _wilson("customers_prior", "households_prior")
_POOLED = "(CAST(customers_current + customers_prior AS DOUBLE) / (households_current + households_prior))"
_ERROR = f"SQRT({_POOLED} * (1 - {_POOLED}) * (1.0::DOUBLE / households_current + 1.0::DOUBLE / households_prior))"
_DIFFERENCE = "CAST(customers_current AS DOUBLE) / households_current - CAST(customers_prior AS DOUBLE) / households_prior"
YOY_SIGNIFICANCE = (
    "SELECT * EXCLUDE (x, t, z, p, q), ROUND(z, 9) AS z, ROUND(p, 9) AS p_value, ROUND(q, 9) AS q_value, q <= 0.2::DOUBLE AS significant\n"
    "FROM (SELECT *, CASE WHEN p IS NOT NULL THEN LEAST(1.0::DOUBLE, (\n"
    "        SELECT MIN(j.p * (SELECT COUNT(m.p) FROM tests m WHERE m.dimension = i.dimension)\n"
    "               / (SELECT COUNT(m.p) FROM tests m WHERE m.dimension = i.dimension AND m.p <= j.p))\n"
    "        FROM tests j WHERE j.dimension = i.dimension AND j.p >= i.p)) END AS q FROM tests i) f"
)
YOY_SIGNIFICANCE = (
    f"WITH hh AS (\n{fixture_cte_sql()}\n),\n"
    f"change AS MATERIALIZED ({YOY_CHANGE}),\n"
    f"zs AS (SELECT *, {_LOW_C} AS low_current, {_HIGH_C} AS high_current, {_LOW_P} AS low_prior, {_HIGH_P} AS high_prior,\n"
    f"    CASE WHEN {_ERROR} > 0 THEN ({_DIFFERENCE}) / {_ERROR} WHEN {_ERROR} = 0 THEN 0.0::DOUBLE END AS z FROM change),\n"
    "xs AS (SELECT *, ABS(z) / SQRT(2.0::DOUBLE) AS x FROM zs),\n"
    "ts AS (SELECT *, 1 / (1 + 0.5::DOUBLE * x) AS t FROM xs),\n"
    f"tests AS MATERIALIZED (SELECT *, CASE WHEN x IS NOT NULL THEN {_erfc()} END AS p FROM ts)\n" + YOY_SIGNIFICANCE
)
_LOW, _HIGH = _wilson("customer_count", "household_count")
RATE_BOUNDS = f"SELECT *, {_LOW} AS low, {_HIGH} AS high FROM ({WORKBENCH_BODIES['xtab_kids_labor']}) x"

ANALYSIS_SQL: dict[str, str] = {
    "all_cuts_long": with_hh(ALL_CUTS_LONG),
    "yoy_change": with_hh(YOY_CHANGE),
    "yoy_significance": YOY_SIGNIFICANCE,
    "rate_bounds": with_hh(RATE_BOUNDS),
    "spread_ranking": with_hh(SPREAD_RANKING),
    "interaction_dwelling_kids": with_hh(
        _interaction("xtab_dwelling_kids", "DWELLING_SEGMENT", "kids_bucket", "total_households", "customer_count")
    ),
    "interaction_kids_transport": with_hh(
        _interaction("xtab_kids_transport", "kids_bucket", "transport_group", "household_count", "customer_count")
    ),
    "all_interactions": with_hh(ALL_INTERACTIONS),
    "min_sample": with_hh(MIN_SAMPLE),
    "min_sample_filter": with_hh(MIN_SAMPLE_FILTER),
    "as_percent": with_hh(AS_PERCENT),
    "demographic_correlation": DEMOGRAPHIC_CORRELATION,
    "predictor_ranking": PREDICTOR_RANKING,
    "univariate_regression": UNIVARIATE_REGRESSION,
    "enrich_with_census": with_hh(ENRICH_WITH_CENSUS),
    "bucketed_labor_by_status": with_hh(BUCKETED_LABOR_BY_STATUS),
    "daily_cube_cuts": with_hh(DAILY_CUBE_CUTS),
    "custom_dimension": with_hh(CUSTOM_DIMENSION),
    "custom_long": with_hh(CUSTOM_LONG),
    "custom_yoy": with_hh(YOY_CHANGE.replace(ALL_CUTS_LONG, CUSTOM_LONG)),
    "custom_ranking": with_hh(SPREAD_RANKING.replace(ALL_CUTS_LONG, CUSTOM_LONG)),
    "custom_interactions": with_hh(ALL_INTERACTIONS.replace(XTABS_LONG, CUSTOM_PAIRS)),
    "export_csv_round_trip": with_hh(DEMOGRAPHIC_PULL),
    "xtab_block_bulk_dwelling": with_hh(XTAB_BLOCK_BULK_DWELLING),
}

BLOCK_BULK_STATUS = with_hh(
    "SELECT CENSUS_BLOCK_GROUP, CASE WHEN MAX(BULK_FLG) = 1 THEN 'has_bulk' ELSE 'no_bulk' END AS block_bulk_status\n"
    "FROM hh GROUP BY CENSUS_BLOCK_GROUP"
)
SOURCE_SQL: dict[str, str] = {
    "block_bulk_status": BLOCK_BULK_STATUS,
    "block_bulk_status_stream": BLOCK_BULK_STATUS,
}
