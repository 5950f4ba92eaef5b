"""Catalogue: dashboards, reports, lookups and set operations over the order tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from furrow.functions import flight as fl
from furrow.operators import reporting as rp
from furrow.session import table

D = "decimal(18,6)"


def dashboard_counts(spark, sf_dir):
    return rp.counts_with_last(table(spark, sf_dir, "customer").select("c_custkey", "c_name"), table(spark, sf_dir, "orders"), "c_custkey", "o_custkey", "o_orderdate")


def kpi_rollup(spark, sf_dir):
    c = table(spark, sf_dir, "customer")
    return c.agg(
        F.count("*").alias("n"),
        F.count_if(F.col("c_acctbal") > 0).alias("n_with"),
        rp.exact_sum(F.when(F.col("c_acctbal") > 0, F.col("c_acctbal")).otherwise(F.lit(1.0))).alias("total"),
    )


def latest_per_key(spark, sf_dir):
    e = table(spark, sf_dir, "events").select("user_id", "event_id", "ts", "event_type")
    return rp.latest_per_key(e, "user_id", F.col("ts").desc(), F.col("event_id").desc())


def left_lookup_one(spark, sf_dir):
    """Customers with their one latest order, if any."""
    o = rp.latest_per_key(table(spark, sf_dir, "orders"), "o_custkey", F.col("o_orderdate").desc(), F.col("o_orderkey"))
    c = table(spark, sf_dir, "customer")
    return c.join(o, c.c_custkey == o.o_custkey, "left").select("c_custkey", "o_orderkey", "o_orderdate")


def page_n(spark, sf_dir):
    return rp.page(table(spark, sf_dir, "orders").select("o_orderkey", "o_orderdate"), 3, F.col("o_orderdate").desc(), F.col("o_orderkey"))


def append_page(spark, sf_dir):
    o = table(spark, sf_dir, "orders").select("o_orderkey", "o_orderstatus")
    return rp.append_page(o.filter("o_orderstatus = 'F'"), o.filter("o_orderstatus <> 'P'"), "o_orderkey")


def zone_volume(spark, sf_dir):
    li = table(spark, sf_dir, "lineitem")
    v = rp.treated_volume(F.col("l_quantity").cast(D), F.col("l_discount").cast(D))
    return li.groupBy("l_suppkey").agg(rp.exact_sum(F.coalesce(v, F.lit(0))).alias("litres"), F.count("*").alias("zones"))


def litres_by_input(spark, sf_dir):
    p = table(spark, sf_dir, "part").select("p_partkey", F.concat_ws(" ", "p_name", "p_type").alias("label"))
    issue = F.element_at(F.array(*[F.lit(x) for x in ISSUES]), (F.col("p_partkey") % len(ISSUES) + 1).cast("int"))
    p = p.select("p_partkey", rp.issue_input(rp.issue_cost_key(issue, F.col("label"))).alias("input"))
    li = table(spark, sf_dir, "lineitem").select("l_partkey", (F.col("l_quantity").cast(D) * F.col("l_tax").cast(D)).alias("v"))
    return rp.litres_by_input(li.join(p, li.l_partkey == p.p_partkey), "input", F.col("v"))


MODELS = ("DJI Agras T40", "XAG P100", "XAG V40", "DJI Mavic 3 Multispectral", "Custom", "", "Homebuilt")
ISSUES = ("Low nitrogen", "n  deficiency", "Phosphorus", "Standing water", "weeds", "rust spots", "aphids", "bare patch", "Potassium", "fertilise", "unknown")


def issue_cost_key(spark, sf_dir):
    return table(spark, sf_dir, "documents").select("doc_id", rp.issue_cost_key(F.col("text")).alias("cost_key"))


def grid_totals(spark, sf_dir):
    treated = F.col("l_returnflag") == "R"
    vol = F.when(treated, F.col("l_quantity").cast(D) * F.col("l_discount").cast(D))
    li = table(spark, sf_dir, "lineitem").groupBy("l_suppkey").agg(
        F.count("*").alias("cells"),
        F.count_if(treated).alias("treated"),
        rp.exact_sum(F.when(treated, F.col("l_quantity"))).alias("area"),
        rp.exact_sum(vol).alias("volume"),
        F.min(F.when(treated, F.col("l_discount"))).alias("min_rate"),
        F.max(F.when(treated, F.col("l_discount"))).alias("max_rate"),
        F.count_if((F.col("l_linestatus") == "O") & treated).alias("operator_cells"),
    )
    return li.withColumn("loads", F.when(F.col("treated") > 0, F.ceil(F.col("volume") / 10.0)).otherwise(F.lit(0)))


def settings_merge(spark, sf_dir):
    """Stored JSON over defaults, leaf by leaf."""
    s = F.from_json("props", "k INT, unit STRING, nested STRUCT<rate: DOUBLE, on: BOOLEAN>")
    e = table(spark, sf_dir, "events").select("event_id", s.alias("s"))
    return e.select(
        "event_id",
        F.coalesce("s.k", F.lit(50)).alias("k"),
        F.coalesce("s.unit", F.lit("metric")).alias("unit"),
        F.coalesce("s.nested.rate", F.lit(4.05)).alias("rate"),
    )


def treated_report(spark, sf_dir):
    li = table(spark, sf_dir, "lineitem").groupBy("l_suppkey").agg(
        rp.exact_sum(F.when(F.col("l_returnflag") != "N", F.col("l_quantity"))).alias("treated"), rp.exact_sum(F.col("l_quantity")).alias("targeted")
    )
    shares = F.coalesce("treated", F.lit(0.0)), F.col("targeted")
    return li.withColumns({"untreated_pct": rp.percent_untreated(*shares), "savings_pct": rp.savings_percent(*shares)})


def history_delta(spark, sf_dir):
    """Each customer's spend of the last order against the one before, in percent; 0 after 0."""
    o = rp.ordinal(table(spark, sf_dir, "orders"), "o_custkey", "o_orderdate", "o_orderkey")
    b = o.select("o_custkey", (F.col("ordinal") + 1).alias("ordinal"), F.col("o_totalprice").alias("older"))
    return o.join(b, ["o_custkey", "ordinal"]).select("o_custkey", "ordinal", rp.change_percent(F.col("older"), F.col("o_totalprice")).alias("change_pct"))


def status_latest(spark, sf_dir):
    """The status machine's last code of each key, and whether its lease is stale."""
    code = F.when(F.col("event_type") == "error", 30).when(F.col("event_type") == "purchase", 40).when(F.col("event_type") == "view", 10).otherwise(20)
    e = table(spark, sf_dir, "events").withColumn("code", code)
    last = rp.latest_per_key(e, "user_id", F.col("ts").desc(), F.col("event_id").desc())
    stale = F.col("ts") < F.lit("2024-01-29 12:00:00").cast("timestamp") - F.expr("INTERVAL 15 MINUTES")
    return last.select("user_id", "code", (F.col("code").isin(20, 30) & stale).alias("claimable"))


def filter_string(spark, sf_dir):
    from furrow.functions.filters import parse_filter

    e = table(spark, sf_dir, "events")
    return e.filter(parse_filter("event_type.in.(error,view),and(event_type.eq.click,value.lt.20.5)")).select("event_id", "event_type")


def owner_filter(spark, sf_dir):
    from furrow.functions.filters import owned_by

    return owned_by(table(spark, sf_dir, "events"), 7).select("event_id", "user_id")


def half_open_range(spark, sf_dir):
    o = table(spark, sf_dir, "orders")
    lo, hi = F.lit("1996-01-01").cast("timestamp"), F.lit("1996-02-01").cast("timestamp")
    return o.filter((F.col("o_orderdate") >= lo) & (F.col("o_orderdate") < hi)).select("o_orderkey", "o_orderdate")


def semi_membership(spark, sf_dir):
    c = table(spark, sf_dir, "customer").filter("c_mktsegment = 'BUILDING'")
    o = table(spark, sf_dir, "orders")
    return o.join(c, o.o_custkey == c.c_custkey, "left_semi").groupBy("o_orderstatus").agg(F.count("*").alias("n"))


def anti_undecided(spark, sf_dir):
    c, o = table(spark, sf_dir, "customer"), table(spark, sf_dir, "orders")
    return c.join(o.filter("o_orderstatus = 'F'"), c.c_custkey == F.col("o_custkey"), "left_anti").select("c_custkey")


def union_tagged(spark, sf_dir):
    s = table(spark, sf_dir, "supplier").select(F.col("s_suppkey").alias("id"), F.col("s_acctbal").alias("rate"))
    c = table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("id"), F.col("c_mktsegment").alias("issue"))
    u = table(spark, sf_dir, "events").select("user_id").distinct().select(F.col("user_id").alias("id"))
    return rp.union_tagged(ai=s, grid=c, user=u).select("id", "rate", "issue", "source")


def day_buckets(spark, sf_dir):
    e = table(spark, sf_dir, "events").filter("event_type = 'purchase'")
    return rp.bucket_by_day(e, "ts", "event_id")


def spec_lookup(spark, sf_dir):
    """Model -> spec with an alias table and, for unknown models, the owner's tank over the defaults."""
    from furrow.sources.dimensions import resolve_specs

    names = F.array(*[F.lit(x) for x in MODELS])
    p = table(spark, sf_dir, "part").select("p_partkey", F.get(names, (F.col("p_size") % 7).cast("int")).alias("model"), F.col("p_size").cast("double").alias("tank"))
    own = F.struct(F.col("tank").alias("tank_l"))
    return resolve_specs(p, "model", own).select("p_partkey", "model_key", "is_custom", "tank_l", "spray_swath_m", "weight_kg")


def refill_plan(spark, sf_dir):
    o = table(spark, sf_dir, "orders").select("o_orderkey", fl.refills(F.col("o_totalprice") / 1000, F.lit(40.0), F.lit(80.0)).alias("p"))
    dry = F.coalesce(F.get("p.dry_fractions", F.lit(0)), F.lit(0.0))
    return o.select("o_orderkey", "p.loads", "p.refills", dry.alias("first_dry"), F.col("p.leftover").alias("leftover"))


_ISSUE = "CASE " + " ".join("WHEN regexp_matches(t, '" + "|".join([*w.split(), *([rf"\b{x}\s+def"] if x else [])]) + f"') THEN '{k}'" for w, x, k in rp.ISSUE_TESTS) + " END"
_INPUT = "CASE k " + " ".join(f"WHEN '{k}' THEN '{v}'" for k, v in rp.ISSUE_INPUT.items() if v) + " END"
_LIST = "[" + ", ".join(f"'{x}'" for x in ISSUES) + "]"

QUERIES = {
    f.__name__: f
    for f in (dashboard_counts, kpi_rollup, latest_per_key, left_lookup_one, page_n, append_page, zone_volume, litres_by_input, issue_cost_key, grid_totals, settings_merge, treated_report, history_delta, status_latest, filter_string, owner_filter, half_open_range, semi_membership, anti_undecided, union_tagged, day_buckets, spec_lookup, refill_plan)
}
ORACLES = {
    "dashboard_counts": "SELECT c_custkey, c_name, coalesce(n, 0) AS n, last_date FROM customer LEFT JOIN (SELECT o_custkey, count(*) AS n, max(o_orderdate) AS last_date FROM orders GROUP BY 1) ON c_custkey = o_custkey",
    "kpi_rollup": "SELECT count(*) AS n, count(*) FILTER (c_acctbal > 0) AS n_with, CAST(sum(CAST(CASE WHEN c_acctbal > 0 THEN c_acctbal ELSE 1 END AS DECIMAL(28,6))) AS DOUBLE) AS total FROM customer",
    "latest_per_key": "SELECT user_id, event_id, ts, event_type FROM events QUALIFY row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC) = 1",
    "left_lookup_one": "SELECT c_custkey, o_orderkey, o_orderdate FROM customer LEFT JOIN (SELECT * FROM orders QUALIFY row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderdate DESC, o_orderkey) = 1) ON c_custkey = o_custkey",
    "page_n": "SELECT o_orderkey, o_orderdate FROM orders ORDER BY o_orderdate DESC, o_orderkey LIMIT 24 OFFSET 72",
    "append_page": "SELECT o_orderkey, o_orderstatus FROM orders WHERE o_orderstatus <> 'P'",
    "zone_volume": "SELECT l_suppkey, CAST(sum(CASE WHEN l_quantity > 0 AND l_discount > 0 THEN CAST(CAST(l_quantity AS DECIMAL(18,6)) * CAST(l_discount AS DECIMAL(18,6)) AS DECIMAL(28,6)) ELSE 0 END) AS DOUBLE) AS litres, count(*) AS zones FROM lineitem GROUP BY 1",
    "litres_by_input": f"""WITH p AS (SELECT p_partkey, lower({_LIST}[p_partkey % {len(ISSUES)} + 1] || ' ' || p_name || ' ' || p_type) AS t FROM part),
        i AS (SELECT p_partkey, {_INPUT} AS input FROM (SELECT p_partkey, {_ISSUE} AS k FROM p))
        SELECT input, CAST(sum(CAST(CAST(l_quantity AS DECIMAL(18,6)) * CAST(l_tax AS DECIMAL(18,6)) AS DECIMAL(28,6))) AS DOUBLE) AS litres, count(*) AS zones
        FROM lineitem JOIN i ON l_partkey = p_partkey WHERE input IS NOT NULL GROUP BY 1""",
    "issue_cost_key": f"SELECT doc_id, {_ISSUE} AS cost_key FROM (SELECT doc_id, lower(text) || ' ' AS t FROM documents)",
    "grid_totals": """SELECT *, CASE WHEN treated > 0 THEN CAST(ceil(volume / 10) AS BIGINT) ELSE 0 END AS loads FROM (SELECT l_suppkey, count(*) AS cells, count(*) FILTER (l_returnflag = 'R') AS treated,
        CAST(sum(CAST(l_quantity AS DECIMAL(28,6))) FILTER (l_returnflag = 'R') AS DOUBLE) AS area,
        CAST(sum(CAST(CAST(l_quantity AS DECIMAL(18,6)) * CAST(l_discount AS DECIMAL(18,6)) AS DECIMAL(28,6))) FILTER (l_returnflag = 'R') AS DOUBLE) AS volume,
        min(l_discount) FILTER (l_returnflag = 'R') AS min_rate, max(l_discount) FILTER (l_returnflag = 'R') AS max_rate,
        count(*) FILTER (l_returnflag = 'R' AND l_linestatus = 'O') AS operator_cells FROM lineitem GROUP BY 1)""",
    "settings_merge": "SELECT event_id, coalesce(CAST(json_extract_string(props, '$.k') AS INTEGER), 50) AS k, coalesce(json_extract_string(props, '$.unit'), 'metric') AS unit, coalesce(CAST(json_extract_string(props, '$.nested.rate') AS DOUBLE), 4.05) AS rate FROM events",
    "treated_report": """SELECT *, CAST(floor(untreated_pct + 0.5) AS BIGINT) AS savings_pct FROM (SELECT *, greatest(0, least(100, CASE WHEN targeted > 0 THEN (1 - coalesce(treated, 0) / targeted) * 100 ELSE 0 END))::DOUBLE AS untreated_pct FROM (
        SELECT l_suppkey, CAST(sum(CAST(l_quantity AS DECIMAL(28,6))) FILTER (l_returnflag <> 'N') AS DOUBLE) AS treated, CAST(sum(CAST(l_quantity AS DECIMAL(28,6))) AS DOUBLE) AS targeted FROM lineitem GROUP BY 1))""",
    "history_delta": """SELECT o_custkey, CAST(ordinal AS INTEGER) AS ordinal, CASE WHEN older > 0 THEN (o_totalprice - older) / older * 100 ELSE 0 END AS change_pct FROM (SELECT o_custkey, o_totalprice,
        row_number() OVER w AS ordinal, lag(o_totalprice) OVER w AS older FROM orders WINDOW w AS (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey)) WHERE ordinal > 1""",
    "status_latest": """SELECT user_id, code, code IN (20, 30) AND ts < TIMESTAMP '2024-01-29 11:45:00' AS claimable FROM (SELECT *, CAST(CASE event_type WHEN 'error' THEN 30 WHEN 'purchase' THEN 40 WHEN 'view' THEN 10 ELSE 20 END AS INTEGER) AS code
        FROM events QUALIFY row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC) = 1)""",
    "filter_string": "SELECT event_id, event_type FROM events WHERE event_type IN ('error', 'view') OR (event_type = 'click' AND value < 20.5)",
    "owner_filter": "SELECT event_id, user_id FROM events WHERE user_id = 7",
    "half_open_range": "SELECT o_orderkey, o_orderdate FROM orders WHERE o_orderdate >= TIMESTAMP '1996-01-01' AND o_orderdate < TIMESTAMP '1996-02-01'",
    "semi_membership": "SELECT o_orderstatus, count(*) AS n FROM orders WHERE o_custkey IN (SELECT c_custkey FROM customer WHERE c_mktsegment = 'BUILDING') GROUP BY 1",
    "anti_undecided": "SELECT c_custkey FROM customer WHERE NOT EXISTS (SELECT 1 FROM orders WHERE o_custkey = c_custkey AND o_orderstatus = 'F')",
    "union_tagged": "SELECT s_suppkey AS id, s_acctbal AS rate, NULL AS issue, 'ai' AS source FROM supplier UNION ALL SELECT c_custkey, NULL, c_mktsegment, 'grid' FROM customer UNION ALL SELECT DISTINCT user_id, NULL, NULL, 'user' FROM events",
    "day_buckets": "SELECT strftime(ts, '%Y-%m-%d') AS day, CAST(row_number() OVER (PARTITION BY strftime(ts, '%Y-%m-%d') ORDER BY ts, event_id) AS INTEGER) AS place, event_id FROM events WHERE event_type = 'purchase'",
    "spec_lookup": f"""WITH s(k, t, w, kg) AS (VALUES ('DJI Agras T40', 40, 9, 65.5), ('XAG P100 Pro', 50, 10, 75), ('XAG V40', 16, 5, 40), ('DJI Mavic 3M', 0, 0, 0.95)), a(alias, k) AS (VALUES ('XAG P100', 'XAG P100 Pro'), ('DJI Mavic 3 Multispectral', 'DJI Mavic 3M')), p AS (SELECT p_partkey, p_size, {list(MODELS)!r}[p_size % 7 + 1] AS m FROM part)
        SELECT p_partkey, coalesce(s.k, nullif(m, ''), 'Custom') AS model_key, s.k IS NULL AS is_custom, coalesce(s.t, p_size)::DOUBLE AS tank_l, coalesce(s.w, 6)::DOUBLE AS spray_swath_m, coalesce(s.kg, 50)::DOUBLE AS weight_kg FROM p LEFT JOIN a ON a.alias = m LEFT JOIN s ON s.k = coalesce(a.k, m)""",
    "refill_plan": """WITH o AS (SELECT o_orderkey, o_totalprice / 1000 AS required FROM orders), l AS (SELECT *, greatest(1, CAST(ceil(required / 32.0::DOUBLE) AS BIGINT)) AS loads FROM o)
        SELECT o_orderkey, loads, loads - 1 AS refills, CASE WHEN loads > 1 THEN 32.0::DOUBLE / required ELSE 0 END AS first_dry, 32.0::DOUBLE * loads - required AS leftover FROM l""",
}
