"""Window functions and frames."""

from __future__ import annotations

from tidewater.plans.runner import Query as Q


def both(name: str, shown: str, oracle: str | None = None, source: str = "orders", key: str = "o_orderkey") -> Q:
    """The same expressions on both sides, but where the oracle needs its own."""
    return Q(name, f"SELECT {key}, {shown} FROM {source}", f"SELECT {key}, {oracle or shown} FROM {source}")


W = "PARTITION BY o_custkey ORDER BY o_totalprice DESC, o_orderkey"
P = "PARTITION BY l_suppkey ORDER BY l_quantity"
QUERIES = [
    both(
        "win_rank_family",
        "CAST(ROW_NUMBER() OVER (PARTITION BY o_custkey ORDER BY o_orderkey) AS BIGINT) AS rn, CAST(RANK() OVER (PARTITION BY o_orderpriority ORDER BY o_orderstatus) AS BIGINT) AS r, CAST(DENSE_RANK() OVER (PARTITION BY o_orderpriority ORDER BY o_orderstatus) AS BIGINT) AS d",
    ),
    both("win_ntile", f"NTILE(4) OVER ({W}) AS q"),
    both("win_lag_lead", f"LAG(o_totalprice) OVER ({W}) AS before, LEAD(o_totalprice, 2, 0.0) OVER ({W}) AS after, LAG(o_orderstatus, 1, 'none') OVER ({W}) AS status"),
    both(
        "win_first_last",
        f"FIRST_VALUE(o_orderkey) OVER ({W}) AS f, LAST_VALUE(o_orderkey) OVER ({W}) AS l, LAST_VALUE(o_orderkey) OVER ({W} ROWS BETWEEN UNBOUNDED PRECEDING AND UNBOUNDED FOLLOWING) AS whole",
    ),
    both("win_running_sum", "SUM(l_linenumber) OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey, l_extendedprice ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS s", "CAST(SUM(l_linenumber) OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey, l_extendedprice ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS BIGINT) AS s", "lineitem", "l_orderkey, l_linenumber"),
    both("win_range_peers", f"COUNT(*) OVER ({P}) AS n, SUM(l_linenumber) OVER ({P} RANGE BETWEEN 2 PRECEDING AND 1 FOLLOWING) AS s", f"COUNT(*) OVER ({P}) AS n, CAST(SUM(l_linenumber) OVER ({P} RANGE BETWEEN 2 PRECEDING AND 1 FOLLOWING) AS BIGINT) AS s", "lineitem", "l_orderkey, l_linenumber, l_quantity, l_suppkey"),
    both("win_groups_frame", f"SUM(l_linenumber) OVER ({P} GROUPS BETWEEN 1 PRECEDING AND 1 FOLLOWING) AS s", f"CAST(SUM(l_linenumber) OVER ({P} GROUPS BETWEEN 1 PRECEDING AND 1 FOLLOWING) AS BIGINT) AS s", "lineitem", "l_orderkey, l_linenumber, l_quantity, l_suppkey"),
    both("win_rows_sliding", f"SUM(YEAR(o_orderdate)) OVER ({W} ROWS BETWEEN 1 PRECEDING AND 2 FOLLOWING) AS s, MIN(o_totalprice) OVER ({W} ROWS 2 PRECEDING) AS m", f"CAST(SUM(YEAR(o_orderdate)) OVER ({W} ROWS BETWEEN 1 PRECEDING AND 2 FOLLOWING) AS BIGINT) AS s, MIN(o_totalprice) OVER ({W} ROWS 2 PRECEDING) AS m"),
    Q(
        "win_percentiles",
        "SELECT DISTINCT o_orderpriority, ROUND(PERCENTILE_CONT(0.25) WITHIN GROUP (ORDER BY o_totalprice) OVER (PARTITION BY o_orderpriority), 4) AS c, PERCENTILE_DISC(0.5) WITHIN GROUP (ORDER BY o_totalprice) OVER (PARTITION BY o_orderpriority) AS d FROM orders",
        "SELECT o_orderpriority, ROUND(quantile_cont(o_totalprice, 0.25), 4) AS c, quantile_disc(o_totalprice, 0.5) AS d FROM orders GROUP BY o_orderpriority",
    ),
    Q(
        "win_percentile_over_order",
        "SELECT DISTINCT o_orderstatus, ROUND(PERCENTILE_CONT(0.5) OVER (PARTITION BY o_orderstatus ORDER BY o_totalprice), 4) AS m FROM orders",
        "SELECT o_orderstatus, ROUND(quantile_cont(o_totalprice, 0.5), 4) AS m FROM orders GROUP BY o_orderstatus",
    ),
    both("win_percent_rank", "ROUND(PERCENT_RANK() OVER (PARTITION BY o_orderstatus ORDER BY o_totalprice), 9) AS p"),
    both("win_int_avg", "AVG(p_size) OVER (PARTITION BY p_brand) AS a, COUNT(DISTINCT p_type) OVER (PARTITION BY p_brand) AS d, MAX(p_retailprice) OVER (PARTITION BY p_brand) AS m", "CAST(SUM(p_size) OVER (PARTITION BY p_brand) // COUNT(p_size) OVER (PARTITION BY p_brand) AS INTEGER) AS a, COUNT(DISTINCT p_type) OVER (PARTITION BY p_brand) AS d, MAX(p_retailprice) OVER (PARTITION BY p_brand) AS m", "part", "p_partkey"),
    both("win_string_agg", "STRING_AGG(n_name, ',') OVER (PARTITION BY n_regionkey ORDER BY n_nationkey ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS s", "string_agg(n_name, ',') OVER (PARTITION BY n_regionkey ORDER BY n_nationkey ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS s", "nation", "n_nationkey"),
    Q(
        "win_over_group",
        "SELECT o_custkey, ROUND(SUM(o_totalprice), 2) AS total, CAST(RANK() OVER (ORDER BY SUM(o_totalprice) DESC, o_custkey) AS BIGINT) AS place FROM orders GROUP BY o_custkey",
        "SELECT o_custkey, ROUND(SUM(o_totalprice), 2) AS total, RANK() OVER (ORDER BY SUM(o_totalprice) DESC, o_custkey) AS place FROM orders GROUP BY o_custkey",
    ),
    both("win_in_expression", "CASE WHEN COUNT(*) OVER (PARTITION BY o_custkey) > 10 THEN 'many' ELSE 'few' END AS kind, o_orderkey - MIN(o_orderkey) OVER (PARTITION BY o_custkey) AS off"),
]
