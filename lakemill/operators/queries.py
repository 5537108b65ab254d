"""One query per operator of the dialect, over the driver's tables, with DuckDB SQL for the same rows.

The text in the dialect goes through the engine; the DuckDB text spells out what differs there: // for integer division,
casts of decimals to DOUBLE and of HUGEINT to BIGINT, dates cast back from timestamps, ESCAPE, and NULL order.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from ..engine import Engine

TABLES = ("region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events", "documents", "labels", "benchmark", "pages", "conversations")

#: name -> (text in the dialect, DuckDB text; None where both are the same)
QUERIES: dict[str, tuple[str, str | None]] = {
    "tpch_q1": (
        """select l_returnflag, l_linestatus, round(sum(l_quantity), 2) as sum_qty, round(sum(l_extendedprice), 2) as sum_base_price,
             round(sum(l_extendedprice * (1 - l_discount)), 2) as sum_disc_price, round(sum(l_extendedprice * (1 - l_discount) * (1 + l_tax)), 2) as sum_charge,
             round(avg(l_quantity), 6) as avg_qty, round(avg(l_extendedprice), 4) as avg_price, round(avg(l_discount), 6) as avg_disc, count(*) as count_order
           from lineitem where l_shipdate <= date '1998-12-01' - interval '90' day (3)
           group by l_returnflag, l_linestatus order by l_returnflag, l_linestatus""",
        """select l_returnflag, l_linestatus, round(sum(l_quantity), 2) as sum_qty, round(sum(l_extendedprice), 2) as sum_base_price,
             round(sum(l_extendedprice * (1 - l_discount)), 2) as sum_disc_price, round(sum(l_extendedprice * (1 - l_discount) * (1 + l_tax)), 2) as sum_charge,
             round(avg(l_quantity), 6) as avg_qty, round(avg(l_extendedprice), 4) as avg_price, round(avg(l_discount), 6) as avg_disc, count(*) as count_order
           from lineitem where l_shipdate <= date '1998-12-01' - interval '90' day group by all""",
    ),
    "tpch_q3": (
        """select l_orderkey, round(sum(l_extendedprice * (1 - l_discount)), 2) as revenue, cast(o_orderdate as date) as o_orderdate, o_orderpriority
           from customer, orders, lineitem
           where c_mktsegment = 'BUILDING' and c_custkey = o_custkey and l_orderkey = o_orderkey
             and o_orderdate < date '1998-03-15' and l_shipdate > date '1998-03-15'
           group by l_orderkey, o_orderdate, o_orderpriority order by revenue desc, o_orderdate, l_orderkey limit 10""",
        """select l_orderkey, round(sum(l_extendedprice * (1 - l_discount)), 2) as revenue, cast(o_orderdate as date) as o_orderdate, o_orderpriority
           from customer, orders, lineitem
           where c_mktsegment = 'BUILDING' and c_custkey = o_custkey and l_orderkey = o_orderkey
             and orders.o_orderdate < date '1998-03-15' and l_shipdate > date '1998-03-15'
           group by l_orderkey, orders.o_orderdate, o_orderpriority order by revenue desc, orders.o_orderdate, l_orderkey limit 10""",
    ),
    "tpch_q6": (
        """select round(sum(l_extendedprice * l_discount), 2) as revenue from lineitem
           where l_shipdate >= date '1997-01-01' and l_shipdate < date '1997-01-01' + interval '1' year
             and l_discount between 0.06 - 0.01 and 0.06 + 0.01 and l_quantity < 24""",
        """select round(sum(l_extendedprice * l_discount), 2) as revenue from lineitem
           where l_shipdate >= date '1997-01-01' and l_shipdate < date '1998-01-01'
             and l_discount between 0.06::double - 0.01::double and 0.06::double + 0.01::double and l_quantity < 24""",
    ),
    "tpch_q8": (
        """select o_year, round(sum(case when nation = 'NATION_6' then volume else 0 end) / sum(volume), 8) as mkt_share
           from (select extract(year from o_orderdate) as o_year, l_extendedprice * (1 - l_discount) as volume, n2.n_name as nation
             from part, supplier, lineitem, orders, customer, nation n1, nation n2, region
             where p_partkey = l_partkey and s_suppkey = l_suppkey and l_orderkey = o_orderkey and o_custkey = c_custkey
               and c_nationkey = n1.n_nationkey and n1.n_regionkey = r_regionkey and r_name = 'AMERICA' and s_nationkey = n2.n_nationkey
               and o_orderdate between date '1996-01-01' and date '1998-12-31' and p_type = 'ECONOMY') as all_nations
           group by o_year order by o_year""",
        None,
    ),
    "tpch_q13": (
        """select c_count, count(*) as custdist
           from (select c_custkey, count(o_orderkey) from customer left outer join orders
               on c_custkey = o_custkey and o_orderpriority not like '%URGENT%' and o_totalprice > 200000
             group by c_custkey) as c_orders (c_custkey, c_count)
           group by c_count order by custdist desc, c_count desc""",
        None,
    ),
    "tpch_q22": (
        """select cntrycode, count(*) as numcust, round(sum(c_acctbal), 2) as totacctbal
           from (select substring(c_name from 17 for 2) as cntrycode, c_acctbal from customer
             where substring(c_name from 17 for 2) in ('13', '31', '23', '29', '30', '18', '17')
               and c_acctbal > (select avg(c_acctbal) from customer where c_acctbal > 0.00)
               and not exists (select * from orders where o_custkey = c_custkey and o_orderpriority = '1-URGENT')) as custsale
           group by cntrycode order by cntrycode""",
        None,
    ),
    "scan_project": ("select n_name, n_regionkey, n_nationkey from nation", None),
    "single_row": ("select 1 as one, 'x' as x, 2.5 as half", "select 1::bigint as one, 'x' as x, 2.5::double as half"),
    "select_star": ("select * from nation", None),
    "qualified_star": ("select n.*, r.r_name from nation n join region r on n.n_regionkey = r.r_regionkey", None),
    "filter_and_or_not": ("select o_orderkey from orders where (o_orderstatus = 'F' or o_totalprice > 300000) and not o_orderpriority = '5-LOW'", None),
    "comparisons": ("select o_orderkey, o_totalprice > 200000 as big, o_orderstatus <> 'O' as not_o, o_custkey <= 700 as low, o_orderkey != 5 as not_5 from orders", None),
    "is_null": ("select c_custkey, case when c_custkey % 3 = 0 then null else c_name end is null as gone, c_name is not null as there from customer", None),
    "between_in_like": ("select p_partkey, p_name from part where p_size between 10 and 20 and p_type in ('ECONOMY', 'SMALL') and p_name not like '%1%'", None),
    "like_escape": (r"select p_partkey from part where p_name || '_x%' like '%\_x\%' and p_name like '_a%'", r"select p_partkey from part where p_name || '_x%' like '%\_x\%' escape '\' and p_name like '_a%'"),
    "in_list_nulls": ("select n_nationkey, n_nationkey in (1, 2, null) as a, n_nationkey not in (1, null) as b from nation", None),
    "case_simple_searched": ("select o_orderkey, case o_orderstatus when 'F' then 'final' when 'O' then 'open' end as word, case when o_totalprice > 250000 then 2 when o_totalprice > 100000 then 1 else 0 end as size from orders", None),
    "coalesce": ("select c_custkey, coalesce(case when c_custkey % 2 = 0 then c_acctbal end, 0) as bal from customer", None),
    "string_functions": ("select n_nationkey, upper(n_name) as up, lower(n_name) as low, length(n_name) as len, char_length(n_name) as len2, n_name || '-' || n_regionkey as tagged from nation", None),
    "substring_edges": (
        "select n_nationkey, substring(n_name, 0, 3) as a, substring(n_name from 3) as b, substr(n_name, -5, 3) as c, substring(n_name, 4, 100) as d from nation",
        "select n_nationkey, substring(n_name, 1, 2) as a, substring(n_name, 3) as b, '' as c, substring(n_name, 4, 100) as d from nation",
    ),
    "integer_division": ("select o_orderkey, (o_orderkey - 300) / 7 as q from orders", "select o_orderkey, (o_orderkey - 300) // 7 as q from orders"),
    "modulo": ("select o_orderkey, (o_orderkey - 300) % 7 as r, o_totalprice % 10 > 5 as f from orders", None),
    "arithmetic": ("select l_orderkey, l_linenumber, round(l_extendedprice / l_quantity, 4) as unit, -l_tax + +l_discount as d, 2 * l_orderkey + 1 as odd from lineitem", None),
    "round_half_away": (
        "select o_orderkey, round(o_totalprice) as a, round(o_totalprice, -2) as b, round((o_orderkey % 9 - 4) / 2.0) as c from orders",
        "select o_orderkey, round(o_totalprice) as a, round(o_totalprice / 100.0) * 100.0 as b, round((o_orderkey % 9 - 4) / 2.0::double) as c from orders",
    ),
    "abs": ("select c_custkey, abs(c_acctbal - 5000) as a, abs(c_custkey - 700) as b from customer", None),
    "casts": (
        "select o_orderkey, cast(o_totalprice as bigint) as b, cast(o_orderkey as varchar) as s, cast(o_orderdate as date) as d, cast(cast(o_orderkey as varchar(20)) as double) as x, cast(o_orderkey % 2 as boolean) as t, cast(o_orderstatus = 'F' as integer) as f, cast('on' as boolean) as y from orders",
        "select o_orderkey, cast(round(o_totalprice) as bigint) as b, cast(o_orderkey as varchar) as s, cast(o_orderdate as date) as d, cast(o_orderkey as double) as x, o_orderkey % 2 <> 0 as t, case when o_orderstatus = 'F' then 1::bigint else 0::bigint end as f, true as y from orders",
    ),
    "cast_double_text": (
        "select o_orderkey, cast(o_orderkey * 0.5 as varchar) as s from orders",
        "select o_orderkey, case when o_orderkey % 2 = 0 then cast(o_orderkey // 2 as varchar) else cast(o_orderkey // 2 as varchar) || '.5' end as s from orders",
    ),
    "date_add_months_clamp": (
        "select o_orderkey, cast(o_orderdate as date) + interval '1' month as m, cast(o_orderdate as date) - interval '1' year + interval '3' day as y, cast(o_orderdate as date) + 10 as t from orders",
        "select o_orderkey, cast(cast(o_orderdate as date) + interval 1 month as date) as m, cast(cast(o_orderdate as date) - interval 1 year + interval 3 day as date) as y, cast(o_orderdate as date) + 10 as t from orders",
    ),
    "interval_pairs": (
        "select n_nationkey, date '2024-01-31' + (interval '1' month + interval '3' day) as a, interval '1' month > interval '29' day as b, date '2024-03-31' - interval '1' month as c from nation",
        "select n_nationkey, date '2024-03-03' as a, true as b, date '2024-02-29' as c from nation",
    ),
    "date_diff": ("select o_orderkey, date '2001-12-31' - cast(o_orderdate as date) as days from orders", None),
    "extract_ymd": ("select o_orderkey, extract(year from o_orderdate) as y, extract(month from o_orderdate) as m, extract(day from o_orderdate) as d from orders", None),
    "output_names": ("select n_name, upper(n_name), cast(n_nationkey as double), extract(year from date '2020-05-01'), case when true then 1 end, count(*) from nation group by n_name, n_nationkey", 'select n_name, upper(n_name) as "upper", cast(n_nationkey as double) as n_nationkey, 2020::bigint as "extract", 1::bigint as "case", count(*) as "count" from nation group by n_name, n_nationkey'),
    "inner_join": ("select o_orderkey, c_name from orders join customer on o_custkey = c_custkey where c_acctbal > 5000", None),
    "left_join": ("select c_custkey, o_orderkey from customer left join orders on c_custkey = o_custkey and o_totalprice > 250000", None),
    "right_join": ("select c_custkey, o_orderkey from orders right outer join customer on c_custkey = o_custkey and o_totalprice > 250000", None),
    "full_join": ("select a.n_name as a, b.n_name as b from nation a full join (select * from nation where n_regionkey < 3) b on a.n_nationkey = b.n_nationkey + 5", None),
    "full_join_residual": ("select count(*) as n, count(a.n_nationkey) as na, count(b.n_nationkey) as nb from nation a full outer join nation b on a.n_regionkey = b.n_regionkey and a.n_nationkey < b.n_nationkey", None),
    "cross_join": ("select r_name, n_name from region cross join nation", None),
    "theta_join": ("select a.n_nationkey as a, b.n_nationkey as b from nation a join nation b on a.n_nationkey < b.n_nationkey and a.n_regionkey >= b.n_regionkey", None),
    "self_join": ("select a.n_name as a, b.n_name as b from nation a, nation b where a.n_regionkey = b.n_regionkey and a.n_nationkey < b.n_nationkey", None),
    "join_coerced_keys": ("select o_orderkey from orders join customer on o_custkey = c_custkey + 0.0", None),
    "null_keys_never_match": ("select a.n_nationkey as a, b.n_nationkey as b from (select case when n_nationkey > 10 then n_regionkey end as k, n_nationkey from nation) a join (select case when n_nationkey > 12 then n_regionkey end as k, n_nationkey from nation) b on a.k = b.k", None),
    "semi_exists": ("select c_custkey from customer c where exists (select 1 from orders o where o.o_custkey = c.c_custkey and o.o_totalprice > 300000)", None),
    "anti_not_exists": ("select c_custkey from customer c where not exists (select 1 from orders o where o.o_custkey = c.c_custkey and o.o_orderpriority = '1-URGENT')", None),
    "in_subquery": ("select s_name from supplier where s_nationkey in (select n_nationkey from nation where n_regionkey = 2)", None),
    "not_in_subquery": ("select s_name from supplier where s_nationkey not in (select n_nationkey from nation where n_regionkey < 3)", None),
    "not_in_null": ("select n_name from nation where n_regionkey not in (select case when r_regionkey = 0 then null else r_regionkey end from region)", None),
    "exists_or": ("select c_custkey from customer c where c_acctbal > 9000 or exists (select 1 from orders where o_custkey = c_custkey and o_totalprice > 350000)", None),
    "in_select_list": ("select n_nationkey, n_regionkey in (select r_regionkey from region where r_regionkey > 2) as late from nation", None),
    "scalar_uncorrelated": ("select o_orderkey, o_totalprice > (select avg(o_totalprice) from orders) as above from orders", None),
    "scalar_empty": ("select n_name, (select r_name from region where r_regionkey < 0) as none from nation", None),
    "correlated_scalar_avg": ("select o_orderkey from orders o where o_totalprice > 1.7 * (select avg(o_totalprice) from orders i where i.o_custkey = o.o_custkey)", None),
    "correlated_count": ("select n_name, (select count(*) from supplier where s_nationkey = n_nationkey) as suppliers from nation", None),
    "exists_two_level": ("select n_name from nation n where exists (select 1 from customer c where c.c_nationkey = n.n_nationkey and exists (select 1 from supplier s where s.s_nationkey = n.n_nationkey and s.s_acctbal > c.c_acctbal))", None),
    "not_exists_two_level": ("select r_name from region r where not exists (select 1 from nation n where n.n_regionkey = r.r_regionkey and not exists (select 1 from supplier s where s.s_nationkey = n.n_nationkey and s.s_acctbal > r.r_regionkey * 2500 - 1000))", None),
    "subquery_in_having": ("select o_custkey, count(*) as n from orders group by o_custkey having count(*) > (select 1.5 * count(*) / count(distinct o_custkey) from orders)", None),
    "subquery_in_on": ("select c_custkey, n_name from customer left join nation on c_nationkey = n_nationkey and exists (select 1 from region where r_regionkey = n_regionkey and r_regionkey > 1)", None),
    "group_by_keys": ("select o_orderstatus, o_orderpriority, count(*) as n, round(sum(o_totalprice), 2) as total from orders group by o_orderstatus, o_orderpriority", None),
    "group_by_expr": ("select extract(year from o_orderdate) + 1 as y, count(*) as n from orders group by extract(year from o_orderdate)", None),
    "group_by_constant": ("select count(*) as n from orders group by 1", "select count(*) as n from orders"),
    "group_by_null": ("select case when n_regionkey < 2 then n_regionkey end as k, count(*) as n from nation group by case when n_regionkey < 2 then n_regionkey end", None),
    "having": ("select o_custkey, count(*) as n from orders group by o_custkey having count(*) > 12 and max(o_totalprice) > 100000", None),
    "having_no_group": ("select count(*) as n from orders having count(*) > 5", None),
    "scalar_agg_empty": ("select count(*) as n, sum(o_custkey) as s, avg(o_totalprice) as a, min(o_orderstatus) as m from orders where o_orderkey < 0", "select count(*) as n, sum(o_custkey)::bigint as s, avg(o_totalprice) as a, min(o_orderstatus) as m from orders where o_orderkey < 0"),
    "sum_bigint": ("select o_custkey, sum(o_orderkey) as s, avg(o_orderkey) as a from orders group by o_custkey", "select o_custkey, sum(o_orderkey)::bigint as s, avg(o_orderkey) as a from orders group by o_custkey"),
    "count_distinct": ("select o_orderstatus, count(distinct o_custkey) as n, count(o_custkey) as c from orders group by o_orderstatus", None),
    "sum_avg_distinct": ("select l_returnflag, sum(distinct l_linenumber) as s, avg(distinct l_linenumber) as a, min(distinct l_linenumber) as lo from lineitem group by l_returnflag", "select l_returnflag, sum(distinct l_linenumber)::bigint as s, avg(distinct l_linenumber) as a, min(l_linenumber) as lo from lineitem group by l_returnflag"),
    "min_max_text_date": ("select n_regionkey, min(n_name) as a, max(n_name) as b, max(n_nationkey > 5) as t from nation group by n_regionkey", None),
    "min_max_date": ("select o_orderstatus, min(cast(o_orderdate as date)) as a, max(cast(o_orderdate as date)) as b from orders group by o_orderstatus", None),
    "agg_over_agg": ("select max(n) as most, min(n) as least, count(*) as customers from (select o_custkey, count(*) as n from orders group by o_custkey) x", None),
    "left_join_count_zero": ("select c_custkey, count(o_orderkey) as n from customer left join orders on o_custkey = c_custkey and o_orderpriority = '1-URGENT' group by c_custkey", None),
    "order_nulls": (
        "select n_nationkey, case when n_nationkey % 3 = 0 then null else n_name end as k from nation order by k desc, n_nationkey",
        "select n_nationkey, case when n_nationkey % 3 = 0 then null else n_name end as k from nation order by k desc nulls first, n_nationkey",
    ),
    "order_nulls_first": ("select n_nationkey, case when n_nationkey % 3 = 0 then null else n_name end as k from nation order by k nulls first, n_nationkey desc", None),
    "order_hidden_key": ("select c_name from customer order by c_acctbal desc, c_custkey", None),
    "order_position": ("select c_nationkey, count(*) as n from customer group by c_nationkey order by 2 desc, 1", None),
    "order_by_aggregate": ("select c_nationkey from customer group by c_nationkey order by sum(c_acctbal) desc", None),
    "limit_offset": ("select o_orderkey from orders order by o_orderkey offset 10 limit 15", "select o_orderkey from orders order by o_orderkey limit 15 offset 10"),
    "offset_alone": ("select n_nationkey from nation order by n_nationkey offset 20", None),
    "distinct": ("select distinct o_orderstatus, o_orderpriority from orders", None),
    "distinct_nulls": ("select distinct case when n_regionkey > 1 then n_regionkey end as k from nation", None),
    "derived_alias_list": ("select k, total from (select o_custkey, sum(o_totalprice), count(*) as n from orders group by o_custkey) as t (k) join (select 1 as total) u on u.total = t.n", "select k, total from (select o_custkey as k, count(*) as n from orders group by o_custkey) t join (select 1::bigint as total) u on u.total = t.n"),
    "three_valued_logic": ("select n_nationkey, (case when n_nationkey > 5 then null else true end) and n_regionkey > 1 as a, (case when n_nationkey > 5 then null else false end) or n_regionkey > 1 as o, not (case when n_nationkey > 5 then null else false end) as x from nation", None),
    "text_scan": ("select lang, count(*) as n, sum(length(text)) as chars, max(n_chars) as longest from documents group by lang", "select lang, count(*) as n, sum(length(text))::bigint as chars, max(n_chars) as longest from documents group by lang"),
    "text_join": ("select source, quality, count(*) as n from documents d join labels l on d.doc_id = l.doc_id where toxic = 0 group by source, quality", None),
    "events_by_day": ("select event_type, cast(ts as date) as day, count(*) as n, round(sum(value), 4) as v from events group by event_type, cast(ts as date)", None),
    "substring_prefix_join": ("select count(*) as n, min(s_suppkey) as least, max(c_custkey) as most from customer join supplier on substring(c_name from 16 for 3) = substring(s_name from 16 for 3) and substring(c_name, -2, 5) <> ''", "select count(*) as n, min(s_suppkey) as least, max(c_custkey) as most from customer join supplier on substring(c_name, 16, 3) = substring(s_name, 16, 3)"),
    "group_key_subquery": ("select o_custkey, (select c_name from customer where c_custkey = o_custkey) as name, count(*) as n from orders group by o_custkey", None),
    "group_key_exists": ("select o_orderstatus, o_custkey, max(o_totalprice) as most from orders group by o_orderstatus, o_custkey having exists (select 1 from customer where c_custkey = o_custkey and c_acctbal > 5000)", None),
    "theta_right_join": ("select a.n_nationkey as a, b.n_nationkey as b from (select n_nationkey from nation where n_regionkey < 2) a right join nation b on a.n_nationkey > b.n_nationkey", None),
    "theta_full_join": ("select a.n_nationkey as a, b.n_nationkey as b from (select * from nation where n_nationkey > 5) a full join (select * from nation where n_nationkey < 12) b on a.n_nationkey + 3 < b.n_nationkey", None),
    "in_subquery_types": ("select o_orderkey from orders where o_custkey in (select c_custkey + 0.0 from customer where c_acctbal < 0)", None),
    "distinct_ordered": ("select distinct o_orderpriority, o_orderstatus from orders order by o_orderstatus desc, o_orderpriority", None),
    "text_to_date": (
        "select o_orderkey, cast(' ' || cast(cast(o_orderdate as date) as varchar) as date) as d, cast(substring(cast(cast(o_orderdate as date) as varchar) from 1 for 7) || '-01' as date) as first from orders",
        "select o_orderkey, cast(o_orderdate as date) as d, cast(date_trunc('month', o_orderdate) as date) as first from orders",
    ),
    "text_to_boolean": ("select o_orderkey, cast(case o_orderstatus when 'F' then 'YES' when 'O' then ' off ' else 't' end as boolean) as b from orders", "select o_orderkey, o_orderstatus <> 'O' as b from orders"),
    "text_to_number": (
        "select o_orderkey, cast(cast(o_totalprice as varchar) as double) as x, cast('+' || cast(o_orderkey as varchar) as bigint) as k, cast('-' || cast(o_custkey as varchar) || 'e-2' as double) as e from orders",
        "select o_orderkey, o_totalprice as x, o_orderkey as k, cast('-' || o_custkey || 'e-2' as double) as e from orders",
    ),
    "turns": ("select role, count(*) as n, count(distinct conv_id) as convs, max(turn) as most from conversations group by role", None),
}

#: Columns that DuckDB returns as INTEGER; here every integer is a BIGINT.
NARROW = {
    "scan_project": "n_nationkey n_regionkey", "select_star": "n_nationkey n_regionkey", "qualified_star": "n_nationkey n_regionkey",
    "in_list_nulls": "n_nationkey", "case_simple_searched": "size", "string_functions": "n_nationkey", "substring_edges": "n_nationkey",
    "arithmetic": "l_linenumber", "interval_pairs": "n_nationkey", "theta_join": "a b", "null_keys_never_match": "a b", "in_select_list": "n_nationkey",
    "group_by_null": "k", "sum_avg_distinct": "lo", "order_nulls": "n_nationkey", "order_nulls_first": "n_nationkey",
    "order_position": "c_nationkey", "order_by_aggregate": "c_nationkey", "offset_alone": "n_nationkey", "distinct_nulls": "k",
    "three_valued_logic": "n_nationkey", "text_join": "quality", "theta_right_join": "a b", "theta_full_join": "a b", "min_max_text_date": "n_regionkey",
}

_engines: dict[tuple[int, str], Engine] = {}


def engine(spark: SparkSession, sf_dir: str) -> Engine:
    """One engine per session and folder; tables are read lazily, and a folder need not have all of them."""
    key = (id(spark), sf_dir)
    if key not in _engines:
        _engines.clear()
        made = Engine(spark)
        for n in TABLES:
            try:
                made.load_parquet(n, f"{sf_dir}/{n}.parquet", replace=True, skip=True)
            except Exception as e:  # noqa: BLE001
                if "PATH_NOT_FOUND" not in str(e):
                    raise
        _engines[key] = made
    return _engines[key]


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {name: (lambda spark, sf_dir, text=text: engine(spark, sf_dir).sql(text)) for name, (text, _) in QUERIES.items()}


def oracle_sql() -> dict[str, str]:
    out = {name: duck or text for name, (text, duck) in QUERIES.items()}
    for name, columns in NARROW.items():
        out[name] = f"select * replace ({', '.join(f'cast({c} as bigint) as {c}' for c in columns.split())}) from ({out[name]}) narrow"
    return out
