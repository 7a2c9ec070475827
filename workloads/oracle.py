"""SQL counterparts of the registered queries, for DuckDB on the same tables.

Written apart from the library: the feature tables here are plain SQL over the
base tables. Every statement carries the table expressions it needs.
"""

from __future__ import annotations

Y = "estimated_delivery_days"


SINGLE = -1


def r(expression: str, name: str, digits: int = 6) -> str:
    if digits == SINGLE:
        return f"cast(cast({expression} as float) as double) as {name}"
    return f"round({expression}, {digits})+0.0 as {name}"


def rs(digits: int, *names: str) -> str:
    return ", ".join(r(f"{n}::double", n, digits) for n in names)


def ts(day: str, seconds: str) -> str:
    return f"({day} + to_seconds({seconds}))"


def hav(lat1: str, lng1: str, lat2: str, lng2: str) -> str:
    a = (f"(pow(sin((radians({lat2})-radians({lat1}))/2),2)"
         f"+cos(radians({lat1}))*cos(radians({lat2}))"
         f"*pow(sin((radians({lng2})-radians({lng1}))/2),2))")
    return f"6371.0*2*atan2(sqrt{a}, sqrt(greatest(0.0, 1-{a})))"


def days(later: str, earlier: str) -> str:
    return f"cast(floor(date_diff('microsecond', {earlier}, {later})/8.64e10) as bigint)"


def hours(later: str, earlier: str) -> str:
    return f"(date_diff('microsecond', {earlier}, {later})/3.6e9)"


def flag(condition: str) -> str:
    return f"cast(coalesce({condition}, false) as int)"


def div(top: str, bottom: str) -> str:
    return f"({top})/nullif(cast({bottom} as double), 0)"


def log1p(x: str) -> str:
    return f"case when {x} > -1 then ln(1+{x}) end"


def std_corr(x: str, y: str) -> str:
    both = f"{x} is not null and {y} is not null"
    a, b = (f"(case when {both} then cast({c} as double) end)" for c in (x, y))
    return f"covar_pop({a}, {b})/nullif(stddev_pop({a})*stddev_pop({b}), 0)"


TABLES = {
    "f_orders": f"""select o_orderkey as order_id, o_custkey as customer_id,
      {ts('o_orderdate', '(o_orderkey*7919)%86400')} as order_purchase_timestamp,
      case when o_orderkey%97=0 then null else
        {ts('o_orderdate', '(o_orderkey*7919)%86400+(o_orderkey*104729)%259200')}
        end as order_approved_at,
      case when o_orderstatus='P' then null else
        {ts('o_orderdate', '(3+o_orderkey%25)*86400')} end as order_delivered_customer_date,
      {ts('o_orderdate', '(6+cast(floor((o_custkey%97)/4) as bigint)+o_orderkey%12)*86400')}
        as order_estimated_delivery_date
      from orders""",
    "f_items": f"""select l_orderkey as order_id, l_linenumber as order_item_id,
      l_partkey as product_id, l_suppkey as seller_id,
      {ts('o_orderdate', '(2+l_partkey%12)*86400+(l_suppkey%24)*3600')} as shipping_limit_date,
      case when l_partkey%400=0 then cast(0 as double) else l_extendedprice/100 end as price,
      l_quantity*l_tax*20 as freight_value
      from lineitem join orders on l_orderkey=o_orderkey""",
    "f_payments": """select l_orderkey as order_id, l_linenumber as payment_sequential,
      case l_returnflag when 'A' then 'credit_card' when 'N' then 'boleto' else 'voucher' end
        as payment_type,
      cast(l_quantity as int)%10 as payment_installments, l_extendedprice/100 as payment_value
      from lineitem where l_orderkey%29<>0""",
    "f_reviews": """select o_orderkey as order_id, cast(1+(o_orderkey*7)%5 as int) as review_score,
      case when o_orderkey%3=0 then null
        else concat(o_orderpriority, repeat('x', cast(o_orderkey%40 as int))) end
        as review_comment_message
      from orders where o_orderkey%10<>0
      union all select o_orderkey, cast(1+o_orderkey%5 as int), 'ok'
      from orders where o_orderkey%13=0""",
    "f_products": """select p_partkey as product_id,
      case when p_partkey%41=0 then null else lower(p_type) end as product_category_name,
      case when p_partkey%41=0 then null else cast(p_partkey%7 as double) end
        as product_photos_qty,
      case when p_partkey%53=0 then null else cast(p_size*200 as double) end as product_weight_g,
      cast(10+2*p_size as double) as product_length_cm,
      cast(p_partkey%60 as double) as product_height_cm,
      cast(5+p_partkey%45 as double) as product_width_cm from part""",
    "f_sellers": """select s_suppkey as seller_id,
      cast(1000+1000*((s_suppkey*7)%97) as int) as seller_zip_code_prefix,
      concat('CITY_', cast(s_suppkey%40 as varchar)) as seller_city, n_name as seller_state
      from supplier join nation on s_nationkey=n_nationkey""",
    "f_customers": """select c_custkey as customer_id,
      cast(1000+1000*(c_custkey%97) as int) as customer_zip_code_prefix,
      concat('city_', cast(c_custkey%40 as varchar)) as customer_city, n_name as customer_state
      from customer join nation on c_nationkey=n_nationkey""",
    "f_points": """select cast(1000+1000*(c_custkey%97) as int) as zip,
      -33+cast(38*(c_custkey%97)+c_custkey%7 as double)/100 as lat,
      -70+cast(31*((c_custkey%97)*53%97)+c_custkey%5 as double)/100 as lng from customer""",
    "zips": "select zip, avg(lat) as lat, avg(lng) as lng from f_points group by zip",
    "regions": """select n_name as state, r_name as region from nation
      join region on n_regionkey=r_regionkey""",
    "types": """select order_id, payment_type, row_number() over (partition by order_id
      order by n desc, payment_type) as k from (select order_id, payment_type, count(*) as n
      from f_payments group by order_id, payment_type)""",
    "pay": """select p.order_id, max(payment_installments) as payment_installments,
      any_value(t.payment_type) as payment_type, sum(payment_value) as payment_value,
      max(payment_sequential) as payment_sequential
      from f_payments p join types t on p.order_id=t.order_id and k=1 group by p.order_id""",
    "rev": """select order_id, avg(review_score) as review_score,
      avg(length(review_comment_message)) as review_comment_length
      from f_reviews group by order_id""",
    "star": f"""select i.*, o.* exclude (order_id), p.* exclude (product_id),
      s.* exclude (seller_id), c.* exclude (customer_id),
      pay.* exclude (order_id), rev.* exclude (order_id),
      a.lat as seller_lat, a.lng as seller_lng, b.lat as customer_lat, b.lng as customer_lng,
      {days('order_estimated_delivery_date', 'order_purchase_timestamp')} as {Y}
      from f_items i join f_orders o on i.order_id=o.order_id
      join f_products p on i.product_id=p.product_id
      join f_sellers s on i.seller_id=s.seller_id
      join f_customers c on o.customer_id=c.customer_id
      join zips a on a.zip=seller_zip_code_prefix
      join zips b on b.zip=customer_zip_code_prefix
      left join pay on pay.order_id=i.order_id left join rev on rev.order_id=i.order_id""",
    "geo": f"""select star.*,
      {hav('seller_lat', 'seller_lng', 'customer_lat', 'customer_lng')} as real_distance_km,
      {hav('seller_lat', 'seller_lng', '-23.5505', '-46.6333')} as seller_hub_distance,
      abs(customer_lat-seller_lat) as seller_customer_lat_diff,
      abs(customer_lng-seller_lng) as seller_customer_lng_diff,
      cast(sign(customer_lat-seller_lat)*2+sign(customer_lng-seller_lng) as double)
        as seller_to_customer_direction,
      abs(customer_zip_code_prefix-seller_zip_code_prefix) as zip_distance,
      cast(floor(customer_zip_code_prefix/10000) as bigint) as customer_zip_prefix_bin,
      cast(floor(seller_zip_code_prefix/10000) as bigint) as seller_zip_prefix_bin,
      seller_zip_code_prefix/customer_zip_code_prefix as seller_zip_to_customer_zip_ratio,
      cast(seller_state=customer_state as int) as same_state,
      seller_state||'_'||customer_state as state_pair,
      x.region as seller_region, y.region as customer_region,
      cast(seller_state in ('NATION_0','NATION_5','NATION_10') as int) as seller_remote_flag,
      cast(regexp_matches(lower(seller_city), '^city_[0-9]$') as int) as seller_in_capital_city,
      cast(regexp_matches(customer_city, '^city_[0-9]$') as int) as customer_in_capital_city,
      cast(lower(seller_city)=lower(customer_city) as int) as is_same_city,
      cast(cast(substr(seller_state,8) as int)<10 and
        cast(substr(customer_state,8) as int) in ((cast(substr(seller_state,8) as int)+1)%25,
        (cast(substr(seller_state,8) as int)+5)%25) as int) as is_neighboring_state
      from star left join regions x on x.state=seller_state
      left join regions y on y.state=customer_state""",
    "base": f"""select geo.*, ln(1+real_distance_km) as log_distance,
      {flag('seller_region=customer_region')} as same_region,
      {flag("seller_region='AFRICA' or customer_region='AFRICA'")} as north_involved,
      {flag("customer_region='AFRICA'")} as remote_state_flag,
      {flag("seller_region='AMERICA'")} as southeast_seller,
      {flag('real_distance_km>1450')} as extreme_longhaul_flag,
      product_length_cm*product_height_cm*product_width_cm as product_volume,
      greatest(product_length_cm,product_height_cm,product_width_cm) as max_dimension_cm,
      2*(product_length_cm*product_height_cm+product_length_cm*product_width_cm
        +product_height_cm*product_width_cm) as product_surface_area,
      case product_category_name when 'economy' then 5 when 'large' then 4 when 'medium' then 3
        when 'promo' then 2 when 'small' then 1 else 2 end as category_complexity,
      {div('product_length_cm', 'product_height_cm')} as product_length_to_height_ratio,
      {div('greatest(product_length_cm,product_height_cm,product_width_cm)',
           'least(product_length_cm,product_height_cm,product_width_cm)')}
        as product_max_to_min_dimension_ratio,
      {div('product_weight_g', 'product_length_cm*product_height_cm*product_width_cm')}
        as product_density,
      {div('product_weight_g',
           'cbrt(product_length_cm*product_height_cm*product_width_cm)')} as compactness_ratio,
      {flag('greatest(product_length_cm,product_height_cm,product_width_cm)>100')}
        as is_oversized,
      {flag('product_weight_g>5000')} as heavy_item_flag,
      {flag('real_distance_km>500 and product_weight_g>2000')} as long_heavy,
      {flag('real_distance_km<200 and product_weight_g>5000')} as short_heavy,
      {flag('same_state=1 and product_weight_g>5000')} as local_heavy,
      ln(1+product_weight_g) as log_weight,
      ln(1+product_length_cm*product_height_cm*product_width_cm) as log_volume,
      real_distance_km*product_weight_g as distance_weight,
      product_length_cm*product_height_cm*product_width_cm*real_distance_km
        as volume_distance_interaction,
      {div('freight_value', 'price')} as freight_ratio,
      {div('freight_value', 'real_distance_km')} as freight_per_km,
      {div('freight_value', 'product_weight_g')} as freight_per_weight,
      {div('price', 'real_distance_km')} as price_per_km,
      ln(1+freight_value) as log_freight, ln(1+price) as log_clv,
      case when freight_value<=0 then null when freight_value<=10 then 0
        when freight_value<=20 then 1 when freight_value<=50 then 2
        when freight_value>50 then 3 end as freight_tier,
      {flag('freight_value<10')} as ultra_cheap_freight,
      {flag('order_item_id>1')} as multi_item_order,
      cast(month(order_purchase_timestamp) as int) as purchase_month,
      cast(isodow(order_purchase_timestamp)-1 as int) as purchase_dayofweek,
      cast(hour(order_purchase_timestamp) as int) as purchase_hour,
      cast(weekofyear(order_purchase_timestamp) as int) as purchase_week_of_year,
      cast(quarter(order_purchase_timestamp) as int) as quarter,
      cast(order_purchase_timestamp as date) as purchase_date,
      cast(day(last_day(order_purchase_timestamp))-day(order_purchase_timestamp) as int)
        as days_until_end_of_month,
      {days('order_purchase_timestamp', "timestamp '1995-01-01'")} as days_since_platform_launch,
      {days('shipping_limit_date', 'order_purchase_timestamp')} as shipping_limit_days,
      {hours('shipping_limit_date', 'order_approved_at')} as seller_processing_window,
      {hours('order_approved_at', 'order_purchase_timestamp')} as payment_approval_delay
      from geo""",
    "feat": f"""select base.*,
      ln(1+product_surface_area) as log_surface_area,
      quarter*purchase_dayofweek as purchase_quarter_x_dayofweek,
      case when purchase_hour<=8 then 0 when purchase_hour<=12 then 1
        when purchase_hour<=18 then 2 else 3 end as purchase_hour_bucket,
      cast(purchase_month in (1,2,6,12) as int) as holiday_pressure,
      cast(purchase_month in (7,8,9) as int) as fast_season,
      cast(purchase_month in (11,12) as int) as end_of_year,
      {log1p('days_since_platform_launch')} as log_days_since_launch,
      {log1p('payment_approval_delay')} as log_approval_delay
      from base""",
    "vol": f"""select feat.*, count(order_id) over (partition by state_pair) as route_frequency,
      count(order_id) over (partition by seller_id) as seller_order_volume,
      real_distance_km/count(order_id) over (partition by state_pair) as distance_route_ratio
      from feat""",
    "edges": """select seller_state as src, customer_state as dst, count(*) as weight
      from star group by all""",
    "days": """select purchase_date, count(*) as daily_order_count,
      case when count(*) over w = 7 then avg(count(*)) over w end as rolling_7d_orders
      from feat group by purchase_date
      window w as (order by purchase_date rows between 6 preceding and current row)""",
    "totals": """select order_id, count(order_item_id) as items_per_order,
      count(distinct seller_id) as unique_sellers_per_order,
      count(distinct product_category_name) as order_item_diversity,
      coalesce(sum(product_weight_g), 0) as total_weight,
      coalesce(sum(product_volume), 0) as total_volume,
      coalesce(sum(price), 0) as order_total_price,
      max(product_length_cm) as order_max_dimension, max(price) as max_item_price
      from feat group by order_id""",
    "ordered": f"""select feat.*, totals.* exclude (order_id),
      ln(1+total_weight) as log_total_order_weight,
      ln(1+total_volume) as log_order_total_volume,
      items_per_order/unique_sellers_per_order as items_per_seller,
      order_item_diversity*unique_sellers_per_order as order_diversity_x_sellers,
      order_total_price*unique_sellers_per_order as order_price_x_unique_sellers,
      order_total_price*payment_installments as order_total_price_x_installments,
      payment_value/items_per_order as payment_value_per_item,
      {div('payment_value', 'order_total_price')} as payment_value_vs_order_value,
      payment_value*payment_installments as payment_value_x_installments,
      {div('payment_value', 'payment_installments')} as avg_installment_value,
      {flag('payment_installments=1')} as is_single_payment,
      ln(1+payment_installments) as log_installments,
      cast(purchase_dayofweek>=5 as int)*payment_installments as weekend_purchase_x_installments,
      cast(payment_sequential*category_complexity as double) as payment_sequential_x_complexity,
      ln(1+coalesce(review_comment_length,0)) as log_review_comment,
      ln(1+payment_value*payment_installments) as log_payment_value_x_installments,
      ln(1+order_total_price*payment_installments) as log_order_total_price_x_installments
      from feat join totals on feat.order_id=totals.order_id""",
}


def fitted(train: str, apply: str) -> dict[str, str]:
    """Lookups of the training rows joined to other rows."""
    return {
        "m_seller": f"""select seller_id, count(order_id) as v, avg(review_score) as ar,
          stddev_samp(review_score) as sr,
          avg(case when payment_installments>3 then 1.0 else 0.0 end) as hi, avg(price) as ap,
          {days(f"(select max(order_purchase_timestamp) from {train})",
                "min(order_purchase_timestamp)")} as age,
          count(distinct customer_state) as reach, max(price)-min(price) as pr
          from {train} group by seller_id""",
        "m_route": f"""select state_pair, count(order_id) as v, avg({Y}) as a,
          stddev_samp({Y}) as s, cast(row_number() over (order by state_pair)-1 as int) as code
          from {train} group by state_pair""",
        "m_ss": f"""select seller_state, avg({Y}) as a,
          cast(row_number() over (order by seller_state)-1 as int) as code
          from {train} group by seller_state""",
        "m_cs": f"""select customer_state, avg({Y}) as a,
          cast(row_number() over (order by customer_state)-1 as int) as code
          from {train} group by customer_state""",
        "m_city": f"""select customer_city, count(order_id) as v,
          count(distinct seller_state) as c from {train} group by customer_city""",
        "m_product": f"""select product_id, min(order_purchase_timestamp) as f
          from {train} group by product_id""",
        "m_category": f"""select product_category_name, avg(product_photos_qty) as p
          from {train} where product_category_name is not null group by product_category_name""",
        "m_day": f"""select purchase_date, count(*) as v,
          case when count(*) over w = 7 then avg(count(*)) over w end as r7
          from {train} group by purchase_date
          window w as (order by purchase_date rows between 6 preceding and current row)""",
        "bound": f"""select quantile_cont(v, 0.25) as q from (select m_route.v from {train}
          join m_route on {train}.state_pair=m_route.state_pair)""",
        "looked": f"""select t.*, coalesce(s.v,0) as seller_order_volume,
          coalesce(s.ar,3) as seller_avg_review, coalesce(s.sr,0) as seller_review_volatility,
          coalesce(s.hi,0) as seller_high_installment_rate,
          coalesce(s.ap,(select avg(ap) from m_seller)) as seller_avg_order_value,
          coalesce(s.age,0) as seller_age_days, s.reach as seller_customer_state_reach,
          s.pr as seller_price_range, coalesce(ro.v,0) as route_frequency,
          coalesce(ro.s,(select avg(s) from m_route)) as route_variability,
          coalesce(ro.a,(select avg(a) from m_route)) as state_pair_avg_days,
          coalesce(ro.code,-1) as state_pair_cat,
          coalesce(ss.a,(select avg(a) from m_ss)) as seller_state_avg_days,
          coalesce(ss.code,-1) as seller_state_cat,
          coalesce(cs.a,(select avg(a) from m_cs)) as customer_state_avg_days,
          coalesce(cs.code,-1) as customer_state_cat,
          coalesce(ci.v,0) as customer_city_order_density,
          coalesce(ci.c,0) as customer_city_seller_concentration,
          coalesce(d.v,0) as daily_order_count, coalesce(d.r7,0) as rolling_7d_orders,
          {days('t.order_purchase_timestamp', 'p.f')} as product_catalog_age_days,
          {div('t.product_photos_qty', 'ca.p')} as photos_vs_category_avg
          from {apply} t left join m_seller s on s.seller_id=t.seller_id
          left join m_route ro on ro.state_pair=t.state_pair
          left join m_ss ss on ss.seller_state=t.seller_state
          left join m_cs cs on cs.customer_state=t.customer_state
          left join m_city ci on ci.customer_city=t.customer_city
          left join m_product p on p.product_id=t.product_id
          left join m_category ca on ca.product_category_name=t.product_category_name
          left join m_day d on d.purchase_date=t.purchase_date""",
        "derived": f"""select looked.*,
          cast(route_frequency < (select q from bound) as int) as rare_route_flag,
          {div('real_distance_km', 'route_frequency')} as distance_route_ratio,
          ln(1+seller_age_days) as log_seller_age,
          ln(1+customer_city_order_density) as log_city_density,
          ln(1+rolling_7d_orders) as log_rolling_7d,
          ln(1+{div('price', 'seller_avg_order_value')}) as log_order_value_ratio,
          ln(1+{div('real_distance_km', 'route_frequency')}) as log_distance_route_ratio,
          {log1p('coalesce(product_catalog_age_days,0)')} as log_catalog_age
          from looked""",
    }


def sql(statement: str, *more: dict[str, str]) -> str:
    tables = dict(TABLES)
    for extra in more:
        tables.update(extra)
    text = ",\n".join(f"{name} as ({body})" for name, body in tables.items())
    return f"with {text}\n{statement}"


ROW = "order_id, order_item_id, product_id, seller_id"


def stats(keys: str, source: str = "feat", y: str = Y) -> str:
    known = " and ".join(f"{k} is not null" for k in keys.split(", "))
    return (f"select {keys}, {r(f'avg({y})', 'mean')}, {r(f'stddev_samp({y})', 'std')}, "
            f"count({y}) as count from {source} where {known} group by {keys}")


def quantile_list(bins: int) -> str:
    return "[" + ", ".join(str(i / bins) for i in range(bins + 1)) + "]"


def qcut_tables(x: str, bins: int, source: str = "feat", clip: float | None = None) -> dict:
    value = x
    tables = {}
    if clip is not None:
        tables["top"] = f"select quantile_cont({x}, {clip}) as q from {source}"
        value = f"case when {x} is not null then least({x}, (select q from top)) end"
    tables["xs"] = f"select cast({value} as double) as x, {Y} from {source}"
    tables["es"] = (f"select list_distinct(quantile_cont(x, {quantile_list(bins)})) as e from xs")
    tables["binned"] = (
        "select cast(case when x is not null and len(e)>=2 then "
        f"greatest(1, len(list_filter(e, lambda z: z < x))) end as int) as bin, {Y} from xs, es")
    return tables


def qcut(x: str, bins: int, source: str = "feat", clip: float | None = None) -> str:
    return sql(stats("bin", "binned"), qcut_tables(x, bins, source, clip))


def rows(digits: int, exact: str, doubles: str = "", source: str = "feat") -> str:
    parts = [ROW] + ([exact] if exact else [])
    if doubles:
        parts.append(rs(digits, *doubles.split(", ")))
    return sql(f"select {', '.join(parts)} from {source}")


def contrast(flags: list[str], source: str) -> str:
    return " union all ".join(
        f"select '{f}' as flag, {r(f'avg(case when {f}=1 then {Y} end)', 'mean_on')}, "
        f"{r(f'avg(case when {f}=0 then {Y} end)', 'mean_off')}, "
        f"cast(sum({f}) as bigint) as rows_on, "
        + r(f"avg(case when {f}=1 then {Y} end)-avg(case when {f}=0 then {Y} end)", "difference")
        + f" from {source}" for f in flags)


def pivot(row: str, column: str, values: list[str]) -> str:
    cells = ", ".join(
        r(f"avg(case when {column}='{v}' then {Y} end)", f'"{v}"') for v in values)
    return sql(f"select {row}, {cells} from feat where {row} is not null group by {row}")


def corr_rows(names: dict[str, str], source: str) -> str:
    return " union all ".join(
        f"select '{n}' as feature, {r(std_corr(x, Y), 'r')}, "
        f"count(case when {x} is not null and {Y} is not null then 1 end) as rows from {source}"
        for n, x in names.items())


def ranked(x: str) -> str:
    return (f"select {x} as x, rank() over (order by {x}) "
            f"+ (count(*) over (partition by {x})-1)/2.0 as rk")


def pagerank_tables(rounds: int) -> dict[str, str]:
    tables = {
        "shares": "select src, dst, weight/sum(weight) over (partition by src) as share from edges",
        "nodes": "select src as node from edges union select dst from edges",
        "sized": """select node, (select count(*) from nodes) as n,
          node not in (select src from edges) as sink from nodes""",
        "pr0": "select node, sink, n, cast(1.0/n as double) as rank from sized",
    }
    for i in range(rounds):
        tables[f"pr{i + 1}"] = f"""select a.node, a.sink, a.n, 0.85*(coalesce(f.flow, 0)
          + (select coalesce(sum(case when sink then rank end), 0) from pr{i})/a.n)+0.15/a.n as rank
          from pr{i} a left join (select dst, sum(share*rank) as flow from shares
          join pr{i} on src=node group by dst) f on f.dst=a.node"""
    return tables


DEGREE = {"ends": "select src as node from edges union all select dst from edges",
          "degrees": """select node, count(*) as degree,
            count(*)/(count(*) over ()-1) as centrality from ends group by node"""}

SCREENING = {
    "habits": """select seller_id, avg(cast(purchase_dayofweek>=5 as int)) as wk,
      avg(cast(purchase_hour<8 as int)) as nt, avg(hour(order_approved_at)) as ah,
      min(order_purchase_timestamp) as first_sale from feat group by seller_id""",
    "pairs": """select seller_state as s, customer_state as c, count(*) as n from feat
      group by all""",
    "s_codes": """select seller_state as s, row_number() over (order by seller_state)-1 as k
      from (select distinct seller_state from feat)""",
    "c_codes": """select customer_state as c, row_number() over (order by customer_state)-1 as k
      from (select distinct customer_state from feat)""",
    "span": "select min(price) as lo, (max(price)-min(price))/5 as w from feat",
    "cand": f"""select o.*, s.k as sk, c.k as ck, h.wk as seller_weekend_order_ratio,
      h.nt as seller_night_order_ratio, coalesce(h.ah, 12) as seller_avg_approval_hour,
      p.n as seller_customer_state_pair_frequency,
      {days('order_purchase_timestamp', 'h.first_sale')} as seller_age,
      greatest(1, cast(price>lo as int)+cast(price>lo+w as int)+cast(price>lo+2*w as int)
        +cast(price>lo+3*w as int)+cast(price>lo+4*w as int)) as price_bin,
      total_volume as order_total_volume, product_density as product_weight_to_volume_ratio
      from ordered o join habits h on h.seller_id=o.seller_id
      join pairs p on p.s=seller_state and p.c=customer_state
      join s_codes s on s.s=seller_state join c_codes c on c.c=customer_state, span""",
    "screened": """select cand.*, payment_installments/price_bin as installment_coverage_ratio,
      customer_zip_prefix_bin*sk as customer_zip_prefix_x_seller_state_cat,
      category_complexity*purchase_month as category_x_purchase_month,
      category_complexity*sk as category_x_seller_region,
      category_complexity*ck as category_x_customer_region from cand""",
}


def screening(features: list[str]) -> dict[str, str]:
    """Report per feature: correlation, quintile statistics, verdict."""
    casts = ", ".join(f"cast({f} as double) as {f}" for f in features)
    return {
        **SCREENING,
        "wide": f"select {Y}, {casts} from screened",
        "long": f"""select feature, value, {Y} from (unpivot wide on {', '.join(features)}
          into name feature value value) where value is not null""",
        "rs": corr_rows({f: f for f in features}, "wide"),
        "es": f"""select feature, list_distinct(quantile_cont(value, {quantile_list(5)})) as e
          from long group by feature""",
        "sbins": f"""select l.feature, cast(greatest(1, len(list_filter(e, lambda z: z < value)))
          as int) as bin, avg({Y}) as mean, stddev_samp({Y}) as std, count({Y}) as count
          from long l join es on es.feature=l.feature where len(e)>=2 group by all""",
        "spreads": "select feature, max(mean)-min(mean) as spread from sbins group by feature",
    }


def p_of(t: str) -> str:
    """Two-sided tail of a t statistic over ``n`` rows: ``cos(a)^(v-1)`` by Simpson's rule,
    in shares of its height where it starts."""
    def part(low: str, top: str) -> str:
        at = f"({low}+k*(({top})-({low}))/20000)"
        return (f"(({top})-({low}))*(list_sum(list_transform(range(20001), lambda k: "
                f"case when k in (0, 20000) then 1 when k%2=1 then 4 else 2 end"
                f"*exp((n-3)*(ln(greatest(cos({at}), 1e-300))-ln(cos({low})))))))")

    start, reach = f"atan(abs({t})/sqrt(n-2))", "60/sqrt(n-2)"
    tail = part(start, f"least(pi()/2, {start}+{reach})")
    return (f"exp((n-3)*ln(cos({start})))*({tail})/(" + part("0.0", f"least(pi()/2, {reach})") + ")")


def lowess_tables(x: str, frac: float, points: int) -> dict[str, str]:
    grid = ", ".join(str(i / (points - 1)) for i in range(points))
    return {
        "xy": f"select {x} as x, cast({Y} as double) as y from star where {x} is not null",
        "total": f"select count(*) as n, cast(floor({frac}*count(*)+1e-10) as bigint) as k from xy",
        "spots": f"""select row_number() over (order by pos)-1 as g, pos from
          (select distinct unnest(quantile_cont(x, [{grid}])) as pos from xy)""",
        "dist": "select g, pos, x-pos as u, abs(x-pos) as d, y from xy, spots",
        "reach": """select g, quantile_cont(d, (k-1)/cast(n-1 as double)) as h
          from (select g, d from dist) join total on true group by g, k, n""",
        "reach2": """select g, d as h from (select g, d, row_number() over
          (partition by g order by d) as i from dist) join total on i=k""",
        "near": """select dist.*, pow(1-pow(d/h,3),3) as w from dist
          join reach2 on reach2.g=dist.g where d<h""",
    }


def build(states: list[str], regions: list[str], columns: dict[str, list[str]],
          plain_flags: list[str], correlated: dict[str, str], numeric: list[str]) -> dict[str, str]:
    """All statements by query name. The arguments are names of columns and
    category values."""
    out: dict[str, str] = {}
    out["geo_centroid"] = sql(f"select zip as zip_code_prefix, {rs(6, 'lat', 'lng')} from zips")
    out["payments_per_order"] = sql(
        "select order_id, payment_installments, payment_type, payment_sequential, "
        f"{rs(4, 'payment_value')} from pay")
    out["reviews_per_order"] = sql(
        f"select order_id, {rs(6, 'review_score', 'review_comment_length')} from rev")
    doubles = ["price", "freight_value", "seller_lat", "seller_lng", "customer_lat",
               "customer_lng", "payment_value", "review_score", "review_comment_length"]
    out["star_join"] = sql(
        f"select star.* exclude ({', '.join(doubles)}, {Y}), {rs(6, *doubles)} from star")
    out["category_translation"] = sql(
        "select upper(product_category_name) as product_category_name_english, "
        f"count(*) as items, {r('sum(round(price,4))', 'revenue', 2)} "
        "from f_items join f_products using (product_id) group by 1")

    for name, exact, inexact in (
        ("haversine_km", "", "real_distance_km"),
        ("hub_distance", "", "seller_hub_distance"),
        ("delivery_days", f"{Y}, shipping_limit_days, days_since_platform_launch", ""),
        ("approval_hours", "", "payment_approval_delay, seller_processing_window"),
        ("calendar_parts", "purchase_month, purchase_dayofweek, purchase_hour, "
         "purchase_week_of_year, quarter, purchase_date, days_until_end_of_month", ""),
        ("dims_features", "is_oversized", "product_volume, max_dimension_cm, "
         "product_surface_area, compactness_ratio, product_length_to_height_ratio, "
         "product_max_to_min_dimension_ratio"),
        ("direction_code", "", "seller_to_customer_direction"),
        ("text_flags", "seller_in_capital_city, customer_in_capital_city, is_same_city, "
         "state_pair", ""),
        ("safe_ratios", "", "freight_ratio, freight_per_km, freight_per_weight, price_per_km, "
         "product_density"),
        ("log_features", "", "log_distance, log_weight, log_volume, log_freight, log_clv, "
         "log_surface_area, log_days_since_launch, log_approval_delay"),
        ("region_map", "seller_region, customer_region, same_region, north_involved, "
         "remote_state_flag, southeast_seller, seller_remote_flag", ""),
        ("complexity_map", "category_complexity", ""),
        ("neighbour_flag", "is_neighboring_state", ""),
    ):
        out[name] = rows(9 if name == "safe_ratios" else 4, exact, inexact)

    out["dropna_clean"] = sql(
        f"select {ROW}, {rs(4, 'product_weight_g', 'freight_value', 'price')} from feat "
        "where product_weight_g is not null and freight_value is not null and price is not null")
    out["exact_sample"] = sql(
        f"select {ROW}, {rs(4, 'price')} from (select * from star "
        f"order by (order_id*7919+order_item_id*104729)%1000003, {ROW}, price limit 1000)")
    out["hash_split"] = sql(
        "select case when (order_id*7919+order_item_id*104729)%100<80 then 'train' else 'test' "
        f"end as part, count(*) as rows, cast(sum({Y}) as bigint) as days from star group by 1")
    out["clip_q99"] = sql(
        f"select {ROW}, {r('case when freight_per_km is not null then least(freight_per_km, q) end', 'freight_per_km', 4)} "
        "from feat, (select quantile_cont(freight_per_km, 0.99) as q from feat)")
    out["inf_clean"] = rows(4, "", "freight_ratio")
    out["pair_frequency"] = sql(
        f"select {ROW}, count(*) over (partition by seller_state, customer_state) "
        "as pair_frequency from feat")
    out["map_with_mean_fill"] = sql(
        f"select {ROW}, {r('coalesce(s, (select avg(s) from m))', 'route_variability')} from feat "
        "left join m on m.state_pair=feat.state_pair",
        {"m": f"select state_pair, stddev_samp({Y}) as s from feat group by state_pair "
              f"having count({Y})>=100"})
    out["date_lookup"] = sql(
        f"select {ROW}, purchase_date, daily_order_count, "
        f"{r('coalesce(rolling_7d_orders, 0)', 'rolling_7d_orders')} "
        "from feat join days using (purchase_date)")
    codes = ["seller_state", "customer_state", "state_pair"]
    out["category_codes"] = sql(
        f"select {ROW}, " + ", ".join(f"{c}_cat" for c in codes) + " from feat " + " ".join(
            f"join k_{c} using ({c})" for c in codes),
        {f"k_{c}": f"select {c}, cast(row_number() over (order by {c})-1 as int) as {c}_cat "
                   f"from (select distinct {c} from feat)" for c in codes})
    out["route_frequency"] = sql(f"select {ROW}, state_pair, route_frequency from vol")
    out["rolling_7d_orders"] = sql(
        f"select purchase_date, daily_order_count, {rs(6, 'rolling_7d_orders')} from days")
    out["seller_age"] = sql(
        f"select {ROW}, seller_age as seller_age_days, "
        f"{r(log1p('seller_age'), 'log_seller_age')} from cand", SCREENING)
    out["seller_attached_stats"] = sql(
        f"select {ROW}, {r('a', 'seller_max_price', 4)}, {r('b', 'seller_price_range', 4)}, "
        "c as seller_customer_state_reach from star join (select seller_id as sid, max(price) a, "
        "max(price)-min(price) b, count(distinct customer_state) c from star group by seller_id) "
        "on sid=seller_id")

    for name, key in (("month", "purchase_month"), ("region", "customer_region"),
                      ("seller_state", "seller_state"), ("zip_bin", "customer_zip_prefix_bin"),
                      ("item_no", "order_item_id")):
        out[f"stats_by_{name}"] = sql(stats(key))
    out["stats_by_weekday"] = sql(
        f"select purchase_dayofweek, {r(f'avg({Y})', 'mean')} from feat group by 1")
    out["stats_by_region_pair"] = sql(
        f"select seller_region, customer_region, {r(f'avg({Y})', 'mean')}, count({Y}) as count "
        "from feat group by 1, 2")
    out["stats_by_route_min10"] = sql(stats("state_pair") + f" having count({Y})>=10")
    bounds = {"rare_route_flag": ("route_frequency", 0.25, "<"),
              "high_volume_seller_flag": ("seller_order_volume", 0.75, ">"),
              "expensive_route_flag": ("freight_per_km", 0.75, ">"),
              "premium_product": ("price", 0.9, ">")}
    flagged = {
        "bounds": "select " + ", ".join(
            f"quantile_cont({c}, {p}) as q_{f}" for f, (c, p, _) in bounds.items()) + " from vol",
        "flagged": "select vol.*, " + ", ".join(
            f"{flag(f'{c} {op} q_{f}')} as {f}" for f, (c, _, op) in bounds.items())
            + " from vol, bounds"}
    out["flag_contrast"] = sql(contrast(plain_flags + list(bounds), "flagged"), flagged)
    out["order_rollup"] = sql(
        "select order_id, items_per_order, unique_sellers_per_order, order_item_diversity, "
        + rs(4, "total_weight", "total_volume", "order_total_price", "order_max_dimension",
             "max_item_price") + " from totals")
    out["seller_shares"] = sql(
        "select seller_id, " + ", ".join([
            r("avg(case when payment_installments>3 then 1.0 else 0.0 end)",
              "high_installment_rate"),
            r("avg(cast(purchase_dayofweek>=5 as int))", "weekend_ratio"),
            r("avg(cast(purchase_hour<8 as int))", "night_ratio"),
            r("avg(hour(order_approved_at))", "approval_hour"),
            r("avg(review_score)", "avg_review"),
            r("stddev_samp(review_score)", "review_volatility")]) + " from feat group by seller_id")
    out["seller_price_range"] = sql(
        f"select seller_id, {r('max(price)-min(price)', 'price_range', 4)} from star group by 1")
    out["seller_reach"] = sql(
        "select seller_id, count(distinct customer_state) as state_reach from star group by 1")
    out["product_first_sale"] = sql(
        "select product_id, min(order_purchase_timestamp) as first_sale from star group by 1")
    out["target_encoding"] = sql(
        f"select state_pair, count(order_id) as route_frequency, {r(f'avg({Y})', 'avg_days')}, "
        f"{r(f'stddev_samp({Y})', 'variability')} from feat group by 1")
    out["daily_orders"] = sql("select purchase_date, daily_order_count from days")
    out["city_density"] = sql(
        "select customer_city, count(order_id) as orders, count(distinct seller_state) "
        "as seller_states from star group by 1")
    out["state_pivot"] = pivot("seller_state", "customer_state", states)
    out["region_pivot"] = pivot("seller_region", "customer_region", regions)
    out["describe_target"] = sql(
        f"select count({Y}) as count, {r(f'avg({Y})', 'mean')}, {r(f'stddev_samp({Y})', 'std')}, "
        f"{r(f'min({Y})::double', 'min')}, " + ", ".join(
            r(f"quantile_cont({Y}::double, {q / 100})", f"q{q}") for q in (25, 50, 75))
        + f", {r(f'max({Y})::double', 'max')} from star")
    out["quantile_vector"] = sql(
        "select count(freight_per_km) as rows, " + ", ".join(
            r(f"quantile_cont(freight_per_km, {q / 100})", f"q{q}") for q in (10, 25, 50, 75, 90))
        + " from feat")

    for name, args in {
        "distance_deciles": ("real_distance_km", 10), "freight_deciles": ("freight_value", 10),
        "price_deciles": ("price", 10), "route_freq_quintiles": ("route_frequency", 5, "vol"),
        "seller_volume_quintiles": ("seller_order_volume", 5, "vol"),
        "volume_quintiles": ("product_volume", 5),
        "compactness_quintiles": ("compactness_ratio", 5, "feat", 0.99),
        "distance_ratio_deciles": ("distance_route_ratio", 10, "vol", 0.99),
    }.items():
        out[name] = qcut(*args)
    out["weight_bins"] = sql(stats("bin", "(select case when product_weight_g<=0 then null "
        "when product_weight_g<=500 then 0 when product_weight_g<=1000 then 1 "
        "when product_weight_g<=2000 then 2 when product_weight_g<=5000 then 3 "
        "when product_weight_g<=10000 then 4 when product_weight_g>10000 then 5 end as bin, "
        f"{Y} from feat)"))
    out["freight_tiers"] = sql(stats("freight_tier"))
    out["hour_buckets"] = sql(stats("purchase_hour_bucket"))
    out["holiday_windows"] = sql(
        "select case when d<=0 then null when d<=3 then 0 when d<=7 then 1 when d<=14 then 2 "
        "when d<=30 then 3 when d<=60 then 4 when d<=365 then 5 end as holiday_window, "
        f"cast(d<=7 as int) as pre_holiday_flag, count(*) as rows, {r(f'avg({Y})', 'mean')} "
        "from (select date_diff('day', purchase_date, make_date(year(purchase_date), 12, 31)) "
        f"as d, {Y} from feat) group by 1, 2")
    out["price_width_bins"] = sql(stats("bin", f"(select cast(price_bin as int) as bin, {Y} "
                                        "from cand)"), SCREENING)

    out["corr_table"] = sql(corr_rows(correlated, "vol"))
    t_of = "r*sqrt((n-2)/(1-r*r))"
    out["pearson_test"] = sql(
        f"select {r('r', 'r')}, n as rows, {r(t_of, 't', 4)}, {r(p_of(t_of), 'p', 9)} from (select "
        f"{std_corr('customer_zip_code_prefix', Y)} as r, count(*) as n from feat)")
    out["spearman"] = sql(
        f"select {r('r', 'r')}, n as rows, {r(t_of, 't', 4)}, {r(p_of(t_of), 'p', 9)} from (select corr(a, b) as r, "
        "count(*) as n from (select rank() over (order by x)+(count(*) over (partition by x)-1)/2.0"
        " as a, rank() over (order by y)+(count(*) over (partition by y)-1)/2.0 as b from "
        f"(select real_distance_km as x, {Y} as y from feat)))")
    screened = screening(columns["screened"])
    out["screening_report"] = sql(
        f"select rs.feature, r, rows, {r('spread', 'spread')}, "
        "case when abs(r)>0.03 then 'YES' else 'WEAK' end as keep, "
        "case when abs(r)>0.03 and spread>1 then 'YES' else 'NO' end as add "
        "from rs left join spreads on spreads.feature=rs.feature", screened)
    out["screening_bins"] = sql(
        f"select sbins.feature, bin, {rs(6, 'mean', 'std')}, count, r from sbins "
        "join rs on rs.feature=sbins.feature where abs(r)>=0.03 and rows>=100", screened)

    out["variable_routes_top10"] = sql(
        f"select * from ({stats('state_pair')} having count({Y})>=10) "
        "order by std desc nulls last, state_pair limit 10")
    out["stable_routes_top10"] = sql(
        f"select * from ({stats('state_pair')} having count({Y})>=10) "
        "order by std asc nulls last, state_pair limit 10")
    out["top_corridors"] = sql("select * from edges order by weight desc, src, dst limit 35")
    out["top_zip_bins"] = sql(
        f"select * from ({stats('customer_zip_prefix_bin')}) "
        "order by mean desc, customer_zip_prefix_bin limit 20")

    def hex_tables(x: str, y: str, source: str, grid: int) -> dict[str, str]:
        ny = int(grid / 3**0.5)
        return {
            "pts": f"select cast({x} as double) as x, cast({y} as double) as y from {source} "
                   f"where {x} is not null",
            "box": f"""select x0-px as x0, y0-py as y0, (x1+px-(x0-px))/{grid} as sx,
              (y1+py-(y0-py))/{ny} as sy from (select min(x) x0, max(x) x1, min(y) y0, max(y) y1,
              1e-9*(max(x)-min(x)) as px, 1e-9*(max(y)-min(y)) as py from pts)""",
            "uv": "select (x-x0)/sx as u, (y-y0)/sy as v from pts, box",
            "hexed": """select case when pow(u-round_even(u,0),2)+3*pow(v-round_even(v,0),2)
              < pow(u-floor(u)-0.5,2)+3*pow(v-floor(v)-0.5,2) then round_even(u,0)
              else floor(u)+0.5 end as u,
              case when pow(u-round_even(u,0),2)+3*pow(v-round_even(v,0),2)
              < pow(u-floor(u)-0.5,2)+3*pow(v-floor(v)-0.5,2) then round_even(v,0)
              else floor(v)+0.5 end as v from uv""",
            "hexes": "select u, v, count(*) as count from hexed group by 1, 2",
        }

    out["hexbin_counts"] = sql(
        f"select {r('u*sx+x0', 'x')}, {r('v*sy+y0', 'y')}, count, "
        f"{r('log10(count)', 'log10_count')} from hexes, box", hex_tables("price", Y, "star", 50))
    out["hexbin_log_volume"] = sql(
        "select count, count(*) as hexagons from hexes group by count",
        hex_tables("log_volume", Y, "feat", 50))

    def hist(x: str, source: str, bins: int, *more: dict[str, str]) -> str:
        return sql(
            f"select bin, {r('lo+bin*w', 'low')}, {r('lo+(bin+1)*w', 'high')}, count(*) as count "
            f"from (select cast(least(floor((x-lo)/w), {bins - 1}) as int) as bin, lo, w from "
            f"(select cast({x} as double) as x from {source}), (select min({x})::double as lo, "
            f"(max({x})-min({x}))/{float(bins)} as w from {source}) where x is not null) "
            "group by bin, lo, w", *more)

    out["histogram"] = hist("route_frequency", "vol", 50)
    out["histogram_route_std"] = hist(
        "std", "rts", 40, {"rts": f"select stddev_samp({Y}) as std from feat group by state_pair "
                           f"having count({Y})>=10"})

    def box(group: str, y: str, where: str = "true") -> str:
        return sql(
            f"select {group}, {rs(6, 'q1', 'median', 'q3')}, "
            f"{r('min(case when inside then y end)', 'low_whisker')}, "
            f"{r('max(case when inside then y end)', 'high_whisker')}, "
            "count(case when not inside then 1 end) as outliers, count(y) as count "
            "from (select *, y>=q1-1.5*(q3-q1) and y<=q3+1.5*(q3-q1) as inside from qs "
            f"join (select {group}, {y}::double as y from feat where {where}) using ({group})) "
            f"group by {group}, q1, median, q3",
            {"qs": f"select {group}, quantile_cont({y}::double, 0.25) as q1, "
                   f"quantile_cont({y}::double, 0.5) as median, "
                   f"quantile_cont({y}::double, 0.75) as q3 from feat where {where} "
                   f"group by {group}"})

    out["box_stats"] = box("customer_region", Y)
    out["box_by_item_no"] = box("order_item_id", "price", "order_item_id<=10")

    def density(points: int, cut: float, by: str = "") -> dict[str, str]:
        key, group = (f"{by}, ", f"group by {by}") if by else ("", "")
        on = f"using ({by})" if by else "on true"
        return {
            "shape": f"select {key}count(x) as n, stddev_samp(x)*pow(count(x),-0.2) as h, "
                     f"min(x) as lo, max(x) as hi from xs {group}",
            "laid": f"""select {key}g, lo-{cut}*h+g*((hi+{cut}*h)-(lo-{cut}*h))/{points - 1} as pos,
              n, h from shape, (select unnest(range(0, {points})) as g)""",
            "counts": f"select {key}x, count(*) as w from xs group by all",
            "dens": f"""select {key}g, any_value(pos) as x,
              sum(w*exp(-pow((pos-x)/h,2)/2))/(any_value(n)*any_value(h)*sqrt(2*pi())) as density
              from laid join counts {on} group by {key}g""",
        }

    out["violin_density"] = sql(
        f"select purchase_month, cast(g as int) as g, {rs(6, 'x', 'density')} from dens",
        {"xs": f"select purchase_month, {Y}::double as x from feat"},
        density(100, 2.0, "purchase_month"))
    clipped = ("select least({0}, q) as x, " + Y + "::double as y from feat, "
               "(select quantile_cont({0}, 0.99) as q from feat) where {0} is not null")
    out["kde_1d"] = sql(
        f"select cast(g as int) as g, {rs(6, 'x', 'density')} from dens",
        {"xs": clipped.format("freight_per_km")}, density(200, 3.0))
    step = "({0}1+3*h{0}-({0}0-3*h{0}))/49"
    out["kde_2d"] = sql(
        f"select cast(gx as int) as gx, cast(gy as int) as gy, {rs(9, 'x', 'y', 'density')} "
        "from dens2", {
            "xs": clipped.format("product_density"),
            "sh": """select *, sqrt(xx) as hx, sqrt(yy) as hy, xx*yy-xy*xy as det from (select
              count(*) as n, var_samp(x)*pow(count(*),-1/3.0) as xx,
              var_samp(y)*pow(count(*),-1/3.0) as yy, covar_samp(x,y)*pow(count(*),-1/3.0) as xy,
              min(x) as x0, max(x) as x1, min(y) as y0, max(y) as y1 from xs)""",
            "gr": f"""select gx, gy, x0-3*hx+gx*{step.format('x')} as ax,
              y0-3*hy+gy*{step.format('y')} as ay, sh.* from sh,
              (select unnest(range(0,50)) as gx), (select unnest(range(0,50)) as gy)""",
            "cn": "select x, y, count(*) as w from xs group by all",
            "dens2": """select gx, gy, any_value(ax) as x, any_value(ay) as y,
              sum(w*exp(-((ax-x)*(ax-x)*yy-2*(ax-x)*(ay-y)*xy+(ay-y)*(ay-y)*xx)/(2*det)))
              /(any_value(n)*2*pi()*sqrt(any_value(det))) as density from gr, cn group by 1, 2"""})
    out["month_band"] = sql(
        f"select purchase_month, {r(f'avg({Y})', 'mean')}, {r(f'stddev_samp({Y})', 'std')}, "
        f"{r(f'avg({Y})-stddev_samp({Y})', 'low')}, {r(f'avg({Y})+stddev_samp({Y})', 'high')} "
        "from feat group by 1")
    out["lowess_curve"] = sql(
        f"select cast(g as int) as g, {r('any_value(pos)', 'x')}, "
        + r("(sum(w*u*u)*sum(w*y)-sum(w*u)*sum(w*u*y))/(sum(w)*sum(w*u*u)-sum(w*u)*sum(w*u))",
            "fit") + " from near group by g", lowess_tables("price", 0.15, 50))

    out["route_edges"] = sql("select * from edges")
    out["degree_centrality"] = sql(
        f"select node, degree, {rs(6, 'centrality')} from degrees", DEGREE)
    out["pagerank"] = sql(f"select node, {rs(6, 'rank')} from pr20", pagerank_tables(20))
    place = "cast(row_number() over (order by round({0}, 9) desc, node) as int)"
    out["top_nodes"] = sql(" union all ".join(
        f"select * from (select '{name}' as measure, {place.format(value)} as place, node, "
        f"{r(value, 'value')} from {table}) where place <= 10"
        for name, value, table in (("degree", "centrality", "degrees"), ("pagerank", "rank", "pr20"))),
        {**DEGREE, **pagerank_tables(20)})
    out["corridor_sizes"] = sql(
        f"select src, dst, weight, {r('weight/4000', 'width')}, {r('centrality*8000', 'size')}, "
        f"{r('rank*10000', 'rank_size')} from (select * from edges "
        "order by weight desc, src, dst limit 35) join degrees on degrees.node=src "
        "join pr20 on pr20.node=src", DEGREE, pagerank_tables(20))

    ints = set(columns["integers"])

    def layer(names: list[str], digits: int, source: str, *more: dict[str, str]) -> str:
        exact = [n for n in names if n in ints]
        return sql(f"select {', '.join([ROW, *exact])}, "
                   f"{rs(digits, *[n for n in names if n not in ints])} from {source}", *more)

    out["feature_layer_geo"] = layer(columns["geo"], SINGLE, "feat")
    out["feature_layer_product"] = layer(columns["product"], SINGLE, "feat")
    out["feature_layer_time"] = layer(columns["time"], 4, "feat")
    out["feature_layer_order"] = layer(columns["order"], SINGLE, "ordered")
    whole = fitted("feat", "ordered")
    out["feature_layer_seller"] = layer(columns["looked_up"], 4, "derived", whole)
    first = """select derived.*, log_clv*category_complexity as clv_x_complexity,
      category_complexity*log_total_order_weight as complex_heavy_order,
      freight_ratio*log_total_order_weight as freight_burden,
      category_complexity*payment_installments as high_complexity_installment,
      payment_installments*log_approval_delay as installment_approval_lag,
      shipping_limit_days*category_complexity as shipping_window_x_complexity,
      log_total_order_weight*unique_sellers_per_order as weight_x_sellers,
      coalesce(log_approval_delay,0)+unique_sellers_per_order+coalesce(log_installments,0)
        as operational_stress from derived"""
    pairs = {
        "city_density_x_clv": "log_city_density*log_clv",
        "city_density_x_operational_stress": "log_city_density*operational_stress",
        "city_density_x_seller_age": "log_city_density*log_seller_age",
        "city_density_x_weight_sellers": "log_city_density*weight_x_sellers",
        "high_installment_x_shipping_window": "high_complexity_installment*shipping_limit_days",
        "load_x_shipping_window": "log_rolling_7d*shipping_limit_days",
        "payment_complexity_x_processing":
            "payment_value_vs_order_value*seller_processing_window",
        "pressure_x_operational_stress": "daily_order_count*operational_stress",
        "pressure_x_weight_sellers": "rolling_7d_orders*weight_x_sellers",
        "processing_window_x_clv_complexity": "seller_processing_window*clv_x_complexity",
        "processing_window_x_complexity": "seller_processing_window*category_complexity",
        "processing_window_x_installments": "seller_processing_window*log_installments",
        "processing_window_x_seller_age": "seller_processing_window*log_seller_age",
        "processing_window_x_weight": "seller_processing_window*log_total_order_weight",
        "seller_hub_distance_x_complexity": "seller_hub_distance*category_complexity",
        "seller_hub_distance_x_review": "seller_hub_distance*seller_avg_review",
        "seller_hub_distance_x_seller_age": "seller_hub_distance*log_seller_age",
        "seller_hub_distance_x_shipping_window": "seller_hub_distance*shipping_limit_days",
        "seller_reach_x_hub_distance": "seller_customer_state_reach*seller_hub_distance",
        "shipping_window_x_city_density": "shipping_window_x_complexity*log_city_density",
        "shipping_window_x_clv": "shipping_window_x_complexity*log_clv",
        "shipping_window_x_installment_lag": "shipping_limit_days*installment_approval_lag",
        "shipping_window_x_operational_stress": "shipping_limit_days*operational_stress",
        "shipping_window_x_seller_age": "shipping_limit_days*log_seller_age",
        "shipping_window_x_seller_review": "shipping_limit_days*seller_avg_review",
    }
    second = "select fst.*, " + ", ".join(f"{e} as {n}" for n, e in pairs.items()) + " from fst"
    out["feature_layer_interactions"] = layer(
        columns["interactions"], 2, "snd", whole, {"fst": first, "snd": second})
    out["feature_layer_screening"] = sql(
        f"select {ROW}, {rs(SINGLE, *columns['screened'])} from screened", SCREENING)
    mix = "(order_id*7919+order_item_id*104729)%100"
    known = ("order_delivered_customer_date is not null and product_weight_g is not null "
             "and freight_value is not null and price is not null")
    test_totals = (TABLES["totals"].replace("from feat", "from tst"))
    test_ordered = TABLES["ordered"].replace("feat", "tst").replace("totals", "ttot")
    out["encoder_transform_test"] = layer(columns["looked_up"], 4, "derived", {
        "trn": f"select * from feat where {mix}<80 and {known}",
        "tst": f"select * from feat where {mix}>=80 and {known}",
        "ttot": test_totals, "tord": test_ordered}, fitted("trn", "tord"))

    fills = {c: f"coalesce({c}::double, (select quantile_cont({c}::double, 0.5) from feat))"
             for c in numeric}
    out["standardise_impute"] = sql(
        f"select {ROW}, " + ", ".join(
            r(f"({c}-avg({c}) over ())/stddev_pop({c}) over ()", f"{c}__z", 4) for c in numeric)
        + " from filled",
        {"filled": f"select {ROW}, " + ", ".join(f"{e} as {c}" for c, e in fills.items()
                                                 if c != "price")
                   + f", {fills['price']} as price from feat"})
    return out
