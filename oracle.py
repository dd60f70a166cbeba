"""DuckDB SQL for every query, over the raw test tables."""

from __future__ import annotations

# --------------------------------------------------------------------------- shared parts

_LINES = """
sales_lines AS (
  SELECT *, sales - cast(l_quantity AS decimal(4,0)) * cast(p_retailprice AS decimal(12,2)) AS profit,
         sales * cast(l_tax AS decimal(3,2)) AS shipping_cost
  FROM (
    SELECT o_orderkey AS order_id, c_custkey AS customer_id, c_name AS customer_name,
           c_mktsegment AS segment, p_partkey AS product_id, p_name AS product_name,
           p_type AS category, p_brand AS sub_category, n_nationkey AS location_id,
           n_name AS country, r_name AS region,
           cast(5 * cast(l_discount AS decimal(3,2)) AS decimal(5,2)) AS discount,
           cast(l_extendedprice AS decimal(12,2))
             * (1 - cast(5 * cast(l_discount AS decimal(3,2)) AS decimal(5,2))) AS sales,
           cast(l_quantity AS bigint) AS quantity, cast(o_orderdate AS date) AS order_date,
           cast(l_shipdate AS date) AS ship_date, o_orderpriority AS order_priority,
           l_returnflag AS ship_mode, l_quantity, l_tax, p_retailprice,
           concat_ws(', ', p_name, CASE WHEN p_size % 3 <> 0 THEN p_type END,
                     CASE WHEN p_size % 3 = 2 THEN 'size ' || p_size END) AS listed_name
    FROM lineitem JOIN orders ON l_orderkey = o_orderkey JOIN part ON l_partkey = p_partkey
    JOIN customer ON o_custkey = c_custkey JOIN nation ON c_nationkey = n_nationkey
    JOIN region ON n_regionkey = r_regionkey))"""

_DISCOUNT = (
    _LINES
    + """,
base AS (
  SELECT order_id, product_id, location_id, sales, quantity, discount, profit, order_date,
         product_name, category, sub_category, country, region,
         cast(year(order_date) AS integer) AS year, strftime(order_date, '%Y-%m') AS month_year,
         CASE WHEN sales = 0 THEN 0.0
              ELSE cast(profit AS double) / cast(sales AS double) * 100 END AS profit_margin,
         cast(CASE WHEN discount * 100 <= -0.01 THEN NULL WHEN discount * 100 <= 10 THEN 1
              WHEN discount * 100 <= 20 THEN 2 WHEN discount * 100 <= 30 THEN 3
              WHEN discount * 100 <= 40 THEN 4 WHEN discount * 100 <= 100 THEN 5 END AS integer)
           AS range_no
  FROM sales_lines),
discount_base AS (
  SELECT *, ['0-10%', '10-20%', '20-30%', '30-40%', '40%+'][range_no] AS discount_range FROM base),
products AS (
  SELECT product_name, cast(sum(sales) AS double) AS sales, cast(sum(profit) AS double) AS profit,
         round_even(avg(profit_margin) * 1000000, 0) / 1000000 AS profit_margin,
         cast(sum(discount) AS double) / count(*) * 100 AS avg_discount,
         count(*) AS order_count
  FROM discount_base GROUP BY product_name),
used_ranges AS (
  SELECT range_no, any_value(discount_range) AS discount_range,
         cast(sum(profit) AS double) / count(*) AS avg_profit,
         cast(sum(profit) AS double) AS total_profit, count(*) AS order_count,
         cast(sum(sales) AS double) AS total_sales,
         cast(sum(discount) AS double) / count(*) * 100 AS avg_discount
  FROM discount_base WHERE range_no IS NOT NULL GROUP BY range_no),
ranges AS (
  SELECT n.range_no, n.label AS discount_range, avg_profit,
         coalesce(total_profit, 0) AS total_profit,
         coalesce(order_count, 0) AS order_count, coalesce(total_sales, 0) AS total_sales,
         avg_discount, coalesce(CASE WHEN total_sales <> 0
           THEN total_profit / total_sales * 100 END, 0) AS profit_margin
  FROM (VALUES (1, '0-10%'), (2, '10-20%'), (3, '20-30%'), (4, '30-40%'), (5, '40%+'))
       n(range_no, label) LEFT JOIN used_ranges USING (range_no)),
related AS (
  SELECT CASE WHEN isfinite(r) THEN r END AS value, CASE WHEN isfinite(r) THEN round_even(r * 1000000, 0) / 1000000 END AS correlation
  FROM (SELECT corr(cast(discount AS double), cast(profit AS double)) AS r FROM discount_base))"""
)

_IMPACT = """CASE WHEN value IS NULL THEN 'unreadable'
    WHEN value < -0.3 THEN 'strong negative' WHEN value < -0.1 THEN 'weak negative'
    WHEN value > 0.1 THEN 'positive' ELSE 'not significant' END"""

_HIDDEN_BASE = (
    _LINES
    + """,
facts AS (
  SELECT product_id, region, cast(sum(quantity) AS bigint) AS total_qty,
         count(DISTINCT order_id) AS frequency, cast(sum(profit) AS double) AS total_profit,
         cast(sum(sales) AS double) AS total_sales
  FROM sales_lines GROUP BY product_id, region),
hidden_base AS (
  SELECT product_id, region, p_name AS product_name, p_name AS full_name, p_type AS category,
         p_brand AS sub_category,
         CASE WHEN p_size % 3 <> 0 THEN p_type ELSE 'not have' END AS type,
         CASE WHEN p_size % 3 = 2 THEN 'size ' || p_size ELSE 'not have' END AS variant,
         total_qty, frequency, total_profit, total_sales
  FROM facts LEFT JOIN part ON p_partkey = product_id)"""
)


def _quantile(column: str, at: float) -> str:
    found = f"quantile_cont(cast({column} AS double), {at})"
    return f"round_even({found} * 1e7, 0) / 1e7"


def _metrics(where: str = "true") -> str:
    return (
        _HIDDEN_BASE
        + f""",
metrics AS (
  SELECT *, round_even(total_profit / nullif(total_sales, 0) * 100 * 100, 0) / 100 AS profit_margin,
         round_even(total_sales / nullif(total_qty, 0) * 100, 0) / 100 AS price_per_unit,
         round_even(total_profit / nullif(total_qty, 0) * 100, 0) / 100 AS profit_per_unit,
         round_even(total_profit / frequency * 100, 0) / 100 AS avg_profit_per_order,
         round_even(total_sales / frequency * 100, 0) / 100 AS avg_sales_per_order
  FROM hidden_base WHERE {where}),
limits AS (
  SELECT {_quantile('frequency', 0.50)} AS freq_th, {_quantile('total_profit', 0.95)} AS profit_th,
         {_quantile('profit_margin', 0.90)} AS margin_th,
         {_quantile('avg_profit_per_order', 0.95)} AS avg_profit_th
  FROM metrics),
segmented AS (
  SELECT metrics.*, CASE
      WHEN frequency <= freq_th AND avg_profit_per_order >= avg_profit_th THEN 'Hidden High-Value'
      WHEN frequency > freq_th AND avg_profit_per_order >= avg_profit_th THEN 'Core Product'
      WHEN frequency <= freq_th AND avg_profit_per_order < avg_profit_th THEN 'Low Impact Niche'
      ELSE 'Volume Driver' END AS segment
  FROM metrics, limits),
hidden AS (SELECT * FROM segmented WHERE segment = 'Hidden High-Value')"""
    )


_METRICS = _metrics()

_MIX = (
    _METRICS
    + """,
mix AS (
  SELECT region, category, count(DISTINCT product_id) AS hidden_count,
         cast(sum(cast(total_profit AS decimal(38,4))) AS double) AS total_profit
  FROM hidden GROUP BY region, category),
totals AS (
  SELECT region, count(DISTINCT product_id) AS hidden_count,
         cast(sum(cast(total_profit AS decimal(38,4))) AS double) AS total_profit
  FROM hidden GROUP BY region)"""
)

_BASKETS = """
items AS (
  SELECT l_orderkey AS order_id, l_partkey AS product_id,
         cast(l_extendedprice AS decimal(12,2))
           * (1 - cast(5 * cast(l_discount AS decimal(3,2)) AS decimal(5,2))) AS sales
  FROM lineitem),
order_sums AS (SELECT order_id, sum(sales) AS order_total FROM items GROUP BY order_id),
traps AS (
  SELECT product_id, any_value(p_name) AS product_name, count(*) AS frequency,
         cast(sum(order_total) AS double) / count(*) AS avg_basket_value
  FROM items JOIN order_sums USING (order_id) LEFT JOIN part ON p_partkey = product_id
  GROUP BY product_id),
ranked AS (SELECT *, frequency * avg_basket_value AS trap_score FROM traps)"""

_KEYS = (
    _LINES
    + """,
product_keys AS (
  SELECT format('{:05d}', row_number() OVER (ORDER BY listed_name, category, sub_category))
           AS product_key, listed_name, category, sub_category
  FROM (SELECT DISTINCT listed_name, category, sub_category FROM sales_lines)),
location_keys AS (
  SELECT format('{:04d}', row_number() OVER (ORDER BY country, region)) AS location_key,
         country, region
  FROM (SELECT DISTINCT country, region FROM sales_lines)),
keyed AS (
  SELECT s.*, product_key, location_key FROM sales_lines s
  JOIN product_keys USING (listed_name, category, sub_category)
  JOIN location_keys USING (country, region))"""
)

_LINE_ORDER = "product_id, quantity, sales, discount, shipping_cost"


def _dollars(value: str) -> str:
    return f"'$' || format('{{:,.0f}}', {value})"


def _fixed(value: str, digits: int) -> str:
    return f"format('{{:.{digits}f}}', {value})"


def _percent(value: str, digits: int = 1) -> str:
    return f"{_fixed(value, digits)} || '%'"


_HEADER = "SELECT cast(row_number() OVER (ORDER BY rank) AS integer) AS finding_no, finding, subject, value, text FROM ("


def _attribute(name: str) -> str:
    return f"""WITH {_METRICS}
      SELECT {name}, count(DISTINCT product_id) AS hidden_count,
             cast(sum(cast(total_profit AS decimal(38,4))) AS double) AS total_profit
      FROM hidden WHERE {name} <> 'not have' GROUP BY {name}"""


def _top_attribute(name: str) -> str:
    return f"""SELECT '{name}' AS attribute, coalesce(max(value), '-') AS value,
        coalesce(max(hidden_count), 0) AS hidden_count
      FROM (SELECT {name} AS value, count(DISTINCT product_id) AS hidden_count FROM hidden
            WHERE {name} <> 'not have' GROUP BY {name} ORDER BY 2 DESC, 1 LIMIT 1)"""


def _histogram(column: str, bins: int) -> str:
    return f"""WITH {_METRICS},
      span AS (SELECT cast(min({column}) AS double) AS low,
                      (cast(max({column}) AS double) - cast(min({column}) AS double)) / {bins}.0 AS width
               FROM metrics),
      binned AS (SELECT low, width, cast(least({bins - 1}, CASE WHEN width = 0 THEN 0
                   ELSE floor(({column} - low) / width) END) AS integer) AS bin
                 FROM metrics, span WHERE {column} IS NOT NULL)
      SELECT bin, any_value(low + bin * width) AS bin_start,
             any_value(low + (bin + 1) * width) AS bin_end, count(*) AS row_count
      FROM binned GROUP BY bin"""


def _chart(column: str, most: int) -> str:
    """Round bins: the least width that needs at most so many."""

    def place(value: str) -> str:
        return f"floor(round_even({value} * down / (step * up) * 1e9, 0) / 1e9)"

    return f"""WITH {_METRICS},
      span AS (SELECT cast(min({column}) AS double) AS low, cast(max({column}) AS double) AS high FROM metrics),
      powers AS (SELECT *, CASE WHEN high > low THEN floor(log10((high - low) / {most}.0)) ELSE 0 END AS power FROM span),
      scales AS (SELECT low, high, pow(10.0, greatest(power, 0)) AS up, pow(10.0, greatest(-power, 0)) AS down FROM powers),
      steps AS (SELECT *, unnest([1.0, 2.0, 5.0, 10.0, 20.0, 50.0]::DOUBLE[]) AS step FROM scales),
      chosen AS (SELECT * FROM steps WHERE {place('high')} - {place('low')} < {most} ORDER BY step LIMIT 1),
      binned AS (SELECT {place(f'cast({column} AS double)')} AS here, {place('low')} AS first_at, step, up, down
                 FROM metrics, chosen WHERE {column} IS NOT NULL)
      SELECT cast(here - first_at AS integer) AS bin, any_value(here * step * up / down) AS bin_start,
             any_value((here + 1) * step * up / down) AS bin_end, count(*) AS row_count
      FROM binned GROUP BY here, first_at"""


_KPIS = f""",
      totals AS (SELECT cast(sum(sales) AS double) AS total_sales, cast(sum(profit) AS double) AS total_profit,
          count(*) AS total_orders, cast(sum(discount) AS double) / count(*) * 100 AS avg_discount
        FROM discount_base),
      rated AS (SELECT *, coalesce(CASE WHEN total_sales <> 0
          THEN total_profit / total_sales * 100 END, 0) AS profit_margin FROM totals)
      SELECT total_sales, total_profit, profit_margin, total_orders, avg_discount,
             {_dollars('total_sales')} AS total_sales_text,
             {_dollars('total_profit')} AS total_profit_text,
             {_percent('profit_margin')} AS profit_margin_text,
             format('{{:,}}', total_orders) AS total_orders_text,
             {_percent('avg_discount')} AS avg_discount_text
      FROM rated"""

_CHOICES = {
    "all": "true",
    "chosen": "year(order_date) IN (1996, 1998) AND category IN ('SMALL', 'LARGE') AND region IN ('ASIA', 'EUROPE')",
    "asia_1997": "year(order_date) = 1997 AND region = 'ASIA'",
}


def _for_choices(body: str) -> str:
    """The direct query over the lines of each choice."""
    whole = "FROM sales_lines),\ndiscount_base"
    return " UNION ALL ".join(
        f"SELECT '{name}' AS choice, * FROM (WITH {_DISCOUNT.replace(whole, whole.replace(')', f' WHERE {where})', 1))} {body})"
        for name, where in _CHOICES.items()
    )


def _options(category: str, region: str) -> str:
    return f"""WITH {_DISCOUNT}
      SELECT DISTINCT 'year' AS facet, cast(year AS varchar) AS option FROM discount_base
      UNION ALL SELECT DISTINCT 'category', category FROM discount_base
      UNION ALL SELECT DISTINCT 'sub_category', sub_category FROM discount_base WHERE {category}
      UNION ALL SELECT DISTINCT 'region', region FROM discount_base
      UNION ALL SELECT DISTINCT 'country', country FROM discount_base WHERE {region}"""


_LINE_OUTPUT = """order_id, product_id, location_id, cast(sales AS double) AS sales, quantity,
  cast(discount AS double) AS discount, cast(profit AS double) AS profit, order_date, product_name,
  category, sub_category, country, region, year, month_year, profit_margin, range_no, discount_range"""

_RECAP = (
    _KEYS
    + f""",
placed AS (
  SELECT *, row_number() OVER (PARTITION BY order_id ORDER BY {_LINE_ORDER}, order_date,
            customer_id, ship_mode, ship_date) AS place
  FROM keyed)"""
)

# --------------------------------------------------------------------------- one per query

_KEYED = (
    ("customer", "c_custkey", "customer"),
    ("customer_name", "c_name", "customer"),
    ("product", "p_partkey", "part"),
    ("product_name", "p_name", "part"),
    ("catalog", "p_partkey", "part"),
    ("location", "n_nationkey", "nation JOIN region ON n_regionkey = r_regionkey"),
)
_MATCHED = (
    ("product", "product_id", "SELECT p_partkey AS k FROM part"),
    ("listed_name", "listed_name", """SELECT concat_ws(', ', p_name, CASE WHEN p_size % 3 <> 0 THEN p_type END,
        CASE WHEN p_size % 3 = 2 THEN 'size ' || p_size END) AS k FROM part"""),
    ("product_name", "listed_name", "SELECT p_name AS k FROM part"),
)

ORACLE_SQL: dict[str, str] = {
    "key_checks": " UNION ALL ".join(
        f"""SELECT '{name}' AS "check", count(*) AS "rows", count(*) - count({key}) AS null_keys,
        (SELECT count(*) FROM (SELECT {key} FROM {table} WHERE {key} IS NOT NULL GROUP BY {key} HAVING count(*) > 1))
          AS repeated_keys,
        count({key}) - count(DISTINCT {key}) AS extra_rows FROM {table}"""
        for name, key, table in _KEYED
    ),
    "match_checks": f"WITH {_LINES} "
    + " UNION ALL ".join(
        f"""SELECT '{name}' AS "check", count(*) AS "rows", count(*) FILTER (n = 0) AS unmatched,
        count(*) FILTER (n > 1) AS repeated, cast(coalesce(sum(n - 1) FILTER (n > 1), 0) AS bigint) AS added
        FROM (SELECT (SELECT count(*) FROM ({lookup}) WHERE k = {key}) AS n FROM sales_lines)"""
        for name, key, lookup in _MATCHED
    ),
    "dim_customer": f"WITH {_LINES} SELECT DISTINCT customer_id, customer_name, segment FROM sales_lines",
    "dim_product": f"""WITH {_KEYS}
      SELECT product_key AS product_id, listed_name AS product_name, category, sub_category
      FROM product_keys""",
    "dim_location": f"""WITH {_KEYS}
      SELECT location_key AS location_id, country AS city, cast(NULL AS varchar) AS state, country,
             region, region AS market, cast(NULL AS varchar) AS postal_code
      FROM location_keys""",
    "star_orders": f"""WITH {_KEYS}
      SELECT order_id, customer_id, product_key AS product_id, location_key AS location_id,
             cast(sales AS double) AS sales, quantity, cast(discount AS double) AS discount,
             cast(profit AS double) AS profit, cast(shipping_cost AS double) AS shipping_cost,
             order_date, ship_date, ship_mode, order_priority
      FROM keyed""",
    "split_product_name": """
      SELECT p_partkey AS product_id, name AS product_name, trim(parts[1]) AS full_name,
             trim(parts[2]) AS type, trim(parts[3]) AS variant
      FROM (SELECT p_partkey, name, string_split(name, ',') AS parts FROM (
        SELECT p_partkey, concat_ws(', ', p_name, CASE WHEN p_size % 3 <> 0 THEN p_type END,
               CASE WHEN p_size % 3 = 2 THEN 'size ' || p_size END) AS name FROM part))""",
    "product_catalog_flat": f"""WITH {_KEYS}
      SELECT DISTINCT product_key AS product_id, 0 AS part, trim(parts[1]) AS full_name, category,
             sub_category, cast(product_id AS varchar) AS original_product_id,
             trim(parts[2]) AS type, trim(parts[3]) AS variant,
             cast(len(parts) - 1 AS integer) AS attribute_count
      FROM (SELECT *, string_split(listed_name, ',') AS parts FROM keyed)""",
    "order_recap_flat": f"""WITH {_RECAP}
      SELECT order_id, 0 AS part, max(strftime(order_date, '%d-%m-%Y')) FILTER (place = 1) AS order_date,
             max(customer_id) FILTER (place = 1) AS customer_id,
             cast(count(*) AS integer) AS product_count,
             round_even(cast(sum(profit) AS double) * 1000, 0) / 1000 AS total_profit,
             round_even(cast(sum(sales) AS double) * 1000, 0) / 1000 AS total_sales,
             max(ship_mode) FILTER (place = 1) AS ship_mode,
             max(strftime(ship_date, '%d-%m-%Y')) FILTER (place = 1) AS ship_date,
             cast(max(date_diff('day', order_date, ship_date)) FILTER (place = 1) AS integer) AS delay,
             round_even(cast(sum(shipping_cost) AS double) * 1000, 0) / 1000
               AS shipping_cost
      FROM placed GROUP BY order_id""",
    "order_recap_lines": f"""WITH {_RECAP}
      SELECT order_id, cast(place - 1 AS integer) AS line_no, product_key AS product_id, quantity,
             cast(sales AS double) AS sales, cast(profit AS double) AS profit,
             cast(discount AS double) AS discount
      FROM placed""",
    "shipping_delays": f"""WITH {_LINES}
      SELECT cast(date_diff('day', order_date, ship_date) AS integer) AS delay,
             count(*) AS line_count, strftime(min(order_date), '%d-%m-%Y') AS first_order_date
      FROM sales_lines GROUP BY 1""",
    "discount_base": f"WITH {_DISCOUNT} SELECT {_LINE_OUTPUT} FROM discount_base",
    "discount_filtered": f"""WITH {_DISCOUNT} SELECT {_LINE_OUTPUT} FROM discount_base
      WHERE year IN (1996, 1998) AND category IN ('SMALL', 'LARGE') AND region IN ('ASIA', 'EUROPE')""",
    "facet_options": _options("true", "true"),
    "facet_options_scoped": _options(
        "category IN ('SMALL', 'LARGE')", "region IN ('ASIA', 'EUROPE')"
    ),
    "discount_kpis": f"WITH {_DISCOUNT}{_KPIS}",
    "product_summary": f"WITH {_DISCOUNT} SELECT * FROM products",
    "discount_range_summary": f"WITH {_DISCOUNT} SELECT * FROM ranges",
    "category_avg_discount": f"""WITH {_DISCOUNT}
      SELECT category, cast(sum(discount) AS double) / count(*) * 100 AS avg_discount
      FROM discount_base GROUP BY category""",
    "region_profit": f"""WITH {_DISCOUNT}
      SELECT region, cast(sum(profit) AS double) AS profit FROM discount_base GROUP BY region""",
    "monthly_trend": f"""WITH {_DISCOUNT}
      SELECT month_year, cast(sum(sales) AS double) AS sales, cast(sum(profit) AS double) AS profit
      FROM discount_base GROUP BY month_year""",
    "discount_correlation": f"""WITH {_DISCOUNT}
      SELECT correlation, {_IMPACT} AS impact,
             coalesce({_fixed('value', 3)}, 'n/a') AS correlation_text
      FROM related""",
    "discount_insights": f"""WITH {_DISCOUNT},
      by_category AS (SELECT category, cast(sum(profit) AS double) AS profit,
          cast(sum(discount) AS double) / count(*) * 100 AS avg_discount
        FROM discount_base GROUP BY category)
      {_HEADER}
        (SELECT 1 AS rank, 'best_category' AS finding, category AS subject, profit AS value,
                {_dollars('profit')} AS text
         FROM by_category ORDER BY profit DESC, category LIMIT 1)
        UNION ALL (SELECT 2, 'best_product', product_name, profit, {_dollars('profit')}
         FROM products ORDER BY profit DESC, product_name LIMIT 1)
        UNION ALL (SELECT 3, 'worst_product', product_name, profit, {_dollars('profit')}
         FROM (SELECT * FROM products ORDER BY profit, product_name LIMIT 1) WHERE profit < 0)
        UNION ALL (SELECT 4, 'highest_discount_category', category, avg_discount,
                {_percent('avg_discount')}
         FROM by_category ORDER BY avg_discount DESC, category LIMIT 1)
        UNION ALL (SELECT 5, 'best_range', discount_range, avg_profit, {_dollars('avg_profit')}
         FROM used_ranges ORDER BY avg_profit DESC, range_no LIMIT 1))""",
    "discount_conclusions": f"""WITH {_DISCOUNT},
      best AS (SELECT * FROM ranges WHERE order_count > 0 ORDER BY avg_profit DESC, range_no LIMIT 1),
      whole AS (SELECT cast(sum(profit) AS double) / cast(sum(sales) AS double) * 100 AS margin
                FROM discount_base),
      strategy AS (SELECT CASE WHEN range_no <= 2 THEN 'low discount' WHEN range_no = 3
          THEN 'moderate discount' ELSE 'high volume' END AS word FROM best)
      {_HEADER}
        SELECT 1 AS rank, 'discount_impact' AS finding, {_IMPACT} AS subject, correlation AS value,
               coalesce({_fixed('value', 3)}, 'n/a') AS text FROM related
        UNION ALL SELECT 2, 'optimal_range', discount_range, avg_profit, {_dollars('avg_profit')} FROM best
        UNION ALL (SELECT 3, 'decline_from', r.discount_range, r.avg_profit, {_dollars('r.avg_profit')}
          FROM ranges r, best WHERE r.order_count > 0 AND r.avg_profit < best.avg_profit * 0.7::DOUBLE
          ORDER BY r.range_no LIMIT 1)
        UNION ALL SELECT 4, 'strategy', word, NULL, word FROM strategy
        UNION ALL SELECT 5, 'overall_margin', 'all', margin, {_percent('margin')} FROM whole
        UNION ALL SELECT 6, 'optimal_margin', discount_range, profit_margin,
          {_percent('profit_margin')} FROM best)""",
    "scatter_sample": f"""WITH {_DISCOUNT}
      SELECT order_id, product_id, quantity, cast(sales AS double) AS sales,
             cast(discount AS double) * 100 AS discount_pct, cast(profit AS double) AS profit,
             category, product_name, region, country
      FROM discount_base
      ORDER BY md5(concat_ws('|', order_id, product_id, quantity, cast(sales AS decimal(18,4)), '42')),
               order_id, product_id, quantity, sales
      LIMIT 1000""",
    "top_products_by_sales": f"""WITH {_DISCOUNT}
      SELECT * FROM products ORDER BY sales DESC, product_name LIMIT 10""",
    "top_products_by_profit": f"""WITH {_DISCOUNT}
      SELECT * FROM products ORDER BY profit DESC, product_name LIMIT 10""",
    "low_profit_products": f"""WITH {_DISCOUNT}
      SELECT * FROM products ORDER BY profit, product_name LIMIT 10""",
    "high_sales_low_profit": f"""WITH {_DISCOUNT}
      SELECT * FROM products
      WHERE sales >= (SELECT {_quantile('sales', 0.8)} FROM products)
        AND profit_margin <= (SELECT {_quantile('profit_margin', 0.5)} FROM products)
      ORDER BY sales DESC, product_name LIMIT 10""",
    "hidden_base": f"WITH {_HIDDEN_BASE} SELECT * FROM hidden_base",
    "hidden_metrics": f"WITH {_METRICS} SELECT * FROM metrics",
    "hidden_thresholds": f"WITH {_METRICS} SELECT * FROM limits",
    "hidden_segments": f"WITH {_METRICS} SELECT * FROM segmented",
    "hidden_filtered": f"""WITH {_metrics("category = 'SMALL' AND region IN ('ASIA', 'EUROPE')")}
      SELECT * FROM segmented""",
    "hidden_by_total_profit": f"""WITH {_METRICS} SELECT metrics.* FROM metrics, limits
      WHERE frequency <= freq_th AND total_profit >= profit_th""",
    "hidden_by_margin": f"""WITH {_METRICS} SELECT metrics.* FROM metrics, limits
      WHERE frequency <= freq_th AND profit_margin >= margin_th""",
    "hidden_by_avg_profit": f"""WITH {_METRICS} SELECT metrics.* FROM metrics, limits
      WHERE frequency <= freq_th AND avg_profit_per_order >= avg_profit_th""",
    "hidden_scatter": f"""WITH {_METRICS}
      SELECT product_id, region, frequency, avg_profit_per_order, segment, total_sales,
             product_name, category, total_profit FROM segmented""",
    "hidden_margin_scatter": f"""WITH {_METRICS}
      SELECT product_id, region, avg_profit_per_order, profit_margin, category FROM hidden""",
    "hidden_kpis": f"""WITH {_METRICS},
      sums AS (SELECT count(DISTINCT CASE WHEN segment = 'Hidden High-Value' THEN product_id END)
                 AS hidden_products,
          cast(sum(cast(total_profit AS decimal(38,4))) AS double) AS total_profit,
          coalesce(cast(sum(CASE WHEN segment = 'Hidden High-Value'
            THEN cast(total_profit AS decimal(38,4)) END) AS double), 0) AS hidden_profit
        FROM segmented),
      parts AS (SELECT *, total_profit - hidden_profit AS non_hidden_profit,
          hidden_profit / nullif(total_profit, 0) AS contribution FROM sums)
      SELECT hidden_products, total_profit, hidden_profit, non_hidden_profit, contribution,
             CASE WHEN total_profit <= 0 AND non_hidden_profit < 0
                  THEN hidden_profit / abs(non_hidden_profit) END AS loss_coverage,
             CASE WHEN contribution > 1 THEN 'hidden products offset losses of other products'
                  WHEN total_profit > 0 THEN 'hidden products contribute to total profit'
                  WHEN total_profit < 0 THEN 'hidden products offset overall losses' END AS caption,
             freq_th, avg_profit_th
      FROM parts, limits""",
    "hidden_by_subcategory": f"""WITH {_METRICS}
      SELECT sub_category, cast(sum(cast(total_profit AS decimal(38,4))) AS double) AS total_profit,
             count(DISTINCT product_id) AS hidden_count
      FROM hidden GROUP BY sub_category""",
    "hidden_region_mix": f"""WITH {_MIX}
      SELECT *, hidden_count / sum(hidden_count) OVER (PARTITION BY region) AS pct,
             {_fixed('total_profit / 1000', 1)} || 'K' AS profit_text,
             {_percent('hidden_count / sum(hidden_count) OVER (PARTITION BY region) * 100', 0)} AS pct_text
      FROM mix""",
    "hidden_region_totals": f"WITH {_MIX} SELECT * FROM totals",
    "top_region_category": f"""WITH {_MIX},
      most AS (SELECT region FROM totals ORDER BY hidden_count DESC, region LIMIT 1),
      richest AS (SELECT region FROM totals ORDER BY total_profit DESC, region LIMIT 1)
      (SELECT 'hidden_count' AS measure, region, category AS leading FROM mix JOIN most USING (region)
       ORDER BY hidden_count DESC, category LIMIT 1)
      UNION ALL
      (SELECT 'total_profit', region, category FROM mix JOIN richest USING (region)
       ORDER BY total_profit DESC, category LIMIT 1)""",
    "attribute_coverage": f"""WITH {_METRICS}
      SELECT category, count(DISTINCT product_id) AS total_products,
             count(DISTINCT CASE WHEN type <> 'not have' THEN product_id END) AS with_type,
             count(DISTINCT CASE WHEN type <> 'not have' THEN product_id END)
               / count(DISTINCT product_id) AS coverage_pct
      FROM hidden GROUP BY category""",
    "attribute_missing": f"""WITH {_METRICS},
      sums AS (SELECT count(DISTINCT product_id) AS products,
          count(DISTINCT CASE WHEN type = 'not have' THEN product_id END) AS no_type,
          count(DISTINCT CASE WHEN variant = 'not have' THEN product_id END) AS no_variant
        FROM hidden)
      SELECT 'type' AS attribute, no_type AS unknown_products, products,
             coalesce(no_type / nullif(products, 0), 0) AS unknown_pct FROM sums
      UNION ALL SELECT 'variant', no_variant, products,
             coalesce(no_variant / nullif(products, 0), 0) FROM sums""",
    "hidden_by_type": _attribute("type"),
    "hidden_by_variant": _attribute("variant"),
    "hidden_top_attributes": f"""WITH {_METRICS}
      {_top_attribute('type')} UNION ALL {_top_attribute('variant')}""",
    "hidden_type_pivot": f"""WITH {_METRICS},
      pivoted AS (SELECT sub_category, type,
          count(DISTINCT CASE WHEN segment = 'Hidden High-Value' THEN product_id END) AS hidden,
          count(DISTINCT CASE WHEN segment <> 'Hidden High-Value' THEN product_id END) AS non_hidden
        FROM segmented WHERE type <> 'not have' GROUP BY sub_category, type)
      SELECT *, hidden + non_hidden AS total, hidden / (hidden + non_hidden) AS hidden_ratio
      FROM pivoted""",
    "hidden_drilldown": f"""WITH {_METRICS}
      SELECT row_number() OVER (PARTITION BY sub_category ORDER BY frequency, profit_margin DESC,
               avg_profit_per_order DESC, product_id, region) AS "No",
             product_id, region, product_name AS "Product", sub_category AS "Sub-Cat",
             frequency AS "Freq", total_sales AS "Sales", total_profit AS "Profit",
             avg_profit_per_order AS "Avg Profit", profit_margin AS "Margin (%)",
             price_per_unit AS "Price/Unit", profit_per_unit AS "Profit/Unit"
      FROM hidden""",
    "chart_frequency": _chart("frequency", 40),
    "chart_avg_profit": _chart("avg_profit_per_order", 30),
    "hidden_options": f"""WITH {_HIDDEN_BASE}
      SELECT 'category' AS facet, 0 AS option_no, 'All' AS option
      UNION ALL SELECT 'category', cast(row_number() OVER (ORDER BY category) AS integer), category
        FROM (SELECT DISTINCT category FROM hidden_base WHERE category IS NOT NULL)
      UNION ALL SELECT 'region', cast(row_number() OVER (ORDER BY region) AS integer), region
        FROM (SELECT DISTINCT region FROM hidden_base WHERE region IS NOT NULL)""",
    "cube_kpis": _for_choices(_KPIS),
    "cube_product_summary": _for_choices("SELECT * FROM products"),
    "cube_range_summary": _for_choices("SELECT * FROM ranges"),
    "cube_category_discount": _for_choices(
        "SELECT category, cast(sum(discount) AS double) / count(*) * 100 AS avg_discount FROM discount_base GROUP BY category"
    ),
    "cube_region_profit": _for_choices(
        "SELECT region, cast(sum(profit) AS double) AS profit FROM discount_base GROUP BY region"
    ),
    "cube_monthly_trend": _for_choices(
        "SELECT month_year, cast(sum(sales) AS double) AS sales, cast(sum(profit) AS double) AS profit "
        "FROM discount_base GROUP BY month_year"
    ),
    "cube_correlation": _for_choices(
        f"SELECT correlation, {_IMPACT} AS impact, coalesce({_fixed('value', 3)}, 'n/a') AS correlation_text FROM related"
    ),
    "hist_frequency": _histogram("frequency", 40),
    "hist_avg_profit": _histogram("avg_profit_per_order", 30),
    "order_totals": f"""WITH {_BASKETS}
      SELECT order_id, cast(order_total AS double) AS order_total FROM order_sums""",
    "order_basket_totals": f"""WITH {_BASKETS}
      SELECT order_id, product_id, count(*) AS line_count,
             cast(any_value(order_total) AS double) AS order_total
      FROM items JOIN order_sums USING (order_id) GROUP BY order_id, product_id""",
    "trap_products": f"""WITH {_BASKETS}
      SELECT product_id, product_name, frequency, avg_basket_value, trap_score FROM ranked""",
    "trap_top_frequency": f"""WITH {_BASKETS}
      SELECT product_id, product_name, frequency, avg_basket_value, trap_score FROM ranked
      ORDER BY frequency DESC, product_id LIMIT 20""",
    "bought_together": """
      SELECT b.l_partkey AS product_id, any_value(p_name) AS product_name, count(*) AS frequency
      FROM lineitem a JOIN lineitem b ON a.l_orderkey = b.l_orderkey
      LEFT JOIN part ON p_partkey = b.l_partkey
      WHERE a.l_partkey = 100 AND b.l_partkey <> 100
      GROUP BY b.l_partkey""",
    "bought_together_top": """
      WITH anchors AS (SELECT l_partkey AS anchor_id FROM lineitem GROUP BY l_partkey
                       ORDER BY count(*) DESC, l_partkey LIMIT 20)
      SELECT anchor_id, b.l_partkey AS product_id, any_value(p_name) AS product_name,
             count(*) AS frequency
      FROM lineitem a JOIN anchors ON a.l_partkey = anchor_id
      JOIN lineitem b ON a.l_orderkey = b.l_orderkey AND b.l_partkey <> anchor_id
      LEFT JOIN part ON p_partkey = b.l_partkey
      GROUP BY anchor_id, b.l_partkey""",
    "bought_together_every": """
      WITH pairs AS (
        SELECT a.l_partkey AS anchor_id, b.l_partkey AS product_id, count(*) AS frequency
        FROM lineitem a JOIN lineitem b ON a.l_orderkey = b.l_orderkey AND a.l_partkey <> b.l_partkey
        GROUP BY a.l_partkey, b.l_partkey),
      ranked AS (
        SELECT *, cast(row_number() OVER (PARTITION BY anchor_id ORDER BY frequency DESC, product_id)
                  AS integer) AS rank FROM pairs)
      SELECT anchor_id, rank, product_id, p_name AS product_name, frequency
      FROM ranked LEFT JOIN part ON p_partkey = product_id WHERE rank <= 10""",
}

# the documents written as JSON arrays and read again hold the same values
ORACLE_SQL["product_catalog_export"] = ORACLE_SQL["product_catalog_flat"]
ORACLE_SQL["order_recap_export"] = ORACLE_SQL["order_recap_lines"]
