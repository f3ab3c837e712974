"""Views over the test tables that give the operators something to find.

Plain SELECTs that Spark and the checking engine both run. All of them keep every row.
"""

# Nulls, copies, formatted and nearly numeric text, an empty and a constant column.
DIRTY_COLUMNS = (
    "o_orderkey", "price_txt", "status", "price", "odate", "near_num", "signed_num", "empty_col",
    "const_col",
)
DIRTY = """
WITH base AS (SELECT *, CAST(floor(o_totalprice) AS BIGINT) AS p FROM orders),
d AS (SELECT o_orderstatus, o_orderpriority, o_orderkey,
  CASE WHEN o_orderkey % 11 = 0 THEN NULL WHEN o_orderkey % 97 = 0 THEN 'n.a. text'
       ELSE concat('$', CAST(CAST(floor(p / 1000) AS BIGINT) AS STRING), ',',
                   lpad(CAST(p % 1000 AS STRING), 3, '0')) END AS price_txt,
  CASE WHEN o_orderkey % 7  = 0 THEN NULL ELSE o_orderstatus END AS status,
  CASE WHEN o_orderkey % 13 = 0 THEN NULL ELSE o_totalprice END AS price,
  CASE WHEN o_orderkey % 17 = 0 THEN NULL ELSE o_orderdate END AS odate,
  CASE WHEN o_orderkey % 40 = 0 THEN 'bad' ELSE CAST(p % 50 AS STRING) END AS near_num,
  CASE WHEN o_orderkey % 50 = 0 THEN 'bad' WHEN o_orderkey % 101 = 0 THEN NULL
       ELSE concat('+', CAST(p % 60 AS STRING)) END AS signed_num,
  CAST(NULL AS DOUBLE) AS empty_col, 'x' AS const_col FROM base),
copies AS (SELECT * FROM d UNION ALL
           SELECT * FROM d WHERE o_orderstatus = 'P' AND o_orderpriority = '1-URGENT')
SELECT {columns} FROM copies
""".format(columns=", ".join(DIRTY_COLUMNS))

# The same kind of data as a CSV file would bring it: text only, headers with blanks, several
# spellings of a missing value, several date forms.
RAW = """
SELECT CAST(o_orderkey AS STRING) AS ` o_orderkey `,
  CASE WHEN o_orderkey % 7 = 0 THEN 'N/A' WHEN o_orderkey % 11 = 0 THEN 'NULL'
       WHEN o_orderkey % 13 = 0 THEN '<NA>' ELSE o_orderstatus END AS status,
  CASE WHEN o_orderkey % 9 = 0 THEN 'nan'
       ELSE CAST(CAST(o_totalprice AS DECIMAL(18, 2)) AS STRING) END AS `price `,
  CASE WHEN o_orderpriority = '1-URGENT' THEN 'True' ELSE 'False' END AS urgent,
  CASE WHEN o_orderkey % 10 = 0 THEN 'unknown day' WHEN o_orderkey % 3 = 0 THEN {iso}
       WHEN o_orderkey % 3 = 1 THEN {slashed} ELSE {us} END AS odate,
  concat('note ', o_orderpriority) AS update_note
FROM orders
"""
SPARK_RAW = RAW.format(
    iso="date_format(o_orderdate, 'yyyy-MM-dd')",
    slashed="date_format(o_orderdate, 'yyyy/MM/dd')",
    us="date_format(o_orderdate, 'MM/dd/yyyy')",
)
DUCK_RAW = RAW.replace("` o_orderkey `", '" o_orderkey "').replace("`price `", '"price "').format(
    iso="strftime(o_orderdate, '%Y-%m-%d')",
    slashed="strftime(o_orderdate, '%Y/%m/%d')",
    us="strftime(o_orderdate, '%m/%d/%Y')",
)

# Measures that depend on each other, with outliers and a time axis.
SALES_COLUMNS = (
    "l_orderkey", "l_partkey", "l_suppkey", "quantity", "price", "revenue", "discount",
    "l_returnflag", "l_linestatus", "l_shipdate",
)
SALES_MEASURES = ("quantity", "price", "revenue", "discount")
SALES = """
WITH priced AS (SELECT l_orderkey, l_partkey, l_suppkey, l_quantity AS quantity,
    CASE WHEN l_quantity = 50 AND l_discount > 0.09 THEN l_extendedprice * 20
         ELSE l_extendedprice END AS price,
    l_discount AS discount, l_returnflag, l_linestatus, l_shipdate FROM lineitem)
SELECT l_orderkey, l_partkey, l_suppkey, quantity, price, price * (1 - discount) AS revenue,
    discount, l_returnflag, l_linestatus, l_shipdate FROM priced
"""

# Measures with a constant column and gaps.
GAPS = """
SELECT l_quantity, l_extendedprice, l_discount, l_tax, 7.5E0 AS constant,
    CASE WHEN l_returnflag = 'N' THEN NULL ELSE l_extendedprice * l_quantity END AS gross
FROM lineitem
"""

# Orders whose measure is missing for one month, so that a period without data lies inside.
MONTH_GAP = """
SELECT o_orderkey, o_orderdate,
    CASE WHEN year(o_orderdate) = 1997 AND month(o_orderdate) = 3 THEN NULL
         ELSE o_totalprice END AS o_totalprice
FROM orders
"""
# Events whose value counts on the first ten days only, one of which is left out.
DAY_GAP = """
SELECT event_id, ts, event_type,
    CASE WHEN day(ts) > 10 OR day(ts) = 4 OR month(ts) > 1 THEN NULL ELSE value END AS value
FROM events
"""
