"""SQL fragments shared by the oracle texts."""

TX = """tx AS (
  SELECT l_orderkey AS order_id, l_linenumber AS line_no, l_partkey AS product_id, l_suppkey AS store_id,
         l_extendedprice AS sales, l_quantity AS quantity, o_custkey AS customer_id, o_orderdate AS ts,
         o_orderpriority AS priority
  FROM lineitem JOIN orders ON l_orderkey = o_orderkey)"""

PRODUCTS = """products AS (
  SELECT p_partkey AS product_id, p_name AS name, p_brand AS brand, p_type AS category, p_size AS size,
         p_retailprice AS price FROM part)"""

STORES = """stores AS (
  SELECT s_suppkey AS store_id, n_name AS city FROM supplier JOIN nation ON s_nationkey = n_nationkey)"""


def money(x: str) -> str:
    return f"CAST({x} AS DECIMAL(18,4))"


def msum(x: str) -> str:
    return f"SUM(CAST({x} AS DECIMAL(18,4)))"


def r(x: str, digits: int = 2) -> str:
    """Half away from zero on doubles, the same steps as the Spark side."""
    s = f"1e{digits}"
    return f"(sign(CAST({x} AS DOUBLE)) * floor(abs(CAST({x} AS DOUBLE)) * {s} + 0.5e0) / {s} + 0e0)"


def pct(num: str, den: str, digits: int = 2) -> str:
    return r(f"(CAST({num} AS DOUBLE) * 100e0 / CAST({den} AS DOUBLE))", digits)


def bucket(x: str, n: int) -> str:
    return f"(CAST(concat('0x', substr(md5(CAST({x} AS VARCHAR)), 1, 8)) AS BIGINT) % {n})"
