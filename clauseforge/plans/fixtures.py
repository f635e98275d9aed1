"""Two versions of a policy, tables and table cells derived from the relational
inputs.  Each is one SQL text that Spark and any ANSI engine run alike: names in
braces are the input tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

_VERB = "CASE ({i}) % 6 WHEN 0 THEN 'shall' WHEN 1 THEN 'must' WHEN 2 THEN 'should' WHEN 3 THEN 'may' WHEN 4 THEN 'is required to' ELSE 'is recommended to' END"
_TAIL = (
    "CASE k % 8 WHEN 0 THEN ' if the contract is signed' WHEN 1 THEN ' at 30 MHz to 230 MHz' WHEN 2 THEN ' with 10 V/m' "
    "WHEN 3 THEN ' per IEC 61000-4-3' WHEN 4 THEN ' (see Figure {fig})' WHEN 5 THEN ' within Class B' ELSE '' END"
)


def _clause(verb: str, days: str, fig: str, between: str = "' units within '") -> str:
    return (
        f"'Customer ' || CAST(cust AS STRING) || ' ' || {_VERB.format(i=verb)} || ' deliver ' || CAST(units AS STRING) || {between} || "
        f"CAST({days} AS STRING) || ' days' || {_TAIL.format(fig=fig)} || '.'"
    )


_BASE = (
    "SELECT o_orderkey AS k, o_custkey AS cust, CAST(FLOOR(o_totalprice) AS BIGINT) % 500 AS units, o_orderkey % 30 + 1 AS days, "
    "c_mktsegment || ' / ' || n_name AS section, n_name AS nation FROM {orders} JOIN {customer} ON o_custkey = c_custkey JOIN {nation} ON c_nationkey = n_nationkey"
)

#: (node, section, page, text, node_type) of version 1: a clause for each order.
CLAUSES_V1 = f"SELECT k AS node, section, k % 97 + 1 AS page, {_clause('k', 'days', '3')} AS text, 'paragraph' AS node_type FROM ({_BASE}) b"

#: Version 2: deletions (11), rewritten (29), punctuation (17), verbs (5), numbers (7),
#: figure numbers (23), moves (13), insertions (19), each by the key's divisor.
CLAUSES_V2 = (
    "SELECT k AS node, CASE WHEN k % 13 = 0 THEN 'Moved / ' || nation ELSE section END AS section, k % 97 + 1 AS page, "
    "CASE WHEN k % 29 = 0 THEN 'Records of supplier ' || CAST(k AS STRING) || ' are archived by the security officer.' "
    f"WHEN k % 17 = 0 THEN {_clause('k', 'days', '3', chr(39) + ' units; within ' + chr(39))} "
    f"WHEN k % 5 = 0 THEN {_clause('k + 1', 'days', '3')} "
    f"WHEN k % 7 = 0 THEN {_clause('k', '(days + 1)', '3')} "
    f"WHEN k % 23 = 0 THEN {_clause('k', 'days', '5')} "
    f"ELSE {_clause('k', 'days', '3')} END AS text, 'paragraph' AS node_type FROM ({_BASE}) b WHERE k % 11 <> 0 "
    "UNION ALL SELECT k + 1000000000 AS node, section, k % 97 + 1 AS page, 'Inserted clause ' || CAST(k AS STRING) || ' must be audited.' AS text, "
    f"'paragraph' AS node_type FROM ({_BASE}) b WHERE k % 19 = 0"
)

_ROWS = "SELECT p_partkey AS k, p_partkey % 50 AS t, (p_partkey - p_partkey % 50) / 50 AS r, p_brand AS brand, p_size AS size, CAST(FLOOR(p_retailprice) AS BIGINT) AS price FROM {part}"
_CELLS = (
    "SELECT 'table ' || CAST(t AS STRING) AS table_uid, CAST(r AS BIGINT) AS row, 0 AS col, 'REQ-' || CAST(k AS STRING) AS text FROM ({rows}) a "
    "UNION ALL SELECT 'table ' || CAST(t AS STRING), CAST(r AS BIGINT), 1, brand FROM ({rows}) a "
    "UNION ALL SELECT 'table ' || CAST(t AS STRING), CAST(r AS BIGINT), 2, CAST({size} AS STRING) || ' V/m' FROM ({rows}) a "
    "UNION ALL SELECT 'table ' || CAST(t AS STRING), CAST(r AS BIGINT), 3, CAST({price} AS STRING) || ' MHz' FROM ({rows}) a"
)
#: (table_uid, row, col, text): tables of parts, fifty of them; columns requirement,
#: brand, field strength, frequency.
CELLS_V1 = _CELLS.format(rows=_ROWS, size="size", price="price")
#: Version 2: rows deleted (11), sizes raised (7), prices halved (13), by the key.
CELLS_V2 = _CELLS.format(
    rows=_ROWS + " WHERE p_partkey % 11 <> 0", size="CASE WHEN k % 7 = 0 THEN size + 1 ELSE size END", price="CASE WHEN k % 13 = 0 THEN price * 2 ELSE price END"
)
HEADERS = ("Requirement", "Brand", "Field strength", "Frequency range")

_GRID = "SELECT DISTINCT p_partkey % 50 AS t FROM {part}"
_HEAD = "SELECT 'table ' || CAST(t AS STRING) AS table_uid, CAST({row} AS BIGINT) AS row, {col} AS col, {span} AS col_span, '{text}' AS text FROM (" + _GRID + ") g"


def _head(row: str, col: int, span: int, text: str, where: str = "") -> str:
    return _HEAD.replace("{row}", row).replace("{col}", str(col)).replace("{span}", str(span)).replace("{text}", text) + where


def _headed(source: str) -> str:
    up = "CASE WHEN t % 3 = 0 THEN 1 ELSE 0 END"
    parts = [
        _head("0", 0, 5, "Table 7: Limits", " WHERE t % 3 = 0"), _head(up, 0, 1, "Phenomenon"), _head(up, 1, 1, "Frequenz-"), _head(up, 2, 1, "bereich"),
        _head(up, 3, 2, "Level"), _head(up + " + 1", 3, 1, "min"), _head(up + " + 1", 4, 1, "max"),
        "SELECT c.table_uid, c.row + 2 + CASE WHEN CAST(substr(c.table_uid, 7) AS BIGINT) % 3 = 0 THEN 1 ELSE 0 END, c.col, 1, c.text FROM (" + source + ") c",
    ]
    return " UNION ALL ".join(parts)


#: (table_uid, row, col, col_span, text): the cells under two rows of headers, every
#: third table under a caption row too.
HEADED_V1, HEADED_V2 = _headed(CELLS_V1), _headed(CELLS_V2)

TABLES = ("region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events", "documents", "embeddings", "pages", "benchmark", "labels", "conversations")


def sql(spark: SparkSession, sf_dir: str, text: str) -> DataFrame:
    """Run one of the texts over the Parquet tables of a folder."""
    used = {t: spark.read.parquet(f"{sf_dir}/{t}.parquet") for t in TABLES if "{" + t + "}" in text}
    return spark.sql(text, **used)


def plain(text: str) -> str:
    """The same text with the tables by name."""
    for t in TABLES:
        text = text.replace("{" + t + "}", t)
    return text
