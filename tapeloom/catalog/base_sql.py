"""Shared SQL views used by the check queries, assembled as CTE chains."""

from __future__ import annotations

from collections.abc import Callable

VIEWS: dict[str, tuple[tuple[str, ...], str]] = {}


def view(name: str, body: str, *needs: str) -> None:
    VIEWS[name] = (needs, body)


def with_views(body: str, *names: str) -> Callable[[], str]:
    """The query text behind a chain of the named views, assembled once all views are known."""

    def build() -> str:
        done: list[str] = []

        def visit(n: str) -> None:
            if n in done:
                return
            for d in VIEWS[n][0]:
                visit(d)
            done.append(n)

        for n in names:
            visit(n)
        ctes = ",\n".join(f"{n} AS ({VIEWS[n][1]})" for n in done)
        return f"WITH RECURSIVE {ctes}\n{body}"

    return build


view(
    "ticks",
    """
SELECT *, row_number() OVER (PARTITION BY instrument ORDER BY ts, seq) - 1 AS pos FROM (
  SELECT 'u' || lpad(CAST(user_id % 16 AS VARCHAR), 2, '0') AS instrument, event_id AS seq, ts,
         pc / 100.0::DOUBLE AS price, k AS qty, pc * k AS cents, pc * k / 100.0::DOUBLE AS dollar, side
  FROM (SELECT *, CAST(round((value + 1) * 100) AS BIGINT) AS pc,
               CAST(regexp_extract(props, '[0-9]+') AS BIGINT) + 1 AS k,
               CASE WHEN event_type IN ('click','purchase','signup') THEN 1 ELSE -1 END AS side FROM events))
""",
)


def bar_select(tagged: str, complete: str = "") -> str:
    return f"""
SELECT instrument, bar_id, bar_id AS pos, max(ts) AS ts, max(pos) AS end_pos,
       arg_min(price, pos) AS open, max(price) AS high, min(price) AS low, arg_max(price, pos) AS close,
       sum(dollar) / CAST(sum(qty) AS DOUBLE) AS vwap, count(*) AS n_trades, sum(dollar) AS dollar,
       CAST(sum(CASE WHEN side = 1 THEN qty ELSE 0 END) AS BIGINT) AS buy_volume,
       CAST(sum(CASE WHEN side = -1 THEN qty ELSE 0 END) AS BIGINT) AS sell_volume
FROM {tagged} GROUP BY instrument, bar_id {complete}
"""


view("tbars", bar_select("(SELECT *, pos // 5 AS bar_id FROM ticks)", "HAVING count(*) = 5"), "ticks")

view(
    "raw_tape",
    """
SELECT 's' || CAST(l_suppkey AS VARCHAR) AS instrument, l_orderkey * 10 + l_linenumber AS trade_id, l_shipdate AS ts,
       l_extendedprice / l_quantity AS price, l_quantity AS qty, l_extendedprice AS quote_qty,
       l_returnflag = 'R' AS is_buyer_maker, l_linestatus = 'O' AS is_best_match, l_partkey AS part,
       CAST(round(l_extendedprice * 100) AS BIGINT) AS ext_cents
FROM lineitem
""",
)

view(
    "daily",
    """
SELECT *, row_number() OVER (PARTITION BY instrument ORDER BY ts) - 1 AS pos FROM (
  SELECT replace(o_orderpriority, ' ', '') AS instrument, o_orderdate AS ts,
         arg_min(o_totalprice, o_orderkey) AS open, max(o_totalprice) AS high, min(o_totalprice) AS low,
         arg_max(o_totalprice, o_orderkey) AS close, count(*) AS volume
  FROM orders GROUP BY 1, 2)
""",
)

view(
    "contracts",
    """
SELECT instrument, contract, CAST(l_shipdate AS DATE) AS date,
       arg_min(c, o) / 100.0::DOUBLE AS open, max(c) / 100.0::DOUBLE AS high, min(c) / 100.0::DOUBLE AS low,
       arg_max(c, o) / 100.0::DOUBLE AS close,
       CAST(sum(CAST(l_quantity AS BIGINT)) AS BIGINT) AS volume, count(*) AS open_int
FROM (SELECT *, 'p' || CAST(l_suppkey % 4 AS VARCHAR) AS instrument,
             'p' || CAST(l_suppkey % 4 AS VARCHAR) || 'y' || CAST(year(l_shipdate) + (l_suppkey % 12) // 4 AS VARCHAR) AS contract,
             CAST(round(l_extendedprice * 100 / l_quantity) AS BIGINT) AS c,
             {'a': l_orderkey, 'b': l_linenumber, 'c': l_partkey, 'd': l_quantity, 'e': l_extendedprice} AS o
      FROM lineitem)
GROUP BY 1, 2, 3
""",
)

view(
    "intervals",
    """
SELECT replace(o_orderpriority, ' ', '') AS instrument, o_orderkey AS event_id, o_orderdate AS t0,
       CASE WHEN m >= o_orderdate THEN m END AS t1, o_totalprice AS value
FROM orders LEFT JOIN (SELECT l_orderkey, max(l_shipdate) AS m FROM lineitem GROUP BY 1) ON o_orderkey = l_orderkey
""",
)

view(
    "trials",
    """
SELECT *, row_number() OVER (PARTITION BY study, trial ORDER BY month) - 1 AS pos FROM (
  SELECT l_linestatus AS study, 't' || lpad(CAST(l_suppkey % 20 AS VARCHAR), 2, '0') AS trial, date_trunc('month', l_shipdate) AS month,
         CAST(sum(CAST(round(l_discount * 100) AS BIGINT) - 5) AS DOUBLE) / count(*) / 100.0::DOUBLE AS pnl
  FROM lineitem GROUP BY 1, 2, 3)
""",
)
