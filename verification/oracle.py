"""The same questions in plain SQL, written independently of the Spark plans.

Dense frames are joined, windows are literal range joins and positions are one global
ROW_NUMBER, so each statement also checks the rewrite used on the Spark side.
"""

from __future__ import annotations

ZERO = "0x0000000000000000000000000000000000000000"
DEAD = "0x000000000000000000000000000000000000dead"
SINKS = f"('{ZERO}', '{DEAD}')"
ACCOUNT = "0x" + "7".rjust(40, "0")
EVENT_DAY, ORDER_DAY = "DATE '2024-01-31'", "DATE '2001-12-31'"
MAIN, SECOND, THIRD = "Brand#2", "Brand#13", "Brand#19"


def addr(i):
    return (f"CASE WHEN {i} = 0 THEN '{ZERO}' WHEN {i} = 1 THEN '{DEAD}' "
            f"ELSE '0x' || lpad(CAST({i} AS VARCHAR), 40, '0') END")


#: Where the statements read the events; ``earlier`` cuts both.
EVENTS_READ = "FROM events AS every_event"
PRICES_READ = "FROM events WHERE event_type <> 'signup'"

BASE = f"""
ev AS (SELECT *, CAST(round(value * 100) AS BIGINT) AS cents, CAST(event_id AS VARCHAR) AS hash,
    (user_id * 31 + event_id * 17 + 5) % (SELECT max(user_id) + 1 FROM events) AS receiver
  {EVENTS_READ}),
erc20_e AS (SELECT ts AS evt_block_time, hash AS evt_tx_hash, {addr('user_id')} AS "from",
    {addr('receiver')} AS "to", event_type AS contract_address, cents AS value FROM ev),
erc20_ef AS (SELECT * FROM erc20_e WHERE "from" <> '{DEAD}'
  UNION ALL
  SELECT TIMESTAMP '2023-12-31 00:00:00', 'mint-' || t.event_type || '-' || CAST(u.user_id AS VARCHAR),
    '{ZERO}', {addr('u.user_id')}, t.event_type, CAST(200000 AS BIGINT)
  FROM (SELECT DISTINCT user_id FROM events WHERE user_id >= 2) u
  CROSS JOIN (SELECT DISTINCT event_type FROM events) t),
tokens_e AS (SELECT DISTINCT event_type AS contract_address, upper(event_type) AS symbol,
    2 AS decimals FROM events WHERE event_type <> 'error'),
prices_e AS (SELECT ts AS minute, event_type AS contract_address, upper(event_type) AS symbol,
    value AS price {PRICES_READ}),
traces_e AS (SELECT ts AS block_time, hash AS tx_hash, {addr('user_id')} AS "from",
    {addr('receiver')} AS "to", CAST(cents AS HUGEINT) * 10000000000000000 AS value, props AS input,
    CASE event_type WHEN 'signup' THEN 'create' ELSE 'call' END AS type,
    CASE event_type WHEN 'error' THEN 'delegatecall' WHEN 'view' THEN NULL ELSE 'call' END AS call_type,
    event_id % 10 <> 0 AS success FROM ev),
calls_e AS (SELECT * FROM traces_e WHERE type = 'call' AND success
    AND (call_type NOT IN ('delegatecall', 'staticcall', 'callcode') OR call_type IS NULL)),
gas_e AS (SELECT hash AS tx_hash, {addr('user_id')} AS tx_sender,
    CAST(round(value * 1000000000) AS HUGEINT) * (21000 + event_id % 1000) AS wei FROM ev),
ol AS (SELECT *, CAST(o_orderkey AS VARCHAR) AS hash,
    o_custkey % (SELECT max(s_suppkey) + 1 FROM supplier) AS receiver
  FROM lineitem JOIN orders ON l_orderkey = o_orderkey JOIN part ON l_partkey = p_partkey),
items_o AS (SELECT l_shipdate AS evt_block_time, hash AS evt_tx_hash, {addr('l_suppkey')} AS "from",
    {addr('receiver')} AS "to", p_brand AS contract_address, l_partkey AS "tokenId" FROM ol),
items_of AS (SELECT evt_block_time, evt_tx_hash, "from", "to", contract_address FROM items_o
    WHERE "from" <> '{DEAD}'
  UNION ALL
  SELECT TIMESTAMP '1995-01-01 00:00:00', 'mint', '{ZERO}', {addr('s_suppkey')},
    'Brand#' || CAST(b AS VARCHAR)
  FROM supplier, range(1, 26) x(b), range(1, 31) y(k) WHERE s_suppkey >= 2),
erc20_o AS (SELECT l_shipdate AS evt_block_time, hash AS evt_tx_hash, {addr('l_suppkey')} AS "from",
    {addr('receiver')} AS "to", p_brand AS contract_address, CAST(l_quantity AS BIGINT) AS value FROM ol),
tokens_nft_o AS (SELECT p_brand AS contract_address, min(p_name) AS name FROM part
    WHERE p_brand <> 'Brand#7' GROUP BY 1),
dex_o AS (SELECT CAST(o_orderdate AS DATE) AS date, o_orderpriority AS project, hash AS tx_hash,
    {addr('o_custkey')} AS tx_from, l_linenumber % 2 = 0 AS even, p_brand, p_type, l_quantity AS qty,
    l_extendedprice AS usd FROM ol),
nft_o AS (SELECT CAST(l_shipdate AS DATE) AS block_date, l_shipdate AS block_time,
    p_brand AS nft_contract_address, l_partkey AS token_id, hash AS tx_hash,
    {addr('l_suppkey')} AS tx_from, {addr('receiver')} AS tx_to, l_extendedprice AS amount_usd FROM ol),
sales AS (SELECT * FROM nft_o WHERE nft_contract_address = '{MAIN}'
    AND tx_from NOT IN {SINKS} AND tx_to NOT IN {SINKS}),
batch_o AS (SELECT hash AS evt_tx_hash, o_orderdate AS evt_block_time, {addr('receiver')} AS "from",
    {addr('(o_orderkey % 10)')} AS "to", o_orderpriority AS contract_address,
    l_partkey AS id, CAST(l_quantity AS BIGINT) AS value FROM ol)"""


def days(table, as_of, column="date"):
    return (f"SELECT CAST(unnest(generate_series(lo, {as_of}, INTERVAL 1 DAY)) AS DATE) AS date "
            f"FROM (SELECT min(CAST({column} AS DATE)) AS lo FROM {table})")


def ledger(table, token, as_of):
    """Ledger, calendar, addresses, net flows and dense balance of one token."""
    return f"""
l AS (SELECT evt_block_time AS datetime, CAST(evt_block_time AS DATE) AS date, evt_tx_hash AS tx_hash,
    "from" AS from_address, "to" AS to_address, contract_address, value AS raw FROM {table}
  WHERE contract_address = '{token}' AND evt_tx_hash IS NOT NULL AND "from" IS NOT NULL
    AND "to" IS NOT NULL),
{frame(as_of)}"""


def frame(as_of):
    return f"""
days AS ({days('l', as_of)}),
addrs AS (SELECT DISTINCT address FROM (SELECT from_address AS address FROM l
  UNION ALL SELECT to_address FROM l)),
net AS (SELECT date, address, sum(v) AS net FROM (
    SELECT date, to_address AS address, raw AS v FROM l
    UNION ALL SELECT date, from_address, -raw FROM l) GROUP BY 1, 2),
bal AS (SELECT d.date, a.address, CAST(sum(coalesce(n.net, 0)) OVER (
    PARTITION BY a.address ORDER BY d.date) AS BIGINT) AS balance
  FROM days d CROSS JOIN addrs a LEFT JOIN net n ON d.date = n.date AND a.address = n.address),
own AS (SELECT * FROM bal WHERE address NOT IN {SINKS}),
holders AS (SELECT address, balance FROM own WHERE date = (SELECT max(date) FROM own) AND balance > 0)"""


def item_ledger(table, collection, as_of):
    return f"""
l AS (SELECT CAST(evt_block_time AS DATE) AS date, evt_tx_hash AS tx_hash, "from" AS from_address,
    "to" AS to_address, contract_address, 1 AS raw FROM {table} WHERE contract_address = '{collection}'),
{frame(as_of)}"""


def q(*parts):
    *ctes, select = parts
    return "WITH " + ",\n".join([BASE.strip(), *[c.strip() for c in ctes]]) + "\n" + select


EV = ledger("erc20_e", "click", EVENT_DAY)
EVF = ledger("erc20_ef", "click", EVENT_DAY)
OR = ledger("erc20_o", MAIN, ORDER_DAY)
ITEM = item_ledger("items_o", MAIN, ORDER_DAY)
ITEMF = item_ledger("items_of", MAIN, ORDER_DAY)

NAMED = "'click' AS token_ca, 'CLICK' AS token_symbol"
CLOSE = """
close AS (SELECT contract_address, date, price AS close_price FROM (
    SELECT contract_address, CAST(minute AS DATE) AS date, price, row_number() OVER (
      PARTITION BY contract_address, CAST(minute AS DATE) ORDER BY minute DESC) AS rn FROM prices_e)
  WHERE rn = 1)"""
LAST = """
last AS (SELECT contract_address, price AS last_price FROM (
    SELECT contract_address, price, row_number() OVER (
      PARTITION BY contract_address ORDER BY minute DESC) AS rn FROM prices_e) WHERE rn = 1)"""
NATIVE = """
native AS (SELECT address, sum(wi) AS wei_in, sum(wo) AS wei_out, sum(wg) AS wei_gas FROM (
    SELECT "to" AS address, value AS wi, NULL AS wo, NULL AS wg FROM calls_e WHERE value > 0
    UNION ALL SELECT "from", NULL, value, NULL FROM calls_e WHERE value > 0
    UNION ALL SELECT tx_sender, NULL, NULL, wei FROM gas_e) GROUP BY 1)"""


def account(table):
    return f"""
acc AS (SELECT *, CAST(evt_block_time AS DATE) AS date,
    CASE WHEN "from" = '{ACCOUNT}' THEN 'from' ELSE 'to' END AS transfer_type,
    CASE WHEN "from" = '{ACCOUNT}' THEN "to" ELSE "from" END AS counter_address
  FROM {table} WHERE "from" = '{ACCOUNT}' OR "to" = '{ACCOUNT}')"""


def account_balance(table, value, as_of):
    return account(table) + f""",
anet AS (SELECT date, contract_address,
    sum(CASE WHEN transfer_type = 'to' THEN {value} ELSE -{value} END) AS net FROM acc GROUP BY 1, 2),
adays AS ({days('acc', as_of)}),
abal AS (SELECT d.date, k.contract_address, CAST(sum(n.net) OVER (
    PARTITION BY k.contract_address ORDER BY d.date) AS BIGINT) AS raw
  FROM adays d CROSS JOIN (SELECT DISTINCT contract_address FROM acc) k
  LEFT JOIN anet n ON d.date = n.date AND k.contract_address = n.contract_address)"""


ABAL20 = account_balance("erc20_e", "value", EVENT_DAY) + "," + CLOSE + """,
r36 AS (SELECT b.date, b.contract_address, t.symbol,
    CAST(b.raw AS DOUBLE) / CASE WHEN t.symbol IS NULL THEN NULL ELSE 100 END AS balance_token,
    c.close_price
  FROM abal b LEFT JOIN tokens_e t ON b.contract_address = t.contract_address
  LEFT JOIN close c ON b.date = c.date AND b.contract_address = c.contract_address),
r36b AS (SELECT *, balance_token * close_price AS balance_usd FROM r36)"""
ACC_ETH = f"""
ae AS (SELECT *, CAST(block_time AS DATE) AS date,
    CASE WHEN "from" = '{ACCOUNT}' THEN 'from' ELSE 'to' END AS transfer_type,
    CASE WHEN "from" = '{ACCOUNT}' THEN "to" ELSE "from" END AS counter_address
  FROM calls_e WHERE "from" = '{ACCOUNT}' OR "to" = '{ACCOUNT}'),
aeg AS (SELECT ae.*, CASE WHEN transfer_type = 'from' THEN g.wei END AS gas_wei
  FROM ae LEFT JOIN gas_e g ON ae.tx_hash = g.tx_hash),
aeb AS (SELECT d.date, CAST(CAST(sum(coalesce(n.net, 0)) OVER (ORDER BY d.date) AS VARCHAR) AS DOUBLE)
    / 1000000000000000000 AS balance_eth
  FROM ({days('aeg', EVENT_DAY)}) d LEFT JOIN (
    SELECT date, sum(CASE WHEN transfer_type = 'to' THEN value ELSE -value - coalesce(gas_wei, 0) END) AS net
    FROM aeg GROUP BY 1) n ON d.date = n.date)"""


def trades(token):
    return f"""
tr AS (SELECT date, CASE WHEN even THEN 'buy' ELSE 'sell' END AS trade_type, project, tx_hash,
    tx_from AS address, '{token}' AS token_ca, '{token.lower()}' AS token_symbol, qty AS amount_token,
    usd AS amount_usd, p_type AS counter_token_ca, lower(p_type) AS counter_token_symbol
  FROM dex_o WHERE p_brand = '{token}' AND tx_from NOT IN {SINKS})"""


def measures(addresses=True, sell=1):
    out = []
    if addresses:
        out += ["count(DISTINCT address) FILTER (WHERE trade_type = 'buy') AS addresses_cnt_buy",
                f"count(DISTINCT address) FILTER (WHERE trade_type = 'sell') * {sell} AS addresses_cnt_sell"]
    out += ["count(DISTINCT tx_hash) FILTER (WHERE trade_type = 'buy') AS txs_cnt_buy",
            f"count(DISTINCT tx_hash) FILTER (WHERE trade_type = 'sell') * {sell} AS txs_cnt_sell"]
    for c, name in (("amount_token", "tx_volume_token"), ("amount_usd", "tx_volume_usd")):
        out += [f"round(sum({c}) FILTER (WHERE trade_type = 'buy'), 2) AS {name}_buy",
                f"round(sum({c}) FILTER (WHERE trade_type = 'sell') * {sell}, 2) AS {name}_sell"]
    return ", ".join(out)


def rolling(table, key, name):
    return "".join(
        f", (SELECT count(DISTINCT x.{key}) FROM {table} x WHERE x.date BETWEEN d.date - {n - 1} "
        f"AND d.date) AS {prefix}{name}" for prefix, n in (("dau", 1), ("wau", 7), ("mau", 30)))


def tops(source, measure, shown, n=10):
    return f"""
rk AS (SELECT *, row_number() OVER (PARTITION BY date ORDER BY {measure} DESC NULLS LAST, address) AS rn
  FROM {source}),
top AS (SELECT date, CASE WHEN rn <= {n} THEN 'Top' || lpad(CAST(rn AS VARCHAR), 2, '0')
    ELSE '(Others)' END AS top10, {shown} FROM rk GROUP BY 1, 2)"""


def today(column):
    return (f"SELECT date, top10, {column} FROM (SELECT *, row_number() OVER (PARTITION BY top10 "
            "ORDER BY date DESC) AS k FROM top) WHERE k = 1")


TOP_BAL = tops("own", "balance", "CAST(sum(balance) AS DOUBLE) / 100 AS balance_token")
SENT = f"""
sent AS (SELECT d.date, a.address, count(l.tx_hash) AS txs_cnt, CAST(sum(l.raw) AS BIGINT) AS vol
  FROM days d CROSS JOIN addrs a LEFT JOIN l ON d.date = l.date AND a.address = l.from_address
  WHERE a.address NOT IN {SINKS} GROUP BY 1, 2)"""
TOP_TXS = tops("sent", "txs_cnt", "CAST(sum(txs_cnt) AS BIGINT) AS txs_cnt")
TOP_VOL = tops("sent", "vol", "CAST(sum(vol) AS DOUBLE) / 100 AS tx_volume_token")


#: Balances on active days only.
SPARSE = """
spo AS (SELECT o.date, o.address, CASE WHEN n.net IS NOT NULL THEN balance END AS balance
  FROM own o LEFT JOIN net n ON o.date = n.date AND o.address = n.address)"""


def new_holders(period, out, source="own", first=False):
    trunc = "date" if period == "day" else f"CAST(date_trunc('{period}', date) AS DATE)"
    before = ("coalesce(sum(held) OVER (PARTITION BY address ORDER BY p ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)"
              if first else "lag(held, 1, 0) OVER (PARTITION BY address ORDER BY p)")
    return f"""
per AS (SELECT {trunc} AS p, address, sum(CASE WHEN balance > 0 THEN 1 ELSE 0 END) AS held
  FROM {source} GROUP BY 1, 2),
prev AS (SELECT *, {before} AS before FROM per)""", (
        f"SELECT p AS {'date' if period == 'day' else period}, count(address) AS {out} FROM prev "
        "WHERE before = 0 AND held > 0 GROUP BY 1")


SUPPLY = f"""
sup AS (SELECT date, CAST(sum(balance) FILTER (WHERE address NOT IN {SINKS}) AS DOUBLE) / 100 AS total_supply,
    CAST(sum(balance) FILTER (WHERE address = '{ZERO}') * -1 AS DOUBLE) / 100 AS total_mint,
    CAST(sum(balance) FILTER (WHERE address = '{DEAD}') * -1 AS DOUBLE) / 100 AS total_burn
  FROM bal GROUP BY 1)"""
SUPPLY_SELECT = f"SELECT date, {NAMED}, total_supply, total_mint, total_burn FROM sup"
PRICE_DAILY = """
pd AS (SELECT d.date, c.contract_address AS token_ca, upper(c.contract_address) AS token_symbol, c.close_price
  FROM days d LEFT JOIN (SELECT * FROM close WHERE contract_address = 'click') c ON d.date = c.date)"""
PAID = """
legs AS (SELECT date, to_address AS address, 'buy' AS side, raw AS v FROM l
  UNION ALL SELECT date, from_address, 'sell', -raw FROM l),
paid AS (SELECT address, CAST(sum(v) AS DOUBLE) / 100 AS balance_token,
    sum(CAST(v AS DOUBLE) / 100 * close_price) FILTER (WHERE side = 'buy')
      / nullif(CAST(sum(v) FILTER (WHERE side = 'buy') AS DOUBLE) / 100, 0) AS avg_purchase_price_usd
  FROM legs LEFT JOIN (SELECT * FROM close WHERE contract_address = 'click') c USING (date) GROUP BY 1)"""


def bands(source, measure, value, lo, hi):
    cases = " ".join(f"WHEN pr <= {i / 10} THEN 'TOP {100 - (i - 1) * 10}%'" for i in range(1, 11))
    return (f"SELECT CASE {cases} END AS class, min({value}) AS {lo}, max({value}) AS {hi}, "
            f"count(address) AS address_cnt FROM (SELECT *, percent_rank() OVER (ORDER BY {measure}) AS pr "
            f"FROM {source}) GROUP BY 1")


def eth_round(wei):
    return (f"CAST(CAST(CASE WHEN {wei} < 0 THEN -1 ELSE 1 END * ((abs({wei}) + 5000000000) // 10000000000) "
            "* 10000000000 AS VARCHAR) AS DOUBLE) / 1000000000000000000")


ETH = "/ 1000000000000000000"
COHORT_HOLDERS = item_ledger("items_of", MAIN, EVENT_DAY).split("days AS")[0].rstrip().rstrip(",") + f""",
people AS (SELECT address FROM (SELECT to_address AS address, raw AS v FROM l
    UNION ALL SELECT from_address, -raw FROM l)
  WHERE address NOT IN {SINKS} GROUP BY 1 HAVING sum(v) > 0)"""


def family(table, as_of):
    net = ", ".join(f"sum(CASE WHEN contract_address = '{ca}' THEN v ELSE 0 END) AS {n}" for n, ca in
                    (("a", MAIN), ("b", SECOND), ("c", THIRD)))
    run = ", ".join(f"sum(coalesce(n.{x}, 0)) OVER (PARTITION BY k.address ORDER BY d.date) AS {x}"
                    for x in "abc")
    return f"""
f AS (SELECT CAST(evt_block_time AS DATE) AS date, "from" AS s, "to" AS r, contract_address
  FROM {table} WHERE contract_address IN ('{MAIN}', '{SECOND}', '{THIRD}')),
fnet AS (SELECT date, address, {net} FROM (SELECT date, r AS address, contract_address, 1 AS v FROM f
    UNION ALL SELECT date, s, contract_address, -1 FROM f) GROUP BY 1, 2),
fbal AS (SELECT d.date, k.address, {run} FROM ({days('f', as_of)}) d
  CROSS JOIN (SELECT DISTINCT address FROM fnet WHERE address <> '{ZERO}') k
  LEFT JOIN fnet n ON d.date = n.date AND k.address = n.address)"""


DERIV = """SELECT date, count(DISTINCT address) FILTER (WHERE a > 0 AND b = 0 AND c = 0) AS main,
  count(DISTINCT address) FILTER (WHERE a > 0 AND b = 0 AND c > 0) AS main_third,
  count(DISTINCT address) FILTER (WHERE a > 0 AND b > 0 AND c = 0) AS main_second,
  count(DISTINCT address) FILTER (WHERE a > 0 AND b > 0 AND c > 0) AS main_second_third
FROM fbal GROUP BY 1"""
LINK = "'<a href=\"{p}' || {c} || '\" target=\"_blank\">' || {t} || '</a>'"
SITE = "https://etherscan.io/"


def link(column, page, text=None):
    return LINK.format(p=SITE + page, c=column, t=f"'{text}'" if text else column)


HHI = """SELECT date, round(sum(power(share, 2)), 9) AS hhi{extra} FROM (
  SELECT date, CAST(balance AS DOUBLE) / nullif(sum(balance) OVER (PARTITION BY date), 0) AS share
  FROM own) GROUP BY 1"""
DIST = """
nb AS (SELECT address, CAST(sum(net) AS BIGINT) AS n FROM net WHERE address NOT IN ({sinks}) GROUP BY 1),
fr AS (SELECT unnest(generate_series(greatest(min(n), 1), max(n))) AS nfts_cnt FROM nb),
sm AS (SELECT n, count(*) AS c FROM nb WHERE n > 0 GROUP BY 1),
fs AS (SELECT f.nfts_cnt, coalesce(s.c, 0) AS address_cnt,
    CAST(sum(f.nfts_cnt * coalesce(s.c, 0)) OVER (ORDER BY f.nfts_cnt) AS BIGINT) AS cum_nfts_cnt,
    CAST(sum(coalesce(s.c, 0)) OVER (ORDER BY f.nfts_cnt) AS BIGINT) AS cum_address_cnt
  FROM fr f LEFT JOIN sm s ON f.nfts_cnt = s.n)""".format(sinks=SINKS.strip("()"))
DIST_SELECT = """SELECT *, CAST(cum_nfts_cnt AS DOUBLE) / sum(nfts_cnt * address_cnt) OVER () AS cum_nfts_share,
  CAST(cum_address_cnt AS DOUBLE) / sum(address_cnt) OVER () AS cum_address_share FROM fs"""
IN_OUT = """SELECT date, count(*) FILTER (WHERE b = 0 AND balance > 0) AS holders_in_cnt,
  count(*) FILTER (WHERE b > 0 AND balance = 0) * -1 AS holders_out_cnt
FROM (SELECT *, lag(balance) OVER (PARTITION BY address ORDER BY date) AS b FROM own) GROUP BY 1"""
DELTAS = """SELECT *, CASE WHEN holders_dod > 0 THEN 'positive' ELSE 'negative' END AS holders_dod_group
FROM (SELECT date, h AS holders_cnt, h - lag(h, 1) OVER (ORDER BY date) AS holders_dod,
    h - lag(h, 7) OVER (ORDER BY date) AS holders_wow, h - lag(h, 30) OVER (ORDER BY date) AS holders_mom
  FROM (SELECT date, count(*) FILTER (WHERE balance > 0) AS h FROM own GROUP BY 1))"""


def half_up(x, places):
    """Round the shortest decimal text of a double, away from zero at a tie."""
    return f"CAST(round(CAST(CAST({x} AS VARCHAR) AS DECIMAL(38, 15)), {places}) AS DOUBLE)"


def avg(value, name, n, order="date", places=9):
    return (f"round(avg({value}) OVER (ORDER BY {order} ROWS BETWEEN {n} PRECEDING AND CURRENT ROW), {places}) "
            f"AS {name}")


MA = ", ".join(avg("close_price", f"ma_{n}d", n) for n in (5, 10, 20, 60))
#: Means over n days instead of the day and n before it.
MA_EXACT = ", ".join(avg("close_price", f"ma_{n}d", n - 1) for n in (5, 10, 20, 60))
NFT_DAILY = f"""
nd AS (SELECT d.date AS block_date, min(amount_usd) AS mn, quantile_disc(amount_usd, 0.5) AS md,
    max(amount_usd) AS mx, count(DISTINCT tx_hash) AS tx_count, round(sum(amount_usd), 2) AS tx_volume_usd
  FROM ({days('sales', ORDER_DAY, 'block_date')}) d LEFT JOIN sales s ON d.date = s.block_date GROUP BY 1),
nf AS (SELECT block_date, last_value(mn IGNORE NULLS) OVER w AS min_price_usd,
    last_value(md IGNORE NULLS) OVER w AS median_price_usd,
    last_value(mx IGNORE NULLS) OVER w AS max_price_usd, tx_count, tx_volume_usd
  FROM nd WINDOW w AS (ORDER BY block_date))"""
TOKEN_STATS = f"""
newest AS (SELECT token_id, amount_usd AS recent FROM (SELECT *, row_number() OVER (PARTITION BY token_id
    ORDER BY block_time DESC, tx_hash DESC, amount_usd DESC) AS rn FROM sales) WHERE rn = 1),
ts AS (SELECT {link("CAST(s.token_id AS VARCHAR)", f"nft/{MAIN}/", "Click")} AS etherscan_link,
    s.token_id, CAST(max(block_time) AS DATE) AS recent_trade_date, round(max(recent), 2) AS recent_price_usd,
    round(min(amount_usd), 2) AS min_price_usd, round(max(amount_usd), 2) AS max_price_usd,
    round(max(amount_usd) / min(amount_usd) - 1, 4) AS price_rate_high_low,
    round(max(recent) / min(amount_usd) - 1, 4) AS price_rate_recent_low,
    count(DISTINCT tx_hash) AS tx_count, round(sum(amount_usd), 2) AS tx_volume_usd
  FROM sales s JOIN newest USING (token_id) GROUP BY s.token_id)"""


def band(source, measure):
    half = f"2.58 * stddev_samp({measure}) / sqrt(count({measure}))"
    return (f"SELECT t.*, round(lo, 4) AS confidence_lower, round(hi, 4) AS confidence_upper, "
            f"CASE WHEN lo <= {measure} AND {measure} <= hi THEN 'Normal' ELSE 'Abnormal' END "
            f"AS confidence_group FROM {source} t, (SELECT avg({measure}) - {half} AS lo, "
            f"avg({measure}) + {half} AS hi FROM {source})")


USERS = f"""
tc AS (SELECT CAST(block_time AS DATE) AS date, "from" AS who FROM traces_e
  WHERE "to" = '{ACCOUNT}' AND success),
td AS ({days('tc', EVENT_DAY)})"""


def overlap(table="erc20_e", having="HAVING sum(v) > 0"):
    return f"""
pos AS (SELECT contract_address, address, sum(v) AS raw FROM (
    SELECT contract_address, "to" AS address, value AS v FROM {table}
    UNION ALL SELECT contract_address, "from", -value FROM {table}) GROUP BY 1, 2 {having})"""


OVERLAP = overlap()
NFT_OVERLAP = f"""
mv AS (SELECT address, contract_address, sum(v) AS n, count(*) FILTER (WHERE v > 0) AS got FROM (
    SELECT "to" AS address, contract_address, 1 AS v FROM items_of
    UNION ALL SELECT "from", contract_address, -1 FROM items_of)
  WHERE contract_address NOT IN ('{MAIN}', '{SECOND}', '{THIRD}') GROUP BY 1, 2),
ov AS (SELECT m.contract_address, count(DISTINCT m.address) FILTER (WHERE m.n > 0) AS address_cnt
  FROM mv m JOIN people p ON m.address = p.address WHERE m.got > 0 GROUP BY 1)"""


def profile(address):
    """Registry entry of a contract, its standard probed in order over the tables of transfers."""
    return f"""
SELECT project, contract_name, CASE
    WHEN EXISTS (SELECT 1 FROM erc20_e WHERE contract_address = {address}) THEN 'ERC-20'
    WHEN EXISTS (SELECT 1 FROM items_o WHERE contract_address = {address}) THEN 'ERC-721'
    WHEN EXISTS (SELECT 1 FROM batch_o WHERE contract_address = {address}) THEN 'ERC-1155'
    ELSE 'Unknown' END AS contract_type, '{ACCOUNT}' AS deployer
FROM (SELECT DISTINCT event_type AS address, lower(event_type) AS project, 'event' AS contract_name FROM events
  UNION ALL SELECT DISTINCT p_brand, lower(p_brand), 'part' FROM part
  UNION ALL SELECT DISTINCT o_orderpriority, lower(o_orderpriority), 'order' FROM orders
  UNION ALL SELECT n_name, lower(n_name), 'nation' FROM nation) WHERE address = {address}"""


def sql():
    units = "CAST({0} AS DOUBLE) / 100"
    raw_legs = """
lg AS (SELECT date, contract_address, to_address AS address, 'buy' AS transfer_type, raw AS v FROM al
  UNION ALL SELECT date, contract_address, from_address, 'sell', -raw FROM al)"""
    all_l = """
al AS (SELECT CAST(evt_block_time AS DATE) AS date, contract_address, "from" AS from_address,
    "to" AS to_address, value AS raw FROM erc20_e)"""
    nd, nd_sel = new_holders("day", "dnu")
    nw, nw_sel = new_holders("week", "wnu")
    nm, nm_sel = new_holders("month", "mnu")
    holders = f"SELECT {NAMED}, address, {units.format('balance')} AS balance_token FROM holders"
    share = f"""SELECT {NAMED}, address, b AS balance_token,
  round(b / (SELECT sum(b) FROM (SELECT {units.format('balance')} AS b FROM holders)), 9) AS share
FROM (SELECT address, {units.format('balance')} AS b FROM holders) ORDER BY b DESC, address LIMIT 10"""
    bal_units = f"SELECT date, {NAMED}, address, {units.format('balance')} AS balance_token FROM bal"
    idx = "CAST(address_idx AS DOUBLE) / max(address_idx) OVER () AS address_idx_cumulative_dist"
    trade_cols = ("date, trade_type, project, tx_hash, address, token_ca, token_symbol, amount_token, "
                  "amount_usd, counter_token_ca, counter_token_symbol")
    eth_who = f"""
oc AS (SELECT h.address, wei_in, wei_out, wei_gas, coalesce(wei_in, 0) - coalesce(wei_out, 0)
    - coalesce(wei_gas, 0) AS wei FROM holders h LEFT JOIN native n ON h.address = n.address)"""
    oracle = {
        # table operators
        "t01_scale_amount": q("SELECT evt_tx_hash, e.contract_address, t.symbol AS token_symbol, "
                              "CASE WHEN t.symbol IS NULL THEN NULL ELSE CAST(value AS DOUBLE) / 100 END "
                              "AS value_token FROM erc20_e e LEFT JOIN tokens_e t "
                              "ON e.contract_address = t.contract_address"),
        "t02_token_info": q("SELECT p_brand AS token_ca, p_type AS token_symbol, p_size AS decimals FROM ("
                            "SELECT *, row_number() OVER (PARTITION BY p_brand ORDER BY p_type, p_size) AS rn "
                            "FROM part) WHERE rn = 1"),
        "t03_account_transfers": q(account("erc20_e"), f"SELECT evt_tx_hash, '{ACCOUNT}' AS ca_address, "
                                   "transfer_type, counter_address FROM acc"),
        "t04_explode_batch": q("SELECT evt_tx_hash, id, value FROM batch_o"),
        "t04_explode_batch_cross": q(
            "SELECT DISTINCT a.evt_tx_hash, a.id, b.value FROM batch_o a JOIN batch_o b "
            "ON a.evt_tx_hash = b.evt_tx_hash"),
        "t05_value_calls": q("SELECT tx_hash, call_type, CAST(value AS DOUBLE) AS value FROM calls_e "
                             "WHERE value > 0"),
        "t06_gas_cost": q("SELECT tx_hash, CAST(CAST(wei AS VARCHAR) AS DOUBLE) / 1000000000000000000 AS gas_eth FROM gas_e"),
        "t07_signed_flows": q(all_l, raw_legs, "SELECT date, contract_address, address, transfer_type, "
                              "CAST(sum(v) AS BIGINT) AS transfer_amount FROM lg GROUP BY 1, 2, 3, 4"),
        "t08_net_flows": q(all_l, raw_legs, "SELECT date, contract_address, address, "
                           "CAST(sum(v) AS BIGINT) AS net_amount FROM lg GROUP BY 1, 2, 3"),
        "t09_in_out_by_date": q(account("erc20_e"), """
SELECT date, contract_address, CAST(i AS BIGINT) AS value_in, CAST(o AS BIGINT) AS value_out,
  CAST(coalesce(i, 0) - coalesce(o, 0) AS BIGINT) AS value_net FROM (
  SELECT date, contract_address, sum(value) FILTER (WHERE transfer_type = 'to') AS i,
    sum(value) FILTER (WHERE transfer_type = 'from') AS o FROM acc GROUP BY 1, 2)"""),
        "t10_date_spine": q(EV, "SELECT date FROM days"),
        "t11_address_spine": q(EV, "SELECT address FROM addrs"),
        "t12_dense_frame": q(EV, "SELECT date, address FROM days CROSS JOIN addrs"),
        "t13_running_balance": q(EV, "SELECT date, address, balance FROM bal"),
        "t13_running_balance_sparse": q(EV, """
SELECT b.date, b.address, CASE WHEN n.net IS NOT NULL THEN balance END AS balance
FROM bal b LEFT JOIN net n ON b.date = n.date AND b.address = n.address"""),
        "t14_daily_close": q("""SELECT DISTINCT contract_address, CAST(minute AS DATE) AS date,
  last_value(price) OVER (PARTITION BY contract_address, CAST(minute AS DATE) ORDER BY minute
    ROWS BETWEEN UNBOUNDED PRECEDING AND UNBOUNDED FOLLOWING) AS close_price FROM prices_e"""),
        "t15_latest_price": q(LAST, "SELECT contract_address, last_price FROM last"),
        "t16_attach_usd": q(all_l, raw_legs, CLOSE, f"""
SELECT n.date, n.contract_address, n.address, {units.format('n.v')} AS amount,
  {units.format('n.v')} * c.close_price AS amount_usd
FROM (SELECT date, contract_address, address, sum(v) AS v FROM lg GROUP BY 1, 2, 3) n
LEFT JOIN close c ON n.date = c.date AND n.contract_address = c.contract_address"""),
        "t16_as_of": q("""
ticks AS (SELECT contract_address, minute, max(price) AS last_price FROM prices_e
  WHERE extract('minute' FROM minute) % 7 = 0 GROUP BY 1, 2)""", """
SELECT evt_tx_hash, e.contract_address, evt_block_time, CAST(value AS DOUBLE) / 100 AS amount, last_price,
  CAST(value AS DOUBLE) / 100 * last_price AS amount_usd
FROM erc20_e e ASOF LEFT JOIN ticks t ON e.contract_address = t.contract_address AND e.evt_block_time >= t.minute"""),
        "t17_rolling_distinct": q(all_l, f"SELECT d.date{rolling('al', 'to_address', '')} "
                                  f"FROM ({days('al', EVENT_DAY)}) d"),
        "t18_cumulative_distinct": q(all_l, f"""SELECT d.date,
  (SELECT count(DISTINCT to_address) FROM al WHERE al.date = d.date) AS dau,
  (SELECT count(DISTINCT to_address) FROM al WHERE al.date <= d.date) AS cumulative_dau
FROM ({days('al', EVENT_DAY)}) d"""),
        "t19_exclude_addresses": q(f"SELECT evt_tx_hash, \"from\" AS address FROM erc20_e "
                                   f"WHERE \"from\" NOT IN {SINKS}"),
        "t20_latest_per_key": q("SELECT date, address, CAST(value AS BIGINT) AS value FROM (SELECT "
                                "CAST(evt_block_time AS DATE) AS date, evt_block_time, \"to\" AS address, value, "
                                "row_number() OVER (PARTITION BY \"to\" ORDER BY evt_block_time DESC) AS rn "
                                "FROM erc20_e) WHERE rn = 1"),
        "t21_topn_with_others": q(
            "ds AS (SELECT CAST(evt_block_time AS DATE) AS date, \"to\" AS address, sum(value) AS v "
            "FROM erc20_e GROUP BY 1, 2)", tops("ds", "v", "CAST(sum(v) AS BIGINT) AS volume"),
            "SELECT date, top10, volume FROM top"),
        "t22_top_n": q("SELECT evt_tx_hash, CAST(value AS BIGINT) AS value FROM erc20_e "
                       "ORDER BY value DESC, evt_tx_hash LIMIT 10"),
        "t23_share_of_total": q(EVF, "SELECT address, balance, round(CAST(balance AS DOUBLE) / "
                                "(SELECT sum(balance) FROM holders), 9) AS share FROM holders"),
        "t23_share_of_day": q(EVF, "SELECT date, address, balance, round(CAST(balance AS DOUBLE) / "
                              "nullif(sum(balance) OVER (PARTITION BY date), 0), 9) AS share FROM own"),
        "t24_hhi": q(EVF, HHI.format(extra="")),
        "t25_cumulative_position": q(EV, f"SELECT {idx}, * FROM (SELECT row_number() OVER ("
                                     "ORDER BY b, address) AS address_idx, address, b AS balance FROM ("
                                     "SELECT address, CAST(sum(net) AS BIGINT) AS b FROM net GROUP BY 1))"),
        "t26_percentile_class": q(EV, bands(
            "(SELECT address, sum(net) AS b, CAST(sum(net) AS DOUBLE) / 100 AS v FROM net GROUP BY 1)",
            "b", "v", "value_min", "value_max")),
        "t27_moving_average": q(CLOSE, f"SELECT date, close_price, {avg('close_price', 'ma_7', 7)}, "
                                f"{avg('close_price', 'ma_14', 14)} FROM close WHERE contract_address = 'click'"),
        "t28_forward_fill": q(f"""
s AS (SELECT CAST(l_shipdate AS DATE) AS date, max(l_extendedprice) AS p FROM ol
  WHERE p_brand = '{MAIN}' GROUP BY 1),
g AS (SELECT d.date, s.p FROM ({days('s', ORDER_DAY)}) d LEFT JOIN s ON d.date = s.date)""",
                              "SELECT date, last_value(p IGNORE NULLS) OVER (ORDER BY date) AS price FROM g"),
        "t29_lag_delta": q(ITEM, DELTAS),
        "t30_holder_transitions": q(ITEM, IN_OUT),
        "t31_new_holders": q(ITEM, new_holders("month", "new_cnt")[0], new_holders("month", "new_cnt")[1]),
        "t32_avg_purchase_price": q(EV, CLOSE, PAID, "SELECT address, balance_token, "
                                    "round(avg_purchase_price_usd, 6) AS avg_purchase_price_usd FROM paid"),
        "t33_segment_counts": q(EV, """SELECT date,
  count(DISTINCT CASE WHEN balance > 10000 THEN address END) AS large,
  count(DISTINCT CASE WHEN balance > 0 AND balance <= 10000 THEN address END) AS small FROM own GROUP BY 1"""),
        "t34_holdings_distribution": q(ITEMF, DIST, DIST_SELECT),
        "t35_confidence_band": q("cb AS (SELECT p_partkey, p_retailprice FROM part)",
                                 band("cb", "p_retailprice")),
        "t36_orient_trades": q(trades(MAIN).replace(f"AND tx_from NOT IN {SINKS}", ""),
                               f"SELECT {trade_cols} FROM tr"),
        "t37_trade_measures": q(trades(MAIN), f"SELECT project, counter_token_ca, {measures()} "
                                "FROM tr GROUP BY 1, 2"),
        "t38_current_balance": q(EV, NATIVE, eth_who, f"SELECT address, CAST(CAST(wei AS VARCHAR) AS DOUBLE) {ETH} "
                                 "AS balance FROM oc"),
        "t39_restrict_to": q(EV, "SELECT tx_hash, CAST(value AS DOUBLE) AS value FROM traces_e "
                             "WHERE \"from\" IN (SELECT address FROM holders)"),
        "t40_supply_mint_burn": q(EV, SUPPLY, "SELECT date, total_supply, total_mint, total_burn FROM sup"),
        "t41_explorer_link": q(EV, f"SELECT address, {link('address', 'address/')} AS link, "
                               f"{link('address', 'address/', 'Click')} AS short_link FROM addrs"),
        "t42_contract_profile": q(profile(f"'{THIRD}'")),
        # token reports
        "r01_transfers": q(EV, f"SELECT datetime, date, tx_hash, {NAMED}, from_address, to_address, "
                           f"{units.format('raw')} AS value_token FROM l"),
        "r02_trades": q(trades(MAIN), f"SELECT date AS datetime, {trade_cols} FROM tr"),
        "r03_balance": q(EV, bal_units),
        "r03_balance_orders": q(OR, f"SELECT date, '{MAIN}' AS token_ca, '{MAIN.upper()}' AS token_symbol, "
                                "address, CAST(balance AS DOUBLE) AS balance_token FROM bal"),
        "r03_balance_sparse": q(EV, f"""
SELECT b.date, CASE WHEN n.net IS NOT NULL THEN 'click' END AS token_ca,
  CASE WHEN n.net IS NOT NULL THEN 'CLICK' END AS token_symbol, b.address,
  CASE WHEN n.net IS NOT NULL THEN {units.format('balance')} END AS balance_token
FROM bal b LEFT JOIN net n ON b.date = n.date AND b.address = n.address"""),
        "r04_price_daily": q(EV, CLOSE, PRICE_DAILY, "SELECT * FROM pd"),
        "r05_holders": q(EVF, holders),
        "r06_supply_mint_burn": q(EVF, SUPPLY, SUPPLY_SELECT),
        "r06_supply_mint_burn_sparse": q(EV, f"""
act AS (SELECT b.date, b.address, n.net IS NOT NULL AS moved, CASE WHEN n.net IS NOT NULL THEN balance ELSE 0 END AS v
  FROM bal b LEFT JOIN net n ON b.date = n.date AND b.address = n.address)""", f"""
SELECT date, CASE WHEN moved THEN 'click' END AS token_ca, CASE WHEN moved THEN 'CLICK' END AS token_symbol,
  CAST(sum(v) FILTER (WHERE address NOT IN {SINKS}) AS DOUBLE) / 100 AS total_supply,
  CAST(sum(v) FILTER (WHERE address = '{ZERO}') * -1 AS DOUBLE) / 100 AS total_mint,
  CAST(sum(v) FILTER (WHERE address = '{DEAD}') * -1 AS DOUBLE) / 100 AS total_burn
FROM act GROUP BY date, moved"""),
        "r07_overlap_erc20": q(EV, LAST, OVERLAP, f"""
SELECT {NAMED}, h.address, p.contract_address, t.symbol, {units.format('p.raw')} AS balance_token,
  {units.format('p.raw')} * last_price AS balance_usd
FROM holders h JOIN pos p ON h.address = p.address JOIN tokens_e t ON p.contract_address = t.contract_address
LEFT JOIN last ON last.contract_address = p.contract_address"""),
        "r08_overlap_eth": q(EV, NATIVE, eth_who, f"SELECT {NAMED}, address, CAST(CAST(wei AS VARCHAR) AS DOUBLE) {ETH} "
                             "AS balance_eth FROM oc WHERE wei > 0"),
        "r09_active_addresses": q(EV, f"SELECT d.date{rolling('l', 'from_address', '_from')}"
                                  f"{rolling('l', 'to_address', '_to')} FROM days d"),
        "r10_avg_purchase_price": q(EV, CLOSE, PAID, f"""
SELECT address_idx, balance_token, round(a, 6) AS avg_purchase_price_usd, {idx} FROM (
  SELECT row_number() OVER (ORDER BY avg_purchase_price_usd, address) AS address_idx, balance_token,
    avg_purchase_price_usd AS a FROM paid
  WHERE address NOT IN {SINKS} AND balance_token > 0 AND avg_purchase_price_usd IS NOT NULL)"""),
        "r11_current_holders": q(EV, "SELECT date, count(*) AS holders_cnt FROM own WHERE balance > 0 GROUP BY 1"),
        "r12_new_holders_daily": q(EV, nd, nd_sel),
        "r13_new_holders_weekly": q(OR, nw, nw_sel),
        "r14_new_holders_monthly": q(OR, nm, nm_sel),
        "r15_other_coins_eth": q(EV, NATIVE, eth_who, f"""
SELECT {idx}, address_idx, address, CAST(CAST(wei_in AS VARCHAR) AS DOUBLE) {ETH} AS eth_in,
  CAST(CAST(wei_out AS VARCHAR) AS DOUBLE) {ETH} AS eth_out, CAST(CAST(wei_gas AS VARCHAR) AS DOUBLE) {ETH} AS gas_spent,
  {eth_round('wei')} AS balance_eth
FROM (SELECT *, row_number() OVER (ORDER BY wei, address) AS address_idx FROM oc)"""),
        "r16_other_coins_erc20": q(EV, LAST, overlap(having=""), f"""
SELECT {idx}, address_idx, address, round(b, 8) AS balance_token, {half_up("coalesce(b * price, 0)", 2)} AS balance_usd
FROM (SELECT h.address, coalesce({units.format('p.raw')}, 0) AS b,
    (SELECT last_price FROM last WHERE contract_address = 'purchase') AS price,
    row_number() OVER (ORDER BY coalesce(p.raw, 0), h.address) AS address_idx
  FROM holders h LEFT JOIN pos p ON h.address = p.address AND p.contract_address = 'purchase')"""),
        "r17_top_holders_list": q(EVF, share),
        "r18_wealth_gap_txs": q(EV, SENT, TOP_TXS, "SELECT * FROM top"),
        "r19_wealth_gap_txs_today": q(EV, SENT, TOP_TXS, today("txs_cnt")),
        "r20_wealth_gap_balance": q(EVF, TOP_BAL, "SELECT * FROM top"),
        "r20_wealth_gap_balance_orders": q(OR, tops(
            "own", "balance", "CAST(sum(balance) AS DOUBLE) AS balance_token"), "SELECT * FROM top"),
        "r21_wealth_gap_balance_today": q(EVF, TOP_BAL, today("balance_token")),
        "r22_wealth_gap_volume": q(EV, SENT, TOP_VOL, "SELECT * FROM top"),
        "r23_wealth_gap_volume_today": q(EV, SENT, TOP_VOL, today("tx_volume_token")),
        "r24_dex_dominance_by_platform": q(trades(MAIN), f"SELECT project, {measures()} FROM tr GROUP BY 1"),
        "r25_dex_dominance_daily": q(OR, trades(MAIN), f"SELECT d.date, project, {measures(sell=-1)} "
                                     "FROM days d LEFT JOIN tr ON d.date = tr.date GROUP BY 1, 2"),
        "r26_dex_pairs_by_symbol": q(trades(MAIN), "SELECT counter_token_symbol, counter_token_ca, "
                                     f"{measures(False)} FROM tr GROUP BY 1, 2"),
        "r27_dex_pairs_daily": q(OR, trades(MAIN), "SELECT d.date, counter_token_symbol, counter_token_ca, "
                                 f"{measures(False, -1)} FROM days d LEFT JOIN tr ON d.date = tr.date "
                                 "GROUP BY 1, 2, 3"),
        "r28_marketcap": q(EVF, SUPPLY, CLOSE, PRICE_DAILY, "SELECT pd.date, coalesce(close_price, 0) * "
                           "coalesce(total_supply, 0) AS marketcap FROM pd LEFT JOIN sup ON pd.date = sup.date"),
        "r29_price_with_ma": q(EV, CLOSE, PRICE_DAILY, f"SELECT *, {MA} FROM pd"),
        "r30_volume": q(EV, CLOSE, PRICE_DAILY, f"""
SELECT d.date, txs_cnt, volume_token, volume_token * close_price AS volume_usd FROM (
  SELECT days.date, count(DISTINCT tx_hash) AS txs_cnt, {units.format('sum(raw)')} AS volume_token
  FROM days LEFT JOIN l ON days.date = l.date GROUP BY 1) d LEFT JOIN pd ON d.date = pd.date"""),
        "r31_tokenomics": q(EV, SUPPLY, SUPPLY_SELECT),
        # account reports
        "r32_account_transfers_erc1155": q(account("batch_o"), account("erc20_e").replace("acc AS", "acs AS"), """
SELECT evt_block_time AS datetime, 'batch' AS transfer_type, evt_tx_hash AS tx_hash, "from" AS from_address,
  "to" AS to_address, contract_address, CAST(id AS BIGINT) AS id, value FROM acc
UNION ALL SELECT evt_block_time, 'single', evt_tx_hash, "from", "to", contract_address,
  CAST(evt_tx_hash AS BIGINT), value FROM acs"""),
        "r33_account_transfers_erc20": q(account("erc20_e"), f"""
SELECT evt_block_time AS datetime, '{ACCOUNT}' AS ca_address, transfer_type, evt_tx_hash AS tx_hash,
  counter_address, a.contract_address AS token_ca, t.symbol AS token_symbol,
  CASE WHEN t.symbol IS NOT NULL THEN CAST(value AS DOUBLE) / 100 END AS value_token
FROM acc a LEFT JOIN tokens_e t ON a.contract_address = t.contract_address"""),
        "r34_account_transfers_erc721": q(account("items_o"), """
SELECT evt_block_time AS datetime, evt_tx_hash AS tx_hash, "from" AS from_address, "to" AS to_address,
  contract_address, "tokenId" FROM acc"""),
        "r35_account_transfers_eth": q(ACC_ETH, f"""
SELECT block_time AS datetime, '{ACCOUNT}' AS ca_address, transfer_type, tx_hash, counter_address,
  CAST(CAST(value AS VARCHAR) AS DOUBLE) {ETH} AS value_eth, CAST(CAST(gas_wei AS VARCHAR) AS DOUBLE) {ETH} AS gas_eth, input AS data FROM aeg"""),
        "r36_account_balance_erc20": q(ABAL20, "SELECT date, contract_address, symbol, balance_token, "
                                       "balance_usd FROM r36b"),
        "r37_account_balance_erc721": q(account_balance("items_o", "1", ORDER_DAY), """
SELECT b.date, b.contract_address, t.name AS symbol, raw AS balance_token
FROM abal b LEFT JOIN tokens_nft_o t ON b.contract_address = t.contract_address"""),
        "r38_account_balance_eth": q(ACC_ETH, "SELECT date, balance_eth FROM aeb"),
        "r39_balance_erc20_view": q(ABAL20, """
SELECT date, contract_address, coalesce(symbol, contract_address) AS symbol,
  coalesce(balance_token, 0) AS balance_token, coalesce(balance_usd, 0) AS balance_usd FROM r36b"""),
        "r54_balance_erc20_total": q(ABAL20, "SELECT date, round(sum(balance_usd), 6) AS balance_usd "
                                     "FROM r36b GROUP BY 1"),
        "r55_balance_eth_view": q(ACC_ETH, "SELECT date, balance_eth FROM aeb"),
        "r46_contract_profile": q(" UNION ALL ".join(profile(a) for a in (
            "'click'", f"'{MAIN}'", "'1-URGENT'", "(SELECT n_name FROM nation WHERE n_nationkey = 0)"))),
        "r52_contract_active_users": q(USERS, f"SELECT d.date{rolling('tc', 'who', '')} FROM td d"),
        "r53_contract_cumulative_users": q(USERS, """SELECT d.date,
  (SELECT count(DISTINCT who) FROM tc WHERE tc.date = d.date) AS dau,
  (SELECT count(DISTINCT who) FROM tc WHERE tc.date <= d.date) AS cumulative_dau FROM td d"""),
        # collection reports
        "r41_cohort_nft_overlap": q(COHORT_HOLDERS, NFT_OVERLAP, f"""
SELECT {link('o.contract_address', 'address/', 'Click')} AS etherscan_link, t.name, o.contract_address,
  address_cnt, CAST(address_cnt AS DOUBLE) / (SELECT count(*) FROM people) AS address_share
FROM ov o LEFT JOIN tokens_nft_o t ON o.contract_address = t.contract_address"""),
        "r42_cohort_eth_class": q(COHORT_HOLDERS, NATIVE, LAST, f"""
ce AS (SELECT address, e, e * (SELECT last_price FROM last WHERE contract_address = 'click') AS u FROM (
  SELECT p.address, {eth_round('(coalesce(wei_in, 0) - coalesce(wei_out, 0) - coalesce(wei_gas, 0))')} AS e
  FROM people p LEFT JOIN native n ON p.address = n.address))""",
                                  bands("ce", "e", "u", "eth_balance_usd_min", "eth_balance_usd_max")),
        "r43_derivative_items": q(family("items_o", ORDER_DAY), DERIV),
        "r44_holding_distribution": q(ITEMF, DIST, DIST_SELECT),
        "r45_each_holder": q(family("items_o", ORDER_DAY), f"""
SELECT {link('address', 'address/')} AS address, CAST(sum(a) AS BIGINT) AS main_cnt,
  CAST(sum(b) AS BIGINT) AS second_cnt, CAST(sum(c) AS BIGINT) AS third_cnt FROM fnet
WHERE address NOT IN {SINKS} GROUP BY fnet.address HAVING sum(a) > 0 OR sum(b) > 0 OR sum(c) > 0"""),
        "r48_holders_in_out": q(ITEMF, IN_OUT),
        "r49_holders_main": q(ITEMF, DELTAS),
        "r50_nft_price_volume": q(NFT_DAILY, "SELECT *, " + ", ".join(
            avg("min_price_usd", f"min_price_usd_ma_{n}d", n, "block_date", 7) for n in (7, 28, 90)) + " FROM nf"),
        "r51_nft_token_stats": q(TOKEN_STATS, band("ts", "min_price_usd")),
    }
    lines = "".join(f', CAST({x} AS DOUBLE) AS "{x} Line"' for x in ("0.01", "0.15", "0.25"))
    for name, brand in (("main", MAIN), ("second", SECOND), ("third", THIRD), ("fourth", "Brand#5")):
        oracle[f"r47_hhi_daily_{name}"] = q(
            item_ledger("items_of", brand, ORDER_DAY),
            HHI.format(extra=lines).replace("FROM own)", "FROM own WHERE date > DATE '1995-08-24')"))
    for token in ("click", "purchase", "view", "signup", "error"):
        oracle[f"r40_cohort_token_class_{token}"] = q(COHORT_HOLDERS, LAST, f"""
tt AS (SELECT address, sum(v) AS raw FROM (
    SELECT "to" AS address, value AS v FROM erc20_e WHERE contract_address = '{token}' AND value > 0
    UNION ALL SELECT "from", -value FROM erc20_e WHERE contract_address = '{token}' AND value > 0) GROUP BY 1),
ct AS (SELECT p.address, coalesce(CAST(raw AS DOUBLE) / 100, 0) AS b,
    coalesce(CAST(raw AS DOUBLE) / 100, 0)
      * (SELECT last_price FROM last WHERE contract_address = '{token}') AS u
  FROM people p LEFT JOIN tt ON p.address = tt.address)""",
            bands("ct", "b", "u", "token_balance_usd_min", "token_balance_usd_max"))
    oracle["a01_wide_amounts"] = (
        f"SELECT address, contract_address, round(balance_token, 6) AS balance_token FROM ({oracle['r07_overlap_erc20']})")
    oracle["r07_overlap_erc20_priced"] = f"SELECT * FROM ({oracle['r07_overlap_erc20']}) WHERE balance_usd IS NOT NULL"
    oracle["a02_wide_ids"] = (
        f"""SELECT * REPLACE (lpad(CAST("tokenId" AS VARCHAR), 78, '9') AS "tokenId") FROM ({oracle['r34_account_transfers_erc721']})""")
    oracle["a13_holders_from_layer"] = oracle["r05_holders"]
    oracle["a14_volume_from_layer"] = oracle["r30_volume"]
    for name, report in {
            "holders": "r05_holders", "supply": "r06_supply_mint_burn", "current_holders": "r11_current_holders",
            "top_holders": "r17_top_holders_list", "wealth_gap_balance": "r20_wealth_gap_balance",
            "marketcap": "r28_marketcap", "price_daily": "r04_price_daily"}.items():
        oracle[f"a13_{name}_from_views"] = oracle[report]
    for name in ("t39_restrict_to", "r07_overlap_erc20", "r08_overlap_eth", "r15_other_coins_eth", "r16_other_coins_erc20",
                 "r40_cohort_token_class_click", "r41_cohort_nft_overlap", "r42_cohort_eth_class"):
        oracle[f"{name}_beyond"] = oracle[name]
    oracle["a14_balance_appended"] = oracle["a14_balance_by_days"] = oracle["r03_balance"]
    oracle["a14_balance_appended_wide"] = rounded(oracle["r03_balance"], ("balance_token",))
    oracle["r09_active_addresses_from_days"] = oracle["r09_active_addresses"]
    oracle["r52_contract_active_users_from_days"] = oracle["r52_contract_active_users"]
    oracle["r46_contract_profile_by_zones"] = oracle["r46_contract_profile"]
    for name, period, ledger_, options in (
            ("r12_new_holders_daily", "day", EV, ("sparse", "first", "sparse_first")),
            ("r13_new_holders_weekly", "week", OR, ("sparse", "first")), ("r14_new_holders_monthly", "month", OR, ("sparse",))):
        for option in options:
            parts = new_holders(period, f"{period[0]}nu", "spo" if "sparse" in option else "own", "first" in option)
            oracle[f"{name}_{option}"] = q(ledger_, SPARSE, *parts)
    oracle["r11_current_holders_sparse"] = q(EV, SPARSE, "SELECT date, count(*) AS holders_cnt FROM spo WHERE balance > 0 GROUP BY 1")
    oracle["r20_wealth_gap_balance_sparse"] = q(EV, SPARSE, tops(
        "spo", "balance", "CAST(sum(balance) AS DOUBLE) / 100 AS balance_token"), "SELECT * FROM top")
    oracle["r28_marketcap_sparse"] = q(EV, CLOSE, PRICE_DAILY, f"""
ssup AS (SELECT date, CAST(sum(balance) FILTER (WHERE address NOT IN {SINKS}) AS DOUBLE) / 100 AS s FROM (
    SELECT b.date, b.address, balance FROM bal b JOIN net n ON b.date = n.date AND b.address = n.address) GROUP BY 1)""", """
SELECT pd.date, coalesce(close_price, 0) * coalesce(s, 0) AS marketcap FROM pd LEFT JOIN ssup ON pd.date = ssup.date""")
    oracle["r31_tokenomics_sparse"] = oracle["r06_supply_mint_burn_sparse"]
    oracle["r29_price_with_ma_exact"] = q(EV, CLOSE, PRICE_DAILY, f"SELECT *, {MA_EXACT} FROM pd")
    oracle["r41_cohort_nft_overlap_labelled"] = f"SELECT * FROM ({oracle['r41_cohort_nft_overlap']}) WHERE name IS NOT NULL"
    oracle["r50_nft_price_volume_exact"] = q(NFT_DAILY, "SELECT *, " + ", ".join(
        avg("min_price_usd", f"min_price_usd_ma_{n}d", n - 1, "block_date", 7) for n in (7, 28, 90)) + " FROM nf")
    oracle["a01_holders_from_parquet"] = rounded(oracle["r05_holders"], ("balance_token",))
    oracle["a01_balance_from_parquet"] = rounded(q(EVF, bal_units), ("balance_token",))
    oracle["a01_overlap_from_parquet"] = rounded(q(EVF, LAST, overlap("erc20_ef"), f"""
SELECT {NAMED}, h.address, p.contract_address, t.symbol, {units.format('p.raw')} AS balance_token,
  {units.format('p.raw')} * last_price AS balance_usd
FROM holders h JOIN pos p ON h.address = p.address JOIN tokens_e t ON p.contract_address = t.contract_address
LEFT JOIN last ON last.contract_address = p.contract_address"""), ("balance_token", "balance_usd"))
    trades_of = "o_orderpriority AS project, hash AS tx_hash, {0} AS tx_from"
    bought, sold = ("CASE WHEN l_linenumber % 2 = 0 THEN p_brand ELSE p_type END",
                    "CASE WHEN l_linenumber % 2 = 0 THEN p_type ELSE p_brand END")
    oracle |= {
        "a03_erc1155_single": q("SELECT *, evt_tx_hash AS id FROM erc20_e"),
        "a04_erc1155_batch": q("SELECT * REPLACE (CAST(id AS VARCHAR) AS id) FROM batch_o"),
        "a05_traces": q("SELECT * REPLACE (CAST(CAST(value AS VARCHAR) AS DOUBLE) AS value) FROM traces_e"),
        "a06_gas_fees": q(f"SELECT hash AS tx_hash, {addr('user_id')} AS tx_sender, value AS gas_price_gwei, "
                          "21000 + event_id % 1000 AS gas_used, ts AS block_time FROM ev"),
        "a07_prices_usd": q("SELECT * FROM prices_e"),
        "a08_tokens_erc20": q("SELECT * FROM tokens_e"),
        "a09_tokens_nft": q("SELECT * FROM tokens_nft_o"),
        "a10_dex_trades": q(f"""
SELECT CAST(o_orderdate AS DATE) AS block_date, {trades_of.format(addr('o_custkey'))}, {bought} AS token_bought_address,
  {sold} AS token_sold_address, lower({bought}) AS token_bought_symbol, lower({sold}) AS token_sold_symbol,
  l_quantity AS token_bought_amount, l_quantity AS token_sold_amount, l_extendedprice AS amount_usd
FROM ol WHERE CAST(o_orderdate AS DATE) <= {ORDER_DAY}"""),
        "a11_nft_trades": q(f"""
SELECT CAST(l_shipdate AS DATE) AS block_date, l_shipdate AS block_time, p_brand AS nft_contract_address,
  CAST(l_partkey AS VARCHAR) AS token_id, hash AS tx_hash, {addr('l_suppkey')} AS tx_from, {addr('receiver')} AS tx_to,
  l_extendedprice AS amount_usd, l_extendedprice * l_tax AS platform_fee_amount_usd,
  l_extendedprice * l_discount AS royalty_fee_amount_usd
FROM ol WHERE CAST(l_shipdate AS DATE) <= {ORDER_DAY}"""),
        "a12_contracts": f"""
SELECT address, lower(address) AS name, namespace, '{ACCOUNT}' AS "from" FROM (
  SELECT DISTINCT event_type AS address, 'event' AS namespace FROM events
  UNION ALL SELECT DISTINCT p_brand, 'part' FROM part
  UNION ALL SELECT DISTINCT o_orderpriority, 'order' FROM orders
  UNION ALL SELECT n_name, 'nation' FROM nation)""",
    }
    oracle["r03_on_day"] = f"SELECT * FROM ({oracle['r03_balance']}) WHERE date = DATE '2024-01-10'"
    oracle["r20_wealth_gap_balance_poor"] = q(EV, TOP_BAL, "SELECT * FROM top")
    for name, columns in WIDE.items():
        oracle[f"{name}_wide"] = rounded(oracle[name], columns)
    del oracle["r20_wealth_gap_balance_poor"]
    oracle["r40_cohort_token_class_wide"] = rounded(
        oracle["r40_cohort_token_class_click"], ("token_balance_usd_min", "token_balance_usd_max"))
    for name in ("r08_overlap_eth", "r15_other_coins_eth", "r42_cohort_eth_class"):
        oracle[f"{name}_earlier"] = earlier(oracle[name])
    return oracle


#: Reports that are also asked over wide amounts, and their columns of doubles.
WIDE = {
    "r03_balance": ("balance_token",),
    "r06_supply_mint_burn": ("total_supply", "total_mint", "total_burn"),
    "r06_supply_mint_burn_sparse": ("total_supply", "total_mint", "total_burn"),
    "r10_avg_purchase_price": ("balance_token", "avg_purchase_price_usd"),
    "r11_current_holders": (), "r12_new_holders_daily": (),
    "r16_other_coins_erc20": ("balance_token", "balance_usd"), "r18_wealth_gap_txs": (),
    "r20_wealth_gap_balance": ("balance_token",), "r20_wealth_gap_balance_poor": ("balance_token",),
    "r22_wealth_gap_volume": ("tx_volume_token",), "r28_marketcap": ("marketcap",),
    "r30_volume": ("volume_token", "volume_usd"),
}


def rounded(statement, columns, places=6):
    """The statement with its doubles rounded; an amount n (10^36 + 10^18) of 36 more decimals is n but for the last digit."""
    if not columns:
        return statement
    replaced = ", ".join(f"round({c}, {places}) AS {c}" for c in columns)
    return f"SELECT * REPLACE ({replaced}) FROM ({statement})"


def earlier(statement):
    """The statement over the events up to 15 January 2024; users keep their numbers."""
    cut = "WHERE ts < TIMESTAMP '2024-01-16 00:00:00'"
    for whole, part in ((EVENTS_READ, f"{EVENTS_READ} {cut}"), (PRICES_READ, f"{PRICES_READ} AND {cut[6:]}")):
        if statement.count(whole) != 1:
            raise ValueError(f"expected {whole!r} once")
        statement = statement.replace(whole, part)
    return statement
