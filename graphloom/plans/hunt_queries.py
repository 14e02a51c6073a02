"""Selections by name over the code graph, and the rules that choose among them. The SQL has its own word lists."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators import graph as G
from ..operators import hunts as H
from .registry import query
from .views import Views, pick, sql_pick

_ORACLE = "oracle|price|feed|twap|chainlink|pyth|uniswap|entropy|random|vrf|seed|nonce|reveal|commit|callback|request|provider|calculator|resolver"
_MONEY = "balance|total|pool|cap|share|deposit|withdraw|reserve|fee|earnings|reward|stake|supply|debt|credit|price|accumulated|accumulator|payout|vault|treasury"
_CAP = "cap|limit|max|min|ceiling|floor"
_FINANCIAL = f"money AS (SELECT * FROM named_variables WHERE regexp_matches(lower(name), '{_MONEY}') AND NOT is_constant)"


def _has(words: str, column: str = "name") -> str:
    return f"regexp_matches(lower({column}), '{words}')"


@query(
    "sel_oracle",
    "named_functions named_variables edges",
    f"SELECT DISTINCT e.src AS id FROM edges e JOIN named_variables v ON v.id = e.dst AND ({_has(_ORACLE)} OR {_has(_ORACLE, 'var_type')}) WHERE e.type IN ('READS', 'WRITES') UNION SELECT id FROM named_functions WHERE {_has(_ORACLE)} OR (starts_with(lower(name), 'set') AND {_has('oracle|entropy|provider|calculator|payout|feed')})",
)
def sel_oracle(v: Views) -> DataFrame:
    return H.oracle(v.named_functions, v.named_variables, v.edges)


@query(
    "sel_accounting",
    "named_variables edges",
    f"WITH {_FINANCIAL} SELECT e.src AS id, count(DISTINCT m.id) AS n_vars FROM money m JOIN edges e ON e.dst = m.id AND e.type = 'WRITES' GROUP BY 1",
)
def sel_accounting(v: Views) -> DataFrame:
    return H.accounting(v.named_variables, v.edges)


@query(
    "priority_score",
    "named_functions named_variables edges",
    f"""WITH {_FINANCIAL}, w AS (SELECT e.src, count(DISTINCT m.id) AS n, bool_or({_has('pool|total|accumulator|balance|lp', 'm.name')}) AS pool FROM money m JOIN edges e ON e.dst = m.id AND e.type = 'WRITES' GROUP BY 1),
    seen AS (SELECT DISTINCT e.src FROM money m JOIN edges e ON e.dst = m.id AND e.type IN ('READS', 'WRITES') WHERE {_has(_CAP, 'm.name')})
    SELECT f.id, CAST(n + CASE WHEN {_has('settle|process|distribute|batch|finalize|draw|claim|withdraw|deposit|transfer|callback', 'f.name')} THEN 5 ELSE 0 END + CASE WHEN pool AND seen.src IS NULL THEN 10 ELSE 0 END - CASE WHEN lower(f.name) = 'constructor' THEN 20 ELSE 0 END AS BIGINT) AS priority
    FROM named_functions f JOIN w ON w.src = f.id LEFT JOIN seen ON seen.src = f.id""",
)
def priority_score(v: Views) -> DataFrame:
    return H.accounting_priority(v.named_functions, v.named_variables, v.edges)


@query(
    "cap_unchecked_writers",
    "named_variables edges",
    f"""WITH {_FINANCIAL} SELECT DISTINCT c.id AS cap, w.src AS fn FROM money c JOIN money x ON x.contract = c.contract AND x.id <> c.id JOIN edges w ON w.dst = x.id AND w.type = 'WRITES'
    WHERE {_has(_CAP, 'c.name')} AND NOT EXISTS (SELECT 1 FROM edges r WHERE r.dst = c.id AND r.src = w.src AND r.type IN ('READS', 'WRITES'))""",
)
def cap_unchecked_writers(v: Views) -> DataFrame:
    return G.cap_unchecked_writers(v.edges.filter(G.kind("WRITES")), v.edges.filter(G.kind("READS") | G.kind("WRITES")), H.caps_with_others(v.named_variables))


_DUAL = "SELECT contract, count(*) FILTER ({0}) AS marked, count(*) FILTER (NOT {0}) AS plain FROM named_variables WHERE starts_with(var_type, 'mapping') GROUP BY 1 HAVING marked >= 1 AND plain >= 1"


@query("dual_record", "named_variables", _DUAL.format(_has("override|amended|updated|effective|snapshot|base|original")))
def dual_record(v: Views) -> DataFrame:
    return H.dual_records(v.named_variables)


@query("dual_record_backup", "named_variables", _DUAL.format(_has("override|amended|updated|effective|snapshot|base|original|backup")))
def dual_record_backup(v: Views) -> DataFrame:
    return H.dual_records(v.named_variables, "marker_backup")


def _parts_sql(table: str, **conditions: str) -> str:
    return " UNION ALL ".join(f"SELECT id, '{n}' AS part FROM {table} WHERE {c}" for n, c in conditions.items())


_FEE = "fee|tax|commission|deduct|charge|cost|compute_fee|computefee|_computefees|collectfee|protocol_fee|protocolFee|take_fee"
_RATE = "rate|reward|amount|distribute|campaign|override|minimum|min_amount|minAmount"


@query("sel_fee", "named_functions", _parts_sql("named_functions", fee=_has(_FEE), rate=_has(_RATE), override=f"{_has('override|update|set|change|modify|amend|adjust|configure')} AND {_has('duration|period|epoch|window|timestamp|start|end|expire')}"))
def sel_fee(v: Views) -> DataFrame:
    return H.parts(v.named_functions, fee=H.has_word("name", "fee"), rate=H.has_word("name", "rate"), override=H.has_word("name", "override") & H.has_word("name", "duration"))


_CALLBACK = "onclaim|onreceive|onflashloan|tokensfallback|tokensreceived|onerc721received|onerc1155received|onerc1155batchreceived|uniswapv2call|uniswapv3swapcallback|pancakeswapv2call|execute|callbackfunction"


@query("sel_callback", "named_functions", _parts_sql("named_functions", callback=_has(_CALLBACK), loop=_has("batch|loop|multi|bulk|all|claim"), payout=_has("claim|distribute|payout|withdraw|redeem")))
def sel_callback(v: Views) -> DataFrame:
    return H.parts(v.named_functions, **{w: H.has_word("name", w) for w in ("callback", "loop", "payout")})


@query(
    "sel_metatx",
    "named_functions",
    _parts_sql("named_functions", metatx=_has("_msgsender|msgsender|trustedforwarder|istrustedforwarder|isforwarder|forwarder|erc2771|opengsn|biconomy|gelato|relayer|metatransaction|meta_transaction"), multicall=_has("multicall|batch|aggregate|execute|dispatch|delegatecall|multisend"), setter="regexp_matches(lower(name), 'forwarder|trusted') AND regexp_matches(lower(name), 'set|update|change')"),
)
def sel_metatx(v: Views) -> DataFrame:
    low = F.lower("name")
    return H.parts(v.named_functions, metatx=H.has_word("name", "metatx"), multicall=H.has_word("name", "multicall"), setter=low.rlike("forwarder|trusted") & low.rlike("set|update|change"))


@query(
    "sel_statemachine",
    "named_functions named_variables",
    _parts_sql("named_functions", transition=_has("settle|cancel|close|activate|pause|unpause|finalize|complete|expire|redeem|claim|withdraw|override|update|transition"), exit=_has("claim|claimreward|withdraw|redeem|collect"), pause=_has("pause"))
    + " UNION ALL "
    + _parts_sql("named_variables", state=f"({_has('status|state|phase|stage|lifecycle|mode|paused|frozen|halted|active|settled|closed|pending|cancelled|expired')} OR contains(lower(var_type), 'enum'))", temporal=_has("timestamp|deadline|expiry|epoch|window|start|end|period|duration|cooldown|lockup")),
)
def sel_statemachine(v: Views) -> DataFrame:
    own = H.parts(v.named_functions, transition=H.has_word("name", "transition"), exit=H.has_word("name", "exit"), pause=F.lower("name").contains("pause"))
    held = H.parts(v.named_variables, state=H.has_word("name", "state") | F.lower("var_type").contains("enum"), temporal=H.has_word("name", "temporal"))
    return own.union(held)


@query("sel_integration", "named_variables", "SELECT interface, count(*) AS n_sites, any_value(CASE interface WHEN 'IPool' THEN 'aave, lending pool, supply, borrow, withdraw' WHEN 'IERC20' THEN 'erc20, fee-on-transfer, approval' END) AS risks FROM (SELECT DISTINCT regexp_extract(var_type, '\\bI[A-Z][A-Za-z0-9]+\\b', 0) AS interface, contract, name FROM named_variables) WHERE interface <> '' GROUP BY 1")
def sel_integration(v: Views) -> DataFrame:
    return H.integration(v.spark, v.named_variables)


_SIDE_NAMES = ("Core", "MathLib", "Vault", "SafeBase", "Pool", "Encoder", "Router")


@query(
    "sel_periphery",
    "functions contracts",
    f"""WITH c AS (SELECT {sql_pick('ord', _SIDE_NAMES)} || ord AS name, is_interface, is_library, name AS own FROM contracts), n AS (SELECT c.name, is_library, count(f.id) AS n FROM c LEFT JOIN functions f ON f.contract = c.own WHERE NOT is_interface GROUP BY 1, 2)
    SELECT name AS contract, n FROM n WHERE is_library OR n <= 5 OR {_has('helper|util|lib|math|safe|base|abstract|common|shared|encoder|decoder|converter')}""",
)
def sel_periphery(v: Views) -> DataFrame:
    new = F.concat(pick(F.col("ord"), _SIDE_NAMES), F.col("ord").cast("string"))
    names = v.contracts.select(F.col("name").alias("contract"), new.alias("new"))
    return H.periphery(v.functions.join(names, "contract").withColumn("contract", F.col("new")), v.contracts.withColumn("name", new))


_TARGETS = ("ecrecover", "ECDSA.recover", "vault", "router", "pool")


@query("sel_crypto", "named_functions edges", f"SELECT id FROM named_functions WHERE {_has('sign|permit|verify|recover|ecrecover|hash')} UNION SELECT src FROM (SELECT src, {sql_pick('CAST(substr(dst, 5) AS INT)', _TARGETS)} AS target FROM edges WHERE type = 'EXTERNAL_CALL') WHERE regexp_matches(lower(target), 'ecrecover|ecdsa')")
def sel_crypto(v: Views) -> DataFrame:
    called = H.call_targets(v.edges).select("src", pick(F.substring("dst", 5, 9).cast("int"), _TARGETS).alias("target"))
    return v.named_functions.filter(H.has_word("name", "crypto")).select("id").union(called.filter(F.lower("target").rlike("ecrecover|ecdsa")).select("src")).distinct()


@query("sel_proxy", "named_functions edges", f"SELECT id FROM named_functions WHERE {_has('initialize|upgrade')} UNION SELECT src FROM edges WHERE type = 'EXTERNAL_CALL' AND CAST(substr(dst, 5) AS INT) % 9 = 0")
def sel_proxy(v: Views) -> DataFrame:
    """One external target in nine is called by delegatecall."""
    called = H.call_targets(v.edges).withColumn("call_type", F.when(F.substring("dst", 5, 9).cast("int") % 9 == 0, "delegatecall").otherwise("call"))
    return v.named_functions.filter(H.has_word("name", "proxy")).select("id").union(called.filter("call_type = 'delegatecall'").select("src")).distinct()


@query("sel_math", "named_functions edges", f"SELECT id FROM named_functions WHERE {_has('mint|deposit|withdraw|redeem|swap|stake|claim|reward|fee')} UNION SELECT src FROM edges WHERE type = 'TOKEN_FLOW'")
def sel_math(v: Views) -> DataFrame:
    return v.named_functions.filter(H.has_word("name", "math")).select("id").union(v.edges.filter(G.kind("TOKEN_FLOW")).select("src")).distinct()


@query("sel_crosschain", "named_functions", f"SELECT id FROM named_functions WHERE {_has('lzreceive|nonblockinglzreceive|execute|sgreceive|ccipreceive')}")
def sel_crosschain(v: Views) -> DataFrame:
    return v.named_functions.filter(H.has_word("name", "crosschain")).select("id")


@query("risk_dictionary_join", sql=f"SELECT p_partkey AS id, CASE iface WHEN 'IPool' THEN 5 WHEN 'IWETH' THEN 3 WHEN 'ICurvePool' THEN 3 WHEN 'AggregatorV3Interface' THEN 3 ELSE 0 END AS n_risks FROM (SELECT p_partkey, {sql_pick('p_partkey', ('IPool', 'IWETH', 'IUnknown', 'ICurvePool', 'AggregatorV3Interface'))} AS iface FROM part)")
def risk_dictionary_join(v: Views) -> DataFrame:
    own = v.table("part").select(F.col("p_partkey").alias("id"), pick(F.col("p_partkey"), ("IPool", "IWETH", "IUnknown", "ICurvePool", "AggregatorV3Interface")).alias("iface"))
    known = v.spark.createDataFrame([(k, len(r)) for k, r in H.RISKS.items()], "iface string, n int")
    return own.join(F.broadcast(known), "iface", "left").select("id", F.coalesce("n", F.lit(0)).alias("n_risks"))


_FLAGS = ("ORACLE", "CALLBACK", "GOVERNANCE", "REENTRANCY_GUARD", "LOTTERY", "MULTI_TOKEN", "SEMI_TRUSTED_ROLE", "NO_SUCH_FLAG", "STAKING", "MIGRATION", "ERC4626", "TEMPORAL")
_PROTOCOLS = (" Lending", "nft", "bridge", "unknown", "dao", "Governance", "amm")
_FACTS = f"""facts AS (SELECT s_suppkey AS audit, list_transform(range(0, s_suppkey % 3), lambda i: CASE (s_suppkey * 5 + i) % 12 {' '.join(f"WHEN {i} THEN '{x}'" for i, x in enumerate(_FLAGS))} END) AS flags,
    {sql_pick('s_suppkey', _PROTOCOLS)} AS protocol, s_nationkey AS n_contracts, s_suppkey % 4 = 0 AS has_calls FROM supplier)"""


@query(
    "route_agents",
    sql=f"""WITH {_FACTS}, a AS (SELECT audit, unnest(['reasoning', 'structural', 'vector_scan']) AS agent FROM facts
    UNION SELECT audit, 'periphery' FROM facts WHERE n_contracts >= 5 UNION SELECT audit, 'economic' FROM facts WHERE has_calls
    UNION SELECT audit, 'economic' FROM facts WHERE len(list_intersect(flags, ['ORACLE', 'FLASH_LOAN', 'DEX_INTERACTION', 'LENDING', 'BALANCE_DEPENDENT', 'STAKING', 'ERC4626', 'MIXED_DECIMALS', 'SHARE_ALLOCATION', 'GOVERNANCE', 'LOTTERY', 'RANDOMNESS_WEAK', 'RANDOMNESS_VRF'])) > 0
    UNION SELECT audit, 'execution_trace' FROM facts WHERE len(list_intersect(flags, ['PROXY_UPGRADEABLE', 'CROSS_CHAIN', 'CALLBACK', 'TEMPORAL', 'HAS_SIGNATURES', 'MIGRATION', 'LOW_LEVEL_CALL', 'MULTI_TOKEN', 'GOVERNANCE'])) > 0
    UNION SELECT audit, 'economic' FROM facts WHERE lower(trim(protocol)) IN ('lending', 'dex', 'amm', 'vault', 'bridge', 'staking', 'governance', 'lottery')
    UNION SELECT audit, 'execution_trace' FROM facts WHERE lower(trim(protocol)) IN ('bridge', 'governance', 'nft'))
    SELECT audit, string_agg(agent, ',' ORDER BY agent) AS agents FROM a GROUP BY 1""",
)
def route_agents(v: Views) -> DataFrame:
    s, k = v.table("supplier"), F.col("s_suppkey")
    flags = F.when(k % 3 > 0, F.transform(F.sequence(F.lit(0).cast("long"), F.greatest(k % 3 - 1, F.lit(0)).cast("long")), lambda i: F.element_at(F.array(*map(F.lit, _FLAGS)), ((k * 5 + i) % 12 + 1).cast("int")))).otherwise(F.array().cast("array<string>"))
    facts = s.select(k.alias("audit"), flags.alias("flags"), pick(k, _PROTOCOLS).alias("protocol"), F.col("s_nationkey").alias("n_contracts"), (k % 4 == 0).alias("has_calls"))
    return H.route(facts).select("audit", F.array_join("agents", ",").alias("agents"))


_LABELS = ("\U0001f513 AccessControl", "\U0001f3db Governance", "Gas/DoS", "Oracle", "Reentrancy", "External Call", "Accounting", "Proxy")
_HUNTERS = ("OracleHunter", "GasDoSHunter", "ReentrancyHunter", "ProxyHunter", "ExternalCallHunter")


@query(
    "substring_match_join",
    sql=f"""WITH act AS (SELECT DISTINCT o_custkey AS audit, {sql_pick('o_orderkey', _HUNTERS)} AS hunter FROM orders WHERE o_orderkey % 3 = 0),
    links(hunter, again) AS (VALUES ('ExternalCallHunter', 'ReentrancyHunter'), ('ExternalCallHunter', 'AccessControlHunter'), ('ExternalCallHunter', 'AccountingHunter'), ('ReentrancyHunter', 'ExternalCallHunter'), ('ReentrancyHunter', 'AccountingHunter'),
        ('OracleHunter', 'AccountingHunter'), ('OracleHunter', 'GovernanceHunter'), ('GasDoSHunter', 'AccountingHunter'), ('GasDoSHunter', 'GovernanceHunter')),
    again AS (SELECT audit, replace(lower(hunter), 'hunter', '') AS name FROM act UNION SELECT audit, replace(lower(again), 'hunter', '') FROM act JOIN links USING (hunter)),
    labels(label, word) AS (VALUES {', '.join(str((x, w)) for x, w in zip(_LABELS, ('accesscontrol', 'governance', 'gasdos', 'oracle', 'reentrancy', 'externalcall', 'accounting', 'proxy'), strict=True))})
    SELECT DISTINCT audit, label FROM again JOIN labels ON contains(name, word) OR contains(word, name)""",
)
def substring_match_join(v: Views) -> DataFrame:
    active = v.table("orders").filter("o_orderkey % 3 = 0").select(F.col("o_custkey").alias("audit"), pick(F.col("o_orderkey"), _HUNTERS).alias("hunter"))
    return H.second_pass(active, v.spark.createDataFrame([(x,) for x in _LABELS], "label string"))
