"""Selections over the code graph by the words in names, and the rules that decide which selections run."""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .graph import kind

#: Words that the selections look for in lower-case names.
WORDS = {
    "oracle": "oracle price feed twap chainlink pyth uniswap entropy random vrf seed nonce reveal commit callback request provider calculator resolver".split(),
    "oracle_setter": "oracle entropy provider calculator payout feed".split(),
    "financial": "balance total pool cap share deposit withdraw reserve fee earnings reward stake supply debt credit price accumulated accumulator payout vault treasury".split(),
    "cap": "cap limit max min ceiling floor".split(),
    "settlement": "settle process distribute batch finalize draw claim withdraw deposit transfer callback".split(),
    "pool": "pool total accumulator balance lp".split(),
    "fee": "fee tax commission deduct charge cost compute_fee computefee _computefees collectfee protocol_fee protocolFee take_fee".split(),
    "rate": "rate reward amount distribute campaign override minimum min_amount minAmount".split(),
    "override": "override update set change modify amend adjust configure".split(),
    "duration": "duration period epoch window timestamp start end expire".split(),
    "callback": "onclaim onreceive onflashloan tokensfallback tokensreceived onerc721received onerc1155received onerc1155batchreceived uniswapv2call uniswapv3swapcallback pancakeswapv2call execute callbackfunction".split(),
    "loop": "batch loop multi bulk all claim".split(),
    "payout": "claim distribute payout withdraw redeem".split(),
    "metatx": "_msgsender msgsender trustedforwarder istrustedforwarder isforwarder forwarder erc2771 opengsn biconomy gelato relayer metatransaction meta_transaction".split(),
    "multicall": "multicall batch aggregate execute dispatch delegatecall multisend".split(),
    "state": "status state phase stage lifecycle mode paused frozen halted active settled closed pending cancelled expired".split(),
    "temporal": "timestamp deadline expiry epoch window start end period duration cooldown lockup".split(),
    "transition": "settle cancel close activate pause unpause finalize complete expire redeem claim withdraw override update transition".split(),
    "exit": "claim claimreward withdraw redeem collect".split(),
    "proxy": "initialize upgrade".split(),
    "crypto": "sign permit verify recover ecrecover hash".split(),
    "math": "mint deposit withdraw redeem swap stake claim reward fee".split(),
    "crosschain": "lzreceive nonblockinglzreceive execute sgreceive ccipreceive".split(),
    "periphery": "helper util lib math safe base abstract common shared encoder decoder converter".split(),
    "marker": "override amended updated effective snapshot base original".split(),
    "marker_backup": "override amended updated effective snapshot base original backup".split(),
}
#: Interfaces with known risks.
RISKS = {
    "IPool": ("aave", "lending pool", "supply", "borrow", "withdraw"),
    "IAavePool": ("aave", "lending pool"),
    "ILendingPool": ("aave", "lending"),
    "IStETH": ("steth", "rebasing token", "shares"),
    "IWStETH": ("wsteth", "steth wrapper", "shares vs balance"),
    "IWETH": ("weth", "wrap", "unwrap"),
    "IUniswapV2Router": ("uniswap", "swap", "slippage", "deadline"),
    "IUniswapV3Pool": ("uniswap v3", "tick", "liquidity", "sqrt price"),
    "ISwapRouter": ("uniswap v3", "swap", "slippage"),
    "ICurvePool": ("curve", "stableswap", "slippage"),
    "IBalancerVault": ("balancer", "flash loan", "swap"),
    "IChainlinkAggregator": ("chainlink", "oracle", "stale price", "round"),
    "AggregatorV3Interface": ("chainlink", "oracle", "stale price"),
    "IERC20": ("erc20", "fee-on-transfer", "approval"),
    "IERC4626": ("erc4626", "vault", "shares", "assets"),
    "IRewardsController": ("aave rewards", "claim"),
    "IPoolDataProvider": ("aave data", "reserve"),
}
INTERFACE = r"\bI[A-Z][A-Za-z0-9]+\b"
#: What always runs, what flags and protocol types add, and the contracts that the periphery needs.
ALWAYS = ("reasoning", "structural", "vector_scan")
FLAG_AGENTS = {
    "economic": "ORACLE FLASH_LOAN DEX_INTERACTION LENDING BALANCE_DEPENDENT STAKING ERC4626 MIXED_DECIMALS SHARE_ALLOCATION GOVERNANCE LOTTERY RANDOMNESS_WEAK RANDOMNESS_VRF".split(),
    "execution_trace": "PROXY_UPGRADEABLE CROSS_CHAIN CALLBACK TEMPORAL HAS_SIGNATURES MIGRATION LOW_LEVEL_CALL MULTI_TOKEN GOVERNANCE".split(),
}
NO_AGENT_FLAGS = ("REENTRANCY_GUARD", "SEMI_TRUSTED_ROLE")
PROTOCOL_AGENTS = {
    "economic": "lending dex amm vault bridge staking governance lottery".split(),
    "execution_trace": "bridge governance nft".split(),
}
PERIPHERY_MIN = 5
#: Which hunters' findings call for a second pass of which others.
INTERACTIONS = {
    "ExternalCallHunter": ("ReentrancyHunter", "AccessControlHunter", "AccountingHunter"),
    "AccountingHunter": ("ExternalCallHunter", "GovernanceHunter", "OracleHunter", "GasDoSHunter"),
    "AccessControlHunter": ("GovernanceHunter", "ExternalCallHunter"),
    "ReentrancyHunter": ("ExternalCallHunter", "AccountingHunter"),
    "OracleHunter": ("AccountingHunter", "GovernanceHunter"),
    "GovernanceHunter": ("AccessControlHunter", "AccountingHunter", "OracleHunter"),
    "GasDoSHunter": ("AccountingHunter", "GovernanceHunter"),
}


def has_word(name: Column | str, words: str) -> Column:
    """Whether a word of the named group occurs in the lower-case name."""
    return F.lower(name).rlike("|".join(re.escape(w) for w in WORDS[words]))


def touching(edges: DataFrame, variables: DataFrame, *types: str) -> DataFrame:
    """(id, var): functions with an edge of one of the types to one of the variables."""
    return edges.filter(F.col("type").isin(*types)).join(variables.select(F.col("id").alias("dst")), "dst", "left_semi").select(F.col("src").alias("id"), F.col("dst").alias("var"))


def parts(rows: DataFrame, **conditions: Column) -> DataFrame:
    """(id, part): one row for each named condition that a row meets."""
    held = F.array_compact(F.array(*(F.when(c, F.lit(n)) for n, c in conditions.items())))
    return rows.select("id", F.explode(held).alias("part"))


def oracle(functions: DataFrame, variables: DataFrame, edges: DataFrame) -> DataFrame:
    """Functions that read or write a variable of an oracle, by name or type, or are named like one or like its setter."""
    own = variables.filter(has_word("name", "oracle") | has_word("var_type", "oracle"))
    setter = F.lower("name").startswith("set") & has_word("name", "oracle_setter")
    named = functions.filter(has_word("name", "oracle") | setter).select("id")
    return touching(edges, own, "READS", "WRITES").select("id").union(named).distinct()


def financial(variables: DataFrame) -> DataFrame:
    return variables.filter(has_word("name", "financial") & ~F.col("is_constant"))


def accounting(variables: DataFrame, edges: DataFrame) -> DataFrame:
    """(id, n_vars): functions that write financial variables, and how many."""
    return touching(edges, financial(variables), "WRITES").groupBy("id").agg(F.count_distinct("var").alias("n_vars"))


def accounting_priority(functions: DataFrame, variables: DataFrame, edges: DataFrame) -> DataFrame:
    """(id, priority) of those writers: their variables, 5 for a settlement, 10 for pool writers that touch no cap, less 20 for constructors."""
    money = financial(variables)
    writes = touching(edges, money, "WRITES")
    pools = money.filter(has_word("name", "pool")).select(F.col("id").alias("var"), F.lit(1).alias("pool"))
    seen = touching(edges, money.filter(has_word("name", "cap")), "READS", "WRITES").select("id").distinct().withColumn("capped", F.lit(True))
    own = writes.join(pools, "var", "left").groupBy("id").agg(F.count_distinct("var").alias("n"), F.max("pool").alias("pool"))
    rows = functions.select("id", "name").join(own, "id").join(seen, "id", "left")
    score = F.col("n") + F.when(has_word("name", "settlement"), 5).otherwise(0) + F.when(F.col("pool").isNotNull() & F.col("capped").isNull(), 10).otherwise(0) - F.when(F.lower("name") == "constructor", 20).otherwise(0)
    return rows.select("id", score.cast("long").alias("priority"))


def caps_with_others(variables: DataFrame) -> DataFrame:
    """(cap, var): each cap and the other financial variables of its contract."""
    money = financial(variables)
    caps = money.filter(has_word("name", "cap")).select("contract", F.col("id").alias("cap"))
    return caps.join(money.select("contract", F.col("id").alias("var")), "contract").filter("cap <> var").select("cap", "var")


def dual_records(variables: DataFrame, markers: str = "marker") -> DataFrame:
    """(contract, marked, plain): contracts with mappings of which one has a marker word in its name and one has none."""
    marked = has_word("name", markers)
    maps = variables.filter(F.col("var_type").startswith("mapping"))
    return maps.groupBy("contract").agg(F.count_if(marked).alias("marked"), F.count_if(~marked).alias("plain")).filter("marked >= 1 and plain >= 1")


def integration(spark, variables: DataFrame) -> DataFrame:
    """(interface, n_sites, risks): interfaces among the types of variables, with the risks known of them."""
    found = F.regexp_extract("var_type", INTERFACE, 0)
    sites = variables.select(found.alias("interface"), "contract", "name").filter("interface <> ''").distinct()
    known = spark.createDataFrame([(k, ", ".join(v)) for k, v in RISKS.items()], "interface string, risks string")
    return sites.groupBy("interface").agg(F.count("*").alias("n_sites")).join(F.broadcast(known), "interface", "left")


def periphery(functions: DataFrame, contracts: DataFrame) -> DataFrame:
    """(contract, n): libraries, contracts with five functions or fewer, and such by name; interfaces never. Where there
    are none, the smaller half (one at least), by number of functions and name."""
    n = functions.groupBy(F.col("contract").alias("name")).agg(F.count("*").alias("n"))
    rows = contracts.filter("not is_interface").join(n, "name", "left").withColumn("n", F.coalesce("n", F.lit(0)).cast("long"))
    own = rows.withColumn("side", F.col("is_library") | (F.col("n") <= 5) | has_word("name", "periphery"))
    every = Window.partitionBy()  # contracts of one audit: a short list
    own = own.withColumns({"some": F.bool_or("side").over(every), "m": F.count("*").over(every), "rk": F.row_number().over(Window.orderBy("n", "name"))})
    return own.filter(F.when(F.col("some"), F.col("side")).otherwise(F.col("rk") <= F.greatest(F.lit(1), F.floor(F.col("m") / 2)))).select(F.col("name").alias("contract"), "n")


def agent_rows() -> list[tuple[str, str, str]]:
    """(what, value, agent) of flags and protocol types."""
    own = (("flag", FLAG_AGENTS), ("protocol", PROTOCOL_AGENTS))
    return [(what, v, agent) for what, table in own for agent, values in table.items() for v in values]


def route(facts: DataFrame) -> DataFrame:
    """(audit, agents) of facts (audit, flags, protocol, n_contracts, has_calls): sorted names of what is to run."""
    spark = facts.sparkSession
    table = F.broadcast(spark.createDataFrame(agent_rows(), "what string, value string, agent string"))
    told = facts.select("audit", F.explode(F.concat(F.transform("flags", lambda f: F.struct(F.lit("flag").alias("what"), f.alias("value"))), F.array(F.struct(F.lit("protocol").alias("what"), F.lower(F.trim("protocol")).alias("value"))))).alias("x")).select("audit", "x.*")
    found = told.join(table, ["what", "value"]).groupBy("audit").agg(F.collect_set("agent").alias("found"))
    extra = F.array_compact(F.array(*map(F.lit, ALWAYS), F.when(F.col("n_contracts") >= PERIPHERY_MIN, "periphery"), F.when(F.col("has_calls"), "economic")))
    agents = F.array_sort(F.array_union(F.coalesce("found", F.array().cast("array<string>")), extra))
    return facts.join(found, "audit", "left").select("audit", agents.alias("agents"))


def second_pass(active: DataFrame, labels: DataFrame) -> DataFrame:
    """(audit, label): hunters, by label, that run again: one with findings or in its interactions contains the label's
    letters, or the other way round. active: (audit, hunter); labels: (label), a short list."""
    spark = active.sparkSession
    links = spark.createDataFrame([(k, x) for k, v in INTERACTIONS.items() for x in (k, *v)], "hunter string, again string")
    again = active.distinct().join(F.broadcast(links), "hunter", "left").select("audit", F.coalesce("again", "hunter").alias("again")).distinct()
    name = F.replace(F.lower("again"), F.lit("hunter"), F.lit(""))
    word = F.regexp_replace(F.lower(F.regexp_replace("label", r"^[^\p{L}]+", "")), "[/ ]", "")
    small = labels.select("label", word.alias("word"))
    met = again.withColumn("name", name).join(F.broadcast(small), F.col("name").contains(F.col("word")) | F.col("word").contains(F.col("name")))
    return met.select("audit", "label").distinct()


def call_targets(edges: DataFrame) -> DataFrame:
    return edges.filter(kind("EXTERNAL_CALL"))
