"""Line and file rules over source text: frames, scopes, blocks, pattern flags."""

from __future__ import annotations

import re
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Flags and their patterns; (?i) where case does not matter.
PATTERNS = (
    ("ORACLE", r"(?i)oracle|latestRoundData|TWAP|chainlink|priceFeed|getPrice"),
    ("RANDOMNESS_WEAK", r"(?i)keccak256.*block|prevrandao|block\.timestamp.*random|block\.difficulty"),
    ("RANDOMNESS_VRF", r"(?i)VRF|entropy|requestRandom|fulfillRandom|IEntropy"),
    ("FLASH_LOAN", r"flashLoan|flash\s*loan|onFlashLoan|executeOperation|flashCallback"),
    ("DEX_INTERACTION", r"IUniswap|IBalancer|swap.*token|addLiquidity|removeLiquidity|getReserves"),
    ("BALANCE_DEPENDENT", r"balanceOf\s*\(\s*address\s*\(\s*this\s*\)|\.balance\b"),
    ("ERC4626", r"ERC4626|deposit.*shares|withdraw.*assets|convertToShares|convertToAssets"),
    ("MULTI_TOKEN", r"ERC1155|ERC6909|onERC1155Received"),
    ("SEMI_TRUSTED_ROLE", r"onlyBot|onlyOperator|onlyKeeper|BOT_ROLE|KEEPER_ROLE|OPERATOR_ROLE"),
    ("PROXY_UPGRADEABLE", r"proxy|upgradeable|Initializable|reinitializ|delegatecall"),
    ("CROSS_CHAIN", r"(?i)bridge|L1|L2|lzReceive|ccipReceive|crossChain|messenger"),
    ("TEMPORAL", r"block\.timestamp|interval|epoch|period|duration|deadline"),
    ("HAS_SIGNATURES", r"ecrecover|ECDSA\.recover|isValidSignature|EIP712|permit\("),
    ("STAKING", r"(?i)stake|unstake|delegation|validator|claimReward|compound"),
    ("GOVERNANCE", r"vote|propose|timelock|quorum|Governor"),
    ("MIXED_DECIMALS", r"mulDiv|mulWad|divWad|1e6|1e8|1e18|decimals\(\)|10\s*\*\*"),
    ("CALLBACK", r"onERC721Received|onERC1155Received|tokensReceived|beforeSwap|afterSwap"),
    ("LOW_LEVEL_CALL", r"\.call\{|\.call\(|\.delegatecall\(|assembly\s*\{"),
    ("REENTRANCY_GUARD", r"nonReentrant|ReentrancyGuard|_status|_locked"),
    ("SHARE_ALLOCATION", r"shares|allocation|distribute|pro.rata|proportional|vest"),
    ("MIGRATION", r"reinitializer|V2|V3|_deprecated|migrat|upgrade|legacy"),
    ("LENDING", r"(?i)borrow|lend|collateral|liquidat|healthFactor|LTV"),
    ("LOTTERY", r"(?i)lottery|jackpot|raffle|drawing|winner|ticket|prize"),
)


def _occurs(text: Column, low: Column, pattern: str) -> Column:
    """Whether a pattern of plain alternatives occurs. Words that an alternative needs are looked for first, which is
    much cheaper than matching and rules most texts out."""
    fold = pattern.startswith("(?i)")
    found = None
    for alt in pattern.removeprefix("(?i)").split("|"):
        words = re.findall("[A-Za-z0-9_]+", re.sub(r"\\[a-z]", " ", alt))
        hit = reduce(lambda x, y: x & y, [low.contains(w.lower()) if fold else text.contains(w) for w in words])
        if fold or words != [alt]:
            hit &= text.rlike(("(?i)" if fold else "") + alt)
        found = hit if found is None else found | hit
    return found


def pattern_flags(text: Column, low: Column) -> Column:
    """All flags whose pattern occurs in a text, given with its lower case, as one array."""
    none = F.lit(None).cast("string")
    return F.array_compact(F.array(*(F.when(_occurs(text, low, p), F.lit(f)).otherwise(none) for f, p in PATTERNS)))


def frame_flag(lines: DataFrame, group: str, order: str, cond: Column, lo: int, hi: int) -> DataFrame:
    """Adds `hit`: whether cond holds for any line of the frame lo..hi around each."""
    return lines.withColumn("hit", F.coalesce(F.bool_or(cond).over(Window.partitionBy(group).orderBy(order).rowsBetween(lo, hi)), F.lit(False)))


def scope(lines: DataFrame, group: str, order: str, starts: Column, name: Column) -> DataFrame:
    """Adds `scope`, the name of the last start at or before each line, and its number `scope_no`."""
    w = Window.partitionBy(group).orderBy(order).rowsBetween(Window.unboundedPreceding, 0)
    return lines.withColumns({"scope": F.last(F.when(starts, name), ignorenulls=True).over(w), "scope_no": F.count_if(starts).over(w)})


def sticky(lines: DataFrame, group: list[str], order: str, cond: Column) -> DataFrame:
    """Adds `sticky`: whether cond held on this line or on an earlier one of the group."""
    w = Window.partitionBy(*group).orderBy(order).rowsBetween(Window.unboundedPreceding, 0)
    return lines.withColumn("sticky", F.coalesce(F.bool_or(cond).over(w), F.lit(False)))


def running_depth(lines: DataFrame, group: str, order: str, line: str, opens: str = "(", closes: str = ")") -> DataFrame:
    """Adds `depth`: openings less closings up to each line."""
    n = lambda c: F.length(line) - F.length(F.replace(F.col(line), F.lit(c), F.lit("")))
    w = Window.partitionBy(group).orderBy(order).rowsBetween(Window.unboundedPreceding, 0)
    return lines.withColumn("depth", F.sum(n(opens) - n(closes)).over(w))


def block_end(lines: DataFrame, group: str, order: str, line: str, opens: str = "(", closes: str = ")") -> DataFrame:
    """(group, end): the first line with depth 0 or less after it was above 0."""
    depth = running_depth(lines, group, order, line, opens, closes)
    w = Window.partitionBy(group).orderBy(order).rowsBetween(Window.unboundedPreceding, 0)
    seen = depth.withColumn("seen", F.max("depth").over(w) > 0)
    return seen.filter("seen and depth <= 0").groupBy(group).agg(F.min(order).alias("end"))
