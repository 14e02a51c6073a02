"""Column functions over text: tokens, shingles, chunks, amounts, names, tags."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

BETWEEN_WORDS = r"[^\p{L}\p{N}_]+"

#: Words that mark a query as code, and the tag classes with their keywords.
CODE_WORDS = "function contract modifier mapping delegatecall assembly solidity reentrancy emit revert require uint address bytes".split()
TAG_CLASSES = {
    "reentrancy": ["reentrancy", "reentrant", "nonreentrant"],
    "oracle": ["oracle", "price", "twap", "chainlink", "flash_loan"],
    "accounting": ["accounting", "invariant", "balance", "share", "rounding"],
    "access_control": ["access_control", "onlyowner", "admin", "permission"],
    "gas_dos": ["gas", "dos", "loop", "unbounded"],
    "governance": ["governance", "timelock", "owner", "admin"],
    "external_call": ["external_call", "arbitrary_call", "delegatecall"],
}
#: The code-intent pattern.
CODE_INTENT = (
    r"(?i)\b(function|contract|mapping|address|uint|int\d*|bytes\d*|revert|require|emit|delegatecall|assembly|solidity|modifier|"
    r"receive\(\)|fallback\(\)|abi\.encode|msg\.sender|tx\.origin)\b"
)
#: Attack keywords in order of priority, with the tags that each gives.
ATTACKS = {
    "reentrancy": ["reentrancy", "callback", "CEI"],
    "flash loan": ["oracle", "flash_loan", "price_manipulation"],
    "price manipulation": ["oracle", "flash_loan", "defi_math"],
    "access control": ["access_control", "authorization"],
    "eip-2771": ["access_control", "meta_transaction", "eip2771"],
    "trusted forwarder": ["access_control", "meta_transaction", "eip2771"],
    "signature replay": ["cryptography", "signature_replay"],
    "oracle": ["oracle", "price_feed"],
    "governance": ["governance", "dao"],
    "proxy": ["proxy", "upgradeable"],
    "integer overflow": ["defi_math", "overflow"],
    "precision loss": ["defi_math", "precision"],
    "fee accounting": ["fee_accounting", "gross_net"],
    "state machine": ["state_machine", "toctou"],
    "bridge": ["cross_chain", "bridge"],
    "sandwich": ["mev", "sandwich", "frontrun"],
    "inflation": ["defi_math", "vault_inflation", "erc4626"],
    "donation": ["defi_math", "vault_inflation"],
}


def col(c: Column | str) -> Column:
    return F.col(c) if isinstance(c, str) else c


def tokens(text: Column | str) -> Column:
    """Lower-case words of letters, digits and underscores. Splitting is linear in the text."""
    return F.array_remove(F.split(F.lower(col(text)), BETWEEN_WORDS), "")


def n_words(text: Column | str) -> Column:
    """Number of words between white space."""
    return F.size(F.array_remove(F.split(col(text), r"\s+"), "")).cast("long")


def shingles(text: Column | str, k: int = 3) -> Column:
    """Distinct word k-shingles; a shorter text gives its distinct words."""
    return F.transform(
        F.array(tokens(text)),
        lambda w: F.when(F.size(w) < k, F.array_distinct(w)).otherwise(
            F.array_distinct(F.transform(F.sequence(F.lit(1), F.greatest(F.size(w) - (k - 1), F.lit(1))), lambda i: F.array_join(F.slice(w, i, k), " ")))
        ),
    )[0]


def jaccard(a: Column | str, b: Column | str) -> Column:
    """Share of common elements; 0 if either set is empty."""
    a, b = col(a), col(b)
    both = F.size(F.array_intersect(a, b))
    return F.when((F.size(a) == 0) | (F.size(b) == 0), F.lit(0.0)).otherwise(both / (F.size(a) + F.size(b) - both))


def chunk_starts(text: Column | str, size: int = 2000, overlap: int = 200) -> Column:
    """Starts (from 0) of fixed windows that overlap; the last one reaches the end."""
    step = size - overlap
    return F.sequence(F.lit(0), F.greatest(F.lit(0), F.ceil((F.length(col(text)) - size) / step).cast("int")) * step, F.lit(step))


def parse_amount(text: Column | str) -> Column:
    """US dollars of a text such as `$4.5M` or `500K USDC`; 0 where there is no number."""
    clean = F.replace(F.upper(col(text)), F.lit(","), F.lit(""))
    value = F.regexp_extract(clean, r"\$?([\d.]+)\s*([MKB])?", 1).try_cast("double")
    unit = F.regexp_extract(clean, r"\$?([\d.]+)\s*([MKB])?", 2)
    scale = F.when(unit == "M", 1e6).when(unit == "K", 1e3).when(unit == "B", 1e9).otherwise(1.0)
    return F.coalesce(value * scale, F.lit(0.0))


def parse_bounty(text: Column | str) -> Column:
    """Number of a bounty text without anything but digits and dots; 0 where there is none."""
    return F.coalesce(F.regexp_replace(col(text), r"[^\d.]", "").try_cast("double"), F.lit(0.0))


def slugify(text: Column | str) -> Column:
    """Anchor of a heading: lower case, other characters as single hyphens."""
    return F.regexp_replace(F.regexp_replace(F.lower(col(text)), r"[^a-z0-9]+", "-"), "^-+|-+$", "")


def safe_filename(day: Column | str, title: Column | str) -> Column:
    """File name of a report: day and at most 50 characters of its title."""
    kept = F.substring(F.regexp_replace(col(title), r"[^A-Za-z0-9 _-]", "_"), 1, 50)
    return F.concat(col(day), F.lit("_"), F.replace(F.lower(F.trim(kept)), F.lit(" "), F.lit("_")), F.lit(".md"))


def strip_leading(text: Column | str, chars: str) -> Column:
    """Without the leading characters of a set."""
    return F.ltrim(col(text), F.lit(chars))


def has_code(text: Column | str, variant: int = 1) -> Column:
    """Whether a text looks like source code, in three variants."""
    return col(text).rlike({1: r"function |mapping\(|require\(|uint\d+", 2: r"function |mapping\(|require\(|emit |\.sol", 3: r"function|mapping|require|solidity|\.sol"}[variant])


def looks_like_code(query: Column | str) -> Column:
    return col(query).rlike(CODE_INTENT)


def inferred_tags(query: Column | str) -> Column:
    """Keywords of every class of which one keyword occurs in the query, distinct, in class order."""
    q = F.lower(col(query))
    none = F.array().cast("array<string>")
    classes = [F.when(reduce(lambda a, b: a | b, [q.contains(k) for k in keys]), F.array(*map(F.lit, keys))).otherwise(none) for keys in TAG_CLASSES.values()]
    return F.array_distinct(F.concat(*classes))


def attack_tags(text: Column | str, base: tuple[str, ...] = ("incident", "real_world", "high_priority")) -> Column:
    """Struct of the first attack keyword found, and the distinct tags of all found after the base ones."""
    low = F.lower(col(text))
    none = F.array().cast("array<string>")
    tags = F.array_distinct(F.concat(F.array(*map(F.lit, base)), *(F.when(low.contains(k), F.array(*map(F.lit, v))).otherwise(none) for k, v in ATTACKS.items())))
    first = F.coalesce(*(F.when(low.contains(k), F.lit(k)) for k in ATTACKS), F.lit("unknown"))
    return F.struct(first.alias("primary"), tags.alias("tags"))


def loss_priority(loss: Column | str) -> Column:
    """7 and one for each million of loss, 10 at most."""
    return F.least(F.greatest(F.lit(7) + F.floor(col(loss) / 1e6), F.lit(7)), F.lit(10)).cast("long")


def param_names(params: Column | str, not_names: tuple[str, ...] = ("memory", "calldata", "storage", "payable", "indexed")) -> Column:
    """Last word of every comma part of a parameter list, without keywords and empty parts."""
    last = F.transform(F.split(col(params), ","), lambda p: F.element_at(F.split(F.trim(p), r"\s+"), -1))
    return F.filter(last, lambda n: (n != "") & ~n.isin(*not_names))


def infer_taint(target: Column | str, params: Column) -> Column:
    """user_input if the root of a dotted target is a parameter, else state."""
    return F.when(F.array_contains(params, F.split(col(target), r"\.")[0]), F.lit("user_input")).otherwise(F.lit("state"))


def sloc(body: Column | str) -> Column:
    """Lines that are neither blank nor comments."""
    lines = F.transform(F.split(col(body), "\n"), lambda x: F.trim(x))
    return F.size(F.filter(lines, lambda x: (x != "") & ~x.startswith("//") & ~x.startswith("*"))).cast("long")


def line_number(text: Column | str, position: Column) -> Column:
    """Line (from 1) of a character position (from 0)."""
    return F.size(F.split(F.substring(col(text), F.lit(1), position), "\n")).cast("long")


def snippets(text: Column | str, pattern: str, before: int, after: int) -> Column:
    """(line, snippet) for every line, from 1, that has the pattern: the lines around it."""

    def of(lines: Column) -> Column:
        hits = F.filter(F.sequence(F.lit(1), F.size(lines)), lambda i: F.element_at(lines, i).rlike(pattern))
        first = lambda i: F.greatest(i - before, F.lit(1))
        return F.transform(hits, lambda i: F.struct(i.cast("long").alias("line"), F.array_join(F.slice(lines, first(i), i + after + 1 - first(i)), "\n").alias("snippet")))

    # as an element of an array the lines are cut once, not for every line
    return F.flatten(F.transform(F.array(F.split(col(text), "\n")), of))
