"""Queries over text, lines, pages and sources."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import text as T
from ..operators import graph as G, rules as L
from ..sources import contracts, markup, replies
from .registry import query
from .views import Views, pick, sql_pick


@query("chunk_fixed", sql="SELECT doc_id, s AS start, length(substr(text, s + 1, 2000)) AS n FROM (SELECT doc_id, text, unnest(range(0, greatest(0, CAST(ceil((length(text) - 2000) / 1800.0) AS BIGINT)) * 1800 + 1, 1800)) AS s FROM documents)")
def chunk_fixed(v: Views) -> DataFrame:
    rows = v.table("documents").select("doc_id", "text", F.explode(T.chunk_starts("text")).alias("start"))
    return rows.select("doc_id", F.col("start").cast("long").alias("start"), F.length(F.substring("text", F.col("start") + 1, F.lit(2000))).cast("long").alias("n"))


@query("doc_counts", sql="SELECT doc_id, CAST(len(list_filter(string_split_regex(text, '\\s+'), lambda x: x <> '')) AS BIGINT) AS n_words, length(text) AS n_length FROM documents")
def doc_counts(v: Views) -> DataFrame:
    return v.table("documents").select("doc_id", T.n_words("text").alias("n_words"), F.length("text").cast("long").alias("n_length"))


@query(
    "parse_amount",
    sql="SELECT o_orderkey, CASE o_orderkey % 4 WHEN 0 THEN (o_orderkey % 1000) * 1e6 WHEN 1 THEN (o_orderkey % 1000) * 1e3 WHEN 2 THEN CAST(o_orderkey AS DOUBLE) ELSE 0.0 END AS amount FROM orders",
)
def parse_amount(v: Views) -> DataFrame:
    k, small = F.col("o_orderkey").cast("string"), (F.col("o_orderkey") % 1000).cast("string")
    text = F.when(F.col("o_orderkey") % 4 == 0, F.concat(F.lit("$"), small, F.lit("m+"))).when(F.col("o_orderkey") % 4 == 1, F.concat(small, F.lit("K USDC"))).when(F.col("o_orderkey") % 4 == 2, k).otherwise("n/a")
    return v.table("orders").select("o_orderkey", T.parse_amount(text).alias("amount"))


@query("parse_bounty", sql="SELECT o_orderkey, CAST(o_orderkey AS DOUBLE) AS bounty, o_orderkey >= 5000 AS large FROM orders")
def parse_bounty(v: Views) -> DataFrame:
    b = T.parse_bounty(F.concat(F.lit("$ "), F.col("o_orderkey").cast("string"), F.lit(" USD")))
    return v.table("orders").select("o_orderkey", b.alias("bounty"), (b >= 5000).alias("large"))


@query("slugify", sql="SELECT page_id, regexp_replace(regexp_replace(lower(url), '[^a-z0-9]+', '-', 'g'), '^-+|-+$', '', 'g') AS slug FROM pages")
def slugify(v: Views) -> DataFrame:
    return v.table("pages").select("page_id", T.slugify("url").alias("slug"))


@query("safe_filename", sql="SELECT doc_id, '2024-01-01_' || replace(lower(trim(substr(regexp_replace(text, '[^A-Za-z0-9 _-]', '_', 'g'), 1, 50), ' ')), ' ', '_') || '.md' AS name FROM documents")
def safe_filename(v: Views) -> DataFrame:
    return v.table("documents").select("doc_id", T.safe_filename(F.lit("2024-01-01"), "text").alias("name"))


@query("loss_priority", sql="SELECT o_orderkey, CAST(least(greatest(7 + floor(o_totalprice * 20 / 1e6), 7), 10) AS BIGINT) AS priority FROM orders")
def loss_priority(v: Views) -> DataFrame:
    return v.table("orders").select("o_orderkey", T.loss_priority(F.col("o_totalprice") * 20).alias("priority"))


@query("is_public", sql="SELECT o_orderkey, o_orderdate < TIMESTAMP '1997-01-01' AS public FROM orders")
def is_public(v: Views) -> DataFrame:
    day = F.date_format("o_orderdate", "yyyy-MM-dd'T'HH:mm:ss'Z'")
    return v.table("orders").select("o_orderkey", F.coalesce(F.try_to_timestamp(day) < F.lit("1997-01-01").cast("timestamp"), F.lit(True)).alias("public"))


@query("sloc", sql="SELECT doc_id, CAST(len(list_filter(string_split(text, chr(10)), lambda x: trim(x, ' ') <> '' AND NOT starts_with(trim(x, ' '), '//') AND NOT starts_with(trim(x, ' '), '*'))) AS BIGINT) AS sloc FROM documents")
def sloc(v: Views) -> DataFrame:
    return v.table("documents").select("doc_id", T.sloc("text").alias("sloc"))


@query(
    "line_number",
    sql="WITH b AS (SELECT doc_id, substr(text, 1, length(text) - strpos(reverse(text), '.')) AS before FROM documents) SELECT doc_id, 1 + length(before) - length(replace(before, chr(10), '')) AS line FROM b",
)
def line_number(v: Views) -> DataFrame:
    """Line of the last full stop of every text; the last line where there is none."""
    last = F.length("text") - F.locate(".", F.reverse("text"))
    return v.table("documents").select("doc_id", T.line_number("text", last).alias("line"))


_HIDDEN = "regexp_replace(" * 6 + "html" + "".join(f", '(?is)<{t}[^>]*>.*?</{t}>', ' ', 'g')" for t in markup.HIDDEN)


@query("html_visible_text", sql=f"SELECT page_id, trim(regexp_replace(regexp_replace({_HIDDEN}, '(?s)<[^>]*>', ' ', 'g'), '\\s+', ' ', 'g'), ' ') AS text FROM pages")
def html_visible_text(v: Views) -> DataFrame:
    return v.table("pages").select("page_id", markup.visible_text("html").alias("text"))


@query("html_main_text", sql=f"SELECT page_id, CAST(len(list_filter(list_transform(string_split(regexp_replace({_HIDDEN}, '(?s)<[^>]*>', chr(10), 'g'), chr(10)), lambda x: trim(x, ' ')), lambda x: x <> '')) AS BIGINT) AS n_lines FROM pages")
def html_main_text(v: Views) -> DataFrame:
    return v.table("pages").select("page_id", F.size(markup.text_lines("html")).cast("long").alias("n_lines"))


@query("html_json_extract", sql="SELECT page_id, regexp_extract(html, '(?is)<title>(.*?)</title>', 1) AS title, regexp_extract(html, 'track\\((\\d+)\\)', 1) AS tracked FROM pages")
def html_json_extract(v: Views) -> DataFrame:
    return v.table("pages").select("page_id", markup.title("html").alias("title"), F.regexp_extract("html", r"track\((\d+)\)", 1).alias("tracked"))


@query("regex_multi_extract", sql="SELECT page_id, link FROM (SELECT page_id, unnest(regexp_extract_all(html, 'href=\"([^\"]*)\"', 1)) AS link FROM pages)")
def regex_multi_extract(v: Views) -> DataFrame:
    return v.table("pages").select("page_id", F.explode(F.regexp_extract_all("html", F.lit('href="([^"]*)"'), F.lit(1))).alias("link"))


@query(
    "md_sections",
    sql="""WITH d AS (SELECT doc_id, replace(text, chr(10), chr(10) || '## ') AS c FROM documents), p AS (SELECT doc_id, unnest(string_split(regexp_replace(c, '\\n(#{1,4} )', chr(1) || '\\1', 'g'), chr(1))) AS part, unnest(range(0, len(string_split(regexp_replace(c, '\\n(#{1,4} )', chr(1) || '\\1', 'g'), chr(1))))) AS section FROM d WHERE length(c) >= 300)
    SELECT doc_id, section, trim(regexp_extract(part, '^#{1,4} ([^\\n]*)', 1), ' ') AS heading, substr(trim(regexp_replace(part, '^#{1,4} [^\\n]*\\n?', ''), ' '), 1, 3500) AS body FROM p WHERE length(body) > 50""",
)
def md_sections(v: Views) -> DataFrame:
    docs = v.table("documents").select("doc_id", F.replace(F.col("text"), F.lit("\n"), F.lit("\n## ")).alias("c"))
    return markup.sections(docs, "doc_id", "c")


def _frame(name: str, lo: int, hi: int) -> None:
    side = lambda n: f"{abs(n)} {'PRECEDING' if n < 0 else 'FOLLOWING'}" if n else "CURRENT ROW"
    sql = f"SELECT doc_id, line_no, hit FROM (SELECT doc_id, line_no, bool_or(contains(line, 'License')) OVER (PARTITION BY doc_id ORDER BY line_no ROWS BETWEEN {side(lo)} AND {side(hi)}) AS hit FROM lines) WHERE hit"

    @query(name, "lines", sql)
    def run(v: Views) -> DataFrame:
        return L.frame_flag(v.lines, "doc_id", "line_no", F.col("line").contains("License"), lo, hi).filter("hit").select("doc_id", "line_no", "hit")


_frame("frame_preceding", -2, 0)
_frame("frame_centered", -5, 4)
_frame("frame_following", 0, 4)
_START = "regexp_matches(line, '^[A-Z][a-z]+ ')"
_SCOPED = f"""s AS (SELECT doc_id, line_no, line, last_value(CASE WHEN {_START} THEN regexp_extract(line, '^([A-Z][a-z]+) ', 1) END IGNORE NULLS) OVER w AS scope, count(*) FILTER ({_START}) OVER w AS scope_no FROM lines WINDOW w AS (PARTITION BY doc_id ORDER BY line_no ROWS UNBOUNDED PRECEDING))"""


def _scoped(v: Views) -> DataFrame:
    return L.scope(v.lines, "doc_id", "line_no", F.col("line").rlike("^[A-Z][a-z]+ "), F.regexp_extract("line", "^([A-Z][a-z]+) ", 1))


@query("ffill_scope", "lines", f"WITH {_SCOPED} SELECT doc_id, line_no, scope FROM s WHERE scope IS NOT NULL")
def ffill_scope(v: Views) -> DataFrame:
    return _scoped(v).filter("scope is not null").select("doc_id", "line_no", "scope")


@query("asof_enclosing", "lines", f"WITH {_SCOPED} SELECT doc_id, line_no, scope FROM s WHERE contains(line, 'License')")
def asof_enclosing(v: Views) -> DataFrame:
    scoped = G.asof_enclosing(v.lines, "doc_id", ["line_no"], F.col("line").rlike("^[A-Z][a-z]+ "), F.regexp_extract("line", "^([A-Z][a-z]+) ", 1))
    return scoped.filter(F.col("line").contains("License")).select("doc_id", "line_no", "scope")


@query("sticky_flag", "lines", f"WITH {_SCOPED} SELECT doc_id, line_no FROM (SELECT *, bool_or(contains(line, 'icense')) OVER (PARTITION BY doc_id, scope_no ORDER BY line_no ROWS UNBOUNDED PRECEDING) AS f FROM s) WHERE f")
def sticky_flag(v: Views) -> DataFrame:
    return L.sticky(_scoped(v), ["doc_id", "scope_no"], "line_no", F.col("line").contains("icense")).filter("sticky").select("doc_id", "line_no")


@query("loops_per_function", "lines", f"WITH {_SCOPED} SELECT doc_id, scope_no, count(*) AS n, count(*) >= 2 AS nested, min(line_no) AS first_line FROM s WHERE regexp_matches(line, '\\b(for|while)\\b') GROUP BY 1, 2")
def loops_per_function(v: Views) -> DataFrame:
    return _scoped(v).filter(F.col("line").rlike(r"\b(for|while)\b")).groupBy("doc_id", "scope_no").agg(F.count("*").alias("n"), (F.count("*") >= 2).alias("nested"), F.min("line_no").alias("first_line"))


@query(
    "block_end",
    "lines",
    """WITH d AS (SELECT doc_id, line_no, sum(length(line) - length(replace(line, ',', '')) - (length(line) - length(replace(line, '.', '')))) OVER (PARTITION BY doc_id ORDER BY line_no ROWS UNBOUNDED PRECEDING) AS depth FROM lines),
    s AS (SELECT *, max(depth) OVER (PARTITION BY doc_id ORDER BY line_no ROWS UNBOUNDED PRECEDING) AS top FROM d) SELECT doc_id, min(line_no) AS "end" FROM s WHERE top > 0 AND depth <= 0 GROUP BY 1""",
)
def block_end(v: Views) -> DataFrame:
    return L.block_end(v.lines, "doc_id", "line_no", "line", ",", ".")


@query("line_rule_scan", "lines", "SELECT doc_id, line_no, CASE WHEN contains(line, 'GNU') THEN 'gnu' WHEN contains(line, 'MIT') THEN 'mit' ELSE 'cc' END AS rule FROM lines WHERE regexp_matches(line, 'GNU|MIT|CC BY')")
def line_rule_scan(v: Views) -> DataFrame:
    rule = F.when(F.col("line").contains("GNU"), "gnu").when(F.col("line").contains("MIT"), "mit").otherwise("cc")
    return v.lines.filter(F.col("line").rlike("GNU|MIT|CC BY")).select("doc_id", "line_no", rule.alias("rule"))


@query("file_rule_scan", sql="SELECT doc_id, contains(text, 'License') AND NOT contains(text, 'MIT') AS other, regexp_matches(text, '\\bversion\\b') AS version FROM documents WHERE contains(text, 'icense')")
def file_rule_scan(v: Views) -> DataFrame:
    d = v.table("documents").filter(F.col("text").contains("icense"))
    return d.select("doc_id", (F.col("text").contains("License") & ~F.col("text").contains("MIT")).alias("other"), F.col("text").rlike(r"\bversion\b").alias("version"))


_FLAGS = " UNION ALL ".join(f"SELECT doc_id, '{f}' AS flag FROM documents WHERE regexp_matches(text, '{p}')" for f, p in L.PATTERNS)


@query("pattern_scan", sql=f"SELECT flag, count(*) AS n, min(doc_id) AS first_doc FROM ({_FLAGS}) GROUP BY 1")
def pattern_scan(v: Views) -> DataFrame:
    rows = v.spread(v.table("documents").select("doc_id", "text")).withColumn("low", F.lower("text"))
    hits = rows.select("doc_id", F.explode(L.pattern_flags(F.col("text"), F.col("low"))).alias("flag"))
    return hits.groupBy("flag").agg(F.count("*").alias("n"), F.min("doc_id").alias("first_doc"))


@query("sel_erc20", "lines", "SELECT doc_id, count(*) AS n FROM lines WHERE regexp_matches(line, '\\.(approve|transfer|transferFrom)\\s*\\(') OR contains(line, 'Released under') GROUP BY 1")
def sel_erc20(v: Views) -> DataFrame:
    hit = F.col("line").rlike(r"\.(approve|transfer|transferFrom)\s*\(") | F.col("line").contains("Released under")
    return v.lines.filter(hit).groupBy("doc_id").agg(F.count("*").alias("n"))


@query("sel_upgradeable", sql="SELECT source, count(*) AS n FROM documents WHERE regexp_matches(text, 'Licensed|Initializable') GROUP BY 1")
def sel_upgradeable(v: Views) -> DataFrame:
    return v.table("documents").filter(F.col("text").rlike("Licensed|Initializable")).groupBy("source").agg(F.count("*").alias("n"))


@query(
    "snippet_window",
    "lines",
    """SELECT h.doc_id, h.line_no AS line, string_agg(l.line, chr(10) ORDER BY l.line_no) AS snippet
    FROM lines h JOIN lines l ON l.doc_id = h.doc_id AND l.line_no BETWEEN h.line_no - 5 AND h.line_no + 3
    WHERE regexp_matches(h.line, '@|icense') GROUP BY 1, 2""",
)
def snippet_window(v: Views) -> DataFrame:
    """Five lines before and three after every hit of a text."""
    return v.table("documents").filter("text is not null").select("doc_id", F.inline(T.snippets("text", "@|icense", before=5, after=3)))


SOURCE = """abstract contract Base is Owned, Guard {
    mapping(address => uint256) public balances;
    uint256 private total;
    function pay(address to, uint256 amount) external onlyOwner {
        if (amount > 0) { balances[to] -= amount; }
        to.call{value: amount}("");
        emit Paid(to);
    }
    function sum() public view returns (uint256) { return total; }
    function open(uint256 total) internal;
}
interface IThing { function f() external; }
"""


@query("parse_sources")
def parse_sources(v: Views) -> DataFrame:
    """Facts of one invented file for each nation, whose contract bears the nation's name."""
    files = v.table("nation").select(F.concat(F.lit("src/"), "n_name", F.lit(".sol")).alias("path"), F.replace(F.lit(SOURCE), F.lit("Base"), F.replace(F.col("n_name"), F.lit(" "), F.lit(""))).alias("content"))
    return contracts.facts(files)


def _facts(v: Views, *kinds: str) -> DataFrame:
    return parse_sources(v).filter(F.col("kind").isin(*kinds))


@query("parse_contracts", sql="SELECT replace(n_name, ' ', '') AS name, 'abstract' AS kind FROM nation UNION ALL SELECT 'IThing', 'interface' FROM nation")
def parse_contracts(v: Views) -> DataFrame:
    return _facts(v, "abstract", "contract", "library", "interface").select("name", "kind")


@query("parse_functions", sql="SELECT replace(n_name, ' ', '') AS contract, f AS name, s AS visibility FROM nation, (VALUES ('pay', 'external'), ('sum', 'public'), ('open', 'internal')) t(f, s) UNION ALL SELECT 'IThing', 'f', 'external' FROM nation")
def parse_functions(v: Views) -> DataFrame:
    return _facts(v, "function").select("contract", "name", "visibility")


@query("parse_vars", sql="SELECT replace(n_name, ' ', '') AS contract, f AS name FROM nation, (VALUES ('balances'), ('total')) t(f)")
def parse_vars(v: Views) -> DataFrame:
    return _facts(v, "variable").select("contract", "name")


@query("data_flow", sql="SELECT replace(n_name, ' ', '') AS contract, f AS name, k AS kind, t AS target FROM nation, (VALUES ('pay', 'writes', 'balances'), ('sum', 'reads', 'total')) x(f, k, t)")
def data_flow(v: Views) -> DataFrame:
    """Writes beat reads, and a parameter hides a variable of its name."""
    return _facts(v, "reads", "writes").select("contract", "name", "kind", "target")


@query("infer_taint", sql="SELECT path, 'user_input' AS taint FROM (SELECT 'src/' || n_name || '.sol' AS path FROM nation)")
def infer_taint(v: Views) -> DataFrame:
    return _facts(v, "external_call").select("path", F.col("visibility").alias("taint"))


@query("brace_body", sql="SELECT 'src/' || n_name || '.sol' AS path, CAST(1 AS BIGINT) AS line, CAST(11 AS BIGINT) AS line_end FROM nation")
def brace_body(v: Views) -> DataFrame:
    return _facts(v, "abstract").select("path", "line", "line_end")


@query("detector_flags", sql="SELECT event_id % 7 AS node, event_type AS flag, count(*) AS n FROM events WHERE event_type IN ('click', 'purchase', 'view') GROUP BY 1, 2")
def detector_flags(v: Views) -> DataFrame:
    """Flags from nested analyzer results: elements exploded, kinds filtered."""
    results = v.table("events").select("event_type", F.array(F.struct((F.col("event_id") % 7).alias("node"), F.lit("function").alias("type"))).alias("elements"))
    rows = results.filter(F.col("event_type").isin("click", "purchase", "view")).select(F.col("event_type").alias("flag"), F.explode("elements").alias("e"))
    return rows.filter("e.type = 'function'").groupBy(F.col("e.node").alias("node"), "flag").agg(F.count("*").alias("n"))


@query("json_from_text", sql="SELECT conv_id, turn, '[\"' || role || '\"]' AS json FROM conversations")
def json_from_text(v: Views) -> DataFrame:
    text = F.concat(F.lit("I found: ["), F.lit('"'), "role", F.lit('"] and more'))
    return v.table("conversations").select("conv_id", "turn", replies.json_array(text).alias("json"))


@query("section_tags", sql="SELECT doc_id, array_to_string(list_distinct(['root_cause'] || CASE WHEN contains(lower(text), 'license') THEN ['license', 'root_cause'] ELSE CAST([] AS VARCHAR[]) END), ',') = 'root_cause' AS plain FROM documents")
def section_tags(v: Views) -> DataFrame:
    own = F.when(F.lower("text").contains("license"), F.array(F.lit("license"), F.lit("root_cause"))).otherwise(F.array().cast("array<string>"))
    return v.table("documents").select("doc_id", (F.array_join(F.array_distinct(F.concat(F.array(F.lit("root_cause")), own)), ",") == "root_cause").alias("plain"))


@query("md_sections_b")
def md_sections_b(v: Views) -> DataFrame:
    """Sections of reports, long ones cut again at blank lines."""
    docs = v.table("documents").select("doc_id", F.replace(F.col("text"), F.lit("\n"), F.lit("\n\n")).alias("c"))
    rows = markup.sections(docs, "doc_id", "c")
    return rows.select("doc_id", "section", F.posexplode(F.split("body", r"\n{2,}")).alias("part", "text")).filter(F.length("text") > markup.MIN_BODY)


@query("source_snippets", "functions", "SELECT f.id, d.doc_id, d.text AS snippet FROM functions f JOIN documents d ON d.doc_id = f.ord")
def source_snippets(v: Views) -> DataFrame:
    d = v.table("documents").select("doc_id", F.col("text").alias("snippet"))
    return v.functions.join(d, F.col("ord") == F.col("doc_id")).select("id", "doc_id", "snippet")


@query(
    "graph_roundtrip",
    "functions data_flow",
    "SELECT f.contract, count(DISTINCT f.id) AS n_nodes, count(*) AS n_edges FROM data_flow e JOIN functions f ON f.id = e.src GROUP BY 1",
)
def graph_roundtrip(v: Views) -> DataFrame:
    """Nodes and edges as JSON rows and back."""
    edges = v.data_flow.select(F.to_json(F.struct("src", "dst", "type")).alias("j")).select(F.from_json("j", "src string, dst string, type string").alias("e")).select("e.*")
    return edges.join(v.functions, F.col("src") == F.col("id")).groupBy("contract").agg(F.count_distinct("id").alias("n_nodes"), F.count("*").alias("n_edges"))


@query("scan_sources", sql="SELECT doc_id, 'doc/' || doc_id || '.sol' AS path FROM documents WHERE doc_id % 5 <> 0")
def scan_sources(v: Views) -> DataFrame:
    """Paths without skipped folders."""
    from ..sources.ingest import SKIPPED

    path = F.when(F.col("doc_id") % 5 == 0, F.concat(F.lit("doc/tests/"), F.col("doc_id").cast("string"))).otherwise(F.concat(F.lit("doc/"), F.col("doc_id").cast("string"), F.lit(".sol")))
    return v.table("documents").select("doc_id", path.alias("path")).filter(~F.arrays_overlap(F.split("path", "/"), F.array(*map(F.lit, SKIPPED))))


_CODES = ("function f", "mapping(a => b)", "require(x", "uint256 n", "emit Done", "see A.sol", "solidity", "plain", "requirement", "mapping only")
_CODED = f"(SELECT doc_id, {sql_pick('doc_id', _CODES)} || ' ' || text AS t FROM documents)"


def _coded(v: Views) -> DataFrame:
    return v.table("documents").select("doc_id", F.concat(pick(F.col("doc_id"), _CODES), F.lit(" "), "text").alias("t"))


@query("has_code", sql=f"SELECT doc_id, regexp_matches(t, 'function |mapping\\(|require\\(|uint\\d+') AS a, regexp_matches(t, 'function |mapping\\(|require\\(|emit |\\.sol') AS b, regexp_matches(t, 'function|mapping|require|solidity|\\.sol') AS c FROM {_CODED}")
def has_code(v: Views) -> DataFrame:
    return _coded(v).select("doc_id", *(T.has_code("t", i + 1).alias(n) for i, n in enumerate("abc")))


_ASKED = ("where is msg.sender read", "a Contract call", "uint64 overflow", "bytes32 key", "int", "print it", "receive() hook", "fallback() x", "contracts", "tx.origin", "nothing here", "abi.encodePacked", "abi.encode it", "REVERT now")


@query("looks_like_code", sql=f"SELECT item_id, t IN ('where is msg.sender read', 'a Contract call', 'bytes32 key', 'int', 'tx.origin', 'abi.encode it', 'REVERT now') AS code FROM (SELECT item_id, {sql_pick('item_id', _ASKED)} AS t FROM benchmark)")
def looks_like_code(v: Views) -> DataFrame:
    """The pattern ends at word boundaries, so the two hooks with parentheses match only before a word."""
    return v.table("benchmark").select("item_id", T.looks_like_code(pick(F.col("item_id"), _ASKED)).alias("code"))


_PARAMS = ("address to, uint256 amount", "bytes calldata", "", "uint[] memory ids, address  from", "IPool pool,")


@query("param_names", sql=f"""SELECT c_custkey, {sql_pick('c_custkey', ('to,amount', '', '', 'ids,from', 'pool'))} AS params, {sql_pick('c_custkey', ('user_input', 'state', 'state', 'state', 'state'))} AS taint FROM customer""")
def param_names(v: Views) -> DataFrame:
    params = T.param_names(pick(F.col("c_custkey"), _PARAMS))
    return v.table("customer").select("c_custkey", F.array_join(params, ",").alias("params"), T.infer_taint(F.lit("to.owner"), params).alias("taint"))


_RAW = ('{"title":"A","date":"d1"}', '{"name":"B","publishedAt":"d2"}', '{"createdAt":"d3"}', '{"title":"","name":"C"}', "{}")


@query("normalize_incident", sql=f"SELECT event_id, {sql_pick('event_id', ('A', 'B', 'unknown', 'C', 'unknown'))} AS title, {sql_pick('event_id', ('d1', 'd2', 'd3', 'unknown', 'unknown'))} AS date FROM events")
def normalize_incident(v: Views) -> DataFrame:
    """The first key of several names that is not empty, else a default."""
    raw = pick(F.col("event_id"), _RAW)
    field = lambda *names: F.coalesce(*(F.nullif(F.get_json_object(raw, f"$.{n}"), F.lit("")) for n in names), F.lit("unknown"))
    return v.table("events").select("event_id", field("title", "name").alias("title"), field("date", "publishedAt", "createdAt").alias("date"))


_TOLD = ("a Reentrancy bug", "flash loan, then oracle", "proxy of a bridge", "donation inflation", "EIP-2771 forwarder", "fee accounting", "nothing known", "integer overflow in governance")


@query("keyword_classify", sql=f"""SELECT doc_id, {sql_pick('doc_id', ('reentrancy', 'flash loan', 'proxy', 'inflation', 'eip-2771', 'fee accounting', 'unknown', 'governance'))} AS primary_key,
    'incident,real_world,high_priority' || {sql_pick('doc_id', (',reentrancy,callback,CEI', ',oracle,flash_loan,price_manipulation,price_feed', ',proxy,upgradeable,cross_chain,bridge', ',defi_math,vault_inflation,erc4626', ',access_control,meta_transaction,eip2771', ',fee_accounting,gross_net', '', ',governance,dao,defi_math,overflow'))} AS tags FROM documents""")
def keyword_classify(v: Views) -> DataFrame:
    tags = T.attack_tags(pick(F.col("doc_id"), _TOLD))
    return v.table("documents").select("doc_id", tags.primary.alias("primary_key"), F.array_join(tags.tags, ",").alias("tags"))


@query("reply_arrays", sql="""SELECT conv_id, turn, CASE turn % 4 WHEN 3 THEN NULL ELSE '[{"role": "' || role || '", "text": "a ] b"}, [1]]' END AS json FROM conversations""")
def reply_arrays(v: Views) -> DataFrame:
    """The first array of replies with a fence, a plain fence, brackets in strings, or none."""
    body = F.concat(F.lit('[{"role": "'), "role", F.lit('", "text": "a ] b"}, [1]]'))
    forms = (F.concat(F.lit("Yes:\n```json\n"), body, F.lit("\n```\n[2]")), F.concat(F.lit("```\n"), body, F.lit("\n```")), F.concat(F.lit("so "), body, F.lit(" and [3]")), F.lit("none here"))
    reply = F.coalesce(*(F.when(F.col("turn") % 4 == i, f) for i, f in enumerate(forms)))
    return v.table("conversations").select("conv_id", "turn", replies.json_array(reply).alias("json"))


_MARKS = ("latestRoundData()", "prevrandao", "requestRandom", "flash  loan", "getReserves", "x.balance", "convertToShares", "ERC6909", "KEEPER_ROLE", "Initializable", "lzReceive", "deadline", "EIP712", "Validator", "quorum", "mulWad", "beforeSwap", "a.call{", "nonReentrant", "allocation", "legacy", "liquidated", "Raffle", "nothing")
_MARKED = ("ORACLE", "RANDOMNESS_WEAK", "RANDOMNESS_VRF", "FLASH_LOAN", "DEX_INTERACTION", "BALANCE_DEPENDENT", "ERC4626", "MULTI_TOKEN", "SEMI_TRUSTED_ROLE", "PROXY_UPGRADEABLE", "CROSS_CHAIN", "TEMPORAL", "HAS_SIGNATURES", "STAKING", "GOVERNANCE", "MIXED_DECIMALS", "CALLBACK", "LOW_LEVEL_CALL", "REENTRANCY_GUARD", "SHARE_ALLOCATION", "MIGRATION", "LENDING", "LOTTERY", "")


@query("pattern_flags", sql=f"SELECT doc_id, {sql_pick('doc_id', _MARKED)} AS flags FROM documents")
def pattern_flags(v: Views) -> DataFrame:
    """A text that hits for each of the 23 flags, and one that misses all."""
    rows = v.table("documents").select("doc_id", pick(F.col("doc_id"), _MARKS).alias("t"))
    return rows.select("doc_id", F.array_join(L.pattern_flags(F.col("t"), F.lower("t")), ",").alias("flags"))
