"""Queries over reports, listings, replies and paths."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.ranks import severity_rank
from ..operators import budget
from ..operators import findings as N
from ..operators import graph as G
from ..sources import reports as R
from .findings_queries import _RANK
from .registry import query
from .views import Views, pick, sql_pick

_LEADS = ("./", "../", ".", "# ", "  ", "/", "src/./")


@query("scope_entries", sql=f"SELECT doc_id, ltrim(e, './') AS entry FROM (SELECT doc_id, trim(CASE WHEN doc_id % 9 = 4 THEN '   ' ELSE {sql_pick('doc_id', _LEADS)} || 'pool/F' || doc_id || '.sol' END) AS e FROM documents) WHERE e <> '' AND NOT starts_with(e, '#')")
def scope_entries(v: Views) -> DataFrame:
    line = F.when(F.col("doc_id") % 9 == 4, "   ").otherwise(F.concat(pick(F.col("doc_id"), _LEADS), F.lit("pool/F"), F.col("doc_id").cast("string"), F.lit(".sol")))
    return R.scope_entries(v.table("documents").select("doc_id", line.alias("line")), "line").select("doc_id", "entry")


_DIRS = ("src", "test", "lib/openzeppelin", "contracts", "lib/forge-std", "script", "mocks", "a/out", "lib/solady", "lib/openzeppelin-contracts", "testing")
_PATH = f"'/repo/' || {sql_pick('doc_id', _DIRS)} || '/F' || doc_id || '.sol'"
_VENDOR = "node_modules|/forge-std/|/openzeppelin/|/solmate/|/solady/|/@openzeppelin/|/test/|/tests/|/mock/|/mocks/|/script/|/artifacts/|/cache/|/out/|/build/"


@query("path_filters", sql=f"SELECT doc_id, NOT regexp_matches(p, '{_VENDOR}') AS in_scope, len(list_intersect(string_split(p, '/'), ['node_modules', 'forge-std', 'openzeppelin-contracts', 'test', 'tests', 'mock', 'mocks', '.git', 'artifacts', 'cache', 'out', 'build', 'script'])) = 0 AS scanned FROM (SELECT doc_id, {_PATH} AS p FROM documents)")
def path_filters(v: Views) -> DataFrame:
    rows = v.table("documents").select("doc_id", F.concat(F.lit("/repo/"), pick(F.col("doc_id"), _DIRS), F.lit("/F"), F.col("doc_id").cast("string"), F.lit(".sol")).alias("path"))
    return rows.select("doc_id", R.in_scope("path").alias("in_scope"), R.scanned("path").alias("scanned"))


_TASKS = ("", "test", "TestTask", "PING", "dummy", "job", "tests")


@query("test_pings", sql=f"SELECT event_id, t = '' OR upper(t) IN ('TEST', 'TESTTASK', 'PING', 'DUMMY') OR event_id % 8 = 3 AS ping FROM (SELECT event_id, {sql_pick('event_id', _TASKS)} AS t FROM events)")
def test_pings(v: Views) -> DataFrame:
    k = F.col("event_id")
    return v.table("events").select("event_id", R.is_ping(pick(k, _TASKS), F.when(k % 8 != 3, "http://host/repo")).alias("ping"))


_PARENTS = ("My Vault", "__x__", "//", "pool-v2", "a.b/c")


@query("folder_names", sql=f"SELECT o_orderkey AS id, CASE WHEN slug = '' THEN 'audit' ELSE slug END || '_' || day AS folder, regexp_replace('H-' || o_orderkey || ':' || p, '[/:]', '_', 'g') AS file FROM (SELECT o_orderkey, {sql_pick('o_orderkey', _PARENTS)} AS p, regexp_replace(regexp_replace({sql_pick('o_orderkey', _PARENTS)}, '[^\\w-]', '_', 'g'), '^_+|_+$', '', 'g') AS slug, strftime(o_orderdate, '%Y%m%d') AS day FROM orders)")
def folder_names(v: Views) -> DataFrame:
    parent = pick(F.col("o_orderkey"), _PARENTS)
    file = R.safe_id(F.concat(F.lit("H-"), F.col("o_orderkey").cast("string"), F.lit(":"), parent))
    return v.table("orders").select(F.col("o_orderkey").alias("id"), R.run_folder(parent, F.date_format("o_orderdate", "yyyyMMdd")).alias("folder"), file.alias("file"))


_PLACES = ("contracts/", "src/", "src/contracts/", "pkg/b/", "", "docs/")


@query("contracts_dir", sql=f"""SELECT repo, CASE WHEN bool_or(starts_with(path, 'contracts/')) THEN 'contracts' WHEN bool_or(starts_with(path, 'src/')) THEN 'src' ELSE coalesce(regexp_extract(min(path) FILTER (path LIKE '%.sol'), '^(.*)/[^/]*$', 1), '') END AS folder
    FROM (SELECT p_partkey % 67 AS repo, {sql_pick('((p_partkey % 67) + (p_partkey % 3) * 2)', _PLACES)} || 'F' || p_partkey || CASE WHEN p_partkey % 67 % 6 = 5 THEN '.md' ELSE '.sol' END AS path FROM part) GROUP BY 1""")
def contracts_dir(v: Views) -> DataFrame:
    repo = F.col("p_partkey") % 67
    path = F.concat(pick(repo + (F.col("p_partkey") % 3) * 2, _PLACES), F.lit("F"), F.col("p_partkey").cast("string"), F.when(repo % 6 == 5, ".md").otherwise(".sol"))
    return R.contracts_dir(v.table("part").select(repo.alias("repo"), path.alias("path")))


_KEYS = ("incidents", "data", "reports", "other")


@query("html_json_ids", sql=f"""SELECT page_id, CASE WHEN page_id % 4 = 3 THEN 'x1,x2,x3' ELSE 'a' || page_id || ',b' END AS ids FROM pages""")
def html_json_ids(v: Views) -> DataFrame:
    """Ids under one of three keys, with an empty list under the first, or under none of them."""
    key = pick(F.col("page_id"), _KEYS)
    empty = F.when(key == "incidents", "").otherwise('"incidents":[],')
    page = F.concat(F.lit('<html><script id="__NEXT_DATA__" type="application/json">{"props":{"pageProps":{'), empty, F.lit('"'), key, F.lit('":[{"id":"a'), F.col("page_id").cast("string"), F.lit('"},{"id":"b"}]}}}</script></html>'))
    return v.table("pages").select("page_id", F.array_join(R.next_data(page, ("x1", "x2", "x3")), ",").alias("ids"))


@query("listing_rows", sql="SELECT o_orderkey AS page, unnest(['i' || o_orderkey, 'j' || o_orderkey]) AS id, unnest(['One ' || o_custkey, 'Two']) AS title, unnest([strftime(o_orderdate, '%Y-%m-%d'), '2024-02-03']) AS day, unnest(['$' || o_custkey || 'M', '$1K']) AS loss FROM orders")
def listing_rows(v: Views) -> DataFrame:
    one = lambda *x: F.concat(*(y for k, c in zip(("id", "title", "time", "loss"), x, strict=True) for y in (F.lit(f'\\"{k}\\":\\"'), c, F.lit('\\",'))))
    key, cust = F.col("o_orderkey").cast("string"), F.col("o_custkey").cast("string")
    first = one(F.concat(F.lit("i"), key), F.concat(F.lit("One "), cust), F.concat(F.date_format("o_orderdate", "yyyy-MM-dd"), F.lit("T10:00:00")), F.concat(F.lit("$"), cust, F.lit("M")))
    text = F.concat(F.lit("[{"), first, F.lit("x},{"), one(F.concat(F.lit("j"), key), F.lit("Two"), F.lit("2024-02-03T"), F.lit("$1K")), F.lit('\\"id\\":\\"cut\\"}]'))
    return v.table("orders").select(F.col("o_orderkey").alias("page"), F.explode(R.listing(text)).alias("r")).select("page", "r.*")


@query("report_headers", sql="SELECT o_orderkey AS id, CASE WHEN o_orderkey % 5 = 0 THEN 'file' || o_orderkey ELSE 'Case ' || o_orderkey END AS title, CASE WHEN o_orderkey % 3 = 0 THEN 'unknown' ELSE strftime(o_orderdate, '%Y-%m-%d') END AS date, CASE WHEN o_orderkey % 7 = 0 THEN 'unknown' ELSE '$' || o_custkey || 'K' END AS loss, CASE WHEN o_orderkey % 2 = 0 THEN '' ELSE 'http://h/' || o_orderkey END AS link FROM orders")
def report_headers(v: Views) -> DataFrame:
    k, key = F.col("o_orderkey"), F.col("o_orderkey").cast("string")
    day = F.when(k % 3 != 0, F.concat(F.lit("**Date:** "), F.date_format("o_orderdate", "yyyy-MM-dd"), F.lit("  | "))).otherwise("**Date:** none")
    loss = F.when(k % 7 != 0, F.concat(F.lit("**Loss:** $"), F.col("o_custkey").cast("string"), F.lit("K"))).otherwise("")
    link = F.when(k % 2 != 0, F.concat(F.lit("**Link:** [see]("), F.concat(F.lit("http://h/"), key), F.lit(") here"))).otherwise("**Link:** none")
    content = F.concat(F.when(k % 5 != 0, F.concat(F.lit("## \U0001f6a8 Case "), key)).otherwise("no title"), F.lit("\n"), day, F.lit("\n"), loss, F.lit("\n"), link, F.lit("\n"))
    rows = v.table("orders").select(k.alias("id"), content.alias("content"))
    return rows.select("id", *(c.alias(n) for n, c in R.header_fields("content", F.concat(F.lit("file"), F.col("id").cast("string"))).items()))


_FORMS = ("# Top\nbody {0}\n## Empty\n### Next\n more", "intro\nRoot Cause Analysis\nbecause {0}\n6. Impact\nloss\n", "plain {0}", "Code Analysis\n\nExecution Trace\n")


@query("section_split", sql="""SELECT doc_id, heading, body FROM (SELECT doc_id, unnest(CASE doc_id % 4 WHEN 0 THEN ['Top', 'Next'] WHEN 1 THEN ['Root Cause Analysis', '6. Impact'] ELSE ['Report Content'] END) AS heading,
    unnest(CASE doc_id % 4 WHEN 0 THEN ['body ' || doc_id, 'more'] WHEN 1 THEN ['because ' || doc_id, 'loss'] WHEN 2 THEN ['plain ' || doc_id] ELSE ['Code Analysis' || chr(10) || chr(10) || 'Execution Trace'] END) AS body FROM documents)""")
def section_split(v: Views) -> DataFrame:
    """Four forms of reports: headers, known headings, neither, and headings without bodies."""
    forms = [F.replace(F.lit(f), F.lit("{0}"), F.col("doc_id").cast("string")) for f in _FORMS]
    content = F.coalesce(*(F.when(F.col("doc_id") % 4 == i, f) for i, f in enumerate(forms)))
    return v.table("documents").select("doc_id", F.explode(R.split_sections(content)).alias("s")).select("doc_id", "s.*")


@query("source_fences", sql="SELECT doc_id, CASE WHEN doc_id % 3 = 0 THEN '' ELSE 'contract C' || doc_id || ' {}' END AS source FROM documents")
def source_fences(v: Views) -> DataFrame:
    code = F.concat(F.lit("contract C"), F.col("doc_id").cast("string"), F.lit(" {}"))
    text = F.concat(F.lit("Here\n```js\nlet x\n```\n"), F.when(F.col("doc_id") % 3 != 0, F.concat(F.lit("```solidity\n"), code, F.lit("\n```"))).otherwise("```solidity none"), F.lit("\n```solidity\nsecond\n```"))
    text = F.when(F.col("doc_id") % 3 == 0, F.lit("no fence ```js\nx\n```")).otherwise(text)
    return v.table("documents").select("doc_id", R.first_fence(text).alias("source"))


@query("bullet_lines", sql="SELECT doc_id, count(*) AS n, CAST(sum(length(x)) AS BIGINT) AS chars FROM (SELECT doc_id, trim(regexp_replace(trim(unnest(string_split(text, chr(10)))), '^[-•* ]+', '')) AS x FROM documents) WHERE length(x) > 20 GROUP BY 1")
def bullet_lines(v: Views) -> DataFrame:
    rows = v.table("documents").select("doc_id", F.explode(R.bullets("text")).alias("x"))
    return rows.groupBy("doc_id").agg(F.count("*").alias("n"), F.sum(F.length("x")).alias("chars"))


_POSITIONS = """SELECT doc_id, CAST(list_sum(list_transform(p[1:i], lambda x: length(x))) + coalesce(list_sum(list_transform(m[1:i - 1], lambda x: length(x))), 0) AS BIGINT) AS at,
    CAST(1 + list_sum(list_transform(p[1:i], lambda x: length(x) - length(replace(x, chr(10), '')))) AS BIGINT) AS line, m[i] AS match
    FROM (SELECT *, unnest(range(1, len(m) + 1)) AS i FROM (SELECT doc_id, regexp_extract_all(text, '{0}') AS m, string_split_regex(text, '{0}') AS p FROM documents WHERE regexp_matches(text, '{0}')))"""


@query("match_positions", sql=_POSITIONS.format("[0-9]{2,}"))
def match_positions(v: Views) -> DataFrame:
    return R.match_positions(v.table("documents"), "doc_id", "text", "[0-9]{2,}")


# RE2 has word boundaries for ASCII only, so its text has a word character for every other one
@query("interface_mentions", sql=_POSITIONS.replace("FROM documents WHERE", "FROM (SELECT doc_id, regexp_replace(text, '[^\\x00-\\x7F]', '_', 'g') AS text FROM documents) WHERE").format("\\bI[A-Z][A-Za-z0-9]+\\b"))
def interface_mentions(v: Views) -> DataFrame:
    return R.match_positions(v.table("documents"), "doc_id", "text", r"\bI[A-Z][A-Za-z0-9]+\b")


@query("modifier_events", sql="SELECT p_partkey AS id, 'only' || p_size AS modifier, CASE WHEN p_partkey % 2 = 0 THEN 'Ev' || p_size || ',Done' ELSE 'Done' END AS events FROM part")
def modifier_events(v: Views) -> DataFrame:
    size = F.col("p_size").cast("string")
    source = F.concat(F.lit("contract C {\n  modifier only"), size, F.lit("() { _; }\n"), F.when(F.col("p_partkey") % 2 == 0, F.concat(F.lit("  event Ev"), size, F.lit("(address a);\n"))).otherwise(""), F.lit("  event   Done();\n}"))
    names = lambda word: F.array_join(F.regexp_extract_all(source, F.lit(rf"\b{word}\s+(\w+)"), F.lit(1)), ",")
    return v.table("part").select(F.col("p_partkey").alias("id"), names("modifier").alias("modifier"), names("event").alias("events"))


_SEVERITIES = (" HIGH", "critical", "Info", "weird", "Low ")


@query("reply_findings", sql=f"""SELECT o_orderkey AS reply, unnest(['F' || o_orderkey, 'ORA-002']) AS id, unnest(['A "b"', 'Untitled']) AS title, unnest([CASE o_orderkey % 5 WHEN 0 THEN 'High' WHEN 1 THEN 'Critical' WHEN 2 THEN 'Info' WHEN 3 THEN 'Medium' ELSE 'Low' END, 'Medium']) AS severity,
    unnest(['Oracle', 'Unknown']) AS category, unnest(['C.f[1]', '']) AS location FROM orders WHERE o_orderkey % 6 < 4""")
def reply_findings(v: Views) -> DataFrame:
    """Four forms of replies with an array, one without, one that is broken."""
    k = F.col("o_orderkey")
    body = F.concat(F.lit('[{"id": "F'), k.cast("string"), F.lit('", "title": "A \\"b\\"", "severity": "'), pick(k, _SEVERITIES), F.lit('", "category": "Oracle", "location": "C.f[1]"}, {"note": 1}]'))
    wrap = lambda a, b: F.concat(F.lit(a), body, F.lit(b))
    forms = [wrap("Sure.\n```json\n", "\n```\nDone [1]"), wrap("```\n", "\n```"), wrap("I found: ", " and no more"), body, F.lit("nothing"), F.lit("```json\n[{broken\n```")]
    replies = v.table("orders").select(k.alias("reply"), F.coalesce(*(F.when(k % 6 == i, f) for i, f in enumerate(forms))).alias("text"))
    return R.hypotheses(replies, "reply", "text", F.lit("OracleHunter"))


@query("tooltips", "named_variables", "SELECT id, '<b>' || name || '</b><br>' || replace(replace(replace(var_type, '&', '&amp;'), '<', '&lt;'), '>', '&gt;') || CASE WHEN is_constant THEN ' constant' ELSE '' END AS tip FROM named_variables")
def tooltips(v: Views) -> DataFrame:
    return v.named_variables.select("id", F.concat(F.lit("<b>"), R.escaped("name"), F.lit("</b><br>"), R.escaped("var_type"), F.when(F.col("is_constant"), " constant").otherwise("")).alias("tip"))


@query("graph_digest", "functions edges", """WITH e AS (SELECT contract, name, row_number() OVER (PARTITION BY contract ORDER BY name) AS rk FROM functions WHERE visibility IN ('external', 'public')),
    x AS (SELECT contract, count(*) AS n FROM functions f JOIN edges e ON e.src = f.id AND e.type = 'EXTERNAL_CALL' GROUP BY 1)
    SELECT contract, string_agg(name, ', ' ORDER BY name) FILTER (rk <= 30) AS entries, count(*) AS n_entries, coalesce(any_value(x.n), 0) AS n_external FROM e LEFT JOIN x USING (contract) GROUP BY 1""")
def graph_digest(v: Views) -> DataFrame:
    """Each contract's entry points, thirty by name at most, and its external calls."""
    own = G.public(v.functions).select("contract", "name").withColumn("rk", F.row_number().over(Window.partitionBy("contract").orderBy("name")))
    rows = own.groupBy("contract").agg(F.array_join(F.array_sort(F.collect_list(F.when(F.col("rk") <= 30, F.col("name")))), ", ").alias("entries"), F.count("*").alias("n_entries"))
    calls = v.edges.filter(G.kind("EXTERNAL_CALL")).join(v.functions.select(F.col("id").alias("src"), "contract"), "src").groupBy("contract").agg(F.count("*").alias("n_external"))
    return rows.join(calls, "contract", "left").na.fill(0, ["n_external"])


@query("variable_lines", "named_variables", "SELECT contract, string_agg(line, chr(10) ORDER BY line) AS lines FROM (SELECT contract, name || ': ' || var_type AS line, row_number() OVER (PARTITION BY contract ORDER BY name || ': ' || var_type) AS rk FROM named_variables) WHERE rk <= 3 GROUP BY 1")
def variable_lines(v: Views) -> DataFrame:
    """The first lines (three here, twenty by default) of each contract's variables in order."""
    own = v.named_variables.select("contract", F.concat("name", F.lit(": "), "var_type").alias("line"))
    rk = F.row_number().over(Window.partitionBy("contract").orderBy("line"))
    return own.withColumn("rk", rk).filter("rk <= 3").groupBy("contract").agg(F.array_join(F.array_sort(F.collect_list("line")), "\n").alias("lines"))


@query("ordered_distinct", "functions", "SELECT flag, min(ord) AS first_ord FROM functions GROUP BY 1")
def ordered_distinct(v: Views) -> DataFrame:
    return v.functions.groupBy("flag").agg(F.min("ord").alias("first_ord"))


@query("interface_sites", "named_variables", "SELECT var_type, string_agg(contract || '.' || name, ', ' ORDER BY name) AS sites FROM named_variables WHERE regexp_matches(var_type, '\\bI[A-Z][A-Za-z0-9]+\\b') GROUP BY 1")
def interface_sites(v: Views) -> DataFrame:
    own = v.named_variables.filter(F.col("var_type").rlike(r"\bI[A-Z][A-Za-z0-9]+\b")).select("var_type", "name", F.concat("contract", F.lit("."), "name").alias("site")).distinct()
    return own.groupBy("var_type").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("name", "site"))), lambda x: x.site), ", ").alias("sites"))


@query("priority_union", "functions", "SELECT id, min(list_no) AS first_list FROM (SELECT id, 1 AS list_no FROM functions WHERE list_contains(modifiers, 'onlyOwner') UNION ALL SELECT id, 2 FROM functions WHERE visibility = 'public' UNION ALL SELECT id, 3 FROM functions WHERE mutability = 'payable') GROUP BY 1 ORDER BY 2, min(id) LIMIT 40")
def priority_union(v: Views) -> DataFrame:
    """Setters, then readers, then payers, each id at its first list, cut to forty."""
    f = v.functions
    lists = [f.filter(F.array_contains("modifiers", "onlyOwner")), f.filter("visibility = 'public'"), f.filter("mutability = 'payable'")]
    every = [x.select("id", F.lit(i + 1).alias("list_no")) for i, x in enumerate(lists)]
    return every[0].union(every[1]).union(every[2]).groupBy("id").agg(F.min("list_no").alias("first_list")).orderBy("first_list", "id").limit(40)


@query("chain_ids", "findings", f"""WITH p(ca, cb) AS (VALUES ('Oracle/Randomness', 'Accounting'), ('Oracle/Randomness', 'Governance'), ('Oracle/Randomness', 'External Call'), ('Access Control', 'Proxy'), ('Access Control', 'Governance'), ('Access Control', 'Reentrancy'),
    ('Proxy', 'Access Control'), ('Proxy', 'External Call'), ('Accounting', 'Oracle/Randomness'), ('Accounting', 'Flash Loan'), ('Reentrancy', 'Accounting'), ('Reentrancy', 'External Call'), ('Governance', 'Access Control'), ('Governance', 'Accounting'),
    ('External Call', 'Reentrancy'), ('External Call', 'Access Control'), ('Cryptography', 'Access Control'), ('Cryptography', 'Governance'), ('DeFi Math', 'Oracle/Randomness'), ('DeFi Math', 'Accounting')),
    good AS (SELECT * FROM findings WHERE {_RANK} <= 2)
    SELECT a, b, 'CHAIN-' || lpad(CAST(row_number() OVER (PARTITION BY location ORDER BY a, b) AS VARCHAR), 3, '0') AS chain FROM (SELECT DISTINCT a.id AS a, b.id AS b, a.location FROM good a JOIN good b ON a.location = b.location AND a.id < b.id JOIN p ON (ca = a.category AND cb = b.category) OR (cb = a.category AND ca = b.category))""")
def chain_ids(v: Views) -> DataFrame:
    """Chained pairs of each audit (here a customer's findings), numbered in order of discovery."""
    rows = N.chain_pairs(v.findings, ["location"])
    n = F.row_number().over(Window.partitionBy("location").orderBy("a", "b"))
    return rows.select("a", "b", F.concat(F.lit("CHAIN-"), F.lpad(n.cast("string"), 3, "0")).alias("chain"))


_LINE = "'[' || severity || '] ' || id || ': ' || category || ' @ ' || location || ' — ' || CASE WHEN length(d) > 150 THEN substr(d, 1, 150) || '...' ELSE d END"


@query("digest_lines", "findings", f"""WITH l AS (SELECT location, id, severity, length({_LINE}) AS n FROM (SELECT *, repeat(category || ' ', CAST(id % 30 AS INT)) AS d FROM findings)),
    r AS (SELECT *, sum(n + 1) OVER (PARTITION BY location ORDER BY {_RANK}, id ROWS UNBOUNDED PRECEDING) - 1 AS running, count(*) OVER (PARTITION BY location) AS total FROM l)
    SELECT location, count(*) FILTER (running <= 600) AS shown, any_value(total) - count(*) FILTER (running <= 600) AS more FROM r GROUP BY 1""")
def digest_lines(v: Views) -> DataFrame:
    """Lines of each audit's digest within its budget (600 here, 3,000 by default), and how many the overflow line tells of."""
    text = F.repeat(F.concat("category", F.lit(" ")), (F.col("id") % 30).cast("int"))
    short = F.when(F.length(text) > 150, F.concat(F.substring(text, 1, 150), F.lit("..."))).otherwise(text)
    line = F.concat(F.lit("["), "severity", F.lit("] "), F.col("id").cast("string"), F.lit(": "), "category", F.lit(" @ "), "location", F.lit(" — "), short)
    rows = v.findings.select("location", "id", "severity", line.alias("line"))
    kept = budget.hard_prefix(rows, ["location"], [severity_rank("severity"), "id"], F.length("line") + 1, 601).groupBy("location").agg(F.count("*").alias("shown"))
    return rows.groupBy("location").agg(F.count("*").alias("total")).join(kept, "location", "left").select("location", F.coalesce("shown", F.lit(0)).alias("shown"), (F.col("total") - F.coalesce("shown", F.lit(0))).alias("more"))


@query("backoff_schedule", sql="SELECT user_id, attempt, CAST(15 * power(2, attempt - 1) AS BIGINT) AS wait_s FROM (SELECT user_id, unnest(range(1, least(count(*), 4) + 1)) AS attempt FROM events WHERE event_type <> 'view' GROUP BY user_id)")
def backoff_schedule(v: Views) -> DataFrame:
    """Waits before the retries of a task's failures: 15 s, doubled each time, four tries at most."""
    n = v.table("events").filter("event_type <> 'view'").groupBy("user_id").agg(F.count("*").alias("n"))
    rows = n.select("user_id", F.explode(F.sequence(F.lit(1).cast("long"), F.least("n", F.lit(4)))).alias("attempt"))
    return rows.select("user_id", "attempt", (15 * F.pow(F.lit(2), F.col("attempt") - 1)).cast("long").alias("wait_s"))
