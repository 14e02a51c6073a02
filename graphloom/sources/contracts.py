"""Source parser: contracts, functions, variables and their facts from contract source text.

Bodies are matched by braces, which no regular expression can do, so files go through one Arrow-batched function; the
facts come out as typed rows (kind, contract, name, ...), and all further steps are DataFrame operations."""

from __future__ import annotations

import re
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame

_HEAD = re.compile(r"\b(abstract\s+)?(contract|library|interface)\s+(\w+)(?:\s+is\s+([^{]+))?\s*\{")
_FUNCTION = re.compile(r"\bfunction\s+(\w+)\s*\(([^)]*)\)([^;{]*)([;{])")
_VARIABLE = re.compile(r"^\s*((?:mapping\s*\([^;]*?\)|u?int\d*|address|bool|bytes\d*|string)(?:\s*\[\s*\])?)((?:\s+(?:public|private|internal|constant|immutable))*)\s+(\w+)\s*(?:=[^;]*)?;", re.M)
_CALL = re.compile(r"(\w+(?:\.\w+)*)\.(call|delegatecall|staticcall|transfer|send)\s*[({]")
_TOKEN = re.compile(r"\.(transfer|transferFrom|safeTransfer|safeTransferFrom|mint|burn)\s*\(")
_EVENT = re.compile(r"\bemit\s+(\w+)")
_INNER = re.compile(r"\b(_\w+)\s*\(")
_WRITE = r"(?<![\w.]){0}\b(?:\s*\[[^\]]*\])*\s*(?:=(?!=)|\+=|-=|\*=|/=|\+\+|--)|(?:\+\+|--)\s*{0}\b|\bdelete\s+{0}\b|(?<![\w.]){0}\.(?:push|pop)\s*\("
COLUMNS = "path string, kind string, contract string, name string, target string, visibility string, mutability string, modifiers string, params string, line long, line_end long"


def body_end(text: str, brace: int) -> int:
    """Place after the brace that closes the one at `brace`; the end of the text if none does."""
    depth = 0
    for m in re.compile(r"[{}]").finditer(text, brace):
        depth += 1 if m[0] == "{" else -1
        if depth == 0:
            return m.end()
    return len(text)


def line_of(text: str, at: int) -> int:
    return text.count("\n", 0, at) + 1


def parse(path: str, text: str) -> list[tuple]:
    rows: list[tuple] = []
    for head in _HEAD.finditer(text):
        kind, contract = head[2], head[3]
        start, end = head.end(), body_end(text, head.end() - 1)
        body = text[start : end - 1]
        rows.append((path, "abstract" if head[1] else kind, contract, contract, None, None, None, None, None, line_of(text, head.start()), line_of(text, end)))
        rows += [(path, "inherits", contract, contract, p.split("(")[0].strip(), None, None, None, None, line_of(text, head.start()), None) for p in (head[4] or "").split(",") if p.strip()]
        spans, functions = [], []
        for f in _FUNCTION.finditer(body):
            stop = body_end(body, f.end() - 1) if f[4] == "{" else f.end()
            spans.append((f.start(), stop))
            functions.append((f, body[f.end() : stop - 1] if f[4] == "{" else ""))
        top, at = [], 0
        for a, b in spans:
            if a >= at:
                top.append(body[at:a])
                at = b
        variables = [(m[1], m[2], m[3]) for part in [*top, body[at:]] for m in _VARIABLE.finditer(part)]
        rows += [(path, "variable", contract, n, t.strip(), "constant" if "constant" in q else "immutable" if "immutable" in q else None, None, None, None, None, None) for t, q, n in variables]
        for f, own in functions:
            quals = f[3].split()
            sight = next((x for x in ("external", "public", "private", "internal") if x in quals), "internal")
            change = next((x for x in ("view", "pure", "payable") if x in quals), "nonpayable")
            params = [p.split()[-1] for p in f[2].split(",") if len(p.split()) > 1]
            line = line_of(text, start + f.start())
            fact = lambda kind, target, extra=None: (path, kind, contract, f[1], target, extra, None, None, None, line, None)  # noqa: B023, E731
            rows.append((path, "function", contract, f[1], None, sight, change, ",".join(x for x in quals if x.startswith("only") or x == "nonReentrant"), ",".join(params), line, line_of(text, start + f.end() + len(own))))
            for _, _, v in variables:
                if v in params or re.search(rf"\b(?:u?int\d*|address|bool|bytes\d*|string)\s+(?:memory\s+|storage\s+)?{v}\b", own):
                    continue
                if re.search(_WRITE.format(v), own):
                    rows.append(fact("writes", v))
                elif re.search(rf"(?<![\w.]){v}\b", own):
                    rows.append(fact("reads", v))
            rows += [fact("external_call", m[1], "user_input" if m[1].split(".")[0] in params else "state") for m in _CALL.finditer(own)]
            rows += [fact("token_flow", m[1]) for m in _TOKEN.finditer(own)]
            rows += [fact("emits", m[1]) for m in _EVENT.finditer(own)]
            rows += [fact("calls", m[1]) for m in _INNER.finditer(own)]
    return rows


def facts(sources: DataFrame) -> DataFrame:
    """Facts of all files (path, content)."""
    names = [c.split()[0] for c in COLUMNS.split(", ")]

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            yield pd.DataFrame([r for p, t in zip(b["path"], b["content"], strict=True) for r in parse(p, t or "")], columns=names)

    return sources.select("path", "content").mapInPandas(run, COLUMNS)
