"""Client calls in script files, by a tokenizer and the structure of brackets.

A script becomes tokens (names, strings, templates, marks) with the partner of every
bracket; comments and regular expressions are told apart from code, and code inside a
template's ${...} is looked at like any other. Calls are classified in two steps: each
file gives its calls and the names of its own wrappers of fetch, and a join brings the
wrappers of all files to the calls.
"""

from __future__ import annotations

import re
from bisect import bisect_right
from dataclasses import dataclass

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators.scale import spread

#: Methods of axios that name a verb. Fixed values.
VERBS = ("delete", "get", "head", "options", "patch", "post", "put")
_PARTS = re.compile(
    r"(?P<skip>\s+|//[^\n]*|/\*.*?(?:\*/|\Z))|(?P<name>[A-Za-z_$\u0080-\uffff][\w$\u0080-\uffff]*)|(?P<number>\.?\d[\w.]*)"
    r"|(?P<string>'(?:[^'\\\n]|\\.)*'|\"(?:[^\"\\\n]|\\.)*\")|(?P<mark>=>|\?\.|\.\.\.|[=!]==?|[-+*%&|^<>]=|.)",
    re.S,
)
_REGEX = re.compile(r"/(?:[^/\\\[\n]|\\.|\[(?:[^\]\\\n]|\\.)*\])+/\w*")
_OPEN, _CLOSE = "([{", ")]}"


@dataclass
class Token:
    kind: str
    text: str
    at: int
    pair: int = -1


def _template_end(text: str, at: int, codes: list[tuple[int, int]]) -> int:
    """The end of the template that begins at ``at``; its ${...} go to ``codes``."""
    k = at + 1
    while k < len(text):
        if text[k] == "\\":
            k += 2
        elif text[k] == "`":
            return k + 1
        elif text.startswith("${", k):
            depth, k = 1, k + 2
            begin = k
            while k < len(text) and depth:
                if text[k] == "`":
                    k = _template_end(text, k, [])
                    continue
                m = _PARTS.match(text, k)
                if m.lastgroup == "mark":
                    depth += (m.group() == "{") - (m.group() == "}")
                k = m.end()
            codes.append((begin, k - 1))
        else:
            k += 1
    return k


def tokens_of(text: str, begin: int = 0, end: int | None = None) -> list[list[Token]]:
    """The tokens of a script, and of each piece of code inside its templates."""
    end = len(text) if end is None else end
    own: list[Token] = []
    codes: list[tuple[int, int]] = []
    opened: list[int] = []
    k = begin
    while k < end:
        if text[k] == "`":
            stop = min(_template_end(text, k, codes), end)
            own.append(Token("template", text[k:stop], k))
            k = stop
            continue
        if text[k] == "/" and not text.startswith(("//", "/*"), k):
            last = own[-1] if own else None
            value = last and (last.kind in ("number", "string", "template") or last.text in _CLOSE or (last.kind == "name" and last.text not in ("return", "typeof", "case", "in", "of", "delete", "void")))
            m = None if value else _REGEX.match(text, k)
            if m:
                own.append(Token("regex", m.group(), k))
                k = m.end()
                continue
        m = _PARTS.match(text, k)
        k = m.end()
        if m.lastgroup == "skip":
            continue
        token = Token(m.lastgroup, m.group(), m.start())
        if token.kind == "mark" and token.text in _OPEN:
            opened.append(len(own))
        elif token.kind == "mark" and token.text in _CLOSE and opened and _OPEN.index(own[opened[-1]].text) == _CLOSE.index(token.text):
            token.pair = opened.pop()
            own[token.pair].pair = len(own)
        own.append(token)
    return [own] + [s for a, b in codes for s in tokens_of(text, a, b)]


def _arguments(toks: list[Token], at: int) -> list[list[Token]]:
    """The arguments between the bracket at ``at`` and its partner."""
    out: list[list[Token]] = [[]]
    k = at + 1
    while k < toks[at].pair:
        t = toks[k]
        if t.text == "," and t.kind == "mark":
            out.append([])
        else:
            out[-1].append(t)
            if t.pair > k:
                out[-1] += toks[k + 1 : t.pair + 1]
                k = t.pair
        k += 1
    return [a for a in out if a]


def _calls(toks: list[Token]):
    """(index of the name, index of the bracket) of the calls of names and members."""
    for k in range(len(toks) - 1):
        t, n = toks[k], toks[k + 1]
        if t.kind != "name" or n.text != "(" or n.pair < 0:
            continue
        before = toks[k - 1].text if k else ""
        earlier = toks[k - 2].text if k > 1 else ""
        after = toks[n.pair + 1].text if n.pair + 1 < len(toks) else ""
        declared = before == "function" or (before == "*" and earlier == "function") or before == "new"
        method = after == "{" and before not in (".", "?.", "=", "(", ",", "return", "await", "=>")
        if not declared and not method and t.text not in ("if", "for", "while", "switch", "catch", "return", "function"):
            yield k, k + 1


def _start(toks: list[Token], k: int) -> int:
    """The first token of the chain that ends in the name at ``k``."""
    while k > 1 and toks[k - 1].text in (".", "?."):
        k -= 2
        while toks[k].text in (")", "]") and toks[k].pair >= 0:
            k = toks[k].pair
            if k and (toks[k - 1].kind == "name" or toks[k - 1].text in (")", "]")):
                k -= 1
            else:
                break
    return k


def _literal(argument: list[Token]) -> str | None:
    return argument[0].text[1:-1] if len(argument) == 1 and argument[0].kind in ("string", "template") else None


def _stated_method(argument: list[Token]) -> str:
    """The literal ``method`` of an options object."""
    if len(argument) < 2 or argument[0].text != "{" or argument[-1].text != "}":
        return ""
    body = [*argument[1:-1], Token("mark", ",", -1)]
    pair: list[Token] = []
    depth = 0
    for t in body:
        depth += (t.text in _OPEN) - (t.text in _CLOSE) if t.kind == "mark" else 0
        if t.text == "," and not depth and t.kind == "mark":
            if len(pair) == 3 and pair[0].text.strip("'\"") == "method" and pair[1].text == ":" and pair[2].kind in ("string", "template"):
                return pair[2].text[1:-1].upper()
            pair = []
        else:
            pair.append(t)
    return ""


def _first_parameter(parameters: list[Token]) -> str:
    named = parameters and parameters[0].kind == "name" and (len(parameters) == 1 or parameters[1].text in (",", "="))
    return parameters[0].text if named else ""


def _expression_end(toks: list[Token], k: int, text: str) -> int:
    """Where the expression that begins at ``k`` ends."""
    while k < len(toks):
        t = toks[k]
        if t.kind == "mark" and (t.text in ",;" or t.text in _CLOSE):
            return k
        k = t.pair + 1 if t.pair > k else k + 1
        if k < len(toks) and toks[k].kind == "name" and (toks[k - 1].kind != "mark" or toks[k - 1].text in _CLOSE) and "\n" in text[toks[k - 1].at : toks[k].at]:
            return k
    return k


def _functions(toks: list[Token], text: str):
    """(name, first parameter, tokens of the body) of named functions: declarations and
    variables that hold a function or an arrow."""
    for k, t in enumerate(toks):
        if t.text == "function" and k + 2 < len(toks) and toks[k + 1].kind == "name" and toks[k + 2].text == "(" and toks[k + 2].pair > 0:
            name, at = toks[k + 1].text, k + 2
        elif t.kind == "name" and k + 2 < len(toks) and toks[k + 1].text == "=" and k and (toks[k - 1].text in ("const", "let", "var") or toks[k - 1].text == ","):
            name, at = t.text, k + 2
            at += toks[at].text == "async"
            if at < len(toks) and toks[at].text == "function":
                at += 1 + (at + 1 < len(toks) and toks[at + 1].kind == "name")
        else:
            continue
        if at >= len(toks):
            continue
        if toks[at].text == "(" and toks[at].pair > 0:
            parameters, after = toks[at + 1 : toks[at].pair], toks[at].pair + 1
        elif toks[at].kind == "name" and at + 1 < len(toks) and toks[at + 1].text == "=>":
            parameters, after = [toks[at]], at + 1
        else:
            continue
        if after < len(toks) and toks[after].text == "=>":
            after += 1
            end = toks[after].pair if after < len(toks) and toks[after].text == "{" else _expression_end(toks, after, text)
        elif after < len(toks) and toks[after].text == "{":
            end = toks[after].pair
        else:
            continue
        yield name, _first_parameter(parameters), toks[after : end + 1 if end > 0 else len(toks)], after


def wrappers_of(text: str) -> set[str]:
    """Names of functions that hand their first parameter to fetch as its first argument."""
    found = set()
    for toks in tokens_of(text):
        fetches = [(k, at) for k, at in _calls(toks) if toks[k].text == "fetch"]
        for name, parameter, body, begin in _functions(toks, text):
            for k, at in fetches:
                if parameter and begin <= k < begin + len(body):
                    first = _arguments(toks, at)[:1]
                    if first and len(first[0]) == 1 and first[0][0].kind == "name" and first[0][0].text == parameter:
                        found.add(name)
    return found


def calls_of(path: str, text: str) -> list[dict]:
    """Calls with an argument that may be client calls: path, line, callee, verb ('' if only
    an option states it), client (fetch and axios themselves), url, method. Literal urls of
    other hosts are left out; a computed url is ''."""
    ends = [m.start() for m in re.finditer("\n", text)]
    out = []
    for toks in tokens_of(text):
        for k, at in _calls(toks):
            arguments = _arguments(toks, at)
            if not arguments:
                continue
            member = k > 1 and toks[k - 1].text in (".", "?.")
            callee = toks[k].text.lower() if member else toks[k].text
            verb = callee.upper() if member and callee in VERBS and toks[k - 2].text.endswith("axios") else ""
            url = _literal(arguments[0])
            if url is not None and (not url.startswith("/") or url.startswith("//")):
                continue
            method = verb or (_stated_method(arguments[1]) if len(arguments) > 1 else "") or "GET"
            client = bool(verb) or callee == "fetch" or (not member and callee == "axios")
            out.append({"path": path, "line": bisect_right(ends, toks[_start(toks, k)].at - 1) + 1, "callee": callee, "client": client, "url": url or "", "method": method})
    return out


def script_wrappers(files: DataFrame) -> DataFrame:
    """(name): wrappers of fetch that any script of ``files`` (path, text) defines."""

    def run(batches):
        for pdf in batches:
            yield pd.DataFrame({"name": sorted({w for t in pdf["text"] for w in wrappers_of(t)})}, dtype="object")

    return spread(files.where(F.contains("text", F.lit("fetch"))).select("path", "text")).mapInPandas(run, "name string").distinct()


def scan_scripts(files: DataFrame) -> DataFrame:
    """path, line, url, method of the client calls of all script files (path, text): calls
    of fetch and axios, and of functions that any file defines as a wrapper of fetch."""

    def run(batches):
        for pdf in batches:
            rows = [r for p, t in zip(pdf["path"], pdf["text"]) for r in calls_of(p, t)]
            yield pd.DataFrame(rows, columns=["path", "line", "callee", "client", "url", "method"])

    some = files.where("path is not null and text is not null")
    calls = spread(some.select("path", "text")).mapInPandas(run, "path string, line int, callee string, client boolean, url string, method string")
    wrapped = calls.where("not client").join(script_wrappers(some).withColumnRenamed("name", "callee"), "callee", "left_semi")
    return calls.where("client").unionByName(wrapped).select("path", "line", "url", "method")
