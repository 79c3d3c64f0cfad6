"""Functions paired with their documentation.

Every live function or method is a symbol: module, qualified name, normalised
signature. Symbol tables of all files are joined so that documentation that stands
on a bare declaration (a stub file, an overload or a body of only ``...``) meets the
code of the separate definition of the same signature. Code is cut from the source
text in blocks of lines, so that neither a long file nor one with very many
functions is copied per function or gathered in one task. Last, documentation that
tells no more than name and signature do is filtered out.
"""

from __future__ import annotations

import json
import re

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import BooleanType, StringType

from ..operators.intervals import unit_code
from ..operators.scale import cut_table, salted_join

FUNCTION_KINDS = ("function", "async_function")

#: Words that any description of a function may use without saying anything. Fixed values.
FILLER = frozenset(
    """a an the this that these those it its is are was be been will can may does do did which who whose to of for in on with
    and or from by as at into given specified provided passed function functions method methods helper routine procedure utility
    class object objects coroutine wrapper implementation implements return returns returned returning result results value values
    output input inputs outputs take takes taking accept accepts get gets nothing no arg args argument arguments parameter
    parameters param params rtype type types yield yields raise raises kwargs self cls instance just simply basically here
    performs perform executes execute runs run used use uses handles handle code docstring documentation some""".split()
)
#: Names of types that signatures use. Fixed values.
TYPES = frozenset("str int float bool bytes list dict set tuple none iterator iterable sequence mapping optional any path object union callable generator async awaitable frozenset type bytearray complex".split())

_DIRECTIVE = re.compile(r"(#\s*)?(noqa|pylint|flake8|type:\s*ignore|fmt:|pragma|mypy:|pyright|isort:|nosec|ruff:|yapf:|eslint|nolint|doctest:|coverage:|-\*-|vim?:)", re.I)
_BARE = re.compile(r"(none|null|nil|n\s*/?\s*a|tbd|tba|wip|xxx+|todo|fixme|hack|undocumented|obvious|trivial|inherited|ditto|pendiente|undokumentiert|unknown|untitled|empty|blank|doc|docs)", re.I)
_PLACEHOLDER = re.compile(
    r"(todo|fixme|tbd|tba|xxx|wip|hack)\b"
    r"|(placeholder|lorem ipsum|undocumented|coming soon|work in progress|self[- ]explanatory|obvious(ly)?\W*$|as the name (says|suggests|implies)|name says it all)"
    r"|(please )?(add|insert|write|fill in|provide|needs?|missing|no|without|put)\b[^.]{0,24}\b(doc|docs|docstring|documentation|description|summary|comment|comments|text)\b[^.]{0,45}$"
    r"|(a |the |this |more |some |short |long |longer |brief )*(summary|description|docstring|documentation|text|comment|details)( line)? (goes|go|comes|to follow|to come|follows|here|pending|missing|was left|is left|left|will|is to be|to be|needed)\b"
    r"|(not (yet )?(documented|described|written)|to be (done|written|documented|described|determined|completed|added|defined))\b"
    r"|describe (what|how|the|this)|explain (what|how) this"
    r"|(à (compléter|faire|documenter)|a completar|por (hacer|documentar|completar|definir)|noch (offen|zu)|folgt( noch)?\W*$|(beschreibung|doku\w*) (folgt|fehlt|fehlend)|sin (descripción|documentar)|da (fare|completare))",
    re.I,
)
_BOILERPLATE = re.compile(
    r"(@?author(s|ed)?\b|copyright\b|\(c\)|©|licen[cs]e[d]?\b|spdx|all rights reserved|(created|written|added|modified|updated|maintained) (on|by|at)\b"
    r"|last (modified|updated|changed)|(auto(matically)?[- ]?)?generated (by|from|stub|code|file|on)\b|auto[- ]?generated|do not (edit|modify)|@?since:?\s+v?\d|@(since|version|date|todo|see)\b|version:?\s+v?\d|maintainer\b|date:)",
    re.I,
)
_POINTER = re.compile(r"(see( also)?|same as|cf\b\.?|refer to|compare|inherited from|inherits from|as (above|below|in)\b|like|overrides|siehe|véase|voir|ver)\b", re.I)
_FIELD = re.compile(r":(param|type|arg|argument|return|returns|rtype|raises|yield|yields|keyword|key)\b[^:]*:|@(param|return|returns|throws|type)\b", re.I)
_WORD = re.compile(r"[^\W\d_]+|\d+")


def _split_name(name: str) -> list[str]:
    return [w.lower() for w in re.findall(r"[A-Z]+(?![a-z])|[A-Z]?[^\W\d_A-Z]+|\d+", name or "")]


def _known(word: str, stems: frozenset[str], full: frozenset[str]) -> bool:
    """Whether a word is one of a name's words, inflected or not."""
    return word in full or _stem(word) in stems or (word.endswith("s") and _stem(word[:-1]) in stems)


def _stem(word: str) -> str:
    for end in ("ations", "ation", "ings", "ing", "ies", "ied", "ers", "er", "ed", "es", "s", "e", "y"):
        if word.endswith(end) and len(word) - len(end) >= 3:
            word = word[: -len(end)]
            break
    if len(word) > 3 and word[-1] == word[-2]:
        word = word[:-1]
    return word[:-1] if len(word) > 3 and word[-1] in "ei" else word


def tells_more(doc: str | None, name: str, qualname: str = "", signature: str = "", parameters: str = "", returns: str = "") -> bool:
    """Whether documentation states something that name, parameters and types don't.

    Sentence by sentence: decoration, tool directives, placeholders, file boilerplate
    and bare pointers state nothing, nor does a sentence whose words are all words of
    the name, the parameters, the types or filler. Null or blank documentation is False.
    """
    if not doc or not doc.strip():
        return False
    names = _split_name(name) + _split_name(qualname) + _split_name(signature) + _split_name(returns)
    try:
        for p in json.loads(parameters) if parameters else []:
            names += _split_name(str(p.get("name", ""))) + _split_name(str(p.get("type", "")))
    except (ValueError, AttributeError):
        pass
    full = frozenset(names) | FILLER | TYPES
    stems = frozenset(_stem(w) for w in names)
    text = _FIELD.sub(" . ", re.sub(r"\bcf\.", "cf", doc.strip(), flags=re.I))
    text = re.sub(r"\b(Args|Arguments|Parameters|Params|Returns?|Yields?|Raises|Attributes|Notes?|Examples?)\s*:", " . ", text)
    for sentence in re.split(r"(?<=[.!?…])[\s`'\")\]]+|\s\.\s|\n\s*\n", text):
        bare = sentence.strip(" \t\r\n.!?…*#=~-_—–`'\"()[]{}<>:;,|/\\+")
        words = [w.lower() for w in _WORD.findall(bare)]
        if not any(w.isalpha() for w in words) or _DIRECTIVE.match(bare) or _BARE.fullmatch(bare) or _PLACEHOLDER.match(bare) or _BOILERPLATE.match(sentence.strip()) or _BOILERPLATE.match(bare):
            continue
        if _POINTER.match(bare) and len(words) <= 6 and ":" not in bare:
            continue
        if any(not _known(w, stems, full) for w in words if w.isalpha()):
            return True
    return False


@F.pandas_udf(BooleanType())
def _tells_more(doc: pd.Series, name: pd.Series, qualname: pd.Series, signature: pd.Series, parameters: pd.Series, returns: pd.Series) -> pd.Series:
    rows = zip(*(s.fillna("") for s in (doc, name, qualname, signature, parameters, returns)))
    return pd.Series([tells_more(*r) for r in rows])


def module_key(path: Column) -> Column:
    """Module of a path: without source and stub roots, suffix and __init__."""
    bare = F.regexp_replace(F.regexp_replace(path, r"^(\./)?((src|lib|stubs|typings)/)?", ""), r"\.pyi?$", "")
    return F.regexp_replace(F.regexp_replace(bare, r"(^|/)__init__$", ""), "/", ".")


#: A string literal, the word lambda, a bracket, or a mark that ends a name or a parameter.
_SIGNATURE = re.compile(
    r"""(?P<text>"(?:[^"\\]|\\.)*"|'(?:[^'\\]|\\.)*')|(?P<function>\blambda\b)|(?P<open>[\[({])|(?P<close>[\])}])|(?P<mark>->|[:=,])""", re.S
)


def parameter_names(signature: str | None) -> str:
    """The parameters of a signature by name, with their stars, joined by commas: types,
    defaults, return type and white space don't count, nor do the bare separators / and *.
    Brackets may nest to any depth and defaults may hold any text. A signature without
    parameters and null give ''."""
    text = signature or ""
    at = text.find("(")
    if at < 0:
        return ""
    names, name, depth, lambdas, named, begin = [], "", 0, 0, True, at + 1
    for m in _SIGNATURE.finditer(text, at + 1):
        if m.lastgroup == "open":
            if not depth and named:
                name += text[begin : m.start()]
            depth, named = depth + 1, named and depth > 0
        elif m.lastgroup == "close" and depth:
            depth -= 1
        elif depth or m.lastgroup == "text":
            continue
        elif m.lastgroup == "function":
            lambdas += 1
        elif lambdas and m.lastgroup == "mark":
            lambdas -= m.group() == ":"  # its own parameters end here
        else:
            if named:
                name += text[begin : m.start()]
            if m.lastgroup == "close" or m.group() == ",":
                names.append("".join(name.split()))
                name, named, begin = "", True, m.end()
                if m.lastgroup == "close":
                    break
            else:
                named = False
    return ",".join(n for n in names if n.strip("*/"))


@F.pandas_udf(StringType())
def normal_signature(signature: pd.Series) -> pd.Series:
    return signature.map({v: parameter_names(v) for v in signature.unique()})


def live_functions(units: DataFrame) -> DataFrame:
    """Current versions, not removed, of functions and methods, once each."""
    keys = units.where("unit_id is not null").groupBy("unit_id").agg(F.max(F.struct("run_id", "ingested_at", F.coalesce("removed", F.lit(False)).alias("removed"), "kind")).alias("v"))
    live = keys.where(~F.col("v.removed") & F.col("v.kind").isin(*FUNCTION_KINDS)).select("unit_id", F.col("v.run_id").alias("run_id"), F.col("v.ingested_at").alias("seen_at"))
    wide = units.where(F.col("kind").isin(*FUNCTION_KINDS)).select(
        "unit_id", "run_id", "ingested_at", "path", "kind", "name", "qualname", "signature", "parameters_json", "returns", "purpose", "doc_text", "start_line", "end_line"
    )
    same = (wide["unit_id"] == live["unit_id"]) & (wide["run_id"] == live["run_id"]) & wide["ingested_at"].eqNullSafe(live["seen_at"])
    return wide.join(live.hint("shuffle_merge"), same).drop(live["unit_id"]).drop(live["run_id"]).drop("seen_at", "ingested_at").dropDuplicates(["unit_id"])


def is_stub(path: Column, code: Column) -> Column:
    """Whether code only declares: in a stub file, or without any body but documentation."""
    body = F.regexp_replace(F.regexp_replace(code, r'(?s)("""|\'\'\').*?\1', ""), r"(?m)^\s*(@.*|#.*)$", "")
    return F.coalesce(path.endswith(".pyi") | body.rlike(r"(?s)^\s*(async\s+)?def\s.*:\s*(\.\.\.|pass|raise\s+NotImplementedError(\(.*\))?)\s*$"), F.lit(False))


def definition_symbols(symbols: DataFrame, stubs: DataFrame) -> DataFrame:
    """(symbol_key, definition): per symbol of ``stubs`` the unit that defines it, the first
    in its file. ``symbols`` are the units with a body."""
    wanted = stubs.select("module", "symbol").distinct()
    near = symbols.join(wanted, ["module", "symbol"], "left_semi").withColumn("shape", normal_signature("signature"))
    first = F.min(F.struct("start_line", "unit_id"))["unit_id"]
    return near.groupBy(symbol_key()).agg(first.alias("definition"))


def symbol_key() -> Column:
    return F.concat_ws("\u0000", "module", "symbol", F.coalesce("shape", F.lit(""))).alias("symbol_key")


def doc_pairs(units: DataFrame, sources: DataFrame) -> DataFrame:
    """unit_id, qualname, signature, description, code, code_unit_id: one row per live
    function or method whose documentation tells more than its name and signature do and
    whose code is in ``sources``.

    The description is doc_text, or purpose where that is null or blank. Two symbol tables
    of all files are joined: the documented declarations and the units with a body. A
    declaration that has a body meets its own code by unit_id. A bare one (a stub file, an
    overload, a body of only ``...``) meets the definition of the same module, qualified
    name and normalised signature, the first in its file; where no file has one, its own
    lines are its code. A declaration without any code gives no pair. Neither many
    declarations of one symbol nor a long file are gathered in one task: definitions are
    reduced to one per symbol before the join, and hot symbols are spread. Empty tables
    give no rows; extra columns are ignored.
    """
    base = F.regexp_replace("qualname", r"#\d+$", "")
    text = F.when(F.regexp_replace("doc_text", r"(?U)\s+", "") != "", F.col("doc_text")).otherwise(F.col("purpose"))
    symbols = live_functions(units).drop("run_id", "kind").withColumn("module", module_key(F.col("path"))).withColumn("symbol", base).withColumn("description", text).drop("doc_text", "purpose")
    symbols = cut_table(symbols, "functions").df
    coded = symbols.join(unit_code(symbols, sources), "unit_id").withColumn("is_stub", is_stub(F.col("path"), F.col("code")))
    table = cut_table(coded, "symbols").df
    documented = F.regexp_replace("description", r"(?U)\s+", "") != ""
    filed = table.where(documented)
    own = filed.where("not is_stub").withColumn("code_unit_id", F.col("unit_id"))

    # Stubs whose lines are in no source file are declarations too.
    bare = filed.where("is_stub").unionByName(symbols.where(documented).join(table.select("unit_id"), "unit_id", "left_anti").withColumns({"code": F.lit(None).cast("string"), "is_stub": F.lit(True)}))
    declared = bare.withColumn("shape", normal_signature("signature")).withColumn("symbol_key", symbol_key())
    bodies = table.where("not is_stub").select("unit_id", "module", "symbol", "signature", "start_line")
    found = definition_symbols(bodies, bare)
    linked = cut_table(salted_join(declared, found, "symbol_key", "left", spread=F.xxhash64("unit_id")), "declared").df
    lent = linked.where("definition is not null").drop("code").join(table.select(F.col("unit_id").alias("definition"), "code"), "definition")
    alone = linked.where("definition is null and code is not null")
    columns = ["unit_id", "name", "qualname", "signature", "parameters_json", "returns", "description", "code", "code_unit_id"]
    pairs = own.select(columns).unionByName(lent.withColumn("code_unit_id", F.col("definition")).select(columns)).unionByName(alone.withColumn("code_unit_id", F.col("unit_id")).select(columns))
    kept = pairs.where(_tells_more("description", "name", "qualname", "signature", "parameters_json", "returns"))
    return kept.select("unit_id", "qualname", "signature", "description", "code", "code_unit_id")
