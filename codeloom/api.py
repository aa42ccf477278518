"""Method names to plan builders: the request surface of the engine over the canonical tables.

A request is a method name with parameters; the answer is a DataFrame. ``tables`` has the canonical tables by
name (occurrences, entities, scopes, edges, includes, lines, ...). Parameters that a method does not know, and
missing ones, are errors that name the parameter.
"""

from __future__ import annotations

import inspect
from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .functions import fuzzy, names
from .operators import delta, graph, locate, tokens, xref
from .schema import CAP_RESULTS, CAP_SYMBOLS, LINE, OUTLINE_EXCLUDES, has_roles

Tables = dict[str, DataFrame]


class UnknownMethod(KeyError):
    """No such method."""


class InvalidParams(ValueError):
    """A parameter is missing, unknown or of the wrong kind."""


METHODS: dict[str, Callable[..., DataFrame]] = {}


def method(*own: str) -> Callable:
    def add(f: Callable[..., DataFrame]) -> Callable[..., DataFrame]:
        for name in own:
            METHODS[name] = f
        return f

    return add


def call(name: str, tables: Tables, **params: object) -> DataFrame:
    if name not in METHODS:
        raise UnknownMethod(name)
    known = inspect.signature(METHODS[name]).parameters
    if odd := sorted(set(params) - set(known)):
        raise InvalidParams(f"{name}: unknown parameter /{odd[0]}")
    if lost := [p for p, x in known.items() if p != "t" and x.default is x.empty and p not in params]:
        raise InvalidParams(f"{name}: missing parameter /{lost[0]}")
    return METHODS[name](tables, **params)


def _targets(t: Tables, cursors: DataFrame) -> DataFrame:
    return xref.first_symbol(cursors, t["occurrences"])


@method("textDocument/references")
def references(t: Tables, cursors: DataFrame, include_declaration: bool = False, role: int = 0, exclude_role: int = 0, folders: list[str] | None = None, base: bool = True) -> DataFrame:
    """Uses of the first symbol at each cursor; of functions also those of everything they override."""
    targets = _targets(t, cursors)
    if base:
        edges = t["edges"].where("etype = 'base'").select("src", "dst")
        up = graph.closure(targets.where("ekind = 3").select(F.col("usr").alias("root")).distinct(), edges)
        more = targets.join(up, targets["usr"] == up["root"]).select("cursor_id", F.col("node").alias("usr"), "ekind")
        targets = targets.unionByName(more).distinct()
    occ = t["occurrences"]
    if folders:
        own = t["files"].where(" or ".join(f"startswith(path, '{f.rstrip('/')}/')" for f in folders)).select("file_id")
        occ = occ.join(own, "file_id", "left_semi")
    return xref.references(targets, occ, role, exclude_role, include_declaration, CAP_RESULTS)


@method("textDocument/definition")
def definition(t: Tables, cursors: DataFrame) -> DataFrame:
    return xref.definitions(_targets(t, cursors), t["entities"], t["occurrences"], cursors)


@method("textDocument/declaration")
def declaration(t: Tables, cursors: DataFrame) -> DataFrame:
    return xref.declarations_except(_targets(t, cursors), t["occurrences"], cursors)


@method("textDocument/typeDefinition")
def type_definition(t: Tables, cursors: DataFrame) -> DataFrame:
    """The type of a variable, or what a type is an alias of."""
    edges = t["edges"].where("etype in ('var_type', 'alias')").select(F.col("src").alias("usr"), F.col("dst").alias("to"))
    return _targets(t, cursors).join(edges, "usr").select("cursor_id", F.col("to").alias("usr")).join(t["entities"], "usr").select("cursor_id", "usr", "file_id", "spell_start_p", "spell_end_p")


@method("textDocument/documentHighlight")
def highlight(t: Tables, cursors: DataFrame) -> DataFrame:
    return xref.highlights(cursors, t["occurrences"])


@method("textDocument/rename")
def rename(t: Tables, cursors: DataFrame, new_name: str) -> DataFrame:
    edits = xref.rename_edits(_targets(t, cursors), t["occurrences"], t["lines"], t["entities"].select("usr", "name"))
    return edits.withColumn("new_text", F.lit(new_name))


@method("textDocument/hover")
def hover(t: Tables, cursors: DataFrame) -> DataFrame:
    met = _targets(t, cursors).join(t["entities"], ["usr", "ekind"])
    return met.groupBy("cursor_id").agg(F.max_by("name", F.length("name")).alias("hover"))


@method("textDocument/documentSymbol")
def document_symbol(t: Tables, exclude_role: int = OUTLINE_EXCLUDES, start_line: int = -1, end_line: int = -1) -> DataFrame:
    own = locate.live(t["occurrences"]).where(has_roles(F.col("role"), 0, exclude_role))
    if start_line >= 0:
        own = own.where((F.col("start_p") >= start_line * LINE) & (F.col("start_p") < (end_line + 1) * LINE))
    return own.select("file_id", "usr", "ekind", "start_p", "end_p", "role")


@method("textDocument/foldingRange")
def folding(t: Tables) -> DataFrame:
    return locate.live(t["occurrences"]).where("ekind in (2, 3) and ext_start_p is not null").select("file_id", "ext_start_p", "ext_end_p").distinct()


@method("textDocument/documentLink")
def document_link(t: Tables) -> DataFrame:
    return t["includes"].select("file_id", "line", names.to_uri(F.col("resolved_path")).alias("target"))


@method("textDocument/semanticTokens/full", "textDocument/semanticTokens/range")
def semantic_tokens(t: Tables, range_: object = None) -> DataFrame:
    """Delta-coded tokens of whole files; a range makes no difference."""
    return tokens.delta_encode(locate.live(t["occurrences"])).select("file_id", "start_p", "d_line", "d_col", "len", "role")


@method("textDocument/codeLens")
def code_lens(t: Tables) -> DataFrame:
    edges = t["edges"]
    count = lambda etype, name: edges.where(F.col("etype") == etype).groupBy(F.col("src").alias("usr")).agg(F.count("*").alias(name))
    refs = locate.live(t["occurrences"]).where("role & 3 = 0").groupBy("usr").agg(F.count("*").alias("ref"))
    counts = t["entities"].select("usr").distinct().join(refs, "usr", "left").join(count("base", "base"), "usr", "left").join(count("derived", "derived"), "usr", "left").fillna(0)
    return xref.code_lens(t["entities"].select("usr").distinct(), counts)


@method("$xref/navigate")
def navigate(t: Tables, cursors: DataFrame, direction: str) -> DataFrame:
    return locate.navigate(cursors, t["scopes"], direction[:1] if direction[:1] in "DLR" else "U")


@method("$xref/call", "callHierarchy/outgoingCalls")
def calls(t: Tables, roots: DataFrame, callee: bool = True, levels: int = 1) -> DataFrame:
    """Callees, or callers, of the roots (column root), level by level."""
    edges = t["edges"].where("etype = 'callee'")
    own = edges.select("src", "dst") if callee else edges.select(F.col("dst").alias("src"), F.col("src").alias("dst"))
    return graph.tree(roots, own, levels)


@method("callHierarchy/incomingCalls")
def incoming(t: Tables, roots: DataFrame) -> DataFrame:
    return calls(t, roots, callee=False)


@method("$xref/inheritance", "textDocument/implementation")
def inheritance(t: Tables, roots: DataFrame, derived: bool = True, levels: int = 1) -> DataFrame:
    return graph.tree(roots, t["edges"].where(F.col("etype") == ("derived" if derived else "base")).select("src", "dst"), levels)


@method("$xref/member")
def member(t: Tables, roots: DataFrame) -> DataFrame:
    """Members with offsets of the roots and of all their bases; a base that is reached twice gives its members twice."""
    up = graph.full_tree(roots, t["edges"].where("etype = 'base'").select("src", "dst"))
    owners = roots.select("root", F.col("root").alias("node")).unionByName(up.select("root", "node"))
    fields = t["edges"].where("etype = 'member'").select(F.col("src").alias("node"), F.col("dst").alias("member"), "offset_bits", "ord")
    return owners.join(fields, "node").select("root", F.col("node").alias("owner"), "member", "offset_bits", "ord")


@method("$xref/vars")
def vars_(t: Tables, cursors: DataFrame) -> DataFrame:
    """Instances of the type at the cursor, or of the type of the variable there."""
    at = _targets(t, cursors)
    to_type = t["edges"].where("etype = 'var_type'").select(F.col("src").alias("usr"), F.col("dst").alias("type_usr"))
    types = at.join(to_type, "usr", "left").select("cursor_id", F.coalesce("type_usr", "usr").alias("src"))
    return types.join(t["edges"].where("etype = 'instance'").select("src", "dst"), "src").select("cursor_id", F.col("dst").alias("usr"))


@method("$xref/info")
def info(t: Tables) -> DataFrame:
    return t["entities"].groupBy("ekind").agg(F.countDistinct("usr").alias("n"))


@method("$xref/fileInfo")
def file_info(t: Tables, includes: bool = False) -> DataFrame:
    own = t["files"]
    return own.join(t["includes"].groupBy("file_id").agg(F.collect_list("resolved_path").alias("includes")), "file_id", "left") if includes else own


@method("workspace/symbol")
def workspace_symbol(t: Tables, query: str, sensitivity: int = 1, most: int = CAP_SYMBOLS) -> DataFrame:
    """Candidates in entity order up to the cap, then ranked by score."""
    order = F.when(F.col("ekind") == 3, 0).when(F.col("ekind") == 2, 1).otherwise(2)
    own = t["entities"].where(F.col("name").rlike(names.subsequence_pattern(query.replace(" ", ""), sensitivity))).orderBy(order, "file_id", "spell_start_p").limit(most)
    scored = own.withColumn("score", fuzzy.score(query, F.col("name"), sensitivity)).where(F.col("score") > fuzzy.MIN_SCORE)
    return scored.orderBy(F.desc("score"), "ekind", "name", "usr")


@method("workspace/executeCommand")
def execute(t: Tables, usr: int, field: str) -> DataFrame:
    """One of a lens's commands: uses, bases, derived or instances of a symbol."""
    if field == "uses":
        return locate.live(t["occurrences"]).where((F.col("usr") == usr) & (F.col("role").bitwiseAND(3) == 0)).select("file_id", "start_p", "end_p")
    etype = {"bases": "base", "derived": "derived", "instances": "instance"}.get(field)
    if etype is None:
        raise InvalidParams(f"workspace/executeCommand: /field is none of uses, bases, derived, instances: {field}")
    return t["edges"].where((F.col("src") == usr) & (F.col("etype") == etype)).select(F.col("dst").alias("usr"))


@method("workspace/didChangeWatchedFiles")
def watched(t: Tables, events: DataFrame, cache: str = "") -> DataFrame:
    """The last event of each path (path, seq, change) that is worth an index run."""
    p = F.col("path")
    own = events.where((names.language(p)["language"] >= 0) & ~p.startswith("."))
    return delta.latest(own.where(~p.startswith(cache)) if cache else own, ["path"], ["seq"])
