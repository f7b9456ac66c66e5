"""The query language over targets: text to syntax tree, tree to text, and tree to a Column.

    or := and ("||" and)*;  and := not ("&&" not)*;  not := "!" not | atom
    atom := "(" or ")" | function "(" [argument] ")" | pattern
"""

from __future__ import annotations

import functools
import operator
import re
from collections import Counter
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from loomgraph.functions import paths
from loomgraph.functions.address import Address, parse_address
from loomgraph.functions.paths import join_rel_checked

MOST_NESTED = 256


@dataclass(frozen=True)
class Node:
    """kind is package, prefix, addr, label, tree_output (with value), not, and, or (with nodes)."""

    kind: str
    value: str = ""
    nodes: tuple[Node, ...] = ()


class QueryError(ValueError):
    pass


_TOKEN = re.compile(r'\s*(?:(&&|\|\||[!()])|"([^"]*)"|([^\s"()!&|]+))')


def tokenize(text: str) -> list[tuple[str, str]]:
    """(operator or 'word', text) pairs."""
    out, at = [], 0
    text = text.rstrip()
    while at < len(text):
        m = _TOKEN.match(text, at)
        if not m:
            raise QueryError(f"unexpected {text[at:].lstrip()[:1]!r} at {at} in {text!r}")
        out.append((m[1], m[1]) if m[1] else ("word", m[2] if m[2] is not None else m[3]))
        at = m.end()
    return out


class _Parser:
    def __init__(self, text: str, base: str):
        self.tokens, self.at, self.base, self.nested = tokenize(text), 0, base, 0

    def next_is(self, kind: str) -> bool:
        return self.at < len(self.tokens) and self.tokens[self.at][0] == kind

    def take(self) -> tuple[str, str]:
        if self.at == len(self.tokens):
            raise QueryError("the query ends too early")
        self.at += 1
        return self.tokens[self.at - 1]

    def chain(self, sign: str, kind: str, part) -> Node:
        nodes = [part()]
        while self.next_is(sign):
            self.take()
            nodes.append(part())
        return nodes[0] if len(nodes) == 1 else Node(kind, nodes=tuple(nodes))

    def either(self) -> Node:
        return self.chain("||", "or", lambda: self.chain("&&", "and", self.negation))

    def negation(self) -> Node:
        self.nested += 1
        if self.nested > MOST_NESTED:
            raise QueryError(f"nested more than {MOST_NESTED} deep")
        if self.next_is("!"):
            self.take()
            out = Node("not", nodes=(self.negation(),))
        else:
            out = self.atom()
        self.nested -= 1
        return out

    def atom(self) -> Node:
        kind, text = self.take()
        if kind == "(":
            out = self.either()
            if self.take()[0] != ")":
                raise QueryError("a closing parenthesis is missing")
            return out
        if kind != "word":
            raise QueryError(f"unexpected {text!r}")
        if not self.next_is("("):
            return self.pattern(text)
        self.take()
        argument = "" if self.next_is(")") else self.argument(text)
        if self.take()[0] != ")":
            raise QueryError(f"{text}( is not closed")
        return self.function(text, argument)

    def argument(self, name: str) -> str:
        kind, text = self.take()
        if kind != "word":
            raise QueryError(f"{name}() needs an argument, found {text!r}")
        return text

    def function(self, name: str, argument: str) -> Node:
        package = lambda: self.checked(join_rel_checked, "", argument.removeprefix("//"), False)
        if name == "label":
            return Node("label", argument)
        if name in ("tree_output", "tree_output_to"):
            return Node("tree_output", package())
        if name in ("package", "pkg"):
            return Node("package", package())
        if name == "package_prefix":
            return Node("prefix", package())
        if name == "addr":
            return Node("addr", str(self.checked(parse_address, argument, self.base)))
        raise QueryError(f"unknown function {name}")

    def pattern(self, word: str) -> Node:
        if ":" in word:
            return Node("addr", str(self.checked(parse_address, word, self.base)))
        deep = word == "//..." or word.endswith("/...")
        path = word[: -len("...")].rstrip("/") if deep else word
        if word.startswith("//"):
            return Node("prefix" if deep else "package", self.checked(join_rel_checked, "", path.removeprefix("//"), False))
        if word in (".", "..") or word.startswith(("./", "../")):
            return Node("prefix" if deep else "package", self.checked(join_rel_checked, self.base, path, False))
        raise QueryError(f"{word!r} is no pattern: it must start with //, ./ or ../")

    @staticmethod
    def checked(function, *args):
        try:
            return function(*args)
        except QueryError:
            raise
        except ValueError as e:
            raise QueryError(str(e)) from e


def parse(text: str, base: str = "") -> Node:
    parser = _Parser(text, base)
    out = parser.either()
    if parser.at < len(parser.tokens):
        raise QueryError(f"unexpected {parser.tokens[parser.at][1]!r}")
    return out


def format_query(node: Node) -> str:
    """Text that parses to the same tree, with the fewest parentheses."""
    rank = {"or": 0, "and": 1, "not": 2}

    def show(n: Node, least: int) -> str:
        if n.kind in ("or", "and"):
            out = (" || " if n.kind == "or" else " && ").join(show(x, rank[n.kind] + 1) for x in n.nodes)
        elif n.kind == "not":
            out = "!" + show(n.nodes[0], 2)
        elif n.kind == "addr":
            out = f'addr("{n.value}")' if re.search(r"[\s()!&|]", n.value) else n.value
        elif n.kind in ("label", "tree_output") or re.search(r"[\s()!&|:]|\.\.\.", n.value):
            name = {"package": "package", "prefix": "package_prefix"}.get(n.kind, n.kind)
            out = f'{name}("{n.value}")' if not re.fullmatch(r'[^\s"()!&|]*', n.value) else f"{name}({n.value})"
        else:
            out = f"//{n.value}" + ("/..." if n.kind == "prefix" and n.value else "..." if n.kind == "prefix" else "")
        return f"({out})" if rank.get(n.kind, 3) < least else out

    return show(node, 0)


def shape(node: Node) -> Counter:
    """How often each kind of node occurs."""
    return Counter([node.kind]) + sum((shape(n) for n in node.nodes), Counter())


def narrowing_prefix(node: Node) -> str:
    """A package prefix that every match is under, for scans: the longest arm of an `and`; '' if there is none."""
    if node.kind in ("prefix", "package"):
        return node.value
    if node.kind == "addr":
        return parse_address(node.value).package
    return max((narrowing_prefix(n) for n in node.nodes), key=len) if node.kind == "and" else ""


def package_verdict(node: Node, package: str) -> bool | None:
    """Whether all (True), none (False) or an unknown part (None) of a package's targets match."""
    if node.kind == "package":
        return package == node.value
    if node.kind == "prefix":
        return node.value == "" or package == node.value or package.startswith(node.value + "/")
    if node.kind == "addr":
        return None if parse_address(node.value).package == package else False
    if node.kind in ("label", "tree_output"):
        return None
    seen = [package_verdict(n, package) for n in node.nodes]
    if node.kind == "not":
        return None if seen[0] is None else not seen[0]
    decisive = node.kind == "or"
    return decisive if decisive in seen else None if None in seen else not decisive


def package_filter(node: Node, sure: bool = False) -> Column:
    """Which packages can have a match (sure: can have nothing but matches), over the column package alone: a scan can skip the
    others before it reads any target."""
    if node.kind == "package":
        return F.col("package") == node.value
    if node.kind == "prefix":
        return paths.has_prefix("package", node.value)
    if node.kind == "addr":
        return F.lit(False) if sure else F.col("package") == parse_address(node.value).package
    if node.kind in ("label", "tree_output"):
        return F.lit(not sure)
    if node.kind == "not":
        return ~package_filter(node.nodes[0], not sure)
    parts = [package_filter(n, sure) for n in node.nodes]
    return functools.reduce(operator.or_ if node.kind == "or" else operator.and_, parts)


def compile_query(node: Node) -> Column:
    """The predicate over targets (addr, package, labels, tree_packages); null labels count as none."""
    if node.kind == "package":
        return F.col("package") == node.value
    if node.kind == "prefix":
        return paths.has_prefix("package", node.value)
    if node.kind == "addr":
        return F.col("addr") == node.value
    if node.kind == "label":
        return F.coalesce(F.array_contains("labels", node.value), F.lit(False))
    if node.kind == "tree_output":
        value = F.lit(node.value)
        near = paths.has_prefix("package", node.value) | paths.has_prefix(value, F.col("package"))
        hit = F.exists("tree_outputs", lambda o: F.when(o["file"], paths.has_prefix(o["dir"], value)).otherwise(paths.has_prefix(o["dir"], value) | paths.has_prefix(value, o["dir"])))
        return near & F.coalesce(hit, F.lit(False))
    inner = [compile_query(n) for n in node.nodes]
    if node.kind == "not":
        return ~inner[0]
    out = inner[0]
    for x in inner[1:]:
        out = out | x if node.kind == "or" else out & x
    return out


def uses(node: Node, kind: str) -> bool:
    return node.kind == kind or any(uses(n, kind) for n in node.nodes)


#: The order of a query's result: by package, then by provider.
ORDER = ("package", "provider_ord", "addr")


def query(targets: DataFrame, expr: str | Node, base: str = "", outputs: DataFrame | None = None, skip_providers: tuple[str, ...] = ()) -> DataFrame:
    """Distinct targets that match; of an address listed twice the row of the first provider stays. Rows that a provider turned out
    not to have, or that ran in a circle (see selection.available), are passed over. selection.positions(found, ORDER) numbers
    the result in the order in which packages are walked."""
    from loomgraph.operators.selection import available, first_by, tree_outputs

    node = parse(expr, base) if isinstance(expr, str) else expr
    targets = available(targets.where(package_filter(node)))
    if uses(node, "tree_output"):
        if outputs is None:
            raise QueryError("tree_output() needs the outputs of the targets")
        # only targets that can match need their outputs; arrays hold the outputs of a single target
        targets = targets.join(tree_outputs(outputs), "addr", "left")
    if skip_providers:
        targets = targets.where(~F.col("provider").isin(*skip_providers))
    found = targets.where(compile_query(node))
    return first_by(found, ["addr"], ["provider_ord", "package"])


def select(targets: DataFrame, addr: str | None = None, label: str | None = None, under: str | None = None, expr: str | None = None, base: str = "", outputs: DataFrame | None = None) -> DataFrame:
    """One of the selection forms: an address, a label (or None) under a package pattern, or an expression."""
    if sum(x is not None for x in (addr, label if label is not None else under, expr)) != 1:
        raise QueryError("give an address, a label or package pattern, or an expression")
    if addr is not None:
        return query(targets, Node("addr", str(_Parser.checked(parse_address, addr, base))), base, outputs)
    if expr is not None:
        return query(targets, expr, base, outputs)
    arms = [Node("label", label)] if label not in (None, "all") else []
    if under:
        pattern = parse(under, base)
        if pattern.kind not in ("package", "prefix"):
            raise QueryError(f"{under!r} is no package pattern")
        arms.append(pattern)
    return query(targets, Node("and", nodes=tuple(arms)) if len(arms) > 1 else arms[0] if arms else Node("prefix"), base, outputs)


#: The package of targets that stand for the result of a query.
QUERY_PACKAGE = "@query"


def query_address(expr: str, base: str = "", exclude: tuple[str, ...] = ()) -> Address:
    """The address of a query as a target; exclude names providers that its resolution skips."""
    args = {"expr": expr} | ({"_base": base} if base else {}) | ({"exclude_provider": ";".join(exclude)} if exclude else {})
    return Address(QUERY_PACKAGE, "query", tuple(sorted(args.items())))


def query_members(targets: DataFrame, address: Address, outputs: DataFrame | None = None) -> DataFrame:
    """What a query target stands for. Arguments that start with '_' only tell addresses apart; excluding a provider that
    doesn't exist excludes none."""
    args = dict(address.args)
    if "expr" not in args:
        unknown = sorted(k for k in args if not k.startswith("_") and k != "exclude_provider")
        raise QueryError(f"unknown arguments of a query target: {unknown}" if unknown else "a query target needs an expression")
    skip = tuple(p for p in args.get("exclude_provider", "").split(";") if p)
    return query(targets, args["expr"], args.get("_base", ""), outputs, skip)


def stamp_query_inputs(inputs: DataFrame) -> DataFrame:
    """inputs (addr, provider, dep_package, dep_name, dep_args): those on query targets get the argument _origin, a hash of their own
    target, and exclude their own target's provider, unless they say themselves what to exclude."""
    origin = F.create_map(F.lit("_origin"), F.substring(F.sha2("addr", 256), 1, 16))
    args = F.map_concat(F.map_filter("dep_args", lambda k, _: k != "_origin"), origin)
    own = (F.coalesce("provider", F.lit("")) != "") & ~F.map_contains_key("dep_args", F.lit("exclude_provider"))
    args = F.when(own, F.map_concat(args, F.create_map(F.lit("exclude_provider"), F.col("provider")))).otherwise(args)
    return inputs.withColumn("dep_args", F.when(F.col("dep_package") == QUERY_PACKAGE, args).otherwise(F.col("dep_args")))


__all__ = ["Address", "Node", "QueryError", "compile_query", "format_query", "narrowing_prefix", "package_filter", "package_verdict", "parse", "query", "query_address", "query_members", "select", "shape", "stamp_query_inputs", "tokenize"]
