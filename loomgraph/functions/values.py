"""Coercions of dynamic config values, types of values, and functions with checked signatures."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass, field

from pyspark.sql import SparkSession


def parse_strings(value) -> list[str]:
    """null: none; a scalar: itself; a list: its items without nulls."""
    if value is None:
        return []
    if isinstance(value, str):
        return [value]
    if isinstance(value, list):
        return [s for v in value if v is not None for s in parse_strings(v)]
    raise TypeError(f"expected a string or a list of strings, got {value!r}")


def parse_map_string_strings(value) -> dict[str, list[str]]:
    """A bare string or list stands for the group ''."""
    if value is None:
        return {}
    return {k: parse_strings(v) for k, v in value.items()} if isinstance(value, dict) else {"": parse_strings(value)}


def parse_map_string_string(value) -> dict[str, str]:
    if value is None:
        return {}
    if not isinstance(value, dict):
        raise TypeError(f"expected a map, got {value!r}")
    return {k: parse_string(v) for k, v in value.items() if v is not None}


def parse_string(value) -> str:
    if not isinstance(value, str):
        raise TypeError(f"expected a string, got {value!r}")
    return value


def parse_bool(value) -> bool:
    if value is None:
        return False
    if not isinstance(value, bool):
        raise TypeError(f"expected a boolean, got {value!r}")
    return value


@dataclass(frozen=True)
class Kind:
    """A type of values: a scalar name, list(item), map(item), union(options) or struct(fields, all optional)."""

    name: str
    items: tuple = ()

    def matches(self, value) -> bool:
        if self.name == "any":
            return True
        if self.name == "null":
            return value is None
        if self.name == "bool":
            return isinstance(value, bool)
        if self.name == "int":
            return isinstance(value, int) and not isinstance(value, bool)
        if self.name == "float":
            return isinstance(value, (int, float)) and not isinstance(value, bool)
        if self.name == "string":
            return isinstance(value, str)
        if self.name == "list":
            return isinstance(value, list) and all(self.items[0].matches(v) for v in value)
        if self.name == "map":
            return isinstance(value, dict) and all(self.items[0].matches(v) for v in value.values())
        if self.name == "union":
            return any(k.matches(value) for k in self.items)
        if self.name == "struct":
            kinds = dict(self.items)
            return isinstance(value, dict) and all(k in kinds and kinds[k].matches(v) for k, v in value.items())
        raise ValueError(f"unknown type {self.name}")

    def __str__(self) -> str:
        if self.name == "union":
            return " | ".join(map(str, self.items))
        if self.name == "struct":
            return "{" + ", ".join(f"{k}?: {v}" for k, v in self.items) + "}"
        return f"{self.name}[{self.items[0]}]" if self.items else self.name


@dataclass(frozen=True)
class Param:
    name: str
    kind: Kind
    default: object = ...


@dataclass(frozen=True)
class Signature:
    """Positional parameters, named ones, an optional variadic one, and what is returned."""

    positional: tuple[Param, ...] = ()
    named: tuple[Param, ...] = ()
    variadic: Kind | None = None
    returns: Kind = field(default_factory=lambda: Kind("any"))

    def bind(self, args: list, named: dict) -> dict:
        """Arguments by name ('*' for variadic ones); TypeError for wrong number, name or type."""
        if len(args) > len(self.positional) and self.variadic is None:
            raise TypeError(f"takes {len(self.positional)} positional arguments, got {len(args)}")
        known = {p.name: p for p in (*self.positional, *self.named)}
        if unknown := sorted(set(named) - set(known)):
            raise TypeError(f"unknown arguments {unknown}")
        given = {p.name: a for p, a in zip(self.positional, args, strict=False)}
        if twice := sorted(set(given) & set(named)):
            raise TypeError(f"arguments given twice: {twice}")
        given |= named
        for name, p in known.items():
            if name not in given:
                if p.default is ...:
                    raise TypeError(f"missing argument {name}")
                given[name] = p.default
            elif not p.kind.matches(given[name]):
                raise TypeError(f"{name}: expected {p.kind}, got {given[name]!r}")
        rest = args[len(self.positional) :]
        if bad := [a for a in rest if not self.variadic.matches(a)]:
            raise TypeError(f"expected {self.variadic}, got {bad[0]!r}")
        return given | ({"*": rest} if self.variadic else {})

    def __str__(self) -> str:
        shown = [f"{p.name}: {p.kind}" + ("" if p.default is ... else f" = {p.default!r}") for p in (*self.positional, *self.named)]
        return f"({', '.join(shown + ([f'*: {self.variadic}'] if self.variadic else []))}) -> {self.returns}"


class Functions:
    """Functions by provider and name, with their signatures; register() makes them SQL functions provider_name."""

    def __init__(self):
        self._known: dict[tuple[str, str], tuple[Signature, Callable]] = {}

    def add(self, provider: str, name: str, signature: Signature, body: Callable) -> None:
        if (provider, name) in self._known:
            raise ValueError(f"{provider}.{name} exists already")
        self._known[provider, name] = signature, body

    def call(self, provider: str, name: str, *args, **named):
        signature, body = self._known[provider, name]
        bound = signature.bind(list(args), named)
        rest = bound.pop("*", [])
        out = body(*rest, **bound)
        if not signature.returns.matches(out):
            raise TypeError(f"{provider}.{name} returned {out!r}, not {signature.returns}")
        return out

    def listing(self) -> list[tuple[str, str, str]]:
        return sorted((p, n, str(s)) for (p, n), (s, _) in self._known.items())

    def register(self, spark: SparkSession, provider: str, name: str, returns: str) -> str:
        """A row function in SQL; only for functions that no Column expression covers."""
        spark.udf.register(f"{provider}_{name}", lambda *args: self.call(provider, name, *args), returns)
        return f"{provider}_{name}"
