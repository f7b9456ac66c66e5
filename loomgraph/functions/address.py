"""Addresses //package:name@key=value,... of targets, in plain Python (plan time) and as Columns."""

from __future__ import annotations

import re
from dataclasses import dataclass, field

from pyspark.sql import Column
from pyspark.sql import functions as F

from loomgraph.functions.paths import join_rel_checked

_ADDR = re.compile(r"//([^: ]*):([^@: |]+)(?:@(.*))?")
_ARG = re.compile(r'([^=,@ |"]+)(?:=(?:"([^"]*)"|([^, |"]+)))?')


@dataclass(frozen=True)
class Address:
    """A target's identity; arguments are kept sorted, so equal addresses have equal text."""

    package: str
    name: str
    args: tuple[tuple[str, str], ...] = ()

    def __str__(self) -> str:
        shown = ",".join(k + (f'="{v}"' if re.search(r'[, |"]', v) else f"={v}" if v else "") for k, v in self.args)
        return f"//{self.package}:{self.name}" + (f"@{shown}" if shown else "")


@dataclass(frozen=True)
class TargetAddress:
    """An address with an output group and filters: addr|output[filter,...]."""

    ref: Address
    output: str | None = None
    filters: tuple[str, ...] = field(default=())


def parse_address(text: str, base: str = "") -> Address:
    """ValueError for anything that is no address. Forms :name, ./x:name and ../x:name are relative to base."""
    if text.startswith(":"):
        text = f"//{base}{text}"
    elif text.startswith(("./", "../")):
        path, colon, rest = text.partition(":")
        if not colon:
            raise ValueError(f"{text!r}: a relative reference must name a target, as in {text}:name")
        text = f"//{join_rel_checked(base, path, keep_slash=False)}:{rest}"
    elif not text.startswith("//"):
        raise ValueError(f"{text!r}: an address starts with //, :, ./ or ../")
    found = _ADDR.fullmatch(text)
    if not found:
        raise ValueError(f"{text!r} is no address")
    args: dict[str, str] = {}
    rest = found[3]
    while rest is not None:
        one = _ARG.match(rest)
        if not one:
            raise ValueError(f"{text!r}: bad arguments")
        args[one[1]] = one[2] if one[2] is not None else one[3] or ""
        rest = rest[one.end() :]
        if not rest:
            break
        if rest[0] != ",":
            raise ValueError(f"{text!r}: bad arguments")
        rest = rest[1:]
    return Address(join_rel_checked("", found[1], keep_slash=False), found[2], tuple(sorted(args.items())))


def split_filters(text: str) -> list[str]:
    """Comma-separated filters; commas inside {} belong to a filter."""
    out, depth, at = [], 0, 0
    for i, c in enumerate(text):
        depth += (c == "{") - (c == "}")
        if c == "," and depth <= 0:
            out.append(text[at:i])
            at = i + 1
    out.append(text[at:])
    return [f.strip() for f in out if f.strip()]


def parse_target_address(text: str, base: str = "") -> TargetAddress:
    filters: list[str] = []
    if text.endswith("]") and "[" in text:
        text, _, inner = text[:-1].rpartition("[")
        filters = split_filters(inner)
    ref, bar, output = text.partition("|")
    if bar and not output:
        raise ValueError(f"{text!r}: empty output name")
    return TargetAddress(parse_address(ref, base), output or None, tuple(filters))


def format_address(package: Column, name: Column, args: Column | None = None) -> Column:
    """The canonical text of an address; args is a map of strings or None."""
    text = F.concat(F.lit("//"), package, F.lit(":"), name)
    if args is None:
        return text
    shown = lambda v: F.when(v.rlike('[, |"]'), F.concat(F.lit('"'), v, F.lit('"'))).otherwise(v)
    pairs = F.array_sort(F.transform(F.map_entries(args), lambda e: F.when(e["value"] == "", e["key"]).otherwise(F.concat(e["key"], F.lit("="), shown(e["value"])))))
    return F.when(F.size(args) > 0, F.concat(text, F.lit("@"), F.array_join(pairs, ","))).otherwise(text)


def build_address(package: Column, variant: Column | None = None) -> Column:
    """The address of a package's build target, for one variant or, without, for the machine's own."""
    text = F.concat(F.lit("//"), package, F.lit(":build"))
    return text if variant is None else F.when(F.coalesce(variant, F.lit("")) == "", text).otherwise(F.concat(text, F.lit("@v="), variant))


def parsed_address(text: Column) -> Column:
    """struct<package, name, args map<string,string>> of absolute addresses; null for what is none. The Column form of
    parse_address(): arguments are pairs, and a quoted value may hold commas."""
    package, name = F.regexp_extract(text, _COLUMN, 1), F.regexp_extract(text, _COLUMN, 2)
    pairs = F.regexp_extract_all(F.regexp_extract(text, _COLUMN, 3), F.lit(r'([^,="]+(?:="[^"]*"|=[^,"]*)?)'), F.lit(1))
    entry = lambda p: F.struct(F.regexp_extract(p, r"^([^=]+)", 1), F.regexp_replace(F.regexp_extract(p, r"^[^=]+=(.*)$", 1), '^"|"$', ""))
    return F.when(text.rlike(_COLUMN), F.struct(package.alias("package"), name.alias("name"), F.map_from_entries(F.transform(pairs, entry)).alias("args")))


#: Package, name and arguments of an absolute address.
_COLUMN = r"^//([^:]*):([^@:]+)(?:@(.+))?$"
