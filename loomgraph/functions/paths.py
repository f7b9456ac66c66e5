"""Package and file paths as Column expressions. Paths are '/'-separated; '' is the root package."""

from __future__ import annotations

import itertools
import re

from pyspark.sql import Column
from pyspark.sql import functions as F


def _col(x: Column | str) -> Column:
    return F.col(x) if isinstance(x, str) else x


def parts(path: Column | str) -> Column:
    """The components of a package; none for the root."""
    path = _col(path)
    return F.when(path == "", F.array().cast("array<string>")).otherwise(F.split(path, "/"))


def ancestors(path: Column | str) -> Column:
    """The package itself, its parents, and '' at last."""
    x = parts(path)
    return F.transform(F.sequence(F.size(x), F.lit(0), F.lit(-1)), lambda n: F.array_join(F.slice(x, F.lit(1), n), "/"))


def has_prefix(path: Column | str, prefix: Column | str) -> Column:
    """Whether path is the package prefix or below it; whole components count, so ab is not under a."""
    path = _col(path)
    prefix = F.lit(prefix) if isinstance(prefix, str) else prefix
    return (prefix == "") | (path == prefix) | F.startswith(path, F.concat(prefix, F.lit("/")))


def depth(path: Column | str) -> Column:
    return F.size(parts(path))


def package_of(addr: Column | str) -> Column:
    """What stands before the last ':' of an address, without '//'."""
    return F.regexp_replace(F.regexp_extract(_col(addr), r"^(.*):[^:]*$", 1), "^//", "")


def clean(path: Column | str) -> Column:
    """Without '.', empty components and resolved '..'; '.' for nothing. A leading '/' and leading '..' of a relative path stay."""
    path = _col(path)
    rooted = F.startswith(path, F.lit("/"))

    def step(done: Column, x: Column) -> Column:
        up = (x == "..") & (F.size(done) > 0) & (F.element_at(done, -1) != "..")
        lost = (x == "..") & (F.size(done) == 0) & rooted
        return F.when((x == "") | (x == ".") | lost, done).when(up, F.slice(done, F.lit(1), F.size(done) - 1)).otherwise(F.concat(done, F.array(x)))

    kept = F.array_join(F.aggregate(F.split(path, "/"), F.array().cast("array<string>"), step), "/")
    return F.when(rooted, F.concat(F.lit("/"), kept)).when(kept == "", F.lit(".")).otherwise(kept)


def join(*paths: Column | str) -> Column:
    """The cleaned join of the non-empty paths; '' if all are empty."""
    whole = F.array_join(F.filter(F.array(*(_col(p) for p in paths)), lambda p: p != ""), "/")
    return F.when(whole == "", F.lit("")).otherwise(clean(whole))


def dirname(path: Column | str) -> Column:
    """The cleaned text up to the last '/'; '.' if there is none."""
    return clean(F.regexp_replace(_col(path), r"[^/]*$", ""))


def basename(path: Column | str) -> Column:
    """The last component; '.' for '' and '/' for slashes alone."""
    path = _col(path)
    bare = F.regexp_replace(path, "/+$", "")
    return F.when(path == "", F.lit(".")).when(bare == "", F.lit("/")).otherwise(F.regexp_extract(bare, r"([^/]*)$", 1))


def join_rel_checked(base: str, rel: str, keep_slash: bool = True) -> str:
    """rel resolved against base in plain Python; ValueError if it leaves the root. One trailing slash stays."""
    out: list[str] = []
    for piece in [*base.split("/"), *rel.split("/")]:
        if piece == "..":
            if not out:
                raise ValueError(f"{rel!r} leaves the root")
            out.pop()
        elif piece not in ("", "."):
            out.append(piece)
    return "/".join(out) + ("/" if keep_slash and rel.endswith("/") and out else "")


def join_rel(base: Column | str, rel: Column | str) -> Column:
    """join_rel_checked() as a Column; null where rel leaves the root."""
    base, rel = _col(base), _col(rel)
    start = F.struct(F.array().cast("array<string>").alias("done"), F.lit(False).alias("left"))

    def step(state: Column, x: Column) -> Column:
        done, up = state["done"], x == ".."
        kept = F.when(up, F.slice(done, F.lit(1), F.greatest(F.size(done) - 1, F.lit(0)))).when((x == "") | (x == "."), done).otherwise(F.concat(done, F.array(x)))
        return F.struct(kept.alias("done"), (state["left"] | (up & (F.size(done) == 0))).alias("left"))

    end = F.aggregate(F.concat(F.split(base, "/"), F.split(rel, "/")), start, step)
    slash = F.when(F.endswith(rel, F.lit("/")) & (F.size(end["done"]) > 0), F.lit("/")).otherwise(F.lit(""))
    return F.when(~end["left"], F.concat(F.array_join(end["done"], "/"), slash))


def glob_to_regex(pattern: str) -> str:
    """The anchored regex of a glob: '*' and '?' stay in a component, '**' spans any number, {a,b} and [abc] choose."""
    out, i, depth_ = [], 0, 0
    while i < len(pattern):
        c = pattern[i]
        if pattern.startswith("**/", i):
            out.append("(?:[^/]+/)*")
            i += 3
            continue
        if pattern.startswith("**", i):
            out.append(".*")
            i += 2
            continue
        if c == "[" and "]" in pattern[i + 2 :]:
            end = pattern.index("]", i + 2)
            body = pattern[i + 1 : end]
            out.append("[" + ("^" + body[1:] if body[0] in "!^" else body).replace("\\", "\\\\") + "]")
            i = end + 1
            continue
        if c == "{":
            depth_ += 1
            out.append("(?:")
        elif c == "}" and depth_:
            depth_ -= 1
            out.append(")")
        elif c == "," and depth_:
            out.append("|")
        else:
            out.append({"*": "[^/]*", "?": "[^/]"}.get(c, re.escape(c)))
        i += 1
    return "^" + "".join(out) + ("" if not depth_ else ")" * depth_) + "$"


def matches_glob(path: Column | str, pattern: str) -> Column:
    return _col(path).rlike(glob_to_regex(pattern))


def glob_base(pattern: Column | str) -> Column:
    """The longest prefix, up to a '/', before the first of * ? [ {."""
    pattern = _col(pattern)
    head = F.regexp_extract(pattern, r"^([^*?\[{]*)", 1)
    return F.when(head == pattern, pattern).otherwise(F.regexp_replace(F.regexp_extract(head, r"^(.*/)?", 1), "/$", ""))


def literal_prefix(pattern: str) -> str:
    """The leading components of a pattern that hold no glob characters: where a walk starts. A literal pattern is its own."""
    return "/".join(itertools.takewhile(lambda piece: not re.search(r"[*?\[\]{}<>\\,]", piece), pattern.split("/")))


def bit_bucket(value: Column | str) -> Column:
    """The bit length of a non-negative whole number."""
    value = _col(value).cast("long")
    return F.when(value <= 0, F.lit(0)).otherwise(F.length(F.bin(value)))


def bucket_upper(bucket: Column) -> Column:
    """The largest number of that bit length."""
    return F.when(bucket <= 0, F.lit(0).cast("long")).otherwise(F.call_function("shiftright", F.lit(2**63 - 1), (63 - bucket).cast("int")))


def human_elapsed(ms: Column | str, millis: bool = False) -> Column:
    """The two largest units: 12s (12.345s with millis), 1m05s, 1h05m, 2d03h. From a minute on it is padded to 6 characters."""
    ms = _col(ms).cast("long")
    s = F.floor(ms / 1000)
    under = F.format_string("%d.%03ds", s, ms % 1000) if millis else F.format_string("%ds", s)
    units = [(60, "m", 1, "s"), (3600, "h", 60, "m"), (86_400, "d", 3600, "h")]
    shown = [F.format_string(f"%d{big}%02d{small}", F.floor(s / a), F.floor(s % a / b)) for a, big, b, small in units]
    over = F.when(s < 3600, shown[0]).when(s < 86_400, shown[1]).otherwise(shown[2])
    return F.when(s < 60, under).otherwise(F.lpad(over, F.greatest(F.length(over), F.lit(6)), F.lit(" ")))


def compression_for(size: Column, precompressed: Column) -> Column:
    return F.when((size >= 1024) & ~precompressed, F.lit("gzip")).otherwise(F.lit("none"))


def key_segment(text: Column | str, most: int = 96) -> Column:
    """A segment of an object key: the text itself if it is short and harmless, else a harmless form of it with a hash of
    the text behind '--', so that different texts never share a segment."""
    text = _col(text)
    plain = text.rlike(r"^[A-Za-z0-9._@=,-]+$") & (F.length(text) <= most) & ~text.isin(".", "..") & ~F.contains(text, F.lit("--"))
    safe = F.substring(F.regexp_replace(text, r"[^A-Za-z0-9._@=,-]", "_"), 1, most)
    return F.when(plain, text).otherwise(F.concat(safe, F.lit("--"), F.substring(F.sha2(text, 256), 1, 16)))
