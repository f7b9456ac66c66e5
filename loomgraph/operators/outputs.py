"""Output paths: overlaps between targets, and transforms of path sets."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from loomgraph.functions import paths


def overlaps(outputs: DataFrame, filesystem_driver: str = "fs") -> DataFrame:
    """(path, addr, other_path, other_addr): copied outputs of different targets with the same path or one inside the
    other, each pair once; pairs of two filesystem targets may overlap. An equi-join on exploded ancestors."""
    mine = outputs.where("codegen = 'copy'").select(F.regexp_replace("path", "/+$", "").alias("path"), "addr", "driver").distinct()
    above = mine.select("path", "addr", "driver", F.explode(paths.ancestors("path")).alias("at")).where("at <> '' or path = ''")
    other = mine.select(F.col("path").alias("other_path"), F.col("addr").alias("other_addr"), F.col("driver").alias("other_driver"))
    met = above.join(other, F.col("at") == F.col("other_path")).where("addr <> other_addr")
    met = met.where((F.col("path") != F.col("other_path")) | (F.col("addr") < F.col("other_addr")))
    both_fs = (F.col("driver") == filesystem_driver) & (F.col("other_driver") == filesystem_driver)
    return met.where(~both_fs).select("path", "addr", "other_path", "other_addr").distinct()


def shared_paths(outputs: DataFrame) -> DataFrame:
    """(path, owners, n_owners): copied output paths of more than one target, with the sorted targets. A row for each path, however
    many share it; overlaps() makes pairs of them."""
    mine = outputs.where("codegen = 'copy'").select(F.regexp_replace("path", "/+$", "").alias("path"), "addr").distinct()
    return mine.groupBy("path").agg(F.sort_array(F.collect_list("addr")).alias("owners"), F.count("*").alias("n_owners")).where("n_owners > 1")


def by_components(path: Column | str) -> Column:
    """A sort key: component by component, so that a/x comes before a-b."""
    return F.split(path, "/")


@dataclass(frozen=True)
class PathTransform:
    """Where the files of a target go. A file must match include (if there is any) and not exclude, either by its path or by its
    path within its package. Then strip_prefix, in either form, is taken off and prefix is put before.

    rename is a text, the destination of the only file that is left, or pairs (path, destination), which hold for these very
    paths whatever the globs say, and without the prefixes."""

    include: tuple[str, ...] = ()
    exclude: tuple[str, ...] = ()
    rename: str | tuple[tuple[str, str], ...] = ()
    strip_prefix: str = ""
    prefix: str = ""

    def __post_init__(self) -> None:
        if isinstance(self.rename, str) and (self.strip_prefix or self.prefix):
            raise ValueError("a single destination can't be combined with strip_prefix or prefix")

    def apply(self, files: DataFrame) -> DataFrame:
        """files (path, and package if their producers have one) with `dst`; those left out are gone."""
        inner = _within_package(files)
        left = self._left(inner)
        if isinstance(self.rename, str):
            return files.where(left).withColumn("dst", F.lit(self.rename))
        dst = F.col("path")
        if self.strip_prefix:
            dst = F.coalesce(_below(F.col("path"), self.strip_prefix), _below(inner, self.strip_prefix), dst)
        if self.prefix:
            dst = F.concat(F.lit(self.prefix.rstrip("/") + "/"), dst)
        for old, new in self.rename:
            dst = F.when(F.col("path") == old, F.lit(new)).otherwise(dst)
        named = F.col("path").isin(*[old for old, _ in self.rename]) if self.rename else F.lit(False)
        return files.where(named | left).withColumn("dst", dst)

    def problems(self, files: DataFrame) -> DataFrame:
        """(problem, detail): two sources for one destination, a single destination for none or several files, a renamed path
        that isn't there, a strip_prefix that no file is under. No files, no problem."""
        inner, sole = _within_package(files), isinstance(self.rename, str)
        pairs = () if sole else self.rename
        under = F.lit(False)
        if self.strip_prefix:
            under = F.coalesce(_below(F.col("path"), self.strip_prefix), _below(inner, self.strip_prefix)).isNotNull()
        seen = files.agg(F.count("*").alias("n"), F.count_if(self._left(inner)).alias("left"), F.count_if(under).alias("under"), *(F.count_if(F.col("path") == old).alias(f"r{i}") for i, (old, _) in enumerate(pairs)))
        found = lambda when, problem, detail: F.when((F.col("n") > 0) & when, F.struct(F.lit(problem).alias("problem"), F.lit(detail).alias("detail")))
        checks = [found(F.col(f"r{i}") == 0, "unknown rename", old) for i, (old, _) in enumerate(pairs)]
        if sole:
            checks += [found(F.col("left") == 0, "nothing to rename", self.rename), found(F.col("left") > 1, "several to rename", self.rename)]
        if self.strip_prefix:
            checks.append(found(F.col("under") == 0, "unused strip_prefix", self.strip_prefix))
        checks.append(found(F.lit(False), "", ""))
        unused = seen.select(F.explode(F.filter(F.array(*checks), lambda c: c.isNotNull())).alias("c")).select("c.problem", "c.detail")
        if sole:
            return unused
        clash = self.apply(files).groupBy("dst").agg(F.countDistinct("path").alias("n")).where("n > 1")
        return clash.select(F.lit("collision").alias("problem"), F.col("dst").alias("detail")).unionByName(unused)

    def _left(self, inner: Column) -> Column:
        hit = lambda globs: _any_glob(F.col("path"), globs) | F.coalesce(_any_glob(inner, globs), F.lit(False))
        return (hit(self.include) if self.include else F.lit(True)) & ~hit(self.exclude)


def _within_package(files: DataFrame) -> Column:
    """A file's path within the package of its producer; null if that is the root or the file is elsewhere."""
    if "package" not in files.columns:
        return F.lit(None).cast("string")
    return F.when(F.col("package") != "", F.when(F.startswith("path", F.concat("package", F.lit("/"))), F.substring("path", F.length("package") + 2, F.length("path"))))


def _below(path: Column, directory: str) -> Column:
    """What follows the directory in a path; null outside it."""
    head = directory.rstrip("/") + "/"
    return path if head == "/" else F.when(F.startswith(path, F.lit(head)), F.substring(path, F.lit(len(head) + 1), F.length(path)))


def _any_glob(path: Column, globs: tuple[str, ...]) -> Column:
    out = F.lit(False)
    for g in globs:
        out = out | (path == g) | paths.matches_glob(path, g)
    return out


def ignore_patterns(outputs: DataFrame) -> DataFrame:
    """(pattern, addr), distinct: outputs that are copied into the tree, anchored at its root, for an ignore file. A directory
    has no '/' at its end, as it may be put there as a link."""
    path = F.regexp_replace("path", "^/+", "")
    path = F.when(F.col("kind") == "dir", F.regexp_replace(path, "/+$", "")).otherwise(path)
    return outputs.where("codegen = 'copy'").select(F.concat(F.lit("/"), path).alias("pattern"), "addr").distinct()


def merge_section(old: DataFrame, fresh: DataFrame, scope: str, exact: bool = False) -> DataFrame:
    """Entries (pattern, addr) of a managed section after a rebuild of scope (a package, with those below it unless exact): old
    entries of targets elsewhere and of no target stay, the fresh ones come in."""
    package = paths.package_of("addr")
    inside = package == scope if exact else paths.has_prefix(package, scope)
    return old.where(~F.coalesce(inside, F.lit(False))).select("pattern", "addr").unionByName(fresh.select("pattern", "addr")).distinct()


def violations(linked: DataFrame, overlapping: DataFrame, wanted: DataFrame, written: DataFrame | None = None) -> DataFrame:
    """(check, addr, detail) of all that is wrong, each check in full: what graph.link() and overlaps() found, and where the ignore
    file's section (written) isn't what it should be; without one (a scoped run) that isn't looked at."""
    out = linked.where("error is not null").select(F.lit("link").alias("check"), "addr", F.concat("error", F.lit(": "), "dep_addr").alias("detail"))
    out = out.unionByName(overlapping.select(F.lit("overlap").alias("check"), "addr", F.concat("path", F.lit(" and "), "other_path", F.lit(" of "), "other_addr").alias("detail")))
    if written is None:
        return out
    sides = [(wanted, written, "not ignored: "), (written, wanted, "no longer made: ")]
    for here, there, text in sides:
        lost = here.select("pattern", "addr").join(there.select("pattern", "addr"), ["pattern", "addr"], "left_anti")
        out = out.unionByName(lost.select(F.lit("ignore").alias("check"), "addr", F.concat(F.lit(text), "pattern").alias("detail")))
    return out
