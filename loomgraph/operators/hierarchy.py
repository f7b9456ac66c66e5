"""Configuration that is declared at packages and holds below them."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from loomgraph.functions import paths
from loomgraph.operators.staging import stage


def ancestor_states(packages: DataFrame, states: DataFrame) -> DataFrame:
    """(package, declared_at, depth, ...state columns): the states at a package or above it; an equi-join on the ancestors."""
    up = packages.select("package").distinct().select("package", F.explode(paths.ancestors("package")).alias("declared_at"))
    found = up.join(states.withColumnRenamed("package", "declared_at"), "declared_at")
    return found.withColumn("depth", paths.depth("declared_at"))


def states_under(states: DataFrame, prefix: str) -> DataFrame:
    return states.where(paths.has_prefix("package", prefix))


def nearest(packages: DataFrame, declared: DataFrame, by: list[str] | None = None, root: str = "") -> DataFrame:
    """For each package (and `by` key) the declaration at the deepest ancestor, not above root."""
    found = ancestor_states(packages, declared.where(paths.has_prefix("package", root)))
    keys = ["package", *(by or [])]
    return found.groupBy(*[F.col(k).alias(f"_k_{k}") for k in keys]).agg(F.max_by(F.struct(*found.columns), "depth").alias("_row")).select("_row.*")


def longest_prefix(imports: DataFrame, modules: DataFrame) -> DataFrame:
    """(import_path, module): the longest module that is the path or a component prefix of it; the first listed wins ties."""
    up = imports.select("import_path").distinct().select("import_path", F.explode(paths.ancestors("import_path")).alias("module"))
    found = up.join(modules.groupBy("module").agg(F.min("pos").alias("pos")), "module")
    return found.groupBy("import_path").agg(F.max_by("module", F.length("module")).alias("module"))


def inherit(variants: DataFrame, required: tuple[str, ...] = ()) -> DataFrame:
    """variants (name, inherit, ...fields): fields that a variant leaves out come from the one it inherits, at any depth.
    ValueError for a cycle, an unknown base, or a required field that stays out.

    Each round a variant takes what its base has by then, and inherits what that inherits, so a chain of n takes log2(n) rounds;
    what is open after that is a cycle."""
    fields = [c for c in variants.columns if c not in ("name", "inherit")]
    now = stage(variants, "variants")
    rounds = now.count().bit_length() + 1
    for k in range(rounds + 1):
        if now.where("inherit is not null").isEmpty():
            if required and not now.where(" or ".join(f"{f} is null" for f in required)).isEmpty():
                raise ValueError(f"a variant lacks one of {required}")
            return now.drop("inherit")
        base = now.select(F.col("name").alias("_base"), F.col("inherit").alias("_next"), *(F.col(f).alias(f"_{f}") for f in fields))
        met = now.join(base, F.col("inherit") == F.col("_base"), "left")
        if not k and not met.where("inherit is not null and _base is null").isEmpty():
            raise ValueError("a variant inherits an unknown one")
        now = stage(met.select("name", F.col("_next").alias("inherit"), *(F.coalesce(F.col(f), F.col(f"_{f}")).alias(f) for f in fields)), "inherited")
    raise ValueError("variants inherit each other in a cycle")


def overlay(layers: list[DataFrame], key: str = "name") -> DataFrame:
    """Field-wise: the last layer that has a value wins. Layers have the same columns."""
    out = layers[0]
    for layer in layers[1:]:
        fields = [c for c in out.columns if c != key]
        upper = layer.select(F.col(key).alias("_key"), *(F.col(f).alias(f"_{f}") for f in fields))
        out = out.join(upper, F.col(key) == F.col("_key"), "full").select(F.coalesce("_key", key).alias(key), *(F.coalesce(F.col(f"_{f}"), F.col(f)).alias(f) for f in fields))
    return out


def merge_lists(earlier: DataFrame, later: DataFrame, key: str = "name") -> DataFrame:
    """Union by key in order of pos: a later row takes the place of the earlier one of its key, new ones come after all."""
    places = earlier.select(F.col(key).alias("_key"), F.col("pos").alias("_pos"))
    end = earlier.agg((F.coalesce(F.max("pos"), F.lit(-1)) + 1).alias("_end"))  # one row
    put = later.join(places, F.col(key) == F.col("_key"), "left").join(F.broadcast(end)).withColumn("pos", F.coalesce("_pos", F.col("_end") + F.col("pos")))
    return put.select(*later.columns).unionByName(earlier.join(later.select(key), key, "left_anti").select(*later.columns))


def with_defaults(rows: DataFrame, defaults: dict, required: tuple[str, ...] = (), key: str = "name") -> DataFrame:
    """Defaults for fields that no layer has set; ValueError naming a row that lacks a required one."""
    for field in required:
        lost = rows.where(F.col(field).isNull()).select(key).first()
        if lost:
            raise ValueError(f"{lost[0]} is missing the required {field}")
    return rows.select(*(F.coalesce(F.col(c), F.lit(defaults[c])).alias(c) if c in defaults else c for c in rows.columns))


def listed_states(packages: DataFrame, states: DataFrame, inherited: bool = True, provider: str | None = None) -> DataFrame:
    """(package, declared_at, depth, ...state columns) of each package, also of one that nobody lists: its own states or, inherited,
    those above it too. In order of package, then from the root down, then as the providers declare them."""
    found = ancestor_states(packages, states if provider is None else states.where(F.col("provider") == provider))
    found = found if inherited else found.where("declared_at = package")
    return found.orderBy("package", "depth", *(c for c in ("provider_ord", "decl_ord") if c in states.columns))


def universe(variants: DataFrame, root: str = "") -> DataFrame:
    """All variants (name, package, ...) that are declared in the module's subtree."""
    return states_under(variants, root)


def pinned(refs: DataFrame, known: DataFrame) -> DataFrame:
    """refs (name, package, ...) with the factors of exactly that variant; `error` names those that aren't declared there."""
    fields = [c for c in known.columns if c not in ("name", "package")]
    found = refs.join(known.withColumn("_found", F.lit(True)), ["name", "package"], "left")
    error = F.when(F.col("_found").isNull(), F.concat(F.lit("variant "), "name", F.lit(" is not declared at "), "package"))
    return found.select(*refs.columns, *fields, error.alias("error"))


def state_json(states: DataFrame) -> DataFrame:
    """States as JSON with sorted keys; `state` is map<string,string>."""
    entries = F.array_sort(F.map_entries("state"))
    return states.withColumn("json", F.to_json(F.map_from_entries(entries)))


__all__ = ["ancestor_states", "inherit", "listed_states", "longest_prefix", "merge_lists", "nearest", "overlay", "pinned", "state_json", "states_under", "universe", "with_defaults"]
