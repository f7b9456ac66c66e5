"""Providers as table functions in SQL: what they list, package by package, and what they know of a package."""

from __future__ import annotations

from collections.abc import Iterator

from pyspark.sql import SparkSession
from pyspark.sql.functions import udtf


class Provider:
    """A source of targets. A provider is sent to the workers, so it holds settings and small tables only."""

    def list_packages(self, prefix: str) -> Iterator[str]:
        raise NotImplementedError

    def list(self, package: str) -> Iterator[tuple[str, str]]:
        """(name, driver) of the targets of a package."""
        raise NotImplementedError

    def probe(self, package: str) -> Iterator[tuple[str, str]]:
        """(key, value) of the states that the provider declares at a package."""
        return iter(())


class StaticProvider(Provider):
    """A fixed list of (package, name, driver), and states (package, key, value)."""

    def __init__(self, targets: list[tuple[str, str, str]], states: list[tuple[str, str, str]] = ()):
        self.targets, self.states = targets, list(states)

    def list_packages(self, prefix: str) -> Iterator[str]:
        under = lambda p: prefix == "" or p == prefix or p.startswith(f"{prefix}/")
        yield from sorted({p for p, _, _ in self.targets if under(p)}, key=str.encode)

    def list(self, package: str) -> Iterator[tuple[str, str]]:
        yield from ((name, driver) for p, name, driver in self.targets if p == package)

    def probe(self, package: str) -> Iterator[tuple[str, str]]:
        yield from ((key, value) for p, key, value in self.states if p == package)


def register_provider(spark: SparkSession, name: str, provider: Provider) -> tuple[str, str, str]:
    """Makes the SQL table functions <name>_packages(prefix), <name>_list(package) and <name>_probe(package); to be joined laterally
    with a table of packages, so that every task asks for the packages that it has."""

    class Packages:
        def eval(self, prefix: str):
            yield from ((p,) for p in provider.list_packages(prefix))

    class Targets:
        def eval(self, package: str):
            yield from provider.list(package)

    class States:
        def eval(self, package: str):
            yield from provider.probe(package)

    made = [(f"{name}_packages", Packages, "package string"), (f"{name}_list", Targets, "name string, driver string"), (f"{name}_probe", States, "key string, value string")]
    for function, handler, schema in made:
        spark.udtf.register(function, udtf(handler, returnType=schema))
    return tuple(function for function, _, _ in made)


__all__ = ["Provider", "StaticProvider", "register_provider"]
