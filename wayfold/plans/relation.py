"""Named relations: queries over other relations, in SQL that Spark and DuckDB share.

An operator is a relation whose inputs are DataFrames: ``apply`` runs it on any DataFrames with the columns it reads, so
Catalyst sees one declarative plan from scan to result. ``build`` runs it over the tables of a folder, and ``oracle``
gives the same query, inputs spelled out as common table expressions, to another engine, or SQL that was written for it
apart. Relations that many others read, such as roads and cells, are written once for each state of the tables.

The shared dialect has a few macros for what the engines spell differently, and numbers with a point are always doubles.
"""

from __future__ import annotations

import re
from dataclasses import dataclass, field

from pyspark.sql import DataFrame, SparkSession

from wayfold.plans import store

#: Macro: (Spark, DuckDB).
MACROS = {
    "PCTL(": ("percentile(", "quantile_cont("),
    "MINBY(": ("min_by(", "arg_min("),
    "MAXBY(": ("max_by(", "arg_max("),
    "LISTOF(": ("collect_list(", "list("),
    "STR)": ("STRING)", "VARCHAR)"),
    "WEEKDAY(": ("date_format(", "strftime("),
}
_SERIES = re.compile(r"SERIES\(")
_DECIMAL = re.compile(r"(?<![\w.'])(\d+\.\d+)(?![\w.'])")


def _dialect(sql: str, duck: bool) -> str:
    for macro, pair in MACROS.items():
        sql = sql.replace(macro, pair[duck])
    out = ""
    while m := _SERIES.search(sql):  # SERIES(a, b): one row for each integer from a to b
        depth, at = 1, m.end()
        while depth:
            depth += {"(": 1, ")": -1}.get(sql[at], 0)
            at += 1
        inner = sql[m.end() : at - 1]
        out += sql[: m.start()] + (f"unnest(generate_series({inner}))" if duck else f"explode(sequence({inner}))")
        sql = sql[at:]
    return _DECIMAL.sub(r"\1e0", out + sql)


@dataclass
class Relation:
    name: str
    sql: str
    inputs: list[str] = field(init=False)

    def __post_init__(self) -> None:
        self.inputs = list(dict.fromkeys(re.findall(r"\{(\w+)\}", self.sql)))

    def apply(self, spark: SparkSession, **frames: DataFrame) -> DataFrame:
        """The relation over the given inputs."""
        return spark.sql(_dialect(self.sql, False), **{k: frames[k] for k in self.inputs})


class _Frames(dict):
    """Frames of relations that were built, and whether some were given from outside."""

    def __init__(self, frames: dict, given: bool) -> None:
        super().__init__(frames)
        self.given = given


class Catalog:
    """Relations by name; names that are none are tables."""

    def __init__(self) -> None:
        self.relations: dict[str, Relation] = {}
        self.queries: list[str] = []
        self.oracles: dict[str, str] = {}
        self.shared: set[str] = set()

    def add(self, name: str, sql: str, query: bool = True, oracle: str | None = None) -> Relation:
        """``oracle``: SQL written apart for the other engine, with its inputs named likewise."""
        if name in self.relations:
            raise ValueError(f"{name} is a relation already")
        out = self.relations[name] = Relation(name, sql)
        if query:
            self.queries.append(name)
        if oracle:
            self.oracles[name] = oracle
        return out

    def share(self, *names: str) -> None:
        """Relations that others read several times: they are written once and read from then on."""
        self.shared.update(names)

    def tables(self, name: str) -> list[str]:
        """The tables that a relation reads, directly or not."""
        if name not in self.relations:
            return [name]
        return sorted({t for i in self.relations[name].inputs for t in self.tables(i)})

    def text(self, name: str) -> str:
        """A relation's definition with those of its inputs."""
        return "" if name not in self.relations else self.relations[name].sql + "".join(self.text(i) for i in self.relations[name].inputs)

    def build(self, name: str, spark: SparkSession, sf_dir: str, frames: dict[str, DataFrame] | None = None) -> DataFrame:
        own_inputs = frames is not None and not isinstance(frames, _Frames)
        frames = frames if isinstance(frames, _Frames) else _Frames(frames or {}, own_inputs)
        if name not in frames:
            if name in self.relations:
                own = self.relations[name]

                def make() -> DataFrame:
                    return own.apply(spark, **{i: self.build(i, spark, sf_dir, frames) for i in own.inputs})

                if name in self.shared and not frames.given:  # inputs given by hand are no state of the tables
                    digest = store.key(spark, self.text(name), [f"{sf_dir}/{t}.parquet" for t in self.tables(name)])
                    frames[name] = store.kept(spark, name, digest, make)
                else:
                    frames[name] = make()
            else:
                frames[name] = spark.read.parquet(f"{sf_dir}/{name}.parquet")
        return frames[name]

    def oracle(self, name: str) -> str:
        order: list[str] = []

        own = {n: Relation(n, self.oracles.get(n, r.sql)) for n, r in self.relations.items()}

        def visit(n: str) -> None:
            if n in own and n not in order:
                for i in own[n].inputs:
                    visit(i)
                order.append(n)

        visit(name)
        text = {n: _dialect(own[n].sql, True).format(**{i: i for i in own[n].inputs}) for n in order}
        ctes = ",\n".join(f"{n} AS ({text[n]})" for n in order[:-1])
        return (f"WITH {ctes}\n" if ctes else "") + f"SELECT * FROM ({text[name]})"


CATALOG = Catalog()
