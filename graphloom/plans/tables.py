"""The driver's tables as graphs: specifications, and the same triples as SQL."""

from __future__ import annotations

import os

from pyspark.sql import DataFrame, SparkSession

from ..operators.mapping import KINDS, ClassSpec, Property, triplify
from ..schema import TYPE

BASE = "http://data.example/"
V = BASE + "v#"


def _spec(name: str, cls: str, key: str, **columns: str) -> ClassSpec:
    props = []
    for column, kind in columns.items():
        if kind.startswith("@"):
            props.append(Property(column, V + column, "iri", f"{BASE}{kind[1:]}/{{}}"))
        else:
            props.append(Property(column, V + column, kind))
    return ClassSpec(V + cls, f"{BASE}{name}/{{}}", key, tuple(props))


SPECS = {
    "region": _spec("region", "Region", "r_regionkey", r_name="string"),
    "nation": _spec("nation", "Nation", "n_nationkey", n_name="string", n_regionkey="@region"),
    "customer": _spec("customer", "Customer", "c_custkey", c_name="string", c_nationkey="@nation", c_acctbal="decimal", c_mktsegment="string"),
    "supplier": _spec("supplier", "Supplier", "s_suppkey", s_name="string", s_nationkey="@nation", s_acctbal="decimal"),
    "part": _spec("part", "Part", "p_partkey", p_name="string", p_brand="string", p_type="string", p_size="integer", p_retailprice="decimal"),
    "orders": _spec("orders", "Order", "o_orderkey", o_custkey="@customer", o_orderstatus="string", o_totalprice="decimal", o_orderdate="date", o_orderpriority="string"),
    "events": _spec("events", "Event", "event_id", ts="dateTime", user_id="@user", event_type="string", value="decimal"),
}


def read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(os.path.join(sf_dir, f"{name}.parquet"))


def quads(spark: SparkSession, sf_dir: str, *names: str, graphs: bool = False) -> DataFrame:
    """Tables as one quad table; with ``graphs`` each in a graph of its own."""
    out = None
    for name in names:
        part = triplify(read(spark, sf_dir, name), SPECS[name], f"{BASE}g/{name}" if graphs else None)
        out = part if out is None else out.unionByName(part)
    return out


def _lexical_sql(column: str, kind: str) -> str:
    if kind == "decimal":
        return f"CAST(CAST({column} AS DECIMAL(18,2)) AS VARCHAR)"
    if kind == "date":
        return f"strftime({column}, '%Y-%m-%d')"
    if kind == "dateTime":
        return f"strftime({column}, '%Y-%m-%dT%H:%M:%S.%f')"
    return f"CAST({column} AS VARCHAR)"


def quads_sql(*names: str, graphs: bool = False) -> str:
    """SQL of the same rows."""
    out = []
    for name in names:
        spec = SPECS[name]
        g = f"CAST(0 AS TINYINT) AS g_kind, '{BASE}g/{name}' AS g" if graphs else "CAST(NULL AS TINYINT) AS g_kind, CAST(NULL AS VARCHAR) AS g"
        head = f"SELECT {g}, CAST(0 AS TINYINT) AS s_kind, '{BASE}{name}/' || {spec.key} AS s, "
        out.append(f"{head}'{TYPE}' AS p, CAST(0 AS TINYINT) AS o_kind, '{spec.iri}' AS o, CAST(NULL AS VARCHAR) AS o_dt, CAST(NULL AS VARCHAR) AS o_lang FROM {name}")
        for p in spec.properties:
            if p.kind == "iri":
                out.append(f"{head}'{p.predicate}', CAST(0 AS TINYINT), '{p.template[:-2]}' || {p.column}, NULL, NULL FROM {name} WHERE {p.column} IS NOT NULL")
            else:
                out.append(f"{head}'{p.predicate}', CAST(2 AS TINYINT), {_lexical_sql(p.column, p.kind)}, '{KINDS[p.kind]}', NULL FROM {name} WHERE {p.column} IS NOT NULL")
    return " UNION ALL ".join(out)
