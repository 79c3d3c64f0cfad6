"""Routes of endpoints, and the client calls that reach them."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.text import edge_module_key, join_route, route_pattern
from ..sources.parse import HTTP_METHODS


def router_of(decorators: Column) -> Column:
    """The router that the first route decorator of a JSON list hangs off, '' if none does."""
    names = F.transform(F.from_json(decorators, "array<string>"), lambda x: F.split_part(x, F.lit("("), F.lit(1)))
    hit = F.filter(names, lambda x: F.lower(F.substring_index(x, ".", -1)).isin(*HTTP_METHODS) & F.contains(x, F.lit(".")))
    return F.coalesce(F.regexp_extract(F.try_element_at(hit, F.lit(1)), r"^(.*)\.[^.]*$", 1), F.lit(""))


def full_routes(endpoints: DataFrame, prefixes: DataFrame) -> DataFrame:
    """unit_id, method, route, full_route of ``endpoints`` (unit_id, path, method, route,
    decorators_json): the route behind the prefix of its router, of several prefixes the
    last in order. ``prefixes``: module, router, prefix. Prefixes aren't composed; an
    endpoint whose router has none keeps its route."""
    one = prefixes.groupBy("module", "router").agg(F.max("prefix").alias("prefix"))
    rows = endpoints.select("unit_id", "method", "route", edge_module_key(F.col("path")).alias("module"), router_of(F.col("decorators_json")).alias("router"))
    got = rows.join(one, ["module", "router"], "left")
    return got.select("unit_id", "method", "route", join_route(F.coalesce("prefix", F.lit("")), F.col("route")).alias("full_route"))


def bound_calls(calls: DataFrame, routes: DataFrame) -> DataFrame:
    """``calls`` (path, line, url, method) with pattern and unit_id: the owner of the route
    of that method and pattern if it is the only one, else null; '' is no url."""
    owners = routes.groupBy("method", route_pattern(F.col("full_route")).alias("pattern")).agg(F.min("unit_id").alias("unit_id"), F.countDistinct("unit_id").alias("n")).where("n = 1").drop("n")
    asked = calls.withColumn("pattern", F.when(F.col("url") != "", route_pattern(F.col("url"))))
    return asked.join(owners, ["method", "pattern"], "left").select(*calls.columns, "pattern", "unit_id")


def unbound_reason(url: Column) -> Column:
    """Why a call without an owner has none; 'no route' only for a literal url."""
    return F.when(url == "", "computed").when(F.contains(url, F.lit("${")), "interpolated").otherwise("no route")


def client_callers(bound: DataFrame) -> DataFrame:
    """(unit_id, callers): per handler its client calls, "path:line — METHOD url", in order."""
    line = F.format_string("%s:%d — %s %s", "path", "line", "method", "url")
    return bound.where("unit_id is not null").groupBy("unit_id").agg(F.array_sort(F.collect_set(line)).alias("callers"))
