"""robots.txt: parsing to a rule table, and verdicts by join and rank."""

from __future__ import annotations

import re

import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from lodestone.session import ship

RULES = "origin string, rule_id int, agent string, match_any boolean, allow boolean, pattern string, literal_bytes int, ends_dollar boolean, regex string, crawl_delay int"
_STATEMENT = re.compile(r"[ \t]*(user-agent|allow|disallow|crawl-delay|sitemap)[ \t]*:[ \t]*(\S*)", re.I)


def decode(path: str) -> str:
    """%xx decoded once, but an encoded slash is kept."""
    return re.sub(r"%([0-9a-fA-F]{2})", lambda m: m[0].lower() if m[1].lower() == "2f" else chr(int(m[1], 16)), path)


def parse(text: str | None) -> tuple[list[tuple], list[str]]:
    """([(rule, agent, any, allow, pattern, literal bytes, $, regex, delay)], sitemaps)."""
    groups: list[dict] = []
    sitemaps: list[str] = []
    fresh = False
    for line in re.split(r"[\r\n]+", (text or "").removeprefix("﻿")):
        m = _STATEMENT.match(line)
        if not m:
            continue
        kind, arg = m[1].lower(), m[2]
        if kind == "sitemap":
            sitemaps.append(arg)
        elif kind == "user-agent":
            if not fresh:
                groups.append({"agents": [], "rules": [], "delay": 0})
            groups[-1]["agents"].append(arg)
            fresh = True
        elif groups:
            fresh = False
            if kind == "crawl-delay":
                groups[-1]["delay"] = int(re.match(r"\d*", arg)[0] or 0)
            elif arg:  # an empty argument restricts nothing
                groups[-1]["rules"].append((kind == "allow", arg))
    rows = []
    for number, g in enumerate(groups):
        for allow, arg in g["rules"]:
            pattern = decode(arg.removeprefix("/"))
            dollar = pattern.endswith("$")
            pattern = pattern.removesuffix("$")
            regex = "(?s)^" + ".*".join(re.escape(x) for x in pattern.split("*")) + ("$" if dollar else "")
            for agent in g["agents"]:
                rows.append((number, agent.lower(), agent in ("*", ""), allow, pattern, len(pattern.replace("*", "").encode()), dollar, regex, g["delay"]))
    return rows, sitemaps


def parse_robots(robots: DataFrame) -> DataFrame:
    """(origin, text) to the rule table."""
    ship(robots.sparkSession)

    def run(batches):
        for pdf in batches:
            rows = [(o, *r) for o, t in zip(pdf["origin"], pdf["text"], strict=True) for r in parse(t)[0]]
            yield pd.DataFrame(rows, columns=["origin", "rule_id", "agent", "match_any", "allow", "pattern", "literal_bytes", "ends_dollar", "regex", "crawl_delay"])

    return robots.select("origin", "text").mapInPandas(run, RULES)


def parse_sitemaps(robots: DataFrame) -> DataFrame:
    ship(robots.sparkSession)

    def run(batches):
        for pdf in batches:
            rows = [(o, s) for o, t in zip(pdf["origin"], pdf["text"], strict=True) for s in parse(t)[1]]
            yield pd.DataFrame(rows, columns=["origin", "sitemap"])

    return robots.select("origin", "text").mapInPandas(run, "origin string, sitemap string")


def decoded_path(path):
    """``decode`` of the path without its first slash, for the paths that need it; others stay in the JVM."""

    @F.pandas_udf("string")
    def run(s: pd.Series) -> pd.Series:
        return s.map(lambda p: None if p is None else decode(p))

    bare = F.regexp_replace(path, "^/", "")
    return F.when(F.instr(bare, "%") > 0, run(bare)).otherwise(bare)


def verdicts(requests: DataFrame, rules: DataFrame) -> DataFrame:
    """``requests`` (origin, user, path, ...) with allowed and crawl_delay.

    Of the directives whose agent is a part of the user's name and whose pattern matches, the one decides that has a
    literal agent, the most literal bytes, a $, and allows, in this order; none: allowed. crawl_delay is the
    greatest of the rules that matched."""
    ship(requests.sparkSession)
    keyed = requests.withColumn("_q", F.struct(*requests.columns)).withColumn("_p", decoded_path(F.col("path")))
    hit = keyed.join(rules.withColumnRenamed("origin", "_o"), (F.col("origin") == F.col("_o")) & (F.col("match_any") | F.contains(F.lower("user"), F.col("agent"))) & F.regexp_like("_p", F.col("regex")))
    best = hit.groupBy("_q").agg(
        F.max_by("allow", F.struct((~F.col("match_any")).cast("int"), F.col("literal_bytes"), F.col("ends_dollar").cast("int"), F.col("allow").cast("int"))).alias("_allow"),
        F.max("crawl_delay").alias("_delay"),
    )
    out = keyed.drop("_p").join(best, "_q", "left")
    return out.select(*requests.columns, F.coalesce("_allow", F.lit(True)).alias("allowed"), F.coalesce("_delay", F.lit(0)).cast("long").alias("crawl_delay"))


def directive_ranks(rules: DataFrame) -> DataFrame:
    """Rules with their precedence inside an origin and agent, as the window that the verdict's maximum stands for."""
    by = Window.partitionBy("origin", "agent").orderBy(F.desc("literal_bytes"), F.desc("ends_dollar"), F.desc("allow"), "pattern")
    return rules.withColumn("precedence", F.row_number().over(by).cast("long"))
