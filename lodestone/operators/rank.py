"""Static document score as one Column expression over feature columns."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column
from pyspark.sql import functions as F


@dataclass(frozen=True)
class RankConfig:
    seed: float = 3.30
    words: float = 0.90
    title: float = 0.45
    thin: float = -0.20
    long: float = -0.20
    https: float = 0.35
    body: float = 0.25
    close_html: float = 0.25
    truncated: float = -0.75
    open_discard: float = -0.50
    url: float = 0.55
    path: float = 0.95
    depth: float = 1.15
    params: float = 0.95
    digits: float = 0.75
    hyphens: float = 0.45
    base_domain: float = 0.35
    links: float = 0.30
    anchors: float = 0.20


TLD = {"gov": 0.35, "edu": 0.35, "org": 0.20, "com": 0.10, "net": 0.05}


def falls(v: Column, scale: float) -> Column:
    """1 / (1 + v/scale), 1 where v <= 0."""
    return F.when(v <= 0, 1.0).otherwise(1.0 / (1.0 + v / scale))


def saturates(v: Column, half: float) -> Column:
    """v / (v + half), 0 where v <= 0."""
    return F.when(v <= 0, 0.0).otherwise(v / (v + half))


def flag(c: Column, value: float) -> Column:
    return F.when(c, value).otherwise(0.0)


def url_score(f: dict[str, Column], c: RankConfig = RankConfig()) -> Column:
    base = f["base_domain_length"]
    return (
        c.url * falls(f["url_length"], 60.0)
        + c.path * falls(f["path_length"], 20.0)
        + c.depth * falls(f["path_depth"], 1.2)
        + c.params * falls(f["query_param_count"], 0.8)
        + c.digits * falls(f["numeric_path_char_count"], 1.0)
        + c.hyphens * falls(f["domain_hyphen_count"], 1.0)
        + flag((base >= 3) & (base <= 20), c.base_domain)
    )


def tld_score(tld: Column) -> Column:
    out = F.lit(0.0)
    for name, value in TLD.items():
        out = F.when(tld == name, value).otherwise(out)
    return out


def content_score(words: Column, title_words: Column, seed_distance: Column, c: RankConfig = RankConfig()) -> Column:
    """Provenance and content, which need no URL features."""
    return c.seed * falls(seed_distance, 1.0) + c.words * saturates(words, 500.0) + c.title * saturates(title_words, 6.0) + flag(words < 45, c.thin) + flag(words > 5000, c.long)


def static_score(f: dict[str, Column], features_present: Column, c: RankConfig = RankConfig()) -> Column:
    """``f``: the URL features and words, title_words, seed_distance, https, saw_body, saw_close_html, truncated, open_discard, link_count, anchor_words."""
    rest = (
        flag(f["https"], c.https) + flag(f["saw_body"], c.body) + flag(f["saw_close_html"], c.close_html) + flag(f["truncated"], c.truncated) + flag(f["open_discard"], c.open_discard)
        + url_score(f, c) + tld_score(f["tld"]) + c.links * saturates(f["link_count"], 20.0) + c.anchors * saturates(f["anchor_words"], 80.0)
    )
    return content_score(f["words"], f["title_words"], f["seed_distance"], c) + F.when(features_present, rest).otherwise(0.0)
