"""URL canonicalisation, features and scores as Column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from lodestone.functions.text import ascii_lower, let

TLDS = ["com", "org", "gov", "edu", "ca", "co.uk", "com.au", "uk", "au", "net", "mil", "int"]
REJECTED = "pdf doc docx xls xlsx zip exe jpg jpeg png gif bmp svg webp mp4 webm avi mov mkv flv mp3 wav aac flac m4a tar gz rar 7z".split()
CRAWLABLE = "html htm shtml xhtml php asp aspx jsp jspx cfm cgi pl py txt xml rss atom csv tsv".split()


def _trim(c: Column) -> Column:
    return F.regexp_replace(F.regexp_replace(c, r"(?s)^[ \t\n\x0B\f\r]+|[ \t\n\x0B\f\r]+\z", ""), r"/+\z", "")


def normalize(c: Column) -> Column:
    """Canonical http(s) URL: scheme and host folded, fragment and the path's trailing slashes dropped; empty if it isn't one."""

    def split(t: Column) -> Column:
        rest = F.regexp_extract(t, r"(?s)^.*?://([^#]*)", 1)
        return F.struct(ascii_lower(F.regexp_extract(t, r"(?s)^(.*?)://", 1)).alias("scheme"), F.regexp_extract(rest, r"^[^/?]*", 0).alias("host"), F.regexp_extract(rest, r"(?s)^[^/?]*(.*)\z", 1).alias("tail"))

    def join(u: Column) -> Column:
        path = F.regexp_replace(F.regexp_extract(u["tail"], r"^[^?]*", 0), r"/+\z", "")
        query = F.regexp_extract(u["tail"], r"(?s)\?.*\z", 0)
        return F.when(u["scheme"].isin("http", "https") & (u["host"] != ""), F.concat(u["scheme"], F.lit("://"), ascii_lower(u["host"]), path, query)).otherwise("")

    return let(_trim(F.coalesce(c, F.lit(""))), lambda t: let(split(t), join))


def remove_dots(path: Column) -> Column:
    """A path without empty, . and .. segments, by a fold over its segments."""
    parts = F.filter(F.split(path, "/"), lambda s: (s != "") & (s != "."))
    kept = F.aggregate(parts, F.array().cast("array<string>"), lambda acc, s: F.when(s == "..", F.slice(acc, F.lit(1), F.greatest(F.size(acc) - 1, F.lit(0)))).otherwise(F.concat(acc, F.array(s))))
    out = F.concat(F.lit("/"), F.array_join(kept, "/"))
    return F.when(path.endswith("/") & ~out.endswith("/"), F.concat(out, F.lit("/"))).otherwise(out)


def absolutize(raw: Column, source: Column, base: Column) -> Column:
    """A link as a canonical URL, relative to base or, without a usable one, to the page; empty if it can't be."""

    def split(context: Column) -> Column:
        whole = F.regexp_extract(F.regexp_extract(context, r"(?s)^.*?://[^/?]*(.*)\z", 1), r"^[^?]*", 0)
        return F.struct(F.regexp_extract(context, r"^(.*?)://", 1).alias("scheme"), F.regexp_extract(context, r"^.*?://[^/?]*", 0).alias("root"), F.when(whole == "", F.lit("/")).otherwise(whole).alias("path"))

    def resolve(link: Column, u: Column) -> Column:
        folder = F.regexp_extract(u["path"], r"^(.*/)[^/]*\z", 1)
        rooted = F.when(link.startswith("/"), link).otherwise(F.concat(F.when(folder == "", F.lit("/")).otherwise(folder), link))
        return (
            F.when((link == "") | link.startswith("#"), F.lit(""))
            .when(link.startswith("http://") | link.startswith("https://"), link)
            .when(link.rlike(r"^[^/?#:]*:") | (u["root"] == ""), F.lit(""))
            .when(link.startswith("//"), F.concat(u["scheme"], F.lit(":"), link))
            .when(link.startswith("?"), F.concat(u["root"], u["path"], link))
            .otherwise(F.concat(u["root"], let(rooted, remove_dots)))
        )

    context = let(normalize(base), lambda b: F.when(b != "", b).otherwise(normalize(source)))
    return normalize(let(_trim(F.coalesce(raw, F.lit(""))), lambda link: let(split(context), lambda u: resolve(link, u))))


def host_port(c: Column) -> Column:
    """What stands between :// and the path of a URL."""
    return F.regexp_extract(c, r"^[^:]*://([^/?#]*)", 1)


def host(c: Column) -> Column:
    """Host without user and port."""
    return F.regexp_extract(F.regexp_replace(host_port(c), r"^.*@", ""), r"^[^:]*", 0)


def origin(c: Column) -> Column:
    """scheme://host of a canonical URL."""
    return F.regexp_extract(c, r"^[^:]*://[^/?#]*", 0)


def path(c: Column) -> Column:
    """Everything behind the authority, query and fragment included."""
    rest = F.regexp_extract(c, r"(?s)^[^:]*://(.*)\z", 1)
    return F.substring(rest, F.length(F.regexp_extract(rest, r"^[^/?#]*", 0)) + 1, F.length(rest))


def is_https(c: Column) -> Column:
    return c.startswith("https://")


def saturate(c: Column, most: int) -> Column:
    return F.least(c, F.lit(most)).cast("long")


def features(c: Column) -> dict[str, Column]:
    """The numeric features of a URL, by name; byte lengths, saturating like the stored record's fields."""
    h, p = host(c), path(c)
    bare = F.regexp_extract(p, r"^[^?#]*", 0)
    trimmed = F.when(F.length(bare) > 1, F.regexp_replace(bare, r"/\z", "")).otherwise(bare)
    query = F.regexp_extract(p, r"^[^?#]*\?([^#]*)", 1)
    label = F.when(F.instr(h, ".") > 0, F.regexp_extract(h, r"([^.]*)\.[^.]*\z", 1)).otherwise(h)
    return {
        "host": h,
        "url_path": p,
        "tld": F.when(F.instr(h, ".") > 0, ascii_lower(F.substring_index(h, ".", -1))).otherwise(""),
        "url_length": saturate(F.octet_length(c), 65535),
        "path_length": saturate(F.octet_length(p), 65535),
        "path_depth": saturate(F.regexp_count(trimmed, F.lit("/")), 255),
        "base_domain_length": saturate(F.octet_length(label), 255),
        "query_param_count": saturate(F.size(F.filter(F.split(query, "&"), lambda s: s != "")), 255),
        "numeric_path_char_count": saturate(F.regexp_count(bare, F.lit("[0-9]")), 255),
        "domain_hyphen_count": saturate(F.regexp_count(h, F.lit("-")), 255),
        "is_ip": h.rlike(r"^[0-9]{1,3}(\.[0-9]{1,3}){3}$"),
    }


def allowed_tld(c: Column) -> Column:
    """Whether a canonical URL's host ends in an allowed top-level domain."""
    hp = F.regexp_replace(F.regexp_extract(c, r"^[^:]*://([^/?]*)", 1), r"^[^@]*@", "")
    h = F.regexp_replace(F.regexp_replace(hp, r":[^:]*\z", ""), r"\.+\z", "")
    return ~hp.startswith("[") & h.rlike(r"(^|\.)(" + "|".join(t.replace(".", r"\.") for t in TLDS) + r")\z")


def bad_extension(c: Column) -> Column:
    """Whether the whole URL ends in a media or archive suffix (a query string hides it)."""
    return c.rlike(r"(?i)\.(" + "|".join(REJECTED) + r")\z")


def fair_percent_encoding(c: Column) -> Column:
    """At most 8 percent signs, or at most a tenth of a tail of 24 bytes or more."""
    rest = F.regexp_extract(c, r"(?s)^.*?://(.*)\z", 1)
    tail = F.substring(rest, F.length(F.regexp_extract(rest, r"^[^/?]*", 0)) + 1, F.length(rest))
    signs, size = F.regexp_count(tail, F.lit("%")), F.octet_length(tail)
    return (signs <= 8) | ((size >= 24) & (signs <= 0.1 * size))


def passes_quality(c: Column) -> Column:
    """Canonical, in an allowed domain, no media suffix, no heavy encoding."""
    return let(normalize(c), lambda n: (n != "") & allowed_tld(n) & ~bad_extension(n) & fair_percent_encoding(n))


def crawlable_extension(c: Column) -> Column:
    """The last path segment has no dot, or the path ends in a text suffix."""
    p = F.regexp_extract(c, r"^[^:]*://[^/]*(/[^?#]*)", 1)
    return ~p.rlike(r"\.[^/]*\z") | p.rlike(r"(?i)\.(" + "|".join(CRAWLABLE) + r")\z")


def frontier_host_path(c: Column) -> tuple[Column, Column]:
    """Host up to the first slash behind ://, and the rest."""
    rest = F.regexp_extract(c, r"(?s)^.*?://(.*)\z", 1)
    h = F.regexp_extract(rest, r"^[^/]*", 0)
    return h, F.substring(rest, F.length(h) + 1, F.length(rest))


def suffix_of(h: Column) -> tuple[Column, Column]:
    """(suffix class, base length) of a host; two-label suffixes count under uk, au and ca."""
    dots = F.size(F.split(h, r"\.")) - 1
    last, two = F.substring_index(h, ".", -1), F.substring_index(h, ".", -2)
    double = last.isin("uk", "au", "ca") & (dots >= 2)
    name = F.when(dots < 1, F.lit("")).when(double, two).otherwise(last)
    kind = F.coalesce(*[F.when(name.isin(*v), F.lit(k)) for k, v in (("EDU", ["edu"]), ("GOV", ["gov"]), ("ORG", ["org", "co.uk", "ca", "uk", "au"]), ("COM", ["com", "com.au"]), ("NET", ["net"]), ("MIL", ["mil"]), ("INT", ["int"]))], F.lit("OTHER"))
    label = F.when(dots < 1, h).when(double, F.element_at(F.split(h, r"\."), -3)).otherwise(F.when(dots >= 1, F.element_at(F.concat(F.array(F.lit("")), F.split(h, r"\.")), -2)))
    return kind, F.length(label).cast("long")


def suffix_score(kind: Column) -> Column:
    return F.when(kind.isin("EDU", "GOV"), 4.0).when(kind.isin("ORG", "COM"), 3.0).when(kind.isin("NET", "MIL", "INT"), 2.0).otherwise(0.0)


def path_score(p: Column) -> Column:
    """Cues in a path: home pages up, listings, accounts and trackers down, articles up."""
    low = ascii_lower(p)

    def cue(words: str, value: float) -> Column:
        return F.when(low.rlike(words), value).otherwise(0.0)

    sums = cue("/search|/filter|/tag/|/category/|/archive/|/date/", -1.5) + cue("/admin|/login|/account|/settings", -2.0) + cue("/ads/|/tracking/|/analytics/", -3.0) + cue("/blog|/article|/news|/tutorial|/guide|/docs|/post", 1.0)
    return F.when(p.isin("/", "/index.html"), 2.0).otherwise(sums)


def frontier_depth(p: Column) -> Column:
    """Slashes of a path and its query, one trailing slash aside."""
    t = F.when(F.length(p) > 1, F.regexp_replace(p, r"/\z", "")).otherwise(p)
    return F.regexp_count(t, F.lit("/")).cast("long")


def query_score(c: Column) -> Column:
    q = F.regexp_extract(c, r"(?s)\?(.*)\z", 1)
    return F.when((F.instr(c, "?") > 0) & ((F.regexp_count(q, F.lit("&")) >= 2) | (F.octet_length(q) > 100)), -0.5).otherwise(0.0)


def subdomain_score(h: Column) -> Column:
    return F.when(ascii_lower(h).rlike(r"^(ads|tracking|mail|smtp|ftp)\."), -2.0).otherwise(0.0)


def frontier_score(c: Column, seed_distance: Column, failed: Column) -> Column:
    """Priority of a URL in the crawl frontier."""
    h, p = frontier_host_path(c)
    kind, base = suffix_of(h)
    return suffix_score(kind) - 0.1 * base - 0.2 * frontier_depth(p) - 3.0 * seed_distance - F.when(failed, 10.0).otherwise(0.0) + path_score(p) + query_score(c) + subdomain_score(h)
