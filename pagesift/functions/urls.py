"""URLs: parts, normal form, authority tier and screening."""

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from pagesift import constants as K

#: Scheme, authority, path and query by RFC 3986.
SPLIT = r"^(?:([A-Za-z][A-Za-z0-9+.-]*):)?(?://([^/?#]*))?([^?#]*)(?:\?([^#]*))?(?:#.*)?$"


def part(url: Column, group: int) -> Column:
    return F.regexp_extract(F.coalesce(url, F.lit("")), SPLIT, group)


def domain(url: Column) -> Column:
    return F.lower(part(url, 2))


def host(url: Column) -> Column:
    return F.regexp_replace(domain(url), r"^www\.", "")


def normalize(url: Column) -> Column:
    """Lower-case scheme and authority, path without trailing slashes (`/` if empty), query kept, fragment dropped."""
    path = F.regexp_replace(part(url, 3), "/+$", "")
    query = part(url, 4)
    return F.concat(
        F.lower(part(url, 1)), F.lit("://"), domain(url), F.when(path == "", "/").otherwise(path), F.when(query == "", "").otherwise(F.concat(F.lit("?"), query))
    )


def quote_plus(text: Column) -> Column:
    """Percent-encoded, blanks as `+`; letters, digits and `_.-~` stand as they are."""
    return F.replace(F.replace(F.url_encode(text), F.lit("*"), F.lit("%2A")), F.lit("%7E"), F.lit("~"))


def ensure_scheme(url: Column) -> Column:
    return F.when(url.startswith("http://") | url.startswith("https://"), url).otherwise(F.concat(F.lit("https://"), url))


def tier(url: Column) -> Column:
    """Authority from 1 (official) to 5: exact hosts first, then top-level domains, signs of documentation, the rest."""
    h, path = host(url), F.lower(part(url, 3))
    known = [h.isin(*hosts) for hosts in K.TIERS.values()]
    out = F.when(known[0], 1)
    for n, is_known in zip((2, 3, 4), known[1:], strict=True):
        out = out.when(is_known, n)
    on_path = F.lit(False)
    for p in K.DOC_PATHS:
        on_path = on_path | path.contains(p)
    at_start, tech = F.lit(False), F.lit(False)
    for p in K.DOC_SUBDOMAINS:
        at_start = at_start | h.startswith(p)
    for d in K.TECH_DOMAINS:
        tech = tech | h.endswith(d)
    out = out.when(h.rlike(r"\.(gov|mil|int)$"), 1).when(h.endswith(".edu") | h.endswith(".ac.uk"), 2)
    return out.when(at_start, 1).when(on_path, F.when(tech, 1).otherwise(4)).otherwise(5)


def blacklisted(url: Column) -> Column:
    return domain(url).isin(*K.BLACKLISTED)


def decode_redirect(url: Column) -> Column:
    """The target of a search engine's redirect link (`uddg=`, or `/url?` with `url=`); `//x` gets https; else the URL itself."""
    plain = F.when(url.startswith("//"), F.concat(F.lit("https:"), url)).otherwise(url)
    found = F.when(
        plain.contains("uddg="), F.regexp_extract(plain, "uddg=([^&]+)", 1)
    ).when(plain.startswith("/url?"), F.regexp_extract(plain, "[?&]url=([^&]+)", 1))
    return F.coalesce(F.nullif(F.try_url_decode(F.replace(found, F.lit("+"), F.lit("%2B"))), F.lit("")), plain)


def source_name(url: Column) -> Column:
    """The name of the first known part that the host holds, wherever it stands; else the host's first label."""
    h, out = host(url), F
    for part_of, name in K.SOURCE_NAMES.items():
        out = out.when(h.contains(part_of), name)
    return out.otherwise(F.regexp_extract(h, r"^([^.]*)", 1))


def _hex4(text: Column) -> Column:
    """A dotted IPv4 address as eight hexadecimal digits; null for what is none (leading zeros, numbers over 255)."""
    number = "(25[0-5]|2[0-4][0-9]|1[0-9]{2}|[1-9]?[0-9])"
    digits = F.transform(F.split(text, r"\."), lambda x: F.lpad(F.lower(F.hex(x.try_cast("int"))), 2, "0"))
    return F.when(text.rlike(rf"^{number}(\.{number}){{3}}\z"), F.array_join(digits, ""))


def bound(value: Column, of) -> Column:
    """of(value), where value is worked out once however often it is used."""
    return F.get(F.transform(F.array(value), of), F.lit(0))


def _hex6(text: Column) -> Column:
    """An IPv6 address, its last part dotted or not, as 32 hexadecimal digits; null for what is none."""

    def undotted(t):
        last = F.regexp_extract(t, r"([0-9.]*\.[0-9.]*)\z", 1)
        tail = lambda x: F.concat(F.regexp_extract(t, r"^(.*:)[0-9.]*\z", 1), F.substring(x, 1, 4), F.lit(":"), F.substring(x, 5, 4))
        return F.when(last == "", t).otherwise(bound(_hex4(last), tail))

    def whole(sides):
        groups = lambda i: F.when(F.coalesce(F.get(sides, F.lit(i)), F.lit("")) != "", F.split(F.get(sides, F.lit(i)), ":", -1))
        parts = F.struct(*[F.coalesce(groups(i), F.array().cast("array<string>")).alias(n) for i, n in ((0, "left"), (1, "right"))], F.size(sides).alias("n"))
        return bound(parts, filled)

    def filled(p):
        n = F.size(p["left"]) + F.size(p["right"])
        zeros = F.when((p["n"] == 2) & (n <= 7), F.array_repeat(F.lit("0"), 8 - n)).when((p["n"] == 1) & (n == 8), F.array().cast("array<string>"))
        return bound(F.concat(p["left"], zeros, p["right"]), padded)

    def padded(groups):
        ok = F.forall(groups, lambda g: g.rlike(r"^[0-9a-fA-F]{1,4}\z"))
        return F.when(ok, F.array_join(F.transform(groups, lambda g: F.lpad(F.lower(g), 4, "0")), ""))

    return F.when(text.contains(":"), bound(F.split(undotted(text), "::", -1), whole))


def _within(number: Column, ranges) -> Column:
    """Whether a fixed-width number lies in one of the ranges (first, last)."""
    out = F.lit(False)
    for first, last in ranges:
        out = out | number.between(first, last)
    return out


def public_address(address: Column) -> Column:
    """Whether an IP address (IPv4, IPv6, IPv4 inside IPv6) is public; null for what is none.

    Addresses become hexadecimal numbers of a fixed width, which sort as the addresses do, and are looked up in the
    disjoint ranges of the special registries. A zone (`%eth0`) doesn't count.
    """
    def found(h):
        four = F.coalesce(h["four"], F.when(h["six"].startswith("0" * 20 + "ffff"), F.substring(h["six"], 25, 8)))
        return F.when(four.isNotNull(), ~_within(four, K.SPECIAL_V4)).when(h["six"].isNotNull(), ~_within(h["six"], K.SPECIAL_V6))

    text = F.regexp_extract(F.coalesce(address, F.lit("")), r"^([^%]*)", 1)
    return bound(text, lambda t: bound(F.struct(_hex4(t).alias("four"), _hex6(t).alias("six")), found))


def bare_host(url: Column) -> Column:
    """The host without credentials, port, brackets and trailing dots."""
    at_host = F.regexp_replace(domain(url), "^.*@", "")
    return F.regexp_replace(F.regexp_replace(at_host, r"^\[(.*)\](:[0-9]*)?$|^([^\[:]*)(:[0-9]*)?$", "$1$3"), r"\.+$", "")


def unsafe_reason(url: Column) -> Column:
    """Why a URL must not be fetched, by the first of: scheme, credentials, no host, localhost, address that isn't public; null if safe."""
    h, who = bare_host(url), F.regexp_extract(part(url, 2), "^(.*)@", 1)
    return (
        F.when(~F.lower(part(url, 1)).isin("http", "https"), "scheme")
        .when(~who.isin("", ":"), "credentials")
        .when(h == "", "no_host")
        .when((h == "localhost") | h.endswith(".localhost"), "localhost")
        .when(~F.coalesce(public_address(h), F.lit(True)), "private_address")
    )


def screen_resolved(urls: DataFrame, dns: DataFrame) -> DataFrame:
    """urls(url, ...) with reason: unsafe_reason's; for names, by dns(host, ip), `unresolved` without a row, `private_address` if any isn't public."""
    known = dns.select(
        F.lower("host").alias("__host"), F.coalesce(public_address(F.col("ip")), F.lit(False)).alias("public")
    ).groupBy("__host").agg(F.min("public").alias("__public"))
    rows = urls.withColumns(
        {"__host": bare_host(F.col("url")), "reason": unsafe_reason(F.col("url"))}
    ).withColumn("__literal", public_address(F.col("__host")))
    late = F.when(F.col("__literal").isNotNull(), None).when(F.col("__public").isNull(), "unresolved").when(~F.col("__public"), "private_address")
    return rows.join(known, "__host", "left").withColumn("reason", F.coalesce("reason", late)).drop("__host", "__public", "__literal")


def frontier_score(url: Column, root: Column) -> Column:
    """How much a link is worth crawling from its root: deep, descriptive paths most; dead ends and the root itself 0."""
    segments = F.filter(F.split(F.lower(part(url, 3)), "/"), lambda s: s != "")
    last = F.coalesce(F.try_element_at(segments, F.lit(-1)), F.lit(""))
    score = F.lit(10) + 5 * F.least(F.size(segments), F.lit(5)) - F.when(part(url, 4) != "", 8).otherwise(0)
    score = score - F.when(last.rlike("^[0-9]+$"), 6).otherwise(0) + F.when(last.rlike(r"^[a-z\-À-ɏ]+$"), 4).otherwise(0)
    same = (part(url, 3) == part(root, 3)) & (part(url, 4) == part(root, 4))
    return F.when(same | F.arrays_overlap(segments, F.array(*map(F.lit, K.DEAD_ENDS))), 0).otherwise(F.greatest(score, F.lit(0)))


def select_frontier(links: DataFrame, n: int = 99, like: int = 5) -> DataFrame:
    """Of links(root, url, pos): root, url, score and rank of the n best of each root, `like` at most of one pattern of path (digits alike).

    URLs lose trailing slashes and count once, where they stand first. Every window is cut by its rank, so Spark limits
    each group before it is shuffled; a root with very many links doesn't gather in one task.
    """
    once = links.select(
        "root", F.regexp_replace("url", "/+$", "").alias("url"), "pos"
    ).where("url <> ''").groupBy("root", "url").agg(F.min("pos").alias("pos"))
    ending = "(" + "|".join(x.replace(".", r"\.") for x in K.SKIPPED_EXTENSIONS) + ")$"
    rows = once.where(
        ~F.regexp_extract(F.lower("url"), r"^([^?]*)", 1).rlike(ending)
    ).withColumn("score", frontier_score(F.col("url"), F.col("root"))).where("score > 0")
    rows = rows.withColumn("pattern", F.regexp_replace(part(F.col("url"), 3), "[0-9]+", "N"))
    rows = rows.withColumn("k", F.row_number().over(W.partitionBy("root", "pattern").orderBy("pos", "url"))).where(F.col("k") <= like)
    return rows.withColumn(
        "rank", F.row_number().over(W.partitionBy("root").orderBy(F.desc("score"), "url"))
    ).where(F.col("rank") <= n).select("root", "url", "score", "rank")
