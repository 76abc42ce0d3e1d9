"""Addresses: parsing, rendering, classes and prefix labels, as column expressions.

An address is 16 bytes, an IPv4 one v4-mapped; so one set of prefixes, keys and classes serves both
families, however an address is written.
"""

from __future__ import annotations

import ipaddress

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Labels of well-known address prefixes.
PREFIX_LABELS = (
    ("8.8.8.0", 24, "Google Public DNS"),
    ("8.8.4.0", 24, "Google Public DNS"),
    ("1.1.1.0", 24, "Cloudflare Public DNS"),
    ("9.9.9.0", 24, "Quad9 Public DNS"),
    ("140.82.112.0", 20, "GitHub"),
    ("13.107.42.0", 24, "Microsoft"),
    ("172.217.0.0", 16, "Google"),
    ("142.250.0.0", 15, "Google"),
    ("104.16.0.0", 13, "Cloudflare"),
    ("151.101.0.0", 16, "Fastly"),
)


def v4_number(addr: Column) -> Column:
    """A dotted quad as a long; null if it is none. Octets have no leading zeros."""
    parts = F.split(addr, "\\.")
    octets = [F.get(parts, F.lit(i)).try_cast("long") for i in range(4)]
    number = sum((o * (1 << (24 - 8 * i)) for i, o in enumerate(octets)), F.lit(0).cast("long"))
    fine = addr.rlike(r"^(0|[1-9][0-9]{0,2})(\.(0|[1-9][0-9]{0,2})){3}\z")
    for o in octets:
        fine = fine & o.between(0, 255)
    return F.when(fine, number)


def render_address(raw: Column) -> Column:
    """16 bytes as text: v4-mapped as a dotted quad, else eight hex groups; zero or short is empty."""
    h = F.lower(F.hex(raw))
    quad = F.concat_ws(".", *(F.conv(F.substring(h, 25 + 2 * i, 2), 16, 10) for i in range(4)))
    groups = F.concat_ws(":", *(F.lower(F.conv(F.substring(h, 1 + 4 * i, 4), 16, 16)) for i in range(8)))
    return F.when((F.length(raw) != 16) | raw.isNull() | (h == "0" * 32), F.lit("")).when(h.startswith("0" * 20 + "ffff"), quad).otherwise(groups)


def mapped_bytes(addr: Column) -> Column:
    """A dotted quad as 16 v4-mapped bytes."""
    return F.unhex(_mapped_hex(addr))


def _mapped_hex(quad: Column) -> Column:
    return F.concat(F.lit(MAPPED), F.lower(F.lpad(F.hex(v4_number(quad)), 8, "0")))


MAPPED = "0" * 20 + "ffff"
GROUP = r"^[0-9a-f]{1,4}\z"


def _let(value: Column, body) -> Column:
    """Evaluate ``value`` once and use it several times in ``body``."""
    return F.transform(F.array(value), body)[0]


def address_hex(addr: Column) -> Column:
    """The 16 bytes of an address in any spelling, as 32 hex digits; null if it is none.

    IPv4 as a dotted quad; IPv6 as groups, shortened once by ``::``, with a dotted quad for the last
    two groups, in either case, with or without a zone after ``%``.
    """
    def spelled(text: Column) -> Column:
        # a quad at the end becomes two groups
        quad = F.regexp_extract(text, r"(?<=:)([0-9]+\.[0-9]+\.[0-9]+\.[0-9]+)$", 1)
        low = F.lower(F.lpad(F.hex(v4_number(quad)), 8, "0"))
        return F.when(quad == "", text).otherwise(F.concat(F.substring(text, F.lit(1), F.length(text) - F.length(quad)), F.substring(low, 1, 4), F.lit(":"), F.substring(low, 5, 4)))

    def groups(part: Column) -> Column:
        return F.when(part == "", F.array().cast("array<string>")).otherwise(F.split(part, ":"))

    def filled(halves: Column) -> Column:
        left, right = groups(F.get(halves, F.lit(0))), groups(F.coalesce(F.get(halves, F.lit(1)), F.lit("")))
        missing = F.lit(8) - F.size(left) - F.size(right)
        short = F.when(missing >= 1, F.concat(left, F.array_repeat(F.lit("0"), missing), right))
        return F.when(F.size(halves) == 1, left).when(F.size(halves) == 2, short)

    def joined(all_groups: Column) -> Column:
        fine = (F.size(all_groups) == 8) & F.forall(all_groups, lambda g: g.rlike(GROUP))
        return F.when(fine, F.array_join(F.transform(all_groups, lambda g: F.lpad(g, 4, "0")), ""))

    bare = F.regexp_replace(F.lower(addr), "(?<=:.{0,45})%[^%]+$", "")
    v6 = _let(_let(_let(bare, spelled), lambda t: filled(F.split(t, "::"))), joined)
    return F.when(addr.contains(":"), v6).otherwise(_mapped_hex(addr))


def address_bytes(addr: Column) -> Column:
    return F.unhex(address_hex(addr))


def ip_class(addr: Column) -> Column:
    """loopback, link_local, cgnat, private or public, tested in this order; null for no address."""

    def of(h: Column) -> Column:
        n = F.conv(F.substring(h, 25, 8), 16, 10).cast("long")

        def within(base: str, bits: int) -> Column:
            lo = int(ipaddress.IPv4Address(base))
            return n.between(lo, lo + (1 << (32 - bits)) - 1)

        v4 = (
            F.when(within("127.0.0.0", 8), "loopback").when(within("169.254.0.0", 16) | within("224.0.0.0", 24), "link_local").when(within("100.64.0.0", 10), "cgnat")
            .when(within("10.0.0.0", 8) | within("172.16.0.0", 12) | within("192.168.0.0", 16), "private").otherwise("public")
        )
        v6 = F.when(h == "0" * 31 + "1", "loopback").when(h.rlike("^(fe[89ab]|ff.2)"), "link_local").when(h.rlike("^f[cd]"), "private").otherwise("public")
        return F.when(h.isNull(), F.lit(None).cast("string")).when(h.startswith(MAPPED), v4).otherwise(v6)

    return _let(address_hex(addr), of)


def prefix_table(spark, prefixes=PREFIX_LABELS) -> DataFrame:
    """label, bits of 128, and the prefix's bytes with the bits beyond it cleared. prefixes: (address, bits of its family, label)."""
    rows = []
    for base, bits, label in prefixes:
        network = ipaddress.ip_network(f"{base}/{bits}", strict=False)
        raw = network.network_address.packed
        raw, bits = (raw, bits) if len(raw) == 16 else (bytes.fromhex(MAPPED) + raw, bits + 96)
        rows.append((label, bits, raw[: -(-bits // 8)]))
    return spark.createDataFrame(rows, "label string, bits int, net binary")


#: The first ``bits`` of the 32 hex digits ``_h``, as bytes.
NETWORK = """unhex(concat(substring(_h, 1, 2 * (bits div 8)),
  if(bits % 8 = 0, '', lpad(hex(conv(substring(_h, 2 * (bits div 8) + 1, 2), 16, 10) & (256 - shiftleft(1, 8 - bits % 8))), 2, '0'))))"""


def label_addresses(rows: DataFrame, prefixes: DataFrame, addr: str = "addr") -> DataFrame:
    """``rows`` with asn, the label of the longest prefix that contains the address, of either family.

    One equi-join on (length, network) for the lengths that the table has, instead of a range
    join: works alike for a few and for a million prefixes. Distinct addresses are joined once.
    """
    lengths = prefixes.select("bits").distinct()  # 129 rows at most
    asked = rows.select(F.col(addr).alias("_a")).where("_a is not null").distinct().withColumn("_h", address_hex(F.col("_a"))).where("_h is not null")
    keyed = asked.crossJoin(F.broadcast(lengths)).withColumn("net", F.expr(NETWORK))
    best = keyed.join(prefixes, ["bits", "net"]).groupBy("_a").agg(F.max_by("label", "bits").alias("asn"))
    return rows.join(best, F.col(addr) == F.col("_a"), "left").drop("_a")
