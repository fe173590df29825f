"""Addresses: IPv4 as numbers, in columns; of both versions as canonical texts, on Arrow batches."""

from __future__ import annotations

import ipaddress

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import BooleanType, IntegerType, StringType, StructType

#: Networks that aren't public, as first address and prefix length.
NOT_PUBLIC = [("0.0.0.0", 8), ("10.0.0.0", 8), ("100.64.0.0", 10), ("127.0.0.0", 8), ("169.254.0.0", 16), ("172.16.0.0", 12), ("192.0.0.0", 24), ("192.0.2.0", 24), ("192.168.0.0", 16), ("198.18.0.0", 15), ("198.51.100.0", 24), ("203.0.113.0", 24), ("224.0.0.0", 4), ("240.0.0.0", 4)]


def number_of(address: str) -> int:
    out = 0
    for part in address.split("."):
        out = out * 256 + int(part)
    return out


def ip_number(c: Column) -> Column:
    """A dotted quad as a number; null for what is none, octets over 255 included."""
    parts = F.split(F.trim(c), r"\.")
    octets = F.transform(parts, lambda p: F.when(p.rlike("^[0-9]{1,3}$"), p.cast("bigint")))
    ok = (F.size(parts) == 4) & F.forall(octets, lambda o: F.coalesce(o <= 255, F.lit(False)))
    return F.when(ok, F.aggregate(octets, F.lit(0).cast("bigint"), lambda a, o: a * 256 + o))


def ip_text(n: Column) -> Column:
    """A number as a dotted quad."""
    return F.concat_ws(".", *[(F.shiftright(n, s).bitwiseAND(F.lit(255))).cast("string") for s in (24, 16, 8, 0)])


def in_networks(n: Column, networks: list[tuple[str, int]]) -> Column:
    out = F.lit(False)
    for first, bits in networks:
        lo = number_of(first)
        out = out | n.between(lo, lo + (1 << (32 - bits)) - 1)
    return out


def is_private(n: Column) -> Column:
    """Whether an address isn't public; null for null."""
    return in_networks(n, NOT_PUBLIC)


def cidr_range(c: Column) -> Column:
    """struct<lo, hi> of 'a.b.c.d/n'; null for what is no network. Host bits are cut off."""
    base = ip_number(F.substring_index(c, "/", 1))
    bits = F.when(F.instr(c, "/") > 0, F.substring_index(c, "/", -1).try_cast("int")).otherwise(32)
    size = F.pow(F.lit(2), F.lit(32) - bits).cast("bigint")
    lo = base - base % size
    return F.when(base.isNotNull() & bits.between(0, 32), F.struct(lo.alias("lo"), (lo + size - 1).alias("hi")))


def read_address(text: str | None) -> ipaddress.IPv4Address | ipaddress.IPv6Address | None:
    """An address of either version as mail headers write it: bare, in brackets, marked `IPv6:`; a mapped one is IPv4."""
    bare = (text or "").strip().strip("[]")
    bare = bare[5:] if bare[:5].lower() == "ipv6:" else bare
    try:
        found = ipaddress.ip_address(bare)
    except ValueError:
        return None
    return getattr(found, "ipv4_mapped", None) or found


def is_public(address: ipaddress.IPv4Address | ipaddress.IPv6Address) -> bool:
    """Whether the internet routes it; shared address space isn't."""
    if address.version == 4 and in_shared_space(address):
        return False
    return not any((address.is_private, address.is_loopback, address.is_link_local, address.is_multicast, address.is_reserved, address.is_unspecified))


def in_shared_space(address: ipaddress.IPv4Address) -> bool:
    return address in ipaddress.IPv4Network("100.64.0.0/10")


@F.pandas_udf(StructType().add("address", StringType()).add("version", IntegerType()).add("public", BooleanType()))
def address_of(text: pd.Series) -> pd.DataFrame:
    """struct<address, version, public> of a text; null fields for what is no address. Each distinct text is read once."""
    known = {t: read_address(t) for t in text.unique()}
    of = {t: (None, None, None) if a is None else (str(a), a.version, is_public(a)) for t, a in known.items()}
    return pd.DataFrame([of[t] for t in text], columns=["address", "version", "public"]).astype({"version": "Int32", "public": "boolean"})


@F.pandas_udf(BooleanType())
def within(text: pd.Series, network: pd.Series) -> pd.Series:
    """Whether an address lies in a network of its version, as text with a prefix length; null for what is neither."""

    def one(t, n):
        a = read_address(t)
        try:
            return None if a is None else a in ipaddress.ip_network(n or "", strict=False)
        except ValueError:
            return None

    return pd.Series([one(t, n) for t, n in zip(text, network, strict=True)], dtype="boolean")
