"""Canonical identities: hosts, principals, addresses and group keys, as columns."""

from __future__ import annotations

import ipaddress
import re
import unicodedata

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

_CONTROL = r"[\x00-\x1f\x7f]"


@F.pandas_udf(T.StringType())
def _nfc(values: pd.Series) -> pd.Series:
    return values.map(lambda v: None if v is None else unicodedata.normalize("NFC", v))


@F.pandas_udf(T.StringType())
def _casefold(values: pd.Series) -> pd.Series:
    return values.map(lambda v: None if v is None else v.casefold())


def nfc(c: Column, unicode_rules: bool = False) -> Column:
    """Unicode NFC. Text that is ASCII is NFC already; unicode_rules turns on the Arrow function for the rest."""
    return _nfc(c) if unicode_rules else c


def casefold(c: Column, unicode_rules: bool = False) -> Column:
    """Caseless form: lower case by default (equal to casefold for ASCII), full folding with unicode_rules."""
    return _casefold(c) if unicode_rules else F.lower(c)


def _clean(c: Column) -> Column:
    """Trimmed text without control characters, else null; blank is null."""
    t = F.trim(c.cast("string"))
    return F.when((t != "") & ~t.rlike(_CONTROL), t)


def canonical_host(c: Column) -> Column:
    """Lower-case ASCII host name without its one trailing dot; null if blank, over 253 characters, or not a host name."""
    t = F.regexp_replace(F.trim(c.cast("string")), r"\.$", "")
    ok = t.rlike(r"^[A-Za-z0-9_](?:[A-Za-z0-9._-]*[A-Za-z0-9_])?$") & ~t.contains("..") & (F.length(t) <= 253)
    return F.when(ok, F.lower(t))


def canonical_principal(user: Column, platform: Column, unicode_rules: bool = False) -> Column:
    """struct(platform, namespace, realm, account): Windows names fold case and split ``REALM\\account`` and ``account@realm``; other names keep their case. Null if the user is blank."""
    u, p = nfc(_clean(user), unicode_rules), F.lower(F.trim(platform))
    folded = casefold(u, unicode_rules)
    down, upn = folded.rlike(r"^[^\\@]+\\[^\\@]+$"), folded.rlike(r"^[^\\@]+@[^\\@]+$")
    windows = p == "windows"
    space = F.when(~windows, "local").when(down, "downlevel").when(upn, "upn").otherwise("bare")
    realm = F.when(windows & down, F.substring_index(folded, "\\", 1)).when(windows & upn, F.substring_index(folded, "@", -1)).otherwise("")
    account = F.when(windows & down, F.substring_index(folded, "\\", -1)).when(windows & upn, F.substring_index(folded, "@", 1)).when(windows, folded).otherwise(u)
    bad = windows & (folded.contains("\\") | folded.contains("@")) & ~down & ~upn
    return F.when(u.isNotNull() & p.isNotNull() & ~F.coalesce(bad, F.lit(False)), F.struct(p.alias("platform"), space.alias("namespace"), realm.alias("realm"), account.alias("account")))


def principal_json(platform: Column, namespace: Column, realm: Column, account: Column) -> Column:
    """A principal as JSON, in the order of its fields; null without an account."""
    return F.when(account.isNotNull() & platform.isNotNull(), F.to_json(F.struct(platform.alias("platform"), namespace.alias("namespace"), realm.alias("realm"), account.alias("account"))))


def display_principal(principal: Column) -> Column:
    """``REALM\\account``, ``account@realm`` or the bare account."""
    return F.when(principal["namespace"] == "downlevel", F.concat(principal["realm"], F.lit("\\"), principal["account"])).when(principal["namespace"] == "upn", F.concat_ws("@", principal["account"], principal["realm"])).otherwise(principal["account"])


def canonical_ipv4(c: Column) -> Column:
    """An IPv4 address, from the dotted or the v4-mapped form, else null. JVM side only."""
    t = F.regexp_replace(F.lower(F.trim(c)), r"^::ffff:(?=[0-9.]+$)", "")
    octet = "(?:25[0-5]|2[0-4][0-9]|1[0-9][0-9]|[1-9]?[0-9])"
    return F.when(t.rlike(rf"^{octet}(?:\.{octet}){{3}}$"), t)


def literal_ip(v) -> str | None:
    """canonical_ip of a constant."""
    try:
        a = ipaddress.ip_address(str(v).strip()) if v is not None and "%" not in str(v) else None
    except ValueError:
        return None
    return a and str(getattr(a, "ipv4_mapped", None) or a)


@F.pandas_udf(T.StringType())
def _canonical_ip(values: pd.Series) -> pd.Series:
    return values.map(literal_ip)


def canonical_ip(c: Column) -> Column:
    """Canonical IPv4 or compressed IPv6; v4-mapped addresses become IPv4, zones and junk null."""
    plain = canonical_ipv4(c)
    return F.coalesce(plain, _canonical_ip(F.when(F.contains(c, F.lit(":")) & plain.isNull(), c)))


def literal_principal(v, windows: bool) -> tuple[str, str, str] | None:
    """(namespace, realm, account) of a constant user name."""
    u = unicodedata.normalize("NFC", str(v).strip())
    if not u or re.search(_CONTROL, u):
        return None
    if not windows:
        return "local", "", u
    u = u.casefold()
    for mark, space in (("\\", "downlevel"), ("@", "upn")):
        a, found, b = u.partition(mark)
        if found and a and b and not re.search(r"[\\@]", a + b):
            return (space, a, b) if space == "downlevel" else (space, b, a)
    return None if re.search(r"[\\@]", u) else ("bare", "", u)


def ownable(ip: Column) -> Column:
    """Whether a canonical address can prove that a machine owns it: not unspecified, loopback, link-local or multicast."""
    first = F.substring_index(ip, ".", 1).cast("int")
    v4 = ~ip.contains(":")
    bad4 = (first == 127) | first.between(224, 239) | ip.startswith("169.254.") | (ip == "0.0.0.0")
    bad6 = ip.isin("::", "::1") | ip.rlike("^fe[89ab]") | ip.startswith("ff")
    return ip.isNotNull() & ~F.when(v4, bad4).otherwise(bad6)


def external_ip(ip: Column) -> Column:
    """Neither private (RFC 1918), loopback, link-local nor unique local, and not blank."""
    return (ip != "") & ~ip.rlike(r"^(?:10\.|127\.|169\.254\.|192\.168\.|172\.(?:1[6-9]|2[0-9]|3[01])\.|::1$|fe80:|f[cd])")


def group_json(parts: dict[str, Column]) -> Column:
    """JSON of the parts in their declared order; null if one is missing."""
    whole = F.to_json(F.struct(*[c.alias(k) for k, c in parts.items()]))
    present = None
    for c in parts.values():
        present = c.isNotNull() if present is None else present & c.isNotNull()
    return F.when(present, whole)


def identity(space: str, *parts: Column | str) -> Column:
    """A deterministic identity: SHA-256 over a name space and parts joined by NUL."""
    cols = [F.lit(space), *[p if isinstance(p, Column) else F.lit(p) for p in parts]]
    return F.sha2(F.concat_ws("\0", *[c.cast("string") for c in cols]), 256)
