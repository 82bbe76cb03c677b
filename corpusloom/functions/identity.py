"""Column functions on addresses, tokens and pseudonyms."""

from __future__ import annotations

import ipaddress

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import StringType


def email(c: Column) -> Column:
    return F.lower(F.trim(c))


def email_ok(c: Column) -> Column:
    """One @, something before it, a dot inside what follows, no white space."""
    return c.rlike(r"^[^@\s]+@[^@\s.]+(?:\.[^@\s.]+)+$") & (F.length(c) <= 254)


def short_hash(c: Column, n: int) -> Column:
    return F.substring(F.sha2(c.cast("binary"), 256), 1, n)


def ipv4_net(c: Column) -> Column:
    """The /24 of an IPv4 address."""
    return F.concat(F.substring_index(c, ".", 3), F.lit(".0/24"))


@F.pandas_udf(StringType())
def ip_key(address: pd.Series) -> pd.Series:
    """The whole IPv4 address, the /64 of an IPv6 one, what was said otherwise."""

    def key(said: str | None) -> str:
        try:
            ip = ipaddress.ip_address(said or "")
        except ValueError:
            return f"ip:{said or 'unknown'}"
        return f"ip:{ipaddress.ip_network((ip, 64), strict=False)}" if ip.version == 6 else f"ip:{ip}"

    return address.map(key)
