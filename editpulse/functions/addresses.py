"""Recognising IP addresses and anonymous editors with plain patterns."""

from __future__ import annotations

from pyspark.sql import Column, functions as F

from .text import strip

_OCTET = r"(?:25[0-5]|2[0-4][0-9]|1[0-9][0-9]|[1-9]?[0-9])"
_GROUP = r"[0-9A-Fa-f]{1,4}"

IPV4_PATTERN = rf"{_OCTET}(?:\.{_OCTET}){{3}}"


def _ipv6_pattern() -> str:
    """All spellings: full, with one ``::`` at each place, and with a trailing IPv4 part."""
    full = rf"(?:{_GROUP}:){{6}}(?:{_GROUP}:{_GROUP}|{IPV4_PATTERN})"
    spellings = [full]
    for left in range(8):
        head = "" if left == 0 else rf"{_GROUP}(?::{_GROUP}){{{left - 1}}}"
        tails = []
        if left <= 6:
            tails.append(rf"{_GROUP}(?::{_GROUP}){{0,{6 - left}}}")
        if left <= 5:
            tails.append(rf"(?:{_GROUP}:){{0,{5 - left}}}{IPV4_PATTERN}")
        tail = f"(?:{'|'.join(tails)})?" if tails else ""
        spellings.append(f"{head}::{tail}")
    return rf"(?:{'|'.join(spellings)})(?:%[^%/]+)?"


IPV6_PATTERN = _ipv6_pattern()


def is_ip_address(text: Column) -> Column:
    return text.rlike(rf"\A(?:{IPV4_PATTERN}|{IPV6_PATTERN})\z")


def looks_anonymous(user: Column) -> Column:
    """True for a temporary account (``~`` prefix) or an address, with or without a ``/`` suffix."""
    name = strip(user)
    host = F.split_part(name, F.lit("/"), F.lit(1))
    return F.coalesce(F.startswith(name, F.lit("~")) | is_ip_address(host), F.lit(False))
