"""Predicates and classes of entity values."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: System processes with a public meaning: fixed values.
KNOWN_PROCESSES = ("lsass.exe", "svchost.exe", "rundll32.exe", "psexec.exe", "outlook.exe", "rclone.exe", "fodhelper.exe", "vssadmin.exe", "powershell.exe", "cmd.exe", "wininit.exe", "explorer.exe")
SERVICE_ACCOUNT = "NT AUTHORITY\\SYSTEM"


def basename(path: Column) -> Column:
    """What follows the last slash or backslash."""
    return F.regexp_extract(path, r"([^\\/]*)\z", 1)


def known(name: Column, names=KNOWN_PROCESSES) -> Column:
    """Whether the lower-cased last path component is one of the names; null counts as unknown."""
    return F.coalesce(F.lower(basename(name)).isin(*names), F.lit(False))


def ip_class(ip: Column) -> Column:
    """RFC1918 or PUBLIC, by the address's text: 10., 192.168., and 172. with a second part from 16 to 31. What is no address at all is judged by its text as well."""
    second = F.split_part(ip, F.lit("."), F.lit(2))
    middle = F.when(second.rlike(r"^\+?[0-9]+\z"), second.try_cast("int").between(16, 31))
    private = ip.startswith("10.") | ip.startswith("192.168.") | (ip.startswith("172.") & F.coalesce(middle, F.lit(False)))
    return F.when(F.coalesce(private, F.lit(False)), "RFC1918").otherwise("PUBLIC")


def account_class(user: Column) -> Column:
    return F.when(user == SERVICE_ACCOUNT, "SERVICE").otherwise("PERSON")


def text_ok(text: Column, most: int) -> Column:
    """Not empty, at most so many bytes, ASCII only; null is not."""
    return F.coalesce((F.octet_length(text) >= 1) & (F.octet_length(text) <= most) & (F.octet_length(text) == F.length(text)), F.lit(False))


def below(value: Column, threshold: Column) -> Column:
    """The threshold predicate: strictly less."""
    return value < threshold


def first_failure(*checks: tuple[Column, int]) -> Column:
    """The code of the first check that is not true, in order; 0 if all are."""
    found = F.lit(0)
    for ok, code in reversed(checks):
        found = F.when(F.coalesce(ok, F.lit(False)), found).otherwise(F.lit(code))
    return found


def leaked(out: Column, raws: list[Column]) -> Column:
    """Whether any of the raw values still stands in the decoded text `out`; empty and null ones do not count."""
    return F.exists(F.array(*raws), lambda r: F.coalesce((r != "") & F.contains(out, r), F.lit(False)))
