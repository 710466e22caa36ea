"""Column functions over URLs."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

# Parameters that name a visit, a session or a way back, not a page.
TRACKING = [
    "gclid", "fbclid", "msclkid", "dclid", "mc_eid", "igshid",
    "returnurl", "redirect", "redirect_to", "redirect_uri", "redirect_url",
    "next", "goto", "continue", "backurl", "target_url", "ref_url", "callback_url",
    "sessionid", "jsessionid", "phpsessid",
]

_URL = r"^([a-zA-Z][a-zA-Z0-9+.-]*)://(?:[^/?#@]*@)?([^/?#:]*)(?::(\d*))?([^?#]*)(?:\?([^#]*))?"


def _part(url: Column, group: int) -> Column:
    return F.regexp_extract(url, _URL, group)


def scheme(url: Column) -> Column:
    """Lower-case scheme of an absolute URL, else null."""
    return F.nullif(F.lower(_part(url, 1)), F.lit(""))


def host(url: Column) -> Column:
    return F.nullif(F.lower(_part(url, 2)), F.lit(""))


def port(url: Column) -> Column:
    return F.nullif(_part(url, 3), F.lit(""))


def path(url: Column) -> Column:
    return F.coalesce(F.nullif(_part(url, 4), F.lit("")), F.lit("/"))


def query(url: Column) -> Column:
    return _part(url, 5)


def is_http(url: Column) -> Column:
    """Absolute http or https URL with a host."""
    return F.coalesce(scheme(url).isin("http", "https") & host(url).isNotNull(), F.lit(False))


@F.pandas_udf(T.StringType())
def _punycode(name: pd.Series) -> pd.Series:
    def one(host_: str | None) -> str | None:
        try:
            return None if host_ is None else host_.encode("idna").decode("ascii")
        except UnicodeError:
            return None

    return name.map(one)


def ascii_host(name: Column) -> Column:
    """Host with non-ASCII labels in punycode; only those leave the JVM."""
    foreign = name.rlike(r"[^\x00-\x7F]")
    return F.when(foreign, _punycode(F.when(foreign, name))).otherwise(name)


def _escaped(value: Column) -> Column:
    """Percent-encoding of everything but unreserved characters."""
    return F.replace(F.replace(F.replace(F.url_encode(value), F.lit("+"), F.lit("%20")), F.lit("*"), F.lit("%2A")), F.lit("%7E"), F.lit("~"))


def normalize_url(url: Column, idn: bool = True) -> Column:
    """One spelling for equal pages; null unless absolute http(s).

    Host in lower case, default port and fragment off, tracking and key-less
    parameters off, repeated pairs once, pairs by key and value, trailing slash
    off but for the root.  Foreign hosts are turned into punycode unless ``idn`` is false.
    """
    pairs = F.transform(
        F.filter(F.split(query(url), "&"), lambda p: p.contains("=")),
        lambda p: F.struct(
            F.coalesce(F.try_url_decode(F.substring_index(p, "=", 1)), F.substring_index(p, "=", 1)).alias("k"),
            F.coalesce(F.try_url_decode(F.substring(p, F.instr(p, "=") + 1, F.length(p))), F.substring(p, F.instr(p, "=") + 1, F.length(p))).alias("v"),
        ),
    )
    kept = F.filter(pairs, lambda p: ~F.lower(p["k"]).startswith("utm_") & ~F.lower(p["k"]).isin(TRACKING))
    text = F.array_join(F.transform(F.array_sort(F.array_distinct(kept)), lambda p: F.concat(_escaped(p["k"]), F.lit("="), _escaped(p["v"]))), "&")
    shown_port = F.when(port(url).isNull() | ((scheme(url) == "http") & (port(url) == "80")) | ((scheme(url) == "https") & (port(url) == "443")), "").otherwise(F.concat(F.lit(":"), port(url)))
    trimmed = F.regexp_replace(path(url), "/+$", "")
    name = ascii_host(host(url)) if idn else host(url)
    out = F.concat(scheme(url), F.lit("://"), name, shown_port, F.when(trimmed == "", "/").otherwise(trimmed), F.when(text == "", "").otherwise(F.concat(F.lit("?"), text)))
    return F.when(is_http(url), out)


def host_matches(domain: Column, wanted: Column) -> Column:
    """Same host or a subdomain of it; look-alikes and empty hosts don't match."""
    a, b = F.lower(domain), F.lower(wanted)
    return F.coalesce((b != "") & ((a == b) | a.endswith(F.concat(F.lit("."), b))), F.lit(False))


def serp_url_key(url: Column) -> Column:
    """Host and path for comparing result pages; the trimmed text where it is no URL."""
    trimmed = F.regexp_replace(path(url), "/+$", "")
    return F.when(is_http(url), F.concat(host(url), trimmed)).otherwise(F.lower(F.trim(url)))


def is_wildcard_query(url: Column) -> Column:
    return F.coalesce(query(url).rlike(r"(?i)\*|%2A"), F.lit(False))


def has_user_info(url: Column) -> Column:
    return F.coalesce(url.rlike(r"^[a-zA-Z][a-zA-Z0-9+.-]*://[^/?#]*@"), F.lit(False))
