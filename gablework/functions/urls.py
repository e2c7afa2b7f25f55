"""URLs: canonical forms, hosts, video ids."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Parameters that only track a visit; all utm_ ones besides.
TRACKING = ("fbclid", "gclid", "mc_cid", "mc_eid", "igshid", "ref", "ref_src", "_ga")


def host_key(url: Column) -> Column:
    """The host in lower case, without user, port and www."""
    host = F.regexp_extract(F.lower(F.coalesce(url, F.lit(""))), r"^[a-z][a-z0-9+.-]*://(?:[^/?#@]*@)?([^/?#:]*)", 1)
    return F.regexp_replace(host, r"^www\.", "")


def canonical(url: Column) -> Column:
    """Scheme and host in lower case, no fragment, no tracking, parameters in order, no trailing slash but at the root."""
    u = F.trim(url)
    scheme, host = F.lower(F.regexp_extract(u, r"^([A-Za-z][\w+.-]*)://", 1)), F.lower(F.regexp_extract(u, r"^[A-Za-z][\w+.-]*://([^/?#]*)", 1))
    path = F.regexp_extract(u, r"^[A-Za-z][\w+.-]*://[^/?#]*([^?#]*)", 1)
    pairs = F.filter(F.split(F.regexp_extract(u, r"\?([^#]*)", 1), "&"), lambda p: (p != "") & ~F.lower(p).rlike(r"^utm_") & ~F.lower(F.split(p, "=")[0]).isin(*TRACKING))
    query = F.array_join(F.array_sort(pairs), "&")
    trimmed = F.when(F.regexp_replace(path, r"/+$", "") == "", F.lit("/")).otherwise(F.regexp_replace(path, r"/+$", ""))
    return F.when(scheme != "", F.concat(scheme, F.lit("://"), host, trimmed, F.when(query != "", F.concat(F.lit("?"), query)).otherwise("")))


def is_file(url: Column) -> Column:
    """Whether a link leads to a file rather than a page."""
    return F.lower(F.regexp_extract(url, r"^[^?#]*", 0)).rlike(r"\.(pdf|jpe?g|png|gif|webp|svg|mp[34]|m4a|wav|avi|mov|zip|gz|docx?|xlsx?|pptx?|css|js|xml|rss|ico)$")


def video_id(url_or_id: Column) -> Column:
    """The id of eleven characters in any form of a watch link, or null; links to channels have none."""
    u = F.trim(url_or_id)
    by_link = F.regexp_extract(u, r"(?:[?&]v=|youtu\.be/|/shorts/|/embed/|/live/)([A-Za-z0-9_-]{11})(?![A-Za-z0-9_-])", 1)
    return F.when(u.rlike(r"^[A-Za-z0-9_-]{11}$"), u).when(by_link != "", by_link)


def is_channel(url: Column) -> Column:
    return F.trim(url).rlike(r"(?i)youtube\.[^/]+/(@|c/|channel/|user/)")


def secret_looking(url: Column) -> Column:
    """Whether a link's parameters seem to hold a secret."""
    return F.lower(url).rlike(r"[?&](key|api_?key|token|secret|password|sig|signature|auth)=")
