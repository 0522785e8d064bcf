"""URL expressions. URLs come from the open web, so nothing here can raise."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

_SCHEME = r"(?i)^[a-z][a-z0-9+.-]*://"


def host(url: Column | str) -> Column:
    """Lower-case host without user name and port; NULL if there is none."""
    found = F.regexp_extract(url, _SCHEME + r"(?:[^/?#@]*@)?(\[[^\]/?#]*\]|[^/?#:]*)", 1)
    return F.nullif(F.lower(found), F.lit(""))


def canonical(url: Column | str) -> Column:
    """Host and path: scheme, ``www.`` or ``m.``, query, fragment and trailing
    slashes removed. The prefix stays where only a top-level name would be left.
    NULL if the URL has no host.
    """
    authority = F.lower(F.regexp_extract(url, _SCHEME + r"([^/?#]*)", 1))
    bare = F.regexp_replace(authority, r"^(?:www|m)\.([^.]+\.)", "$1")
    path = F.regexp_extract(url, _SCHEME + r"[^/?#]*([^?#]*)", 1)
    return F.when(authority != "", F.rtrim(F.concat(bare, path), F.lit("/")))
