"""Links of places."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# How links to places and search redirects look.
PLACE_LINK_PARTS = ("/maps/place", "google.com/maps")
REDIRECT_PREFIX = "/url?q="


def place_id(url: Column) -> Column:
    """First non-empty ``cid`` parameter of the query string, else the whole link."""
    query = F.regexp_extract(url, r"^[^?#]*\?([^#]*)", 1)
    cid = F.regexp_extract(query, r"(?:^|&)cid=([^&]+)", 1)
    return F.coalesce(F.nullif(F.coalesce(F.try_url_decode(cid), cid), F.lit("")), url)


def unwrap_redirect(href: Column) -> Column:
    """Target of a search redirect, up to the next parameter and not percent-decoded."""
    target = F.split_part(href, F.lit(REDIRECT_PREFIX), F.lit(2))
    return F.when(F.startswith(href, F.lit(REDIRECT_PREFIX)), F.substring_index(target, "&", 1)).otherwise(href)


def is_place_link(href: Column) -> Column:
    first, second = (F.contains(href, F.lit(part)) for part in PLACE_LINK_PARTS)
    return first | second
