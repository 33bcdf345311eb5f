"""Classification of names, link extraction and source addresses."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

from snaplake import fixed_values as fv


def name_class(name: Column, classes=fv.NAME_CLASSES, otherwise: str = fv.UNCLASSIFIED) -> Column:
    """The class of the first pattern found in the name."""
    first, *rest = classes
    chain = reduce(
        lambda acc, rule: acc.when(name.rlike(rule[0]), rule[1]),
        rest,
        F.when(name.rlike(first[0]), first[1]),
    )
    return chain.otherwise(otherwise)


def links(html: Column) -> Column:
    return F.regexp_extract_all(html, F.lit(fv.HREF_PATTERN), F.lit(1))


def site_root(url: Column) -> Column:
    return F.regexp_extract(url, r"^(https?://[^/?#]+)", 1)


def absolute_link(href: Column, page_url: Column) -> Column:
    """A link with a scheme stays; a rooted one gets the page's site in front."""
    return F.when(href.rlike("^https?://"), href).when(
        href.startswith("/"), F.concat(site_root(page_url), href)
    ).otherwise(F.concat(site_root(page_url), F.lit("/"), href))


def source_address(source_type: Column, website: Column, taxonomy_url: Column) -> Column:
    """The firm's own site for the own-site type, the taxonomy address otherwise."""
    return F.when(source_type == fv.OWN_SITE_TYPE, F.nullif(website, F.lit(""))).otherwise(taxonomy_url)


def unique_in_order(items: Column) -> Column:
    """Each item of a list once, where it first stood."""
    return F.array_distinct(items)


def plain_path(uri: Column) -> Column:
    """A path or name as files have it, from the form of a URI in which the scan's metadata holds it."""
    return F.url_decode(F.replace(uri, F.lit("+"), F.lit("%2B")))
