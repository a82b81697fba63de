"""Identifiers, local names and IRIs as Column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def short_id(name: Column) -> Column:
    """First eight hex digits of the MD5 of a name's UTF-8 bytes."""
    return F.substring(F.md5(name.cast("string").cast("binary")), 1, 8)


def property_name(key: Column) -> Column:
    """Local name of a property: colons and spaces become underscores."""
    return F.translate(key, ": ", "__")


def predicate_name(type_: Column) -> Column:
    return F.replace(type_, F.lit(" "), F.lit("_"))


def ontology_iri(iri: str) -> str:
    return iri if iri.endswith(("#", "/")) else iri + "#"


def base_iri(iri: str) -> str:
    return iri if iri.endswith(("#", "/")) else iri + "/"


def page_file_name(url: Column) -> Column:
    """File name of a saved page: reserved characters replaced, scheme dropped, 100 characters at most."""
    safe = F.regexp_replace(url, r'[\\/:*?"<>|]', "_")
    for scheme in ("http_", "https_"):
        safe = F.replace(safe, F.lit(scheme), F.lit(""))
    return F.concat(F.substring(safe, 1, 100), F.lit(".html"))


def link_url(href: Column, base: str) -> Column:
    """Absolute link without its query string."""
    return F.concat(F.lit(base), F.split_part(href, F.lit("?"), F.lit(1)))


def reference_url(href: Column, base: str) -> Column:
    return F.when((href == "") | F.startswith(href, F.lit("http")), href).otherwise(F.concat(F.lit(base), href))
