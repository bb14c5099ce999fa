"""Typed listings out of the payloads of web pages of two portals, with columns only.

Payloads are JSON texts: what html.json_after, html.unflattened and html.key_search give. Members
that are missing, null or of another type give nulls; a payload that doesn't parse gives a row
whose listing_id is null.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessella.functions.text import areas, digits

#: Where the portals' pages keep what a listing needs.
FIRST_PORTAL = {
    "listing_id": "$.id", "display_address": "$.address.displayAddress", "outcode": "$.address.outcode", "country": "$.address.ukCountry",
    "property_subtype": "$.propertySubType", "transaction_type": "$.transactionType", "tenure": "$.tenure.tenureType", "bedrooms": "$.bedrooms",
    "bathrooms": "$.bathrooms", "price": "$.prices.primaryPrice", "description": "$.text.description", "photos": "$.images", "floorplans": "$.floorplans",
    "agent": ("$.customer.branchDisplayName", "$.customer.companyName"), "sizings": "$.sizings", "features": "$.keyFeatures",
}
SECOND_PORTAL = {
    "listing_id": ("$.listingId", "$.id"), "display_address": ("$.displayAddress", "$.address"), "outcode": "$.outcode",
    "property_subtype": "$.propertyType", "tenure": "$.tenure", "bedrooms": ("$.numBedrooms", "$.bedrooms"), "bathrooms": ("$.numBathrooms", "$.bathrooms"),
    "price": "$.price", "description": "$.description", "photos": ("$.propertyImage", "$.images"), "floorplans": ("$.floorPlan", "$.floorplans"), "agent": "$.branch.name",
}
SQUARE_FOOT = 0.09290304
_MEDIA = "array<struct<url:string,original:string,filename:string,src:string,caption:string>>"
_SIZES = "array<struct<unit:string,minimumSize:double,maximumSize:double>>"


def _at(payload: Column, paths: str | tuple[str, ...]) -> Column:
    """The first of the paths that leads to something: JSON's empty text, null and false don't."""
    found = [F.get_json_object(payload, p) for p in ((paths,) if isinstance(paths, str) else paths)]
    return F.coalesce(*[F.when(~f.isin("", "false"), f) for f in found])


def media(text: Column) -> Column:
    """array<struct<url, caption>> of a JSON list of images, without those that have no address."""
    read = F.from_json(text, _MEDIA)
    named = F.transform(read, lambda m: F.struct(F.coalesce(m["url"], m["original"], m["filename"], m["src"]).alias("url"), m["caption"].alias("caption")))
    return F.coalesce(F.filter(named, lambda m: F.coalesce(m["url"], F.lit("")) != ""), F.array().cast("array<struct<url:string,caption:string>>"))


def without_tags(html: Column) -> Column:
    return F.trim(F.regexp_replace(html, r"<[^>]+>", " "))


def stated_area(sizings: Column, description: Column) -> Column:
    """Square metres: of the first size that has a number and a known unit, else of the first area in
    the description."""
    unit = lambda s: F.lower(F.coalesce(s["unit"], F.lit("")))
    size = lambda s: F.coalesce(F.nullif(s["minimumSize"], F.lit(0.0)), F.nullif(s["maximumSize"], F.lit(0.0)))
    feet = lambda s: unit(s).rlike("sq ?ft") | (unit(s) == "ft2")
    metres = lambda s: unit(s).rlike("sq ?m") | (unit(s) == "m2")
    fits = F.filter(F.from_json(sizings, _SIZES), lambda s: size(s).isNotNull() & (feet(s) | metres(s)))
    first = F.get(F.transform(fits, lambda s: F.round(F.when(feet(s), size(s) * SQUARE_FOOT).otherwise(size(s)), 2)), 0)
    return F.coalesce(first, F.get(areas(without_tags(description)), 0))


def listings(pages: DataFrame, payload: str, source: str, paths: dict, **fixed: str) -> DataFrame:
    """The columns of pages other than payload, and source, listing_id and the typed members of paths:
    bedrooms, bathrooms and price as whole numbers, floor_area_sqm, photos and floorplans as arrays,
    description without tags. fixed gives members that a portal's payload doesn't hold."""
    p = F.col(payload)
    text = {k: _at(p, v) for k, v in paths.items()} | {k: F.lit(v) for k, v in fixed.items()}
    none = F.lit(None).cast("string")
    description = F.nullif(without_tags(text.get("description", none)), F.lit(""))
    typed = {
        "source": F.lit(source), **{k: text.get(k, none) for k in ("listing_id", "display_address", "outcode", "country", "property_subtype", "transaction_type", "tenure", "agent")},
        **{k: F.try_to_number(text.get(k, none), F.lit("999999")).cast("int") for k in ("bedrooms", "bathrooms")},
        "price": digits(text.get("price", none)), "floor_area_sqm": stated_area(text.get("sizings", none), text.get("description", none)),
        "photos": media(text.get("photos", none)), "floorplans": media(text.get("floorplans", none)), "description": description,
        "key_features": F.coalesce(F.from_json(text.get("features", none), "array<string>"), F.array().cast("array<string>")),
    }
    return pages.select(*[c for c in pages.columns if c != payload and c not in typed], *[v.alias(k) for k, v in typed.items()])


def with_photos(found: DataFrame, least: int = 4) -> DataFrame:
    """Listings of so many photos at least; a null list holds none."""
    return found.filter(F.coalesce(F.size("photos"), F.lit(0)) >= least)
