"""Scalar column expressions (H1m-H15j, B7, B9-B11, B18-B20, B22)."""

from __future__ import annotations

import math
from collections.abc import Mapping

from pyspark.sql import Column
from pyspark.sql import functions as F

# Month names.
MONTHS = list(range(1, 13))
MONTH_LABELS = ["Jan", "Feb", "Mar", "Apr", "May", "Jun", "Jul", "Aug", "Sep", "Oct", "Nov", "Dec"]

# Mean earth radius in km.
EARTH_RADIUS_KM = 6371.0088

# Land-cover classes by code.
LANDCOVER_NAMES = {
    0: "Water",
    1: "Evergreen Needleleaf Forest",
    2: "Evergreen Broadleaf Forest",
    3: "Deciduous Needleleaf Forest",
    4: "Deciduous Broadleaf Forest",
    5: "Mixed Forests",
    6: "Closed Shrublands",
    7: "Open Shrublands",
    8: "Woody Savannas",
    9: "Savannas",
    10: "Grasslands",
    11: "Permanent Wetlands",
    12: "Croplands",
    13: "Urban and Built-up",
    14: "Cropland/Natural Vegetation Mosaic",
    15: "Permanent Snow and Ice",
    16: "Barren or Sparsely Vegetated",
    17: "Unclassified",
    255: "Fill",
}

# Biomes by code.
BIOME_NAMES = {
    1: "Tropical Moist Broadleaf Forests",
    2: "Tropical Dry Broadleaf Forests",
    3: "Tropical Coniferous Forests",
    4: "Temperate Broadleaf Forests",
    5: "Temperate Coniferous Forests",
    6: "Boreal Forests/Taiga",
    7: "Tropical Grasslands/Savannas",
    8: "Temperate Grasslands/Steppes",
    9: "Flooded Grasslands",
    10: "Montane Grasslands",
    11: "Tundra",
    12: "Mediterranean Forests",
    13: "Deserts & Xeric Shrublands",
    14: "Mangroves",
}

# Background labels.
BACKGROUND_LABELS = {"long_term": "long-term background", "same_month": "same-month background"}


def nan_to_null(c: Column) -> Column:
    """Missing values are NULL inside the library."""
    return F.when(F.isnan(c), F.lit(None)).otherwise(c)


def nodata_to_null(c: Column, *codes: float, low: float | None = None, high: float | None = None) -> Column:
    """Recode fill values and out-of-range values to NULL."""
    keep = c.isNotNull()
    if codes:
        keep = keep & ~c.isin(*codes)
    if low is not None:
        keep = keep & (c >= F.lit(low))
    if high is not None:
        keep = keep & (c <= F.lit(high))
    return F.when(keep, c)


def scaled_in_range(c: Column, scale: float, low: float, high: float) -> Column:
    """Scale raw values and mask those outside the valid range."""
    x = c.cast("double") * F.lit(scale)
    return F.when((x >= F.lit(low)) & (x <= F.lit(high)), x)


def wind_from_direction(u: Column, v: Column) -> Column:
    """Direction the wind blows from, degrees clockwise from north (H1m)."""
    return F.pmod(F.degrees(F.atan2(-u, -v)) + F.lit(360.0), F.lit(360.0))


def windwardness(slope_deg: Column, aspect_deg: Column, wind_from_deg: Column) -> Column:
    """Cosine of the angle between slope aspect and wind, 0 on flat ground (H2m)."""
    facing = F.cos(F.radians(aspect_deg) - F.radians(wind_from_deg))
    return F.when(slope_deg < 1.0, F.lit(0.0)).otherwise(facing)


def exposure(slope_deg: Column, aspect_deg: Column, wind_from_deg: Column) -> Column:
    """Windward share of the slope, 0 on flat ground and on the lee side (H2m)."""
    facing = F.cos(F.radians(aspect_deg) - F.radians(wind_from_deg))
    steep = F.sin(F.radians(F.greatest(F.least(slope_deg, F.lit(90.0)), F.lit(0.0))))
    # greatest() skips NULL, so a missing wind or aspect is kept missing explicitly.
    value = F.when(facing.isNotNull() & slope_deg.isNotNull(), F.greatest(F.lit(0.0), facing) * steep)
    return F.when(slope_deg < 1.0, F.lit(0.0)).otherwise(value)


def clip(c: Column, low: float, high: float) -> Column:
    """Clip to a range, NULL stays NULL."""
    return F.when(c.isNotNull(), F.least(F.greatest(c, F.lit(low)), F.lit(high)))


def clip_probability(p: Column, eps: float = 1e-6) -> Column:
    return clip(p, eps, 1.0 - eps)


def logit(p: Column) -> Column:
    q = clip_probability(p)
    return F.log(q / (F.lit(1.0) - q))


def logistic(x: Column) -> Column:
    return F.lit(1.0) / (F.lit(1.0) + F.exp(-x))


def cap_positive_at_zero(c: Column) -> Column:
    """Positive departures become 0."""
    return F.when(c > 0, F.lit(0.0)).otherwise(c)


def circular_month_distance(a: Column, b: Column) -> Column:
    """Distance of two months on the 12-month circle, 0 to 6 (H6m)."""
    d = F.abs(F.rint(a).cast("int") - F.rint(b).cast("int"))
    return F.when(d.isNotNull(), F.least(d, F.lit(12) - d))


def signed_month_shift(a: Column, b: Column) -> Column:
    """Month a minus month b wrapped into [-6, 6]; +6 and -6 keep their sign (H6m)."""
    d = F.rint(a).cast("int") - F.rint(b).cast("int")
    return F.when(d > 6, d - F.lit(12)).when(d < -6, d + F.lit(12)).otherwise(d)


def month_angle(month: Column) -> Column:
    """January = 0, in radians."""
    return F.lit(2.0 * math.pi) * (month - F.lit(1)) / F.lit(12.0)


def month_name(month: Column) -> Column:
    """Label of the nearest month, clamped to 1-12 (H12s)."""
    m = F.greatest(F.lit(1), F.least(F.lit(12), F.rint(month).cast("int")))
    return F.when(month.isNotNull(), F.element_at(F.array(*[F.lit(x) for x in MONTH_LABELS]), m))


def background_label(name: Column) -> Column:
    known = F.create_map(*[F.lit(x) for pair in BACKGROUND_LABELS.items() for x in pair])
    return F.coalesce(known[name], F.replace(name, F.lit("_"), F.lit("-")))


def safe_ratio(a: Column, b: Column) -> Column:
    """NULL for a zero or missing denominator (H8m)."""
    return F.try_divide(a.cast("double"), b.cast("double"))


def normalize_longitude(lon: Column) -> Column:
    """Longitude in [-180, 180)."""
    return F.pmod(lon + F.lit(180.0), F.lit(360.0)) - F.lit(180.0)


def in_bbox(lon: Column, lat: Column, bbox: tuple[float, float, float, float]) -> Column:
    """True inside (min lon, min lat, max lon, max lat), edges included."""
    return lon.between(bbox[0], bbox[2]) & lat.between(bbox[1], bbox[3])


def haversine_km(lon1: Column, lat1: Column, lon2: Column, lat2: Column) -> Column:
    """Great-circle distance (H10m)."""
    dlat = F.radians(lat2 - lat1) / 2
    dlon = F.radians(lon2 - lon1) / 2
    h = F.pow(F.sin(dlat), 2) + F.cos(F.radians(lat1)) * F.cos(F.radians(lat2)) * F.pow(F.sin(dlon), 2)
    return F.lit(2.0 * EARTH_RADIUS_KM) * F.asin(F.sqrt(F.least(h, F.lit(1.0))))


def is_winter(day: Column) -> Column:
    return F.month(day).isin(12, 1, 2)


def quadrant(lon: Column, lat: Column, centre_lon: float, centre_lat: float) -> Column:
    """Quadrant around a centre point; the centre lines belong to the east and the north."""
    north, east = lat >= centre_lat, lon >= centre_lon
    return (
        F.when(north & ~east, "Northwest").when(north & east, "Northeast").when(~north & ~east, "Southwest")
        .when(~north & east, "Southeast")
    )


def lookup(code: Column, names: Mapping[int, str]) -> Column:
    """Name of a class code, NULL where unknown."""
    pairs = [F.lit(x) for pair in names.items() for x in pair]
    return F.create_map(*pairs)[code.cast("int")]


def date_from_name(name: Column) -> Column:
    """First 8 digits of a file or layer name as a date (H11s)."""
    return F.try_to_date(F.nullif(F.regexp_extract(name, r"(\d{8})", 1), F.lit("")), "yyyyMMdd")


def year_from_name(name: Column) -> Column:
    """First year 1980-2039 in a name (H11s)."""
    return F.nullif(F.regexp_extract(name, r"(19[89]\d|20[0-3]\d)", 1), F.lit("")).cast("int")


def chunk_key(name: Column, prefix: str = "era5_chunk_", suffix: str = ".nc") -> Column:
    """Key shared by the files of one period: the name without suffix from the last prefix on (H11s)."""
    stem = F.regexp_replace(name, suffix.replace(".", r"\.") + "$", "")
    return F.when(F.contains(stem, F.lit(prefix)), F.concat(F.lit(prefix), F.substring_index(stem, prefix, -1))).otherwise(stem)


def hexagon_wkt(cx: Column, cy: Column, side: float) -> Column:
    """Closed flat-top hexagon ring as WKT (H13s)."""
    corners = []
    for k in [0, 1, 2, 3, 4, 5, 0]:
        a = math.radians(60 * k)
        corners.append(F.format_string("%.3f %.3f", cx + F.lit(side * math.cos(a)), cy + F.lit(side * math.sin(a))))
    return F.concat(F.lit("POLYGON (("), F.concat_ws(", ", *corners), F.lit("))"))


def encoder_json(mapping: Column, global_mean: Column, smooth_k: float) -> Column:
    """Target-encoding artefact as JSON (H15j)."""
    return F.to_json(
        F.struct(mapping.alias("mapping"), global_mean.alias("global_mean"), F.lit(float(smooth_k)).alias("smooth_k"))
    )
