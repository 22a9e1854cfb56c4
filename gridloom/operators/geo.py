"""Points, distances, map extent, nearest station, addresses."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from gridloom.functions import texts
from gridloom.operators.joins import attach, lookup
from gridloom.session import pinned

EARTH_KM = 6371.0088
STATION_LIMIT_KM = 150.0
LIST_LIMIT_KM = 700.0
DEFAULT_SIZE = 4.0
SALTS = 8


def distance_km(lat1: Column, lon1: Column, lat2: Column, lon2: Column) -> Column:
    """Great-circle distance by the haversine formula."""
    half_lat = F.sin(F.radians(lat2 - lat1) / 2)
    half_lon = F.sin(F.radians(lon2 - lon1) / 2)
    a = half_lat * half_lat + F.cos(F.radians(lat1)) * F.cos(F.radians(lat2)) * half_lon * half_lon
    return 2 * EARTH_KM * F.asin(F.sqrt(F.least(a, F.lit(1.0))))


def points(df: DataFrame) -> DataFrame:
    """Point table from Name, Breitengrad, Längengrad, with optional Punktgröße and Punktfarbe."""
    if not {"Breitengrad", "Längengrad"} <= set(df.columns):
        if "Adresse" in df.columns:
            raise ValueError("addresses need a gazetteer: use points_from_addresses")
        raise ValueError("columns Breitengrad and Längengrad, or Adresse, are required")
    return df.select(
        F.col("Name").alias("name"), F.col("Breitengrad").cast("double").alias("latitude"),
        F.col("Längengrad").cast("double").alias("longitude"), *_attributes(df),
    )


def points_from_addresses(df: DataFrame, gazetteer: DataFrame) -> DataFrame:
    """Point table from Name and Adresse with coordinates from ``(address, latitude, longitude)``."""
    named = df.withColumnRenamed("Adresse", "address")
    found = coordinates_of(named, gazetteer)
    return found.select(F.col("Name").alias("name"), "latitude", "longitude", *_attributes(df))


def _attributes(df: DataFrame) -> list[Column]:
    wanted = {"Punktgröße": "attr_size", "Punktfarbe": "attr_colour"}
    return [
        (F.col(c) if c in df.columns else F.lit(None)).cast("double").alias(a)
        for c, a in wanted.items()
    ]


def coordinates_of(df: DataFrame, gazetteer: DataFrame) -> DataFrame:
    """Coordinates by normalised address; the gazetteer's first entry (smallest) per address counts."""
    key = texts.normal_address(F.col("address"))
    known = gazetteer.groupBy(key.alias("_key")).agg(
        F.min(F.struct("latitude", "longitude")).alias("_at")
    )
    joined = lookup(df.withColumn("_key", key), known, ["_key"])
    return joined.withColumns(
        {"latitude": F.col("_at.latitude"), "longitude": F.col("_at.longitude")}
    ).drop("_key", "_at")


def addresses_of(df: DataFrame, gazetteer: DataFrame, limit_km: float = STATION_LIMIT_KM) -> DataFrame:
    """Nearest gazetteer address of each place ``(place_id, latitude, longitude)``."""
    named = gazetteer.select(F.col("address").alias("station_id"), "latitude", "longitude")
    near = nearest_station(df, named, limit_km)
    return near.select("place_id", F.col("station_id").alias("address"), "distance")


def same_attributes(df: DataFrame) -> DataFrame:
    """Do all points share one size, one colour? Missing ones count as 4."""

    def same(name: str) -> Column:
        # min = max is the same test as one distinct value, without a distinct set.
        value = F.coalesce(F.nullif(F.col(name), F.lit(0.0)), F.lit(DEFAULT_SIZE))
        return F.min(value) == F.max(value)

    return df.agg(same("attr_size").alias("all_same_size"), same("attr_colour").alias("all_same_colour"))


def size_reference(df: DataFrame, max_size: float = 5.0) -> DataFrame:
    size = F.coalesce(F.nullif(F.col("attr_size"), F.lit(0.0)), F.lit(DEFAULT_SIZE))
    return df.agg((F.max(size) * 2 / F.lit(max_size * max_size)).alias("size_ref"))


def map_extent(df: DataFrame) -> DataFrame:
    """Bounding box, centre and zoom; no zoom for a single spot."""
    box = df.agg(
        F.min("latitude").alias("min_lat"), F.max("latitude").alias("max_lat"),
        F.min("longitude").alias("min_lon"), F.max("longitude").alias("max_lon"),
    )
    wide = F.greatest(F.col("max_lat") - F.col("min_lat"), F.col("max_lon") - F.col("min_lon")) * 111
    return box.withColumns(
        {
            "lat": (F.col("max_lat") + F.col("min_lat")) / 2,
            "lon": (F.col("max_lon") + F.col("min_lon")) / 2,
            "zoom": F.when(wide > 0, 14 - F.log(wide)),
        }
    )


FINEST_KM = 0.013  # cube numbers then fit in 20 bits
FEW = 16


def _axes(lat: str, lon: str) -> list[Column]:
    """The point on the globe in km from its centre; valid at poles and date line."""
    phi, lam = F.radians(F.col(lat)), F.radians(F.col(lon))
    return [a * EARTH_KM for a in (F.cos(phi) * F.cos(lam), F.cos(phi) * F.sin(lam), F.sin(phi))]


def _cube(fine: str, up: int) -> Column:
    """Key of the cube ``up`` levels above the finest; an edge is four times that of the level below."""
    return _key([F.shiftright(F.col(f"{fine}{i}"), 2 * up) for i in range(3)])


def _key(cells: list[Column]) -> Column:
    shift = 1 << 19
    return ((cells[0] + shift) * (1 << 40)) + ((cells[1] + shift) * (1 << 20)) + (cells[2] + shift)


def nearest_station(
    places: DataFrame,
    stations: DataFrame,
    limit_km: float = STATION_LIMIT_KM,
    by: list[str] | None = None,
) -> DataFrame:
    """Nearest station of each place within the limit; ties by smallest station id.

    ``places(place_id, latitude, longitude, *by)``, ``stations(station_id, latitude, longitude, *by)``.
    Copies of a spot collapse first on both sides. Then spots descend through cubes of falling edge,
    from the limit on: a cube is kept if its nearest possible point is not farther than the nearest
    station seen so far, so a spot meets a few cubes per level however dense the stations are, and
    only the stations of the last cubes. Nothing is left out, so the result is exact.
    """
    by = by or []
    spot = [*by, "latitude", "longitude"]
    # Every level reads the stations; pinned, what they are made from is read only once.
    sites = pinned(stations.groupBy(*spot).agg(F.min("station_id").alias("station_id")))
    depth, sites = _depth(sites, by, limit_km)
    finest = limit_km / 4**depth
    spots = places.select(*spot).na.drop(subset=["latitude", "longitude"]).distinct()
    axes = _axes("latitude", "longitude")
    spots = spots.withColumns({f"_a{i}": a for i, a in enumerate(axes)})
    start = spots.withColumns({f"_c{i}": F.floor(F.col(f"_a{i}") / finest) for i in range(3)})
    seen = start.withColumn("_cube", _cube("_c", depth)).drop("_c0", "_c1", "_c2")
    for level in range(depth + 1):
        nodes = _nodes(sites, by, depth - level, first=level == 0)
        seen = _closer(_met(seen, nodes, by, spot), spot, limit_km, limit_km / 4**level)
    last = sites.select(
        *by, _cube("_s", 0).alias("_cube"), "station_id",
        F.col("latitude").alias("_lat"), F.col("longitude").alias("_lon"),
    )
    met = _met(seen, last, by, spot)
    km = distance_km(F.col("latitude"), F.col("longitude"), F.col("_lat"), F.col("_lon"))
    best = met.groupBy(*spot).agg(F.min(F.struct(km.alias("km"), "station_id")).alias("_best"))
    near = best.filter(F.col("_best.km") <= limit_km).select(
        *spot, "_best.station_id", F.col("_best.km").alias("distance")
    )
    return attach(places, near, spot, "inner")


def _depth(sites: DataFrame, by: list[str], limit_km: float) -> tuple[int, DataFrame]:
    """Levels until the fullest cube holds few stations, and the stations with their finest cubes."""
    axes = _axes("latitude", "longitude")
    for depth in range(2, 11):
        edge = limit_km / 4**depth
        placed = sites.withColumns({f"_s{i}": F.floor(a / edge) for i, a in enumerate(axes)})
        if edge / 4 < FINEST_KM:
            break
        counts = placed.groupBy(*by, _cube("_s", 0).alias("_cube")).count()
        if (counts.agg(F.max("count")).first()[0] or 0) <= FEW:
            break
    return depth, placed


def _nodes(sites: DataFrame, by: list[str], up: int, *, first: bool) -> DataFrame:
    """Occupied cubes of a level by the cube they are looked up with: the one above, or on the first
    level each of the 27 around. A cube carries one of its stations as a bound."""
    cells = [F.shiftright(F.col(f"_s{i}"), 2 * up).alias(f"_n{i}") for i in range(3)]
    one = F.min_by(F.struct("latitude", "longitude"), "station_id").alias("_one")
    cubes = sites.groupBy(*by, *cells).agg(one)
    if first:
        for i in range(3):
            step = F.explode(F.array(*[F.lit(k) for k in (-1, 0, 1)]))
            cubes = cubes.withColumn(f"_k{i}", step)
        found = _key([F.col(f"_n{i}") + F.col(f"_k{i}") for i in range(3)])
    else:
        found = _cube("_n", 1)
    own = [f"_n{i}" for i in range(3)]
    return cubes.select(
        *by, found.alias("_cube"), *own, F.col("_one.latitude").alias("_lat"), F.col("_one.longitude").alias("_lon")
    )


def _met(seen: DataFrame, nodes: DataFrame, by: list[str], spot: list[str]) -> DataFrame:
    # A cube with very many spots is spread over salts; what it meets repeats per salt.
    salted = seen.withColumn("_salt", F.pmod(F.xxhash64(*spot), F.lit(SALTS)).cast("int"))
    sided = nodes.withColumn("_salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
    return salted.join(sided, [*by, "_cube", "_salt"]).drop("_salt")


def _closer(met: DataFrame, spot: list[str], limit_km: float, edge: float) -> DataFrame:
    """Keep the cubes that can hold the nearest station; ``_cube`` becomes the cube met."""
    gaps = [
        F.greatest(
            F.col(f"_n{i}") * edge - F.col(f"_a{i}"), F.col(f"_a{i}") - (F.col(f"_n{i}") + 1) * edge, F.lit(0.0)
        )
        for i in range(3)
    ]
    chord = F.sqrt(gaps[0] * gaps[0] + gaps[1] * gaps[1] + gaps[2] * gaps[2])
    least = 2 * EARTH_KM * F.asin(F.least(chord / (2 * EARTH_KM), F.lit(1.0)))
    km = distance_km(F.col("latitude"), F.col("longitude"), F.col("_lat"), F.col("_lon"))
    # A spot has a bounded number of cubes: 27 on the first level, then the parts of those kept.
    sure = F.min("_km").over(Window.partitionBy(*spot))
    slack = 1e-6  # a millimetre, for rounding of the bounds
    bounded = met.withColumns({"_least": least, "_km": km}).withColumn("_sure", sure)
    kept = bounded.filter((F.col("_least") <= F.col("_sure") + slack) & (F.col("_least") <= limit_km + slack))
    return kept.select(*spot, "_a0", "_a1", "_a2", _key([F.col(f"_n{i}") for i in range(3)]).alias("_cube"))
