"""Geographic expressions on columns of degrees."""

from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Mean radius in km; semi-major axis in m and squared eccentricity of WGS 84.
RADIUS_KM, AXIS_M, ECC2 = 6371.0088, 6378137.0, 0.0066943799901413165


def distance_km(lon1: Column, lat1: Column, lon2: Column, lat2: Column) -> Column:
    """Great-circle distance."""
    p1, p2 = F.radians(lat1), F.radians(lat2)
    h = F.pow(F.sin((p2 - p1) / 2), F.lit(2)) + F.cos(p1) * F.cos(p2) * F.pow(F.sin((F.radians(lon2) - F.radians(lon1)) / 2), F.lit(2))
    return F.lit(2 * RADIUS_KM) * F.asin(F.when(h > 1, F.lit(1.0)).otherwise(F.sqrt(h)))


def arcs(lon: Column, lat: Column, at: str) -> dict[str, Column]:
    """What distance_km() needs of one place, for arc_km(): columns named by `at`."""
    p = F.radians(lat)
    return {f"_l{at}": F.radians(lon), f"_p{at}": p, f"_q{at}": F.cos(p)}


def high_apart(a: str, b: str, km: float) -> Column:
    """False only for places that their latitudes alone set more than `km` apart."""
    return F.abs(F.col(f"_p{b}") - F.col(f"_p{a}")) <= F.lit(km / RADIUS_KM + 1e-9)


def arc_km(a: str, b: str) -> Column:
    """distance_km(), to the last bit, of the arcs() named `a` and `b`."""
    h = F.pow(F.sin((F.col(f"_p{b}") - F.col(f"_p{a}")) / 2), F.lit(2)) + F.col(f"_q{a}") * F.col(f"_q{b}") * F.pow(F.sin((F.col(f"_l{b}") - F.col(f"_l{a}")) / 2), F.lit(2))
    return F.lit(2 * RADIUS_KM) * F.asin(F.when(h > 1, F.lit(1.0)).otherwise(F.sqrt(h)))


def cell(x: Column, size: float) -> Column:
    """Integer cell of a coordinate: nearest multiple of size, half a size (in degrees, not cells) on; ties to even."""
    return F.rint(x / F.lit(size) + F.lit(0.5 * size)).cast("bigint")


def snapped(x: Column, size: float, digits: int = 4) -> Column:
    """The cell's coordinate, rounded."""
    return F.bround(cell(x, size) * F.lit(size), digits)


def around(lon: Column, lat: Column, size: float) -> Column:
    """The eight neighbours of a cell as an array of structs lon, lat, snapped again; lon varies slowest."""
    steps = [F.struct(snapped(lon + F.lit(i * size), size).alias("lon"), snapped(lat + F.lit(j * size), size).alias("lat")) for i in (-1, 0, 1) for j in (-1, 0, 1) if i or j]
    return F.array(*steps)


def pixel_centre(row: Column, col: Column, resolution: float = 1 / 120) -> tuple[Column, Column]:
    """(lon, lat) of a pixel's centre of a grid from the north-west corner of the world."""
    return F.lit(-180.0) + (col + F.lit(0.5)) * F.lit(resolution), F.lit(90.0) - (row + F.lit(0.5)) * F.lit(resolution)


def in_box(x: Column, y: Column, left: float, right: float, down: float, up: float) -> Column:
    """Closed on all sides."""
    return x.between(left, right) & y.between(down, up)


def in_box_open_east(x: Column, y: Column, left: float, right: float, down: float, up: float) -> Column:
    return (x >= left) & (x < right) & y.between(down, up)


def turn(ax: Column, ay: Column, bx: Column, by: Column, cx: Column, cy: Column) -> Column:
    """Cross product of ab and ac: positive for a left turn."""
    return (bx - ax) * (cy - ay) - (by - ay) * (cx - ax)


def inside(ring: Column, x: Column, y: Column) -> Column:
    """Is (x, y) inside a closed ring (array of structs x, y)? Ray casting; points on a left or lower edge
    count as inside, those on a right or upper edge as outside, so that neighbours share no point."""
    n = F.size(ring)
    sides = F.zip_with(F.slice(ring, 1, n - 1), F.slice(ring, 2, n - 1), lambda a, b: F.struct(a["x"].alias("ax"), a["y"].alias("ay"), b["x"].alias("bx"), b["y"].alias("by")))
    crossed = F.filter(
        sides,
        lambda s: ((s["ay"] > y) != (s["by"] > y)) & (x < s["ax"] + (s["bx"] - s["ax"]) * (y - s["ay"]) / F.nullif(s["by"] - s["ay"], F.lit(0.0))),
    )
    return F.size(crossed) % 2 == 1


def _q(lat: Column) -> Column:
    e = ECC2**0.5
    s = F.sin(F.radians(lat))
    return F.lit(1 - ECC2) * (s / (1 - F.lit(ECC2) * s * s) - F.lit(1 / (2 * e)) * F.log((1 - F.lit(e) * s) / (1 + F.lit(e) * s)))


def _height(km: float) -> float:
    """Degrees of latitude of a band that is as high as `km`, 180 divided by a whole number."""
    return 180 / max(1, min(1_000_000, math.floor(180 / (math.degrees(km / RADIUS_KM) or 1e-9))))


def band(lat: Column, km: float) -> Column:
    """The number of the band of latitudes, from the south pole."""
    return F.least(F.greatest(F.floor((lat + 90) / F.lit(_height(km))), F.lit(0)), F.lit(round(180 / _height(km)) - 1)).cast("int")


def _spread(lat: Column, km: float) -> Column:
    """Degrees of longitude that a circle of `km` around a point spans to either side; 180 if a pole lies in it."""
    r = min(km / RADIUS_KM, math.pi)
    beside = F.degrees(F.asin(F.least(F.lit(1.0), F.lit(math.sin(min(r, math.pi / 2))) / F.cos(F.radians(lat)))))
    return F.when(F.abs(lat) + math.degrees(r) + 1e-9 >= 90, F.lit(180.0)).otherwise(beside + 1e-9)


def _cells_of(number: Column, km: float) -> Column:
    """Cells of a band: each as wide as a circle's half at the band's edge nearer to a pole, one at the poles."""
    h = _height(km)
    edge = F.greatest(F.abs(number * h - 90), F.abs((number + 1) * h - 90))
    return F.greatest(F.lit(1), F.floor(F.lit(360.0) / _spread(edge, km)).cast("int"))


def band_cell(lon: Column, number: Column, km: float) -> Column:
    """The cell of a longitude in a band, from -180 eastwards and around."""
    n = _cells_of(number, km)
    return F.least(F.floor(F.pmod(lon + 180, F.lit(360.0)) / 360 * n).cast("int"), n - 1)


def cells_around(lon: Column, lat: Column, km: float) -> Column:
    """(band, cell) of all cells that can hold a point within `km`, each once, across the date line and the poles."""
    high = math.degrees(min(km / RADIUS_KM, math.pi)) + 1e-9
    bands = F.sequence(band(lat - high, km), band(lat + high, km))

    def cells(b: Column) -> Column:
        n, spread = _cells_of(b, km), _spread(lat, km)
        first, upto = (F.floor((lon + 180 + side * spread) / 360 * n).cast("int") for side in (-1, 1))
        return F.transform(F.sequence(first, F.least(upto, first + n - 1)), lambda c: F.struct(b.alias("band"), F.pmod(c, n).alias("cell")))

    return F.flatten(F.transform(bands, cells))


def ring_area(ring: Column, unit: str) -> Column:
    """polygon_area() of one closed ring."""
    return polygon_area(F.array(F.array(ring)), unit)


def polygon_area(parts: Column, unit: str) -> Column:
    """Area of parts, arrays of closed rings of which the first is a part's outer one and the others are holes, whichever way they
    run, on an Albers equal-area plane whose standard parallels are the polygon's least and largest latitude; unit 'm2' or
    'km2'. Null where the parallels are opposite, the projection being undefined."""
    # Each value that is used again is bound to a lambda's variable; else the formula would be spelt out at every use.
    bound = lambda value, f: F.get(F.transform(F.array(value), f), F.lit(0))
    m2 = lambda lat: F.pow(F.cos(F.radians(lat)), F.lit(2)) / (1 - F.lit(ECC2) * F.pow(F.sin(F.radians(lat)), F.lit(2)))
    total = lambda values: F.aggregate(values, F.lit(0.0), lambda s, v: s + v)

    def area(k: Column) -> Column:
        n, c = k["n"], k["c"]

        def point(p: Column) -> Column:
            at = F.struct((F.lit(AXIS_M) * F.sqrt(c - n * _q(p["y"])) / n).alias("rho"), (n * F.radians(p["x"])).alias("theta"))
            return bound(at, lambda t: F.struct((t["rho"] * F.sin(t["theta"])).alias("x"), (-t["rho"] * F.cos(t["theta"])).alias("y")))

        def shoelace(flat: Column) -> Column:
            size = F.size(flat)
            return F.abs(total(F.zip_with(F.slice(flat, 1, size - 1), F.slice(flat, 2, size - 1), lambda a, b: a["x"] * b["y"] - b["x"] * a["y"]))) / 2

        def part(rings: Column) -> Column:
            sizes = F.transform(rings, lambda ring: bound(F.transform(ring, point), shoelace))
            # The outer ring counts, holes are taken away.
            return bound(sizes, lambda s: 2 * F.get(s, F.lit(0)) - total(s))

        return total(F.transform(parts, part))

    def constants(e: Column) -> Column:
        low, high = e["low"], e["high"]
        n = F.when(high == low, F.sin(F.radians(low))).otherwise((m2(low) - m2(high)) / F.nullif(_q(high) - _q(low), F.lit(0.0)))
        return bound(F.struct(F.nullif(n, F.lit(0.0)).alias("n"), low.alias("low")), lambda k: F.struct(k["n"].alias("n"), (m2(k["low"]) + k["n"] * _q(k["low"])).alias("c")))

    lats = F.transform(F.flatten(F.flatten(parts)), lambda p: p["y"])
    found = bound(bound(F.struct(F.array_min(lats).alias("low"), F.array_max(lats).alias("high")), constants), area)
    return found / 1e6 if unit == "km2" else found


def sides(parts: Column) -> Column:
    """The sides (ax, ay, bx, by) of all rings of all parts."""
    ring = lambda r: F.zip_with(F.slice(r, 1, F.size(r) - 1), F.slice(r, 2, F.size(r) - 1), lambda a, b: F.struct(a["x"].alias("ax"), a["y"].alias("ay"), b["x"].alias("bx"), b["y"].alias("by")))
    return F.flatten(F.transform(F.filter(F.flatten(parts), lambda r: F.size(r) > 1), ring))


def crossings(lines: Column, x: Column, y: Column) -> Column:
    """The sides that a ray from (x, y) to the east crosses; inside by the even-odd rule if they are odd, whatever is a hole."""
    crossed = lambda s: ((s["ay"] > y) != (s["by"] > y)) & (x < s["ax"] + (s["bx"] - s["ax"]) * (y - s["ay"]) / F.nullif(s["by"] - s["ay"], F.lit(0.0)))
    return F.size(F.filter(lines, crossed))


def mollweide_to_degrees(x: Column, y: Column) -> tuple[Column, Column]:
    """(lon, lat) of a point in metres on the Mollweide plane of a sphere with the WGS 84 axis."""
    theta = F.asin(y / F.lit(AXIS_M * 2**0.5))
    lat = F.degrees(F.asin((2 * theta + F.sin(2 * theta)) / F.lit(3.141592653589793)))
    lon = F.degrees(F.lit(3.141592653589793) * x / (F.lit(2 * AXIS_M * 2**0.5) * F.cos(theta)))
    return lon, lat


def between_points(lon1: Column, lat1: Column, lon2: Column, lat2: Column, least: float = 2.0) -> Column:
    """Points along a link, about two km apart, both ends included; a link shorter than `least` km keeps its ends only."""
    d = distance_km(lon1, lat1, lon2, lat2)
    n = F.ceil(d / 2).cast("int")
    end = F.struct(lon2.alias("lon"), lat2.alias("lat"))
    inner = F.transform(F.sequence(F.lit(0), F.greatest(n - 1, F.lit(0))), lambda i: F.struct((lon1 + (lon2 - lon1) * i / n).alias("lon"), (lat1 + (lat2 - lat1) * i / n).alias("lat")))
    return F.when(d < least, F.array(F.struct(lon1.alias("lon"), lat1.alias("lat")), end)).otherwise(F.array_append(inner, end))


def pull(value1: Column, value2: Column, distance: Column) -> Column:
    """Gravity of two places; null for values or distances that are not positive."""
    return F.exp(F.log(value1) + F.log(value2) - 2 * F.log(distance)) * F.lit(1e-4)


def speed_kmh(distance: Column, minutes: Column) -> Column:
    """Null without a positive time."""
    return F.when(minutes > 0, distance / (minutes / 60))


def drive_time(forward: Column, forward_ok: Column, back: Column, back_ok: Column, distance: Column) -> Column:
    """Seconds of a drive: the forward one if it is possible (no time) or faster than 40 km/h; else the least of
    both directions and a walk at 5 km/h, if the way back is valid; else -1. Failed look-ups are null or -1."""
    f, b = F.nullif(forward, F.lit(-1)), F.nullif(back, F.lit(-1))
    quick = forward_ok & ((f == 0) | (distance / (F.nullif(f, F.lit(0)) / 3600) > 40))
    return F.when(quick, f).when(back_ok & b.isNotNull(), F.least(f, b, distance / 5 * 3600)).otherwise(-1)


def max_speed(text: Column) -> Column:
    """km/h of a speed tag: all its digits as one number, miles turned into km; -1 without a digit."""
    digits = F.regexp_replace(text, "\\D", "").try_cast("double")
    return F.coalesce(F.when(F.contains(text, F.lit("mph")), F.round(digits * F.lit(1.60934), 2)).otherwise(digits), F.lit(-1.0))


def log_shade(v: Column) -> Column:
    """log(v + 1), null where v is not positive."""
    return F.when(v > 0, F.log1p(v))


def route_ends_fit(start: Column, end: Column, steps: Column, size: float) -> Column:
    """Do a way's ends lie within `size` degrees of where it was asked from and to? Without steps, do both lie so near to
    each other? start, end: structs lon, lat; steps: an array of such."""
    near = lambda p, q: F.pow(p["lon"] - q["lon"], F.lit(2)) + F.pow(p["lat"] - q["lat"], F.lit(2)) <= size**2
    return F.when(F.size(steps) == 0, near(start, end)).otherwise(near(F.get(steps, F.lit(0)), start) & near(F.get(steps, F.size(steps) - 1), end))
