"""Settings of a study: area, dates, grid, sources, model and budget."""

from __future__ import annotations

import math
from dataclasses import asdict, dataclass, field, fields, replace

# Cities with (west, south, east, north) in degrees, projected system and display name.
CITIES = {
    "delhi": ((76.84, 28.40, 77.35, 28.88), "EPSG:32643", "Delhi NCR"),
    "mumbai": ((72.77, 18.89, 72.99, 19.27), "EPSG:32643", "Greater Mumbai"),
    "hyderabad": ((78.30, 17.20, 78.65, 17.55), "EPSG:32644", "Hyderabad"),
    "ahmedabad": ((72.45, 22.92, 72.72, 23.15), "EPSG:32643", "Ahmedabad"),
    "bengaluru": ((77.46, 12.83, 77.78, 13.14), "EPSG:32643", "Bengaluru"),
}
MODES = ("synthetic", "scenes", "observations")


@dataclass(frozen=True)
class Config:
    """A study; unknown modes, empty areas, reversed dates and values out of range are refused."""

    city: str = "delhi"
    bbox: tuple[float, float, float, float] | None = None
    crs: str | None = None
    start: str = "2024-03-01"
    end: str = "2024-05-31"
    resolution_m: float = 100.0
    mode: str = "synthetic"
    max_cloud_pct: float = 20.0
    datasets: dict[str, bool] = field(default_factory=dict)
    seed: int = 0
    shape: tuple[int, int] | None = None
    budget: float = 1e7
    area_cap_frac: float = 0.30
    optimizer: str = "greedy"
    equity: bool = True

    def __post_init__(self):
        key = match_city(self.city)
        if key is None and self.bbox is None:
            raise ValueError(f"unknown city {self.city!r}; known: {', '.join(CITIES)}; or give a bbox")
        if self.bbox is None:
            object.__setattr__(self, "bbox", CITIES[key][0])
        if self.crs is None:
            west, south, east, north = self.bbox
            zone = int(((west + east) / 2 + 180) / 6) + 1
            object.__setattr__(self, "crs", CITIES[key][1] if key else f"EPSG:{326 if south + north >= 0 else 327}{zone:02d}")
        object.__setattr__(self, "bbox", tuple(float(x) for x in self.bbox))
        west, south, east, north = self.bbox
        if not (west < east and south < north):
            raise ValueError("the bbox is empty")
        if self.mode not in MODES:
            raise ValueError(f"unknown mode {self.mode!r}; one of {MODES}")
        if self.start > self.end:
            raise ValueError("the dates are reversed")
        if not (self.resolution_m > 0 and self.budget >= 0 and 0 < self.area_cap_frac <= 1):
            raise ValueError("resolution, budget or area share is out of range")

    @property
    def name(self) -> str:
        key = match_city(self.city)
        return CITIES[key][2] if key else self.city.title()

    @classmethod
    def from_city(cls, city: str, **changes) -> Config:
        if match_city(city) is None:
            raise KeyError(f"unknown city {city!r}; known: {', '.join(CITIES)}")
        return cls(city=match_city(city), **changes)

    @classmethod
    def from_dict(cls, values: dict) -> Config:
        """Keys that are no setting are ignored."""
        known = {f.name for f in fields(cls)}
        return cls(**{k: tuple(v) if k in ("bbox", "shape") and v is not None else v for k, v in values.items() if k in known})

    def to_dict(self) -> dict:
        return asdict(self)

    def changed(self, **changes) -> Config:
        return replace(self, **changes)

    def uses(self, dataset: str) -> bool:
        """Data sets are used unless switched off."""
        return bool(self.datasets.get(dataset, True))

    def geometry(self) -> Geometry:
        return Geometry.of(self)


def match_city(name: str | None) -> str | None:
    """The key of a city given by key or display name, in any case."""
    said = (name or "").strip().lower()
    for key, (_, _, shown) in CITIES.items():
        if said and said in (key, shown.lower()):
            return key
    return None


def utm_zone(crs: str, longitude: float) -> tuple[int, bool]:
    """(zone, whether north) of an EPSG code 326zz or 327zz, else the zone of the longitude, north."""
    code = crs.upper().removeprefix("EPSG:")
    if code.isdigit() and len(code) == 5 and code[:3] in ("326", "327"):
        return int(code[3:]), code[:3] == "326"
    return int((longitude + 180.0) / 6.0) + 1, True


def to_utm(lon: float, lat: float, zone: int, north: bool = True) -> tuple[float, float]:
    """Easting and northing on the WGS84 ellipsoid by the usual transverse Mercator series."""
    a, f, k0 = 6378137.0, 1 / 298.257223563, 0.9996
    e2 = f * (2 - f)
    second = e2 / (1 - e2)
    phi, lam = math.radians(lat), math.radians(lon - (zone * 6 - 183))
    n = a / math.sqrt(1 - e2 * math.sin(phi) ** 2)
    t, c, x = math.tan(phi) ** 2, second * math.cos(phi) ** 2, lam * math.cos(phi)
    m = a * (
        (1 - e2 / 4 - 3 * e2**2 / 64 - 5 * e2**3 / 256) * phi
        - (3 * e2 / 8 + 3 * e2**2 / 32 + 45 * e2**3 / 1024) * math.sin(2 * phi)
        + (15 * e2**2 / 256 + 45 * e2**3 / 1024) * math.sin(4 * phi)
        - (35 * e2**3 / 3072) * math.sin(6 * phi)
    )
    east = 500_000 + k0 * n * (x + (1 - t + c) * x**3 / 6 + (5 - 18 * t + t**2 + 72 * c - 58 * second) * x**5 / 120)
    up = k0 * (m + n * math.tan(phi) * (x**2 / 2 + (5 - t + 9 * c + 4 * c**2) * x**4 / 24 + (61 - 58 * t + t**2 + 600 * c - 330 * second) * x**6 / 720))
    return east, up if north else up + 10_000_000


@dataclass(frozen=True)
class Geometry:
    """A north-up grid: rows, columns, the affine of its pixels, and its bounds in map units."""

    rows: int
    cols: int
    transform: tuple[float, float, float, float, float, float]
    crs: str
    bounds: tuple[float, float, float, float]

    @classmethod
    def of(cls, config: Config) -> Geometry:
        """The grid of a study: its corners are projected, and the extent holds at least 2 by 2 whole pixels."""
        west, south, east, north = config.bbox
        zone, up = utm_zone(config.crs, (west + east) / 2)
        x0, y0 = to_utm(west, south, zone, up)
        x1, y1 = to_utm(east, north, zone, up)
        r = config.resolution_m
        cols, rows = max(2, round((x1 - x0) / r)), max(2, round((y1 - y0) / r))
        if config.shape:
            rows, cols = config.shape
        return cls(rows, cols, (r, 0.0, x0, 0.0, -r, y1), config.crs, (x0, y1 - rows * r, x0 + cols * r, y1))
