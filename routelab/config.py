"""Settings of a city and of the models. Importing this module does no input or output."""

from __future__ import annotations

from dataclasses import dataclass, field


@dataclass(frozen=True)
class Settings:
    max_walk_m: float = 500.0
    walk_speed_mps: float = 1.2
    k_paths: int = 10
    default_headway_min: float = 10.0
    seed: int = 42
    test_fraction: float = 0.2
    target_trips: int = 1800
    min_trips_per_od: int = 2
    metro_max_gap_sec: float = 3600.0
    bus_max_gap_sec: float = 7200.0


@dataclass(frozen=True)
class Betas:
    """Disutilities, stored positive, and the coefficient of ln(path size)."""

    ivt: float = 0.025
    wait: float = 0.05
    walk: float = 0.035
    transfer: float = 0.4
    pathsize: float = 1.0


@dataclass(frozen=True)
class BusRoute:
    """A bus route that runs beside the metro, cut to the part between two stations or up to a stop."""

    name: str
    route_id: str
    anchors: tuple[str, str]
    trim_at_stop_id: str | None = None


@dataclass(frozen=True)
class City:
    """What a run needs to know of a city: routes with their headsigns, services and demand files."""

    headsigns: dict[str, str | None]
    demand: str  # "entry_exit" or "ridership"
    longest: tuple[str, ...] = ()  # routes that take their longest pattern; others take the commonest
    service_filter: str | None = None
    headway_services: dict[str, str] = field(default_factory=dict)
    branch_boundaries: tuple[str, ...] = ()
    bus_routes: tuple[BusRoute, ...] = ()
    has_od: bool = False


SETTINGS = Settings()
TRUE_BETAS = Betas()

# Ids and names as the two cities' public feeds have them.
CITIES = {
    "sydney": City(
        headsigns={"2-T1-W-sj2-1": "Penrith Via Parramatta", "2-T2-sj2-1": "City Circle Via Museum", "78-L2-sj2-1": None},
        demand="entry_exit",
        longest=("2-T1-W-sj2-1",),
        headway_services={"2-T1-W-sj2-1": "TA+d9+7", "2-T2-sj2-1": "TA+p2+7", "78-L2-sj2-1": "TA+c9+44"},
    ),
    "bengaluru": City(
        headsigns={"GREEN": "Silk Institute", "PURPLE": "Whitefield (Kadugodi)"},
        demand="ridership",
        service_filter="weekday",
        branch_boundaries=("Rajajinagar", "Lalbagh", "Mahatma Gandhi Road"),
        bus_routes=(
            BusRoute("252-F", "1621", ("Nadaprabhu Kempegowda Station, Majestic", "Rajajinagar")),
            BusRoute("25-A", "1771", ("Lalbagh", "Nadaprabhu Kempegowda Station, Majestic")),
            BusRoute("314-D", "1127", ("Nadaprabhu Kempegowda Station, Majestic", "Mahatma Gandhi Road"), "22278"),
        ),
        has_od=True,
    ),
}
