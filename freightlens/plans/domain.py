"""The dictionaries of one delivery domain, handed to the feature builders."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from dataclasses import dataclass, field

from freightlens import constants as c


@dataclass(frozen=True)
class Domain:
    region_of_state: Mapping[str, str] = field(default_factory=lambda: c.REGION_OF_STATE)
    remote_region: str = c.REMOTE_REGION
    core_region: str = c.CORE_REGION
    remote_seller_states: Sequence[str] = tuple(c.REMOTE_SELLER_STATES)
    complexity_of_category: Mapping[str, int] = field(
        default_factory=lambda: c.COMPLEXITY_OF_CATEGORY)
    default_complexity: int = c.DEFAULT_COMPLEXITY
    capital_cities: Sequence[str] = tuple(c.CAPITAL_CITIES)
    neighbours_of_state: Mapping[str, Sequence[str]] = field(
        default_factory=lambda: c.NEIGHBOURS_OF_STATE)
    hub_point: tuple[float, float] = c.HUB_POINT
    platform_launch: str = c.PLATFORM_LAUNCH
