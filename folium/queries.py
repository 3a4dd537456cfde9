"""All queries of the library outside its llm subpackage."""

from __future__ import annotations

import folium.catalog.aggregates  # noqa: F401
import folium.catalog.bags  # noqa: F401
import folium.catalog.calls  # noqa: F401
import folium.catalog.drafting  # noqa: F401
import folium.catalog.edits  # noqa: F401
import folium.catalog.facts  # noqa: F401
import folium.catalog.layouts  # noqa: F401
import folium.catalog.ordered  # noqa: F401
import folium.catalog.planning  # noqa: F401
import folium.catalog.plans  # noqa: F401
import folium.catalog.records  # noqa: F401
import folium.catalog.relations  # noqa: F401
import folium.catalog.review  # noqa: F401
import folium.catalog.rulesets  # noqa: F401
import folium.catalog.sets  # noqa: F401
import folium.catalog.sources  # noqa: F401
import folium.catalog.streams  # noqa: F401
import folium.catalog.terms  # noqa: F401
import folium.catalog.text  # noqa: F401
import folium.catalog.trees  # noqa: F401
import folium.catalog.versions  # noqa: F401
from folium.registry import ORACLES, QUERIES

__all__ = ["ORACLES", "QUERIES"]
