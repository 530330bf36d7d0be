"""Named sets of regions, passed to the operators as parameters."""

from __future__ import annotations

# Fixed values.
RUST_BELT = ("Illinois", "Indiana", "Michigan", "Ohio", "Pennsylvania", "Wisconsin", "New York")
FOCUS_STATES = ("Michigan", "California", "Florida")
OFF_MAP_STATES = ("Alaska", "Hawaii")
TERRITORIES = ("PR", "VI", "GU", "AS", "MP")
DISASTER_TERRITORIES = ("AS", "FM", "GU", "MH", "MP", "PR", "PW", "VI")
FIFTY_STATES = (
    "Alabama", "Alaska", "Arizona", "Arkansas", "California", "Colorado", "Connecticut", "Delaware",
    "Florida", "Georgia", "Hawaii", "Idaho", "Illinois", "Indiana", "Iowa", "Kansas", "Kentucky",
    "Louisiana", "Maine", "Maryland", "Massachusetts", "Michigan", "Minnesota", "Mississippi",
    "Missouri", "Montana", "Nebraska", "Nevada", "New Hampshire", "New Jersey", "New Mexico",
    "New York", "North Carolina", "North Dakota", "Ohio", "Oklahoma", "Oregon", "Pennsylvania",
    "Rhode Island", "South Carolina", "South Dakota", "Tennessee", "Texas", "Utah", "Vermont",
    "Virginia", "Washington", "West Virginia", "Wisconsin", "Wyoming",
)
MAP_STATES = (*FIFTY_STATES, "District of Columbia")
SURVEY_STATES = (*FIFTY_STATES, "Puerto Rico", "District of Columbia")
US_VIEW = (-125.0, 24.0, -66.0, 50.0)  # west, south, east, north
