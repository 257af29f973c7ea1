"""Query language, presets and registered queries."""
