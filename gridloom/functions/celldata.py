"""Fields of cells that are kept as JSON text: each has a short and a long key, the short one first."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Short and long keys.
KEYS = {
    "user_entered_value": ("ue", "userEnteredValue"),
    "effective_value": ("ev", "effectiveValue"),
    "user_entered_format": ("uf", "userEnteredFormat"),
    "effective_format": ("ef", "effectiveFormat"),
    "formatted_value": ("fv", "formattedValue"),
    "style_id": ("sid", "styleId"),
    "number_value": ("nv", "numberValue"),
    "string_value": ("sv", "stringValue"),
    "bool_value": ("bv", "boolValue"),
    "formula_value": ("fv", "formulaValue"),
    "error_value": ("ev", "errorValue"),
}


def field(cell: Column, name: str) -> Column:
    """A field of JSON text as text; null where it is missing."""
    short, long = KEYS[name]
    return F.coalesce(F.get_json_object(cell, f"$.{short}"), F.get_json_object(cell, f"$.{long}"))
