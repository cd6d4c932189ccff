"""Feed enumerations: code to label, defaults, and which of them reject unknown codes."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


@dataclass(frozen=True)
class Codes:
    labels: dict[int, str]
    default: int | None = None
    strict: bool = False


# Fixed values from the feed format.
CODES: dict[str, Codes] = {
    "location_type": Codes({0: "stop_point", 1: "stop_area", 2: "station_entrance", 3: "generic_node",
                            4: "boarding_area"}, 0),
    "pickup_drop_off": Codes({0: "regular", 1: "not_available", 2: "arrange_by_phone",
                              3: "coordinate_with_driver"}, 0),
    "continuous": Codes({0: "continuous", 1: "not_available", 2: "arrange_by_phone",
                         3: "coordinate_with_driver"}, 1),
    "timepoint": Codes({0: "approximate", 1: "exact"}, 1, strict=True),
    "availability": Codes({0: "information_not_available", 1: "available", 2: "not_available"}, 0),
    "bikes_allowed": Codes({0: "no_bike_info", 1: "at_least_one_bike", 2: "no_bikes_allowed"}, 0),
    "exact_times": Codes({0: "frequency_based", 1: "schedule_based"}, 0, strict=True),
    "transfers": Codes({0: "no_transfer", 1: "unique_transfer", 2: "two_transfers"}),
    "exception_type": Codes({1: "added", 2: "deleted"}, None, strict=True),
    "direction": Codes({0: "outbound", 1: "inbound"}, None, strict=True),
    "payment_method": Codes({0: "aboard", 1: "pre_boarding"}, None, strict=True),
    "transfer_type": Codes({0: "recommended", 1: "timed", 2: "min_time", 3: "impossible"}, 0, strict=True),
    "pathway_mode": Codes({1: "walkway", 2: "stairs", 3: "moving_sidewalk", 4: "escalator", 5: "elevator",
                           6: "fare_gate", 7: "exit_gate"}, 1, strict=True),
    "pathway_direction": Codes({0: "unidirectional", 1: "bidirectional"}, 0, strict=True),
}

# Mode words of requests and the drawing width of a line by mode.
MODE_WORDS = {"bus": "bus", "tram": "tramway", "subway": "subway", "rail": "rail", "ferry": "ferry"}
LINE_WIDTH = {"rail": 4.9, "subway": 4.3, "tram": 3.4}
OTHER_WIDTH = 2.6


def _lookup(mapping: dict, key: Column) -> Column:
    pairs = [F.lit(x) for kv in mapping.items() for x in kv]
    return F.try_element_at(F.create_map(*pairs), key)


def code_of(text: Column, kind: str) -> Column:
    """Code of a text cell; empty means the default, a strict kind gives null for unknown codes."""
    spec = CODES[kind]
    code = text.try_cast("int")
    if spec.strict:
        code = F.when(code.isin(list(spec.labels)), code)
    if spec.default is None:
        return code
    empty = text.isNull() | (text == "")
    return F.when(empty, F.lit(spec.default)).otherwise(code)


def label_of(code: Column, kind: str) -> Column:
    """Label of a code; ``unknown`` outside the list, and for transfers null means unlimited."""
    found = _lookup(CODES[kind].labels, code)
    if kind == "transfers":
        return F.when(code.isNull(), "unlimited").otherwise(F.coalesce(found, F.lit("other")))
    return F.when(code.isNotNull(), F.coalesce(found, F.lit("unknown")))


def known_or_default(code: Column, kind: str) -> Column:
    """Replace codes outside the list by the default of the kind."""
    spec = CODES[kind]
    return F.when(code.isin(list(spec.labels)), code).otherwise(F.lit(spec.default))


def route_type_label(code: Column) -> Column:
    """Basic and extended route types; the order of the branches matters."""
    h = F.floor(code / 100).cast("int")
    branches = [
        ("tramway", 0, (9,)), ("subway", 1, (4,)), ("rail", 2, (1,)), ("bus", 3, (7, 8)),
        ("ferry", 4, (10, 12)), ("cable_car", 5, ()), ("gondola", 6, (13,)), ("funicular", 7, (14,)),
        ("coach", None, (2,)), ("air", None, (11,)), ("taxi", None, (15,)),
    ]
    out = None
    for label, basic, hundreds in branches:
        test = h.isin(list(hundreds)) if hundreds else F.lit(False)
        if basic is not None:
            test = test | (code == basic)
        out = F.when(test, label) if out is None else out.when(test, label)
    return out.otherwise(F.when(code.isNotNull(), "other"))


def mode_label(route_type: Column) -> Column:
    """Mode shown to riders; other types give an empty text."""
    shown = {"bus": "bus", "tramway": "tram", "subway": "subway", "rail": "rail"}
    return F.coalesce(_lookup(shown, route_type), F.lit(""))


def line_width(mode: Column) -> Column:
    return F.coalesce(_lookup(LINE_WIDTH, mode), F.lit(OTHER_WIDTH))


def requested_types(words: DataFrame, column: str = "mode") -> DataFrame:
    """Rows with a known mode word, with its ``route_type``; unknown words are dropped."""
    return words.withColumn("route_type", _lookup(MODE_WORDS, F.col(column))).where("route_type is not null")
