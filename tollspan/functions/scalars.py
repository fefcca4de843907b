"""Column expressions for plates, gantries, dates, classes and densities."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Tokens that mean "no value" in text columns.
NULL_TOKENS = ["", "NAN", "NULL", "NONE"]

# Accepted date layouts of detection files, in order of trial, each with
# the shape of its texts. The last element tells whether the layout carries a zone offset.
_D, _Y, _HMS, _HM = "[0-9]{1,2}", "[0-9]{4}", "[0-9]{1,2}:[0-9]{1,2}:[0-9]{1,2}", "[0-9]{1,2}:[0-9]{1,2}"
DETECTION_TIME_FORMATS = [
    ("d/M/yyyy H:m:s", f"^{_D}/{_D}/{_Y} {_HMS}$", False),
    ("d-M-yyyy H:m:s", f"^{_D}-{_D}-{_Y} {_HMS}$", False),
    ("yyyy-M-d H:m:s", f"^{_Y}-{_D}-{_D} {_HMS}$", False),
    ("yyyy/M/d H:m:s", f"^{_Y}/{_D}/{_D} {_HMS}$", False),
    ("yyyy-M-d'T'H:m:s'Z'", f"^{_Y}-{_D}-{_D}T{_HMS}Z$", False),
    ("yyyy-M-d'T'H:m:s.SSSSSS'Z'", f"^{_Y}-{_D}-{_D}T{_HMS}[.][0-9]+Z$", False),
    ("yyyy-M-d'T'H:m:sXX", f"^{_Y}-{_D}-{_D}T{_HMS}[+-][0-9]{{2}}(:?[0-9]{{2}})?$", True),
    ("d/M/yyyy H:m", f"^{_D}/{_D}/{_Y} {_HM}$", False),
    ("yyyy-M-d H:m", f"^{_Y}-{_D}-{_D} {_HM}$", False),
]

# Raw class to feature class, and its label.
CATEGORY_REMAP = {1: 1, 2: 2, 3: 2, 4: 3}
CATEGORY_LABELS = {1: "Light", 2: "Heavy", 3: "Motorcycles"}

# Carriageway names.
CARRIAGEWAYS = {"oriente": "Oriente", "poniente": "Poniente", "ambas": "Ambas"}

# Time-to-collision limit in seconds by gantry number (27 has none).
TTC_LIMIT_S = {
    1: 5.5, 2: 15.0, 3: 13.0, 4: 14.0, 5: 10.5, 6: 4.5, 7: 13.5, 8: 13.5, 9: 15.0, 10: 14.5,
    11: 11.5, 12: 15.0, 13: 11.5, 14: 4.5, 15: 14.0, 16: 13.0, 17: 9.0, 18: 8.5, 19: 12.0, 20: 14.0,
    21: 10.5, 22: 9.5, 23: 13.0, 24: 9.5, 25: 15.0, 26: 12.0, 28: 7.5, 29: 14.0, 30: 15.0, 31: 10.0,
    32: 8.0,
}

# Vehicle templates and the class that selects each.
VEHICLE_TEMPLATES = {
    "car": {"accel": 0.8, "decel": 4.5, "sigma": 0.5, "length": 4.5, "min_gap": 2.5, "max_speed": 180.0,
            "v_class": "passenger"},
    "bus": {"accel": 0.5, "decel": 4.0, "sigma": 0.5, "length": 12.0, "min_gap": 2.5, "max_speed": 90.0,
            "v_class": "bus"},
    "truck": {"accel": 0.4, "decel": 4.0, "sigma": 0.5, "length": 10.0, "min_gap": 2.5, "max_speed": 120.0,
              "v_class": "truck"},
    "motorcycle": {"accel": 1.0, "decel": 5.0, "sigma": 0.5, "length": 2.0, "min_gap": 1.5, "max_speed": 180.0,
                   "v_class": "motorcycle"},
}
CLASS_TEMPLATE = {1: "car", 2: "bus", 3: "truck", 4: "motorcycle"}

# Characters a number may hold, and white space.
NUMBER_CHARS = "0123456789+-.eE"
BLANKS = " \t\n\x0b\f\r"


def strip(c: Column) -> Column:
    """Trim every kind of white space, not blanks only."""
    return F.btrim(c, F.lit(BLANKS))


def _number(text: Column) -> Column:
    """Double of a text made of number characters only (so no `NaN`, `Infinity` or `1d`)."""
    return F.when(F.translate(text, NUMBER_CHARS, "") == "", text.try_cast("double"))


def clean_text(c: Column) -> Column:
    """Trimmed text, empty becomes NULL."""
    return F.nullif(strip(c), F.lit(""))


def normalise_plate(c: Column) -> Column:
    text = F.upper(strip(c.cast("string")))
    return F.when(~text.isin(NULL_TOKENS), text)


def parse_decimal(c: Column) -> Column:
    """Number with a decimal comma or point; anything else is NULL."""
    return _number(F.replace(strip(c), F.lit(","), F.lit(".")))


def parse_whole(c: Column) -> Column:
    """Tolerant integer: numeric text is rounded half to even, other text is NULL."""
    text = strip(c)
    return F.coalesce(text.try_cast("int"), F.bround(_number(text), 0).try_cast("int"))


def normalise_gantry(c: Column) -> Column:
    """Upper-case code; numbers lose their decimal comma and, when whole, their decimals."""
    text = F.upper(strip(c.cast("string")))
    number = parse_decimal(text)
    whole = F.when(number == F.floor(number), number.cast("bigint").cast("string"))
    code = F.coalesce(text.try_cast("bigint").cast("string"), whole, number.cast("string"), text)
    return F.when(~text.isin(NULL_TOKENS), code)


def parse_detection_time(c: Column) -> Column:
    """First matching layout, runs of blanks as one; a zone offset (`+hh`, `+hhmm`, `+hh:mm`) is applied and dropped.

    Each text meets the one layout that it has the shape of, so no parser fails on the way to it. All texts are
    read as UTC, so the session's zone and its clock changes play no part.
    """
    c = F.regexp_replace(strip(c), " +", " ")
    out = None
    for layout, shape, zoned in DETECTION_TIME_FORMATS:
        if zoned:
            whole = F.regexp_replace(c, "([+-][0-9]{2}):?([0-9]{2})$", "$1$2")
            text = F.when(whole.rlike("[+-][0-9]{4}$"), whole).otherwise(F.concat(c, F.lit("00")))
        else:
            text, layout = F.concat(c, F.lit(" +0000")), f"{layout} XX"
        micros = F.unix_micros(F.try_to_timestamp(text, F.lit(layout)))
        at = F.timestamp_add("MICROSECOND", micros, F.expr("TIMESTAMP_NTZ'1970-01-01 00:00:00'"))
        out = F.when(c.rlike(shape), at) if out is None else out.when(c.rlike(shape), at)
    return out


_EVENT_TIME = (
    r"[0-9]{1,4}[/.-][0-9]{1,2}[/.-][0-9]{1,4}"
    r"(?:[ T]+[0-9]{1,2}:[0-9]{1,2}(?::[0-9]{1,2}(?:[.][0-9]{1,6})?)? ?(?:[AaPp][Mm])?)?"
)
#: Steps from a day-first text to `year-month-day hour:minute:second.fraction[ AM]`.
_EVENT_STEPS = (
    (rf"(?s)^(?!{_EVENT_TIME}$).*$", ""),
    ("^(0?[0-9]|1[0-2])[/.-](1[3-9]|[2-9][0-9])[/.-]", "$2/$1/"),  # the month stands first
    ("^([0-9]{1,2})[/.-]([0-9]{1,2})[/.-]([0-9]{1,4})(?![0-9])", "$3-$2-$1"),
    ("^([0-9]{4})[/.-]([0-9]{1,2})[/.-]([0-9]{1,2})(?![0-9])", "$1-$2-$3"),
    ("^([0-9])-", "200$1-"),
    ("^(69|[7-9][0-9])-", "19$1-"),
    ("^([0-9]{2})-", "20$1-"),
    ("^([^ T]+)$", "$1 0:0:0.0"),
    ("^([^ T]+)[ T]+([0-9]{1,2}:[0-9]{1,2})(?![:0-9])", "$1 $2:0.0"),
    ("^([^ T]+)[ T]+([0-9:]+)(?![.:0-9])", "$1 $2.0"),
    ("^([^ T]+)[ T]+([0-9:.]+) ?", "$1 $2 "),
    (" $", ""),
)
_EVENT_LAYOUT = "yyyy-M-d[ h:m:s.SSSSSS a][ H:m:s.SSSSSS] XX"


def parse_event_time(date_text: Column, time_text: Column) -> Column:
    """Day-first date text plus time text, in any mix of layouts.

    Parts are parted by `/`, `-` or `.`; a four-digit first part is the year; two-digit years from 69 on lie in
    the 1900s. A month above 12 changes places with a day that is not. The time may be missing, be joined by
    `T`, have a fraction, or AM or PM.
    """
    text = strip(F.concat_ws(" ", strip(date_text), strip(time_text)))
    for shape, form in _EVENT_STEPS:  # each step reads the one before once, so a text is taken apart once
        text = F.regexp_replace(text, shape, form)
    micros = F.unix_micros(F.try_to_timestamp(F.concat(text, F.lit(" +0000")), F.lit(_EVENT_LAYOUT)))
    return F.timestamp_add("MICROSECOND", micros, F.expr("TIMESTAMP_NTZ'1970-01-01 00:00:00'"))


def with_slot(df: DataFrame, ts: str = "ts", minutes: int = 5, name: str = "interval_start") -> DataFrame:
    """Add the epoch-aligned interval a timestamp falls in; rows without a time are dropped."""
    return df.withColumn(name, F.window(ts, f"{minutes} minutes")["start"])


def slug(c: Column) -> Column:
    text = F.regexp_replace(F.regexp_replace(F.lower(strip(c)), "[^a-z0-9]+", "_"), "^_+|_+$", "")
    return F.when(text == "", "unknown").otherwise(text)


def label_slug(c: Column) -> Column:
    """Slug of a cluster label; a leading minus becomes `neg_`."""
    return slug(F.regexp_replace(strip(c.cast("string")), "^-", "neg_"))


# Accented letters and their plain form.
ACCENTED = "áàäâãéèëêíìïîóòöôõúùüûñç"
PLAIN = "aaaaaeeeeiiiiooooouuuunc"


def fold_key(c: Column) -> Column:
    """Lower-case key without accents, spaces or punctuation."""
    return F.regexp_replace(F.translate(F.lower(c), ACCENTED, PLAIN), "[^a-z0-9]", "")


def lookup(c: Column, table: dict) -> Column:
    """Literal-map lookup; a missing key gives NULL."""
    pairs = [F.lit(x) for kv in table.items() for x in kv]
    return F.try_element_at(F.create_map(*pairs), c)


def category_label(c: Column) -> Column:
    return lookup(c, {raw: CATEGORY_LABELS[cls] for raw, cls in CATEGORY_REMAP.items()})


def carriageway(c: Column) -> Column:
    return lookup(F.lower(strip(c)), CARRIAGEWAYS)


def strip_subtype(c: Column) -> Column:
    return F.regexp_replace(c, r"^AC-0[1-6] -\s*", "")


def minutes_between(start: str, end: str) -> Column:
    """Whole minutes, half to even."""
    return F.bround(F.expr(f"timestampdiff(MICROSECOND, {start}, {end}) / 60000000.0D"), 0)


def severity(df: DataFrame) -> Column:
    """'1' when column `7` counts a victim, else '0'; 'Na' when a severity column is absent."""
    if any(str(i) not in df.columns for i in range(1, 10)):
        return F.lit("Na")
    grave = F.coalesce(F.col("`7`").try_cast("double"), F.lit(0.0)) > 0
    return F.when(grave, "1").otherwise("0")


def iso_week(c: Column) -> Column:
    """ISO year times 100 plus ISO week."""
    return (F.extract(F.lit("YEAROFWEEK"), c) * 100 + F.weekofyear(c)).cast("int")


def month_key(c: Column) -> Column:
    """`yyyy-MM` of a zone-less timestamp."""
    return F.concat(F.lpad(F.year(c).cast("string"), 4, "0"), F.lit("-"), F.lpad(F.month(c).cast("string"), 2, "0"))


def density(flow_per_hour: Column, speed: Column, at_rest: float | None = 0.0) -> Column:
    """Vehicles per kilometre; `at_rest` is the value where the speed is not positive."""
    return F.when(speed > 0, flow_per_hour / speed).when(speed <= 0, F.lit(at_rest))


def entropy_term(share: Column) -> Column:
    """-p ln p, with 0 for p = 0."""
    return F.when(share > 0, -share * F.ln(share)).otherwise(F.lit(0.0))


def soft_entropy(probabilities: Column) -> Column:
    """Entropy of an array of responsibilities, floored at 1e-12."""
    return F.aggregate(
        probabilities, F.lit(0.0), lambda acc, p: acc - p * F.ln(p + F.lit(1e-12))
    )


def template_name(vehicle_class: Column) -> Column:
    return F.coalesce(lookup(vehicle_class.cast("int"), CLASS_TEMPLATE), F.lit("car"))


def template_value(vehicle_class: Column, field: str) -> Column:
    return lookup(template_name(vehicle_class), {k: v[field] for k, v in VEHICLE_TEMPLATES.items()})


def safe_id(c: Column) -> Column:
    """Identifier of at most 60 characters made from a plate.

    Other characters become `_`, a run of them one; none stays at either end. Each of the two patterns goes over
    the text once and never back: the first 60 characters of the result, and whether any but `_` follow them.
    """
    units = "(?:[A-Za-z0-9_-]|[^A-Za-z0-9_-]++)"
    first = F.regexp_extract(c, f"^[^A-Za-z0-9-]*+({units}{{0,60}}+)", 1)
    more = c.rlike(f"^[^A-Za-z0-9-]*+{units}{{60}}+[^A-Za-z0-9-]*+[A-Za-z0-9-]")
    text = F.regexp_replace(first, "[^A-Za-z0-9_-]+", "_")
    text = F.when(more, text).otherwise(F.regexp_replace(text, "_+$", ""))
    text = F.when(text == "", "veh").otherwise(text)
    return F.substring(F.when(text.rlike("^[0-9]"), F.concat(F.lit("veh_"), text)).otherwise(text), 1, 60)


def feature_signature(names: Column) -> Column:
    """md5 of the sorted, joined feature names of an array column."""
    return F.md5(F.array_join(F.array_sort(names), "|"))


def json_number(payload: Column, field: str) -> Column:
    return F.get_json_object(payload, f"$.{field}").try_cast("double")


def ttc_limit(gantry: Column) -> Column:
    """Time-to-collision limit of a gantry code; NULL for codes without one."""
    number = parse_decimal(gantry)
    return lookup(F.when(number == F.floor(number), number.cast("int")), TTC_LIMIT_S)


def split_lat_lon(c: Column) -> list[Column]:
    """`lat,lon` text as two double columns."""
    parts = F.split(c, ",")
    return [parse_decimal(F.try_element_at(parts, F.lit(i))) for i in (1, 2)]


def any_contains(columns: Sequence[str], text: str) -> Column:
    """Case-insensitive search of a text in any of the columns."""
    return F.contains(F.lower(F.concat_ws("\u0001", *[F.col(c).cast("string") for c in columns])), F.lit(text.lower()))
