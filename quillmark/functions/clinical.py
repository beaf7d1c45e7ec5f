"""Doses, frequencies, durations, dates and units as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from quillmark.functions.text import fold, lab_text, numeric_context, squeeze

#: Times a day of words in an order's frequency; the longest word that occurs counts.
FREQUENCY_WORDS = {
    "od": 1, "qd": 1, "hs": 1, "once daily": 1, "once a day": 1, "at night": 1, "morning": 1, "before breakfast": 1, "after breakfast": 1, "after food daily": 1, "before food daily": 1,
    "after dinner daily": 1, "daily": 1, "bd": 2, "bid": 2, "twice daily": 2, "twice a day": 2, "tds": 3, "tid": 3, "thrice daily": 3, "qid": 4, "qds": 4, "sos": 0, "prn": 0, "stat": 0,
    "weekly": 0.143, "once a week": 0.143, "once in a year": 0.003, "twice in a year": 0.006, "once in 6 months": 0.006, "once in 3 months": 0.011,
}
#: The same for terminology; the first that occurs counts.
FREQUENCY_TERMS = {
    "od": 1, "qd": 1, "hs": 1, "once daily": 1, "1-0-0": 1, "0-0-1": 1, "0-1-0": 1, "bd": 2, "bid": 2, "twice daily": 2, "1-0-1": 2, "1-1-0": 2, "0-1-1": 2,
    "tds": 3, "tid": 3, "thrice daily": 3, "1-1-1": 3, "qid": 4, "1-1-1-1": 4, "sos": 0, "prn": 0,
}
#: The closed set of the reading grammar; before and after meals have no number.
FREQUENCY_CODES = {"od": 1, "qd": 1, "hs": 1, "bd": 2, "bid": 2, "tds": 3, "tid": 3, "qid": 4, "sos": 0, "prn": 0, "stat": 0, "qhs": 1, "ac": None, "pc": None}
#: Units of strength as written, and their codes.
STRENGTH_UNITS = {"mcg": "ug", "µg": "ug", "ug": "ug", "mg": "mg", "gm": "g", "g": "g", "ml": "mL", "iu": "[IU]", "u": "[IU]", "unit": "[IU]", "units": "[IU]", "iu/ml": "[IU]/mL", "u/ml": "[IU]/mL", "%": "%"}
#: Unit aliases and their codes.
UNIT_CODES = {
    "mg": "mg", "g": "g", "gm": "g", "mcg": "ug", "µg": "ug", "ug": "ug", "ml": "mL", "cc": "mL", "l": "L", "%": "%", "mg/dl": "mg/dL", "g/dl": "g/dL", "u/l": "U/L", "iu/l": "[IU]/L",
    "miu/l": "m[IU]/L", "mmol/l": "mmol/L", "mmhg": "mm[Hg]", "mm hg": "mm[Hg]", "/min": "/min", "bpm": "/min", "kg": "kg", "cm": "cm", "f": "[degF]", "c": "Cel", "10^3/ul": "10*3/uL", "10*3/ul": "10*3/uL",
}
#: Names of vital signs as written.
VITAL_NAMES = {
    "pulse": "heart_rate", "hr": "heart_rate", "heart_rate": "heart_rate", "resp": "resp_rate", "rr": "resp_rate", "respiratory_rate": "resp_rate", "temp": "temperature", "temperature": "temperature",
    "spo2": "spo2", "o2_sat": "spo2", "oxygen_saturation": "spo2", "weight": "weight", "wt": "weight", "height": "height", "ht": "height", "bmi": "bmi", "pain_score": "pain_score", "pain": "pain_score",
    "systolic_bp": "systolic_bp", "diastolic_bp": "diastolic_bp",
}
MONTHS = ("jan", "feb", "mar", "apr", "may", "jun", "jul", "aug", "sep", "oct", "nov", "dec")


def lookup(c: Column, table: dict) -> Column:
    return F.element_at(F.create_map(*[F.lit(x) for kv in table.items() for x in kv]), c)


def _got(c: Column, rx: str, group: int = 1) -> Column:
    """A group of the first match; null without one."""
    x = F.regexp_extract(c, rx, group)
    return F.when(F.length(x) > 0, x)


def first_number(c: Column) -> Column:
    """the first number in a text."""
    return _got(c, r"(-?\d+(?:\.\d+)?)").cast("double")


def quantity(c: Column) -> Column:
    """struct(value, unit) of a quantity written as JSON: an object, a number or a text such as 500 mg."""
    v = F.try_parse_json(c)
    kind = F.schema_of_variant(v)
    value, text = F.try_variant_get(v, "$.value", "string"), F.try_variant_get(v, "$", "string")
    unit = F.coalesce(*[F.try_variant_get(v, f"$.{k}", "string") for k in ("unit_ucum", "unit_text", "unit")])
    is_object, plain = kind.startswith("OBJECT"), kind.isin("STRING", "BIGINT", "DOUBLE") | kind.startswith("DECIMAL")
    written = _got(text, r"-?\d+(?:\.\d+)?\s*([A-Za-z%/µ][A-Za-z%/0-9µ.\[\]*^-]*)")
    return F.struct(F.when(is_object, first_number(value)).when(plain, first_number(text)).alias("value"), F.when(is_object, unit).when(kind == "STRING", written).alias("unit"))


def slots(c: Column) -> Column:
    """The slots of a pattern such as 1-0-1 or 1-0-0-1, wherever it stands; empty if none."""
    rx = r"(?<![\d.])(\d)\s*-\s*(\d)\s*-\s*(\d)(?:\s*-\s*(\d))?(?![\d.])"
    return F.array_compact(F.array(*[_got(c, rx, k).cast("int") for k in (1, 2, 3, 4)]))


def _first_in(low: Column, table: dict) -> Column:
    out = F.lit(None).cast("double")
    for word, n in reversed(table.items()):
        out = F.when(low.contains(word), F.lit(float(n))).otherwise(out)
    return out


def per_day(c: Column) -> Column:
    """F22 of orders: sum of slots, else the longest known word anywhere in the text, `3 times a day`, `q8h`; null if unknown."""
    low = F.lower(F.trim(c))
    s = slots(low)
    words = dict(sorted(FREQUENCY_WORDS.items(), key=lambda kv: -len(kv[0])))
    times = _got(low, r"(\d+(?:\.\d+)?)\s*(?:times|x)\s*(?:/|per|a|an|each)?\s*day\b").cast("double")
    hours = _got(low, r"\bq\s*(\d+)\s*h(?:rs?|ours?)?\b").cast("double")
    return F.when(F.size(s) > 0, F.aggregate(s, F.lit(0), lambda a, x: a + x).cast("double")).otherwise(F.coalesce(_first_in(low, words), times, F.when(hours > 0, F.round(24.0 / hours, 2))))


def per_day_of_term(c: Column) -> Column:
    """F22 of terminology: the first known term in the normalised text, else the sum of a whole pattern."""
    s = F.when(F.trim(c).rlike(r"^\d-\d-\d(?:-\d)?$"), slots(c))
    return F.coalesce(_first_in(lab_text(c), FREQUENCY_TERMS), F.aggregate(s, F.lit(0), lambda a, x: a + x).cast("double"))


def dose_slots(c: Column) -> Column:
    """slots of d-d-d or d-d-d-d, halves allowed, none above 4; null if the text is anything else."""
    t = F.regexp_replace(F.replace(numeric_context(c), F.lit(" "), F.lit("")), "[—–]", "-")
    parts = F.split(t, "-")
    value = F.transform(parts, lambda p: F.when(p.isin("½", "1/2"), 0.5).when(p.rlike("^[0-9]$"), p.cast("double")))
    fine = F.size(parts).isin(3, 4) & F.forall(value, lambda v: F.coalesce(v <= 4, F.lit(False)))
    return F.when(fine, value)


def per_day_of_reading(c: Column) -> Column:
    """F22 of readings: struct(valid, per_day): the closed set, else the slots of a pattern that aren't zero."""
    key = F.regexp_replace(fold(c), "[^a-z]", "")
    known = key.isin(*FREQUENCY_CODES)
    used = F.size(F.filter(dose_slots(c), lambda v: v > 0))
    pattern = dose_slots(c).isNotNull()
    return F.struct(F.coalesce(known | pattern, F.lit(False)).alias("valid"), F.when(known, lookup(key, FREQUENCY_CODES).cast("double")).when(pattern, used.cast("double")).alias("per_day"))


def duration_days(text: Column, number: Column) -> Column:
    """F23 of orders: a number given is days; else `5 days`, `2 months`, `a month` of the text."""
    low = F.lower(text)
    n = first_number(number)
    month = F.when(low.rlike(r"\bmonth\b"), F.coalesce(_got(low, r"(\d+)\s*month").cast("int") * 30, F.lit(30)))
    return F.coalesce(F.when(n != 0, n.cast("int")), _got(low, r"x?\s*(\d+)\s*days?").cast("int"), month)


def duration_of_reading(c: Column) -> Column:
    """F23 of readings: x 5 d, 2 wk, 1/52, 1 month in days; null if it is none or over ten years."""
    t = F.replace(numeric_context(c), F.lit("×"), F.lit("x"))
    weeks = _got(t, r"(\d+)\s*/\s*52").cast("int") * 7
    rx = r"(\d+)\s*(d|day|days|w|wk|wks|week|weeks|m|mo|month|months)\b"
    unit = _got(t, rx, 2)
    days = _got(t, rx).cast("int") * F.when(unit.startswith("w"), 7).when(unit.startswith("m"), 30).otherwise(1)
    return F.coalesce(weeks, F.when(days <= 3650, days))


def strength_of_reading(c: Column) -> Column:
    """struct(value, unit) of a text that is nothing but a number and a unit."""
    t = F.replace(numeric_context(c), F.lit(" "), F.lit(""))
    rx = r"^(\d+(?:\.\d+)?)(mg/ml|mg/5ml|mg|gm|g|mcg|ug|µg|ml|iu|units|u|%)$"
    return F.struct(_got(t, rx).cast("double").alias("value"), _got(t, rx, 2).alias("unit"))


def strength(c: Column) -> Column:
    """struct(name, value, unit) of a product's name: the first dose; a volume or gram counts only if there is nothing else."""
    rx = r"(?i)\b(\d+(?:\.\d+)?)\s*(mcg|µg|ug|mg|gm|g|ml|iu|units?|u/ml|iu/ml|%)(?![0-9A-Za-zµ_])"
    percent = r"(?i)\b(\d+(?:\.\d+)?)\s*(?:mcg|µg|ug|mg|gm|g|ml|iu|units?|u/ml|iu/ml)(?![0-9A-Za-zµ_])"
    found = F.regexp_extract_all(c, F.lit(percent), F.lit(0))
    code = lambda x: lookup(F.lower(F.regexp_extract(x, rx, 2)), STRENGTH_UNITS)
    doses = F.filter(found, lambda x: ~code(x).isin("mL", "g"))
    pick = F.when(F.size(doses) > 0, doses[0]).when(F.size(found) > 0, found[0])
    at = F.instr(c, pick)
    rest = F.concat(F.substring(c, F.lit(1), at - 1), F.substring(c, at + F.length(pick), F.length(c)))
    clean = F.regexp_replace(F.regexp_replace(rest, r"^[ \-,/]+|[ \-,/]+$", ""), r"\s{2,}", " ")
    return F.struct(F.when(pick.isNull() | (clean == ""), c).otherwise(clean).alias("name"), F.regexp_extract(pick, rx, 1).cast("double").alias("value"), code(pick).alias("unit"))


def unit_code(c: Column) -> Column:
    """the code of a unit as written; an unknown one stays as it is, an empty one is null."""
    t = F.trim(c)
    return F.when(F.length(c) > 0, F.coalesce(lookup(F.lower(t), UNIT_CODES), t))


def to_milligrams(value: Column, unit: Column) -> Column:
    """Grams and micrograms in mg."""
    u = F.lower(F.coalesce(unit, F.lit("")))
    return value * F.when(u.isin("g", "gm"), 1000.0).when(u.isin("mcg", "ug", "µg"), 0.001).otherwise(1.0)


def celsius(f: Column) -> Column:
    """F26."""
    return (f - 32) * 5 / 9


def strength_marketed(value: Column, strengths: Column) -> Column:
    """whether a product is made in this strength; null if that is unknown."""
    known = value.isNotNull() & (F.size(strengths) > 0)
    return F.when(known, F.exists(strengths, lambda s: F.abs(value - s) < 1e-6))


def _day(y: Column, m: Column, d: Column) -> Column:
    """The date of year, month and day as texts; two-digit years are 20xx; null if there is no such day."""
    year = F.when(F.length(y) < 3, y.cast("int") + 2000).otherwise(y.cast("int"))
    return F.try_to_date(F.format_string("%04d-%02d-%02d", year, m.cast("int"), d.cast("int")), "yyyy-MM-dd")


def _month(name: Column) -> Column:
    k = F.array_position(F.array(*[F.lit(m) for m in MONTHS]), F.lower(F.substring(name, 1, 3)))
    return F.when(k > 0, k)


def parse_date(c: Column) -> Column:
    """struct(day, precision): year, year-month or day as ISO; 12-Mar-20, 12 March 2020, 12/3/20.  Nulls if it is no date."""
    t = F.trim(c)
    iso, named, plain = r"^(\d{4})(?:-(\d{2}))?(?:-(\d{2}))?$", r"^(\d{1,2})[-/ ]([A-Za-z]{3})[a-z]*[-/ ](\d{2,4})$", r"^(\d{1,2})[-/](\d{1,2})[-/](\d{2,4})$"
    year, month, day = (_got(t, iso, k) for k in (1, 2, 3))
    one = F.lit("1")
    out = F.coalesce(
        _day(year, F.coalesce(month, one), F.coalesce(day, one)), _day(_got(t, named, 3), _month(_got(t, named, 2)), _got(t, named)), _day(_got(t, plain, 3), _got(t, plain, 2), _got(t, plain))
    )
    precision = F.when(year.isNotNull() & month.isNull(), "year").when(year.isNotNull() & day.isNull(), "month").otherwise("day")
    return F.struct(out.alias("day"), F.when(out.isNotNull(), precision).alias("precision"))


def parse_date_text(c: Column) -> Column:
    """a whole date as written, also with dots or spaces; null if it is none."""
    t = F.trim(c)
    iso, named, plain = r"^(\d{4})-(\d{2})-(\d{2})$", r"^(\d{1,2})[-/. ]([A-Za-z]{3})[a-z]*[-/. ](\d{2,4})$", r"^(\d{1,2})[-/. ](\d{1,2})[-/. ](\d{2,4})$"
    return F.coalesce(
        _day(_got(t, iso, 1), _got(t, iso, 2), _got(t, iso, 3)), _day(_got(t, named, 3), _month(_got(t, named, 2)), _got(t, named)), _day(_got(t, plain, 3), _got(t, plain, 2), _got(t, plain))
    )


def age_of_text(c: Column) -> Column:
    """F30 of field checks: whole years; months, weeks or days are 0; null if it is no age."""
    t = F.coalesce(c, F.lit(""))
    years = _got(t, r"(?i)^\s*(\d{1,3})\s*(?:y|yr|yrs|year|years)?\s*$").cast("int")
    return F.coalesce(years, F.when(t.rlike(r"(?i)\d+\s*(m|mo|month|months|d|day|days|w|wk|week|weeks)\b"), 0))


def age_of_identity(c: Column) -> Column:
    """F30 of identities: the first number that stands alone or before years, up to 120; `6m` is 0."""
    t = F.lower(F.trim(c))
    years = _got(t, r"(\d+)\s*(?:y|yr|yrs|year|years)?\b").cast("int")
    return F.coalesce(F.when(years.between(0, 120), years), F.when(t.rlike(r"\d+\s*(?:m|mo|month|months)\b"), 0))


def age_years(born: Column, as_of: Column) -> Column:
    """whole years, months and days borrowed."""
    before = (F.month(as_of) * 100 + F.dayofmonth(as_of)) < (F.month(born) * 100 + F.dayofmonth(born))
    return F.year(as_of) - F.year(born) - before.cast("int")


def follow_up(c: Column) -> Column:
    """F32: struct(kind, low, high, unit, day) of a follow-up as written: a range, an interval, a date, as needed; nulls if none."""
    number, unit = r"(\d+(?:\.\d+)?)", r"(day|days|week|weeks|wk|wks|month|months|mo|year|years)"
    span = rf"(?i){number}\s*(?:-|to)\s*{number}\s*{unit}\b"
    after, later = rf"(?i)(?:after|in|within|next|following)\s+{number}\s*{unit}\b", rf"(?i){number}\s*{unit}\s*(?:later|after)"
    date = parse_date_text(_got(c, r"(\d{1,2}[-/.]\d{1,2}[-/.]\d{2,4}|\d{1,2}[-/. ][A-Za-z]{3}[a-z]*[-/. ]\d{2,4})"))
    is_span, is_after, is_later = c.rlike(span), c.rlike(after), c.rlike(later)
    # Whichever of the two wordings of an interval begins first.
    first = is_after & (~is_later | (F.length(F.regexp_replace(c, rf"{after}(?s:.*)$", "")) <= F.length(F.regexp_replace(c, rf"{later}(?s:.*)$", ""))))
    pick = lambda k, j: F.when(is_span, _got(c, span, k)).when(first, _got(c, after, j)).when(is_later, _got(c, later, j))
    word = F.lower(pick(3, 2))
    as_needed = c.rlike(r"(?i)\b(sos|if needed|when required|if symptoms|if pain persists|as needed)\b")
    interval = is_span | is_after | is_later
    return F.struct(
        F.when(interval, "interval").when(date.isNotNull(), "date").when(as_needed, "as_needed").alias("kind"), pick(1, 1).cast("double").alias("low"), F.when(is_span, _got(c, span, 2)).cast("double").alias("high"),
        F.when(word.startswith("d"), "days").when(word.startswith("w"), "weeks").when(word.startswith("m"), "months").when(word.startswith("y"), "years").alias("unit"), F.when(~interval, date).alias("day"),
    )


def next_date(line: Column) -> Column:
    """F32: the next date or month written on a line (ISO, a day or a month); null if there is none."""
    tail = _got(line, r"(?i)\bnext\s+(?:date|dose|visit|appointment|appt|review|follow[\s-]?up|due)\b[\s:\-]*([^\n]{3,60})")
    day = parse_date_text(_got(tail, r"(\d{1,2}[-/.]\d{1,2}[-/.]\d{2,4}|\d{1,2}[-/. ][A-Za-z]{3}[a-z]*[-/. ]\d{2,4})"))
    rx = r"(?i)\b(jan|feb|mar|apr|may|jun|jul|aug|sep|oct|nov|dec)[a-z]*\.?[\s'’,?]*((?:19|20)\d{2})\b"
    month = F.when(_got(tail, rx).isNotNull(), F.format_string("%s-%02d", _got(tail, rx, 2), _month(_got(tail, rx))))
    return F.coalesce(F.date_format(day, "yyyy-MM-dd"), month)


def preparation(c: Column) -> Column:
    """F32: struct(kind, value, unit) of a preparation note, from its words alone."""
    low = fold(c)
    after = r"(?i)(\d+(?:\.\d+)?)\s*(hours?|hrs?|h|min(?:ute)?s?)\s*(?:after|post)"
    meal = c.rlike(after) & low.rlike("meal|food|lunch|dinner|breakfast|eating")
    fasting = low.rlike(r"\bfasting\b|empty stomach|overnight|nil by mouth|npo|no food")
    hours = _got(c, r"(?i)(\d+(?:\.\d+)?)\s*(?:hours?|hrs?|h)\b").cast("double")
    hold = low.rlike(r"\b(stop|hold|avoid|withhold|do not take|skip)\b.*\b(biotin|metformin|medicine|tablet|insulin|aspirin|drug)")
    kind = (
        F.when(meal, "timing").when(fasting, "fasting").when(hold, "medicine_hold").when(low.rlike("first.?morning|early morning|midstream|clean catch|24.?h(?:ou)?r? urine|collect"), "sample_collection")
        .when(low.rlike("bring|carry|previous report|old report|earlier report"), "bring_documents").when(low.rlike(r"\b(morning|before breakfast|evening|afternoon)\b"), "timing")
        .when(low.rlike(r"\b(diet|avoid fatty|low salt|no alcohol|alcohol)\b"), "diet")
    )
    unit = F.when(meal, F.when(F.lower(_got(c, after, 2)).startswith("h"), "h").otherwise("min")).when(fasting & hours.isNotNull(), "h")
    return F.struct(kind.alias("kind"), F.when(meal, _got(c, after).cast("double")).when(fasting, hours).alias("value"), unit.alias("unit"))


def backoff(base_seconds: int, attempts: Column) -> Column:
    """seconds to wait after so many attempts."""
    return (F.lit(base_seconds) * F.pow(F.lit(2.0), attempts)).cast("long")


def calibrate(conf: Column, partial: Column, blocker: Column, warn: Column) -> Column:
    """Less .3 if partial, at most .5 with a blocker, .9 with a warning, from 0 to 1, three decimals; null is 0."""
    c = F.coalesce(conf, F.lit(0.0)) - F.when(partial, 0.3).otherwise(0.0)
    c = F.when(blocker, F.least(c, F.lit(0.5))).when(warn, F.least(c, F.lit(0.9))).otherwise(c)
    return F.round(F.greatest(F.lit(0.0), F.least(F.lit(1.0), c)), 3)


def gate(conf: Column, blocker: Column, partial: Column, policy_review: Column, n_findings: Column, med_finding: Column) -> Column:
    """auto_accepted, audited (accepted, and drawn from for audits) or in_review."""
    hold = blocker | partial | policy_review | (conf < 0.85) | med_finding
    return F.when(hold, "in_review").when((conf >= 0.985) & (n_findings == 0), "auto_accepted").when(conf >= 0.95, "audited").otherwise("in_review")


def wilson_lower(right: Column, n: Column, z: float = 1.96) -> Column:
    """lower bound of a share; 0 for n <= 0."""
    p, m = right / n, n.cast("double")
    low = (p + z * z / (2 * m) - z * F.sqrt(p * (1 - p) / m + z * z / (4 * m * m))) / (1 + z * z / m)
    return F.when(n > 0, F.greatest(F.lit(0.0), low)).otherwise(0.0)


def vital_name(c: Column) -> Column:
    """The name of a vital sign."""
    raw = F.replace(F.lower(F.trim(c)), F.lit(" "), F.lit("_"))
    return F.coalesce(lookup(raw, VITAL_NAMES), raw)


def pressure(c: Column) -> Column:
    """struct(systolic, diastolic) of 120/80; nulls if it is no pair."""
    rx = r"^\s*(\d+(?:\.\d+)?)\s*/\s*(\d+(?:\.\d+)?)"
    return F.struct(_got(c, rx).cast("double").alias("systolic"), _got(c, rx, 2).cast("double").alias("diastolic"))


def coded_text(c: Column) -> Column:
    """The text of a coded value written as JSON: a text, or an object's text, code, display or name; else empty."""
    v = F.try_parse_json(c)
    parts = [F.nullif(F.try_variant_get(v, f"$.{k}", "string"), F.lit("")) for k in ("text", "code", "display", "name")]
    return F.coalesce(F.when(F.schema_of_variant(v).startswith("OBJECT"), F.coalesce(*parts)).when(F.schema_of_variant(v) == "STRING", F.try_variant_get(v, "$", "string")), F.lit(""))


def squeezed(c: Column) -> Column:
    """a correction's value: single spaces, at most 300 characters."""
    return F.substring(squeeze(F.coalesce(c, F.lit(""))), 1, 300)
