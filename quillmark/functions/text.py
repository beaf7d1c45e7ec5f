"""Text normalisers as column expressions (F1-F11, F17-F19, P24, P25, P29, S12, S24, Z18-Z21).  Each is a different function."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Wordings that address a model.
INJECTION = (
    r"ignore\s+(all\s+|any\s+|the\s+|your\s+)?(previous|prior|above|earlier)\s+(instructions?|prompts?)"
    r"|disregard\s+(the\s+|all\s+|your\s+)?(previous|above|prior|instructions?)"
    r"|forget\s+(everything|all)\s+(above|previous)|system\s+prompt|you\s+are\s+now\b"
    r"|reveal\s+(the\s+|your\s+)?(prompt|instructions?)|list\s+all\s+patients|new\s+instructions\s*:"
)
#: Titles that stand before a person's name.
TITLES = "mr|mrs|ms|miss|master|baby|dr|smt|shri|sri|sh|late"
#: Degrees after a doctor's name.
DEGREES = "mbbs|md|ms|dnb|frcs|mrcp|dm|mch|dgo|dch|do|bds|mds"
#: Words of organisations.
ORGANISATIONS = (
    "limited|ltd|pvt|private|hospital|hospitals|clinic|clinics|centre|center|health|healthcare|lifestyle|diagnostic|diagnostics|pharmacy|medical|"
    "laboratory|laboratories|nursing|polyclinic|institute|foundation|trust|corporation|enterprises|company"
)
#: Letters that look like digits, and the digits.
LOOKALIKE, DIGITS = "OoDQlI|iSsBZz", "0000111155822"
#: Words of a drug's form.
FORM_WORDS = ("tab", "tab.", "tabs", "cap", "cap.", "caps", "tablet", "capsule", "syp", "syrup", "inj", "inj.", "injection", "susp", "cream", "oint", "gel", "drop", "drops", "t.", "c.", "mg")


def fold(c: Column) -> Column:
    """Lower case, sharp s as ss."""
    return F.replace(F.lower(c), F.lit("ß"), F.lit("ss"))


def squeeze(c: Column) -> Column:
    """Runs of white space as one space, none at the ends."""
    return F.trim(F.regexp_replace(c, r"\s+", " "))


def key_alnum(c: Column) -> Column:
    """lower case, ASCII letters and digits only."""
    return F.regexp_replace(F.lower(c), "[^0-9a-z]", "")


def words_only(c: Column) -> Column:
    """lower case, everything else one space, trimmed."""
    return F.trim(F.regexp_replace(F.lower(c), "[^0-9a-z]+", " "))


def numeric_context(c: Column) -> Column:
    """in tokens that are mostly digits, letters that look like digits become digits; a unit may be glued on.  Lower case."""
    rx = r"^([0-9OoDQlI|iSsBZz.,/\-½]+)([a-zA-Z%µ/]*)$"

    def one(tok: Column) -> Column:
        number = F.regexp_extract(tok, rx, 1)
        core = F.regexp_replace(number, r"[.,/\-x×]", "")
        n = F.length(F.regexp_replace(core, "[^0-9]", ""))
        return F.when((n >= 1) & (2 * n >= F.length(core)), F.concat(F.translate(number, LOOKALIKE, DIGITS), F.regexp_extract(tok, rx, 2))).otherwise(tok)

    return fold(F.array_join(F.transform(F.regexp_extract_all(F.coalesce(c, F.lit("")), F.lit(r"(\S+)"), F.lit(1)), one), " "))


def numbers_repaired(c: Column) -> Column:
    """F11 after F10: numbers as an array; these must match exactly."""
    return F.regexp_extract_all(numeric_context(c), F.lit(r"(\d+(?:\.\d+)?(?:/\d+)?|½)"), F.lit(1))


def alias_key(c: Column) -> Column:
    """numbers repaired, glued units and digits split, form words and mg left out."""
    t = F.regexp_replace(numeric_context(c), r"(\d)\s*(mg|mcg|g|ml|iu)\b", "$1 $2")
    t = F.regexp_replace(F.regexp_replace(t, r"([a-z])(\d)", "$1 $2"), r"(?U)[^\w½%/. ]", " ")
    return F.array_join(F.filter(F.split(squeeze(t), " "), lambda x: ~x.isin(*FORM_WORDS)), " ")


def lab_text(c: Column) -> Column:
    """lower case, `hbalc` and `hba lc` repaired; keeps word characters, percent, slash, dot, dash."""
    low = F.replace(F.replace(F.lower(F.trim(c)), F.lit("hbalc"), F.lit("hba1c")), F.lit("hba lc"), F.lit("hba1c"))
    return squeeze(F.regexp_replace(low, r"(?U)[^\w%/.\- ]", " "))


def person_key(c: Column) -> Column:
    """letters, spaces, apostrophes, hyphens; others become a space."""
    return squeeze(F.regexp_replace(F.lower(c), r"[^a-z\s'-]", " "))


def person_key_strict(c: Column) -> Column:
    """one leading title goes, other characters are deleted, not replaced."""
    return squeeze(F.regexp_replace(fold(F.regexp_replace(F.trim(c), rf"(?i)^(?:{TITLES})\b\.?\s*", "")), "[^a-z ]", ""))


def doctor_key(c: Column) -> Column:
    """F8: everything from the first degree on, bracketed parts and titles cut; letters only."""
    t = F.regexp_replace(F.regexp_replace(c, rf"(?i)\b(?:{DEGREES})\b.*$", ""), r"\(.*?\)", " ")
    return squeeze(F.regexp_replace(fold(F.regexp_replace(t, r"(?i)\b(?:dr|doctor|prof|mr|mrs|ms)\b\.?", " ")), "[^a-z ]", " "))


def reading_key(c: Column) -> Column:
    """F9, of readings: numbers repaired; word characters, half, percent, slash, dot, dash."""
    return squeeze(F.regexp_replace(numeric_context(c), r"(?U)[^\w½%/.\- ]", " "))


def compact(c: Column) -> Column:
    """F9, of page text: without white space, dashes, dots, brackets, slashes, commas, colons; folded."""
    return fold(F.regexp_replace(c, r"[\s\-.()/,:]", ""))


def line_key(c: Column) -> Column:
    """F9, of lines: folded, single spaces."""
    return squeeze(fold(c))


def collapse_runs(c: Column) -> Column:
    """lines of punctuation only become empty; four spaced question marks or more become one, six like characters or more three."""
    t = F.trim(F.coalesce(c, F.lit("")))
    short = F.trim(F.regexp_replace(F.regexp_replace(t, r"(?:\s*\?){4,}", " ?"), r"(.)\1{5,}", "$1$1$1"))
    return F.when(t.rlike("[0-9A-Za-z]"), short).otherwise("")


def numbers(c: Column) -> Column:
    """literal numbers in order, as an array of strings."""
    return F.regexp_extract_all(c, F.lit(r"([0-9]+(?:\.[0-9]+)?)"), F.lit(1))


def injection_suspect(c: Column) -> Column:
    """P25: a line that addresses a model."""
    return F.coalesce(F.lower(c).rlike(INJECTION), F.lit(False))


def organisation_like(c: Column) -> Column:
    """a company's or hospital's name, never a patient's."""
    return F.coalesce(F.lower(c).rlike(rf"\b(?:{ORGANISATIONS})\b"), F.lit(False))


def phone_digits(c: Column) -> Column:
    """Ten digits after an optional country code or zero; null if no valid mobile number."""
    d = F.regexp_replace(F.regexp_replace(c, "[^0-9]", ""), "^(?:0|91)(?=[0-9]{10}$)", "")
    return F.when(d.rlike("^[6-9][0-9]{9}$"), d)


def health_id(c: Column) -> Column:
    """Fourteen digits written 2-4-4-4; null otherwise."""
    d = F.regexp_replace(c, "[^0-9]", "")
    return F.when(F.length(d) == 14, F.concat_ws("-", F.substring(d, 1, 2), F.substring(d, 3, 4), F.substring(d, 7, 4), F.substring(d, 11, 4)))


def sex_code(c: Column) -> Column:
    """M, F or O from the usual spellings."""
    k = F.lower(F.trim(c))
    return F.when(k.isin("m", "male", "boy", "man"), "M").when(k.isin("f", "female", "girl", "woman"), "F").when(k.isin("o", "other", "t", "transgender"), "O")


def registration_numbers(c: Column) -> Column:
    """Registration numbers written in a text, letters and digits, upper case."""
    rx = r"(?i)(?:reg(?:istration)?\.?\s*(?:no|number|#)?\.?\s*[:\-]?\s*)([A-Z]{0,4}[-/ ]?\d{3,7})"
    return F.transform(F.regexp_extract_all(F.coalesce(c, F.lit("")), F.lit(rx), F.lit(1)), lambda x: F.upper(F.regexp_replace(x, "[^0-9A-Za-z]", "")))


def first_word(c: Column) -> Column:
    """The first word of three letters after a form prefix, folded."""
    rest = F.regexp_replace(F.coalesce(c, F.lit("")), r"(?i)^\s*(?:inj|in|tab|t|cap|c|syp|sy|syr|susp|oint|cream|gel|drops?|rx)\b[\s.:\-]*", "")
    return fold(F.regexp_extract(rest, "[A-Za-z]{3,}", 0))


def ignore_reason(name: Column) -> Column:
    """Why a file of a watched folder is left alone; null if it isn't."""
    low = F.lower(name)
    return (
        F.when(low.rlike(r"\.(part|tmp|crdownload)$") | low.startswith("~$") | low.startswith("."), "temporary or hidden file")
        .when(low.rlike(r"\.(error\.txt|json|log)$"), "note or data file, not a prescription")
        .when(~low.rlike(r"\.(pdf|png|jpe?g|tiff?)$"), "file type not allowed")
    )


def mime_of(content: Column) -> Column:
    """Media type by the first bytes."""
    h = F.hex(F.substring(content, 1, 12))
    return (
        F.when(h.startswith("25504446"), "application/pdf").when(h.startswith("89504E470D0A1A0A"), "image/png").when(h.startswith("FFD8FF"), "image/jpeg")
        .when(h.startswith("49492A00") | h.startswith("4D4D002A"), "image/tiff").when(h.startswith("52494646") & (F.substring(h, 17, 8) == "57454250"), "image/webp").otherwise("application/octet-stream")
    )


#: Wordings of failures that may pass, and of files that are at fault.
TRANSIENT = ("timeout", "timed out", "connection", "503", "429", "temporarily", "unavailable")
DATA_FAULT = ("no objects found", "format error", "corrupt", "decode", "unsupported", "truncated")


def error_class(kind: Column, message: Column) -> Column:
    """Data (the file is at fault, never tried again), transient or code."""
    low = F.lower(F.coalesce(message, F.lit("")))
    has = lambda words: F.exists(F.array(*[F.lit(w) for w in words]), lambda w: low.contains(w))
    return (
        F.when(kind.isin("DataError", "PdfiumError", "UnidentifiedImageError"), "data").when(kind.isin("TimeoutError", "ConnectionError") | has(TRANSIENT), "transient")
        .when(has(DATA_FAULT), "data").when(kind == "OSError", "transient").otherwise("code")
    )


def scrub(message: Column, limit: int = 300) -> Column:
    """what stands in quotes is blanked; reasons stay."""
    one = F.regexp_replace(F.regexp_replace(message, r'"[^"]{1,400}"', '"..."'), r"'[^']{1,400}'", "'...'")
    return F.substring(one, 1, limit)


def test_key(c: Column) -> Column:
    """Spellings of one written test share a key: the specimen goes, letters and digits stay."""
    return F.regexp_replace(F.regexp_replace(fold(F.coalesce(c, F.lit(""))), r"^\s*(?:s|serum)[\s.]+", ""), "[^a-z0-9]", "")


def parse_name(c: Column) -> Column:
    """struct(given, family, full): stacked titles stripped, words capitalised; nulls if nothing is left."""
    bare = F.regexp_replace(F.trim(c), r"(?i)^(?:\s*(?:mr|mrs|ms|miss|master|dr|smt|shri|sri|baby|b/o|s/o|d/o|w/o|c/o)\.?\s+)+", "")
    full = F.initcap(squeeze(F.regexp_replace(bare, r"(?i)[^a-z\s'-]", " ")))
    words = F.split(full, " ")
    some = full != ""
    return F.struct(
        F.when(some, words[0]).alias("given"), F.when(some & (F.size(words) > 1), F.array_join(F.slice(words, 2, 99), " ")).alias("family"), F.when(some, full).alias("full")
    )
