"""Geometry of blocks on a page (J10, J11, J14, F16, F43, Z7): boxes are x0, y0, x1, y1."""

from __future__ import annotations

import re
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quillmark.functions.clinical import lookup

BOX = ("x0", "y0", "x1", "y1")


def pairs(blocks: DataFrame, page: str, key: str) -> DataFrame:
    """Ordered pairs of blocks of one page as a_* and b_*; a page has few blocks, so pairs within it are few."""
    own = blocks.select(page, key, *BOX)
    a, b = (own.withColumnsRenamed({c: f"{s}_{c}" for c in (key, *BOX)}) for s in "ab")
    return a.join(b, page).where(F.col(f"a_{key}") != F.col(f"b_{key}"))


def overlap_area() -> Column:
    side = lambda lo, hi: F.greatest(F.lit(0), F.least(f"a_{hi}", f"b_{hi}") - F.greatest(f"a_{lo}", f"b_{lo}"))
    return side("x0", "x1") * side("y0", "y1")


def inside(blocks: DataFrame, page: str, key: str, share: float) -> DataFrame:
    """(inner_id, outer_id) where at least `share` of the inner box is covered."""
    area = (F.col("a_x1") - F.col("a_x0")) * (F.col("a_y1") - F.col("a_y0"))
    return pairs(blocks, page, key).where(overlap_area() >= share * area).select(F.col(f"a_{key}").alias("inner_id"), F.col(f"b_{key}").alias("outer_id"))


def near(blocks: DataFrame, page: str, key: str) -> DataFrame:
    """Links (a, b) of blocks within 1.6 line heights of each other down and 3 across; boxes over 3 line heights link nothing.

    The line height is the median of the page's, from 12 to 60."""
    height = blocks.groupBy(page).agg(F.least(F.lit(60.0), F.greatest(F.lit(12.0), F.median(F.col("y1") - F.col("y0")))).alias("h"))
    down = F.abs((F.col("a_y0") + F.col("a_y1")) - (F.col("b_y0") + F.col("b_y1"))) / 2
    across = F.greatest(F.lit(0), F.greatest("a_x0", "b_x0") - F.least("a_x1", "b_x1"))
    tall = F.greatest(F.col("a_y1") - F.col("a_y0"), F.col("b_y1") - F.col("b_y0")) > 3 * F.col("h")
    j = pairs(blocks, page, key).join(height, page)
    return j.where(~tall & (down <= 1.6 * F.col("h")) & (across <= 3 * F.col("h"))).select(F.col(f"a_{key}").alias("a"), F.col(f"b_{key}").alias("b"))


def mapped_box(box: Column, matrix: Column) -> Column:
    """the box around the corners of a box under a homogeneous 3 x 3 matrix (nine numbers by rows)."""
    m = lambda k: F.element_at(matrix, k + 1)
    corners = F.array(*[F.struct(F.element_at(box, x).alias("x"), F.element_at(box, y).alias("y")) for x, y in ((1, 2), (3, 2), (3, 4), (1, 4))])
    w = lambda p: m(6) * p.x + m(7) * p.y + m(8)

    def row(r: int) -> Column:
        return F.transform(corners, lambda p: (m(r) * p.x + m(r + 1) * p.y + m(r + 2)) / w(p))

    xs, ys = row(0), row(3)
    return F.array(F.array_min(xs), F.array_min(ys), F.array_max(xs), F.array_max(ys))


def context_link(rows: DataFrame, test_lines: Column, reason_lines: Column, pages: dict[str, int]) -> DataFrame:
    """Adds relation and quote: same_line with the first line that both rest on, else same_page, else null; unknown lines don't count."""
    known = lambda c: F.filter(c, lambda x: x.isin(*pages))
    t, r = known(test_lines), known(reason_lines)
    page = lambda c: F.transform(c, lambda x: lookup(x, pages))
    shared = F.array_intersect(t, r)
    relation = F.when(F.size(shared) > 0, "same_line").when(F.arrays_overlap(page(t), page(r)), "same_page")
    return rows.withColumns({"relation": relation, "quote": F.when(F.size(shared) > 0, shared[0])})


#: Words after a doctor's name that are none; words of a clinic's name; where contact details begin.
NO_NAMES = frozenset("mob ph phone reg regd contact contacts tel consultant senior clinic hospital mbbs timing timings".split())
CLINIC = r"(?i)hospitals?|clinics?|healthcare|health\s*care|polyclinic|diagnostics?|nursing\s*home|medical\s*cent(?:re|er)|centre|center|institute|laborator(?:y|ies)|pharmacy"
CONTACT = r"(?i)\b(?:mob|ph|phone|contacts?|tel|reg|regd)\b\.?:?.*$|[+\d].*$"


def doctor_of(line: str) -> str | None:
    """F16: up to four words that look like names behind Dr, with the titles written out."""
    m = re.search(r"(Prof\.?\s*)?\(?\s*Dr\s*\.?\s*\)?\s*(?=[A-Z])", line)
    names: list[str] = []
    for word in line[m.end() :].split()[:4] if m else ():
        bare = word.strip(",;:|")
        if bare.rstrip(".").casefold() in NO_NAMES or not re.fullmatch(r"[A-Z](?:[a-z]+\.?|\.)", bare):
            break
        names.append(bare)
    return " ".join([*(["Prof."] if m[1] else []), "Dr.", *names]) if names else None


def clinic_of(line: str) -> str | None:
    """F16: two to four plain words that end at the line's only word of organisations (or the second of two that belong together)."""
    t = re.sub(CONTACT, "", line).strip()
    at = [] if "|" in line else list(re.finditer(CLINIC, t))
    if len(at) == 2 and at[1].start() - at[0].end() <= 12:
        del at[0]
    if len(at) != 1:
        return None
    words = f"{t[: at[0].start()]} {at[0][0]}".split()
    fine = 2 <= len(words) <= 4 and all(re.fullmatch(r"[A-Za-z&.'\-]+", w) for w in words) and sum(map(str.isalpha, "".join(words))) >= 5
    return " ".join(words) if fine else None


def header(lines: Sequence[str] | None) -> dict:
    """F16: the first doctor and clinic named in the upper 35 % of a page's lines (one line at least)."""
    top = list(lines if lines is not None else [])
    top = top[: max(1, round(0.35 * len(top)))]
    return {"doctor": next(filter(None, map(doctor_of, top)), None), "clinic": next(filter(None, map(clinic_of, top)), None)}
