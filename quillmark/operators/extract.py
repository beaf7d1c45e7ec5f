"""From payloads to facts, visits, records and bundles.

A payload is a JSON text per document; a broken one gives no rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from quillmark.functions import clinical as C
from quillmark.functions import linkage as L
from quillmark.functions import orders as O


def items(v: Column, path: str) -> Column:
    """The items of a list in a variant; none if it is missing or no list."""
    return F.coalesce(F.try_variant_get(v, path, "array<variant>"), F.array().cast("array<variant>"))


def text(v: Column, *keys: str) -> Column:
    """The first non-empty text of an item's keys; a plain text is its own."""
    parts = [F.nullif(F.try_variant_get(v, f"$.{k}", "string"), F.lit("")) for k in keys or ("text", "code", "display", "name")]
    plain = F.when(F.schema_of_variant(v) == "STRING", F.nullif(F.try_variant_get(v, "$", "string"), F.lit("")))
    return F.coalesce(*parts, plain)


def _fact(kind: str, name: Column, value: Column | None = None, unit: Column | None = None, note: Column | None = None, day: Column | None = None) -> Column:
    null = F.lit(None)
    return F.struct(
        F.lit(kind).alias("fact_type"), name.alias("local_text"), (null.cast("double") if value is None else value).alias("value_num"), (null.cast("string") if unit is None else unit).alias("unit"),
        (null.cast("string") if note is None else note).alias("value_text"), (null.cast("date") if day is None else day).alias("effective_on"),
    )


def _each(v: Column, path: str, make) -> Column:
    return F.transform(items(v, path), make)


def facts_of(docs: DataFrame, doc: str = "document_id", kind: str = "doc_type", payload: str = "payload") -> DataFrame:
    """A row per fact of each payload, by document type: (document, fact_type, local_text, value_num, unit, value_text, effective_on).

    One pass without a shuffle: every list becomes facts by an expression; entries of tests, medicines and advice are
    filed by what they are, and vital signs are read, in Arrow batches."""
    p = docs.select(F.col(doc), F.col(kind).alias("kind_"), F.try_parse_json(payload).alias("p_")).where("p_ is not null")
    v = F.col("p_")
    texts = lambda path: F.transform(items(v, path), lambda x: text(x, "drug_text", "text", "code", "display", "name"))
    vitals = F.try_variant_get(v, "$.vitals", "array<struct<name:string,value:string,unit:string,systolic:string,diastolic:string>>")
    filed = L.over(O.file_entries, "tests array<string>, medicines array<string>, advice array<string>")(texts("$.investigations"), texts("$.advice"), F.concat(texts("$.medications"), texts("$.medications_on_discharge")))
    own = p.withColumns({"filed_": filed, "vitals_": L.over(O.vital_values, "array<struct<name:string,value:double,unit:string>>")(vitals)})
    orders = F.col("kind_").isin("prescription", "opd_note")
    date = lambda *paths: C.parse_date(F.coalesce(*[F.try_variant_get(v, x, "string") for x in paths])).day
    lists = [
        F.when(F.col("kind_").isin("prescription", "opd_note", "discharge", "radiology"), _each(v, "$.diagnoses", lambda x: _fact("condition", text(x), day=F.when(F.col("kind_") == "discharge", date("$.admission_date")).when(F.col("kind_") == "radiology", date("$.study_date"))))),
        F.when(orders | (F.col("kind_") == "discharge"), F.transform("filed_.medicines", lambda x: _fact("medication", C.strength(x).getField("name"), C.strength(x).value, C.strength(x).unit))),
        F.when(orders, F.transform("filed_.tests", lambda x: _fact("investigation_order", x, note=x))), F.when(orders, F.transform("filed_.advice", lambda x: _fact("advice", x, note=x))),
        F.when(orders | (F.col("kind_") == "vitals"), F.transform("vitals_", lambda x: _fact("vital_sign", F.replace(x["name"], F.lit("_"), F.lit(" ")), x.value, x.unit))),
        F.when(F.col("kind_") == "vitals", F.concat(_each(v, "$.symptoms", lambda x: _fact("symptom", text(x))), _each(v, "$.allergies", lambda x: _fact("allergy", text(x, "substance_text", "text", "name"), note=F.try_variant_get(x, "$.reaction_text", "string"))))),
        F.when(F.col("kind_") == "lab_report", _each(v, "$.results", lambda x: _fact("lab_result", text(x, "analyte_text", "text"), C.quantity(F.to_json(F.try_variant_get(x, "$.value", "variant"))).value, F.coalesce(C.quantity(F.to_json(F.try_variant_get(x, "$.value", "variant"))).unit, F.try_variant_get(x, "$.unit", "string")), F.try_variant_get(x, "$.value_text", "string"), date("$.reported_at", "$.collected_at")))),
        F.when(F.col("kind_") == "discharge", _each(v, "$.procedures", lambda x: _fact("procedure", text(x, "name", "text"), note=F.try_variant_get(x, "$.findings", "string"), day=C.parse_date(F.try_variant_get(x, "$.date", "string")).day))),
        F.when(F.col("kind_") == "radiology", F.concat(F.array(_fact("diagnostic_report", F.coalesce(*[F.nullif(F.try_variant_get(v, f"$.{k}", "string"), F.lit("")) for k in ("study_name", "procedure_name", "modality")], F.lit("Imaging study")), note=F.nullif(F.concat_ws(" | ", F.try_variant_get(v, "$.impression", "string"), F.try_variant_get(v, "$.findings", "string")), F.lit("")), day=date("$.study_date"))), _each(v, "$.findings_list", lambda x: _fact("finding", text(x), day=date("$.study_date"))))),
    ]
    empty = F.filter(F.array(_fact("", F.lit(""))), lambda x: F.lit(False))
    rows = own.select(doc, F.posexplode(F.concat(*[F.coalesce(x, empty) for x in lists])).alias("fact_no", "f"))
    return rows.select(doc, F.col("fact_no").cast("long").alias("fact_no"), "f.*").where("local_text is not null and local_text <> ''")


def entries_of(pages: DataFrame, doc: str = "document_id", page: str = "page_no", payload: str = "payload") -> DataFrame:
    """Dated entries of each page in order, its main one first: (document, page, entry_no, date_text, day, tests, follow_up)."""
    p = pages.select(doc, page, F.try_parse_json(payload).alias("p_")).where("p_ is not null")
    v = F.col("p_")

    def entry(x: Column, date: str) -> Column:
        follow = F.coalesce(F.try_variant_get(x, "$.follow_up.text", "string"), F.when(F.schema_of_variant(F.try_variant_get(x, "$.follow_up", "variant")) == "STRING", F.try_variant_get(x, "$.follow_up", "string")))
        said = F.when(~F.lower(F.trim(follow)).isin("", "none", "null", "nil", "n/a", "na", "-", "--", "not written", "not mentioned"), F.trim(follow))
        return F.struct(F.try_variant_get(x, date, "string").alias("date_text"), F.transform(items(x, "$.investigations"), lambda i: text(i)).alias("tests"), said.alias("follow_up"))

    other = F.filter(F.transform(items(v, "$.earlier_entries"), lambda e: entry(e, "$.date_text")), lambda e: e.date_text.isNotNull() | e.follow_up.isNotNull() | (F.size(e.tests) > 0))
    rows = p.select(doc, page, F.posexplode(F.concat(F.array(entry(v, "$.encounter_date")), other)).alias("entry_no", "e")).select(doc, page, "entry_no", "e.*")
    return rows.withColumn("day", C.parse_date(F.col("date_text")).day)


IDENTITY = ("name", "phone", "sex", "mrn")


def merge_visits(pages: DataFrame, doc: str = "document_id", page: str = "page_no", payload: str = "payload") -> DataFrame:
    """Of each document the latest dated entry (undated ones never beat dated ones, ties go to the earlier), how many
    entries, and who it is: the first page that says it, field by field."""
    e = entries_of(pages, doc, page, payload)
    rank = F.row_number().over(Window.partitionBy(doc).orderBy(F.desc_nulls_last("day"), page, "entry_no"))
    n = F.count("*").over(Window.partitionBy(doc))
    latest = e.withColumn("n_entries", n).withColumn("r_", rank).where("r_ = 1").select(doc, F.col(page).alias("latest_page"), "day", "date_text", F.array_join("tests", "; ").alias("tests"), "follow_up", "n_entries")
    v = F.try_parse_json(payload)
    said = [F.nullif(F.try_variant_get(v, f"$.patient.{k}", "string"), F.lit("")).alias(k) for k in IDENTITY]
    who = pages.select(doc, page, *said).groupBy(doc).agg(*[F.min_by(F.col(k), F.when(F.col(k).isNotNull(), F.col(page))).alias(k) for k in IDENTITY])
    return latest.join(who, doc, "left")


def project(v: Column, path: str) -> Column:
    """A path of a record as text: dots, lists with [*], and |join: for the texts of a list; a list without join is JSON."""
    path, _, pipe = path.partition("|")
    head, star, rest = path.partition("[*]")
    if not star:
        return F.try_variant_get(v, f"$.{head}", "string")
    inner = rest.lstrip(".")
    values = F.transform(items(v, f"$.{head}"), lambda x: F.try_variant_get(x, f"$.{inner}" if inner else "$", "string"))
    if pipe.startswith("join:"):
        return F.array_join(F.filter(values, lambda x: x.isNotNull() & (x != "")), pipe[len("join:") :])
    return F.to_json(values)


def mapped(records: DataFrame, record: str, fields: dict[str, str]) -> DataFrame:
    """Adds payload, the JSON of the mapped fields in order, without empty ones (P31), and its key."""
    v = F.try_parse_json(record)
    body = F.to_json(F.struct(*[F.nullif(project(v, p), F.lit("")).alias(k) for k, p in fields.items()]))
    return records.withColumn("payload", body).withColumn("payload_key", F.substring(F.sha2("payload", 256), 1, 16))


def pruned(c: Column) -> Column:
    """JSON without nulls, empty texts and empty lists at its first level."""
    m = F.from_json(c, "map<string,string>")
    return F.to_json(F.map_filter(m, lambda k, v: v.isNotNull() & ~v.isin("", "[]", "{}")))


RESOURCES = {"condition": "Condition", "lab_result": "Observation", "vital_sign": "Observation", "medication": "MedicationRequest", "procedure": "Procedure", "allergy": "AllergyIntolerance", "investigation_order": "ServiceRequest"}


def resources(facts: DataFrame) -> DataFrame:
    """A resource of each governed fact: (document_id, full_url, resource), JSON with fields in order and without nulls; urls are
    hashes of the fact, so a second run makes the same bundle."""
    kind = C.lookup(F.col("fact_type"), RESOURCES)
    url = lambda c: F.concat(F.lit("urn:uuid:"), F.substring(F.sha2(c.cast("string"), 256), 1, 32))
    body = F.struct(
        kind.alias("resourceType"), F.struct(url(F.concat(F.lit("patient-"), F.col("patient_id"))).alias("reference")).alias("subject"), F.struct(F.col("code").alias("code")).alias("code"),
        F.when(F.col("value_num").isNotNull(), F.struct(F.col("value_num").alias("value"), F.col("unit").alias("unit"))).alias("valueQuantity"), F.date_format("effective_on", "yyyy-MM-dd").alias("effectiveDateTime"),
    )
    return facts.where(kind.isNotNull()).select("document_id", "fact_id", url(F.concat(F.lit("fact-"), F.col("fact_id"))).alias("full_url"), F.to_json(body).alias("resource"))


def bundles(parts: DataFrame) -> DataFrame:
    """One bundle per document, entries in the order of facts."""
    entry = F.struct("fact_id", "full_url", "resource")
    own = F.transform(F.array_sort(F.collect_list(entry)), lambda e: F.concat(F.lit('{"fullUrl":"'), e.full_url, F.lit('","resource":'), e.resource, F.lit("}")))
    return parts.groupBy("document_id").agg(F.concat(F.lit('{"resourceType":"Bundle","type":"document","entry":['), F.array_join(own, ","), F.lit("]}")).alias("bundle"), F.count("*").alias("n_entries"))


def dangling(parts: DataFrame, given: DataFrame) -> DataFrame:
    """References of a document's resources to urls that neither its entries nor `given` (document_id, full_url) have."""
    refs = parts.select("document_id", F.explode(F.regexp_extract_all("resource", F.lit('"reference":"([^"]+)"'), F.lit(1))).alias("ref")).distinct()
    urls = parts.select("document_id", F.col("full_url").alias("ref")).unionByName(given.select("document_id", F.col("full_url").alias("ref")))
    return refs.join(urls, ["document_id", "ref"], "left_anti")
