"""Synthetic messages from templates, repeatable by seed.

A template is compiled to one expression over ``spark.range``: every value is a function of seed, row and
path, so partitions can be made again in any order.
"""

from __future__ import annotations

from typing import Any

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.text import escape, sha256

#: Word lists for made-up values.
LAST = ("Arden", "Bellamy", "Corwin", "Dunmore", "Ellery", "Farrow", "Garland", "Hollis", "Ives", "Jarrow", "Kestrel", "Lorne")
FIRST = {"F": ("Ada", "Bea", "Cora", "Dina", "Elsa", "Fern", "Gwen"), "M": ("Abel", "Boris", "Cyril", "Dov", "Emil", "Felix", "Gus")}
STREETS = ("Mill Lane", "High Street", "Harbour Road", "Orchard Way", "Station Road")
CITIES = ("Ashford", "Brookfield", "Clearwater", "Dunhaven", "Eastbrook")
CODES = {
    "icd10": ("I10", "E11.9", "J45.909", "M54.5", "N39.0", "K21.9"),
    "loinc": ("2345-7", "718-7", "4548-4", "2160-0", "6690-2"),
    "medication": ("Metformin", "Lisinopril", "Atorvastatin", "Amoxicillin", "Albuterol"),
    "allergen": ("Penicillin", "Peanut", "Latex", "Pollen", "Shellfish"),
    "blood_type": ("A+", "A-", "B+", "B-", "AB+", "AB-", "O+", "O-"),
    "ethnicity": ("H", "N", "U"),
    "race": ("1002-5", "2028-9", "2054-5", "2076-8", "2106-3"),
}
ERRORS = ("invalid_segment_id", "invalid_field_format", "invalid_rep_format", "invalid_comp_format", "invalid_subcomp_format", "duplicate_delims", "bad_delim_length")


class TemplateError(ValueError):
    pass


class Maker:
    """Columns of made-up values: each is drawn from a hash of seed, row and a name."""

    def __init__(self, seed: int, row: Column):
        self.seed, self.row = seed, row

    def draw(self, name: str) -> Column:
        return F.xxhash64(F.lit(self.seed), self.row, F.lit(name))

    def below(self, name: str, n: int) -> Column:
        return F.pmod(self.draw(name), F.lit(n))

    def pick(self, name: str, options: tuple[str, ...] | list[str]) -> Column:
        return F.element_at(F.array(*[F.lit(str(o)) for o in options]), (self.below(name, len(options)) + 1).cast("int"))

    def digits(self, name: str, n: int) -> Column:
        return F.lpad(self.below(name, 10**n).cast("string"), n, "0")

    def uniform(self, name: str) -> Column:
        return (F.pmod(self.draw(name), F.lit(1 << 52)).cast("double") + 0.5) / float(1 << 52)

    def value(self, source: dict[str, Any] | str, name: str) -> Column:
        """The value of one source; an unknown type, or one that injects an error, raises TemplateError."""
        kind, given = (source, None) if isinstance(source, str) else (source.get("type"), source.get("value"))
        key = (kind or "").lower().replace("realistic_", "").replace("realistic", "").replace("_", "")
        g = given if isinstance(given, dict) else {}
        if key == "fixed":
            return F.lit(str(given))
        if key == "from":
            return self.pick(name, given)
        if key == "map":
            return self.pick(name, list(given.values()))
        if key == "numeric":
            return self.digits(name, int(g.get("digits", given if isinstance(given, int) else 6)))
        if key == "date":
            span = F.date_diff(F.to_date(F.lit(g["end"]), "yyyyMMdd"), F.to_date(F.lit(g["start"]), "yyyyMMdd"))
            return F.date_format(F.date_add(F.to_date(F.lit(g["start"]), "yyyyMMdd"), F.pmod(self.draw(name), (span + 1).cast("bigint")).cast("int")), "yyyyMMdd")
        if key == "gaussian":
            normal = F.sqrt(-2 * F.log(self.uniform(f"{name}/u"))) * F.cos(2 * F.pi() * self.uniform(f"{name}/v"))
            return F.format_string(f"%.{int(g.get('precision', 2))}f", F.lit(float(g.get("mean", 0))) + F.lit(float(g.get("sd", 1))) * normal)
        if key == "uuidv4":
            h = F.md5(F.concat(self.draw(f"{name}/a").cast("string"), F.lit("/"), self.draw(f"{name}/b").cast("string")))
            return F.concat_ws("-", F.substring(h, 1, 8), F.substring(h, 9, 4), F.concat(F.lit("4"), F.substring(h, 14, 3)), F.concat(F.lit("8"), F.substring(h, 18, 3)), F.substring(h, 21, 12))
        if key == "dtmnowutc":
            return F.date_format(F.current_timestamp(), "yyyyMMddHHmmss")
        if key == "name":
            sex = str(g.get("gender") or "").upper()
            return F.concat(self.pick(f"{name}/last", LAST), F.lit("^"), self.pick(f"{name}/first", FIRST.get(sex, FIRST["F"] + FIRST["M"])))
        if key == "address":
            return F.concat((self.below(f"{name}/n", 9999) + 1).cast("string"), F.lit(" "), self.pick(f"{name}/s", STREETS), F.lit("^^"), self.pick(f"{name}/c", CITIES), F.lit("^ST^"), self.digits(f"{name}/z", 5))
        if key == "phone":
            return F.concat(F.lit("("), (self.below(f"{name}/a", 800) + 200).cast("string"), F.lit(")555-"), self.digits(f"{name}/d", 4))
        if key == "ssn":
            return F.concat((self.below(f"{name}/a", 566) + 100).cast("string"), F.lit("-"), F.lpad((self.below(f"{name}/g", 99) + 1).cast("string"), 2, "0"), F.lit("-"), F.lpad((self.below(f"{name}/s", 9999) + 1).cast("string"), 4, "0"))
        if key == "mrn":
            return self.digits(name, 8)
        lists = {k.replace("_", ""): v for k, v in CODES.items()}
        if key in lists:
            return self.pick(name, lists[key])
        if key in {e.replace("_", "") for e in ERRORS}:
            raise TemplateError(f"the template injects the error {kind}")
        raise TemplateError(f"unknown value source {kind!r}")


def message(template: dict[str, Any], seed: int, row: Column) -> Column:
    """The wire text of a template's message. Sources are named by field path (``PID.3``) and fill each component."""
    delims = template.get("delims") or "^~\\&"
    encoding = delims if isinstance(delims, str) else "".join(delims)
    maker, lines = Maker(seed, row), []
    for at, segment in enumerate(template["segments"]):
        text = segment if isinstance(segment, str) else "|".join([segment["id"], *segment.get("fields", [])])
        name, *given = text.split("|")
        parts: list[Column] = [F.lit(name)]
        for i, field in enumerate(given):
            number = i + (2 if name == "MSH" else 1)
            if name == "MSH" and i == 0:
                parts.append(F.lit(encoding))
                continue
            sources = (template.get("values") or {}).get(f"{name}.{number}")
            if not sources:
                parts.append(F.lit(field))
                continue
            made = []
            for j, _ in enumerate(field.split("^")):
                source = sources[min(j, len(sources) - 1)]
                made.append(escape(maker.value(source, f"{name}[{at}].{number}.{j}")))
            parts.append(F.concat_ws("^", *made))
        lines.append(F.concat_ws("|", *parts))
    return F.concat(F.concat_ws("\r", *lines), F.lit("\r"))


def generate(spark: SparkSession, templates: list[tuple[dict[str, Any], float]] | dict[str, Any], seed: int, n: int) -> DataFrame:
    """``n`` messages: ordinal, template, raw. Several templates share the rows by weight."""
    weighted = [(templates, 1.0)] if isinstance(templates, dict) else list(templates)
    total = sum(w for _, w in weighted)
    rows = spark.range(n).withColumnRenamed("id", "ordinal")
    u, raw, name, upto = Maker(seed, F.col("ordinal")).uniform("template"), F.lit(None).cast("string"), F.lit(None).cast("string"), 0.0
    choices = []
    for template, weight in weighted:
        upto += weight / total
        choices.append((upto, template))
    for limit, template in reversed(choices):
        first = template is choices[-1][1]
        raw = message(template, seed, F.col("ordinal")) if first else F.when(u < limit, message(template, seed, F.col("ordinal"))).otherwise(raw)
        name = F.lit(template.get("name", "")) if first else F.when(u < limit, F.lit(template.get("name", ""))).otherwise(name)
    return rows.select("ordinal", name.alias("template"), raw.alias("raw"))


def golden_hashes(messages: DataFrame) -> DataFrame:
    return messages.select("ordinal", sha256(F.col("raw")).alias("sha256"))


def verify_golden_hashes(messages: DataFrame, golden: DataFrame) -> DataFrame:
    """ordinal and ok for every message and every golden hash."""
    joined = golden_hashes(messages).withColumnRenamed("sha256", "now").join(golden.withColumnRenamed("sha256", "was"), "ordinal", "full")
    return joined.select("ordinal", F.coalesce(F.col("now") == F.col("was"), F.lit(False)).alias("ok"))
