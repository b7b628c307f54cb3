"""Schemas of the data model."""

from keratoline import dims

ITEMS = "page_id string, ord int, text string, confidence float, cx float, cy float, x0 float, y0 float, x1 float, y1 float, page_height int"
LOCATED = "page_id string, field string, value double, conf float, cx float, cy float, raw_text string"
MANIFEST = ["filename", "id", "family_name", "given_name", "dob", "examdate", "examtime", "laterality", "printouttype"]
IDENTITY = ["id", "FamilyName", "GivenName", "birthdate", "eye", "exam_date", "exam_time"]
NAMES = ["FamilyName", "GivenName"]
EVENT = ["source_folder", "source_file", "page_number", "printout_type", "qa_status", "n_fields", "device_serial", "software_version", "imagedir"]
CONF_SUFFIX = "_Paddle_conf"
MEASUREMENTS = "ord bigint, visit_id string, source_type string, field string, value double, conf float"
LEDGER = "path string, commit string"
REJECTS = "category string, file string, detail string"


def raw_columns(names: bool = True) -> list[str]:
    """The wide table's columns, with or without the patients' names."""
    return [*(c for c in IDENTITY if names or c not in NAMES), *EVENT, *dims.FIELDS, *(f"{f}{CONF_SUFFIX}" for f in dims.FIELDS)]
