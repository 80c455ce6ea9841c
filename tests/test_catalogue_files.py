"""Two catalogues as files, a sound one and broken ones: what loads, what is refused, and what an export keeps."""

import json

import pytest
from pyspark.errors import PySparkValueError

from docfacts.sources import catalogue_files as files


def field(name, **more):
    return {"id": name, "label_it": f"Label {name}", "type": "money", "format": None, "default_cardinality": "one", "pii": "NONE", "evidence_required": True, "validators": [], "description": "what it is", "label_aliases_it": [f"alias {name}"], **more}


def write(folder, fields, types, **top):
    folder.mkdir()
    (folder / files.FIELDS_FILE).write_text(json.dumps({"version": "1", "sections": {"issuer": ["Cedente", "Cedente prestatore (fornitore)", " "]}, "fields": fields, **top}))
    (folder / files.TYPES_FILE).write_text(json.dumps({"version": "1", "document_types": types}))
    return str(folder)


def sound(folder):
    fields = {f"f.{i:02}": field(f"f.{i:02}", curator={"note": [i, "è \"x\""]}) for i in range(40)}
    fields["f.03"]["columns"] = [{"id": "c", "label_it": "C", "type": "date"}]
    types = {f"t.{i}": {"document_type_id": f"t.{i}", "required_fields": [f"f.{i + 1:02}", f"f.{i:02}"], "optional_fields": ["f.30"], "field_pii_overrides": {"f.30": "PERSONAL"}, "odd": i} for i in range(20)}
    types["t.0"]["derived_fields"] = ["f.39"]
    return write(folder, fields, types, curators=["a", "b"])


def test_loads_fields_types_lists_and_headings(spark, tmp_path):
    found = files.load(spark, sound(tmp_path / "a"))
    assert found.fields.count() == 40 and found.types.count() == 20
    assert [tuple(r) for r in found.asked.where("document_type = 't.0'").orderBy("ord").select("role", "field_id").collect()] == [("required", "f.01"), ("required", "f.00"), ("optional", "f.30"), ("derived", "f.39")]
    assert [r["heading"] for r in found.sections.collect()] == ["cedente prestatore fornitore", "cedente"]
    assert found.overrides.count() == 20
    three = found.fields.where("key = 'f.03'").first()
    assert three["aliases"] == ["alias f.03"] and three["columns"][0]["type"] == "date" and three["enum"] is None


def test_an_export_keeps_unknown_keys_and_loads_again(spark, tmp_path):
    folder = sound(tmp_path / "a")
    found = files.load(spark, folder)
    decisions = spark.createDataFrame([("t.0", "f.00", "excluded"), ("t.0", "f.30", "required"), ("t.0", "f.20", "optional"), ("none", "f.01", "required")], "document_type string, field_id string, state string")
    hints = spark.createDataFrame([("f.01", "seen"), ("f.01", "seen"), ("f.01", "alias f.01")], "field_id string, label string")
    many = spark.createDataFrame([("f.02", "many")], "field_id string, cardinality string")
    types, fields = files.corrected_types(found, decisions), files.corrected_fields(found, hints, many)
    text = {f: files.file_text(spark, folder, f, m, e).collect() for f, m, e in ((files.FIELDS_FILE, "fields", fields), (files.TYPES_FILE, "document_types", types))}
    assert all(len(rows) == 1 for rows in text.values())
    old = {f: json.loads((tmp_path / "a" / f).read_text()) for f in text}
    new = {f: json.loads(rows[0]["value"]) for f, rows in text.items()}
    old[files.FIELDS_FILE]["fields"]["f.01"]["label_aliases_it"].append("seen")
    old[files.FIELDS_FILE]["fields"]["f.02"]["default_cardinality"] = "many"
    old[files.TYPES_FILE]["document_types"]["t.0"].update(required_fields=["f.01", "f.30"], optional_fields=["f.20"])
    assert new == old
    again = tmp_path / "b"
    again.mkdir()
    for f, rows in text.items():
        (again / f).write_text(rows[0]["value"])
    assert files.load(spark, str(again)).asked.where("document_type = 't.0' and role <> 'derived'").count() == 3


def test_broken_files_are_refused(spark, tmp_path):
    ask = lambda *names: {"required_fields": list(names), "optional_fields": []}
    cases = {
        r"2 references .*first: t: gone": ({"a": field("a")}, {"t": ask("gone", "a"), "u": ask("more")}),
        r"1 references .*first: t: a": ({"a": field("a")}, {"t": {**ask(), "field_validator_overrides": {"a": []}}}),
        r"2 entries lack .*document-fields.json: t": ({"a": field("a", label_aliases_it="no")}, {"t": {"required_fields": ["a", 1], "optional_fields": []}}),
    }
    for i, (message, (fields, types)) in enumerate(cases.items()):
        with pytest.raises(PySparkValueError, match=message):
            files.load(spark, write(tmp_path / str(i), fields, types))
    folder = write(tmp_path / "text", {}, {})
    assert files.load(spark, folder).fields.count() == 0
    (tmp_path / "text" / files.FIELDS_FILE).write_text('{"fields": {}')
    with pytest.raises(PySparkValueError, match="isn't a JSON object"):
        files.load(spark, folder)
