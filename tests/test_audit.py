"""A sound catalogue has no faults, each planted one is told, references that lead nowhere are refused."""

import pytest
from pyspark.errors import PySparkValueError

from docfacts.operators import audit

SOUND = ("a", "a", "Label", "string", None, None, "one", "what", None, None, None, None, True, None)


def catalogue(spark, fields=(SOUND,), asked=(("t", "required", "a"),), types=(("t",),), overrides=()):
    return (
        spark.createDataFrame(list(types), "document_type string"), spark.createDataFrame(list(asked), "document_type string, role string, field_id string"),
        spark.createDataFrame(list(overrides), "document_type string, field_id string"), spark.createDataFrame(list(fields), audit.FIELD_COLUMNS),
    )


def rules(spark, **parts):
    return sorted((r["rule"], r["subject"], r["detail"]) for r in audit.violations(*catalogue(spark, **parts)).collect())


def field(**changes):
    names = [c.split(" ")[0] for c in "key,field_id,label,type,format,scale,cardinality,description,validators,aliases,enum,columns,evidence_required,derived".split(",")]
    return tuple(changes.get(n, v) for n, v in zip(names, SOUND, strict=True))


def test_sound_and_empty(spark):
    assert rules(spark) == [] and rules(spark, fields=(), asked=(), types=()) == []
    audit.require_references(*catalogue(spark))


def test_fields(spark):
    wrong = field(field_id="b", type="money", scale="x", description="Label", validators=["vin", "no"], aliases=["LABEL", "c"], enum=["p", None], columns=[("i", "", "object"), ("i", "I", None)], derived=True)
    got = rules(spark, fields=(wrong,))
    assert [r[0] for r in got] == [
        "alias_repeats", "column_id_repeats", "column_type_unknown", "column_without_label", "columns_on_scalar", "derived_wants_evidence", "enum_blank_or_repeated", "id_differs_from_key", "mute_description", "scale_unknown", "unknown_validator",
    ]
    assert ("unknown_validator", "a", "no") in got and ("alias_repeats", "a", "label") in got
    assert rules(spark, fields=(field(type="object"), )) == [("object_of_one", "a", "one")]


def test_types(spark):
    asked = [("t", "required", "a"), ("t", "optional", "a"), ("t", "derived", "a"), ("t", "derived", "a"), ("t", "optional", "z"), ("u", "optional", "a")]
    assert rules(spark, asked=asked, types=[("t",), ("t",), ("u",), ("v",)], overrides=[("t", "a"), ("t", "z"), ("v", "a"), ("v", "a")]) == [
        ("derived_and_read", "t", "a"), ("derived_undeclared", "t", "a"), ("listed_twice", "t", "a"), ("override_unused", "t", "z"), ("override_unused", "v", "a"), ("required_and_optional", "t", "a"),
        ("type_without_fields", "v", ""), ("type_without_required", "u", ""), ("type_without_required", "v", ""), ("unknown_field", "t", "z"),
    ]
    with pytest.raises(PySparkValueError, match=r"^2 references .*t: z"):
        audit.require_references(*catalogue(spark, asked=asked, overrides=[("t", "z")]))
