"""Contracts: compatibility, round trips of both spellings, warnings, hypothesis on locations."""

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from contractlens import contract

BASE = """
id: c
version: 1.0.0
inputs:
  - {name: a, location: in/a}
  - {name: b, location: in/b}
outputs:
  - name: o
    location: out/o
    format: parquet
    csv: {delimiter: ';'}
    schema:
      fields:
        - {name: k, type: long, required: true}
        - {name: s, type: struct, properties: [{name: x, type: string}]}
"""


@pytest.mark.parametrize(
    ("was", "becomes", "kind"),
    [
        ("id: c", "id: d", "BREAKING"),
        ("location: out/o", "location: out/p", "BREAKING"),
        ("format: parquet", "format: orc", "BREAKING"),
        ("    format: parquet\n", "", None),
        ("format: parquet", "format: parquet\n    saveMode: append", "BREAKING"),
        ("  - {name: b, location: in/b}\n", "", "BREAKING"),
        ("  - {name: b, location: in/b}\n", "  - {name: b, location: in/b}\n  - {name: d, location: in/d}\n", "MINOR"),
        ("csv: {delimiter: ';'}", "csv: {delimiter: ','}", "BREAKING"),
        ("    csv: {delimiter: ';'}\n", "", None),
        ("type: long, required: true}", "type: integer, required: true}", "BREAKING"),
        ("type: long, required: true}", "type: bigint, required: true}", None),
        ("type: long, required: true}", "type: long, required: false, nullable: false}", None),
        ("type: long, required: true}", "type: long, required: true}\n        - {name: n, type: string}", "MINOR"),
        ("type: long, required: true}", "type: long, required: true}\n        - {name: n, type: string, required: true}", "BREAKING"),
        ("type: long, required: true}", "type: long, required: true, partitioned: true}", "BREAKING"),
        ("{name: x, type: string}", "{name: x, type: long}", "BREAKING"),
        ("{name: x, type: string}", "{name: x, type: string}, {name: y, type: string}", "MINOR"),
        ("format: parquet", "format: parquet\n    catalog: {required: true}", "BREAKING"),
        ("format: parquet", "format: parquet\n    catalog: {required: false, technology: hive}", None),
        ("format: parquet", "format: parquet\n    derivedFrom: [a]", "BREAKING"),
        ("format: parquet", "format: parquet\n    derivedFrom: [a, b]", None),
        ("format: parquet", "format: parquet\n    derivedFrom: []", "BREAKING"),
    ],
)
def test_changes(was, becomes, kind):
    assert was in BASE
    old, new = contract.parse(BASE), contract.parse(BASE.replace(was, becomes))
    kinds = {k for k, _ in contract.changes(old, new)}
    assert kinds == ({kind} if kind else set())
    assert contract.parse(contract.to_yaml(new)) == new


def test_slips_are_named_and_other_keys_left_alone():
    text = "id: c\ninput: []\ntags: [x]\nwhatever: 1\noutputs: [{name: o, location: l, catalog: {required: true, tabel: t}, schema: {field: []}}]\n"
    said = [m for _, m in contract.unknown_keys(text)]
    assert said == ["input: unknown key is ignored; did you mean inputs?", "outputs[0].catalog.tabel: unknown key is ignored; did you mean table?", "outputs[0].schema.field: unknown key is ignored; did you mean fields?"]
    assert contract.unknown_keys("id: [") == []


@pytest.mark.parametrize(
    "text",
    [
        "id: c\noutputs: [{name: o, location: l, schema: {fields: [{name: x}]}}]", "id: c\noutputs: [{location: l}]", "id: c\noutputs: {name: o}", "id: c\noutputs: [x]",
        "id: c\noutputs: [{name: o, location: l, type: TABLE}]", "id: c\nrules: [{columns: [a]}]", "id: c\noutputs: [{name: o, location: l, derivedFrom: [1]}]",
        "id: c\noutputs: [{name: o, location: l, schema: {fields: [{name: x, type: t, required: perhaps}]}}]", "", "id: c\noutputs: [{name: o, location: l, csv: {sep: ';', delimiter: ','}}]",
        "id: c\noutputs: [{name: o, location: l, schema: {fields: [{name: x, type: t, partitionKeyPosition: first}]}}]", "id: c\nextensions: 3",
    ],
)
def test_what_is_no_contract_says_where(text):
    with pytest.raises(contract.ContractError) as x:
        contract.parse(text)
    assert ":" in str(x.value)


parts = st.lists(st.sampled_from(["a", "b", "orders", "x.y", "k=1", ".", "", "gold"]), min_size=1, max_size=4).map("/".join)
places = st.tuples(st.sampled_from(["", "/", "s3a://", "S3://", "file:/", "file:///", "abfss://"]), parts).map("".join)


@settings(max_examples=300, deadline=None)
@given(places, places)
def test_the_index_finds_what_comparison_finds(declared, actual):
    same = contract.same_location(declared, actual)
    index = contract.Locations([declared], lambda x: x)
    assert (index.actual(actual) == [declared]) is same
    assert (contract.Locations([actual], lambda x: x).declared(declared) == [actual]) is same
    assert contract.normal_location(contract.normal_location(actual)) == contract.normal_location(actual)
