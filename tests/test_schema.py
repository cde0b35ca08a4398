"""The schema compiler's contracts."""

import json

import pytest
import yaml

from bitquarry.__main__ import main
from bitquarry.schema import compiler as S
from bitquarry.schema import nodes as N

MESSAGES = """
substitute: {phrase: 128, flag: true}
types:
  request: {kind: object, fields: {times: u16, phrase: {kind: b5_string, max_length: "${phrase}", bounded_buffer_size: 64}}}
  response:
    kind: object
    fields:
      phrase: {kind: b5_string, max_length: 64, terminated_sequence: false}
      list: {name: item_list, kind: array, max_elements: 5, encoding: delimited, type: {kind: object, fields: {f1: u16, f2: u32, f3: bfloat16}}}
  message: {kind: variant, options: {req: {id: 1, type: request}, resp: {id: 2, type: response}}}
"""


def test_whole_document():
    s = S.compile_text(MESSAGES)
    assert (s["request"].min_bits, s["request"].max_bits) == (24, 664)
    assert s["response"].max_bits == 652
    assert s["message"].tag_bits == 2
    assert "item_list" in s.nodes and s["item_list"].encoding == "delimited"
    assert list(s.nodes).index("request") < list(s.nodes).index("message")
    assert "u8" not in s.nodes and "u16" in s.nodes
    assert "u8" in S.compile_text(MESSAGES, prune=False).nodes
    assert "message: 2..666 bits, arrow" in s.explain()


def test_imports_merge_and_circles(tmp_path, monkeypatch):
    far = tmp_path / "far"
    far.mkdir()
    (far / "core.yaml").write_text("types: {a: {kind: integer, bitwidth: 3, signed: false}}\nlist: [1]\n")
    (tmp_path / "root.yaml").write_text("imports: [core.yaml]\ntypes: {a: {bitwidth: 5}, b: {kind: optional, type: a}}\nlist: [2]\n")
    with pytest.raises(S.SchemaError, match="no import"):
        S.load(tmp_path / "root.yaml")
    monkeypatch.setenv("SCHEMA_PATH", str(far))
    doc = S.load(tmp_path / "root.yaml")
    assert doc["types"]["a"] == {"kind": "integer", "bitwidth": 5, "signed": False} and doc["list"] == [1, 2]
    assert S.compile_doc(doc)["b"] == N.Optional(N.Integer(5))
    (tmp_path / "x.yaml").write_text("imports: y.yaml\n")
    (tmp_path / "y.yaml").write_text("imports: x.yaml\n")
    with pytest.raises(S.SchemaError, match="circle"):
        S.load(tmp_path / "x.yaml")
    (tmp_path / "z.yaml").write_text("[1]\n")
    with pytest.raises(S.SchemaError, match="map"):
        S.load(tmp_path / "z.yaml")


def test_substitution_and_lifting():
    assert S.substituted({"a": "${f}", "b": "x${n}y", "c": "${no}"}, {"f": True, "n": 3}) == {"a": True, "b": "x3y", "c": "${no}"}
    assert S.dotted("code_config", {"a": {"b": 1}}) == {"code_config.a.b": 1}
    doc = S.lifted({"types": {"o": {"kind": "object", "fields": {"p": {"kind": "array", "max_elements": 4, "type": {"kind": "integer", "bitwidth": 2, "signed": False}}}}}})
    assert doc["types"]["o"]["fields"] == {"p": "o_p_T1"}
    assert doc["types"]["o_p_T1"]["type"] == "o_p_T1_type_T2"


@pytest.mark.parametrize(
    "text,match",
    [
        ("types: {a: {kind: integer, signed: false}}", "needs bitwidth"),
        ("types: {a: {kind: nothing}}", "unknown kind"),
        ("types: {a: {kind: object, fields: {b: c}}}", "no type c"),
        ("types: {a: {kind: object, fields: {b: 3}}}", "is no type"),
        ("types: {a: {kind: object, fields: {b: b1}}, b1: {kind: optional, type: a}}", "circle"),
        ("types: {a: {kind: integer, bitwidth: true, signed: false}}", "no u32"),
        ("types: {a: {kind: vbr_integer, signed: false, segments: [3]}}", "two or more"),
        ("types: {a: {kind: buffer, max_elements: 3, bitwidth: 2, encoding: other}}", "none of"),
        ("types: {a: {kind: b5_string}}", "needs max_length"),
        ("types: {a: {kind: buffer, min_elements: 2, max_elements: 2, bitwidth: 2, encoding: delimited}}", "delimited"),
        ("types: {a: {kind: enumeration, values: {x: 1, y: 3}}}", "dense"),
    ],
)
def test_errors(text, match):
    with pytest.raises(S.SchemaError, match=match):
        S.compile_text(text)


def test_all_kinds_and_registry():
    s = S.compile_text("types: {e: {kind: enumeration, values: {x: 10, y: 11}}, r: {kind: enumeration, min: 1, max: 6}, b: {kind: boolean}, p: {kind: primitive_variant}, v: {kind: vbr_integer, signed: true, segments: [32, 32]}, o: {kind: optional, type: v}}")
    assert s["e"].labels == ("x", "y") and s["r"].max_bits == 3 and s["p"].tag_bits == 5 and s["o"].max_bits == 66
    S.register_kind("nibble", {}, lambda p, of: N.Integer(4))
    try:
        assert S.compile_text("types: {n: {kind: nibble}}")["n"] == N.Integer(4)
        with pytest.raises(S.SchemaError):
            S.register_kind("nibble", {}, None)
    finally:
        del S.KINDS["nibble"]


def test_command_line(tmp_path, capsys):
    path = tmp_path / "m.yaml"
    path.write_text(MESSAGES)
    assert main(["merge", str(path), "--json"]) == 0
    assert json.loads(capsys.readouterr().out)["types"]["request"]["kind"] == "object"
    assert main(["merge", str(path), "--no-prune"]) == 0
    assert "u64" in yaml.safe_load(capsys.readouterr().out)["types"]
    assert main(["plan", str(path)]) == 0
    assert main(["ddl", str(path), "--type", "request"]) == 0
    assert "struct<times:int,phrase:string>" in capsys.readouterr().out
    assert main(["schema", str(path), "--type", "u16"]) == 0
    path.write_text("types: {a: {kind: nothing}}")
    assert main(["plan", str(path)]) == 1
