"""Planted entities beside other numbers; what is expected is written here, not found by the operator."""

import ipaddress

import pytest

from caseloom.llm import pii

PLANTED = [
    ("+1 (826) 555-4081", "phone"), ("(826) 555-4081", "phone"), ("+33 6 12 34 56 78", "phone"), ("+49 30 12345678", "phone"),
    ("+44 20 7946 0958", "phone"), ("+44 7911 123456", "phone"), ("+1-736-555-2678", "phone"), ("+4915112345678", "phone"),
    ("4111 1111 1111 1111", "card"), ("4111111111111111", "card"), ("378282246310005", "card"), ("4111-1111-1111-1111", "card"),
    ("2001:db8:85a3::8a2e:370:7334", "ip6"), ("fe80::1ff:fe23:4567:890a", "ip6"), ("2001:0DB8:0000:0000:0000:0000:0000:0001", "ip6"),
    ("190.137.223.204", "ip"), ("123-45-6789", "ssn"),
]


@pytest.mark.parametrize("around", ["{}", "see {}.", "190.137.223.1 {}", "{} 190.137.223.1", "no 7 {}", "{} 12 items", "12 {} 07", "({}, 123)", "{} 123"])
@pytest.mark.parametrize("entity, kind", PLANTED)
def test_beside_numbers(entity, kind, around):
    text = around.format(entity)
    at = text.index(entity)
    assert (at, at + len(entity), kind) in [f[:3] for f in pii.find(text)]


def test_no_entities():
    assert pii.find("at 12:30:45 a::b std::vector 2020-01-02 1234 5678 and 4111 1111 1111 1112 123, ratio 1:2:3") == []


def test_documents_with_planted(spark):
    rows = [(i, f"call 12 {entity} 190.137.223.1 today") for i, (entity, _) in enumerate(PLANTED)]
    got = pii.with_surrogates(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    for r in got:
        entity, kind = PLANTED[r.doc_id]
        assert entity not in r.text
        if entity.startswith("+"):
            assert f" {entity.split()[0].split('-')[0][:3]}" in r.text
        assert kind in [f[2] for f in pii.find(r.text)]


def test_scope_of_addresses():
    for entity in ("fe80::1ff:fe23:4567:890a", "fe80::1", "2001:db8::1", "fd00::2"):
        drawn = [pii.surrogate("ip6", entity, attempt) for attempt in range(12)]
        assert entity not in drawn and {d.split(":")[0] for d in drawn} == {entity.split(":")[0]}
        assert all(ipaddress.IPv6Address(d) for d in drawn)
