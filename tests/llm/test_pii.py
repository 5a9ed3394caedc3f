import ipaddress
import time

from caseloom.llm import pii


def test_finds():
    text = ("Mr. John Smith wrote to SMITH at j.d@Mail.example.com or +1 (736) 555-2678 and +1-736-555-2678, card "
            "4111 1111 1111 1111 not 4111 1111 1111 1112, 10.2.3.4 not 1.2.3.456, DE89370400440532013000, 123-45-6789; Анна Иванова")
    kinds = [(kind.split()[0], entity) for _, _, kind, entity in pii.find(text)]
    assert kinds == [("name", "john"), ("name", "smith"), ("name", "smith"), ("email", "j.d@mail.example.com"), ("phone", "+17365552678"),
                     ("phone", "+17365552678"), ("card", "4111111111111111"), ("ip", "10.2.3.4"), ("iban", "DE89370400440532013000"),
                     ("ssn", "123456789"), ("name", "анна"), ("name", "иванова")]
    assert pii.find("Plain words of 1234 and 12.5, see 2020-01-02.") == []


def test_surrogates(odd_docs):
    got = {(r.doc_id, r.source): r.text for r in pii.with_surrogates(odd_docs).collect()}
    before = {(r.doc_id, r.source): r.text for r in odd_docs.collect()}
    assert {k for k in got if got[k] != before[k]} == {(13, "a"), (14, "b")}
    one, two = got[13, "a"], got[14, "b"]
    found, other = pii.find(one), pii.find(two)
    # Same types in the same order, the surname and the address shared by both texts.
    assert [f[2] for f in found] == [f[2] for f in pii.find(before[13, "a"])]
    assert [f[2] for f in other] == [f[2] for f in pii.find(before[14, "b"])]
    surname = [f[3] for f in found if "surname" in f[2]]
    assert len(set(surname)) == 1 and surname[0] in [f[3] for f in other]
    assert {f[3] for f in found if f[2] == "email"} == {f[3] for f in other if f[2] == "email"}
    assert not {f[3] for f in found} & {f[3] for f in pii.find(before[13, "a"])}
    assert [f[3] for f in other if f[2] == "ip"][0].startswith("10.")
    assert pii.with_surrogates(odd_docs).columns == odd_docs.columns


def test_documents(documents):
    """Every entity of the corpus keeps one surrogate, different ones differ, other text stays."""
    drawn = {}
    got = {r.doc_id: r for r in pii.with_surrogates(documents, found_as="entities").collect()}
    for doc_id, text in documents.select("doc_id", "text").collect():
        before, after = pii.find(text), pii.find(got[doc_id].text)
        assert (text == got[doc_id].text) == (not before)
        assert [(e.start, e.end, e.kind, e.entity) for e in got[doc_id].entities] == before
        for old, new in zip(before, after, strict=True):
            assert old[2] == new[2] and drawn.setdefault(old[2:], new[3]) == new[3]
    assert len(set(drawn.values())) == len(drawn) and not set(drawn.values()) & {entity for _, entity in drawn}


def test_names_of_small_pools(spark):
    """Hundreds of names of one gender get as many surrogates."""
    rows = [("name given latin f", f"anna{chr(97 + i // 26)}{chr(97 + i % 26)}") for i in range(600)]
    got = pii.assign(spark.createDataFrame(rows, "kind string, entity string")).collect()
    assert len({r.drawn for r in got}) == len(got) == 600


def test_spaces_too_small(spark):
    """More entities than half of what their form leaves to draw: widened draws still part them all."""
    rows = [("ip", f"192.168.{i // 256}.{i % 256}") for i in range(40_000)] + [("phone", f"+375{i:04d}") for i in range(8_000)]
    rows += [("email", f"{chr(97 + i)}@x.example") for i in range(26)]
    got = pii.assign(spark.createDataFrame(rows, "kind string, entity string").repartition(8)).collect()
    drawn = {(r.kind, r.drawn) for r in got}
    assert len(got) == len(rows) == len(drawn) and not drawn & set(rows)
    assert all(ipaddress.ip_address(r.drawn).is_private for r in got if r.kind == "ip")
    # No digit of a widened number is lost in the text.
    assert pii.rendered("+37512345", "+375 1234", "phone") == "+375 12345"


def test_many_entities():
    text = " ".join(f"a{i}@mail.example.com 10.1.{i // 256}.{i % 256}" for i in range(6_000))
    start = time.process_time()
    assert len(pii.find(text)) == 12_000
    assert time.process_time() - start < 5


def test_clashing_names(spark):
    names = ["row", "_row", "drawn", "_drawn", "entity", "kind", "start", "end", "e", "_Found", "a.b"]
    docs = spark.createDataFrame([(1, "mail a@b.example.com", *names), (2, None, *names)],
                                 "doc_id long, text string, " + ", ".join(f"`{n}` string" for n in names))
    got = pii.with_surrogates(docs)
    assert got.columns == docs.columns
    assert sorted(tuple(r)[2:] for r in got.collect()) == [tuple(names)] * 2


def test_empty(no_docs):
    assert pii.with_surrogates(no_docs).collect() == []


def test_length_follows(spark):
    docs = spark.createDataFrame([(1, "mail a@b.example.com", 20), (2, None, None)], "doc_id long, text string, n_chars int")
    rows = {r.doc_id: r for r in pii.with_surrogates(docs, length="n_chars").collect()}
    assert rows[1].n_chars == len(rows[1].text) and rows[2].n_chars is None
