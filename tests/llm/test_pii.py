import re
import hashlib
import random

from corpusloom.llm import pii

EMAIL = re.compile(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+")
IP = re.compile(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)")
CARD = re.compile(r"[0-9]([\x20-]?[0-9])+")
PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")


def base(text):
    digits = lambda s: re.sub("[^0-9]", "", s)
    return {
        "email": [m.span() for m in EMAIL.finditer(text)],
        "ip": [m.span() for m in IP.finditer(text) if all(int(p) <= 255 for p in m.group().split("."))],
        "card": [m.span() for m in CARD.finditer(text) if 16 <= len(digits(m.group())) <= 19 and pii.luhn(digits(m.group()))],
        "phone": [m.span() for m in PHONE.finditer(text) if 8 <= len(digits(m.group())) <= 15],
    }


def test_base_spans_equal_the_patterns():
    draw = random.Random(6)
    bits = ["a", "b.c", "@", "@x.de", ".", "..", "-", "+", "+1 (555) 123-4567", "1", "12", "255", "256", "4111 1111 1111 1111", "4111111111111111", " ", "  ", "1.2.3.4", "10.0.0.1.7", "é", "(", "_", "%", "0", "٣", "²"]
    for _ in range(6000):
        text = "".join(draw.choice(bits) for _ in range(draw.randint(0, 9)))
        found = pii.find(text)
        assert {k: found[k] for k in pii.BASE} == base(text), text


def test_added_kinds():
    text = "IBAN DE89 3704 0044 0532 0130 00, account no. 12345678; tel:030-1234567 https://joe:secret@host/x https://host/path Account settings 5"
    found = pii.find(text)
    assert [text[a:b] for k in pii.ADDED for a, b in found[k]] == ["DE89 3704 0044 0532 0130 00", "12345678", "030-1234567", "joe:secret"]
    assert "<iban>" in pii.redact(text) and "secret" not in pii.redact(text)
    assert pii.redact(None) == "" and pii.redact("plain") == "plain"
    assert not any(pii.find("DE89 3704 0044 0532 0130 01 and http://x.org").get(k) for k in pii.ADDED)


def test_report(documents, odd_rows):
    rows = odd_rows + [(20, "mail a@b.co or 1.2.3.4")]
    found = pii.personal_data(documents(rows)).collect()
    assert len(found) == len(rows)
    last = next(r for r in found if r["doc_id"] == 20)
    assert (last["n_email"], last["n_ip"], last["spans"]) == (1, 1, "email:5:11,ip:15:22")
    assert last["base_sha256"] == hashlib.sha256(b"email:5:11,ip:15:22").hexdigest()
    assert pii.personal_data(documents([])).count() == 0
    docs = documents(rows)
    assert pii.redacted(docs).columns == docs.columns and pii.redacted(docs).filter("doc_id = 20").first()["text"] == "mail <email> or <ip>"


def test_long_numbers_and_secrets():
    long = "1." * 500_000 + "7" * 10_000 + ".0" + "0" * 9_000 + "8.1.2 mail a@b.co"
    found = pii.find(long)
    assert found["ip"] == ips(long) and len(found["ip"]) > 100_000 and len(found["email"]) == 1
    text = "x Token = 'abcdef0123456789abcd' PASSWORD: short api_key=AAAAbbbbCCCCdddd1"
    assert [text[a:b] for a, b in pii.find(text)["secret"]] == ["abcdef0123456789abcd", "AAAAbbbbCCCCdddd1"]


def ips(text):
    small = lambda p: len(p.lstrip("0")) <= 3 and int(p.lstrip("0") or 0) <= 255
    return [m.span() for m in IP.finditer(text) if all(small(p) for p in m.group().split("."))]
