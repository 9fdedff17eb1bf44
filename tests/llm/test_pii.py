import pytest

from textanomaly.llm import pii

CARDS = ["4539578763621486", "4539 5787 6362 1486", "6011-0009-9013-9424"]


@pytest.mark.parametrize("size", [1, 2, 3, 10, 97, 1000])
def test_permutations_are_permutations(size):
    feistel = pii.Feistel(b"k")
    images = [feistel.permute(i, size, "t") for i in range(size)]
    assert sorted(images) == list(range(size))
    assert [feistel.permute(i, size, "t", back=True) for i in images] == list(range(size))


def test_formats_and_validity_stay():
    names = pii.Pseudonyms(b"k")
    for card in CARDS:
        changed, found = names.replace(f"x {card}.")
        digits = [c for c in changed if c.isdigit()]
        assert found == {"card": 1} and card not in changed
        assert pii.luhn_digit("".join(digits[:-1])) == digits[-1]
        assert [c for c in changed if not c.isdigit()] == [c for c in f"x {card}." if not c.isdigit()]
    assert names.replace("1234567812345678")[1] == {"number": 1}
    changed, found = names.replace("at 10.0.0.255, 999.1.1.1 and 1.2.3.4.5")
    assert found == {"ip": 1} and "999.1.1.1 and 1.2.3.4.5" in changed
    changed, found = names.replace("GB29NWBK60161331926819")
    assert found == {"iban": 1} and pii._iban_check("GB", changed[4:]) == changed[2:4]
    for text in ("1999-02-28", "28/02/1999", "28.02.1999"):
        changed, found = names.replace(text)
        assert found == {"date": 1} and names.replace(changed)[1] == {"date": 1} and len(changed) == 10
    assert names.replace("1999-02-30 version 3.0, CC 4.0, 12 of 2024") == ("1999-02-30 version 3.0, CC 4.0, 12 of 2024", {})


def test_equal_values_stay_linked():
    names = pii.Pseudonyms(b"k")
    one, two = names.replace("+1 (017) 555-7713")[0], names.replace("call +1 017 555 7713!")[0]
    assert [c for c in one if c.isdigit()] == [c for c in two if c.isdigit()]
    assert names.replace(CARDS[0])[0] == names.replace(CARDS[1])[0].replace(" ", "")
    assert names.replace("Ann.34@Mail.example.com")[0].lower() == names.replace("ann.34@mail.example.com")[0]
    assert names.replace("ann.34@mail.example.com")[0].endswith("@mail.example.com")


@pytest.mark.parametrize("phone", ["+1 (826) 555-4081", "+44 20 7946 0958", "+49 1512 3456 789", "(826) 555-4081"])
@pytest.mark.parametrize("kind, other", [
    ("ip", "190.137.223.204"), ("ip", "8.8.8.8"), ("card", "4539 5787 6362 1486"), ("card", "4539578763621486"),
    ("date", "1999-02-28"), ("date", "28.02.1999"), ("social", "078-05-1120"), (None, "2024"),
])
def test_phones_end_before_other_values(phone, kind, other):
    names = pii.Pseudonyms(b"k")
    changed, found = names.replace(f"call {phone} {other} now")
    assert found == ({"phone": 1, kind: 1} if kind else {"phone": 1})
    assert changed == f"call {names.replace(phone)[0]} {names.replace(other)[0]} now"
    assert phone not in changed and (other in changed) == (kind is None)
    assert pii.Pseudonyms(b"k", back=True).replace(changed)[0] == f"call {phone} {other} now"


@pytest.mark.parametrize("address", ["8.8.8.8", "1.1.1.1"])
def test_lone_addresses_of_single_digits_change(address):
    names = pii.Pseudonyms(b"k")
    changed, found = names.replace(f"ping {address} now")
    assert found == {"ip": 1} and address not in changed
    assert names.replace(f"12 {address}")[0].split()[1] == changed.split()[1]
    assert names.replace(f"a.b@c.example {address}")[0].split()[1] == changed.split()[1]
    assert pii.Pseudonyms(b"k", back=True).replace(changed)[0] == f"ping {address} now"


def test_key_gives_values_back(spark, documents):
    texts = [None, "", "no values", " ".join([*CARDS, "é.4@x.example", "17.2.3.4", "2020-01-31", "(212) 555-0100", "078-05-1120"]), "9" * 15 + " a@b.c " * 2, "w 8.8.8.8 " * 20_000]
    docs = documents([(i, t) for i, t in enumerate(texts)] + [(3, texts[3]), (None, texts[3])])
    changed = pii.pseudonymise(docs, "secret", found="kinds")
    assert changed.columns == [*docs.columns, "kinds"]
    rows = changed.collect()
    assert len({r.text for r in rows if r.doc_id in (3, None)}) == 1
    assert {k: v for k, v in rows[3].kinds.items()} == {"card": 3, "mail": 1, "ip": 1, "date": 1, "phone": 1, "social": 1}
    back = pii.pseudonymise(changed.drop("kinds"), "secret", back=True)
    assert sorted(back.collect(), key=repr) == sorted(docs.collect(), key=repr)
    assert pii.pseudonymise(documents([]), "secret").collect() == []


@pytest.mark.parametrize("text, kind", [
    ("12/31/1999", "date"), ("1999/12/31", "date"), ("12.31.1999", "date"), ("3782 822463 10005", "card"), ("3782-822463-10005", "card"),
    ("378282246310005", "card"), ("219-09-9999", "social"),
])
def test_other_ways_of_writing(text, kind):
    names = pii.Pseudonyms(b"k")
    changed, found = names.replace(f"on {text}, so")
    assert found == {kind: 1} and text not in changed and len(changed) == len(f"on {text}, so")
    assert names.replace(changed)[1] == {kind: 1}
    assert pii.Pseudonyms(b"k", back=True).replace(changed)[0] == f"on {text}, so"


def test_month_first_only_where_day_first_is_no_date():
    names, back = pii.Pseudonyms(b"k"), pii.Pseudonyms(b"k", back=True)
    for month in range(1, 13):
        for day in range(1, 32):
            text = f"{month:02d}/{day:02d}/2003"
            changed, found = names.replace(text)
            valid = day <= 12 or day <= [31, 28, 31, 30, 31, 30, 31, 31, 30, 31, 30, 31][month - 1]
            assert found == ({"date": 1} if valid else {}) and back.replace(changed)[0] == text


@pytest.mark.parametrize("text", ["666-12-0000", "000-12-3456", "912-12-3456", "123-00-4567", "123-45-0000", "1999/13/31", "31/31/1999"])
def test_invalid_values_stay(text):
    assert pii.Pseudonyms(b"k").replace(f"a {text} b") == (f"a {text} b", {})


def test_social_numbers_stay_valid():
    names = pii.Pseudonyms(b"k")
    for i in range(300):
        digits = f"{i + 1:03d}{i % 99 + 1:02d}{i + 1:04d}"
        if pii.social_valid(digits):
            moved = names._social(digits)
            assert pii.social_valid(moved) and pii.Pseudonyms(b"k", back=True)._social(moved) == digits


def test_mail_places_and_long_runs():
    import re
    import time

    plain = re.compile(r"[\w.%+-]*\w@[\w-]+(?:\.[\w-]+)+")
    texts = ["a@b@c.de", "@x.y", ".a@b.c", "-@b.c", "é.4@x.example, a+b%c@d-e.f.g@h.i", "a@b.c@d.e", "x@y", "x@y.", "a b@c.d.e. f@g.h", "a-@b.c", "__@b.c"]
    for text in texts:
        assert list(pii.mails(text)) == [m.span() for m in plain.finditer(text)], text
    start = time.time()
    long = "x" * 1_000_000
    assert list(pii.mails(f"{long} {long}@b.c {long}@")) == [(1_000_001, 2_000_005)]
    assert pii.Pseudonyms(b"k").replace(f"a@b.c {long}")[1] == {"mail": 1}
    assert time.time() - start < 10
