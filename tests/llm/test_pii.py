from hypothesis import given, settings
from hypothesis import strategies as st

from strata.llm.pii import KINDS, Feistel, luhn_digit, mask_pii, pseudonymize
from tests.llm.conftest import EDGE, make

F = Feistel(b"test key")
CARD = "4207051279108084"
TEXT = ("Call +1 (375) 555-4393 or 375-555-4393, card " + CARD + ", 4207 0512 7910 8084, ip 28.125.121.88. "
        "Mail nacccgom.40@mail6.example.com on 2020-02-29, 12/25/1999, 25/12/1999 and 03.04.2001, "
        "iban DE89 3704 0044 0532 0130 00, ssn 123-45-6789.")


def masked(text):
    counts = dict.fromkeys(KINDS, 0)
    return pseudonymize(text, F, counts), counts


def test_every_kind_is_replaced_and_restored():
    out, counts = masked(TEXT)
    assert counts == {"email": 1, "iban": 1, "ip": 1, "date": 4, "phone": 2, "ssn": 1, "card": 2}
    for value in ("555-4393", CARD, "28.125.121.88", "nacccgom.40", "2020-02-29", "12/25/1999", "123-45-6789"):
        assert value not in out
    assert pseudonymize(out, F, back=True) == TEXT


def test_equal_values_stay_linked_and_formats_stay():
    a, b = masked(f"x {CARD} y")[0], masked(f"other {CARD}.")[0]
    new = a.split()[1]
    assert b == f"other {new}." and new != CARD and len(new) == 16 and luhn_digit(new[:-1]) == new[-1]
    phone = masked("+1 (375) 555-4393 375-555-4393")[0]
    assert phone.count("-") == 3 and phone[4:7] == phone[18:21]  # one number in two formats
    day = masked("2001-04-03 03.04.2001")[0].split()
    assert day[0].split("-") == day[1].split(".")[::-1]


def test_invalid_values_stay():
    text = "4207051279108085 300.1.1.1 2021-02-30 1-2-3 000-12-3456 DE89 3704 0044 0532 0130 01 a@b 0000000000000000 150-555-1234"
    assert masked(text) == (text, dict.fromkeys(KINDS, 0))


@settings(max_examples=200, deadline=None)
@given(st.integers(2, 10 ** 16), st.data())
def test_feistel_is_a_bijection(size, data):
    n = data.draw(st.integers(0, size - 1))
    image = F.permute(n, size, b"t")
    assert 0 <= image < size and F.permute(image, size, b"t", back=True) == n


def test_small_domains_are_permuted():
    for size in (2, 3, 10, 97):
        assert sorted(F.permute(n, size, b"t") for n in range(size)) == list(range(size))


def test_rows(spark, no_docs):
    rows = [*EDGE, (30, TEXT), (31, TEXT), (31, TEXT), (32, "1" * 100_000), (33, "1 " * 50_000), (34, "a@" * 50_000)]
    out = mask_pii(make(spark, rows), b"test key")
    assert out.columns == ["doc_id", "text", "n_found", *(f"n_{k}" for k in KINDS)]
    got = sorted(((r["doc_id"], r["text"], r["n_found"]) for r in out.collect()), key=str)
    want = []
    for i, t in rows:
        new, counts = (t, {}) if t is None else masked(t)
        want.append((i, new, sum(counts.values())))
    assert got == sorted(want, key=str)
    assert mask_pii(no_docs, b"k").count() == 0


def test_keys_differ():
    assert pseudonymize(CARD, Feistel(b"a")) != pseudonymize(CARD, Feistel(b"b"))


def test_values_beside_other_groups_are_found():
    cards = ("4111 1111 1111 1111 123", "4111 1111 1111 1111 12/27", "12 4111 1111 1111 1111", "4111-1111-1111-1111 99")
    for text in cards:
        out, counts = masked(f"paid {text} ok")
        assert counts["card"] == 1 and "1111 1111" not in out and "1111-1111" not in out
    assert masked("ID12 4111 1111 1111 1111 and NO12 4111 1111 1111 1111")[1]["card"] == 2
    ibans = ("BE68 5390 0754 7034", "AT61 1904 3002 3457 3201", "ES91 2100 0418 4502 0005 1332",
             "PL61 1090 1014 0000 0712 1981 2874", "DE89 3704 0044 0532 0130 00", "BE68539007547034")
    for iban in ibans:
        for after in ("", " EUR", " 1234", " A", " BIC ABCD", ", EUR"):
            out, counts = masked(f"to {iban}{after}")
            assert counts == {**dict.fromkeys(KINDS, 0), "iban": 1} and iban not in out and out.endswith(after), iban + after
            assert pseudonymize(out, F, back=True) == f"to {iban}{after}"


def test_dates_of_timestamps_are_found():
    for text in ("2024-05-01T10:00:00", "2024-05-01T10:00:00.123Z", "2024-05-01T1000", "2024-05-01 10:00"):
        out, counts = masked(text)
        assert counts["date"] == 1 and out[10:] == text[10:] and out[:10] != text[:10]
        assert pseudonymize(out, F, back=True) == text
    assert masked("2024-05-01Tuesday")[1]["date"] == 0
