"""Values that stand before or within longer matches, dates with the day first, and phones with a leading 1."""

import random

import pytest

from pairwave.llm import pii

KEY = b"0123456789abcdef"
WHOLE = {
    "BE68 5390 0754 7034 BIC": "BE68 5390 0754 7034",
    "BE68539007547034 2024": "BE68539007547034",
    "AT611904300234573201 BIC": "AT611904300234573201",
    "ES9121000418450200051332 A": "ES9121000418450200051332",
    "PL61109010140000071219812874 ODER": "PL61109010140000071219812874",
    "NO9386011117947 AB12": "NO9386011117947",
    "born 25/12/2020.": "25/12/2020",
    "born 13/12/2020.": "13/12/2020",
    "born 12/25/2020.": "12/25/2020",
    "call 1-555-123-4567 now": "1-555-123-4567",
    "call 1 (555) 123-4567 now": "1 (555) 123-4567",
    "AB12 4111 1111 1111 1111": "4111 1111 1111 1111",
    "in 2024 4111 1111 1111 1111": "4111 1111 1111 1111",
}


@pytest.mark.parametrize("text", WHOLE)
def test_found_changed_and_undone(text):
    made, n = pii.pseudonymise(text, pii.Feistel(KEY))
    assert n == 1 and WHOLE[text] not in made
    head, tail = text.split(WHOLE[text])
    assert made.startswith(head) and made.endswith(tail) and len(made) == len(text)
    assert pii.pseudonymise(made, pii.Feistel(KEY, undo=True)) == (text, 1)


def test_two_values_side_by_side():
    made, n = pii.pseudonymise("BE68539007547034 4111 1111 1111 1111", pii.Feistel(KEY))
    assert n == 2 and "1111 1111" not in made and "5390" not in made


def test_equal_phones_however_written():
    f = pii.Feistel(KEY)
    digits = [pii.pseudonymise(t, f)[0].lstrip("+").replace(" ", "-") for t in ("1-555-123-4567", "+1 555 123 4567")]
    assert digits[0] == digits[1]


def test_undo_of_day_first_dates_and_inner_cards():
    rng = random.Random(448)
    for _ in range(300):
        date = f"{rng.randrange(1, 29):02d}/{rng.randrange(1, 13):02d}/{rng.randrange(1900, 2100)}"
        body = "4" + "".join(rng.choices("0123456789", k=14))
        card = next(body + c for c in "0123456789" if pii.luhn(body + c))
        text = f"{date} and {rng.randrange(1900, 2100)} {card[:4]} {card[4:8]} {card[8:12]} {card[12:]}"
        made, n = pii.pseudonymise(text, pii.Feistel(KEY))
        assert n == 2
        assert pii.pseudonymise(made, pii.Feistel(KEY, undo=True)) == (text, 2)
