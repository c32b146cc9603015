"""Forms of surrogates by regular expressions, and texts by hand; no function of the operator finds the entities here."""

import random
import re

import pytest

from tidewright.llm import pii

FORMS = {
    "ssn": (lambda r: f"{r.randrange(10**9):09}", r"\d{9}"),
    "card": (lambda r: f"4{r.randrange(10**15):015}", r"4\d{15}"),
    "phone": (lambda r: f"{r.randrange(2 * 10**9, 10**10)}", r"\d{10}"),
    "iban": (lambda r: f"DE{r.randrange(10**20):020}", r"DE\d{20}"),
    "ip": (lambda r: ".".join(str(r.randrange(1, 255)) for _ in range(4)), r"(?:[1-9]\d{0,2}\.){3}[1-9]\d{0,2}"),
    "ipv6": (lambda r: ":".join(f"{r.randrange(65536):04x}" for _ in range(8)), r"(?:[0-9a-f]{4}:){7}[0-9a-f]{4}"),
    "email": (lambda r: f"{r.randrange(10**6):06}@shop{r.randrange(99)}.example.org", r"\d{6}@[a-z]{4}\d{1,2}\.[a-z]{7}\.org"),
    "secret": (lambda r: f"{r.randrange(10**12):012}", r"\d{12}"),
}


@pytest.mark.parametrize("kind", FORMS)
def test_forms_of_drawn_values(kind):
    draw, form = FORMS[kind]
    r = random.Random(kind)
    for _ in range(2000):
        value = draw(r)
        new = pii.surrogate(kind, value)
        assert re.fullmatch(form, new) and len(new) == len(value), (value, new)


def test_hexadecimal_secrets_stay_so():
    r = random.Random(1)
    for _ in range(500):
        assert re.fullmatch("[0-9a-f]{32}", pii.surrogate("secret", f"{r.getrandbits(128) | 10 << 124:032x}"[:31] + "7"))
    assert re.fullmatch("[A-Z][a-z]{3}-[0-9]{2}!", pii.surrogate("secret", "Abcd-42!"))


@pytest.mark.parametrize(
    "text, private, kept",
    [
        ("Prof. Dr. Max Weber came.", ["Max", "Weber"], r"Prof\. Dr\. \w+ \w+ came\."),
        ("Mr. J. Smith came.", ["J. S", "Smith"], r"Mr\. [A-Z]\. \w+ came\."),
        ("Dr. med. Eva Klein came.", ["Eva", "Klein"], r"Dr\. med\. \w+ \w+ came\."),
        ("Mr.  John Smith and Mrs.\nAnn Lee came.", ["John", "Smith", "Ann", "Lee"], r"Mr\.  \w+ \w+ and Mrs\.\n\w+ \w+ came\."),
        ("Mrs. Anna de Vries came. Mrs. de Vries left.", ["Anna", "Vries"], r"Mrs\. \w+ de (\w+) came\. Mrs\. de \1 left\."),
        ("Señora Ana María López García vino.", ["Ana", "María", "López", "García"], r"Señora \w+ \w+ \w+ \w+ vino\."),
        ("Dr. John Smith came. JOHN SMITH left.", ["John", "Smith", "JOHN", "SMITH"], r"Dr\. (\w+) (\w+) came\. [A-Z]+ [A-Z]+ left\."),
        ("From 2001:0db8:0000:0000:0000:ff00:0042:8329 now.", ["2001", "0db8", "8329"], r"From (?:[0-9a-f]{4}:){7}[0-9a-f]{4} now\."),
        ("Card 3782 822463 10005 paid.", ["822463", "10005"], r"Card 3\d{3} \d{6} \d{5} paid\."),
        ("SSN 123-45-6789.", ["123-45", "6789"], r"SSN \d{3}-\d{2}-\d{4}\."),
    ],
)
def test_texts_by_hand(spark, text, private, kept):
    (row,) = pii.replace_pii(spark.createDataFrame([(1, text)], "doc_id long, text string")).collect()
    assert re.fullmatch(kept, row["text"]), row["text"]
    assert not any(p in row["text"] for p in private), row["text"]


def test_people_stay_apart_and_the_same(spark):
    r = random.Random(2)
    families = ["Lopez", "Clark", "Brown", "Evans", "Ford", "Gray", "Hall", "King"]
    docs = []
    for i in range(300):
        a, b = r.sample(families, 2)
        docs.append((i, f"Mr. John {a} met Mr. Mark {b}. Mr. {a} left, Mr. {b} stayed."))
    docs.append((300, "Mr. John Smith met Ms. Jane Smith. Mr. Smith left, Ms. Smith stayed."))
    for row in pii.replace_pii(spark.createDataFrame(docs, "doc_id long, text string")).collect():
        a, b, c, d = re.fullmatch(r"M[rs]\. (.+) met M[rs]\. (.+)\. M[rs]\. (.+) left, M[rs]\. (.+) stayed\.", row["text"]).groups()
        assert a != b and c != d, row["text"]
        assert c in (a, a.split()[-1]) and d in (b, b.split()[-1]), row["text"]
